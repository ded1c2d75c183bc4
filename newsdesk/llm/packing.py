"""Best-fit packing: pieces of tokenized documents into sequences of bounded length.

Best-fit decreasing looks only at lengths, of which there are at most ``capacity``. So the plan is made from
the table of counts per length: for each length from the longest down, a segment tree over remaining
capacities finds the tightest open bins, and as many pieces as bins of that kind move at once. The plan says
which ranks of a length go to which bins; its size depends on the capacity, not on the corpus. The ranks are
dealt out over salted groups, so no length is gathered in one task.

Results for odd input: a null or empty text is the end token alone; rows with a null or repeated ``doc_id``
are packed like any others; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm import arrays
from newsdesk.llm.storage import documents, written
from newsdesk.llm.word_tokens import WordTokens

CAPACITY = 2048
END = 0
SALTS = 64


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    tokens = WordTokens.of(tokenizer)
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            ids, bounds = tokens.encode(part.column("text"))
            ids = np.insert(ids, bounds[1:], end).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            counts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            length = np.minimum(capacity, sizes[row] - piece * capacity)
            at = (bounds[:-1][row] + piece * capacity).tolist()
            view = memoryview(ids).cast("B")
            sums = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )


class Tightest:
    """Segment tree over remaining capacities: how many bins are open below each node."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, left: int, n: int) -> None:
        at = self.leaves + left
        while at:
            self.open[at] += n
            at >>= 1

    def at_least(self, size: int) -> int | None:
        """The smallest remaining capacity of an open bin that is ``size`` or more."""
        at = self.leaves + size
        if self.open[at]:
            return size
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` pieces: (length, first rank, pieces, first bin, offset)."""
    tree, bins, out = Tightest(capacity), 0, []
    runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for size in sorted(counts, reverse=True):
        rank, todo = 0, counts[size]
        while todo:
            left = tree.at_least(size)
            if left is None:
                # New bins, each filled as far as pieces of this length go.
                each = capacity // size
                full, rest = divmod(todo, each)
                for i in range(each):
                    n = full + (i < rest)
                    if n:
                        out.append((size, rank, n, bins, i * size))
                        rank += n
                for n, first, used in ((full, bins, each), (1 if rest else 0, bins + full, rest)):
                    if n and (room := capacity - used * size):
                        runs[room].append((first, n))
                        tree.add(room, n)
                bins, todo = bins + full + bool(rest), 0
                continue
            first, n = runs[left].pop()
            take = min(n, todo)
            if take < n:
                runs[left].append((first + take, n - take))
            tree.add(left, -take)
            out.append((size, rank, take, first, capacity - left))
            if left > size:
                runs[left - size].append((first, take))
                tree.add(left - size, take)
            rank, todo = rank + take, todo - take
    return out


def _placed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    keys, rows = shared.value
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
        _, first_rank, _, first_bin, offset = (rows[at, i] for i in range(5))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first_bin + rank - first_rank), pa.array(offset)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = docs.select("doc_id", "text").mapInArrow(partial(_pieces, tokenizer=tokenizer, capacity=capacity, end=end), kinds)
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS))
    pieces = written(pieces, "packing-pieces").withColumn("salt", salt)
    groups = pieces.groupBy("length", "salt").count()
    # At most ``capacity`` x ``SALTS`` rows, whatever the corpus.
    groups = groups.selectExpr("length", "salt", "sum(count) over (partition by length order by salt) - count as before")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    made = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((made[:, 0] * (1 << 44) + made[:, 1], made))
    ranked = pieces.withColumn("row", F.expr("row_number() over (partition by length, salt order by doc_id, piece)"))
    ranked = ranked.join(groups, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("row") - 1)
    placed = partial(_placed, shared=shared)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed, f"{kinds}, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), "word_bpe_49k.json")
