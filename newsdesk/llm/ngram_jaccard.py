"""N-gram Jaccard join: documents whose word n-gram sets overlap, and the groups they form.

Two documents link when ``den * |A & B| >= num * |A | B|``. Linked sets of sizes a <= b differ in at most
k = (a + b)(den - num)/(den + num) tokens. Tokens are dealt by hash to k + 1 + e parts, so linked sets have
1 + e equal parts at least, and the strongest of these, in an order that a part's tokens alone settle, is among the
k + 1 strongest of both: those make candidates, without loss. Parts are the stronger, the more tokens they have that
are not common in a sample of the documents, so that common passages do not chain candidates; any sample gives the
same links. Candidates form clusters; a cluster is cut into blocks of bounded weight, and signature trees find the exact links of each block and between blocks.

Results for odd input: a null or empty text has no shingle and is linked with nothing; rows with a null
``doc_id`` come back with a null component and take no part; rows that share a ``doc_id`` are one document;
copies share their component; an empty table gives no rows; further columns are not read.
Tokens are 64-bit hashes of shingles, sets are told apart by 128 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsdesk.llm import arrays
from newsdesk.llm.graph import components
from newsdesk.llm.signature_tree import Forest, SignatureTree, links
from newsdesk.llm.storage import documents, written

CLASS_RATIO = 1.4
BLOCK_TOKENS = 1_000_000
"""Tokens of the sets in one block: 8 MB, and as much again in bitmaps at most."""
ANCHOR_TOKENS = 50_000
"""Of a cluster of several blocks, every block also gets the same sets of about so many tokens."""

SAMPLE, COMMON = 20_000, 3
"""A token is common if it is in so many of about so many documents."""
COMMON_BITS = 25
"""Common tokens are told by so many of their bits (4 MB)."""

SETS = "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"


class Parts:
    """The dealing of tokens for sets whose smaller one is in a class of sizes."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        # In smaller sets any difference is too much; only their copies link.
        self.first = -(-num // (den - num))

    def class_of(self, size: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(size, 1)) / np.log(CLASS_RATIO) + 1e-9).astype(np.int64)

    @cache
    def count(self, number: int) -> tuple[int, int]:
        """Parts of a class, and the largest size of a smaller set in it."""
        a = int(np.ceil(CLASS_RATIO ** (number + 1))) + 1
        return 2 * self.differing(a + a * self.den // self.num + 1) + 7, a

    def differing(self, total: int) -> int:
        """Tokens, and so parts, in which linked sets of so many tokens together differ at most."""
        return total * (self.den - self.num) // (self.den + self.num)

    def keys(self, tokens: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """Keys of the strongest parts, of each class in which the set can be one of a linked pair."""
        size = len(tokens)
        least = -(-size * self.num // self.den)
        own = int(self.class_of(np.array([size]))[0])
        out = []
        for number in range(int(self.class_of(np.array([least]))[0]), own + 1):
            m, most = self.count(number)
            part = (tokens >> np.uint64(20)) % np.uint64(m)
            part = part.astype(np.int64)
            order = np.argsort(part, kind="stable")
            filled = np.bincount(part, minlength=m)
            bounds = np.concatenate([[0], np.cumsum(filled)])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(arrays.mix(tokens[order]))])
            salt = np.uint64((number * 1_000_003 + 17) & 0xFFFFFFFF) * np.uint64(arrays.MIX_2 & 0xFFFFFFFF)
            key = arrays.mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ (np.arange(m, dtype=np.uint64) * np.uint64(arrays.WORD_BASE) + salt))
            # In its own class the set may be the smaller one, in a lower class it is the larger one.
            k = self.differing(size + (size * self.den // self.num if number == own else min(size, most)))
            strength = np.lexsort((key, filled, np.bincount(part[rare], minlength=m)))
            out.append(key[strength[-(k + 1) :]])
        return np.concatenate(out)


def _of_sample(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Tokens of the documents of each batch; copies in it count once."""
    for batch in batches:
        for piece in arrays.slices(batch, "text"):
            rows, tokens = arrays.shingles(arrays.words_of(piece.column("text"), lower=True), n)
            bounds = np.searchsorted(rows, np.arange(piece.num_rows + 1))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(arrays.mix(tokens))])
            _, first = np.unique(total[bounds[1:]] - total[bounds[:-1]], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[np.isin(rows, first)].view(np.int64))], names=["token"])


def common_tokens(docs: DataFrame, n: int) -> bytes:
    """A bit for each hash of a token that is common in a sample of the documents."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    found = sample.mapInArrow(partial(_of_sample, n=n), "token long").groupBy("token").count().where(f"count >= {COMMON}")
    place = found.selectExpr(f"shiftrightunsigned(token, {64 - COMMON_BITS}) as place").distinct().toArrow()["place"].to_numpy()
    bits = np.zeros(1 << COMMON_BITS, bool)
    bits[place.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _sets(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, common) -> Iterator[pa.RecordBatch]:
    arrays.fresh_memory()
    parts = Parts(num, den)
    bits = np.frombuffer(common.value, np.uint8)
    for batch in batches:
        for piece in arrays.slices(batch, "text"):
            rows, tokens = arrays.shingles(arrays.words_of(piece.column("text"), lower=True), n)
            bounds = np.searchsorted(rows, np.arange(piece.num_rows + 1))
            mixed = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(arrays.mix(tokens ^ np.uint64(salt)))]) for salt in (arrays.MIX_1, arrays.WORD_BASE)]
            d1, d2 = (m[bounds[1:]] - m[bounds[:-1]] for m in mixed)
            place = tokens >> np.uint64(64 - COMMON_BITS)
            rare = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 0
            ids = piece.column("doc_id")
            known = np.array(ids.is_valid())
            keys, ends = [], [0]
            for i in range(piece.num_rows):
                own = tokens[bounds[i] : bounds[i + 1]]
                if known[i] and len(own) >= parts.first:
                    keys.append(parts.keys(own, rare[bounds[i] : bounds[i + 1]]))
                    ends.append(ends[-1] + len(keys[-1]))
                else:
                    ends.append(ends[-1])
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(bounds)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), arrays.list_array(flat, np.array(ends), pa.int64())],
                names=["doc_id", "n_shingles", "d1", "d2", "keys"],
            )


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a batch: the least document of each goes on, the others are joined to it here.

    A key that a third of all rows share so leaves one row per batch.
    """
    arrays.fresh_memory()
    for batch in batches:
        keys = batch.column("keys")
        ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), np.diff(keys.offsets.to_numpy()))
        keys = keys.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        pivot = ids[first][np.cumsum(first) - 1] if len(ids) else ids
        edges = np.unique(np.stack([ids, pivot])[:, ids != pivot], axis=1)
        at = np.concatenate([keys[first], arrays.mix(edges[0].astype(np.uint64) ^ arrays.mix(edges[1].astype(np.uint64))).view(np.int64)])
        link = pa.array(np.concatenate([np.zeros(first.sum(), np.int64), edges[1]]), mask=np.arange(len(at)) < first.sum())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([ids[first], edges[0]])), link], names=["key", "doc_id", "link"])


def _tokens(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    arrays.fresh_memory()
    for batch in batches:
        for piece in arrays.slices(batch, "text"):
            rows, tokens = arrays.shingles(arrays.words_of(piece.column("text"), lower=True), n)
            bounds = np.searchsorted(rows, np.arange(piece.num_rows + 1))
            raw = tokens.tobytes()
            sets = pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("cluster"), piece.column("blocks"), piece.column("anchors"), sets], names=["doc_id", "cluster", "blocks", "anchors", "tokens"])


def _links(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Exact links within each block; where some rows are ``visitor``, only between those and the others."""
    arrays.fresh_memory()
    for table in arrays.groups(batches, "block"):
        ids = table.column("doc_id").to_numpy()
        label = table.column("label").to_numpy()
        visitor = table.column("visitor").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
        bits = 1 << max(9, int(2 * max(map(len, sets)) - 1).bit_length())
        bits = min(bits, 1 << max(9, (BLOCK_TOKENS * 64 // len(sets)).bit_length() - 1))
        forest, seen = Forest(len(ids)), {}
        for i, x in enumerate(label):
            forest.join(seen.setdefault(int(x), i), i)
        trees = [SignatureTree([sets[i] for i in at], at, bits) for at in (np.flatnonzero(~visitor), np.flatnonzero(visitor)) if len(at)]
        found = np.array(list(links(trees[0], trees[-1], forest, num, den)), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], names=["a", "b"])


def _compared(blocks: DataFrame, num: int, den: int) -> DataFrame:
    dealt = blocks.repartition("block").sortWithinPartitions("block", "doc_id")
    return dealt.mapInArrow(partial(_links, num=num, den=den), "a long, b long")


def similar_documents(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id`` long, ``text`` string)."""
    docs = docs.select("doc_id", "text")
    common = docs.sparkSession.sparkContext.broadcast(common_tokens(docs, n))
    sets = written(docs.mapInArrow(partial(_sets, n=n, num=num, den=den, common=common), SETS), "jaccard-sets")
    common.destroy()
    known = sets.where("doc_id is not null and n_shingles > 0")
    kinds = known.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    of_key = "key long, doc_id long, link long"
    keys = known.where("size(keys) > 0").select("doc_id", "keys").mapInArrow(_combined, of_key)
    spec = "partition by key order by doc_id rows between unbounded preceding and current row"
    pivots = keys.selectExpr("doc_id as a", f"coalesce(link, first(doc_id) over ({spec})) as b")
    clusters = components(pivots.where("a <> b").distinct()).withColumnsRenamed({"node": "doc_id", "component": "cluster"})

    reps = kinds.groupBy("rep").agg(F.max("n_shingles").alias("weight")).join(clusters, F.col("rep") == F.col("doc_id"))
    reps = reps.select("doc_id", "cluster", "weight")
    total = reps.groupBy("cluster").agg(F.sum("weight").alias("total"), F.count("*").alias("members")).where("members > 1")
    reps = reps.join(total, "cluster").select(
        "doc_id", "cluster", F.ceil(F.col("total") / block_tokens).alias("blocks"),
        (F.pmod(F.xxhash64("doc_id", F.lit("anchor")), F.lit(1 << 40)).cast("double") * F.col("total") < F.lit(1 << 40) * F.lit(float(ANCHOR_TOKENS))).alias("anchors"),
    )
    members = docs.join(reps, "doc_id").mapInArrow(partial(_tokens, n=n), "doc_id long, cluster long, blocks long, anchors boolean, tokens binary")
    members = written(members, "jaccard-members").withColumn("home", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    spread = "if(blocks > 1 and anchors, sequence(0L, blocks - 1), array(home))"
    blocks = members.selectExpr("doc_id", "cluster", "doc_id as label", "false as visitor", "tokens", f"explode({spread}) as part").withColumn("block", F.xxhash64("cluster", "part"))
    found = written(_compared(blocks.drop("cluster", "part"), num, den), "jaccard-links")

    wide = members.where("blocks > 1")
    if not wide.isEmpty():
        found = found.union(_between_blocks(wide, found, num, den, block_tokens))
    joined = components(found)
    named = kinds.join(joined, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
    return out.selectExpr("doc_id", "n_shingles", "if(doc_id is null, null, coalesce(component_id, doc_id)) as component_id")


def _between_blocks(wide: DataFrame, found: DataFrame, num: int, den: int, block_tokens: int) -> DataFrame:
    """Links between blocks of one cluster.

    The members of a cluster's largest component need no comparison with each other; each other
    member visits every block of its cluster, in as many turns as keep a block's weight bounded.
    """
    label = wide.select("doc_id", "cluster").join(components(found), F.col("doc_id") == F.col("node"), "left")
    label = label.select("doc_id", "cluster", F.coalesce("component", "doc_id").alias("label"))
    size = label.groupBy("cluster", "label").count()
    largest = size.groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    label = written(label.join(largest, "cluster").drop("cluster"), "jaccard-labels")
    rows = wide.join(label, "doc_id").withColumn("visitor", F.col("label") != F.col("largest"))
    weight = rows.groupBy("cluster").agg(F.sum(F.expr("if(visitor, octet_length(tokens) div 8, 0)")).alias("weight"))
    rows = rows.join(weight.where("weight > 0").selectExpr("cluster", f"weight div {block_tokens} + 1 as turns"), "cluster")
    guests = rows.where("visitor").selectExpr("*", "explode(sequence(0L, blocks - 1)) as part", "pmod(xxhash64(doc_id, 'turn'), turns) as turn")
    hosts = rows.withColumn("visitor", F.lit(False)).selectExpr("*", "home as part", "explode(sequence(0L, turns - 1)) as turn")
    blocks = hosts.unionByName(guests).withColumn("block", F.xxhash64("cluster", "part", "turn"))
    return _compared(blocks.select("block", "doc_id", "label", "visitor", "tokens"), num, den)


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of ``docs``, all columns: of each group of linked documents the one of least ``doc_id`` stays.

    Of rows that share its ``doc_id`` the one of least text stays; rows with a null ``doc_id`` all stay.
    """
    least = similar_documents(docs, n, num, den).where("doc_id = component_id").selectExpr("doc_id as least").distinct()
    row = f"row_{uuid.uuid4().hex}"
    known = docs.join(least, docs["doc_id"] == least["least"], "left_semi")
    known = known.withColumn(row, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(row) == 1).drop(row)
    return known.union(docs.where(docs["doc_id"].isNull()))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir), n=3, num=90, den=100)
