"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts elsewhere.

Every window of ``length`` bytes has an anchor, the leftmost least hash of the ``GRAM``-byte runs in it; equal
windows have equal anchors. Anchors that occur once in the corpus hold no repeat. For the others each document
cuts out the stretch whose windows they anchor, so that every window lies in exactly one stretch and all its
equals in stretches of the same anchor. Stretches are dealt to shards by anchor, and a suffix array per shard,
made by induced sorting, finds the windows that start more than once (``suffix_array.repeats``). Stretches that are
equal within a batch go on once. Of an anchor that more than ``HOT`` stretches share, the windows are grouped by hash over
all tasks instead, so that no shard grows with a very frequent passage.

With ``words``, passages of so many words that have fewer than ``length`` bytes are anchors of their own: those that
occur twice are repeats, so that no passage of that many words is too short in bytes.

Documents with a copy are covered whole; of each group of copies one stands for all.

Results for odd input: a null or empty text has no bytes; rows with a null ``doc_id`` come back with nothing
removed and take no part; repeated rows are one document; of rows that share a ``doc_id`` with different texts, long
enough to hold a repeat, the one of least SHA-256 is the document and the others come back unchanged; an empty table gives no rows; further
columns are not read. Equality of strings is equality of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm import arrays
from newsdesk.llm.storage import documents, written
from newsdesk.llm.substring_dedup import NOTHING, sliding_least
from newsdesk.llm.suffix_array import repeats

LENGTH, GRAM = 400, 64
HOT = 1_500
SHARD_BYTES = 1_000_000


def anchors(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one anchor: row, first window start, and the anchor; and the end of the last window."""
    gram = min(GRAM, length)
    sizes = np.diff(off)
    windows = np.maximum(sizes - length + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), windows)
    if not len(rows):
        return rows, rows, np.zeros(0, np.uint64)
    start = np.arange(len(rows)) - np.repeat(np.cumsum(windows) - windows, windows) + off[rows]
    prefix = arrays.prefix_hash(raw, arrays.BYTE_POWERS)
    at = np.arange(len(raw) - gram + 1)
    hashes = arrays.range_hash(prefix, at, at + gram, arrays.BYTE_POWERS)
    span = length - gram + 1
    least = sliding_least(hashes, span)[start]
    # The place of the leftmost least run: where it was last seen from the right, no earlier than the window.
    new = np.ones(len(rows), bool)
    new[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1]) | (hashes[start[:-1]] == least[:-1])
    first = np.flatnonzero(new)
    return rows[first], start[first], least[first]


def passages(raw: np.ndarray, off: np.ndarray, length: int, words: int) -> tuple[np.ndarray, ...]:
    """Row, start, end and anchor of runs of so many words that have fewer than ``length`` bytes."""
    of = arrays.Words(raw, off, False)
    at = np.flatnonzero(np.arange(len(of)) <= of.bounds[1:][of.row] - words)
    start, ends = of.start[at], of.end[at + words - 1]
    few = ends - start < length
    rows, start, ends = of.row[at][few], start[few], ends[few]
    return rows, start, ends, arrays.mix(arrays.range_hash(arrays.prefix_hash(raw, arrays.BYTE_POWERS), start, ends, arrays.BYTE_POWERS))


def merged_spans(rows: np.ndarray, start: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch as one; they come by row, and both bounds ascend within a row."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (start[1:] > ends[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    return rows[first], start[first], ends[last if len(first) else first]


def _stretches(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    rows, start, anchor = anchors(raw, off, length)
    ends = np.append(start[1:], 0) + length - 1
    last = np.append(rows[1:] != rows[:-1], True)[: len(rows)]
    ends = np.where(last, off[rows + 1], ends[: len(rows)]) if len(rows) else rows
    return rows, start, ends, anchor


PROFILE = "doc_id long, n_bytes long, whole binary, anchors array<long>"


def _profile(batches: Iterator[pa.RecordBatch], length: int, words: int) -> Iterator[pa.RecordBatch]:
    arrays.fresh_memory()
    for batch in batches:
        for piece in arrays.slices(batch, "text"):
            raw, off = arrays.byte_view(piece.column("text"))
            view = memoryview(np.ascontiguousarray(raw))
            whole = [hashlib.sha256(view[a:b]).digest() for a, b in zip(off, off[1:], strict=False)]
            rows, _, anchor = anchors(raw, off, length)
            if words:
                few, _, _, more = passages(raw, off, length, words)
                rows, anchor = np.concatenate([rows, few]), np.concatenate([anchor, more])
            order = np.lexsort((anchor, rows))
            rows, anchor = rows[order], anchor[order]
            # An anchor that stands twice in a document is told by standing here twice; more is not needed.
            same = np.zeros(len(rows), bool)
            same[2:] = (rows[2:] == rows[:-2]) & (anchor[2:] == anchor[:-2])
            rows, anchor = rows[~same], anchor[~same]
            bounds = np.searchsorted(rows, np.arange(piece.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.diff(off)), pa.array(whole, pa.binary()), arrays.list_array(anchor.view(np.int64), bounds, pa.int64())],
                names=["doc_id", "n_bytes", "whole", "anchors"],
            )


STRETCHES = "doc_id long, start long, anchor long, hot boolean, stretch binary"


def _cut(batches: Iterator[pa.RecordBatch], length: int, words: int) -> Iterator[pa.RecordBatch]:
    """Stretches of repeated anchors; of equal ones in a batch one, the others as already repeated (no bytes)."""
    arrays.fresh_memory()
    for batch in batches:
        for piece in arrays.slices(batch, "text"):
            raw, off = arrays.byte_view(piece.column("text"))
            rows, start, ends, anchor = _stretches(raw, off, length)
            if words:
                rows, start, ends, anchor = map(np.concatenate, zip((rows, start, ends, anchor), passages(raw, off, length, words), strict=True))
            listed = piece.column("anchors")
            flat = listed.flatten()
            of_row = np.repeat(np.arange(piece.num_rows), np.diff(listed.offsets.to_numpy()))
            known = flat.field("anchor").to_numpy(zero_copy_only=False).view(np.uint64)
            mark = np.uint64(arrays.BYTE_BASE)
            wanted, there = arrays.mix(known ^ of_row.astype(np.uint64) * mark), arrays.mix(anchor ^ rows.astype(np.uint64) * mark)
            order = np.argsort(wanted)
            at = np.searchsorted(wanted, there, sorter=order)
            at[at == len(wanted)] = 0
            at = order[at] if len(wanted) else at
            keep = np.flatnonzero(wanted[at] == there) if len(wanted) else np.zeros(0, np.int64)
            hot = flat.field("hot").to_numpy(zero_copy_only=False)[at[keep]] if len(keep) else np.zeros(0, bool)
            rows, start, ends, anchor = rows[keep], start[keep], ends[keep], anchor[keep]
            # The anchor of a short passage is the whole of it, and occurs elsewhere: neighbouring ones are one span.
            short = ends - start < length
            gone = merged_spans(rows[short], start[short], ends[short])
            rows, start, ends, anchor, hot = (x[~short] for x in (rows, start, ends, anchor, hot))
            content = arrays.range_hash(arrays.prefix_hash(raw, arrays.BYTE_POWERS), start, ends, arrays.BYTE_POWERS) if len(rows) else anchor
            _, first, place, times = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
            one = np.zeros(len(rows), bool)
            one[first] = True
            data, n = raw.tobytes(), len(gone[0])
            cut = [data[a:b] if o else None for a, b, o in zip(start.tolist(), ends.tolist(), one.tolist(), strict=True)] + [None] * n
            rows, start, ends = (np.concatenate(x) for x in zip((rows, start, ends), gone, strict=True))
            anchor, hot, known = np.append(anchor, np.zeros(n, np.uint64)), np.append(hot, np.zeros(n, bool)), np.append(times[place] > 1, np.ones(n, bool))
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False)[rows]
            low = start - off[rows]
            names = STRETCH_NAMES
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low), pa.array(ends - start), pa.array(anchor.view(np.int64)), pa.array(hot), pa.array(known), pa.array(cut, pa.binary())], names=names)


STRETCH = "doc_id long, start long, size long, anchor long, hot boolean, known boolean, stretch binary"
STRETCH_NAMES = [x.split()[0] for x in STRETCH.split(", ")]
SPANS = "doc_id long, a long, b long"


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of bytes that repeated windows cover, from a suffix array of each shard."""
    arrays.fresh_memory()
    for table in arrays.groups(batches, "shard"):
        parts = [x.as_buffer() for x in table.column("stretch")]
        sizes = np.array([len(p) for p in parts])
        # UTF-8 has no byte 255, so no string of a stretch crosses it.
        s = np.frombuffer(b"\xff".join(p.to_pybytes() for p in parts), np.uint8)
        first = np.cumsum(sizes + 1) - sizes - 1
        inside = np.zeros(len(s) + 1, np.int32)
        inside[first] += 1
        inside[first + sizes - length + 1] -= 1
        again = repeats(s, length, np.cumsum(inside[:-1]) > 0)
        edge = np.diff(again.astype(np.int8), prepend=0, append=0)
        a, b = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        row = np.searchsorted(first, a, side="right") - 1
        start = table.column("start").to_numpy()[row] + a - first[row]
        yield pa.RecordBatch.from_arrays([pa.array(table.column("doc_id").to_numpy()[row]), pa.array(start), pa.array(start + (b - a) + length - 1)], names=["doc_id", "a", "b"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    arrays.fresh_memory()
    for batch in batches:
        for piece in arrays.slices(batch, "stretch"):
            raw, off = arrays.byte_view(piece.column("stretch"))
            count = np.diff(off) - length + 1
            row = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = off[row] + step
            window = arrays.range_hash(arrays.prefix_hash(raw, arrays.BYTE_POWERS), at, at + length, arrays.BYTE_POWERS)
            start = piece.column("start").to_numpy()[row] + step
            yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), pa.array(piece.column("doc_id").to_numpy()[row]), pa.array(start)], names=["window", "doc_id", "start"])


def _kept(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    arrays.fresh_memory()
    for batch in batches:
        removed, runs, kept, rest = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            edge = np.zeros(len(raw) + 2, np.int32)
            np.add.at(edge, spans.values.field("a").to_numpy(zero_copy_only=False), 1)
            np.add.at(edge, spans.values.field("b").to_numpy(zero_copy_only=False), -1)
            gone = np.cumsum(edge)[: len(raw)] > 0
            left = raw[~gone].tobytes()
            removed.append(int(gone.sum()))
            runs.append(int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum()))
            kept.append(hashlib.sha256(left).digest())
            rest.append(left.decode("utf-8", "ignore") if texts else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array(rest, pa.string())],
            names=["rep", "removed", "runs", "rest", "kept_text"],
        )


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, texts: bool = False, words: int = 0) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs`` (``doc_id`` long, ``text`` string).

    With ``words`` also passages of so many words are repeats, whatever their bytes. With ``texts`` also ``whole``, the SHA-256 of the text, and ``kept_text``, null where nothing was removed; a
    character cut in two is dropped from it.
    """
    docs = docs.select("doc_id", "text")
    profile = written(docs.mapInArrow(partial(_profile, length=length, words=words), PROFILE), "suffixes-profile")
    long = profile.where("doc_id is not null and size(anchors) > 0")
    chosen = long.groupBy("doc_id").agg(F.min("whole").alias("whole"))
    reps = chosen.groupBy("whole").agg(F.min("doc_id").alias("rep"), (F.count("*") > 1).alias("copied"))

    mine = long.alias("long").join(reps.alias("reps"), F.col("doc_id") == F.col("rep")).where("long.whole = reps.whole")
    mine = mine.dropDuplicates(["doc_id"]).select("doc_id", F.explode("anchors").alias("anchor"))
    mine = written(mine, "suffixes-anchors")
    again = mine.groupBy("anchor").count().where("count > 1").select("anchor", (F.col("count") > hot).alias("hot"))
    wanted = mine.join(again, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "hot")).alias("anchors"))
    wanted = wanted.join(reps.select(F.col("rep").alias("doc_id"), "whole"), "doc_id")
    texts_of = docs.join(wanted, "doc_id").where("unhex(sha2(text, 256)) = whole").dropDuplicates(["doc_id"])
    texts_of = written(texts_of.select("doc_id", "text", "anchors"), "suffixes-texts")

    stretches = written(texts_of.mapInArrow(partial(_cut, length=length, words=words), STRETCH), "suffixes-stretches")
    weight = stretches.where("stretch is not null and not hot").agg(F.sum("size")).first()[0] or 0
    shards = weight // SHARD_BYTES + 1
    dealt = stretches.where("stretch is not null and not hot").select("doc_id", "start", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "stretch")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    spans = dealt.mapInArrow(partial(_shards, length=length), SPANS)
    at_once = stretches.where("known").selectExpr("doc_id", "start as a", "start + size as b")
    windows = stretches.where("stretch is not null and hot").select("doc_id", "start", "stretch")
    windows = windows.mapInArrow(partial(_windows, length=length), "window long, doc_id long, start long")
    common = windows.groupBy("window").count().where("count > 1").select("window")
    frequent = windows.join(common, "window").selectExpr("doc_id", "start as a", f"start + {length} as b")
    spans = spans.union(at_once).union(frequent).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    rest = texts_of.select("doc_id", "text").join(spans, "doc_id")
    rest = rest.mapInArrow(partial(_kept, texts=texts), "rep long, removed long, runs long, rest binary, kept_text string")

    named = reps.withColumnRenamed("rep", "of").join(rest, F.col("of") == F.col("rep"), "left").drop("rep")
    out = profile.drop("anchors").join(chosen.join(named, "whole"), ["doc_id", "whole"], "left")
    taken = "(of is not null and copied)"
    columns = [
        F.expr(f"case when {taken} then n_bytes else coalesce(removed, 0L) end").alias("n_removed"),
        F.expr(f"case when {taken} then 1L else coalesce(runs, 0L) end").alias("n_spans"),
        F.expr(f"case when {taken} then '{NOTHING}' else lower(hex(coalesce(rest, whole))) end").alias("kept_sha256"),
    ]
    if texts:
        columns += [F.col("whole"), F.expr(f"case when {taken} then '' else kept_text end").alias("kept_text")]
    return out.where("doc_id is not null").select("doc_id", "n_bytes", *columns).unionByName(
        profile.where("doc_id is null").selectExpr("doc_id", "n_bytes", "0L as n_removed", "0L as n_spans", "lower(hex(whole)) as kept_sha256", *(["whole", "cast(null as string) as kept_text"] if texts else []))
    )


def cleaned(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """``docs``, all rows and columns, with ``text`` less its repeated strings; ``n_chars``, if there, follows it."""
    name = f"kept_{uuid.uuid4().hex}"
    changed = without_repeats(docs, length, texts=True, words=words).where("kept_text is not null")
    changed = changed.selectExpr("doc_id as of", "whole", f"kept_text as {name}").dropDuplicates(["of", "whole"])
    same = (docs["doc_id"] == changed["of"]) & (F.unhex(F.sha2(docs["text"], 256)) == changed["whole"])
    text = F.coalesce(changed[name], docs["text"])
    known = {"text": text.alias("text"), "n_chars": F.when(changed[name].isNull(), docs["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in docs.columns else {"text": text.alias("text")}
    return docs.join(changed, same, "left").select(*[known.get(c, docs[c]) for c in docs.columns])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
