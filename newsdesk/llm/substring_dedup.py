"""Substring dedup: words covered by a window that occurred before, found behind a count-min prefilter.

A window is ``n`` words in a row of one document. Its anchor is the least hash of the ``GRAM``-word runs in
it, so equal windows have equal anchors and the count of an anchor is never below that of its windows.
Pass 1 counts anchor places in a count-min sketch per batch; the sketches are merged by column, and of the
merged one only "two or more" is kept, ``DEPTH * COLUMNS`` bits whatever the input. Pass 2 groups exactly, by
64-bit hashes, the windows whose anchor the sketch estimates as repeated: first whole stretches of windows with one
anchor, then, among stretches that are the first of their kind, the windows one by one. The sketch only overestimates,
so no repeat is lost; when it is overfull, more windows are grouped and the result stays the same.

Results for odd input: a null or empty text has no words; rows with a null ``doc_id`` come back with nothing
removed and take no part; copies of one row get equal results; of rows that share a ``doc_id`` with different
words, enough for a window, the one of least digest is the document and the others come back unchanged; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm import arrays
from newsdesk.llm.storage import documents, written

WINDOW, GRAM = 20, 8
COLUMNS, DEPTH = 1 << 27, 4
"""Columns (a power of two) and rows of the sketch. Merged it takes 64 MB."""
BLOCK = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(words: arrays.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every window, and the window's anchor."""
    gram = min(GRAM, n)
    prefix = arrays.prefix_hash(words.hashes(), arrays.WORD_POWERS)
    at = np.arange(max(0, len(words) - gram + 1))
    least = sliding_least(arrays.range_hash(prefix, at, at + gram, arrays.WORD_POWERS), n - gram + 1)
    start = np.flatnonzero(np.arange(len(words)) <= words.bounds[1:][words.row] - n)
    return start, least[start]


def places(words: arrays.Words, n: int) -> np.ndarray:
    """Anchors by place: windows in a row that share theirs count once for each time it is chosen anew."""
    start, anchor = anchors(words, n)
    if not len(start):
        return anchor
    gram = min(GRAM, n)
    at = np.arange(len(words) - gram + 1)
    prefix = arrays.prefix_hash(words.hashes(), arrays.WORD_POWERS)
    hashes = arrays.range_hash(prefix, at, at + gram, arrays.WORD_POWERS)
    span = n - gram + 1
    of_window = np.zeros(len(hashes) + span - 1, np.uint64)
    of_window[start + span - 1] = anchor
    # A run is chosen where it equals the anchor of a window over it: those anchors' maximum. Of equal runs in
    # one window both count: an estimate may be too high, never too low.
    return hashes[~sliding_least(~of_window, span) == hashes]


def cells(anchor: np.ndarray, columns: int) -> list[np.ndarray]:
    """The cell of each row of the sketch that counts the anchor."""
    out = []
    for row in range(DEPTH):
        out.append((anchor & np.uint64(columns - 1)).astype(np.int64) + row * columns)
        anchor = arrays.mix(anchor)
    return out


def _profile(batches: Iterator[pa.RecordBatch], n: int, columns: int) -> Iterator[pa.RecordBatch]:
    """A row per document (words, digest, hash of the words), and a row per block of the batch's sketch."""
    for batch in batches:
        found = []
        for piece in arrays.slices(batch, "text"):
            words = arrays.words_of(piece.column("text"))
            d1, d2 = _digests(words)
            raw, off = arrays.byte_view(piece.column("text"))
            raw = raw.tobytes()
            whole = [hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(off, off[1:], strict=False)]
            found.append(places(words, n))
            nothing = pa.nulls(piece.num_rows, pa.int32()), pa.nulls(piece.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(words.bounds)), pa.array(d1), pa.array(d2), pa.array(whole, pa.binary()), *nothing], names=PROFILE_NAMES)
        at = np.sort(np.concatenate([c for anchor in found for c in cells(anchor, columns)])) if found else np.zeros(0, np.int64)
        block = at // BLOCK
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        raw, ends = (at % BLOCK).astype(np.uint16).tobytes(), [*cuts[1:], len(at)]
        packed = pa.array([raw[2 * a : 2 * b] for a, b in zip(cuts, ends, strict=False)], pa.binary())
        empty = [pa.nulls(len(cuts), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(block[cuts].astype(np.int32)), packed], names=PROFILE_NAMES)


PROFILE = "doc_id long, n_words long, d1 long, d2 long, whole binary, block int, cells binary"
PROFILE_NAMES = [x.split()[0] for x in PROFILE.split(", ")]


def _digests(words: arrays.Words) -> tuple[np.ndarray, np.ndarray]:
    hashes = words.hashes()
    out = []
    for salt in (arrays.MIX_1, arrays.BYTE_BASE):
        prefix = arrays.prefix_hash(arrays.mix(hashes ^ np.uint64(salt)), arrays.WORD_POWERS)
        out.append(arrays.range_hash(prefix, words.bounds[:-1], words.bounds[1:], arrays.WORD_POWERS).view(np.int64))
    return out[0], out[1]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of the merged sketch: a bit for every column that counts two or more."""
    for table in arrays.groups(batches, "block"):
        counts = np.zeros(BLOCK, np.int64)
        for part in table.column("cells"):
            counts += np.bincount(np.frombuffer(part.as_buffer(), np.uint16), minlength=BLOCK)
        bits = np.packbits(counts > 1, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([table.column("block").chunk(0)[:1], pa.array([bits], pa.binary())], names=["block", "bits"])


def repeated(anchor: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.ones(len(anchor), bool)
    for cell in cells(anchor, len(bits) * 8 // DEPTH):
        out &= ((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(bool)
    return out


def _candidates(batches: Iterator[pa.RecordBatch], n: int, sketch) -> Iterator[pa.RecordBatch]:
    """Documents with a window that the sketch estimates as repeated."""
    bits = np.frombuffer(sketch.value, np.uint8)
    for batch in batches:
        for piece in arrays.slices(batch, "text"):
            words = arrays.words_of(piece.column("text"))
            d1, d2 = _digests(words)
            start, anchor = anchors(words, n)
            rows = np.unique(words.row[start[repeated(anchor, bits)]])
            out = pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(d1), pa.array(d2), piece.column("text")], names=["doc_id", "d1", "d2", "text"])
            out = out.take(pa.array(rows))
            yield out.set_column(3, "text", arrays.squeezed(out.column("text")))


STRETCH = "kind long, anchor long, doc_id long, at int, size int, windows binary"
STRETCH_NAMES = [x.split()[0] for x in STRETCH.split(", ")]


def _stretches(batches: Iterator[pa.RecordBatch], n: int, sketch) -> Iterator[pa.RecordBatch]:
    """Runs of windows with one anchor that is estimated as repeated: hash of their words, place, number, hashes."""
    bits = np.frombuffer(sketch.value, np.uint8)
    for batch in batches:
        for piece in arrays.unsqueezed(batch):
            words = arrays.words_of(piece.column("text"))
            start, anchor = anchors(words, n)
            wanted = repeated(anchor, bits)
            rows = words.row[start]
            # The leftmost run that is the anchor is another one where it differs or was the last window's first.
            prefix = arrays.prefix_hash(words.hashes(), arrays.WORD_POWERS)
            before = arrays.range_hash(prefix, start[:-1], start[:-1] + min(GRAM, n), arrays.WORD_POWERS)
            new = np.ones(len(start), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1]) | (before == anchor[:-1])
            first = np.flatnonzero(new)
            end = np.append(first[1:], len(start))[: len(first)]
            first, end = first[wanted[first]], end[wanted[first]]
            kind = arrays.range_hash(prefix, start[first], start[end - 1] + n, arrays.WORD_POWERS).view(np.int64)
            raw = arrays.range_hash(prefix, start, start + n, arrays.WORD_POWERS).tobytes()
            windows = pa.array([raw[8 * a : 8 * b] for a, b in zip(first.tolist(), end.tolist(), strict=True)], pa.binary())
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
            at = (start[first] - words.bounds[rows[first]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(anchor[first].view(np.int64)), pa.array(ids[rows[first]]), pa.array(at), pa.array((end - first).astype(np.int32)), windows], names=STRETCH_NAMES)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = arrays.byte_view(batch.column("windows"))
        count = np.diff(off) // 8
        row = np.repeat(np.arange(batch.num_rows), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = batch.column("at").to_numpy()[row] + step
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.tobytes(), np.int64)), pa.array(batch.column("doc_id").to_numpy()[row]), pa.array(at.astype(np.int32))], names=["window", "doc_id", "at"])


def _kept(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in arrays.unsqueezed(batch):
            removed, kept = [], []
            for text, starts in zip(piece.column("text"), piece.column("starts"), strict=True):
                words = text.as_py().split()
                edge = np.zeros(len(words) + n + 1, np.int32)
                at = starts.values.field("at").to_numpy(zero_copy_only=False)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + starts.values.field("size").to_numpy(zero_copy_only=False) + n - 1, -1)
                gone = np.cumsum(edge)[: len(words)] > 0
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).digest())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["rep", "removed", "rest"])


def without_repeats(docs: DataFrame, n: int = WINDOW, columns: int = COLUMNS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs`` (``doc_id`` long, ``text`` string)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    pass_1 = written(docs.mapInArrow(partial(_profile, n=n, columns=columns), PROFILE), "windows-profile")
    profile = pass_1.where("block is null").drop("block", "cells")
    blocks = pass_1.where("block is not null").select("block", "cells").repartition("block").sortWithinPartitions("block")
    bits = bytearray(DEPTH * columns // 8)
    for row in blocks.mapInArrow(_merged, "block int, bits binary").toLocalIterator():
        bits[row["block"] * BLOCK // 8 : (row["block"] + 1) * BLOCK // 8] = row["bits"]
    sketch = spark.sparkContext.broadcast(bytes(bits))
    del bits

    chosen = profile.where(f"doc_id is not null and n_words >= {n}").groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("kind"))
    chosen = chosen.select("doc_id", "kind.d1", "kind.d2")
    reps = chosen.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "d1", "d2")
    found = docs.mapInArrow(partial(_candidates, n=n, sketch=sketch), "doc_id long, d1 long, d2 long, text binary")
    same = (F.col("found.d1") == F.col("reps.d1")) & (F.col("found.d2") == F.col("reps.d2"))
    texts = found.alias("found").join(reps.alias("reps"), "doc_id").where(same).select("doc_id", "found.text")
    texts = written(texts.dropDuplicates(["doc_id"]), "windows-texts")
    stretches = texts.mapInArrow(partial(_stretches, n=n, sketch=sketch), STRETCH)
    kinds_of = stretches.groupBy("kind").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.min("anchor").alias("anchor"), F.count("*").alias("times"))
    kinds_of = written(kinds_of, "windows-kinds")
    mixed = kinds_of.groupBy("anchor").count().where("count > 1").select("anchor", F.lit(True).alias("mixed"))
    kinds_of = kinds_of.join(mixed, "anchor", "left").where("times > 1 or mixed").select("kind", "first", "mixed")
    placed = stretches.drop("anchor").join(kinds_of, "kind")
    later = placed.where("doc_id <> first.doc_id or at <> first.at").select("doc_id", "at", "size")
    windows = placed.where("mixed and doc_id = first.doc_id and at = first.at").select("doc_id", "at", "windows")
    windows = windows.mapInArrow(_windows, "window long, doc_id long, at int")
    first = windows.groupBy("window").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("times"))
    again = windows.join(first.where("times > 1"), "window").where("doc_id <> first.doc_id or at <> first.at")
    starts = later.union(again.select("doc_id", "at", F.lit(1).alias("size")))
    starts = written(starts.groupBy("doc_id").agg(F.collect_list(F.struct("at", "size")).alias("starts")), "windows-starts")
    sketch.destroy()
    rest = texts.join(starts, "doc_id").mapInArrow(partial(_kept, n=n), "rep long, removed long, rest binary")

    named = reps.join(rest, F.col("doc_id") == F.col("rep"), "left").select("d1", "d2", F.col("doc_id").alias("rep"), "removed", "rest")
    out = profile.join(chosen.join(named, ["d1", "d2"]), ["doc_id", "d1", "d2"], "left")
    return out.select(
        "doc_id", "n_words",
        F.expr("case when doc_id > rep then n_words when doc_id = rep then coalesce(removed, 0L) else 0L end").alias("n_removed"),
        F.expr(f"case when doc_id > rep then '{NOTHING}' else lower(hex(if(doc_id = rep, coalesce(rest, whole), whole))) end").alias("kept_sha256"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
