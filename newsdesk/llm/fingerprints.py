"""Document fingerprints: bottom-k sketches of word shingles.

A fingerprint holds the ``k`` least hashes of a text's distinct shingles, 6 bytes each, in order. That of a text
in parts is the merge of theirs (shingles that cross parts aside). It estimates the number of distinct shingles,
and of two texts the resemblance (Jaccard) and the containment of one in the other.

Results for odd input: a null or empty text has an empty fingerprint, alike (1.0) to another empty one and to
nothing else; a text of fewer words than a shingle is one shingle; rows with a null ``doc_id`` come last, each with
null edited columns, and are nobody's next document; rows that share a ``doc_id`` follow each other by their
text; a single document is its own next one; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm import arrays
from newsdesk.llm.storage import documents

WORDS, K = 5, 256
ROWS_PER_RANGE = 2_000
SPACE = float(1 << 48)


def sketches(text: pa.Array, n: int = WORDS, k: int = K) -> list[np.ndarray]:
    """The ``k`` least 48-bit hashes of each text's distinct ``n``-word shingles, in order."""
    rows, tokens = arrays.shingles(arrays.words_of(text), n)
    bounds = np.searchsorted(rows, np.arange(len(text) + 1))
    tokens = tokens >> np.uint64(16)
    return [tokens[a : min(b, a + k)] for a, b in zip(bounds, bounds[1:], strict=False)]


def encoded(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of common shingles among all: that among the ``k`` least of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    new = np.concatenate([[True], ~twice])
    place = np.cumsum(new)
    least = min(k, int(place[-1]))
    return float(np.count_nonzero(twice & (place[1:] <= least)) / least)


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / SPACE)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the shingles of ``a`` that ``b`` has too."""
    if not len(a):
        return 1.0
    union = distinct_shingles(merged(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_shingles(a, k))


def _ranges(batches: Iterator[pa.RecordBatch], bounds: list[float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.searchsorted(bounds, ids, side="right"))], names=["doc_id", "range"])


def _dealt(batches: Iterator[pa.RecordBatch], bounds: list[float], before: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Every document to its range; the first of each range also to the one before, as the last one's next."""
    first = np.array(sorted(before), np.int64)
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        at = np.searchsorted(bounds, ids, side="right")
        again = np.flatnonzero(np.isin(ids, first))
        target = np.array([before[int(i)] for i in ids[again]], np.int64)
        out = batch.take(pa.array(np.concatenate([np.arange(len(ids)), again])))
        extra = np.arange(out.num_rows) >= len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, target])), pa.array(extra), out.column("doc_id"), out.column("text")], names=["range", "beyond", "doc_id", "text"])


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], n: int, k: int) -> pa.RecordBatch:
    """Rows of all documents given but the last, which is only the next one."""
    out: list[list] = [[] for _ in NAMES]
    own = sketches(pa.array(texts, pa.string()), n, k)
    edited = []
    for text, after in zip(texts, texts[1:], strict=False):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    changed = sketches(pa.array(edited, pa.string()), n, k)
    for i, text in enumerate(edited):
        values = (
            ids[i], len(texts[i]), hashlib.sha256(text.encode()).hexdigest(), encoded(own[i]), encoded(changed[i]),
            resemblance(own[i], changed[i], k), resemblance(own[i], own[i + 1], k),
        )
        for column, value in zip(out, values, strict=True):
            column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=NAMES)


def _neighbours(batches: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    """From rows ordered by range, ``beyond``, id and text; a range ends at its first row from beyond."""
    ids, texts, size, current, ended = [], [], 0, None, False
    for batch in batches:
        for at, beyond, doc, text in zip(*(batch.column(c).to_pylist() for c in ("range", "beyond", "doc_id", "text")), strict=True):
            if at != current:
                ids, texts, size, current, ended = [], [], 0, at, False
            if ended:
                continue
            ids.append(doc)
            texts.append(text or "")
            size += len(texts[-1])
            ended = beyond
            if ended or size > arrays.SLICE_BYTES // 2:
                yield _rows(ids, texts, n, k)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])


def _alone(batches: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        own = pa.array([encoded(s) for s in sketches(pa.array(texts, pa.string()), n, k)], pa.string())
        none = [pa.nulls(len(texts), t) for t in (pa.string(), pa.string(), pa.float64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, none[0], own, none[1], none[2], none[3]], names=NAMES)


def with_neighbours(docs: DataFrame, n: int = WORDS, k: int = K) -> DataFrame:
    """Fingerprints of every row of ``docs``, of its edited text, and their likeness; see ``KINDS``.

    Documents are dealt to ranges of ids; the first of each range is sent to the range before too, so that no task
    orders all documents.
    """
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id is not null")
    rows = known.count()
    parts = rows // ROWS_PER_RANGE + 1
    bounds = sorted(set(known.approxQuantile("doc_id", [i / parts for i in range(1, parts)], max(1e-4, 0.2 / parts)))) if rows and parts > 1 else []
    firsts = known.select("doc_id").mapInArrow(partial(_ranges, bounds=bounds), "doc_id long, range long").groupBy("range").agg(F.min("doc_id").alias("first"))
    found = sorted((r["range"], r["first"]) for r in firsts.collect())
    before = {first: found[i - 1][0] for i, (_, first) in enumerate(found)}
    dealt = known.mapInArrow(partial(_dealt, bounds=bounds, before=before), "range long, beyond boolean, doc_id long, text string")
    dealt = dealt.repartition("range").sortWithinPartitions("range", "beyond", "doc_id", "text")
    out = dealt.mapInArrow(partial(_neighbours, n=n, k=k), KINDS)
    return out.union(docs.where("doc_id is null").mapInArrow(partial(_alone, n=n, k=k), KINDS))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(documents(spark, sf_dir))
