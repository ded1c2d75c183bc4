"""Stretches of consecutive words that repeat with a period, and texts with each cut to its first period.

The words of many texts are numbered so that equal numbers are equal words of one text; ``block_runs`` then finds the
runs of the whole sequence by block convolution at dyadic scales, and none goes past a text. A text is
one row, so the work of one row grows with its words times the logarithm's square at most; nothing is shuffled.

Results for odd input: a null or empty text has no words and no runs, and an empty text is kept of it; rows with a null
or repeated ``doc_id`` are taken like any others; an empty table gives no rows; further columns are not read. Words
are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm import arrays
from newsdesk.llm.block_runs import runs
from newsdesk.llm.storage import documents, ship_package

LEAST, TIMES = 6, 4
Places = Callable[[int | None, int], np.ndarray | None]


def joined(words: arrays.Words, at: np.ndarray, row: np.ndarray, n_rows: int) -> pa.Array:
    """For each row, its words ``at`` (with their ``row``, ascending) joined by one space."""
    more = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)
    start, size = words.start[at], words.end[at] - words.start[at]
    size = size + more
    ends = np.cumsum(size)
    raw = np.append(words.raw, np.uint8(0x20))
    out = raw[np.repeat(start - ends + size, size) + np.arange(size.sum())]
    out[ends[more] - 1] = 0x20
    bounds = np.concatenate([[0], ends])[np.searchsorted(row, np.arange(n_rows + 1))]
    return pa.StringArray.from_buffers(n_rows, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out)))


def _collapsed(batches: Iterator[pa.RecordBatch], least: int, times: int, places: Places | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            words, n_rows = arrays.words_of(part.column("text")), part.num_rows
            at = np.arange(len(words))
            if places:
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), words.bounds.tolist(), words.bounds[1:].tolist(), strict=False):
                    if (order := places(doc_id, b - a)) is not None:
                        at[a:b] = a + order
            of_row = arrays.mix(words.row.astype(np.uint64) + np.uint64(1))
            _, numbers = np.unique(words.hashes()[at] ^ of_row, return_inverse=True)
            found = runs(numbers.astype(np.uint64) + np.uint64(1), least, times)
            start, length, period = found.T
            dropped = np.zeros(len(words) + 1, np.int64)
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, start + length, -1)
            kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
            text = joined(words, at[kept], words.row[kept], n_rows)
            row = words.row[start]
            fields = [pa.array(x) for x in (start - words.bounds[row], length, period)]
            bounds = pa.array(np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32))
            listed = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(words.bounds)), listed, text], names=["doc_id", "n_words", "runs", "text"])


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES, places: Places | None = None) -> DataFrame:
    """``doc_id, n_words, runs, text``: the runs of each text, by start, then period, and the text without their repeats.

    ``runs`` holds ``start, length, period`` in words, of at least ``max(least, times * period)`` words. Of each run the
    words after its first period go; what is kept is joined by one space. ``places`` may give another order of the
    words of a text, from its ``doc_id`` and number of words.
    """
    ship_package(docs.sparkSession)
    kinds = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
    return docs.select("doc_id", "text").mapInArrow(partial(_collapsed, least=least, times=times, places=places), kinds)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth document, by the checksum of its number, repeats some of its words to its end."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapsed(documents(spark, sf_dir), places=planted)
    found = found.withColumn("most", F.expr("array_max(transform(runs, r -> struct(r.length, -r.start, -r.period)))"))
    return found.selectExpr(
        "doc_id",
        "cast(size(runs) as long) as n_runs",
        "-most.col2 as start",
        "most.length as length",
        "-most.col3 as period",
        "1000 * most.length div -most.col3 as exponent_milli",
        "sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), ''), 256) as runs_sha256",
        "sha2(text, 256) as collapsed_sha256",
        "n_words",
    )
