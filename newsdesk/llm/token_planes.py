"""Token ids as binary files in the order of the documents' ids, written by Spark's sink and read again.

Rows are dealt to ranges of ``doc_id`` and sorted within; each task packs its documents into segments of the format
of ``plane_files`` and Spark's text sink writes them, with its commit protocol and to any store it reaches. The number
of ranges follows the bytes of the input, and a file holds a bounded number of segments. The place of a document in the
whole order is its place in its file plus the ids of all files before, summed in two levels.

Results for odd input: a null or empty text (or list of ids) is a document of the end id alone; rows with a null
``doc_id`` come first, rows that share one follow each other by the hash of their text; copies of one row are spread
over ranges like any others; an empty table gives no files and no rows; further columns are not read; nulls
in a list of ids are left out. A document is not cut across segments, so a segment is at least as large as
its longest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm import arrays, plane_files
from newsdesk.llm.storage import documents, ship_package, written
from newsdesk.llm.word_tokens import WordTokens
from newsdesk.session import staging_folder

TOKENIZER, END = "word_bpe_49k.json", 2
RANGE_BYTES = 32 << 20
"""Input of one range of documents, about; a range is one task."""
SEGMENT_IDS, FILE_SEGMENTS = 1 << 20, 64
GROUP = 1024


def _packed(batches: Iterator[pa.RecordBatch], tokenizer: str | None, end: int, width: int, planes: str) -> Iterator[pa.RecordBatch]:
    tokens = WordTokens.of(tokenizer) if tokenizer else None
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        value = plane_files.segment(*(np.concatenate(x) for x in zip(*held, strict=True)), planes=planes)
        held.clear()
        arrays.free_pages()
        return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])

    for batch in batches:
        for part in arrays.slices(batch, "text") if tokens else [batch]:
            if tokens:
                ids, bounds = tokens.encode(part.column("text"))
            else:
                ids = part.column("ids").flatten().to_numpy()
                bounds = np.concatenate([[0], np.cumsum(part.column("ids").value_lengths().to_numpy(), dtype=np.int64)])
            if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 8 * width:
                raise ValueError(f"an id does not fit {width} bytes")
            ids = np.insert(ids.astype(f"<u{width}"), bounds[1:], end)
            doc_id = part.column("doc_id")
            held.append((doc_id.fill_null(0).to_numpy(), doc_id.is_valid().to_numpy(zero_copy_only=False), np.diff(bounds) + 1, ids))
            if sum(len(x[3]) for x in held) >= SEGMENT_IDS:
                yield made()
    if any(len(x[0]) for x in held):
        yield made()


def write_planes(docs: DataFrame, path: str, tokenizer: str | None = TOKENIZER, end: int = END, width: int = 2, planes: str = "byte") -> None:
    """Files of the rows' texts as ids of ``tokenizer``, or of their ``ids`` where it is None, by ascending ``doc_id``.

    Each document ends with the id ``end``. Ids take ``width`` bytes (2 or 4); ``planes`` is ``byte`` or ``bit``.
    """
    ship_package(docs.sparkSession)
    column = "text" if tokenizer else "ids"
    size = F.octet_length("text") if tokenizer else 4 * F.size("ids")
    total = docs.agg(F.sum(F.greatest(size, F.lit(0)).cast("long"))).first()[0] or 0
    given = F.col("text") if tokenizer else F.array_compact(F.coalesce("ids", F.array()))
    rows = docs.select("doc_id", given.alias(column)).withColumns({"tie": F.xxhash64(column), "row": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(total // RANGE_BYTES + 1, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie")
    pack = partial(_packed, tokenizer=tokenizer, end=end, width=width, planes=planes)
    made = dealt.select("doc_id", column).mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", plane_files.LINE_FEED.decode()).option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrays.fresh_memory()
    for batch in batches:
        total = [sum(s.n_ids for s in plane_files.segments(x.as_buffer())) for x in batch.column("content")]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(total, pa.int64())], names=["path", "total"])


def _documents(batches: Iterator[pa.RecordBatch], digests: bool) -> Iterator[pa.RecordBatch]:
    arrays.fresh_memory()
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            before = 0
            for s in plane_files.segments(content.as_buffer()):
                doc_ids, given, bounds = s.documents()
                ids = s.ids(0, s.n_ids)
                if digests:
                    data, at = memoryview(ids.astype("<u4")).cast("B"), (4 * bounds).tolist()
                    last = pa.array([zlib.crc32(data[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())
                else:
                    last = arrays.list_array(ids.astype(np.int32), bounds, pa.int32())
                columns = [pa.array([path] * s.n_docs, pa.string()), pa.array(doc_ids, mask=~given), pa.array(before + bounds[:-1]), pa.array(np.diff(bounds)), last]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "doc_id", "at", "n_tokens", "ids_crc32" if digests else "ids"])
                before += s.n_ids


def file_starts(files: DataFrame) -> DataFrame:
    """``path, before``: the ids in all files before each, by the numbers in their names."""
    totals = files.select("path", "content").mapInArrow(_totals, "path string, total long")
    totals = totals.withColumn("number", F.regexp_extract("path", r"part-(\d+)", 1).cast("long")).withColumn("group", F.expr(f"number div {GROUP}"))
    totals = written(totals.withColumn("piece", F.regexp_extract("path", r"-c(\d+)[^/]*$", 1).cast("long")), "plane-totals")
    groups = totals.groupBy("group").agg(F.sum("total").alias("of_group"))
    groups = groups.selectExpr("group", "sum(of_group) over (order by group) - of_group as before_group")
    within = totals.selectExpr("*", "sum(total) over (partition by group order by number, piece) - total as before_here")
    return written(within.join(groups, "group").selectExpr("path", "before_group + before_here as before"), "plane-starts")


def read_planes(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document: ``start`` counts the ids of all documents before it.

    With ``digests`` the last column is ``ids_crc32``: of the ids as unsigned little-endian numbers of four bytes.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    last = "ids_crc32 long" if digests else "ids array<int>"
    rows = files.mapInArrow(partial(_documents, digests=digests), f"path string, doc_id long, at long, n_tokens long, {last}")
    rows = rows.join(file_starts(files), "path")
    return rows.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", last.split()[0])


def op12_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{staging_folder(spark, 'llm-planes')}/files"
    write_planes(documents(spark, sf_dir), path)
    return read_planes(spark, path, digests=True)
