"""Token counts of documents in flat token files, by a scan for separators.

A token file is ids one behind the other, two or four bytes each, little-endian, plain or gzipped; each document
ends with the end id and nothing tells where. Blocks of a file are searched for that id at once, whatever document
they cut; a prefix scan over the blocks' summaries (separators so far, place of the last) then tells each block the
number and the start of the document that is open where it begins. The scan has two levels, so that no task takes all
blocks of a corpus-sized file.

Results for odd input: a null or empty text is a document of no tokens; tokens after the last end id of a file are one
more document; an empty file or table gives no rows; a length that is no multiple of the width is an error;
further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm.pieces import encoded_batches
from newsdesk.llm.storage import documents, ship_package
from newsdesk.session import staging_folder

BLOCK_TOKENS = 1 << 18
GROUP = 4096
MODEL, END = "piece_bpe_32k.model", 2


def _flat(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        data = ids.flatten().to_numpy().astype(f"<u{width}").tobytes()
        ends = (width * (ids.offsets.to_numpy() - ids.offsets[0].as_py())).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([data[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], names=["value"])


def _flat_texts(batches: Iterator[pa.RecordBatch], model: str, width: int) -> Iterator[pa.RecordBatch]:
    return _flat(encoded_batches(batches, model), width)


def write_token_files(docs: DataFrame, path: str, model: str | None = None, end: int = END, width: int = 2) -> None:
    """Flat files of the rows' ``ids``, or of their texts' pieces by ``model``, gzipped; ``end`` closes each document.

    The end id is written as what parts the rows, so its bytes must be valid UTF-8 (below 128, for one).
    """
    apart = end.to_bytes(width, "little").decode()
    if model is None:
        flat = docs.select("ids").mapInArrow(partial(_flat, width=width), "value binary")
    else:
        flat = docs.select("doc_id", "text").mapInArrow(partial(_flat_texts, model=model, width=width), "value binary")
    flat.select(F.col("value").cast("string")).write.option("lineSep", apart).option("compression", "gzip").text(path)


def _chunks(content: memoryview, zipped: bool, size: int) -> Iterator[bytes]:
    """Blocks of ``size`` bytes, the last one shorter."""
    if not zipped:
        for at in range(0, len(content), size):
            yield bytes(content[at : at + size])
        return
    held, at = b"", 0
    while at < len(content):  # a gzip file is one or more members
        reader = zlib.decompressobj(31)
        while not reader.eof and (at < len(content) or reader.unconsumed_tail):
            given = reader.unconsumed_tail
            if not given:
                given, at = bytes(content[at : at + size]), at + size
            held += reader.decompress(given, size)
            while len(held) >= size:
                yield held[:size]
                held = held[size:]
        at = min(at, len(content)) - len(reader.unused_data)
    if held:
        yield held


BLOCK = "file string, block long, start long, size long, ends array<long>"


def _scan(batches: Iterator[pa.RecordBatch], end: int, width: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Places of the end id in each block, from the start of the file."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            name, start = path.as_py(), 0
            for block, data in enumerate(_chunks(memoryview(content.as_buffer()), name.endswith(".gz"), width * block_tokens)):
                tokens = np.frombuffer(data, f"<u{width}")
                ends = np.flatnonzero(tokens == end) + start
                row = [pa.array([name]), pa.array([block]), pa.array([start]), pa.array([len(tokens)]), pa.array([ends], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(row, names=["file", "block", "start", "size", "ends"])
                start += len(tokens)


def token_counts(spark: SparkSession, path: str, end: int = END, width: int = 2, block_tokens: int = BLOCK_TOKENS, group: int = GROUP) -> DataFrame:
    """``file, document, start, n_tokens``: each document of each file under ``path``, without its end id."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    blocks = files.mapInArrow(partial(_scan, end=end, width=width, block_tokens=block_tokens), BLOCK)
    blocks = blocks.withColumn("group", F.expr(f"block div {group}")).withColumn("found", F.size("ends")).withColumn("last", F.expr("try_element_at(ends, -1)"))
    sums = blocks.groupBy("file", "group").agg(F.sum("found").alias("found"), F.max("last").alias("last"), F.max(F.col("start") + F.col("size")).alias("length"))
    before = "partition by file order by group rows between unbounded preceding and 1 preceding"
    sums = sums.selectExpr(
        "file", "group", f"coalesce(sum(found) over ({before}), 0) as found_before", f"max(last) over ({before}) as last_before",
        "max(length) over (partition by file) as length",
    )
    before = "partition by file, group order by block rows between unbounded preceding and 1 preceding"
    local = blocks.selectExpr("*", f"coalesce(sum(found) over ({before}), 0) as found_here", f"max(last) over ({before}) as last_here")
    local = local.join(sums, ["file", "group"]).selectExpr(
        "file", "found_before + found_here as first", "coalesce(last_here, last_before, -1L) + 1 as open",
        # The end of a file closes its last document, if there are tokens left for it.
        "if(start + size = length and coalesce(last, -1L) < length - 1, array_append(ends, length), ends) as ends",
    )
    return local.selectExpr("file", "first", "open", "ends", "posexplode(ends) as (at, end)").selectExpr(
        "file", "first + at as document", "if(at = 0, open, get(ends, at - 1) + 1) as start", "end - if(at = 0, open, get(ends, at - 1) + 1) as n_tokens"
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, from token files of the table; ``part`` is the number of the file."""
    path = f"{staging_folder(spark, 'llm-tokens')}/files"
    write_token_files(documents(spark, sf_dir), path, MODEL)
    counts = token_counts(spark, path)
    return counts.select(F.regexp_extract("file", r"part-(\d+)", 1).cast("int").alias("part"), "document", "start", "n_tokens")
