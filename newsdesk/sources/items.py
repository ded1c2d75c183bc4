"""Feed payloads, web pages and text documents as items.

An item is ``feed_ord, entry_ord, title, link, source``. The two ordinals fix which of
several equal titles comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsdesk.functions.barrier import computed_once
from newsdesk.sources.encodings import NO_CONTENT, payload_text

RUN_BYTES = 1 << 20
"""Content decoded at once, so that a worker holds little besides the batch it was given."""
ITEM_COLUMNS = ("feed_ord", "entry_ord", "title", "link", "source")

# RSS 2.0 nests its items in the channel, RSS 1.0 puts them beside it, Atom has entries.
PAYLOAD_SCHEMA = (
    "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: ARRAY<STRING>>>>, "
    "item ARRAY<STRUCT<title: STRING, link: ARRAY<STRING>>>, "
    "entry ARRAY<STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING>>>>, "
    "_malformed STRING"
)
FEED_ROOTS = ("rss", "rdf:RDF", "feed")
JSON_SCHEMA = "version STRING, items ARRAY<STRUCT<title: STRING, url: STRING, external_url: STRING>>, _malformed STRING"
JSON_VERSION = "https://jsonfeed.org/version/"
# What may stand before the root of a document: declarations and comments.
PROLOG = r"^(?:\s|\x{FEFF}|<\?[\s\S]*?\?>|<!--[\s\S]*?-->|<!DOCTYPE[^>\[]*(?:\[[\s\S]*?\])?\s*>)*"

# Named character references decoded in page titles, ampersand last.
HTML_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&copy;", "©"), ("&nbsp;", " "), ("&amp;", "&"),
)


def landed_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``feed_ord, body, problem`` of payload files landed as ``<path>/feed_ord=<n>/<file>``, whatever their encoding.

    A failed fetch lands as a blank file; one without any byte is not read, and its feed has nothing landed.
    """
    return decoded_payloads(spark.read.format("binaryFile").load(path))


def landing_payloads(spark: SparkSession, path: str, files_per_poll: int | None = None) -> DataFrame:
    """The same folder as a stream of newly landed payloads."""
    reader = spark.readStream.format("binaryFile").schema(
        "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY, feed_ord INT"
    )
    if files_per_poll is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_poll)
    return decoded_payloads(reader.load(path))


def decoded_payloads(files: DataFrame) -> DataFrame:
    """Replace the ``content`` of payloads by ``body``, its text, and ``problem``, why it has none.

    The columns of the file source go; others stay.
    """
    rest = [f for f in files.schema.fields if f.name not in ("content", "path", "modificationTime", "length")]
    schema = T.StructType([*rest, T.StructField("body", T.StringType()), T.StructField("problem", T.StringType())])
    return files.select(*[f.name for f in rest], "content").mapInArrow(_decoded, schema)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``RUN_BYTES`` of content, or one row that has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("content")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + RUN_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in (run for batch in batches for run in _runs(batch)):
        read = [payload_text(content.as_py()) for content in run.column("content")]
        kept = {name: run.column(name) for name in run.schema.names if name != "content"}
        texts = {"body": pa.array([text for text, _ in read], pa.string()), "problem": pa.array([why for _, why in read], pa.string())}
        yield pa.RecordBatch.from_pydict(kept | texts)


def _entry(title: Column, link: Column) -> Column:
    return F.struct(
        F.coalesce(title, F.lit("")).alias("title"), F.coalesce(link, F.lit("")).alias("link")
    )


def parsed_payloads(payloads: DataFrame) -> DataFrame:
    """Replace ``body`` (and ``problem``) by ``ok``, ``reason`` and ``entries``, the titles and first links in order.

    Feeds are RSS 1.0 and 2.0, Atom, with or without a prefix, and JSON Feed. A missing, malformed or
    non-feed body is not ok, has a reason and no entries; a valid feed without entries is ok.
    """
    body = F.col("_body")
    text = F.regexp_replace(F.col("body"), PROLOG, "")
    is_json = F.startswith(body, F.lit("{"))
    root = F.regexp_extract(body, r"^<([A-Za-z_][\w.:-]*)", 1)
    # The elements of a feed whose root has a prefix, without it.
    prefix = F.regexp_extract(body, r"^<([A-Za-z_][\w.-]*):feed[\s>]", 1)
    bare = F.replace(F.replace(body, F.concat(F.lit("<"), prefix, F.lit(":")), F.lit("<")), F.concat(F.lit("</"), prefix, F.lit(":")), F.lit("</"))
    plain = F.when(prefix != "", bare).otherwise(body)
    rest = [c for c in payloads.columns if c not in ("body", "problem")]
    problem = F.col("problem") if "problem" in payloads.columns else F.lit(None).cast("string")
    shaped = computed_once(payloads, {"_body": text, "_problem": problem}).withColumns({"_root": F.when(prefix != "", "feed").otherwise(root), "_json": is_json})
    parsed = computed_once(
        shaped,
        {
            "_feed": F.from_xml(F.when(~F.col("_json"), plain), PAYLOAD_SCHEMA, {"columnNameOfCorruptRecord": "_malformed"}),
            "_list": F.from_json(F.when(F.col("_json"), body), JSON_SCHEMA, {"columnNameOfCorruptRecord": "_malformed"}),
        },
    )
    rss = [F.col("_feed.channel.item"), F.col("_feed.item")]
    entries = [
        F.transform(items, lambda e: _entry(e["title"], F.try_element_at(e["link"], F.lit(1))))
        for items in rss
    ]
    entries.append(
        F.transform(
            F.col("_feed.entry"),
            lambda e: _entry(e["title"], F.try_element_at(e["link"], F.lit(1))["_href"]),
        )
    )
    entries.append(F.transform(F.col("_list.items"), lambda e: _entry(e["title"], F.coalesce(e["url"], e["external_url"]))))
    none = F.array().cast("array<struct<title:string,link:string>>")
    found = F.concat(*[F.coalesce(e, none) for e in entries])
    listed = F.col("_list._malformed").isNull() & F.startswith(F.col("_list.version"), F.lit(JSON_VERSION))
    reason = (
        F.when(F.col("_problem").isNotNull(), F.col("_problem"))
        .when(body.isNull() | (body == ""), F.lit(NO_CONTENT))
        .when(F.col("_json"), F.when(F.coalesce(listed, F.lit(False)), F.lit(None)).otherwise("not a JSON feed"))
        .when(F.col("_root") == "", F.lit("neither XML nor JSON"))
        .when(~F.col("_root").isin(*FEED_ROOTS), F.concat(F.lit("not a feed: <"), F.col("_root"), F.lit(">")))
        .when(F.col("_feed").isNull() | F.col("_feed._malformed").isNotNull(), F.lit("malformed XML"))
    )
    judged = computed_once(parsed, {"reason": reason}).withColumn("ok", F.col("reason").isNull())
    read = computed_once(judged, {"entries": F.when(F.col("ok"), found).otherwise(none)})
    return read.select(*rest, "ok", "reason", "entries")


def items_of(parsed: DataFrame) -> DataFrame:
    """Lateral expansion of parsed payloads, in entry order; other columns are kept."""
    rest = [c for c in parsed.columns if c not in ("ok", "reason", "entries")]
    return parsed.select(*rest, F.posexplode("entries").alias("entry_ord", "_entry")).select(
        *rest, "entry_ord", "_entry.title", "_entry.link"
    )


def feed_items(payloads: DataFrame, feeds: DataFrame) -> DataFrame:
    """Items of landed payloads ``feed_ord, body``, stamped with their feed's source."""
    stamps = F.broadcast(feeds.select("feed_ord", "source"))
    return items_of(parsed_payloads(payloads)).join(stamps, "feed_ord").select(*ITEM_COLUMNS)


def page_items(pages: DataFrame, feed_ord: int) -> DataFrame:
    """Title, address and host of whole web pages ``page_id, url, html``."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    for written, meant in HTML_ENTITIES:
        title = F.replace(title, F.lit(written), F.lit(meant))
    return pages.select(
        F.lit(feed_ord).alias("feed_ord"),
        F.col("page_id").alias("entry_ord"),
        title.alias("title"),
        F.coalesce("url", F.lit("")).alias("link"),
        F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("source"),
    )


def pooled(*items: DataFrame) -> DataFrame:
    """Bag union of item tables; catalogue order lives in ``feed_ord``."""
    parts = [part.select(*ITEM_COLUMNS) for part in items]
    return reduce(DataFrame.unionByName, parts)
