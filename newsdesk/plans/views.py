"""The given tables as items, payloads, reads, replies and parameter documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.operators.queue import poll_index
from newsdesk.sources import catalogue
from newsdesk.sources.items import page_items, pooled
from newsdesk.sources.params import Params

PAGES_FEED = 20
# Place of a line within the position of its document: lines of one document in order, then those of the next.
LINE_BITS = 24
DOCUMENTS_PER_POLL = 50
POLL_MINUTES = 10

CATEGORY_OF_TYPE = {
    "click": "financial",
    "purchase": "political",
    "signup": "technology",
    "error": "catastrophe",
    "view": "drop",
}
SYNONYM_OF_TYPE = {
    "click": "markets",
    "purchase": "geopolitics",
    "signup": "science",
    "error": "humanitarian",
    "view": "sport",
}

# Technology shares a channel with politics; catastrophe has no route.
PARAMS = Params(
    webhooks={"financial": "money", "political": "policy", "technology": "policy"},
    poll_minutes=POLL_MINUTES,
    drip_seconds=600,
)

# Frequent words of the given lines, so that every band and run length matches.
LEXICON = {
    "financial": ("rewh", "orantion", "attion to", "in the"),
    "political": ("hehely", "thanea", "of the", "was the"),
    "technology": ("la des", "que", "und der", "des"),
    "catastrophe": ("anea eriner thanea", "was", "is the is", "erreth was"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_type(pairs: dict[str, str]) -> Column:
    value = F.lit(None).cast("string")
    for kind, meaning in pairs.items():
        value = F.when(F.col("event_type") == kind, F.lit(meaning)).otherwise(value)
    return value


def feed_number() -> Column:
    return F.expr("try_cast(substring(source, 4) AS INT)")


def document_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every line as a title; those of every third document carry its source as a publisher suffix."""
    suffix = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" - "), "source")).otherwise("")
    lines = table(spark, folder, "documents").select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return lines.select(
        feed_number().alias("feed_ord"),
        (F.shiftleft("doc_id", LINE_BITS) + F.col("line_no")).alias("entry_ord"),
        F.concat("line", suffix).alias("title"),
        F.lit("").alias("link"),
        "source",
    )


def line_columns() -> list[Column]:
    """The document and line of an item of :func:`document_items`."""
    line = F.col("entry_ord").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int")
    return [F.shiftright("entry_ord", LINE_BITS).alias("doc_id"), line.alias("line_no")]


def document_history(spark: SparkSession, folder: str) -> DataFrame:
    """Document items in the polls that gathered them, in order of arrival."""
    return document_items(spark, folder).withColumn(
        "poll_id", F.expr(f"shiftright(entry_ord, {LINE_BITS}) div {DOCUMENTS_PER_POLL}")
    )


def web_items(spark: SparkSession, folder: str) -> DataFrame:
    return page_items(table(spark, folder, "pages"), PAGES_FEED)


def all_items(spark: SparkSession, folder: str) -> DataFrame:
    return pooled(document_items(spark, folder), web_items(spark, folder))


def document_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as the bytes of a feed payload whose entries are its lines.

    By their number they are RSS, Atom, RSS in UTF-16, Atom with a prefix and a comment before its root, JSON
    Feed, and RSS in windows-1252 where its characters allow; the English payloads of one feed were cut off.
    """
    text = F.col("text")
    for written, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(written), F.lit(escaped))
    lines = F.split(text, "\n")
    address = F.concat(F.lit("https://example.org/d/"), "doc_id", F.lit("/"))

    def joined(entry) -> Column:
        return F.array_join(F.transform(lines, entry), "")

    def rss(declaration: str) -> Column:
        items = joined(
            lambda line, at: F.concat(
                F.lit("<item><title>"), line, F.lit("</title><link>"), address, at, F.lit("</link></item>")
            )
        )
        return F.concat(F.lit(declaration + '<rss version="2.0"><channel><title>c</title>'), items, F.lit("</channel></rss>"))

    def atom(before: str, prefix: str, name: str) -> Column:
        entries = joined(
            lambda line, at: F.concat(
                F.lit(f'<{prefix}entry><{prefix}title type="text">'), line, F.lit(f'</{prefix}title><{prefix}link href="'), address, at,
                F.lit(f'"/><{prefix}link href="https://example.org/other"/></{prefix}entry>'),
            )
        )
        start = f'{before}<{prefix}feed {name}="http://www.w3.org/2005/Atom"><{prefix}title>c</{prefix}title>'
        return F.concat(F.lit(start), entries, F.lit(f"</{prefix}feed>"))

    listed = F.to_json(
        F.struct(
            F.lit("https://jsonfeed.org/version/1.1").alias("version"),
            F.lit("c").alias("title"),
            F.transform(
                F.split("text", "\n"), lambda line, at: F.struct(F.concat(address, at).alias("url"), line.alias("title"))
            ).alias("items"),
        )
    )
    narrow = F.rlike(F.col("text"), F.lit(r"^[\x{0}-\x{7F}\x{A0}-\x{FF}]*$"))
    kinds = [
        (rss('<?xml version="1.0"?>'), "UTF-8"),
        (atom("", "", "xmlns"), "UTF-8"),
        (rss('<?xml version="1.0" encoding="UTF-16"?>'), "UTF-16"),
        (atom("<!-- <html> --> ", "a:", "xmlns:a"), "UTF-8"),
        (listed, "UTF-8"),
        (F.when(narrow, rss('<?xml version="1.0" encoding="windows-1252"?>')).otherwise(rss("")), None),
    ]
    cut_off = (F.col("source") == "src7") & (F.col("lang") == "en")
    content = F.lit(None).cast("binary")
    for at, (body, encoding) in enumerate(kinds):
        cut = F.when(cut_off, F.left(body, F.length(body) - 10)).otherwise(body)
        written = F.encode(cut, encoding) if encoding else F.when(narrow, F.encode(cut, "ISO-8859-1")).otherwise(F.encode(cut, "UTF-8"))
        content = F.when(F.col("doc_id") % len(kinds) == at, written).otherwise(content)
    return table(spark, folder, "documents").select("doc_id", feed_number().alias("feed_ord"), content.alias("content"))


def wall_seconds(ts: Column) -> Column:
    """Seconds since the epoch of a time without zone, whatever the session's zone."""
    days = F.unix_date(ts.cast("date")).cast("bigint")
    return days * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


def event_number() -> Column:
    return F.get_json_object("props", "$.k").try_cast("int")


def event_reads(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as one item with its read, in order of ``event_id``."""
    k = event_number()
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        poll_index(wall_seconds(F.col("ts")), POLL_MINUTES).alias("poll_id"),
        F.concat_ws(" ", "event_type", "event_id").alias("title"),
        F.concat(F.lit("https://example.org/e/"), "event_id").alias("link"),
        F.concat(F.lit("user "), "user_id").alias("source"),
        by_type(CATEGORY_OF_TYPE).alias("category"),
        F.concat(F.lit("k is "), k).alias("read"),
        (k % 4 + 1).cast("int").alias("severity"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), k % 3 + 1).alias("confidence"),
        F.when(k % 10 == 0, F.lit("status 500 — busy")).alias("failure"),
    )


def event_headlines(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a headline with its time; two of three name what some sweep of the catalogue looks for."""
    asked = catalogue.alternatives()
    named = F.element_at(F.array(*[F.lit(a) for a in asked]), (F.col("event_id") % len(asked) + 1).cast("int"))
    told = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit(": “"), named, F.lit("” again"))).otherwise("")
    return table(spark, folder, "events").select(
        "event_id", "ts", F.concat(F.col("event_type"), told, F.lit(" - desk "), "event_id").alias("title")
    )


def event_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a reader's reply, in fifteen spellings from clean to broken."""
    k = event_number()
    band, synonym = by_type(CATEGORY_OF_TYPE), by_type(SYNONYM_OF_TYPE)
    severity = k % 4 + 1

    def reply(category: Column, severity_json: Column, confidence: str) -> Column:
        return F.concat(
            F.lit('{"category":"'), category, F.lit('","read":"k is '), k, F.lit('","severity":'),
            severity_json, F.lit(f',"confidence":"{confidence}"}}'),
        )

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    clean = reply(band, severity, "High")
    spellings = [
        clean,
        reply(synonym, severity, ""),
        reply(F.upper(band), severity, "MEDIUM"),
        reply(F.lit("central_bank"), severity, "low"),
        reply(F.concat(F.lit(" "), band), severity, "low"),
        reply(band, quoted(severity), "Very Sure"),
        reply(band, quoted(F.concat(F.lit(" +"), severity, F.lit(" "))), "low"),
        reply(band, k % 8 + 256, "low"),
        reply(band, -severity, "low"),
        reply(band, F.concat(severity, F.lit(".0")), "low"),
        F.concat(F.lit('{"category":"'), band, F.lit('"}')),
        F.concat(clean, F.lit(" trailing")),
        F.concat(F.left(clean, F.length(clean) - 1), F.lit(',"note":1,"note":2}')),
        reply(band, F.lit("1e999"), "low"),
        F.concat(F.lit('{"more":{"a":1,"a":2},'), F.substring(clean, 2, 10_000)),
    ]
    raw = spellings[-1]
    for at, spelling in enumerate(spellings[:-1]):
        raw = F.when(F.col("event_id") % len(spellings) == at, spelling).otherwise(raw)
    return table(spark, folder, "events").select(
        "event_id", raw.alias("raw"), F.lit(None).cast("string").alias("error")
    )


def event_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a parameter document; some lack keys, some lack their routes."""
    k = event_number()
    routes = F.concat(F.lit('"webhooks":{"'), "event_type", F.lit('":"u'), "user_id", F.lit('","drop":"x"}'))
    knobs = F.concat(
        F.lit(',"min_severity":'), k % 6, F.lit(',"poll_minutes":'), k % 3, F.lit(',"drip_seconds":'), k % 11
    )
    model = F.concat(F.lit(',"model":"m'), k, F.lit('"'))
    kind = F.col("event_id") % 4
    return table(spark, folder, "events").select(
        "event_id",
        F.concat(
            F.lit("{"),
            F.when(kind == 0, '"note":1').otherwise(routes),
            F.when(kind == 1, "").otherwise(knobs),
            F.when(kind == 2, model).otherwise(""),
            F.lit("}"),
        ).alias("document"),
    )
