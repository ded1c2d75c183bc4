"""Counters, snapshots, feed health and the activity log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.sources.catalogue import BANDS
from newsdesk.sources.encodings import NO_CONTENT
from newsdesk.sources.params import Params

# Lines the activity log keeps, and lines a snapshot shows.
LOG_LINES = 200
SNAPSHOT_LINES = 60


def posted_columns() -> list[Column]:
    """Successful posts per category, 0 where there are none."""
    return [
        F.count_if((F.col("outcome") == "posted") & (F.col("category") == band)).alias(f"posted_{band}")
        for band in BANDS
    ]


def posted_counts(deliveries: DataFrame) -> DataFrame:
    return deliveries.agg(*posted_columns())


def status_snapshot(
    flow: DataFrame, popped: DataFrame, params: Params, feeds: int, cap: int | None = None
) -> DataFrame:
    """One row from the totals of a queue's ``flow`` and the ``category, outcome`` of its popped cards.

    The flow has a row per poll and severity, so no read is looked at again.
    """
    none = F.lit(None).cast("string")
    polls = flow.groupBy("poll_id").agg(F.max("reads").alias("reads"), F.sum("new").alias("new"))
    gone = popped.select(
        F.lit(None).cast("bigint").alias("poll_id"), F.lit(0).cast("bigint").alias("reads"),
        F.lit(0).cast("bigint").alias("new"), "category", "outcome",
    )
    state = polls.select("*", none.alias("category"), none.alias("outcome")).unionByName(gone)
    total = sum((F.col(f"posted_{band}") for band in BANDS[1:]), F.col(f"posted_{BANDS[0]}"))
    seen = F.coalesce(F.sum("reads"), F.lit(0))
    return state.agg(
        (seen if cap is None else F.least(seen, F.lit(cap))).alias("seen"),
        (F.coalesce(F.sum("new"), F.lit(0)) - F.count("outcome")).alias("queued"),
        *posted_columns(),
        (F.max("poll_id") * (params.poll_minutes * 60)).alias("last_poll_unix"),
    ).select(
        "*",
        total.alias("posted_total"),
        F.lit(params.min_severity).alias("min_severity"),
        F.lit(params.poll_minutes).cast("bigint").alias("poll_minutes"),
        F.lit(params.drip_seconds).cast("bigint").alias("drip_seconds"),
        F.lit(feeds).cast("bigint").alias("feeds"),
    )


def feedcheck(feeds: DataFrame, parsed: DataFrame) -> DataFrame:
    """Health of every catalogue feed: payloads landed, entries found, and its line.

    A feed is ok when all its payloads were valid, even without entries; a feed with a
    bad payload, or none at all, is not, and its line tells why.
    """
    health = parsed.groupBy("feed_ord").agg(
        F.count("*").alias("payloads"),
        F.count_if("ok").alias("valid"),
        F.sum(F.size("entries")).cast("bigint").alias("items"),
        F.min("reason").alias("reason"),
    )
    ok = F.coalesce(F.col("payloads") == F.col("valid"), F.lit(False))
    checked = feeds.join(health, "feed_ord", "left").withColumn("ok", ok)
    line = F.when(
        F.col("ok"), F.format_string("[ok ] %-16s %3d  (%s)", "source", "items", F.initcap("hint"))
    ).otherwise(F.format_string("[ERR] %-16s %s", F.col("source"), F.coalesce("reason", F.lit(NO_CONTENT))))
    return checked.select(
        "feed_ord",
        "source",
        "hint",
        "ok",
        F.coalesce("payloads", F.lit(0)).alias("payloads"),
        F.coalesce("items", F.lit(0)).alias("items"),
        line.alias("line"),
    )


def feedcheck_rollup(checked: DataFrame) -> DataFrame:
    """Feeds ok and items pulled per band and source, per band, and in total."""
    return checked.rollup("hint", "source").agg(
        F.count_if("ok").alias("feeds_ok"),
        F.sum(F.when(F.col("ok"), F.col("items")).otherwise(0)).alias("items"),
        F.grouping_id().cast("int").alias("level"),
    )


def poll_line() -> Column:
    return F.format_string("poll: %d new · %d queued · %d seen", "new", "queued", "seen")


def seed_line(count: int) -> str:
    return f"seeded {count} headlines (posted nothing)"


def recent_log(activity: DataFrame, lines: int, *sequence: str) -> DataFrame:
    """The newest ``lines`` of the log; its ring is :data:`LOG_LINES` of them."""
    return activity.orderBy(*[F.desc(c) for c in sequence]).limit(lines)


def posted_lines(activity: DataFrame) -> DataFrame:
    return activity.where(F.startswith("line", F.lit("posted")))
