"""Registered queries: each operator over the whole of the given tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.functions import replies as R
from newsdesk.functions.cards import CARD_TYPE, card_json, meter
from newsdesk.functions.text import fingerprint
from newsdesk.operators import dedupe, delivery, queue, reads, status
from newsdesk.operators.decode import with_reply, with_response
from newsdesk.operators.joins import with_band, with_channel, with_skin
from newsdesk.plans import views as V
from newsdesk.session import cut_lineage, staging_folder, written
from newsdesk.sources import catalogue, items, params
from newsdesk.sources.ledger import LedgerTable

CAP = 200
TICK_CARDS = 25
CAPACITY = V.PARAMS.capacity_per_poll()
FLOOR = V.PARAMS.min_severity
START_UNIX = 1_704_067_200


# Sources and dimensions


def feed_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue entries with their addresses and the items each has delivered."""
    delivered = V.document_items(spark, folder).groupBy("feed_ord").agg(F.count("*").alias("items"))
    return (
        catalogue.feeds(spark)
        .join(delivered, "feed_ord", "left")
        .select("feed_ord", "kind", "source", "hint", "url", F.coalesce("items", F.lit(0)).alias("items"))
    )


def sweep_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Search address of every line taken as a query."""
    return V.document_items(spark, folder).select(
        *V.line_columns(), catalogue.search_url(F.col("title")).alias("url")
    )


def feed_items_xml(spark: SparkSession, folder: str) -> DataFrame:
    return items.items_of(items.parsed_payloads(items.decoded_payloads(V.document_payloads(spark, folder)))).select(
        "feed_ord", "doc_id", "entry_ord", "title", "link"
    )


def page_items(spark: SparkSession, folder: str) -> DataFrame:
    return V.web_items(spark, folder)


def ledger_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger written as a table and read back."""
    ledger = LedgerTable(spark, staging_folder(spark, "ledger"))
    ledger.insert(dedupe.seeded(dedupe.gathered(V.all_items(spark, folder))), 0)
    return ledger.before(1)


def config_defaults(spark: SparkSession, folder: str) -> DataFrame:
    return params.parsed_documents(V.event_documents(spark, folder)).select(
        "event_id", *params.TYPES, F.size("webhooks").alias("routes")
    )


def tuning_view(spark: SparkSession, folder: str) -> DataFrame:
    shown = params.tuning_view(V.event_documents(spark, folder))
    return shown.withColumn("webhook_bands", F.array_join("webhook_bands", ","))


def tuning_clamp(spark: SparkSession, folder: str) -> DataFrame:
    k = V.event_number()
    asked = V.table(spark, folder, "events").select(
        "event_id",
        (k % 7).alias("min_severity"),
        (k % 3).cast("bigint").alias("poll_minutes"),
        (k % 11).cast("bigint").alias("drip_seconds"),
    )
    return params.clamped_tuning(asked)


# Items, fingerprints and de-duplication


def nonblank_items(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document that are not blank."""
    lines = V.table(spark, folder, "documents").select(
        "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "title")
    )
    return dedupe.not_blank(lines)


def gathered_items(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.gathered(V.all_items(spark, folder))


def fingerprint_docs(spark: SparkSession, folder: str) -> DataFrame:
    return V.document_items(spark, folder).select(
        *V.line_columns(), fingerprint(F.col("title")).alias("fp")
    )


def fingerprint_pages(spark: SparkSession, folder: str) -> DataFrame:
    return V.web_items(spark, folder).select(
        F.col("entry_ord").alias("page_id"), fingerprint(F.col("title")).alias("fp")
    )


def batch_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.gathered(V.document_items(spark, folder))


def web_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger of a first run over the web pages."""
    return dedupe.seeded(dedupe.gathered(V.web_items(spark, folder)))


def seed_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.seeded(dedupe.gathered(V.all_items(spark, folder)))


def _second_poll(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.seeded(dedupe.gathered(V.document_items(spark, folder)), poll_id=1)


def ledger_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.upserted(web_ledger(spark, folder), _second_poll(spark, folder))


def ledger_capped(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.capped(cut_lineage(ledger_upsert(spark, folder)), CAP)


def ledger_after_poll(spark: SparkSession, folder: str) -> DataFrame:
    """The web ledger after one poll of the documents, written down and read back."""
    ledger = LedgerTable(spark, staging_folder(spark, "ledger"))
    ledger.insert(web_ledger(spark, folder), 0)
    # Read three times: for the files it can meet, for their rows of it, and for what they lack.
    batch = written(dedupe.gathered(V.document_items(spark, folder)), "batch")
    fresh = dedupe.unseen(batch, ledger.met(batch, 1))
    read = reads.lexicon_reads(fresh, V.LEXICON)
    ledger.insert(dedupe.seeded(read, poll_id=1), 1)
    return ledger.before(2)


def unseen_items(spark: SparkSession, folder: str) -> DataFrame:
    batch = dedupe.gathered(V.document_items(spark, folder))
    return dedupe.unseen(batch, web_ledger(spark, folder))


def suppressed_items(spark: SparkSession, folder: str) -> DataFrame:
    batch = dedupe.gathered(V.document_items(spark, folder))
    return dedupe.suppressed(batch, web_ledger(spark, folder))


def first_sightings(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.first_sightings(V.document_history(spark, folder))


# Reads


def topic_sweep(spark: SparkSession, folder: str) -> DataFrame:
    hits = reads.swept(V.document_items(spark, folder), V.LEXICON)
    return hits.select(
        *V.line_columns(), "sweep", F.array_join("terms", "|").alias("terms")
    )


def sweep_recent(spark: SparkSession, folder: str) -> DataFrame:
    return reads.recent(V.table(spark, folder, "events").select("event_id", "event_type", "ts"), "ts").select(
        "event_id", "event_type"
    )


def catalogue_sweeps(spark: SparkSession, folder: str) -> DataFrame:
    """All sweeps of the catalogue over headlines, each as far back as its query says."""
    hits = reads.swept(V.event_headlines(spark, folder), catalogue.sweeps(spark), "ts", catalogue.horizons())
    return hits.select("event_id", "sweep", F.array_join("terms", "|").alias("terms"))


def reader_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return V.document_items(spark, folder).select(
        *V.line_columns(), F.md5(reads.prompt()).alias("prompt_md5")
    )


def reader_replies(spark: SparkSession, folder: str) -> DataFrame:
    """The pluggable reader asked about every page, replies decoded.

    The reader stands in for a model: band and severity follow from the length of the
    headline, and some reads time out.
    """
    bands = catalogue.CATEGORIES

    def by_length(prompts: pd.Series) -> list[object]:
        answers: list[object] = []
        for size in prompts.str.split("\nHeadline: ", n=1).str[1].str.len():
            if size % 13 == 0:
                answers.append(TimeoutError("reader timed out"))
            else:
                reply = {"category": bands[size % 5], "read": f"{size} letters", "severity": size % 6}
                answers.append(json.dumps(reply))
        return answers

    answered = reads.with_replies(V.web_items(spark, folder), by_length)
    return reads.decoded_reads(answered).select(
        F.col("entry_ord").alias("page_id"), *reads.READ_COLUMNS, "error"
    )


def lexicon_reads(spark: SparkSession, folder: str) -> DataFrame:
    read = reads.lexicon_reads(V.document_items(spark, folder), V.LEXICON)
    return read.select(*V.line_columns(), *reads.READ_COLUMNS)


def decode_envelope(spark: SparkSession, folder: str) -> DataFrame:
    """Replies wrapped in a model server's body and unwrapped again."""
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.col("raw").alias("response")))
    wrapped = V.event_replies(spark, folder).select("event_id", body.alias("body"))
    return with_response(wrapped, "body", "raw").drop("body")


def decode_replies(spark: SparkSession, folder: str) -> DataFrame:
    return reads.decoded_reads(V.event_replies(spark, folder))


def failed_reads(spark: SparkSession, folder: str) -> DataFrame:
    return reads.failed(reads.decoded_reads(V.event_replies(spark, folder)))


def _decoded(spark: SparkSession, folder: str) -> DataFrame:
    replies = with_reply(V.event_replies(spark, folder), "raw", "reply")
    return replies.where(F.col("reply").isNotNull()).select("event_id", "reply.*")


def coerce_category(spark: SparkSession, folder: str) -> DataFrame:
    return with_band(_decoded(spark, folder)).select("event_id", "category")


def coerce_severity(spark: SparkSession, folder: str) -> DataFrame:
    return _decoded(spark, folder).select(
        "event_id", R.coerce_severity(F.col("severity")).alias("severity")
    )


def coerce_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _decoded(spark, folder).select(
        "event_id", R.coerce_confidence(F.col("confidence")).alias("confidence")
    )


def cleared_reads(spark: SparkSession, folder: str) -> DataFrame:
    return _cards(spark, folder).select("event_id", "category", "severity")


# Cards


def _cards(spark: SparkSession, folder: str) -> DataFrame:
    return reads.cleared(V.event_reads(spark, folder), FLOOR)


def _routes(spark: SparkSession) -> DataFrame:
    return V.PARAMS.routes(spark)


def severity_meter(spark: SparkSession, folder: str) -> DataFrame:
    return V.event_reads(spark, folder).select("event_id", meter(F.col("severity")).alias("meter"))


def skin_cards(spark: SparkSession, folder: str) -> DataFrame:
    return with_skin(V.event_reads(spark, folder)).select("event_id", "label", "emoji", "color")


def route_cards(spark: SparkSession, folder: str) -> DataFrame:
    return with_channel(_cards(spark, folder), _routes(spark)).select("event_id", "category", "channel")


def _card_fields(cards: DataFrame, *keys: str) -> DataFrame:
    embed = F.col("card.embeds")[0]
    return cards.select(
        *keys,
        F.col("card.username").alias("username"),
        embed["title"].alias("title"),
        embed["url"].alias("url"),
        embed["color"].alias("color"),
        embed["description"].alias("description"),
        F.array_join(
            F.transform(embed["fields"], lambda f: F.concat(f["name"], F.lit("="), f["value"])), ";"
        ).alias("fields"),
        F.forall(embed["fields"], lambda f: f["inline"]).alias("all_inline"),
        embed["footer"]["text"].alias("footer"),
    )


def cards(spark: SparkSession, folder: str) -> DataFrame:
    return _card_fields(delivery.themed(_cards(spark, folder)), "event_id")


def cards_by_channel(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads of every channel, serialised and parsed back."""
    sent = delivery.routed(_cards(spark, folder), _routes(spark)).where(F.col("channel").isNotNull())
    payloads = sent.select("event_id", "channel", card_json(F.col("card")).alias("payload"))
    return _card_fields(
        payloads.withColumn("card", F.from_json("payload", CARD_TYPE)), "event_id", "channel"
    )


# Queue and deliveries


def queue_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return queue.queue_ranked(
        _cards(spark, folder).select("event_id", "severity"), "event_id"
    )


def drip_top(spark: SparkSession, folder: str) -> DataFrame:
    return queue.popped(_cards(spark, folder), TICK_CARDS, "event_id").select(
        "event_id", "category", "severity", "title"
    )


def drip_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return queue.drip_schedule(
        _cards(spark, folder).select("event_id", "severity"), 3, 90, START_UNIX, "event_id"
    )


def drip_dry(spark: SparkSession, folder: str) -> DataFrame:
    tick = queue.popped(_cards(spark, folder), TICK_CARDS, "event_id")
    return delivery.with_outcome(delivery.routed(tick, _routes(spark)), dry=True).select(
        "event_id", "outcome", "line"
    )


def _outcomes(cards: DataFrame, spark: SparkSession) -> DataFrame:
    return delivery.with_outcome(delivery.routed(cards, _routes(spark)), failure="failure")


def drip_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _outcomes(_cards(spark, folder), spark).select(
        "event_id", "category", "channel", "outcome", "line"
    )


def _history(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All reads, and the flow of their cards through the queue."""
    history = V.event_reads(spark, folder)
    return history, queue.queue_flow(history, CAPACITY, FLOOR)


def queue_replay(spark: SparkSession, folder: str) -> DataFrame:
    history, flow = _history(spark, folder)
    narrow = history.select("event_id", "category", "severity", "poll_id")
    return queue.queue_replay(narrow, flow, FLOOR, "event_id").drop("category")


# Status


def poll_windows(spark: SparkSession, folder: str) -> DataFrame:
    window = F.window("ts", f"{V.POLL_MINUTES} minutes")
    return (
        V.table(spark, folder, "events")
        .groupBy(window.alias("poll"))
        .agg(F.count("*").alias("items"))
        .select(V.wall_seconds(F.col("poll.start")).alias("start_unix"), "items")
    )


def poll_summary(spark: SparkSession, folder: str) -> DataFrame:
    _, flow = _history(spark, folder)
    return queue.poll_summary(flow).withColumn("line", status.poll_line())


def posted_counts(spark: SparkSession, folder: str) -> DataFrame:
    return status.posted_counts(_outcomes(_cards(spark, folder), spark))


def status_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot at the end of the replayed history."""
    history, flow = _history(spark, folder)
    left = queue.leavers(history, flow, FLOOR, "event_id")
    popped = _outcomes(left, spark).select("category", "outcome")
    return status.status_snapshot(flow, popped, V.PARAMS, len(catalogue.CATALOGUE))


def _health(spark: SparkSession, folder: str) -> DataFrame:
    return status.feedcheck(
        catalogue.feeds(spark), items.parsed_payloads(items.decoded_payloads(V.document_payloads(spark, folder)))
    )


def feedcheck(spark: SparkSession, folder: str) -> DataFrame:
    return _health(spark, folder)


def feedcheck_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return status.feedcheck_rollup(_health(spark, folder))


def _activity(spark: SparkSession, folder: str, lines: int | None = None) -> DataFrame:
    """Lines of the replayed history: each poll's line, then those of its pops.

    For the newest ``lines`` of them only the polls that have these are replayed.
    """
    history, flow = _history(spark, folder)
    since = None if lines is None else queue.since_poll(flow, lines)
    polls = queue.poll_summary(flow).select(
        "poll_id", F.lit(0).cast("bigint").alias("place"), status.poll_line().alias("line")
    )
    replayed = queue.queue_replay(history, flow, FLOOR, "event_id", since=since)
    pops = _outcomes(replayed, spark).select(F.col("left_poll").alias("poll_id"), "place", "line")
    return (polls if since is None else polls.where(F.col("poll_id") >= since)).unionByName(pops)


def activity_log(spark: SparkSession, folder: str) -> DataFrame:
    return status.recent_log(_activity(spark, folder, status.LOG_LINES), status.LOG_LINES, "poll_id", "place")


def recent_log(spark: SparkSession, folder: str) -> DataFrame:
    return status.recent_log(_activity(spark, folder, status.SNAPSHOT_LINES), status.SNAPSHOT_LINES, "poll_id", "place")


def activity_posted(spark: SparkSession, folder: str) -> DataFrame:
    return status.posted_lines(_activity(spark, folder))


QUERIES = {
    q.__name__: q
    for q in (
        feed_catalogue, sweep_urls, feed_items_xml, page_items, ledger_scan, config_defaults,
        tuning_view, tuning_clamp, nonblank_items, gathered_items, fingerprint_docs,
        fingerprint_pages, batch_dedupe, seed_ledger, ledger_upsert, ledger_capped,
        ledger_after_poll, unseen_items, suppressed_items, first_sightings, topic_sweep,
        sweep_recent, catalogue_sweeps, reader_prompts, reader_replies, lexicon_reads, decode_envelope,
        decode_replies, failed_reads, coerce_category, coerce_severity, coerce_confidence,
        cleared_reads, severity_meter, skin_cards, route_cards, cards, cards_by_channel,
        queue_ranked, drip_top, drip_schedule, drip_dry, drip_outcomes, queue_replay,
        poll_windows, poll_summary, posted_counts, status_snapshot, feedcheck,
        feedcheck_rollup, activity_log, recent_log, activity_posted,
    )
}
