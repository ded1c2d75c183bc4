"""The continuous desk: polls and drips as two streaming queries over shared tables.

Both cycles run in ``foreachBatch``. Every step writes its table under the batch's own id
before the next step reads it, and the last step of a cycle writes one row to ``polls``
or ``ticks``. A batch that is run again after a crash skips finished work and overwrites
unfinished work; readers look only at finished polls.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsdesk.functions.cards import card_json
from newsdesk.operators import dedupe, delivery, queue, reads, status
from newsdesk.sources import catalogue
from newsdesk.sources.items import ITEM_COLUMNS
from newsdesk.sources.params import Params, reload_params
from newsdesk.sources.ledger import LedgerTable
from newsdesk.sources.tables import BatchTable, one_row

ITEM_SCHEMA = "feed_ord INT, entry_ord BIGINT, title STRING, link STRING, source STRING, fp STRING"
READ_SCHEMA = "category STRING, read STRING, severity INT, confidence STRING"
READS_SCHEMA = f"{ITEM_SCHEMA}, {READ_SCHEMA}, error STRING"
CARD_SCHEMA = f"{ITEM_SCHEMA}, {READ_SCHEMA}, poll_id BIGINT"
POSTED_SCHEMA = ", ".join(f"posted_{band} BIGINT" for band in catalogue.BANDS)
TOTALS_SCHEMA = ", ".join(f"total_{band} BIGINT" for band in catalogue.BANDS)
LOG_SCHEMA = "unix BIGINT, cycle INT, place BIGINT, line STRING"

# Position of a card in its severity's line.
ARRIVAL = dedupe.INSERT_ORDER

# Maps unseen items to reads with an ``error`` column.
ItemReader = Callable[[DataFrame], DataFrame]


def model_reader(reader: reads.Reader, parallelism: int | None = None) -> ItemReader:
    """Item reader that asks a model through Arrow batches."""
    return lambda items: reads.decoded_reads(reads.with_replies(items, reader, parallelism))


def lexicon_reader(lexicon: dict[str, tuple[str, ...]]) -> ItemReader:
    return lambda items: reads.lexicon_reads(items, lexicon).withColumn(
        "error", F.lit(None).cast("string")
    )


class Desk:
    """State under ``root``, parameters, and the two cycles that advance the state."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        reader: ItemReader,
        params: Params,
        params_path: str | None = None,
        poster: delivery.Poster | None = None,
        dry: bool = False,
        cap: int | None = None,
        clock: Callable[[], float] = time.time,
    ):
        self.spark, self.root, self.reader, self.poster = spark, root, reader, poster
        self.params, self.params_path, self.dry, self.clock = params, params_path, dry, clock
        self.started = False
        self.newest: dict[str, int] = {}

        def table(name: str, schema: str) -> BatchTable:
            return BatchTable(spark, f"{root}/{name}", schema)

        self.ledger = LedgerTable(spark, f"{root}/ledger", cap)
        self.gathered = table("gathered", ITEM_SCHEMA)
        self.reads = table("reads", READS_SCHEMA)
        self.read_done = table("read_done", "reads BIGINT")
        self.cards = table("cards", CARD_SCHEMA)
        self.polls = table("polls", "new BIGINT, seen BIGINT, unix BIGINT, new_total BIGINT")
        self.popped = table("popped", f"{CARD_SCHEMA}, place BIGINT")
        self.drained = table(
            "drained", "severity INT, poll_id BIGINT, feed_ord INT, entry_ord BIGINT, fp STRING"
        )
        self.deliveries = table(
            "deliveries",
            f"{CARD_SCHEMA}, place BIGINT, channel STRING, payload STRING, failure STRING, outcome STRING, line STRING",
        )
        self.popped_done = table("popped_done", "rows BIGINT")
        self.deliveries_done = table("deliveries_done", "rows BIGINT")
        self.ticks = table("ticks", f"popped BIGINT, {POSTED_SCHEMA}, unix BIGINT, popped_total BIGINT, {TOTALS_SCHEMA}, oldest BIGINT")
        self.poll_log = table("poll_log", LOG_SCHEMA)
        self.tick_log = table("tick_log", LOG_SCHEMA)
        self.snapshots = table("snapshots", status_schema())

    def refresh_params(self) -> None:
        if self.params_path is not None:
            self.params = reload_params(self.spark, self.params_path, self.params)

    # Polls

    def poll(self, offered: DataFrame, poll_id: int) -> None:
        """Gather, skip what is seen, read the rest once, queue what is cleared."""
        self.refresh_params()
        first_run, self.started = not self.started and not self.ledger.size(poll_id), True
        if self.polls.has(poll_id):
            return
        again = reads.failed(self.reads_of(poll_id - 1)).select(*ITEM_COLUMNS)
        items = offered.select(*ITEM_COLUMNS).withColumn("entry_ord", F.col("entry_ord").cast("bigint"))
        self.gathered.write(dedupe.gathered(items.unionByName(again)), poll_id)
        batch = self.gathered.at(poll_id)
        if first_run:
            self.ledger.insert(dedupe.seeded(batch, poll_id), poll_id)
            self._finish_poll(poll_id, 0, self.ledger.size(poll_id + 1), status.seed_line(batch.count()))
            return
        self._ask(dedupe.unseen(batch, self.ledger.met(batch, poll_id)), poll_id)
        good = reads.succeeded(self.reads_of(poll_id))
        self.ledger.insert(dedupe.seeded(good, poll_id), poll_id)
        cards = reads.cleared(good, self.params.min_severity)
        self.cards.write(cards.withColumn("poll_id", F.lit(poll_id).cast("bigint")), poll_id)
        new, seen = self.cards.at(poll_id).count(), self.ledger.size(poll_id + 1)
        queued = self._queued() + new
        self._finish_poll(poll_id, new, seen, f"poll: {new} new · {queued} queued · {seen} seen")

    def _ask(self, items: DataFrame, poll_id: int) -> None:
        """Read items once: finished reads are never asked again."""
        if not self.read_done.has(poll_id):
            self.reads.write(self.reader(items), poll_id)
            done = self.reads.at(poll_id).agg(F.count("*").alias("reads"))
            self.read_done.write(done, poll_id)

    def reads_of(self, poll_id: int) -> DataFrame:
        """Reads of one poll, if they are complete."""
        done = self.read_done.has(poll_id)
        return self.reads.at(poll_id) if done else self.spark.createDataFrame([], READS_SCHEMA)

    def _finish_poll(self, poll_id: int, new: int, seen: int, line: str) -> None:
        unix, place = self._now(), F.lit(poll_id).cast("bigint")
        self.poll_log.write(
            one_row(self.spark, unix=unix, cycle=F.lit(0), place=place, line=F.lit(line)), poll_id
        )
        before = self.polls.at(poll_id - 1).head()
        counts = {"new": new, "seen": seen, "new_total": new + (before.new_total if before else 0)}
        row = {name: F.lit(n).cast("bigint") for name, n in counts.items()}
        self.polls.write(one_row(self.spark, **row, unix=unix), poll_id)
        self.newest["polls"] = poll_id

    def _now(self) -> Column:
        return F.lit(int(self.clock())).cast("bigint")

    def _last(self, name: str) -> Row | None:
        """The record of the last finished poll or tick, which has the totals of all."""
        table: BatchTable = getattr(self, name)
        if name not in self.newest:
            found = table.read().agg(F.max("batch_id")).head()[0]
            if found is None:
                return None
            self.newest[name] = found
        return table.at(self.newest[name]).head()

    def _queued(self) -> int:
        """Cards waiting, from the records of the last poll and the last tick."""
        poll, tick = self._last("polls"), self._last("ticks")
        return (poll.new_total if poll else 0) - (tick.popped_total if tick else 0)

    # Drips

    def waiting(self, tick_id: int) -> DataFrame:
        """Cards of finished polls that no tick before ``tick_id`` has popped.

        Within a severity cards leave in order of arrival, so the last popped position of
        each severity (at most four rows) tells popped cards from waiting ones. The tick before has noted the
        poll of the oldest card that waits; the folders of earlier polls are not opened.
        """
        before = self.ticks.at(tick_id - 1).head()
        since = F.col("batch_id") >= (before.oldest if before else 0)
        finished = self.polls.read().where(since).select("batch_id")
        cards = self.cards.read().where(since).join(finished, "batch_id", "left_semi").drop("batch_id")
        marks = {row["severity"]: row for row in self.drained.at(tick_id - 1).collect()}
        if not marks:
            return cards
        passed = [
            (F.col("severity") == severity) & _after(mark) for severity, mark in marks.items()
        ]
        return cards.where(reduce(or_, passed, ~F.col("severity").isin(*marks)))

    def _oldest(self, tick_id: int) -> int:
        """The first poll with a card that waits after a tick; no later poll's cards are before it."""
        before = self.ticks.at(tick_id - 1).head()
        finished = self.polls.read().where(F.col("batch_id") >= (before.oldest if before else 0))
        upto = finished.agg(F.max("batch_id")).head()[0]
        marks = {row["severity"]: row for row in self.drained.at(tick_id).collect()}
        ahead = self.waiting(tick_id)
        if marks:
            ahead = ahead.where(reduce(or_, [(F.col("severity") == s) & _after(m) for s, m in marks.items()], ~F.col("severity").isin(*marks)))
        first = ahead.agg(F.min("poll_id")).head()[0]
        if first is not None:
            return first
        return upto + 1 if upto is not None else before.oldest if before else 0

    def drip(self, tick_id: int) -> None:
        """Pop the strongest cards, deliver them, and record that they have left.

        What a tick popped is fixed once, and so is what it delivered: a tick that is run again
        takes the same cards, and hands none to the poster after its deliveries are complete.
        """
        self.refresh_params()
        if self.ticks.has(tick_id):
            if not self.snapshots.has(tick_id):
                self.snapshots.write(self.status(), tick_id)
            return
        if not self.popped_done.has(tick_id):
            front = queue.popped(self.waiting(tick_id), self.params.max_per_drop, *ARRIVAL)
            self.popped.write(queue.with_place(front, *ARRIVAL), tick_id)
            self._complete(self.popped, self.popped_done, tick_id)
        popped = self.popped.at(tick_id)
        if not self.deliveries_done.has(tick_id):
            cards = delivery.routed(popped, self.params.routes(self.spark))
            cards = cards.withColumn("payload", card_json(F.col("card")))
            if self.poster is None or self.dry:
                cards = cards.drop("card").withColumn("failure", F.lit(None).cast("string"))
            else:
                cards = delivery.posted_by(cards, self.poster)
            named = [f.strip().split(" ")[0] for f in self.deliveries.schema.split(",")]
            self.deliveries.write(
                delivery.with_outcome(cards, self.dry, "failure").select(*named), tick_id
            )
            self._complete(self.deliveries, self.deliveries_done, tick_id)
        left = popped.groupBy("severity").agg(F.max(F.struct(*ARRIVAL)).alias("_last"))
        marks = left.select("severity", "_last.*").unionByName(self.drained.at(tick_id - 1))
        last = marks.groupBy("severity").agg(F.max(F.struct(*ARRIVAL)).alias("_last"))
        self.drained.write(last.select("severity", "_last.*"), tick_id)
        unix = self._now()
        sent = self.deliveries.at(tick_id)
        self.tick_log.write(
            sent.select(unix.alias("unix"), F.lit(1).alias("cycle"), "place", "line"), tick_id
        )
        counts = sent.agg(F.count("*").alias("popped"), *status.posted_columns())
        before = self.ticks.at(tick_id - 1).head()
        totals = {"popped_total": "popped", **{f"total_{band}": f"posted_{band}" for band in catalogue.BANDS}}
        summed = {total: F.col(own) + F.lit(before[total] if before else 0) for total, own in totals.items()}
        oldest = F.lit(self._oldest(tick_id)).cast("bigint")
        self.ticks.write(counts.withColumns({"unix": unix, **summed, "oldest": oldest}), tick_id)
        self.newest["ticks"] = tick_id
        self.snapshots.write(self.status(), tick_id)

    @staticmethod
    def _complete(rows: BatchTable, done: BatchTable, batch_id: int) -> None:
        done.write(rows.at(batch_id).agg(F.count("*").alias("rows")), batch_id)

    # Reports

    def activity(self) -> DataFrame:
        return self.poll_log.read().unionByName(self.tick_log.read())

    def recent_log(self, lines: int = status.SNAPSHOT_LINES) -> DataFrame:
        return status.recent_log(self.activity(), lines, "unix", "cycle", "batch_id", "place").select("line")

    def status(self) -> DataFrame:
        """One row of counters, from the records of the last finished poll and tick."""
        poll, tick = self._last("polls"), self._last("ticks")
        counters = {
            "seen": poll.seen if poll else 0,
            "queued": (poll.new_total if poll else 0) - (tick.popped_total if tick else 0),
            **{f"posted_{band}": tick[f"total_{band}"] if tick else 0 for band in catalogue.BANDS},
            "last_poll_unix": poll.unix if poll else None,
            "min_severity": self.params.min_severity,
            "poll_minutes": self.params.poll_minutes,
            "drip_seconds": self.params.drip_seconds,
            "feeds": len(catalogue.CATALOGUE),
        }
        kinds = dict(column.split() for column in status_schema().split(", "))
        return one_row(self.spark, **{name: F.lit(n).cast(kinds[name].lower()) for name, n in counters.items()})

    # Queries

    def start_polls(self, items: DataFrame, once: bool = False) -> StreamingQuery:
        """Poll a stream of items at every due tick, or everything landed so far."""
        period = f"{self.params.poll_seconds()} seconds"
        return (
            items.writeStream.foreachBatch(self.poll)
            .option("checkpointLocation", f"{self.root}/checkpoints/polls")
            .trigger(**({"availableNow": True} if once else {"processingTime": period}))
            .start()
        )

    def start_drips(self, seconds: int | None = None) -> StreamingQuery:
        """Drip every ``drip_seconds``; a rate source serves as the clock."""
        period = max(self.params.drip_seconds, 1) if seconds is None else seconds
        return (
            self.spark.readStream.format("rate")
            .load()
            .writeStream.foreachBatch(lambda _, tick_id: self.drip(tick_id))
            .option("checkpointLocation", f"{self.root}/checkpoints/drips")
            .trigger(processingTime=f"{period} seconds")
            .start()
        )


def _after(mark) -> Column:
    """Whether a card arrived after the position in ``mark``."""
    later = F.lit(False)
    for name in reversed(ARRIVAL):
        later = (F.col(name) > mark[name]) | ((F.col(name) == mark[name]) & later)
    return later


def status_schema() -> str:
    return (
        f"seen BIGINT, queued BIGINT, {POSTED_SCHEMA}, last_poll_unix BIGINT, "
        "min_severity INT, poll_minutes BIGINT, drip_seconds BIGINT, feeds BIGINT"
    )


def once_per_fingerprint(items: DataFrame, arrival: str | None = None, horizon: str | None = None) -> DataFrame:
    """Stream of items whose fingerprint the state store has not seen yet.

    The state is kept per fingerprint across all executors, for ever or, given an
    ``arrival`` column and a ``horizon``, for that long. It is bounded by time where the
    ledger is bounded by count, and any of several equal titles in one batch may win.
    """
    keyed = dedupe.with_fingerprint(dedupe.not_blank(items))
    if arrival is None or horizon is None:
        return keyed.dropDuplicates(["fp"])
    return keyed.withWatermark(arrival, horizon).dropDuplicatesWithinWatermark(["fp"])
