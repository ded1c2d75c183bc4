"""One short beat for both cycles of a desk: what is due is decided at each beat, by the parameters of the moment.

Items are taken in as they land and wait in a table of their own; a poll gathers what waits. A beat looks whether a drip is due,
and at a drip whether a poll is, and does the poll first; changed periods so hold from the next beat on. A poll that is due
is done even when nothing has landed, and asks failed reads again.

What a beat is to do, and up to which intake, is written down before it is done. A beat that a crash has cut short is
finished by the next one: the desk's steps skip what is done, and periods go on from the recorded times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsdesk.session import delete_folder
from newsdesk.sources.items import ITEM_COLUMNS
from newsdesk.sources.tables import BatchTable, one_row
from newsdesk.streaming.desk import Desk

BEAT_SCHEMA = "polls BOOLEAN, drips BOOLEAN, poll_id BIGINT, tick_id BIGINT, since BIGINT, upto BIGINT, polled_unix BIGINT, dripped_unix BIGINT"
OFFERED_SCHEMA = "feed_ord INT, entry_ord BIGINT, title STRING, link STRING, source STRING"
START = Row(batch_id=-1, polls=False, drips=False, poll_id=-1, tick_id=-1, since=-1, upto=-1, polled_unix=0, dripped_unix=0)


class DueClock:
    """The beats of a desk. After a start, a poll and a drip are due at once."""

    def __init__(self, desk: Desk):
        self.desk, self.spark, self.fresh = desk, desk.spark, True
        self.offered = BatchTable(self.spark, f"{desk.root}/offered", OFFERED_SCHEMA)
        self.offered_done = BatchTable(self.spark, f"{desk.root}/offered_done", "rows BIGINT")
        self.plans = BatchTable(self.spark, f"{desk.root}/plans", BEAT_SCHEMA)
        self.beats = BatchTable(self.spark, f"{desk.root}/beats", BEAT_SCHEMA)
        self.state: Row | None = None

    # Intake

    def offer(self, items: DataFrame, batch_id: int) -> None:
        """Let a micro-batch wait for the next poll."""
        if not self.offered_done.has(batch_id):
            items = items.select(*ITEM_COLUMNS).withColumn("entry_ord", F.col("entry_ord").cast("bigint"))
            self.offered.write(items, batch_id)
            self.offered_done.write(one_row(self.spark, rows=F.lit(self.offered.at(batch_id).count()).cast("bigint")), batch_id)

    def _waiting(self, plan: Row) -> DataFrame:
        rows = self.offered.read().where((F.col("batch_id") > plan.since) & (F.col("batch_id") <= plan.upto))
        # Intakes have no order of their own among equal positions, and need none.
        return rows.drop("batch_id")

    # Beats

    def _last(self) -> Row:
        """The last finished beat."""
        if self.state is None:
            rows = self.beats.read().orderBy(F.desc("batch_id")).limit(1).collect()
            self.state = rows[0] if rows else START
        return self.state

    def _plan(self, last: Row) -> Row | None:
        """What is to be done now, if anything; one that was written down before a crash holds."""
        beat = last.batch_id + 1
        if found := self.plans.at(beat).collect():
            return found[0]
        now, params = int(self.desk.clock()), self.desk.params
        if not self.fresh and now - last.dripped_unix < params.drip_seconds:
            return None
        polls = self.fresh or now - last.polled_unix >= params.poll_minutes * 60
        landed = self.offered_done.read().agg(F.max("batch_id")).head()[0] if polls else None
        upto = last.upto if landed is None else max(landed, last.upto)
        values = {
            "polls": polls, "drips": True, "poll_id": last.poll_id + polls, "tick_id": last.tick_id + 1, "since": last.upto,
            "upto": upto, "polled_unix": now if polls else last.polled_unix, "dripped_unix": now,
        }
        kinds = {name: kind.lower() for name, kind in (column.split() for column in BEAT_SCHEMA.split(", "))}
        self.plans.write(one_row(self.spark, **{name: F.lit(value).cast(kinds[name]) for name, value in values.items()}), beat)
        return self.plans.at(beat).head()

    def beat(self) -> Row | None:
        """Do what is due, the poll before the drip; returns what was done."""
        self.desk.refresh_params()
        last = self._last()
        plan = self._plan(last)
        if plan is None:
            return None
        beat = last.batch_id + 1
        if plan.polls:
            self.desk.poll(self._waiting(plan), plan.poll_id)
        if plan.drips:
            self.desk.drip(plan.tick_id)
        self.beats.write(self.plans.at(beat), beat)
        self.state, self.fresh = Row(**plan.asDict(), batch_id=beat), False
        self._clean(last, beat)
        return plan

    def _clean(self, last: Row, beat: int) -> None:
        """Drop what finished beats have used up."""
        for table in (self.plans, self.beats):
            delete_folder(self.spark, f"{table.path}/batch_id={beat - 2}")
        for batch in range(last.since + 1, last.upto + 1):
            delete_folder(self.spark, f"{self.offered.path}/batch_id={batch}")

    # Queries

    def take_in(self, items: DataFrame, seconds: float | None = None) -> StreamingQuery:
        """Take in a stream of items every so often, or everything landed so far."""
        trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
        sink = items.writeStream.foreachBatch(self.offer).option("checkpointLocation", f"{self.desk.root}/checkpoints/intake")
        return sink.trigger(**trigger).start()

    def start(self, items: DataFrame, seconds: float = 1) -> tuple[StreamingQuery, StreamingQuery]:
        """Intake and beats; a rate source serves as the clock."""
        ticks = self.spark.readStream.format("rate").load().writeStream.foreachBatch(lambda *_: self.beat())
        ticks = ticks.option("checkpointLocation", f"{self.desk.root}/checkpoints/beats")
        return self.take_in(items, seconds), ticks.trigger(processingTime=f"{seconds} seconds").start()

    def once(self, items: DataFrame) -> Row | None:
        """Take in what has landed, poll, then drip; a first run seeds the ledger and has nothing to drip."""
        query = self.take_in(items)
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
        self.fresh = True
        return self.beat()
