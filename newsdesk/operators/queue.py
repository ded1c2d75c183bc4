"""The carry-over priority queue: order, pops, pacing, and its replay over many polls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsdesk.functions.replies import MAX_SEVERITY
from newsdesk.operators.rank import ranked
from newsdesk.operators.reads import is_cleared
from newsdesk.operators.scan import BLOCK, scanned
from newsdesk.session import cut_lineage


def in_order(*sequence: str) -> list:
    """Queue order: strongest first, ties in order of arrival."""
    return [F.desc("severity"), *sequence]


def queue_ranked(queue: DataFrame, *sequence: str) -> DataFrame:
    """Add every card's 1-based ``rank`` in the queue."""
    return ranked(queue, in_order(*sequence))


def popped(queue: DataFrame, most: int, *sequence: str) -> DataFrame:
    """The front of the queue: what one drip tick removes."""
    return queue.orderBy(*in_order(*sequence)).limit(most)


def with_place(front: DataFrame, *sequence: str) -> DataFrame:
    """Number the cards of one tick, at most ``max_per_drop``, from 1."""
    return front.withColumn(
        "place", F.row_number().over(W.orderBy(*in_order(*sequence))).cast("bigint")
    )


def remaining(queue: DataFrame, popped_cards: DataFrame, *sequence: str) -> DataFrame:
    return queue.join(popped_cards.select(*sequence), list(sequence), "left_anti")


def drip_schedule(
    queue: DataFrame, max_per_drop: int, drip_seconds: int, start_unix: int, *sequence: str
) -> DataFrame:
    """Add the ``slot`` and time at which each card of a standing queue leaves."""
    slot = F.floor((F.col("rank") - 1) / max_per_drop).cast("bigint")
    return (
        queue_ranked(queue, *sequence)
        .withColumn("slot", slot)
        .withColumn("due_unix", F.lit(start_unix) + F.col("slot") * drip_seconds)
    )


def poll_index(seconds: Column, poll_minutes: int) -> Column:
    """Number of the poll that gathers a row, from its arrival in epoch seconds."""
    return F.floor(seconds / (poll_minutes * 60)).cast("bigint")


def queue_flow(reads: DataFrame, capacity: int, min_severity: int, block: int = BLOCK) -> DataFrame:
    """Arrivals and departures per severity and poll, without a fold over polls.

    ``reads`` has ``poll_id, category, severity``. Cards of severity s or more form a
    queue that weaker cards never delay, so its backlog after poll t follows
    ``b(t) = max(0, b(t-1) + arrivals(t) - capacity)``, whose solution is
    ``S(t) - min(0, min of S up to t)`` with ``S(t) = arrivals so far - capacity * polls so far``;
    a prefix scan over blocks of polls finds both, so no task takes a whole history.
    The departures of exactly severity s are the difference of two neighbouring queues.

    Result: ``severity, poll_id, reads, new, arrived, left_before, left, stronger`` where
    ``reads`` counts all reads of the poll, ``new`` the cards it added, ``arrived`` cards
    so far, ``left_before`` and ``left`` departures before and after its pops, and
    ``stronger`` its pops of higher severities. The rows are bounded by the clock
    (polls x 4), not by the data, so the table is written down and used freely.
    """
    floors = range(1, MAX_SEVERITY + 1)
    card = is_cleared(min_severity)
    per_poll = cut_lineage(
        reads.groupBy("poll_id").agg(
            F.count("*").alias("reads"),
            *[F.count_if(card & (F.col("severity") >= s)).alias(f"n{s}") for s in floors],
        )
    )
    first, last = per_poll.agg(F.min("poll_id"), F.max("poll_id")).head()
    spark = reads.sparkSession
    polls = spark.range(0) if first is None else spark.range(first, last + 1)
    levels = F.array(*[F.struct(F.lit(s).alias("floor"), F.col(f"n{s}").alias("n")) for s in floors])
    every = polls.withColumnRenamed("id", "poll_id").join(per_poll, "poll_id", "left").na.fill(0)
    grid = every.select("poll_id", "reads", F.inline(levels)).withColumn("step", F.col("n") - capacity)
    span = 0 if first is None else last - first + 1
    above = W.partitionBy("poll_id").orderBy(F.desc("floor"))

    def own(name: str) -> Column:
        return F.col(name) - F.lag(name, 1, 0).over(above)

    def backlog(total: Column, least: str) -> Column:
        """Cards waiting when ``total`` is the surplus of arrivals over capacity, and ``least`` its least so far."""
        return total - F.least(F.lit(0), least)

    turns = (F.col("poll_id") - F.lit(first or 0) + 1) * capacity
    return cut_lineage(
        scanned(grid, ["floor"], "poll_id", "step", span, block)
        .withColumn("arrived", F.col("total") + turns)
        .withColumn("gone", F.col("arrived") - backlog(F.col("total"), "least"))
        .withColumn("gone_before", F.col("arrived") - F.col("n") - backlog(F.col("total") - F.col("step"), "least_before"))
        .select(
            F.col("floor").alias("severity"),
            "poll_id",
            "reads",
            own("n").alias("new"),
            own("arrived").alias("arrived"),
            own("gone_before").alias("left_before"),
            own("gone").alias("left"),
            F.lag(F.col("gone") - F.col("gone_before"), 1, 0).over(above).alias("stronger"),
        )
    )


def _reach(flow: DataFrame, departures: DataFrame) -> DataFrame:
    """Per severity, the polls in which the cards of some departures arrived, and the arrivals before them.

    At most four rows: ``severity, low, high, first_poll, last_poll, earlier``; the departures are those of lines
    ``low + 1`` to ``high``.
    """
    lines = departures.groupBy("severity").agg(F.min("left_before").alias("low"), F.max("left").alias("high"))
    arrivals = flow.join(lines, "severity").where(
        (F.col("new") > 0) & (F.col("arrived") > F.col("low")) & (F.col("arrived") - F.col("new") < F.col("high"))
    )
    return arrivals.groupBy("severity", "low", "high").agg(
        F.min("poll_id").alias("first_poll"),
        F.max("poll_id").alias("last_poll"),
        F.min(F.col("arrived") - F.col("new")).alias("earlier"),
    )


def queue_replay(
    reads: DataFrame, flow: DataFrame, min_severity: int, *sequence: str, since: int | None = None
) -> DataFrame:
    """The cards that left the queue over a poll history, with ``left_poll`` and ``place``; all columns are kept.

    ``sequence`` identifies a card and orders the cards of a poll. Within a severity
    cards leave in order of arrival, so the r-th arrival is the r-th to leave. Only cards of the polls
    in which the leavers arrived take part in the ranking, a severity's first line follows from the flow, and
    they are written down first so that the sort does not scan all reads twice. With ``since`` only departures of that
    poll and later ones are told, and only their arrivals are looked at.
    Departures are expanded from the flow (never more than capacity per poll) and meet
    the cards by their unique (severity, place in line).
    """
    some = flow.where(F.col("left") > F.col("left_before"))
    some = some if since is None else some.where(F.col("poll_id") >= since)
    departures = some.select(
        "severity",
        F.col("poll_id").alias("left_poll"),
        "stronger",
        "left_before",
        F.explode(F.sequence(F.col("left_before") + 1, F.col("left"))).alias("line"),
    )
    lining_up = cut_lineage(
        reads.where(is_cleared(min_severity))
        .join(F.broadcast(_reach(flow, some)), "severity")
        .where(F.col("poll_id").between(F.col("first_poll"), F.col("last_poll")))
    )
    return (
        ranked(lining_up, ["poll_id", *sequence], keys=["severity"], name="_turn")
        .withColumn("line", F.col("earlier") + F.col("_turn"))
        .join(departures, ["severity", "line"])
        .select(
            *reads.columns,
            "left_poll",
            (F.col("stronger") + F.col("line") - F.col("left_before")).alias("place"),
        )
    )


def leavers(reads: DataFrame, flow: DataFrame, min_severity: int, *sequence: str) -> DataFrame:
    """The cards that left the queue over a poll history, whenever; only polls that left in part are ranked."""
    reach = _reach(flow, flow.where(F.col("left") > F.col("left_before")))
    reach = reach.select("severity", "high", F.col("last_poll").alias("_last"))
    edge = flow.join(reach, "severity").where(F.col("poll_id") == F.col("_last"))
    edge = edge.select("severity", "_last", (F.col("high") - F.col("arrived") + F.col("new")).alias("_most"))
    cards = reads.where(is_cleared(min_severity)).join(F.broadcast(edge), "severity")
    whole = cards.where(F.col("poll_id") < F.col("_last")).select(*reads.columns)
    part = cut_lineage(cards.where(F.col("poll_id") == F.col("_last")))
    part = ranked(part, list(sequence), keys=["severity"], name="_turn").where(F.col("_turn") <= F.col("_most"))
    return whole.unionByName(part.select(*reads.columns))


def since_poll(flow: DataFrame, lines: int) -> int | None:
    """The poll that the newest ``lines`` lines of a log reach back to: a poll has a line, and one for each of its pops."""
    per_poll = flow.groupBy("poll_id").agg((F.sum(F.col("left") - F.col("left_before")) + 1).alias("lines"))
    newest = W.orderBy(F.desc("poll_id"))
    # At most so many polls, as each has a line.
    few = per_poll.orderBy(F.desc("poll_id")).limit(lines).withColumn("later", F.sum("lines").over(newest) - F.col("lines"))
    return few.where(F.col("later") < lines).agg(F.min("poll_id")).head()[0]


def poll_summary(flow: DataFrame, cap: int | None = None, block: int = BLOCK) -> DataFrame:
    """Per poll: cards added, and queue and ledger length right after it, before its pops."""
    polls = flow.groupBy("poll_id").agg(
        F.sum("new").alias("new"),
        F.sum(F.col("arrived") - F.col("left_before")).alias("queued"),
        F.max("reads").alias("reads"),
    )
    first, last = flow.agg(F.min("poll_id"), F.max("poll_id")).head()
    span = 0 if first is None else last - first + 1
    seen = F.col("total") if cap is None else F.least("total", F.lit(cap))
    return scanned(polls, [], "poll_id", "reads", span, block).select("poll_id", "new", "queued", seen.alias("seen"))
