"""The prefix scan, and the queue's flow, against plain loops; windows stay within blocks."""

import random

import pytest
from pyspark.sql import functions as F

from newsdesk.operators import queue
from newsdesk.operators.scan import scanned


@pytest.mark.parametrize("block", [4, 7, 4096])
def test_scan_equals_a_loop(spark, block):
    rng = random.Random(block)
    rows = [(key, at, rng.randint(-5, 4)) for key in ("a", "b") for at in range(-30, 170) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "key string, at bigint, step bigint").repartition(5)
    got = {(r.key, r.at): (r.total, r.least, r.least_before) for r in scanned(df, ["key"], "at", "step", 200, block).collect()}
    wanted = {}
    for key in ("a", "b"):
        total, least = 0, None
        for _, at, step in sorted(r for r in rows if r[0] == key):
            total, before = total + step, least
            least = total if least is None else min(least, total)
            wanted[key, at] = total, least, before
    assert got == wanted


def test_no_window_takes_a_whole_history(spark):
    df = spark.range(1000).withColumn("step", F.col("id") % 3 - 1)
    plan = scanned(df, [], "id", "step", 1000, 10)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line or line.lstrip("+-: ").startswith("Window [")]
    assert windows and sum("_block" not in line for line in windows) <= 3  # the summaries of the uppermost blocks


def simulated(arrivals, capacity):
    """Departures per poll and severity, poll by poll."""
    waiting, out = {s: 0 for s in (1, 2, 3, 4)}, []
    for new in arrivals:
        left, room = {}, capacity
        for s in (4, 3, 2, 1):
            waiting[s] += new[s]
            left[s] = min(room, waiting[s])
            waiting[s] -= left[s]
            room -= left[s]
        out.append(left)
    return out


def test_flow_over_blocks_equals_poll_by_poll(spark):
    rng = random.Random(4)
    counts = [{s: rng.choice([0, 0, 1, 2, 5]) for s in (1, 2, 3, 4)} if rng.random() < 0.8 else None for _ in range(60)]
    counts[0] = counts[-1] = {1: 1, 2: 1, 3: 0, 4: 2}
    rows = [(poll + 100, "financial", s) for poll, new in enumerate(counts) for s, n in (new or {}).items() for _ in range(n)]
    reads = spark.createDataFrame(rows, "poll_id bigint, category string, severity int")
    wanted = simulated([new or {s: 0 for s in (1, 2, 3, 4)} for new in counts], 3)
    for block in (8, 4096):
        flow = queue.queue_flow(reads, 3, 1, block)
        got = {(r.poll_id - 100, r.severity): r.left - r.left_before for r in flow.collect()}
        assert got == {(poll, s): n for poll, left in enumerate(wanted) for s, n in left.items()}
        summary = queue.poll_summary(flow, block=block).orderBy("poll_id").collect()
        assert [r.seen for r in summary][-1] == len(rows) and len(summary) == 60


def test_the_newest_departures_are_those_of_the_whole_replay(spark):
    rng = random.Random(9)
    rows = [(i, i // 6, rng.choice(["financial", "political", "drop"]), rng.randint(1, 4)) for i in range(400)]
    reads = spark.createDataFrame(rows, "event_id bigint, poll_id bigint, category string, severity int")
    flow = queue.queue_flow(reads, 2, 2)
    whole = {tuple(r) for r in queue.queue_replay(reads, flow, 2, "event_id").collect()}
    since = queue.since_poll(flow, 20)
    newest = {tuple(r) for r in queue.queue_replay(reads, flow, 2, "event_id", since=since).collect()}
    assert newest == {r for r in whole if r[4] >= since} and 0 < len(newest) < len(whole)
    lines = sum(1 for r in whole if r[4] >= since) + max(r[1] for r in rows) - since + 1
    assert lines >= 20 > lines - 1 - sum(1 for r in whole if r[4] == since)
    left = {r.event_id for r in queue.leavers(reads, flow, 2, "event_id").collect()}
    assert left == {r[0] for r in whole}
    empty = reads.where("false")
    none = queue.queue_flow(empty, 2, 2)
    assert queue.since_poll(none, 20) is None
    assert queue.queue_replay(empty, none, 2, "event_id").count() == queue.leavers(empty, none, 2, "event_id").count() == 0
