"""Queue replay and poll summary against a step-by-step simulation."""

import random

import pytest

from newsdesk.operators.queue import poll_summary, queue_flow, queue_replay
from newsdesk.sources.params import Params


def history(seed, polls, size):
    rng = random.Random(seed)
    rows = []
    for at in range(size):
        poll = 3 if rng.random() < 0.33 else rng.choice([p for p in range(polls) if p % 5])
        rows.append((poll, at, rng.choice(["financial", "political", "drop"]), rng.randint(1, 4)))
    return rows


def simulate(rows, capacity, floor):
    queue, left, summary, seen = [], [], {}, 0
    for poll in range(min(r[0] for r in rows), max(r[0] for r in rows) + 1):
        batch = sorted((r for r in rows if r[0] == poll), key=lambda r: r[1])
        cards = [r for r in batch if r[2] != "drop" and r[3] >= floor]
        queue = sorted(queue + cards, key=lambda r: -r[3])
        seen += len(batch)
        summary[poll] = (len(cards), len(queue), seen)
        gone, queue = queue[:capacity], queue[capacity:]
        left += [(r[1], poll, place) for place, r in enumerate(gone, 1)]
    return left, summary, queue


@pytest.mark.parametrize(("seed", "capacity", "floor"), [(1, 1, 2), (2, 3, 1), (3, 5, 2), (4, 40, 3), (5, 2, 4)])
def test_replay(spark, seed, capacity, floor):
    rows = history(seed, 40, 150)
    reads = spark.createDataFrame(rows, "poll_id bigint, at bigint, category string, severity int").repartition(6)
    left, summary, waiting = simulate(rows, capacity, floor)
    flow = queue_flow(reads, capacity, floor)
    replayed = queue_replay(reads, flow, floor, "at").collect()
    assert sorted((r.at, r.left_poll, r.place) for r in replayed) == sorted(left)
    got = {r.poll_id: (r.new, r.queued, r.seen) for r in poll_summary(flow, None).collect()}
    assert got == summary
    assert len({r.at for r in replayed} | {r[1] for r in waiting}) == len(replayed) + len(waiting)


def test_flow_counts_add_up(spark):
    rows = history(9, 30, 200)
    reads = spark.createDataFrame(rows, "poll_id bigint, at bigint, category string, severity int")
    flow = queue_flow(reads, 2, 1).collect()
    assert all(r.left - r.left_before + r.stronger <= 2 for r in flow)
    assert sum(r.new for r in flow) == sum(r[2] != "drop" for r in rows)


def test_capacity_follows_the_ticks():
    assert Params().capacity_per_poll() == 7
    assert Params().poll_seconds() == 630
    assert Params(drip_seconds=600, max_per_drop=3).capacity_per_poll() == 3
    assert Params(poll_minutes=1, drip_seconds=90).capacity_per_poll() == 1
