"""The queue as keyed state with timers: order, pace and restart."""

import json
import time

import pytest

from newsdesk.streaming import channel_queue

CARD = "channel string, severity int, poll_id bigint, at bigint, title string"


@pytest.fixture
def store(spark):
    before = spark.conf.get(channel_queue.STATE_STORE)
    channel_queue.use_state_store(spark)
    yield
    spark.conf.set(channel_queue.STATE_STORE, before)


def land(folder, name, cards):
    staged = folder / f".{name}"
    staged.write_text("\n".join(json.dumps(dict(zip(("channel", "severity", "poll_id", "at", "title"), c))) for c in cards))
    staged.rename(folder / f"{name}.json")


def start(spark, folder, root):
    cards = spark.readStream.schema(CARD).json(str(folder))
    left = channel_queue.drained(cards, "channel", ("poll_id", "at"), 2, 0.2)
    sink = left.writeStream.foreachBatch(lambda rows, batch: rows.write.mode("append").json(str(root / "left")))
    return sink.option("checkpointLocation", str(root / "state")).trigger(processingTime="300 milliseconds").start()


def gone(spark, root):
    if not (root / "left").exists():
        return []
    rows = spark.read.schema(CARD + ", left_ms bigint, place bigint").json(str(root / "left")).collect()
    return sorted(rows, key=lambda r: (r.left_ms, r.channel or "", r.place))


def wait_for(spark, root, query, enough, seconds=120):
    until = time.time() + seconds
    while time.time() < until:
        assert query.exception() is None
        rows = gone(spark, root)
        if len(rows) >= enough:
            return rows
        time.sleep(0.3)
    raise AssertionError(f"{len(gone(spark, root))} of {enough} cards left")


def in_order(cards, channel):
    return [c[4] for c in sorted((c for c in cards if c[0] == channel), key=lambda c: (-min(max(c[1], 1), 4), c[2], c[3]))]


def test_cards_leave_by_severity_then_arrival_and_survive_a_restart(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    first = [(channel, 1 + (i * 7) % 4, i // 5, i, f"{channel}{i}") for i in range(16) for channel in ("money", "policy")]
    land(folder, "first", first[::-1])
    query = start(spark, folder, tmp_path)
    try:
        wait_for(spark, tmp_path, query, 6)
    finally:
        query.stop()
    before = gone(spark, tmp_path)
    for channel in ("money", "policy"):
        left = [r.title for r in before if r.channel == channel]
        assert left == in_order(first, channel)[: len(left)] and len(left) < 16
    late = [("money", 9, 9, 0, "seismic"), ("money", 0, 9, 1, "faint"), (None, 2, 9, 2, "nowhere")]
    land(folder, "late", late)
    query = start(spark, folder, tmp_path)
    try:
        rows = wait_for(spark, tmp_path, query, len(first) + len(late))
    finally:
        query.stop()
    titles = [r.title for r in rows]
    assert sorted(titles) == sorted(c[4] for c in first + late)
    assert [r.title for r in rows if r.channel == "policy"] == in_order(first, "policy")
    money = [r.title for r in rows if r.channel == "money"]
    assert [t for t in money if t != "seismic"] == [*in_order(first, "money"), "faint"]
    assert money.index("seismic") < 15 and [r.title for r in rows if r.channel is None] == ["nowhere"]
    ticks = {}
    for r in rows:
        ticks.setdefault((r.channel, r.left_ms), []).append(r.place)
    assert all(sorted(places) == list(range(1, len(places) + 1)) and len(places) <= 2 for places in ticks.values())
