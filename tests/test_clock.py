"""The due clock: live periods, one-shot runs, quiet retries, crashes."""

import json

import pytest
from test_desk import ITEM, PARAMS, model_reader, reader

from newsdesk.streaming.clock import DueClock
from newsdesk.streaming.desk import Desk


class Time:
    now = 1_000_000

    def __call__(self):
        return self.now


def params(path, **more):
    path.write_text(json.dumps({"webhooks": PARAMS.webhooks, "max_per_drop": 2, "poll_minutes": 10, "drip_seconds": 90, **more}))
    return str(path)


def clock_of(spark, tmp_path, time):
    desk = Desk(spark, str(tmp_path / "state"), model_reader(reader), PARAMS, params_path=str(tmp_path / "params.json"), clock=time)
    return DueClock(desk)


def offer(spark, clock, batch, *titles):
    clock.offer(spark.createDataFrame([(0, n, t, "", "s") for n, t in enumerate(titles)], ITEM), batch)


def done(clock):
    plan = clock.beat()
    return None if plan is None else (plan.polls, plan.drips)


def test_both_periods_change_while_it_runs(spark, tmp_path):
    time = Time()
    params(tmp_path / "params.json")
    clock, ran = clock_of(spark, tmp_path, time), []
    clock.desk.poll, clock.desk.drip = (lambda _, n: ran.append(("poll", n))), (lambda n: ran.append(("drip", n)))
    assert done(clock) == (True, True) and ran == [("poll", 0), ("drip", 0)]
    for seconds, wanted in ((60, None), (89, None), (90, (False, True)), (599, (False, True)), (600, None), (690, (True, True))):
        time.now = 1_000_000 + seconds
        assert done(clock) == wanted, seconds
    params(tmp_path / "params.json", poll_minutes=2, drip_seconds=30)
    for seconds, wanted in ((719, None), (720, (False, True)), (790, (False, True)), (820, (True, True))):
        time.now = 1_000_000 + seconds
        assert done(clock) == wanted, seconds
    assert clock.desk.status().head().drip_seconds == 30
    assert ran[-2:] == [("poll", 2), ("drip", 6)] and clock_of(spark, tmp_path, time).beat().tick_id == 7


def test_failed_reads_are_asked_again_while_nothing_lands(spark, tmp_path):
    time = Time()
    params(tmp_path / "params.json", min_severity=1)
    clock = clock_of(spark, tmp_path, time)
    offer(spark, clock, 0, "seed")
    clock.beat()
    offer(spark, clock, 1, "fail one", "story 1")
    for poll in (1, 2):
        time.now += 600
        assert done(clock) == (True, True)
        asked = [r.title for r in clock.desk.reads_of(poll).collect()]
        assert sorted(asked) == (["fail one", "story 1"] if poll == 1 else ["fail one"])
    offer(spark, clock, 1, "an intake that is run again")
    time.now += 600
    clock.beat()
    assert [r.title for r in clock.desk.reads_of(3).collect()] == ["fail one"]


def test_a_beat_that_crashed_is_finished_by_the_next(spark, tmp_path):
    time = Time()
    params(tmp_path / "params.json", min_severity=1)
    clock = clock_of(spark, tmp_path, time)
    offer(spark, clock, 0, "seed")
    clock.beat()
    offer(spark, clock, 1, "story 1", "story 2")
    time.now += 600
    clock.desk.drip = lambda _: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        clock.beat()
    offer(spark, clock, 2, "story 3")  # lands between the crash and the restart
    time.now += 5
    again = clock_of(spark, tmp_path, time)
    plan = again.beat()
    assert (plan.poll_id, plan.tick_id, plan.upto, plan.polled_unix) == (1, 1, 1, 1_000_600)
    assert sorted(r.title for r in again.desk.reads_of(1).collect()) == ["story 1", "story 2"]
    time.now += 600
    assert again.beat().poll_id == 2
    assert [r.title for r in again.desk.reads_of(2).collect()] == ["story 3"]


def test_once_polls_then_drips(spark, tmp_path):
    params(tmp_path / "params.json", min_severity=1, max_per_drop=50)
    folder, time = tmp_path / "items", Time()

    def land(name, *titles):
        rows = [(0, n, t, "", "s") for n, t in enumerate(titles)]
        spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(str(folder))

    def once():
        clock = clock_of(spark, tmp_path, time)
        clock.once(spark.readStream.schema(ITEM).parquet(str(folder)))
        time.now += 1
        return clock.desk

    land("a", "seed")
    assert once().deliveries.read().isEmpty()
    land("b", *[f"story {n}" for n in range(12)])
    desk = once()
    assert desk.status().head().queued == 0
    left, cards = desk.deliveries.read().count(), desk.cards.read().count()
    assert left == cards > 0
    lines = [r.line for r in desk.recent_log().collect()]
    assert sum(line.startswith("poll: ") for line in lines) == 1 and lines[-1].startswith("seeded 1 ")
    assert lines[left] == f"poll: {cards} new · {cards} queued · 13 seen"


def test_ticks_open_only_polls_with_waiting_cards(spark, tmp_path):
    time = Time()
    params(tmp_path / "params.json", min_severity=1, max_per_drop=50, poll_minutes=1, drip_seconds=1)
    clock = clock_of(spark, tmp_path, time)
    for poll in range(2):
        offer(spark, clock, poll, *[f"story {poll}{n}" for n in range(5)])
        clock.beat()
        time.now += 60
    assert clock.desk.ticks.at(1).head().oldest == 2
    plan = clock.desk.waiting(2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(batch_id#") >= 2 and plan.count(">= 2)]") >= 2  # partition filters of the cards and the polls
    status = clock.desk.status().head()
    deliveries = clock.desk.deliveries.read()
    assert status.queued == 0 and status.posted_financial == deliveries.where("outcome = 'posted' and category = 'financial'").count()
