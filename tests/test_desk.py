"""The streaming desk against a plain simulation of its rules."""

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from newsdesk.functions.text import fingerprint
from newsdesk.sources import catalogue
from newsdesk.sources.items import feed_items, landing_payloads
from newsdesk.sources.params import Params
from newsdesk.streaming.desk import Desk, lexicon_reader, model_reader, once_per_fingerprint


ITEM = "feed_ord int, entry_ord bigint, title string, link string, source string"
PARAMS = Params(webhooks={"financial": "money", "political": "policy"}, max_per_drop=2)


def answer(title):
    """Reply that follows from the title alone; titles with 'fail' cannot be read."""
    if "fail" in title:
        return None
    size = sum(map(ord, title))
    band = ["finance", "politics", "tech", "war", "sport"][size % 5]
    return {"category": band, "read": title.upper(), "severity": size % 6, "confidence": ""}


def reader(prompts):
    # Kept in one function so that workers need no test module.
    replies = []
    for title in prompts.str.split("\nHeadline: ", n=1).str[1]:
        size = sum(map(ord, title))
        band = ["finance", "politics", "tech", "war", "sport"][size % 5]
        fields = f'"category":"{band}","read":"{title.upper()}","severity":{size % 6},"confidence":""'
        replies.append(ValueError("no answer") if "fail" in title else "{" + fields + "}")
    return replies


reader.__module__ = "__main__"
BANDS = dict(finance="financial", politics="political", tech="technology", war="catastrophe", sport="drop")


def random_polls(seed, polls=3, size=25):
    rng = random.Random(seed)
    names = [f"story {n}" for n in range(40)] + ["fail one", "fail two"]
    return [
        [(rng.randint(0, 3), at, rng.choice(names) + rng.choice(["", " - Src", "!"]), f"l{at}", "s") for at in range(size)]
        for _ in range(polls)
    ]


def norm(spark, titles):
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    return {r.t: r.fp for r in df.select("t", fingerprint(F.col("t")).alias("fp")).collect()}


def simulate(spark, polls, ticks_per_poll, per_tick, floor, cap=None):
    """Ledger, popped titles and reads after each poll followed by its ticks."""
    fps = norm(spark, {row[2] for rows in polls for row in rows})
    seen, queue, popped, asked, retry = [], [], [], [], []
    for poll_id, rows in enumerate(polls):
        batch = {}
        for row in sorted(rows + retry, key=lambda r: (r[0], r[1])):
            batch.setdefault(fps[row[2]], row)
        retry, before = [], set(seen)
        for key, row in batch.items():
            if poll_id and key in before:
                continue
            reply = answer(row[2]) if poll_id else None
            if poll_id:
                asked.append(row[2])
            if poll_id and reply is None:
                retry.append(row)
                continue
            seen = [*seen, key]
            if poll_id:
                severity = min(max(reply["severity"], 1), 4)
                if BANDS[reply["category"]] != "drop" and severity >= floor:
                    queue.append((severity, BANDS[reply["category"]], row))
        seen = seen[-(cap or 10**9):]
        queue.sort(key=lambda c: -c[0])
        for _ in range(ticks_per_poll):
            popped += [(c[2][2], c[1]) for c in queue[:per_tick]]
            queue = queue[per_tick:]
    return seen, popped, asked, queue


def run(spark, root, polls, ticks_per_poll=1, params=PARAMS, **options):
    desk = Desk(spark, str(root), model_reader(reader), params, clock=lambda: 1000, **options)
    tick = 0
    for poll_id, rows in enumerate(polls):
        desk.poll(spark.createDataFrame(rows, ITEM), poll_id)
        for _ in range(ticks_per_poll):
            desk.drip(tick)
            tick += 1
    return desk


def popped_titles(desk):
    rows = desk.deliveries.read().orderBy("batch_id", "place").collect()
    return [(r.title, r.category) for r in rows]


@pytest.mark.parametrize(("cap", "seed"), [(None, 7), (12, 8)])
def test_desk_follows_the_rules(spark, tmp_path, cap, seed):
    polls = random_polls(seed)
    desk = run(spark, tmp_path, polls, cap=cap)
    seen, popped, asked, waiting = simulate(spark, polls, 1, PARAMS.max_per_drop, PARAMS.min_severity, cap)
    assert popped_titles(desk) == popped
    assert {r.fp for r in desk.ledger.before(len(polls)).collect()} == set(seen)
    reads = [r.title for p in range(len(polls)) for r in desk.reads_of(p).collect()]
    assert sorted(reads) == sorted(asked)
    assert sorted(r.title for r in desk.waiting(len(polls)).collect()) == sorted(c[2][2] for c in waiting)
    status = desk.status().head()
    assert (status.seen, status.queued, status.feeds) == (len(seen), len(waiting), 34)
    outcomes = {r.outcome: r["count"] for r in desk.deliveries.read().groupBy("outcome").count().collect()}
    routed = sum(band in PARAMS.webhooks for _, band in popped)
    assert outcomes.get("posted", 0) == routed and outcomes.get("held", 0) == len(popped) - routed
    assert status.posted_financial + status.posted_political == routed
    assert status.posted_technology == status.posted_catastrophe == 0
    assert desk.snapshots.at(len(polls) - 1).head() == status


def test_second_poll_of_the_same_items_adds_nothing(spark, tmp_path):
    rows = [r for r in random_polls(3, 1)[0] if "fail" not in r[2]]
    desk = run(spark, tmp_path, [rows, rows], 1)
    assert desk.reads_of(1).isEmpty() and desk.deliveries.read().isEmpty()
    lines = [r.line for r in desk.recent_log().collect()]
    seen = desk.ledger.before(2).count()
    assert lines == [f"poll: 0 new · 0 queued · {seen} seen", f"seeded {seen} headlines (posted nothing)"]


def test_failed_reads_come_back_until_they_succeed(spark, tmp_path):
    rows = [(0, 0, "fail one", "", "s")]
    desk = run(spark, tmp_path, [[(0, 9, "seed", "", "s")], rows, [(1, 0, "story 1", "", "s")]], 0)
    for poll in (1, 2):
        failures = desk.reads_of(poll).where("error is not null").collect()
        assert [(r.title, r.error) for r in failures] == [("fail one", "no answer")]
    assert "fail one" not in {r.fp for r in desk.ledger.before(3).collect()}


def test_rerun_of_a_batch_changes_nothing_and_reads_nothing_twice(spark, tmp_path):
    polls = random_polls(11)
    desk = run(spark, tmp_path / "a", polls)
    wanted = popped_titles(desk)

    def forbidden(items):
        raise AssertionError("read twice")

    again = Desk(spark, str(tmp_path / "a"), forbidden, PARAMS)
    again.poll(spark.createDataFrame(polls[-1], ITEM), len(polls) - 1)
    again.drip(len(polls) - 1)
    assert popped_titles(again) == wanted

    # A crash after the reads were written: the rest of the poll runs again.
    crashed = Desk(spark, str(tmp_path / "b"), model_reader(reader), PARAMS)
    crashed.poll(spark.createDataFrame(polls[0], ITEM), 0)
    crashed._finish_poll = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        crashed.poll(spark.createDataFrame(polls[1], ITEM), 1)
    assert crashed.waiting(0).isEmpty()
    resumed = Desk(spark, str(tmp_path / "b"), forbidden, PARAMS)
    resumed.poll(spark.createDataFrame(polls[1], ITEM), 1)
    _, popped, _, waiting = simulate(spark, polls[:2], 0, 1, PARAMS.min_severity)
    assert sorted(r.title for r in resumed.waiting(0).collect()) == sorted(c[2][2] for c in waiting)


@pytest.mark.parametrize("table", ["popped", "deliveries", "drained", "tick_log", "ticks"])
def test_a_retried_tick_delivers_the_same_cards_once(spark, tmp_path, table):
    """A crash after each write, and a stronger card that arrives before the retry."""
    titles = [t for t in (f"story {n}" for n in range(80)) if answer(t)["category"] != "sport"]
    strong = max(titles, key=lambda t: answer(t)["severity"])
    weak = [t for t in titles if 2 <= answer(t)["severity"] < answer(strong)["severity"]][:4]
    polls = [[(9, 0, "seed", "", "s")], [(0, n, t, "", "s") for n, t in enumerate(weak)]]
    desk = run(spark, tmp_path, polls, 0)
    write = getattr(desk, table).write

    def then_crash(rows, batch_id):
        write(rows, batch_id)
        if table in ("popped", "deliveries"):
            getattr(desk, f"{table}_done").write(spark.range(1).selectExpr("id as rows"), batch_id)
        raise RuntimeError("lost")

    getattr(desk, table).write = then_crash
    with pytest.raises(RuntimeError):
        desk.drip(0)
    first = [r.title for r in desk.popped.at(0).collect()]
    again = Desk(spark, str(tmp_path), model_reader(reader), PARAMS)
    again.poll(spark.createDataFrame([(0, 99, strong, "", "s")], ITEM), 2)
    again.drip(0)
    again.drip(1)
    rows = again.deliveries.read().collect()
    assert [r.title for r in rows if r.batch_id == 0] == first and strong in {r.title for r in rows if r.batch_id == 1}
    assert all('"embeds"' in r.payload for r in rows) and again.snapshots.has(0)


def test_cards_that_share_a_position_all_leave(spark, tmp_path):
    # Two payloads of one feed landed in the same poll.
    titles = [t for t in (f"story {n}" for n in range(60)) if answer(t)["category"] != "sport"][:7]
    rows = [(0, 0, title, "", "s") for title in titles]
    desk = run(spark, tmp_path, [[(9, 0, "seed", "", "s")], rows], 0)
    waiting = desk.waiting(0).count()
    for tick in range(4):
        desk.drip(tick)
    assert len(popped_titles(desk)) == len(set(popped_titles(desk))) == waiting > 2


def test_dry_run_pops_without_posting(spark, tmp_path):
    polls = random_polls(13)
    dry = run(spark, tmp_path, polls, dry=True, poster=lambda *_: 1 / 0)
    plain = simulate(spark, polls, 1, PARAMS.max_per_drop, PARAMS.min_severity)[1]
    assert popped_titles(dry) == plain != []
    rows = dry.deliveries.read().collect()
    assert {r.outcome for r in rows} == {"dry"} and all(r.line.startswith("[dry] ") for r in rows)
    assert dry.status().head().posted_financial == 0


def test_failed_posts_leave_the_queue(spark, tmp_path):
    def poster(channels, payloads):
        return ["status 500 — busy" if "money" == c else None for c in channels]

    poster.__module__ = "__main__"
    polls = [[(9, 0, "seed", "", "s")], [(0, n, f"story {n}", "", "s") for n in range(100, 130)]]
    desk = run(spark, tmp_path, polls, params=replace(PARAMS, max_per_drop=50), poster=poster)
    plain = simulate(spark, polls, 1, 50, PARAMS.min_severity)[1]
    assert popped_titles(desk) == plain
    rows = desk.deliveries.read().collect()
    assert {(r.channel, r.outcome) for r in rows} <= {("money", "failed"), ("policy", "posted"), (None, "held")}
    assert any(r.line == "post FAILED FINANCE — status 500 — busy" for r in rows)


def test_parameters_are_reread_before_each_cycle(spark, tmp_path):
    path = tmp_path / "params.json"
    document = {"webhooks": {}, "min_severity": 9}
    path.write_text(json.dumps(document))
    desk = Desk(spark, str(tmp_path / "state"), model_reader(reader), PARAMS, params_path=str(path))
    polls = random_polls(19, 3)
    desk.poll(spark.createDataFrame(polls[0], ITEM), 0)
    desk.poll(spark.createDataFrame(polls[1], ITEM), 1)
    assert desk.cards.at(1).isEmpty()
    path.write_text(json.dumps({**document, "min_severity": 1}))
    desk.poll(spark.createDataFrame(polls[2], ITEM), 2)
    assert not desk.cards.at(2).isEmpty()
    path.write_text("{broken")
    desk.refresh_params()
    assert desk.params.min_severity == 1


def payload(titles, atom=False):
    if atom:
        entries = "".join(f"<entry><title>{t}</title><link href='http://{n}'/></entry>" for n, t in enumerate(titles))
        return f'<feed xmlns="http://www.w3.org/2005/Atom">{entries}</feed>'
    return "<rss><channel>" + "".join(f"<item><title>{t}</title></item>" for t in titles) + "</channel></rss>"


def land(folder, poll, feed, body):
    target = folder / f"feed_ord={feed}"
    target.mkdir(parents=True, exist_ok=True)
    (target / f"{poll}.xml").write_text(body)


def test_stream_of_landed_payloads_stops_and_resumes(spark, tmp_path):
    landing, root = tmp_path / "landing", tmp_path / "state"
    lexicon = {"financial": ("gold",), "catastrophe": ("flood", "state of emergency")}
    params = Params(webhooks={"financial": "money"}, min_severity=1)

    def one_shot():
        desk = Desk(spark, str(root), lexicon_reader(lexicon), params, clock=lambda: 1)
        items = feed_items(landing_payloads(spark, str(landing)), catalogue.feeds(spark))
        query = desk.start_polls(items, once=True)
        query.awaitTermination(120)
        assert query.exception() is None
        return desk

    land(landing, 0, 0, payload(["Gold up - DJ", "Old news"]))
    land(landing, 0, 16, payload(["Flood in town"], atom=True))
    assert one_shot().cards.read().isEmpty()
    land(landing, 1, 0, payload(["GOLD UP!", "Gold and flood", "Sport"]))
    land(landing, 1, 16, payload(["Flood: state of emergency declared", "Gold and flood - BBC"], atom=True))
    land(landing, 1, 20, "<rss><channel><item>")
    desk = one_shot()
    rows = desk.reads_of(1).orderBy("feed_ord", "entry_ord").collect()
    assert [(r.title, r.source, r.category, r.severity) for r in rows] == [
        ("Gold and flood", "DJ Markets", "financial", 1),
        ("Sport", "DJ Markets", "drop", 1),
        ("Flood: state of emergency declared", "BBC World", "catastrophe", 2),
    ]
    desk.drip(0)
    desk.drip(1)
    assert [t for t, _ in popped_titles(desk)] == ["Flood: state of emergency declared", "Gold and flood"]
    land(landing, 2, 1, payload(["Gold up again"]))
    desk = one_shot()
    assert [r.title for r in desk.reads_of(2).collect()] == ["Gold up again"]
    assert desk.status().head().seen == 7


def test_drips_run_on_a_clock(spark, tmp_path):
    polls = random_polls(23, 2)
    desk = Desk(spark, str(tmp_path), model_reader(reader), PARAMS)
    for poll_id, rows in enumerate(polls):
        desk.poll(spark.createDataFrame(rows, ITEM), poll_id)
    waiting = desk.waiting(0).count()
    query = desk.start_drips(seconds=1)
    try:
        for _ in range(60):
            if desk.ticks.read().agg(F.sum("popped")).head()[0] == waiting:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    _, popped, _, _ = simulate(spark, polls, 40, PARAMS.max_per_drop, PARAMS.min_severity)
    assert popped_titles(desk) == popped


@pytest.mark.parametrize("horizon", [None, "1 hour"])
def test_state_store_form_passes_each_fingerprint_once(spark, tmp_path, horizon):
    rows = random_polls(29, 1, 60)[0]
    items = spark.createDataFrame(rows, ITEM).withColumn("ts", F.timestamp_seconds(F.col("entry_ord") + 1_700_000_000))
    items.repartition(3).write.parquet(str(tmp_path / "items"))
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "items"))
    query = (
        once_per_fingerprint(stream, horizon and "ts", horizon).writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert query.exception() is None
    got = [r.fp for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(set(norm(spark, {r[2] for r in rows}).values()))
