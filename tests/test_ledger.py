"""The segmented ledger against a plain list of inserts."""

import random
import uuid

import numpy as np
import pytest

from newsdesk.operators import dedupe
from newsdesk.sources import ledger as L

ROW = "fp string, poll_id bigint, feed_ord int, entry_ord bigint"


def rows_of(spark, fps, poll_id):
    return spark.createDataFrame([(fp, poll_id, at % 3, at) for at, fp in enumerate(fps)], ROW)


def test_segments_of_one_tier_become_one_of_the_next():
    live = []
    for poll in range(200):
        live = L.merged([*live, L.Segment(poll, 0, 10, [str(poll)])], 4)
        assert all(sum(s.tier == t for s in live) < 4 for t in range(9))
        assert [p for s in live for p in s.parts] == [str(p) for p in range(poll + 1)]
    assert len(live) == 5  # 200 is 3020 to the base of four


def test_eviction_drops_whole_segments_and_cuts_one():
    live = [L.Segment(at, 0, rows, [str(at)]) for at, rows in enumerate((5, 7, 4))]
    kept = L.evicted(live, 9)
    assert [(s.parts, s.rows, s.skipped) for s in kept] == [(["1"], 5, 2), (["2"], 4, 0)]
    assert not L.evicted([L.Segment(0, 0, 3, ["0"])], 0)
    assert L.evicted(live[2:], None) == live[2:]


def test_filters_lose_no_key():
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    bits = np.zeros(L.filter_bits(4000), bool)
    bits[L.probes(keys[:4000], len(bits)).ravel()] = True
    assert bits[L.probes(keys[:4000], len(bits))].all()
    assert bits[L.probes(keys[4000:], len(bits))].all(1).sum() < 10


@pytest.mark.parametrize("cap", [None, 30])
def test_the_ledger_is_the_list_of_inserts(spark, tmp_path, cap):
    rng = random.Random(3)
    table, held = L.LedgerTable(spark, str(tmp_path / "ledger"), cap, buckets=3, fan=2), []
    for poll in range(6):
        fps = [f"s{poll}-{i}" for i in range(rng.randint(0, 20))] if poll != 3 else []
        for _ in range(1 + (poll == 5)):  # a batch that is run again
            table.insert(rows_of(spark, fps, poll), poll)
        held = (held + sorted(fps, key=lambda fp: (int(fp.split("-")[1]) % 3, int(fp.split("-")[1]))))[-(cap or 10**9) :]
        assert table.size(poll + 1) == len(held)
        assert {r.fp for r in table.before(poll + 1).collect()} == set(held)
        asked = rng.sample(held, min(4, len(held))) + ["new 1", "new 2"]
        met = table.met(spark.createDataFrame([(fp,) for fp in asked], "fp string"), poll + 1)
        assert sorted(r.fp for r in met.collect()) == sorted(set(asked) & set(held))
        assert len(table.segments(poll + 1)) <= 4
    live = {p for b in (5, 6) for s in table.segments(b) for p in s.parts}
    assert {f.name for f in (tmp_path / "ledger" / "segments").iterdir() if f.is_dir()} == {f"segment={p}" for p in live}


def test_a_poll_reads_as_many_files_later_as_at_first(spark, tmp_path):
    """Each poll offers the items of the one before it and some new ones; the ledger grows on."""
    table, files = L.LedgerTable(spark, str(tmp_path / "ledger"), buckets=2, fan=3), {}
    for poll in range(14):
        batch = rows_of(spark, [f"{p} {i}" for p in (poll - 1, poll) for i in range(12)], poll)
        files[poll] = table.files_met(batch, poll)
        unseen = dedupe.unseen(batch, table.met(batch, poll))
        assert unseen.count() == (12 if poll else 24)
        table.insert(unseen, poll)
    assert len(files[13]) == len(files[4]) == 2
    assert table.size(14) == 14 * 12 + 12
    assert not table.files_met(rows_of(spark, ["never"], 14), 14)


def test_the_filters_of_a_segment_are_made_once(spark, tmp_path, monkeypatch):
    folder, filters = str(tmp_path), L._filters

    def noted(batches):
        for batch in filters(batches):
            for bucket in batch.column("bucket").to_pylist():
                open(f"{folder}/{bucket}-{uuid.uuid4().hex}.made", "w").close()
            yield batch

    monkeypatch.setattr(L, "_filters", noted)
    table = L.LedgerTable(spark, f"{folder}/ledger")
    rows = spark.range(500).selectExpr("'f' || id as fp", "0L as poll_id", "1 as feed_ord", "id as entry_ord")
    table.insert(rows, 0)
    assert len(list(tmp_path.glob("*.made"))) == table.state(1).count() == L.BUCKETS
    assert table.size(1) == table.before(1).count() == 500
