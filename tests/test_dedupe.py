"""First-wins de-duplication, the ledger, and ranks on skewed data."""

import random

import pytest
from pyspark.sql import functions as F

from newsdesk.operators import dedupe
from newsdesk.operators.queue import popped, remaining
from newsdesk.operators.rank import ranked
from newsdesk.sources.ledger import LedgerTable


def item_table(spark, seed, size=400):
    """Random items; a third of all rows share one title."""
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "delta-x", "Éta", "…"]
    rows = []
    for at in range(size):
        hot = rng.random() < 0.34
        title = "Hot story" if hot else " ".join(rng.choices(words, k=rng.randint(0, 3)))
        title += rng.choice(["", " - Src", "  ", "!"])
        rows.append((rng.randint(0, 5), at, title, f"l{at}", "s"))
    rng.shuffle(rows)
    return spark.createDataFrame(
        rows, "feed_ord int, entry_ord bigint, title string, link string, source string"
    ).repartition(7)


def brute_first(rows, key):
    winners = {}
    for row in sorted(rows, key=lambda r: (r.feed_ord, r.entry_ord)):
        winners.setdefault(key(row), row)
    return set(winners.values())


def test_gathered_keeps_the_first_of_each_fingerprint(spark):
    for seed in range(3):
        items = item_table(spark, seed)
        rows = dedupe.with_fingerprint(dedupe.not_blank(items)).collect()
        assert set(dedupe.gathered(items).collect()) == brute_first(rows, lambda r: r.fp)


def test_blank_titles_go_but_punctuation_stays(spark):
    rows = [(0, 0, "", "", ""), (0, 1, " 　\u0085", "", ""), (0, 2, "!!!", "", ""), (0, 3, "?", "", "")]
    items = spark.createDataFrame(rows, "feed_ord int, entry_ord bigint, title string, link string, source string")
    assert [r.title for r in dedupe.gathered(items).collect()] == ["!!!"]


def test_unseen_and_suppressed_split_the_batch(spark):
    batch = dedupe.gathered(item_table(spark, 1))
    ledger = dedupe.seeded(dedupe.gathered(item_table(spark, 2, 60)))
    new, old = dedupe.unseen(batch, ledger), dedupe.suppressed(batch, ledger)
    assert set(new.collect()) | set(old.collect()) == set(batch.collect())
    assert new.join(old, "fp").count() == 0 and old.count() > 0
    assert dedupe.unseen(batch, dedupe.seeded(batch)).count() == 0


def ledger_of(spark, rows):
    return spark.createDataFrame(rows, "fp string, poll_id bigint, feed_ord int, entry_ord bigint")


def test_cap_evicts_by_first_insert(spark):
    inserts = ledger_of(spark, [(fp, 0, 0, at) for at, fp in enumerate("abc")])
    again = ledger_of(spark, [("a", 1, 0, 0), ("d", 1, 0, 1)])
    kept = dedupe.capped(dedupe.upserted(inserts, again), 3).collect()
    assert {r.fp for r in kept} == {"b", "c", "d"}


def test_cap_keeps_the_newest_of_a_large_ledger(spark):
    rows = [(f"f{at}", at // 50, at % 3, at) for at in range(300)]
    newest = sorted(rows, key=lambda r: r[1:])[-120:]
    assert {tuple(r) for r in dedupe.capped(ledger_of(spark, rows), 120).collect()} == set(newest)
    assert dedupe.capped(ledger_of(spark, rows), None).count() == 300


def test_ledger_table_reads_what_earlier_batches_left(spark, tmp_path):
    for cap in (None, 4):
        table = LedgerTable(spark, str(tmp_path / f"ledger-{cap}"), cap)
        assert table.before(0).isEmpty()
        table.insert(ledger_of(spark, [(fp, 0, 0, at) for at, fp in enumerate("abc")]), 0)
        table.insert(ledger_of(spark, [("d", 1, 0, 0), ("e", 1, 0, 1)]), 1)
        table.insert(ledger_of(spark, [("d", 1, 0, 0), ("e", 1, 0, 1)]), 1)
        assert {r.fp for r in table.before(1).collect()} == set("abc")
        assert {r.fp for r in table.before(2).collect()} == (set("abcde") if cap is None else set("bcde"))


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_ranks_are_exact_with_hot_keys(spark, coalesce):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, coalesce)
    try:
        check_ranks(spark, many_partitions=coalesce == "false")
    finally:
        spark.conf.set(name, before)


def check_ranks(spark, many_partitions):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 9)}", rng.randint(1, 4), at) for at in range(3000)]
    df = spark.createDataFrame(rows, "key string, severity int, at bigint").repartition(11)
    order = [F.desc("severity"), "at"]
    if many_partitions:
        assert df.orderBy("key", *order).rdd.getNumPartitions() > 1
    got = {(r.key, r.at): r["rank"] for r in ranked(df, order, ["key"]).collect()}
    for key in {r[0] for r in rows}:
        line = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [got[key, r[2]] for r in line] == list(range(1, len(line) + 1))
    everywhere = {r.at: r["rank"] for r in ranked(df, order).collect()}
    assert [everywhere[r[2]] for r in sorted(rows, key=lambda r: (-r[1], r[2]))] == list(range(1, 3001))


def test_pop_and_remainder(spark):
    queue = spark.createDataFrame([(at, s) for at, s in enumerate([1, 2, 3, 4, 1, 2])], "at int, severity int")
    drained = []
    while not queue.isEmpty():
        front = popped(queue, 1, "at")
        drained += [r.at for r in front.collect()]
        queue = spark.createDataFrame(remaining(queue, front, "at").collect(), queue.schema)
    assert drained == [3, 2, 1, 5, 0, 4]


def test_damaged_ledger_is_an_error_and_a_missing_one_empty(spark, tmp_path):
    assert LedgerTable(spark, str(tmp_path / "none")).before(1).isEmpty()
    table = LedgerTable(spark, str(tmp_path / "ledger"))
    table.insert(ledger_of(spark, [("a", 0, 0, 0)]), 0)
    for file in (tmp_path / "ledger" / "segments").glob("*/*/part-*"):
        file.write_bytes(b"not a table")
    for checksum in (tmp_path / "ledger" / "segments").glob("*/*/.part-*"):
        checksum.unlink()
    with pytest.raises(Exception, match="FAILED_READ_FILE|CANNOT_READ"):
        table.before(1).collect()
