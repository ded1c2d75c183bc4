"""Ranked lexical search against scores of all documents."""

import collections
import math
import re

import duckdb
import pytest

from newsdesk.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, most):
    """The best scores of each item with the ids they can have, from every document's sum."""
    counts = [(doc_id, collections.Counter(terms(text))) for doc_id, text in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_words = len(counts), sum(n for _, _, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c, n in counts:
            m = 100 - 25 + (25 * n * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0 and doc_id is not None:
                scores.append((-score, doc_id))
        out += [(item_id, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def asked(spark, odd):
    texts = ["one TWO", None, "", "la la idiot you", "nothing of this", " ".join(r["text"] or "" for r in odd.collect())[:9000], "one two"]
    return spark.createDataFrame([(i if i != 4 else None, t, "x") for i, t in enumerate(texts)], "item_id long, text string, score string")


@pytest.mark.parametrize("most", [1, 3, 20])
def test_odd_rows(odd, asked, most, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 2)
    wanted = expected([(r["doc_id"], r["text"]) for r in odd.collect()], [(r["item_id"], r["text"]) for r in asked.collect()], most)
    assert wanted and rows(lexical_search.search(odd, asked, most)) == wanted


def test_empty_tables(spark, odd, nothing, asked):
    none = spark.createDataFrame([], "item_id long, text string")
    for docs, items in ((nothing, asked), (odd, none), (nothing, none), (odd.where("text is null"), asked)):
        assert lexical_search.search(docs, items).count() == 0


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    base = duckdb.connect()
    for name in ("documents", "benchmark"):
        base.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    assert rows(lexical_search.op13_lexical_search(spark, folder)) == sorted(base.sql(lexical_search.ORACLE).fetchall(), key=str)


def test_pruned_sums_are_those_of_all_documents(spark, given):
    """Many documents a shard, so that bundles drop documents between owners."""
    docs = given.select("doc_id", "text").coalesce(1)
    items = given.where("doc_id % 25 = 0").selectExpr("doc_id as item_id", "substr(text, 1, 300) as text")
    wanted = expected([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], 4)
    assert rows(lexical_search.search(docs, items, 4)) == wanted
