"""Every registered query against its SQL restatement on the smallest given tables."""

import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from newsdesk.plans.oracle import ORACLE
from newsdesk.plans.queries import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="given tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_oracle(spark, duck, name):
    result = QUERIES[name](spark, str(FOLDER))
    columns = sorted(result.columns)
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    wanted_types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: TYPES[t] for c, t in result.dtypes} == wanted_types
    quoted = ", ".join(f'"{c}"' for c in columns)
    wanted = duck.execute(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall()
    got = [tuple(row[c] for c in columns) for row in result.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))


# Joins that pair every row with every other, and row-at-a-time or per-batch Python.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
READERS = {"reader_replies"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan_stays_distributed_and_in_the_jvm(spark, name):
    plan = executed_plan(QUERIES[name](spark, str(FOLDER)))
    assert not [operator for operator in UNWANTED if operator in plan]
    assert ("MapInPandas" in plan) == (name in READERS)


def executed_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("sweep_recent", {"event_id", "event_type", "ts"}),
        ("severity_meter", {"event_id", "props"}),
        ("fingerprint_docs", {"doc_id", "text", "source"}),
        ("route_cards", {"event_id", "event_type", "props"}),
        ("page_items", {"page_id", "url", "html"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    plan = executed_plan(QUERIES[name](spark, str(FOLDER)))
    read = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert {field.split(":")[0] for schema in read for field in schema.split(",")} == columns


def test_duplicates_are_combined_before_the_shuffle(spark):
    plan = executed_plan(entry.queries()["batch_dedupe"](spark, str(FOLDER)))
    before_shuffle = plan.split("Exchange")[-1]
    assert "partial_min" in before_shuffle and plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["unseen_items", "suppressed_items", "ledger_upsert"])
def test_fingerprints_are_computed_once_per_table(spark, name):
    plan = executed_plan(QUERIES[name](spark, str(FOLDER)))
    filters = [line for line in plan.splitlines() if "Filter" in line.split("(")[0]]
    assert filters and not any("regexp_replace" in line for line in filters)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_a_reader_that_raises_fails_one_item():
    from newsdesk.operators.reads import _answers

    def reader(prompts):
        if (prompts == "bad").any():
            raise ValueError("no")
        return [p.upper() for p in prompts]

    found = _answers(reader, pd.Series(["a", "bad", "b"]))
    assert found[0] == "A" and isinstance(found[1], ValueError) and found[2] == "B"
    assert _answers(reader, pd.Series([], dtype=object)) == []
