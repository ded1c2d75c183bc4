"""Parameter documents."""

import json

import pytest

from newsdesk.sources.params import Params, load_params, parsed_documents, reload_params, save_tuning, tuning_view

GOOD = {"webhooks": {"financial": "u1", "political": "u2"}, "min_severity": 3, "note": [1]}


def test_documents_are_strict_and_defaulted(spark):
    bad = [
        "{}", "nope", '{"webhooks":null}', '{"webhooks":{"a":1}}', '{"webhooks":{},"poll_minutes":"5"}',
        '{"webhooks":{},"poll_minutes":null}', '{"webhooks":{},"poll_minutes":-1}',
        '{"webhooks":{},"min_severity":256}', '{"webhooks":{},"drip_seconds":1.5}', '{"webhooks":{},"model":3}',
    ]
    rows = [(0, json.dumps(GOOD)), (1, '{"webhooks":{}}'), *enumerate(bad, 2)]
    documents = spark.createDataFrame(rows, "id int, document string")
    got = {r.id: r for r in parsed_documents(documents).collect()}
    assert set(got) == {0, 1}
    assert got[0].webhooks == GOOD["webhooks"] and got[0].min_severity == 3
    assert (got[1].min_severity, got[1].poll_minutes, got[1].drip_seconds, got[1].max_per_drop) == (2, 10, 90, 1)
    assert (got[1].model, got[1].seen_path) == ("llama3.1:8b", "data/seen.json")
    for text in bad:
        with pytest.raises((ValueError, TypeError)):
            Params.from_json(text)


def test_tuning_view_tolerates_anything(spark):
    rows = [(0, json.dumps(GOOD)), (1, "nope"), (2, '{"webhooks":7,"poll_minutes":"5","drip_seconds":30}')]
    shown = tuning_view(spark.createDataFrame(rows, "id int, document string")).collect()
    assert [tuple(r) for r in shown] == [
        (0, 3, 10, 90, ["financial", "political"]), (1, 2, 10, 90, []), (2, 2, 10, 30, []),
    ]


def test_clamps(spark, tmp_path):
    path = tmp_path / "params.json"
    path.write_text(json.dumps(GOOD))
    for asked, wanted in (((0, 0, 1), (1, 1, 5)), ((9, 7, 60), (4, 7, 60))):
        save_tuning(spark, str(path), *asked)
        saved = load_params(spark, str(path))
        assert (saved.min_severity, saved.poll_minutes, saved.drip_seconds) == wanted
        assert saved.webhooks == GOOD["webhooks"]
        assert json.loads(spark.read.text(str(path), wholetext=True).head()[0])["note"] == [1]


def test_reload_keeps_the_old_parameters(spark, tmp_path):
    path = tmp_path / "params.json"
    path.write_text(json.dumps(GOOD))
    current = load_params(spark, str(path))
    path.write_text("{broken")
    assert reload_params(spark, str(path), current) == current
    assert reload_params(spark, str(tmp_path / "none.json"), current) == current
    routes = {tuple(r) for r in current.routes(spark).collect()}
    assert routes == {("financial", "u1"), ("political", "u2")}
    assert Params().routes(spark).count() == 0
