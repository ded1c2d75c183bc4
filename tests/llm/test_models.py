"""The trained classifiers: held-out accuracy, folds, odd input."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from newsdesk.llm import labelled, quality, toxicity
from newsdesk.llm.toxicity import label_model

DATA = "/root/testdata/sf0.1"


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.mark.parametrize("query,label,least", [(toxicity.op7_toxicity, "toxic", 0.96), (quality.op10_quality, "quality", 0.98)])
def test_held_out_accuracy(spark, labels, query, label, least):
    rows = query(spark, DATA)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    found = rows.join(labels, "doc_id", "left").toPandas()
    assert len(found) == 10_000 and found.score.between(0, 1).all()
    assert (found.held_out == found.doc_id.map(held)).all()
    threshold = toxicity.THRESHOLD if label == "toxic" else quality.THRESHOLD
    assert (found.predicted == (found.score >= threshold)).all()
    test = found[found.held_out & found[label].notna()]
    truth = test[label] == 1
    rank = test.score.rank()
    auc = (rank[truth].sum() - truth.sum() * (truth.sum() + 1) / 2) / (truth.sum() * (~truth).sum())
    assert auc > least
    assert ((test.predicted == 1) == truth).mean() > least
    wrongly = ((test.predicted == 1) != truth)[~truth if label == "toxic" else truth].mean()
    assert wrongly < 0.01  # clean documents are left alone


def test_labels_of_the_held_out_fold_are_never_read(spark, given, labels):
    some = labels.limit(0).union(spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(200)], labels.schema))
    lied = some.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) as toxic")
    for module in (toxicity, quality):
        a, b = module.fit(given, some), module.fit(given, lied)
        assert np.array_equal(a.weights, b.weights)


def test_a_label_is_outvoted():
    """A clean row labelled toxic by mistake, and a toxic one labelled clean, among many that fit."""
    rng = np.random.default_rng(1)
    truth = rng.random(600) < 0.3
    votes = np.stack([truth & (rng.random(600) < 0.9) for _ in range(6)] + [~truth], axis=1).astype(float)
    labels = truth.astype(int)
    labels[:4] = 1 - labels[:4]
    assert ((label_model(votes, labels) > 0.5) == truth).all()


def test_voters_that_copy_each_other_share_their_weight():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.5
    good = [np.where(rng.random(4000) < 0.8, truth, ~truth) for _ in range(3)]
    poor = np.where(rng.random(4000) < 0.65, truth, ~truth)
    votes = np.stack([*good, *[poor] * 8], axis=1).astype(float)
    labels = np.where(rng.random(4000) < 0.7, truth, ~truth).astype(int)
    majority = (votes.mean(1) > 0.5) == truth
    assert ((label_model(votes, labels) > 0.5) == truth).mean() > majority.mean() + 0.02


def test_class_prior_is_near_the_true_share():
    rng = np.random.default_rng(3)
    p = rng.normal(3, 1, 8000)
    u = np.concatenate([rng.normal(3, 1, 7000), rng.normal(-3, 1, 3000)])
    assert abs(quality.class_prior(p, u) - 0.7) < 0.05


def test_the_risk_of_negatives_is_not_driven_below_zero():
    x = quality._sparse(np.zeros((10, 1), int), 1)
    gradient = quality.risk_gradient(x, x, 0.99, 0.0)
    raised = gradient(np.array([5.0, 5.0]))
    w = np.array([-5.0, -5.0])
    assert raised[-1] > 0 and np.isfinite(gradient(w)).all()


def test_odd_rows_and_empty_tables(spark, odd, nothing, labels):
    for module, empty in ((toxicity, 0.0), (quality, 0.5)):
        without = module.fit(odd, labels.limit(0))
        assert {r["score"] for r in module.scored(odd, without).collect()} == {empty}
        model = module.fit(spark.read.parquet(f"{DATA}/documents.parquet"), labels)
        rows = module.scored(odd, model).collect()
        assert len(rows) == odd.count() and len({r["score"] for r in rows if not r["text"]}) == 1
        by_text = {}
        for r in rows:
            assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
        kept = module.kept(odd, model)
        assert kept.columns == odd.columns and kept.count() <= odd.count()
        assert module.scored(nothing, model).count() == 0 and module.kept(nothing, model).count() == 0
    toxic = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0))
    assert toxic.score(pa.array(["", None])).tolist() == [0, 0]


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns and docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == before < 1000
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert docs.where("n_chars <> length(text)").count() == 0


def test_stages_take_odd_rows(spark, nothing):
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, least long, score string, whole binary"
    rows = [(None, None, None, None, None, None, "x", None), (1, "", "en", "s", 0, 5, None, None), (1, "", "en", "s", 0, 5, None, None), (2, "idiot " * 50, "en", "s", 300, 5, "y", b"z")]
    odd = spark.createDataFrame(rows, schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_an_id_of_very_many_rows_is_one_training_row(spark, labels, given):
    """The bound on training rows is one of rows, whatever a labelled or drawn id repeats."""
    known = [i for i in range(3000) if not held(i)]
    some = spark.createDataFrame([(i, n % 2, n % 2) for n, i in enumerate(known[:200])], "doc_id long, quality int, toxic int")
    hot = spark.range(50_000).selectExpr(f"{known[1]}L as doc_id", "concat('hot text ', id % 7) as text")
    docs = given.select("doc_id", "text").where("doc_id < 150").union(hot)
    rows = labelled.training_rows(docs, some, "toxic", 40)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    assert sizes and max(sizes.values()) <= 40
    assert rows.groupBy("doc_id").count().where("count > 1").count() == 0
    unlabelled = labelled.one_of_each_id(docs, "doc_id")
    assert unlabelled.count() == docs.select("doc_id").distinct().count()
    assert unlabelled.where(f"doc_id = {known[1]}").head().text <= "hot text 0"
