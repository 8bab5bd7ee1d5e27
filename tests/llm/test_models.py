"""Operators 1 and 8: held-out accuracy and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality, toxicity
from tessella.llm.common import held_out, table

SF = "/root/testdata/sf0.1"
ODD = [(None, None), (1, ""), (1, ""), (2, " \n\t "), (3, "a" * 300_000), (4, "word " * 60_000), (5, "é\u0000x")]


@pytest.fixture(scope="module")
def data(spark):
    return table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")


def _held_out(scored, labels, label):
    rows = scored.join(labels, "doc_id").filter(held_out("doc_id")).select("score", label).toPandas()
    return rows["score"].to_numpy(), rows[label].to_numpy()


def test_quality_on_the_held_out_fold(spark, data):
    docs, labels = data
    model = quality.fit(docs, labels)
    score, y = _held_out(quality.score(docs, model), labels, "quality")
    assert ((score >= quality.THRESHOLD) == y).mean() > 0.97
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = quality.score(odd, model)
    assert got.columns == ["doc_id", "text", "score"]
    rows = got.collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert rows[1].score == rows[2].score == rows[0].score
    assert quality.score(odd.limit(0), model).count() == 0


def test_toxicity_on_the_held_out_fold(spark, data):
    docs, labels = data
    model = toxicity.fit(docs, labels)
    score, y = _held_out(toxicity.score(docs, model), labels, "toxic")
    assert (score[y == 1] >= 0.5).mean() > 0.8 and (score[y == 0] >= 0.5).mean() < 0.05
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash"))
    assert toxicity.score(odd, model).columns == ["doc_id", "text", "score"] and toxicity.score(odd.limit(0), model).count() == 0
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)


def test_without_labels(spark, data):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()] == pytest.approx([quality.THRESHOLD] * len(ODD))
    assert len({r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}) == 1


def test_rows_that_repeat_an_id_count_once(spark, data):
    docs, labels = data
    some = docs.join(labels.select("doc_id"), "doc_id").limit(60)
    again = some.union(some).union(some.withColumn("text", F.concat(F.lit("other words before "), "text")))
    models = [quality.fit(d, labels) for d in (again, again.repartition(3))]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].threshold == models[1].threshold
    one, two = (toxicity.fit(d, labels) for d in (again, again.repartition(3)))
    assert np.array_equal(one.keys, two.keys) and one.bias == pytest.approx(two.bias)


def test_a_long_text_has_the_same_features_in_parts(monkeypatch):
    text = b" ".join(b"Word%d!" % (i % 997) + b"\n" * (i % 7 == 0) for i in range(9000)) + " é the the".encode()
    whole = quality.features([text])
    monkeypatch.setattr(quality.tb, "SLICE", 5000)
    assert np.allclose(quality.features([text]), whole)


def test_nnpu_beats_positive_against_unlabelled():
    rng = np.random.default_rng(0)
    positive = [np.array([0, *rng.integers(2, 50, 3)]) for _ in range(200)]
    unlabelled = [np.array([int(rng.random() > 0.3), *rng.integers(2, 50, 3)]) for _ in range(1000)]
    w, bias = toxicity.fit_nnpu(positive, unlabelled, 50, 0.3)
    assert w[0] + bias > 0 > w[1] + bias


def test_pairs_rank_by_the_feature_that_decides():
    x = np.random.default_rng(1).normal(size=(500, 3))
    w = quality.fit_pairs(x, x[:, 1] > 0)
    assert w[1] > 5 * max(abs(w[0]), abs(w[2]))


def test_features_do_not_depend_on_the_slice():
    texts = [b"one two three", b"", b"x" * 5000, "é ü".encode(), b"a b a b a b"]
    whole = quality.features(texts)
    assert np.allclose(whole, np.concatenate([quality.features([t]) for t in texts]))
    h, n = toxicity.features(texts)
    assert n.tolist() == [len(toxicity.features([t])[0]) for t in texts]
