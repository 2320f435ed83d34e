import math

import numpy as np
import pytest

from spanwright.llm import toxicity


def sentences(rule, seed=0, n=3000):
    rng = np.random.default_rng(seed)
    filler = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    texts, labels = [], []
    for _ in range(n):
        a, b = map(int, rng.random(2) < 0.5)
        texts.append(" ".join([*rng.choice(filler, 20), *["clownish"] * a, *["groupies"] * b]))
        labels.append(int(rule(a, b)))
    return texts, labels


def slow_score(model, text):
    """Weights and all pairs, one by one."""
    place = {int(h): k for k, h in enumerate(model.terms)}
    own = sorted({place[h] for w in toxicity.words(text or "") for h in toxicity.term_hashes(w) if h in place})
    z = model.bias + sum(model.weights[i] for i in own)
    z += sum(float(model.factors[i] @ model.factors[j]) for i in own for j in own if i < j)
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def additive_accuracy(texts, labels):
    """Of the best logistic model with weights alone, by Newton's method over the two words."""
    x = np.array([[1, "clownish" in t, "groupies" in t] for t in texts], float)
    y, w = np.array(labels, float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(3), x.T @ (y - p))
    return ((x @ w > 0) == (y > 0.5)).mean()


@pytest.mark.parametrize("rule", [lambda a, b: a and b, lambda a, b: a ^ b], ids=["and", "xor"])
def test_learns_an_interaction(spark, rule):
    texts, labels = sentences(rule)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tags = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic long")
    model = toxicity.fit_on(docs, tags)
    more, wanted = sentences(rule, 1, 500)
    got = np.array([slow_score(model, t) > 0.5 for t in more])
    assert (got == np.array(wanted, bool)).mean() > 0.97
    if rule(1, 1) == 0:
        assert additive_accuracy(texts, labels) < 0.65
    assert np.abs(model.factors).max() > 0.1


def test_scores_equal_brute_force(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit_on(docs, labels)
    got = toxicity.score(odd, model, "doc_id", "text").collect()
    assert len(got) == odd.count()
    assert all(abs(r.score - slow_score(model, r.text)) < 1e-9 for r in got)
    some = toxicity.score(docs.limit(100), model, "text").collect()
    assert all(abs(r.score - slow_score(model, r.text)) < 1e-9 for r in some) and len({r.score for r in some}) > 20
    assert toxicity.score(nothing, model, "doc_id").count() == 0


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = toxicity.op3(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").toPandas()
    assert (found.predicted == found.toxic).mean() > 0.93
    assert found.score.between(0, 1).all()


def test_stage_on_odd_rows(spark, odd):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = toxicity.toxicity_stage(odd, labels)
    assert kept.dtypes == odd.dtypes and kept.count() <= odd.count()
    assert toxicity.toxicity_stage(odd, labels.limit(0)).count() == odd.count()
