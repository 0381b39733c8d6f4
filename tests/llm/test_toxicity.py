import random

import numpy as np
from pyspark.sql import functions as F

from mailtriage.llm import toxicity_pu as T
from mailtriage.llm.common import residue
from tests.llm.conftest import ODD


def corpus(n=1500):
    rng, rows, labels = random.Random(5), [], []
    for i in range(n):
        words = [f"plain{rng.randrange(300)}" for _ in range(rng.randint(5, 120))]
        toxic = i % 8 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Vile", "NASTY,", "foul"])
        rows.append((i, " ".join(words)))
        if toxic or i % 3 == 0:
            labels.append((i, int(toxic)))
    return rows, labels


def test_learns_from_positives_and_unlabelled(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = T.fit(docs, marks)
    assert {b"vile", b"nasty", b"foul"} <= set(model.words)
    got = T.with_scores(docs, model).withColumn("held", residue("doc_id", 5) == 0).collect()
    held = [r for r in got if r.held]
    assert sum((r.score >= 0.5) == (r.doc_id % 8 == 0) for r in held) >= 0.98 * len(held)
    for r in random.Random(1).sample(got, 50):
        assert r.score == model.score(r.text.lower().encode())
    kept = T.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() < len(rows)


def test_the_held_out_fold_lends_no_label(spark):
    rows, labels = corpus(600)
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    turned = marks.withColumn("toxic", F.when(residue("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.fit(docs, marks), T.fit(docs, turned)
    assert a.words == b.words and np.array_equal(a.weights, b.weights) and a.prior == b.prior


def test_risk_stays_positive():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 30)) < 0.1).astype(float)
    positive = np.arange(400) < 40
    w = T.fit_nnpu(x, positive, 0.1, 0, steps=300)
    score = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert 0.02 < score[~positive].mean() < 0.4


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(6, 1), (6, 0), (None, 1), (7, None), (99, 1)], "doc_id bigint, toxic int")
    model = T.fit(odd, labels)
    got = T.with_scores(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert T.with_scores(none, T.fit(none, labels.limit(0))).count() == 0
    assert T.drop_toxic(odd, labels.limit(0)).columns == odd.columns
