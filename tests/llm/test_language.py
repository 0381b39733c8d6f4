import random

import numpy as np
import pytest

from mailtriage.llm import crf_language as C
from mailtriage.llm.common import residue
from tests.llm.conftest import ODD

WORDS = {"aa": ["lomba", "lombu", "rako", "miko", "tero"], "bb": ["schtik", "schwen", "grulz", "plitz", "krunz"], "cc": ["ñélo", "éñila", "çalé", "véña", "lçéo"]}


def brute(e, a):
    n, k = e.shape
    total, at = 0, np.zeros((n, k))
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    alpha[0] = e[0]
    for i in range(1, n):
        alpha[i] = (alpha[i - 1] @ a) * e[i]
    for i in range(n - 2, -1, -1):
        beta[i] = a @ (e[i + 1] * beta[i + 1])
    p = alpha * beta
    return p / p.sum(axis=1)[:, None]


@pytest.mark.parametrize("sizes", [[1], [5], [1, 1, 1], [40, 3, 100, 1, 7]])
def test_lanes_equal_each_text_alone(sizes):
    rng = np.random.default_rng(len(sizes))
    e, a = rng.random((sum(sizes), 3)) + 0.01, rng.random((3, 3))
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    got, pairs = C.forward_backward(e, first, a, pairs=True)
    want = np.concatenate([brute(x, a) for x in np.split(e, np.cumsum(sizes)[:-1])])
    assert np.allclose(got, want)
    assert np.isclose(pairs.sum(), sum(sizes) - len(sizes))


@pytest.fixture(scope="module")
def docs(spark):
    rng, rows = random.Random(3), []
    for i in range(300):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", ",", "."]) for _ in range(rng.randint(3, 60))), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_held_out_texts_and_switches(docs):
    model = C.fit(docs)
    got = C.with_language(docs.withColumn("held", residue("doc_id", 3) == 1), model).collect()
    held = [r for r in got if r.held]
    assert sum(r.lang == r.lang_pred for r in held) == len(held) > 50 and all(0 <= r.score <= 1 for r in got)
    mixed = [w.encode() for w in WORDS["aa"] + WORDS["bb"] + WORDS["cc"]]
    labels = [model.languages[i] for i in model.label_words([mixed])[0].argmax(axis=1)]
    assert sum(a == b for a, b in zip(labels, ["aa"] * 5 + ["bb"] * 5 + ["cc"] * 5)) >= 13
    # Kept words and batches do not change a result.
    fresh = C.LanguageModel(model.languages, model.weights, model.transition)
    for r in got[:40]:
        assert fresh.predict([r.text.lower().encode()]) == [(r.lang_pred, r.score)]


def test_odd_rows(spark, odd, none, docs):
    model = C.fit(docs)
    got = C.with_language(odd.drop("score", "lang_pred"), model).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text))
        assert r.lang_pred in ("und", *WORDS) and (r.lang_pred != "und" or r.score == 0)
    marks = spark.createDataFrame([(1, "… 😀 123 €"), (2, "Ω")], "doc_id bigint, text string")
    assert [r.lang_pred == "und" for r in C.with_language(marks, model).orderBy("doc_id").collect()] == [True, False]
    assert C.with_language(none, model).count() == 0
    assert {r.lang_pred for r in C.with_language(odd, C.fit(none)).collect()} == {"und"}
