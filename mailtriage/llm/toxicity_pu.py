"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts, labelled clean or not at all, count as
unlabelled. With the share ``prior`` of toxic texts, estimated from the labels, the risk is
prior * loss(P, toxic) + max(0, loss(U, clean) - prior * loss(P, clean)): what the positives hidden among
the unlabelled add to the second term is taken off, and where that falls below zero the step goes
against it, so the model cannot gain by calling every unlabelled text clean.

Fit, on a bounded sample (``max_positives``, ``max_unlabelled``, the smallest hashes of the ids): words by their
presence in a text; the ``max_words`` words that lean most to the positives, of those in at least
1 % (and 5) of them; several NumPy classifiers from
different seeds, averaged. The driver gets the matrix of that sample and nothing else. Scoring is one narrow
stage over whole texts with a model of at most ``max_words`` words.

Rows whose crc32(doc_id as text) mod 5 is 0 never lend a label. Inputs of a score are the words of the text.

Defined cases: null and empty texts have no words and get the score of the bias; a null id is held out; a
document labelled more than once is toxic if any label says so. Without positives or unlabelled texts in the
sample every score is the prior (0 without labels). Other columns are carried along.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mailtriage.llm.common import materialize_texts, residue, text_of
from mailtriage.session import materialize, ship

MAX_POSITIVES = 6_000
MAX_UNLABELLED = 12_000
MAX_WORDS = 256
LEAST_LEAN = 4.0
LEAST_TEXTS, LEAST_SHARE = 5, 0.01
FOLDS = 5
CLASSIFIERS = 3

# ASCII letters to lower case, other ASCII but digits to spaces; bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(data: bytes) -> set[bytes]:
    return set(data.translate(_TABLE).split())


def lowered() -> Column:
    return F.lower(text_of()).cast("binary")


def _lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per word among positives and unlabelled, of each batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for positive, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[positive].update(words_of(data.as_buffer().to_pybytes()))
        words = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *[pa.array([counts[k][w] for w in words], pa.int64()) for k in (1, 0)]], ["word", "pos", "unl"])


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, seed: int, steps: int = 400, rate: float = 0.1, decay: float = 2e-4) -> np.ndarray:
    """Weights and bias of one classifier; logistic loss, mini-batches drawn by ``seed``."""
    rng = np.random.default_rng(seed)
    rows_p, rows_u = np.flatnonzero(positive), np.flatnonzero(~positive)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)

    def side(rows, target):
        """Mean loss and gradient if all rows were of class ``target`` (1 or -1)."""
        part = x[rows]
        margin = target * (part @ w[:-1] + w[-1])
        slope = -target / (1 + np.exp(np.clip(margin, -500, 500)))
        return np.logaddexp(0, -margin).mean(), np.append(part.T @ slope, slope.sum()) / len(rows)

    for step in range(1, steps + 1):
        p, u = (rng.choice(r, min(len(r), 2048), replace=False) for r in (rows_p, rows_u))
        (_, grad_pos), (loss_pn, grad_pn), (loss_un, grad_un) = side(p, 1), side(p, -1), side(u, -1)
        clean, grad_clean = loss_un - prior * loss_pn, grad_un - prior * grad_pn
        grad = prior * grad_pos + grad_clean if clean >= 0 else -grad_clean
        grad = grad + decay * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w = w - rate / (1 + step / 100) * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return w


@dataclass
class ToxicModel:
    """Word weights, a bias per classifier; without words every text scores ``prior``."""

    words: dict[bytes, int]
    weights: np.ndarray
    prior: float

    def score(self, data: bytes) -> float:
        if not len(self.weights):
            return self.prior
        found = [self.words[w] for w in self.words.keys() & words_of(data)]
        margins = self.weights[:, found].sum(axis=1) + self.weights[:, -1]
        return float(np.mean(1 / (1 + np.exp(-np.clip(margins, -500, 500)))))


def fit(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, max_words: int = MAX_WORDS) -> ToxicModel:
    spark = docs.sparkSession
    ship(spark)
    usable = labels.filter(residue("doc_id", FOLDS) != 0).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter("toxic is not null")
    seen, toxic = usable.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = toxic / seen if seen else 0.0
    by_hash = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    positives = by_hash(usable.filter("toxic = 1"), max_positives).select("doc_id", F.lit(1).alias("positive"))
    others = by_hash(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter(residue("doc_id", FOLDS) != 0), max_unlabelled)
    others = others.select("doc_id", F.lit(0).alias("positive"))
    # At most max_positives + max_unlabelled ids; a positive that is drawn as unlabelled too counts on both sides, as the risk demands.
    chosen = positives.unionByName(others)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lowered().alias("data")).join(F.broadcast(chosen), "doc_id").select("positive", "data")
    texts = materialize(texts, "toxic-sample")
    sizes = dict(texts.groupBy("positive").count().collect())
    p, u = sizes.get(1, 0), sizes.get(0, 0)
    if not p or not u or not 0 < prior < 1:
        return ToxicModel({}, np.zeros((0, 0)), prior)
    counts = texts.mapInArrow(_lean, "word binary, pos bigint, unl bigint").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    share = (F.col("unl") + F.lit(0.5)) / (u + 1)
    lean = (F.col("pos") / p - share) / F.sqrt(share * (1 - share) / p)
    top = counts.filter(F.col("pos") >= max(LEAST_TEXTS, LEAST_SHARE * p)).withColumn("lean", lean).filter(F.col("lean") >= LEAST_LEAN).orderBy(F.desc("lean"), "word").limit(max_words)
    words = {bytes(r["word"]): i for i, r in enumerate(top.select("word").collect())}

    def rows(batches):
        for batch in batches:
            found = [[words[w] for w in words.keys() & words_of(d.as_buffer().to_pybytes())] for d in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["positive", "found"])

    sample = texts.mapInArrow(rows, "positive int, found array<int>").toArrow()
    positive = sample.column("positive").to_numpy() == 1
    x = np.zeros((len(positive), len(words)))
    for i, found in enumerate(sample.column("found").to_pylist()):
        x[i, found] = 1
    order = np.lexsort([*x.T, positive])
    return ToxicModel(words, np.array([fit_nnpu(x[order], positive[order], prior, seed) for seed in range(CLASSIFIERS)]), prior)


def with_scores(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``docs`` with score, between 0 and 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(data: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(d) for d in data], dtype="float64")

    return docs.withColumn("score", score(lowered()))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns as they were."""
    scored = with_scores(docs.withColumnRenamed("score", "__score"), fit(docs, labels)).filter(F.col("score") < threshold).drop("score")
    # Written here, so that texts are scored in small batches.
    return materialize_texts(scored.withColumnRenamed("__score", "score"), "not-toxic")
