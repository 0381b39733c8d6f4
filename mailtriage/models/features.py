"""Feature rows of the three models: n-gram blocks, one-hot block, numeric block, in that order."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailtriage import constants as K
from mailtriage.functions.headers import header_features_from_map
from mailtriage.functions.sparse import ml_vector
from mailtriage.functions.style import keyword_features, style_features
from mailtriage.functions.text import clean_text, join_text
from mailtriage.operators.vocab import GramSpec, TextModel, char_spec, fit_text, fit_text_by_fold, word_spec
from mailtriage.session import work_path
from mailtriage.sources.sinks import write_training_matrix

LOG1P = ("n_recipients",)


@dataclass
class FeatureSpec:
    """Which blocks a model reads. Sizes and limits are the reference's unless a caller changes them."""

    grams: Sequence[GramSpec] = ()
    one_hot: tuple[str, Sequence[str]] | None = None
    numeric: Sequence[str] = ()
    embedding: tuple[str, int] | None = None


def spam_spec(max_features=30_000, min_df=3, stop_words=()):
    return FeatureSpec([word_spec(max_features, min_df, stop_words)])


def category_spec(words=20_000, chars=8_000, stop_words=()):
    return FeatureSpec([word_spec(words, 2, stop_words), char_spec(chars, 3)], None, K.CATEGORY_NUMERIC)


def priority_spec(words=3_000, chars=1_500, stop_words=()):
    return FeatureSpec([word_spec(words, 2, stop_words), char_spec(chars, 3)], ("category_label", K.CATEGORIES), K.PRIORITY_NUMERIC)


def message_features(parsed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Clean text and all numeric features of parsed messages (``headers``, ``subject``, ``body``)."""
    return parsed.select(
        *keep, clean_text(join_text("subject", "body")).alias("clean"), *header_features_from_map("headers"),
        *style_features("subject", "body"), *keyword_features("subject", "body"),
    )


@dataclass
class FeatureModel:
    """A fitted feature row. Everything it holds is bounded by the vocabulary sizes."""

    spec: FeatureSpec
    texts: list[TextModel]
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    @property
    def blocks(self) -> list[tuple[str, int, int]]:
        """``(name, first index, size)`` of each block, in order."""
        out, at = [], 0
        sizes = [(t.spec.name, t.size) for t in self.texts]
        if self.spec.one_hot:
            sizes.append((self.spec.one_hot[0], len(self.spec.one_hot[1])))
        if self.spec.embedding:
            sizes.append((self.spec.embedding[0], self.spec.embedding[1]))
        if self.spec.numeric:
            sizes.append(("numeric", len(self.spec.numeric)))
        for name, size in sizes:
            out.append((name, at, size))
            at += size
        return out

    @property
    def dim(self) -> int:
        return sum(size for _, _, size in self.blocks)

    def transform(self, df: DataFrame, clean: str = "clean") -> DataFrame:
        """Adds ``indices`` and ``values`` of the feature row. One narrow projection, no shuffle."""
        starts = {name: at for name, at, _ in self.blocks}
        index, value = [], []
        for t in self.texts:
            df = t.transform(df, clean)
            index.append(_shift(f"{t.spec.name}_idx", starts[t.spec.name]))
            value.append(F.col(f"{t.spec.name}_val"))
        if self.spec.one_hot:
            c, values = self.spec.one_hot
            hot = F.array_compact(F.array(*[F.when(F.col(c) == v, F.lit(starts[c] + i)) for i, v in enumerate(values)]))
            index.append(hot)
            value.append(F.transform(hot, lambda i: F.lit(1.0)))
        if self.spec.embedding:
            c, size = self.spec.embedding
            index.append(F.sequence(F.lit(starts[c]), F.lit(starts[c] + size - 1)))
            value.append(F.transform(F.col(c), lambda x: x.cast("double")))
        if self.spec.numeric:
            at = starts["numeric"]
            index.append(F.array(*[F.lit(at + i) for i in range(len(self.spec.numeric))]))
            value.append(F.array(*[(numeric(c) - self.means[c]) / self.scales[c] for c in self.spec.numeric]))
        out = df.withColumns({"indices": F.concat(*index), "values": F.concat(*value)})
        return out.drop(*[f"{t.spec.name}_{s}" for t in self.texts for s in ("idx", "val")])

    def matrix(self, df: DataFrame, keep: Sequence[str], name: str) -> DataFrame:
        """Feature rows written to the shared folder and read back with an ML vector column."""
        rows = self.transform(df).select(*keep, ml_vector(F.lit(self.dim), F.col("indices"), F.col("values")).alias("features"))
        return write_training_matrix(rows, work_path(df.sparkSession, name))

    def names(self) -> list[tuple[str, str]]:
        """``(block, feature)`` of every index."""
        out = []
        for t in self.texts:
            out += [(t.spec.name, term) for term in t.terms]
        if self.spec.one_hot:
            out += [(self.spec.one_hot[0], v) for v in self.spec.one_hot[1]]
        if self.spec.embedding:
            out += [(self.spec.embedding[0], str(i)) for i in range(self.spec.embedding[1])]
        return out + [("numeric", c) for c in self.spec.numeric]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, b, f) for i, (b, f) in enumerate(self.names())], "idx int, block string, feature string")


def _shift(c: str, by: int) -> Column:
    return F.transform(c, lambda i: i + by)


def numeric(c: str) -> Column:
    return F.log1p(F.col(c).cast("double")) if c in LOG1P else F.col(c).cast("double")


def fit_numeric(df: DataFrame, cols: Sequence[str]) -> tuple[dict, dict]:
    """Means and population deviations: one row of at most a few dozen numbers."""
    return fit_numeric_without(df, cols, {None: F.lit(True)})[None]


def fit_numeric_without(df: DataFrame, cols: Sequence[str], parts: dict) -> dict:
    """Means and deviations of several row subsets in one aggregation; a constant column has scale 1."""
    if not cols:
        return {k: ({}, {}) for k in parts}
    aggs = []
    for k, where in parts.items():
        for c in cols:
            x = F.when(where, numeric(c))
            aggs += [F.avg(x).alias(f"{k}_{c}_m"), F.stddev_pop(x).alias(f"{k}_{c}_s")]
    row = df.agg(*aggs).first()
    return {k: ({c: row[f"{k}_{c}_m"] for c in cols}, {c: (row[f"{k}_{c}_s"] or 1.0) for c in cols}) for k in parts}


def fit_features(df: DataFrame, spec: FeatureSpec, clean: str = "clean") -> FeatureModel:
    means, scales = fit_numeric(df, spec.numeric)
    with ThreadPoolExecutor(max(1, len(spec.grams))) as pool:
        texts = list(pool.map(lambda g: fit_text(df, clean, g), spec.grams))
    return FeatureModel(spec, texts, means, scales)


def fit_features_by_fold(df: DataFrame, spec: FeatureSpec, fold: str, clean: str = "clean") -> dict[int, FeatureModel]:
    """One feature model per fold, fitted without that fold's rows."""
    with ThreadPoolExecutor(max(1, len(spec.grams))) as pool:
        texts = list(pool.map(lambda g: fit_text_by_fold(df, clean, g, fold), spec.grams))
    folds = texts[0].keys() if texts else [r[0] for r in df.select(fold).distinct().collect()]
    stats = fit_numeric_without(df, spec.numeric, {f: F.col(fold) != f for f in folds})
    return {f: FeatureModel(spec, [t[f] for t in texts], *stats[f]) for f in folds}
