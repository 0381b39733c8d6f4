"""Saved pipelines: the package's feature rows and linear models as Spark ML stages that can be written and read again.

A stage keeps what it has learnt in params (bounded by the vocabulary), so the standard writer saves it as its metadata and
a fresh session that has this package loads it; ``PipelineModel`` saves and loads a list of them. Stages are narrow
projections and work on tables and streams alike.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from mailtriage.functions import scores as S
from mailtriage.functions.headers import header_map
from mailtriage.functions.text import body_of, subject_of
from mailtriage.models.features import FeatureModel, FeatureSpec, message_features
from mailtriage.models.linear import LinearModel
from mailtriage.operators.vocab import GramSpec, TextModel


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer whose params are all that it has."""

    def _given(self, kwargs):
        self._set(**{k: v for k, v in kwargs.items() if v is not None})


class MessageRow(_Stage):
    """Raw messages to clean text and all numeric features; ``keep`` columns stay."""

    message = Param(Params._dummy(), "message", "column of the raw message", TypeConverters.toString)
    keep = Param(Params._dummy(), "keep", "columns that stay", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, message: str = "message", keep: Sequence[str] | None = None):
        super().__init__()
        self._setDefault(message="message", keep=[])
        self._given(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        c, keep = self.getOrDefault(self.message), self.getOrDefault(self.keep)
        return message_features(df.select(*keep, header_map(c).alias("headers"), subject_of(c).alias("subject"), body_of(c).alias("body")), keep)


class FeatureRow(_Stage):
    """A fitted feature row: adds ``indices`` and ``values``."""

    model = Param(Params._dummy(), "model", "the fitted feature row as JSON", TypeConverters.toString)
    clean = Param(Params._dummy(), "clean", "column of the clean text", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, model: str | None = None, clean: str = "clean"):
        super().__init__()
        self._setDefault(clean="clean")
        self._given(self._input_kwargs)

    @staticmethod
    def of(fitted: FeatureModel, clean: str = "clean") -> FeatureRow:
        spec = fitted.spec
        grams = [[t.spec.name, t.spec.min_n, t.spec.max_n, t.spec.min_df, t.spec.max_features, t.spec.analyzer, list(t.spec.stop_words)] for t in fitted.texts]
        held = {
            "grams": grams, "terms": [t.terms for t in fitted.texts], "idf": [t.idf for t in fitted.texts], "one_hot": spec.one_hot and [spec.one_hot[0], list(spec.one_hot[1])],
            "numeric": list(spec.numeric), "embedding": spec.embedding and list(spec.embedding), "means": fitted.means, "scales": fitted.scales}
        return FeatureRow(model=json.dumps(held), clean=clean)

    def fitted(self) -> FeatureModel:
        held = json.loads(self.getOrDefault(self.model))
        specs = [GramSpec(*g) for g in held["grams"]]
        spec = FeatureSpec(specs, held["one_hot"] and tuple(held["one_hot"]), held["numeric"], held["embedding"] and tuple(held["embedding"]))
        return FeatureModel(spec, [TextModel(g, t, i) for g, t, i in zip(specs, held["terms"], held["idf"])], held["means"], held["scales"])

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.fitted().transform(df, self.getOrDefault(self.clean))


class LinearScores(_Stage):
    """A fitted linear model over ``indices`` and ``values``: adds its probabilities and its label, or its score; takes the feature row away."""

    classes = Param(Params._dummy(), "classes", "labels by number, none for a regression", TypeConverters.toListString)
    coefficients = Param(Params._dummy(), "coefficients", "rows end to end", TypeConverters.toListFloat)
    intercepts = Param(Params._dummy(), "intercepts", "one per row", TypeConverters.toListFloat)
    output = Param(Params._dummy(), "output", "prefix of the new columns", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, classes: Sequence[str] | None = None, coefficients: Sequence[float] | None = None, intercepts: Sequence[float] | None = None, output: str = "linear"):
        super().__init__()
        self._setDefault(classes=[], output="linear")
        self._given(self._input_kwargs)

    @staticmethod
    def of(fitted: LinearModel, output: str, regression: bool = False) -> LinearScores:
        return LinearScores(
            classes=[] if regression else [str(c) for c in fitted.classes], coefficients=np.ravel(fitted.coefficients).tolist(), intercepts=np.ravel(fitted.intercepts).tolist(), output=output)

    def fitted(self) -> LinearModel:
        b = np.array(self.getOrDefault(self.intercepts))
        return LinearModel(list(self.getOrDefault(self.classes)), np.array(self.getOrDefault(self.coefficients)).reshape(len(b), -1), b)

    def _transform(self, df: DataFrame) -> DataFrame:
        m, name = self.fitted(), self.getOrDefault(self.output)
        if not m.classes:
            return df.withColumn(f"{name}_score", m.score()).drop("indices", "values")
        out = df.withColumn(f"{name}_probability", m.probabilities()).drop("indices", "values")
        return out.withColumn(f"{name}_label", S.argmax_label(F.col(f"{name}_probability"), m.classes))


def triage_pipeline(message: str, keep: Sequence[str], models: dict[str, tuple[FeatureModel, LinearModel]], regressions: Sequence[str] = ()) -> PipelineModel:
    """Messages to the labels and scores of several linear models, as one pipeline that can be saved."""
    stages = [MessageRow(message=message, keep=list(keep))]
    for name, (features, linear) in models.items():
        stages += [FeatureRow.of(features), LinearScores.of(linear, name, name in regressions)]
    return PipelineModel(stages)
