"""Linear models: Spark ML fits, and scoring as a column expression over sparse rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from mailtriage.functions.text import let
from mailtriage.models import block_fit
from mailtriage.operators.numeric import class_weights
from mailtriage.operators.vocab import constant_array


@dataclass
class LinearModel:
    """Coefficients per class (one row for a binary or a regression model) and intercepts."""

    classes: list
    coefficients: np.ndarray
    intercepts: np.ndarray

    def margins(self, indices: str = "indices", values: str = "values") -> list[Column]:
        out = []
        for row, b in zip(self.coefficients, self.intercepts):
            weights = constant_array(row)
            products = F.zip_with(indices, values, _product(weights))
            out.append(F.aggregate(products, F.lit(float(b)), lambda a, x: a + x))
        return out

    def probabilities(self, indices: str = "indices", values: str = "values") -> Column:
        """One probability per class, computed inside the row."""
        m = self.margins(indices, values)
        if len(m) == 1:
            return let(1 / (1 + F.exp(-m[0])), lambda p: F.array(1 - p, p))

        def softmax(ms):
            shifted = F.transform(ms, lambda x: F.exp(x - F.array_max(ms)))
            return let(shifted, lambda es: let(F.aggregate(es, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(es, lambda e: e / t)))

        return let(F.array(*m), softmax)

    def score(self, indices: str = "indices", values: str = "values") -> Column:
        return self.margins(indices, values)[0]


def _product(weights: Column):
    return lambda i, v: v * F.get(weights, i)


# Rows per partition of a training matrix: small fits run many short jobs, so they use few tasks. A thousand rows of a few
# hundred entries take some hundredths of a second a step, several times what a further task costs.
FIT_ROWS_PER_TASK = 1_000


# Steps that a search may take before it counts as failed.
MAX_STEPS = 3000


def fit_partitions(rows: DataFrame, n: float) -> DataFrame:
    """As many partitions as the rows are worth, but not more than there are cores: each step waits for its last task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(1, min(cores, int(n) // FIT_ROWS_PER_TASK)))


def index_labels(df: DataFrame, label: str, classes: Sequence) -> DataFrame:
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    return df.withColumn("_y", at.cast("double"))


def sorted_classes(df: DataFrame, label: str) -> list:
    """Class names in order; label sets are small."""
    return [r[0] for r in df.select(label).distinct().orderBy(label).collect()]


def fit_logistic(matrix: DataFrame, label: str, C: float, weight: str | None = None, balanced: bool = True,
                 classes: Sequence | None = None, max_iter: int = MAX_STEPS, tol: float = 1e-7) -> LinearModel:
    """Logistic regression whose penalty matches an inverse strength ``C`` on the summed loss.

    Spark averages the loss, so the penalty is ``1 / (C * sum of weights)``. Balanced weights add up
    to the number of rows. A search that has not ended after ``max_iter`` steps raises.
    """
    classes = list(classes) if classes is not None else sorted_classes(matrix, label)
    rows = index_labels(matrix, label, classes)
    if balanced:
        rows = class_weights(rows, label)
        rows = rows.withColumn("weight", F.col("weight") * F.col(weight)) if weight else rows
    else:
        rows = rows.withColumn("weight", F.col(weight) if weight else F.lit(1.0))
    total, n = rows.agg(F.sum("weight"), F.count("*")).first()
    model = LogisticRegression(
        featuresCol="features", labelCol="_y", weightCol="weight", regParam=1.0 / (C * total), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=tol, family="binomial" if len(classes) == 2 else "multinomial",
    ).fit(fit_partitions(rows.select("_y", "weight", "features"), n))
    require_end(model, max_iter)
    return LinearModel(classes, model.coefficientMatrix.toArray(), np.asarray(model.interceptVector.toArray()))


def require_end(model, max_iter: int) -> None:
    """Raise unless the search ended by its tolerance before the last step that it may take."""
    if model.hasSummary and model.summary.totalIterations >= max_iter:
        raise RuntimeError(f"the fit has not converged after {max_iter} steps")


def fit_ridge(matrix: DataFrame, target: str, alpha: float = 5.0, max_iter: int = MAX_STEPS) -> LinearModel:
    """Ridge regression with penalty ``alpha`` on the summed squared error.

    Spark divides the target by its sample deviation before it penalises; the penalty is scaled back.
    """
    stats = matrix.agg(F.count("*").alias("n"), F.stddev_samp(target).alias("sd")).first()
    model = LinearRegression(
        featuresCol="features", labelCol=target, elasticNetParam=0.0, standardization=False, solver="l-bfgs",
        regParam=alpha * stats.sd / stats.n, maxIter=max_iter, tol=1e-10,
    ).fit(fit_partitions(matrix, stats.n))
    require_end(model, max_iter)
    return LinearModel([target], np.asarray([model.coefficients.toArray()]), np.asarray([model.intercept]))


def fit_model(df: DataFrame, features, label: str, strength: float, classes: Sequence | None = None, ridge: bool = False,
              name: str = "fit", in_order: bool = False, curved: bool = True) -> LinearModel:
    """Fit on the feature rows of ``df``, whatever their number.

    ``curved`` fits (``block_fit``) take many times fewer steps than Spark ML, if there are no more columns than
    ``block_fit.CURVED_DIM``; with more, they are left to Spark ML. Spark ML adds what its tasks return in the order in which
    they end. With ``in_order`` a logistic fit adds it in the order of the rows, so a fit over the same table gives the same numbers.
    """
    curved = curved and not in_order and features.dim <= block_fit.CURVED_DIM
    if curved or in_order and not ridge:
        rows = features.transform(df).select(label, "indices", "values")
        if ridge:
            return LinearModel([label], *block_fit.fit_squared(rows, label, features.dim, strength, MAX_STEPS))
        classes = list(classes) if classes is not None else sorted_classes(df, label)
        return LinearModel(classes, *block_fit.fit(rows, label, classes, features.dim, strength, MAX_STEPS, curved))
    matrix = features.matrix(df, [label], name)
    return fit_ridge(matrix, label, strength) if ridge else fit_logistic(matrix, label, strength, classes=classes)


def objective_gradient(rows: DataFrame, model: LinearModel, label: str, C: float) -> DataFrame:
    """Largest absolute gradient entry per class of the summed, balanced objective at the fitted point.

    A distributed check of the fit: contributions are summed per (class, index) with partial sums.
    """
    spark = rows.sparkSession
    classes = model.classes
    p = rows.withColumn("_p", model.probabilities())
    p = class_weights(p, label)
    at = range(len(classes)) if len(classes) > 2 else [1]
    err = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("weight") * (F.get("_p", F.lit(k)) - (F.col(label) == classes[k]).cast("double"))).alias("e"))
                    for k in at])
    pairs = p.select(F.explode(err).alias("c"), "indices", "values").select(
        "c.k", "c.e", F.explode(F.arrays_zip(F.col("indices").alias("i"), F.col("values").alias("v"))).alias("x"))
    data = pairs.groupBy("k", F.col("x.i").alias("i")).agg(F.sum(F.col("e") * F.col("x.v")).alias("g"))
    coef = [(k, i, float(w)) for row, k in zip(model.coefficients, at) for i, w in enumerate(row)]
    table = spark.createDataFrame(coef, "k int, i int, w double")
    return table.join(data, ["k", "i"], "left").groupBy("k").agg(
        F.max(F.abs(F.coalesce("g", F.lit(0.0)) + F.col("w") / C)).alias("max_gradient"))


def coefficient_table(model: LinearModel, names: DataFrame) -> DataFrame:
    """``class, idx, block, feature, weight`` of every coefficient."""
    labels = model.classes if len(model.coefficients) > 1 else [model.classes[-1]]
    rows = [(str(c), i, float(w)) for c, row in zip(labels, model.coefficients) for i, w in enumerate(row)]
    return names.sparkSession.createDataFrame(rows, "class string, idx int, weight double").join(names, "idx")
