"""Numeric features: population scaling, one-hot columns, class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def fit_scaler(df: DataFrame, cols: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per column; a constant column gets scale 1."""
    aggs = []
    for c in cols:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"{c}_scale")]
    return df.groupBy(*groups).agg(*aggs)


def scale(df: DataFrame, scaler: DataFrame, cols: Sequence[str], on: Sequence[str] = (), keep_stats: bool = False) -> DataFrame:
    """Standardise with fitted statistics: one row, or one row per group, so broadcast is safe."""
    joined = df.join(F.broadcast(scaler), list(on)) if on else df.crossJoin(F.broadcast(scaler))
    out = joined.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_scale") for c in cols})
    return out if keep_stats else out.drop(*[f"{c}_{s}" for c in cols for s in ("mean", "scale")])


def one_hot(c: str, values: Sequence[str]) -> list[Column]:
    """One 0/1 column per known value; an unknown value gives zeros."""
    return [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v.lower()}") for v in values]


def class_weights(df: DataFrame, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Adds ``weight = n / (k * n_c)``. The table of classes is small and joins back by broadcast."""
    from pyspark.sql import Window as W

    per = df.groupBy(*groups, label).agg(F.count("*").alias("_n"))
    whole = W.partitionBy(*groups)
    per = per.withColumn("weight", F.sum("_n").over(whole) / (F.count("*").over(whole) * F.col("_n"))).drop("_n")
    return df.join(F.broadcast(per), [*groups, label])
