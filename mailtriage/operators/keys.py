"""Key checks: leakage, missing keys, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def normalised_key(subject: Column, body: Column) -> Column:
    """Equality key of a message: both fields trimmed and lowered."""
    return F.md5(F.concat_ws("\x00", F.lower(F.trim(subject)), F.lower(F.trim(body))))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both frames."""
    return left.select(key).intersect(right.select(key))


def missing(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(found.select(key), key, "left_anti")


def key_check(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and surplus rows; pre-aggregated per key so hot keys stay small."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"),
                   F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
