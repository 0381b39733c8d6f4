"""Weak labels, label filters and label maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailtriage import constants as K


def folder_labels(spark: SparkSession) -> DataFrame:
    """The fixed folder table: a few dozen rows, so it may always be broadcast."""
    rows = [(folder, label) for label, names in K.FOLDER_LABELS.items() for folder in names]
    return spark.createDataFrame(rows, "folder string, weak_label string")


def weak_label(df: DataFrame, folder: str = "folder") -> DataFrame:
    """Adds ``weak_label``; rows in noisy or unknown folders drop out before their text is read."""
    kept = df.filter(~F.col(folder).isin(*K.SKIP_FOLDERS))
    table = F.broadcast(folder_labels(df.sparkSession)).withColumnRenamed("folder", folder)
    return kept.join(table, folder)


def unmapped_folders(df: DataFrame, folder: str = "folder", n: int = 15) -> DataFrame:
    """The ``n`` most frequent folders that are neither mapped nor skipped."""
    known = [f for names in K.FOLDER_LABELS.values() for f in names] + list(K.SKIP_FOLDERS)
    counts = df.filter(F.col(folder).isNotNull() & ~F.col(folder).isin(*known)).groupBy(folder).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), folder).limit(n)


def has_label(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.trim(c) != "")


def apply_label_map(master: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Master rows with a new label take it; all other rows stay as they are.

    Of several labels for one key the last in sort order wins, so the row count cannot change.
    """
    new = labels.groupBy(key).agg(F.max(label).alias("_new"))
    return master.join(new, key, "left").withColumn(label, F.coalesce("_new", label)).drop("_new")


def append_new_labels(master: DataFrame, labels: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Labels for keys not yet in master, with text from the pool where it is there."""
    fresh = labels.join(master.select(key), key, "left_anti").join(pool, key, "left")
    return master.unionByName(fresh, allowMissingColumns=True)


def fill_missing(df: DataFrame, numeric: list[str]) -> DataFrame:
    return df.na.fill(0, subset=numeric)


def noisy_duplicates(df: DataFrame, key: Column, label: str) -> DataFrame:
    """Rows whose content also occurs under another label.

    Keys with more than one label are found first; the rows join back to them. No pairs are built,
    so a content key with many copies costs its rows and not their square.
    """
    keyed = df.withColumn("content", F.md5(key))
    # Partial aggregation reduces every key to its distinct labels before the exchange.
    mixed = (
        keyed.groupBy("content", label).agg(F.count("*").alias("copies"))
        .groupBy("content").agg(F.count("*").alias("n_labels"), F.sum("copies").alias("n_copies"))
        .filter("n_labels > 1")
    )
    return keyed.join(mixed, "content")


def validate_corrections(df: DataFrame, model: str, label: str, confidence: str) -> DataFrame:
    """Adds the trimmed label and ``error``; null means the correction is valid."""
    c, m, p = F.trim(F.col(label)), F.col(model), F.col(confidence)
    error = (
        F.when(~m.isin(*K.MODELS) | m.isNull(), "unknown model")
        .when(F.col(label).isNull() | (F.col(label) == ""), "label is empty")
        .when(F.length(F.col(label)) > K.MAX_CUSTOM_LABEL_CHARS, "label is too long")
        .when(c == "", "label is blank")
        .when((m == "priority") & ~c.isin(*K.BUCKETS), "not a priority label")
        .when((m == "spam") & ~c.isin(*K.SPAM_LABELS), "not a spam label")
        .when(p.isNull() | (p < 0) | (p > 1), "confidence out of range")
    )
    return df.withColumns({label: c, "error": error})
