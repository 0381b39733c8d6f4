"""Evaluation: confusion tables, class metrics, baselines, confidence gates.

Every report starts from a small table (label pairs, or label and 4-digit confidence), so the rows
themselves are aggregated once, before any exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mailtriage import constants as K


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def accuracy(df: DataFrame, true: str, pred: str) -> DataFrame:
    hit = (F.col(true) == F.col(pred)).cast("double")
    return df.agg(F.count("*").alias("n"), F.sum(hit).cast("long").alias("n_correct"), F.round(F.avg(hit), 6).alias("accuracy"))


def pair_counts(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, true: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """One row per true label and one count column per predicted label, in the given order."""
    table = df.groupBy(F.col(true).alias("true_label")).pivot(pred, list(labels)).count()
    table = table.na.fill(0)
    return table.select("true_label", *[F.col(f"`{x}`").alias(f"pred_{x.lower()}") for x in labels])


def class_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class; undefined ratios are 0."""
    pairs = pair_counts(df, true, pred)
    long = pairs.select(
        F.explode(F.array(
            F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                     F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                     F.lit(0).cast("long").alias("hit")),
        )).alias("x")
    ).select("x.*")
    s = long.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    precision = F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    s = s.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return s.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).drop("hit", "predicted")


def average_report(report: DataFrame) -> DataFrame:
    """Macro and weighted averages of a class report."""
    w = F.col("support")
    return report.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * w) / F.sum(w)).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        F.sum(w).alias("support"),
    )


def bucket_recall(df: DataFrame, true: str, pred: str) -> DataFrame:
    hit = (F.col(true) == F.col(pred)).cast("long")
    return df.groupBy(true).agg(F.count("*").alias("n"), F.sum(hit).alias("n_correct"), F.round(F.avg(hit), 6).alias("recall"))


def mae_against_mean(df: DataFrame, true: Column, pred: Column) -> DataFrame:
    """Mean absolute error, and that of always predicting the mean (a one-row broadcast)."""
    rows = df.select(true.alias("y"), pred.alias("p"))
    mean = rows.agg(F.avg("y").alias("m"))
    return rows.crossJoin(F.broadcast(mean)).agg(
        F.round(F.avg(F.abs(F.col("y") - F.col("p"))), 6).alias("mae"),
        F.round(F.avg(F.abs(F.col("y") - F.col("m"))), 6).alias("baseline_mae"),
    )


def majority_baseline(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by(label, F.struct("n", label)).alias("majority"), F.round(F.max("n") / F.sum("n"), 6).alias("baseline"))


def agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(
        F.round(F.corr(a, b), 6).alias("r"), F.round(F.avg(F.abs(a - b)), 6).alias("mae"),
        F.round(F.avg(F.when(a == b, 1.0).otherwise(0.0)), 6).alias("exact"),
    )


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum.

    Values are counted first. Quartiles then come from the (value, count) table: with 4-digit
    confidences it has at most 10,001 rows, whatever the number of messages.
    """
    table = df.groupBy(value).agg(F.count("*").alias("n"))
    v, n = F.col(value), F.col("n")
    total = F.sum(n)
    mean = F.sum(v * n) / total
    # The deviation is taken around the mean, not as a difference of large sums.
    centre = table.agg((F.sum(v * n) / F.sum(n)).alias("c"))
    q = F.expr(f"percentile({value}, array(0.25D, 0.5D, 0.75D), n)")
    return table.crossJoin(F.broadcast(centre)).agg(
        total.alias("count"), F.round(mean, 6).alias("mean"),
        F.round(F.sqrt(F.sum(n * (v - F.col("c")) * (v - F.col("c"))) / (total - 1)), 6).alias("std"),
        F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max"),
    ).select("count", "mean", "std", "min", *[F.round(F.col("q")[i], 6).alias(a) for i, a in enumerate(("p25", "p50", "p75"))], "max")


def gate_sweep(df: DataFrame, true: str, pred: str, confidence: str) -> DataFrame:
    """Per predicted class and threshold: rows kept, precision and coverage of the class.

    The running sums go over distinct 4-digit confidences (at most 10,001 per class), not over rows.
    """
    hit = (F.col(true) == F.col(pred)).cast("long")
    table = df.groupBy(F.col(pred).alias("label"), F.col(confidence).alias("threshold")).agg(
        F.count("*").alias("n"), F.sum(hit).alias("hit"))
    down = W.partitionBy("label").orderBy(F.desc("threshold"))
    whole = W.partitionBy("label")
    kept = F.sum("n").over(down)
    return table.select(
        "label", "threshold", kept.alias("kept"), (F.sum("hit").over(down) / kept).alias("precision"),
        (kept / F.sum("n").over(whole)).alias("coverage"),
    )


def lowest_threshold(sweep: DataFrame, target: float) -> DataFrame:
    """The lowest threshold of each class that still reaches the target precision."""
    ok = sweep.filter(F.col("precision") >= target)
    return ok.groupBy("label").agg(
        F.min("threshold").alias("threshold"), F.min_by("kept", "threshold").alias("kept"),
        F.min_by("precision", "threshold").alias("precision"), F.min_by("coverage", "threshold").alias("coverage"),
    )


def confidence_gate(df: DataFrame, pred: str, confidence: str, thresholds: dict[str, float] = K.GATE_THRESHOLDS) -> DataFrame:
    """Adds ``decision``: accepted at or above the class threshold, else review."""
    limit = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    # A class without a threshold is never accepted unseen.
    ok = F.coalesce(F.col(confidence) >= F.try_element_at(limit, F.col(pred)), F.lit(False))
    return df.withColumn("decision", F.when(ok, "accepted").otherwise("review"))


def promotion_gate(own_accuracy: Column, gate_accuracy: Column, base_accuracy: Column, custom_fraction: Column) -> Column:
    """First failing check, in the order own corrections, custom labels, accuracy; null where all hold."""
    return (
        F.when(own_accuracy < K.OWN_CORRECTION_MIN, "corrections")
        .when(custom_fraction > K.MAX_CUSTOM_FRACTION, "custom labels")
        .when(gate_accuracy < base_accuracy - K.MAX_GATE_DROP, "accuracy")
    )


def gate_metrics(df: DataFrame, groups: Sequence[str], is_own: Column, true: Column, pred: Column,
                 base_pred: Column, base_labels: Sequence[str], score_all_rows: bool = False) -> DataFrame:
    """Gate numbers per model in one conditional aggregate.

    ``is_own`` marks the user's corrections, the other rows are the test set. Test rows predicted as
    a label outside the base set cannot be right or wrong and are left out of the accuracy, unless
    ``score_all_rows`` is set.
    """
    custom = ~pred.isin(*base_labels)
    scored = ~is_own if score_all_rows else (~is_own & ~custom)
    rate = lambda when, value: F.coalesce(F.avg(F.when(when, value.cast("double"))), F.lit(0.0))
    out = df.groupBy(*groups).agg(
        rate(is_own, true == pred).alias("own_accuracy"), rate(scored, true == pred).alias("gate_accuracy"),
        rate(~is_own, true == base_pred).alias("base_accuracy"), rate(~is_own, custom).alias("custom_fraction"),
    )
    reason = promotion_gate(*[F.col(c) for c in ("own_accuracy", "gate_accuracy", "base_accuracy", "custom_fraction")])
    return out.withColumn("reason", reason).withColumn("passed", F.when(reason.isNull(), 1).otherwise(0))
