"""Corrections, retrain attempts and model versions as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mailtriage import constants as K

CORRECTION_KEY = ("user_id", "message_id", "model")
MODEL_KEY = ("user_id", "model")


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order``; later deliveries win.

    An aggregation and not a window: partial aggregation leaves one row per key and map task, so a
    key delivered many times stays small.
    """
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*key, "_r.*").select(*df.columns)


def scope_to_user(corrections: DataFrame, connections: DataFrame, on: Column, user: Column | None = None) -> DataFrame:
    """Corrections with the owner of their connection. Spark broadcasts connections only if they are small."""
    out = corrections.join(connections, on)
    return out if user is None else out.filter(user)


def counts(current: DataFrame) -> DataFrame:
    return current.groupBy(*MODEL_KEY).agg(
        F.count("*").alias("correction_count"), F.max("created_at").alias("last_correction"))


def last_attempt(attempts: DataFrame) -> DataFrame:
    return latest(attempts, MODEL_KEY, ["version"])


def remaining(current: DataFrame, attempts: DataFrame) -> DataFrame:
    """Corrections per (user, model) and how many are missing until the next retrain."""
    last = last_attempt(attempts).select(*MODEL_KEY, F.col("correction_count").alias("_at"))
    new = F.col("correction_count") - F.coalesce("_at", F.lit(0))
    return counts(current).join(last, list(MODEL_KEY), "left").select(
        *MODEL_KEY, "correction_count",
        F.greatest(F.lit(0).cast("long"), F.lit(K.RETRAIN_THRESHOLD) - new).alias("corrections_until_retrain"))


def changed_since_attempt(current: DataFrame, attempts: DataFrame) -> DataFrame:
    """Keys whose newest correction is later than their last attempt, or that had no attempt."""
    last = last_attempt(attempts).select(*MODEL_KEY, F.col("created_at").alias("_at"))
    return counts(current).join(last, list(MODEL_KEY), "left").filter(
        F.col("_at").isNull() | (F.col("last_correction") > F.col("_at"))).select(*MODEL_KEY, "last_correction")


def next_version(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy(*MODEL_KEY).agg((F.max("version") + 1).alias("next_version"))


def with_status(attempts: DataFrame) -> DataFrame:
    """Adds ``status``: the newest passed attempt is active, earlier passed ones are superseded.

    The active version per key comes from one aggregation and is joined back, so a user with very
    many attempts is never one window.
    """
    active = attempts.filter("passed = 1").groupBy(*MODEL_KEY).agg(F.max("version").alias("_active"))
    status = (F.when(F.col("passed") == 0, "rejected").when(F.col("version") == F.col("_active"), "active").otherwise("superseded"))
    return attempts.join(active, list(MODEL_KEY), "left").withColumn("status", status).drop("_active")


def promote(history: DataFrame, attempt: DataFrame) -> DataFrame:
    """Add attempts to a version history and derive every status again."""
    return with_status(history.drop("status").unionByName(attempt, allowMissingColumns=True))


def active_versions(attempts: DataFrame) -> DataFrame:
    return attempts.filter("passed = 1").groupBy(*MODEL_KEY).agg(F.max("version").alias("version"))


def version_key(attempts: DataFrame) -> DataFrame:
    """Sorted ``model:version`` list per user; at most one entry per model."""
    entry = F.concat("model", F.lit(":"), F.col("version").cast("string"))
    return active_versions(attempts).groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("version_key"))


def attempt_key(attempts: DataFrame) -> DataFrame:
    """``model:last version`` for the three models in order; 0 where a model had no attempt."""
    last = attempts.groupBy("user_id").agg(
        *[F.coalesce(F.max(F.when(F.col("model") == m, F.col("version"))), F.lit(0)).alias(f"v_{m}") for m in K.MODELS])
    parts = [F.concat(F.lit(f"{m}:"), F.col(f"v_{m}").cast("string")) for m in K.MODELS]
    return last.select("user_id", F.concat_ws(",", *parts).alias("attempt_key"))


def label_maps(current: DataFrame) -> DataFrame:
    """One map model → label per message; a message has at most one correction per model."""
    return current.groupBy("user_id", "message_id").agg(
        F.map_from_entries(F.collect_list(F.struct("model", "corrected_label"))).alias("corrected"))


def shown_labels(results: DataFrame, current: DataFrame, key: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Results with a ``shown_<model>`` column: the user's correction where there is one, else the model's label.

    A corrected priority bucket also sets the shown score. Raw labels are kept.
    """
    wide = current.groupBy(*key).agg(*[
        F.max(F.when(F.col("model") == m, F.col("corrected_label"))).alias(f"_{m}") for m in columns])
    out = results.join(wide, list(key), "left")
    out = out.withColumns({f"shown_{m}": F.coalesce(F.col(f"_{m}"), F.col(c)) for m, c in columns.items()})
    if "priority" in columns and "score" in results.columns:
        from mailtriage.functions.scores import bucket_score

        out = out.withColumn("shown_score", F.coalesce(bucket_score(F.col("_priority")), F.col("score")))
    return out.drop(*[f"_{m}" for m in columns])


def custom_labels(current: DataFrame, base: Sequence[str] = K.CATEGORIES) -> DataFrame:
    """Distinct labels the users invented."""
    return current.filter((F.col("model") == "category") & ~F.col("corrected_label").isin(*base)).select("user_id", "corrected_label").distinct()


def status_summary(current: DataFrame, attempts: DataFrame, users: DataFrame) -> DataFrame:
    """Per (user, model): corrections, missing corrections, last attempt; custom labels per user."""
    grid = users.select("user_id").distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in K.MODELS])))
    last = with_status(attempts)
    last = latest(last, MODEL_KEY, ["version"]).select(
        *MODEL_KEY, F.col("version").alias("last_version"), F.col("status").alias("last_status"), F.col("correction_count").alias("_at"))
    labels = custom_labels(current).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("corrected_label")), ",").alias("custom_labels"))
    n = counts(current).drop("last_correction")
    out = grid.join(n, list(MODEL_KEY), "left").join(last, list(MODEL_KEY), "left").join(labels, "user_id", "left")
    have = F.coalesce("correction_count", F.lit(0).cast("long"))
    left = F.greatest(F.lit(0).cast("long"), F.lit(K.RETRAIN_THRESHOLD) - (have - F.coalesce("_at", F.lit(0))))
    return out.select(*MODEL_KEY, have.alias("correction_count"), left.alias("corrections_until_retrain"), "last_version", "last_status",
                      F.coalesce("custom_labels", F.lit("")).alias("custom_labels"))


def recent_connection(df: DataFrame, user: str, connection: str, used_at: str) -> DataFrame:
    return df.groupBy(user).agg(F.max_by(connection, F.struct(used_at, connection)).alias(connection))


def opt_out(table: DataFrame, users: DataFrame) -> DataFrame:
    """The table without the rows of users who opted out."""
    return table.join(users.select("user_id"), "user_id", "left_anti")
