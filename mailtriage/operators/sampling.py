"""Seeded samples, ranks, folds and deduplication that hold when one group has most of the rows.

"Random" order is the order of ``md5(seed:key)``: repeatable, engine-independent and uniform.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mailtriage.functions.text import content_key

# One group is spread over this many first-stage tasks before its final selection.
SALTS = 32
# Hex digits of the order hash that name a bucket: 16**3 = 4096 buckets per group.
BUCKET_DIGITS = 3


def _cols(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def take_per_group(df: DataFrame, groups: Sequence[str] | str, order: Sequence[Column], n: int, salt_on: str) -> DataFrame:
    """The first ``n`` rows of every group, exactly.

    Two steps: first within (group, salt), then within the group over at most ``SALTS * n`` rows, so
    no task ever holds a whole group. Spark also cuts each map task to n rows per group before the
    first exchange (window group limit).
    """
    groups = _cols(groups)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(SALTS)))
    first = W.partitionBy(*groups, "_salt").orderBy(*order)
    final = W.partitionBy(*groups).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(final)).filter(F.col("_rn") <= n)
        .drop("_rn", "_salt")
    )


def sample_per_group(df: DataFrame, groups, key: str, n: int, seed) -> DataFrame:
    """Exactly ``min(n, size)`` rows of every group, seeded."""
    return take_per_group(df, groups, [content_key(key, seed), F.col(key)], n, key)


def rank_in_group(df: DataFrame, groups, key: str, seed, name: str = "rank") -> DataFrame:
    """Exact 1-based rank of each row within its group in seeded order, plus the group size.

    A window over a whole group would put it into one task. The hash order is cut into 4096 equal
    buckets instead: buckets are counted (a small table), their running totals give each bucket its
    start, and rows are ranked inside their bucket. Group and bucket are one struct key, which is
    null-safe and lets the ranking and a shuffled join share one exchange.
    """
    groups = _cols(groups)
    keyed = df.withColumn("_h", content_key(key, seed)).withColumn(
        "_k", F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], F.substring("_h", 1, BUCKET_DIGITS).alias("b")))
    counts = keyed.groupBy("_k").agg(F.count("*").alias("_n"))
    whole = W.partitionBy(*[f"_k.g{i}" for i in range(len(groups))])
    starts = counts.select(
        "_k", (F.sum("_n").over(whole.orderBy("_k.b")) - F.col("_n")).alias("_start"), F.sum("_n").over(whole).alias("group_size"))
    ranked = keyed.withColumn("_rn", F.row_number().over(W.partitionBy("_k").orderBy("_h", key)))
    return ranked.join(starts, "_k").withColumn(name, F.col("_start") + F.col("_rn")).drop("_h", "_k", "_rn", "_start")


def sample_fraction(df: DataFrame, groups, key: str, fraction: float, seed) -> DataFrame:
    """``round(fraction * size)`` rows of every group: keeps the class ratio."""
    ranked = rank_in_group(df, groups, key, seed)
    return ranked.filter(F.col("rank") <= F.round(F.col("group_size") * fraction)).drop("rank", "group_size")


def assign_folds(df: DataFrame, label: str, key: str, k: int, seed) -> DataFrame:
    """Stratified fold number 0..k-1: within a label, folds differ by at most one row."""
    ranked = rank_in_group(df, label, key, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "group_size")


def holdout(df: DataFrame, label: str, key: str, fraction: float, seed) -> DataFrame:
    """Adds ``is_test``: ``ceil(fraction * size)`` rows of every label, seeded."""
    ranked = rank_in_group(df, label, key, seed)
    test = F.col("rank") <= F.ceil(F.col("group_size") * fraction)
    return ranked.withColumn("is_test", test.cast("int")).drop("rank", "group_size")


def half_split(df: DataFrame, groups, key: str, seed, minimum: int = 4) -> DataFrame:
    """Adds ``half``: 0 for the first ``size // 2`` rows of a group in seeded order, 1 for the rest.

    Groups below the minimum cannot be split; they get null.
    """
    ranked = rank_in_group(df, groups, key, seed)
    half = F.when(F.col("rank") <= F.floor(F.col("group_size") / 2), 0).otherwise(1)
    return ranked.withColumn("half", F.when(F.col("group_size") >= minimum, half)).drop("rank", "group_size")


def message_key(subject: str, body: str, prefix: int | None = None) -> Column:
    """Content key of a message. With ``prefix`` only that many characters of the body count, so rows that differ later are lost."""
    return F.concat_ws("||", subject, body if prefix is None else F.substring(body, 1, prefix))


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row per content key, the one with the smallest ``order`` value.

    The group limit runs before the exchange, so of a key with a third of all rows each map task
    sends one row.
    """
    w = W.partitionBy("_key").orderBy(order)
    keyed = df.withColumn("_key", F.md5(key)).withColumn("_rn", F.row_number().over(w))
    return keyed.filter(F.col("_rn") == 1).drop("_rn", "_key")


def bounded_chunk_sample(df: DataFrame, key: str, chunks: int, per_chunk: int, total: int, seed) -> DataFrame:
    """At most ``per_chunk`` rows of each hash chunk, and ``total`` rows in all, in seeded order."""
    order = [content_key(key, seed), F.col(key)]
    h = content_key(key, f"{seed}-chunk")
    chunk = F.conv(F.substring(h, 1, 6), 16, 10).cast("long") % chunks
    picked = take_per_group(df.withColumn("_chunk", chunk), "_chunk", order, per_chunk, key)
    return picked.orderBy(*order).limit(total).drop("_chunk")


def class_mix(parts: Sequence[tuple[DataFrame, int]], key: str, seed) -> DataFrame:
    """Union of seeded samples, each of at most its given size, from frames with the same columns."""
    out = None
    for df, n in parts:
        picked = df.orderBy(content_key(key, seed), key).limit(n)
        out = picked if out is None else out.unionByName(picked)
    return out
