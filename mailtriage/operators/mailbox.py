"""Mailbox views: search, filters, order, counts, shown labels, relationships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mailtriage import constants as K


def matches_query(text: str, columns: Sequence[str]) -> Column:
    """Case-insensitive search; a blank query matches every row."""
    q = text.strip().lower()
    if not q:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    return hit


def view(df: DataFrame, archived: bool = False, category: str | None = None, only_high: bool = False,
         only_unread: bool = False, resorted: DataFrame | None = None, key: str = "msg_id") -> DataFrame:
    """One mailbox view. Category and high-only filters do not apply to the archive or re-sorted views."""
    out = df.filter(F.col("archived") == int(archived))
    if resorted is not None:
        out = out.join(resorted.select(key), key, "left_semi")
    elif not archived:
        if category is not None:
            out = out.filter(F.col("category") == category)
        if only_high:
            out = out.filter(F.col("bucket") == "high")
    return out.filter(F.col("unread") == 1) if only_unread else out


def inbox_order(df: DataFrame, received: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(received), key)


def counts(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Live mailbox counts: total, per category, high priority, unread."""
    live = F.col("archived") == 0
    return df.groupBy(*groups).agg(
        F.count_if(live).alias("n_all"),
        *[F.count_if(live & (F.col("category") == c)).alias(f"n_{c.lower()}") for c in K.CATEGORIES],
        F.count_if(live & (F.col("bucket") == "high")).alias("n_high"),
        F.count_if(live & (F.col("unread") == 1)).alias("n_unread"),
    )


def pair_frequency(df: DataFrame, sender: str, recipient: str) -> DataFrame:
    """Messages per (sender, recipient) with the sender's number of distinct recipients.

    Distinct recipients are counted over the pair table, so a sender with most of the mail is
    already reduced to one row per recipient.
    """
    pairs = df.groupBy(sender, recipient).agg(F.count("*").alias("pair_freq"))
    senders = pairs.groupBy(sender).agg(F.count("*").alias("n_distinct_to"))
    return pairs.join(senders, sender)


def resorted(before: DataFrame, after: DataFrame, corrected: DataFrame, key: str, label: str) -> DataFrame:
    """Messages whose model label changed, with the old label; corrected messages are left out."""
    b = before.select(key, F.col(label).alias("label_before"))
    a = after.select(key, F.col(label).alias("label_after"))
    return a.join(b, key).filter("label_before <> label_after").join(corrected.select(key), key, "left_anti")
