"""Scores and labels as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from mailtriage import constants as K


def bucket_of(score: Column) -> Column:
    return (F.when(score < K.BUCKET_MEDIUM_FROM, "low").when(score < K.BUCKET_HIGH_FROM, "medium")
            .when(score.isNotNull(), "high"))


def lookup(c: Column, table: dict) -> Column:
    """Value of a small fixed table; null where the key is not in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), c)


def bucket_score(bucket: Column) -> Column:
    return lookup(bucket, K.BUCKET_SCORE)


def correction_target(model: Column, label: Column) -> Column:
    """Training target of a corrected label: 1/0 for spam, a score for the regressor, else itself."""
    return (
        F.when(model == "spam", lookup(label, K.SPAM_TARGET).cast("string"))
        .when(model == "priority_regressor", bucket_score(label).cast("string"))
        .otherwise(label)
    )


def sentiment_class(compound: Column) -> Column:
    return (F.when(compound >= K.SENTIMENT_CUT, "positive").when(compound <= -K.SENTIMENT_CUT, "negative")
            .otherwise("neutral"))


def negative_tail_bonus(compound: Column) -> Column:
    """The retired rule: strongly negative text raises priority, positive text changes nothing."""
    return F.when(compound <= -0.6, 0.15).when(compound <= -0.3, 0.08).otherwise(0.0)


def clip_score(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(K.SCORE_MIN)), F.lit(K.SCORE_MAX))


def spam_label(p: Column) -> Column:
    return F.when(p >= K.SPAM_THRESHOLD, "spam").otherwise("ham")


def priority_result(spam_conf: Column, score: Column, bucket: Column) -> Column:
    """Final priority; mail flagged as spam is always low."""
    spam = spam_conf >= K.SPAM_THRESHOLD
    note = F.concat(F.lit("classified as spam (conf="), F.format_number(spam_conf, 2), F.lit("), priority suppressed"))
    return F.struct(
        F.when(spam, F.lit(K.SCORE_MIN)).otherwise(F.round(clip_score(score), 2)).alias("score"),
        F.when(spam, F.lit("low")).otherwise(bucket).alias("bucket"),
        F.when(spam, note).alias("note"),
    )


def predicted_label(model: Column, label: Column, confidences: Column, spam_conf: Column) -> Column:
    """Label and confidence shown for one model; spam reports the probability of its own label."""
    spam = spam_label(spam_conf)
    return F.struct(
        F.when(model == "spam", spam).otherwise(label).alias("label"),
        F.when(model == "spam", F.when(spam == "spam", spam_conf).otherwise(1 - spam_conf))
        .otherwise(F.coalesce(F.try_element_at(confidences, label), F.lit(0.0))).alias("confidence"),
    )


def argmax_label(probabilities: Column, classes: list[str]) -> Column:
    """Label with the highest probability; the first one on a tie."""
    at = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in classes]), at)


def day_section(ts: Column, as_of: Column) -> Column:
    days = F.datediff(F.to_date(as_of), F.to_date(ts))
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").otherwise("Earlier")


def unscale(value: Column, mean: Column, scale: Column) -> Column:
    return value * scale + mean


def shown_signal(name: str, raw: Column) -> Column:
    """``label`` and ``value`` of a numeric column as a reader sees them; an unnamed column shows two digits."""
    label, form = K.SIGNALS.get(name, (name, "two digits"))
    whole = lambda x: shown_count(x).cast("string")
    value = {
        "count": lambda: whole(raw),
        "log count": lambda: whole(F.expm1(raw)),
        "log characters": lambda: F.concat(whole(F.expm1(raw)), F.lit(" characters")),
        "yes or no": lambda: F.when(raw >= 0.5, "yes").otherwise("no"),
        "per thousand": lambda: F.format_string("%.1f per 1,000 characters", F.greatest(F.lit(0.0), raw)),
        "percent": lambda: F.concat(whole(F.least(F.lit(1.0), raw) * 100), F.lit("%")),
        "two digits": lambda: F.format_string("%.2f", raw),
    }[form]()
    return F.struct(F.lit(label).alias("label"), value.alias("value"))


def shown_count(raw: Column) -> Column:
    return F.greatest(F.lit(0), F.round(raw).cast("int"))
