"""Style markers and keyword counts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailtriage import constants as K
from mailtriage.functions.text import join_text, text_or_empty


def _words(words) -> str:
    """Any of the words, which start with letters. The first letters are asked for first, and words of one letter stand together, in their
    order: an edge of a word that none of them starts at, such as its end, costs one test and not one per word."""
    by_letter: dict[str, list[str]] = {}
    for w in words:
        by_letter.setdefault(w[0], []).append(w[1:])
    return rf"(?iU)\b(?=[{''.join(by_letter)}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + r")\b"


def occurrences(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def style_features(subject, body) -> list[Column]:
    """Nine style markers; greetings look at the first characters, closings at the last."""
    full = join_text(subject, body)
    body = text_or_empty(body)
    head = F.substring(body, 1, K.GREETING_CHARS)
    tail = F.right(body, F.lit(K.CLOSING_CHARS))
    n = F.length(full)
    cols = {
        "text_len_log": F.log1p(n.cast("double")),
        "excl_density": occurrences(full, "!") / F.greatest(n, F.lit(1)) * 1000,
        "caps_word_count": F.least(F.regexp_count(full, F.lit(r"(?U)\b[A-Z]{3,}\b")), F.lit(K.CAPS_CAP)),
        "informal_greeting": head.rlike(_words(K.INFORMAL_GREETING)).cast("int"),
        "formal_greeting": head.rlike(_words(K.FORMAL_GREETING)).cast("int"),
        "family_words": full.rlike(_words(K.FAMILY_WORDS)).cast("int"),
        "formal_closing": tail.rlike(_words(K.FORMAL_CLOSING)).cast("int"),
        "informal_closing": tail.rlike(_words(K.INFORMAL_CLOSING)).cast("int"),
        "question_count": F.least(occurrences(full, "?"), F.lit(K.QUESTION_CAP)),
    }
    return [cols[name].alias(name) for name in K.STYLE_COLS]


def keyword_features(subject, body) -> list[Column]:
    full = join_text(subject, body)
    return [
        F.regexp_count(full, F.lit(_words(K.HIGH_WORDS))).alias("kw_high"),
        F.regexp_count(full, F.lit(_words(K.MEDIUM_WORDS))).alias("kw_med"),
        F.regexp_count(full, F.lit(_words(K.LOW_WORDS))).alias("kw_low"),
        occurrences(text_or_empty(subject), "!").alias("excl_subj"),
    ]
