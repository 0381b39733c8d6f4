"""Message text as column expressions: cleaning, splitting, truncation, tidying.

Patterns carry ``(?U)`` so that word characters, digits and blanks follow Unicode on every JDK.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailtriage.constants import ROUTING_WORDS

BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _replaced(c: Column, possible, pattern: str, word: str) -> Column:
    """The pattern replaced, tried only where ``possible`` holds."""
    return let(c, lambda x: F.when(possible(x), F.regexp_replace(x, pattern, word)).otherwise(x))


def clean_text(c, strip_routing: bool = False) -> Column:
    """Lower-case letters and single blanks only; links, addresses and phone numbers as words.

    The address pattern starts at the edge of a run of non-blanks, so long runs without ``@`` cost
    one pass and not one per character.
    """
    out = F.lower(text_or_empty(c))
    # Patterns and words that the published models were fitted with. Few texts have what they start from, and a
    # search for that is far cheaper than a pattern tried at every character.
    out = _replaced(out, lambda x: x.contains("http") | x.contains("www."), r"(?U)http\S+|www\.\S+", " url ")
    out = _replaced(out, lambda x: x.contains("@"), r"(?U)(?<!\S)\S+@\S+", " email ")
    out = _replaced(out, lambda x: x.rlike(r"(?U)\d[\d\s\-().]{6}"), r"(?U)\b\d[\d\s\-().]{6,}\d\b", " phone ")
    out = F.regexp_replace(out, r"[^a-z]+", " ")
    if strip_routing:
        out = F.regexp_replace(out, r"\b(" + "|".join(ROUTING_WORDS) + r")\b", " ")
        out = F.regexp_replace(out, r" +", " ")
    return F.trim(out)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def split_message(c) -> Column:
    """``[header block, body]`` cut at the first blank line; one element where there is none."""
    return F.split(text_or_empty(c), r"\r?\n\r?\n", 2)


def header_block(c) -> Column:
    return F.get(F.split(text_or_empty(c), r"\n\n|\r\n\r\n", 2), F.lit(0))


def body_of(c, max_chars: int | None = None) -> Column:
    body = strip(F.coalesce(F.get(split_message(c), F.lit(1)), F.lit("")))
    return truncate(body, max_chars)


def subject_of(c) -> Column:
    head = F.get(split_message(c), F.lit(0))
    return strip(F.regexp_extract(head, r"(?im)^Subject:[^\S\r\n]?(.*)$", 1))


def truncate(c: Column, max_chars: int | None) -> Column:
    return c if max_chars is None else F.substring(c, 1, max_chars)


def join_text(subject, body) -> Column:
    return F.concat(text_or_empty(subject), F.lit(" "), text_or_empty(body))


def folder_of(path) -> Column:
    """Second path segment, lowered and trimmed; null where the path has no second segment."""
    c = F.col(path) if isinstance(path, str) else path
    return strip(F.lower(F.get(F.split(strip(c), "/"), F.lit(1))))


def tidy_plain_text(c) -> Column:
    out = F.regexp_replace(text_or_empty(c), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t]+(?=\n|\z)", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


def snippet(c, max_chars: int) -> Column:
    return F.substring(F.regexp_replace(text_or_empty(c), r"\r\n|\n", " "), 1, max_chars)


def content_key(c, seed: str | int | None = None) -> Column:
    """Hash of a text or key; with a seed it gives a repeatable random order."""
    c = F.col(c) if isinstance(c, str) else c
    if seed is None:
        return F.md5(c.cast("string"))
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))
