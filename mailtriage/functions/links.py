"""Links in plain text: extraction, short labels, rewriting. Display only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailtriage.constants import MAX_LINK_LABEL
from mailtriage.functions.text import let, text_or_empty

# A link without the sentence punctuation after it.
LINK = r"""https?://(?:[^\s<>"'`]*[^\s<>"'`.,;:!?)\]}])?"""
PARTS = r"^https?://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)(.*)$"


def extract_links(c) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(f"({LINK})"), 1)


def short_label(href: Column) -> Column:
    """Host and path, at most 36 characters; an ellipsis marks what was dropped."""
    host = F.regexp_replace(F.lower(F.regexp_extract(href, PARTS, 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(href, PARTS, 2), r"/+$", "")
    dropped = F.regexp_extract(href, PARTS, 3).rlike(r"^\?[^#]|#.")
    label = F.when(href.rlike(PARTS), F.concat(host, path)).otherwise(href)
    return (
        F.when(F.length(label) > MAX_LINK_LABEL,
               F.concat(F.substring(label, 1, MAX_LINK_LABEL - 1), F.lit("…")))
        .when(href.rlike(PARTS) & dropped, F.concat(label, F.lit("…")))
        .otherwise(label)
    )


def with_short_links(c) -> Column:
    """The text with each link replaced by its short label."""
    text = text_or_empty(c)
    labels = F.transform(extract_links(text), short_label)
    pieces = F.split(text, LINK, -1)
    return let(
        labels,
        lambda ls: F.array_join(
            F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(ls, i), F.lit("")))), ""
        ),
    )
