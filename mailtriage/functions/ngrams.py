"""Word and character n-grams of cleaned text, and their counts inside the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from mailtriage.functions.text import let


def tokens(clean: Column, stop_words: Sequence[str] = (), min_chars: int = 2) -> Column:
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else None
    out = F.filter(F.split(clean, " "), lambda t: F.length(t) >= min_chars)
    return out if stop is None else F.filter(out, lambda t: ~t.isin(list(stop_words)))


def word_ngrams(clean: Column, min_n: int = 1, max_n: int = 2, stop_words: Sequence[str] = ()) -> Column:
    """N-grams over the tokens that remain once stop words are gone, shorter ones first."""

    def of_size(ts, n):
        if n == 1:
            return ts
        # Every start position, joined with the tokens after it.
        starts = F.slice(ts, F.lit(1), F.greatest(F.size(ts) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda t, i: F.concat_ws(" ", t, *[F.get(ts, i + d) for d in range(1, n)]))

    def grams(ts):
        return F.concat(*[of_size(ts, n) for n in range(min_n, max_n + 1)])

    return let(tokens(clean, stop_words), grams)


def char_wb_ngrams(clean: Column, min_n: int = 3, max_n: int = 5) -> Column:
    """Character n-grams inside words padded by one blank, as a bag: by length, then by position.

    Cleaned text has single blanks, so a window of the blank-edged text lies in one padded word when
    only its first or last character is a blank. A look-ahead finds overlapping windows in one pass
    of the regex engine, without a lambda per character.
    """
    edged = F.concat(F.lit(" "), clean, F.lit(" "))
    sizes = [
        F.regexp_extract_all(edged, F.lit(f"(?=([ a-z][a-z]{{{n - 2}}}[ a-z]))"), 1) for n in range(max(min_n, 3), max_n + 1)
    ]
    return F.concat(*sizes)


def term_counts(grams: Column) -> Column:
    """``array<struct<term, tf>>`` of one row, counted inside the row.

    The grams are sorted and runs are measured, so no shuffle on (document, term) is needed.
    """

    def runs(s):
        n = F.size(s)
        starts = F.filter(
            F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"), (F.coalesce(F.get(st, j + 1), n) - p).alias("tf")
                ),
            ),
        )

    return let(F.sort_array(grams), runs)
