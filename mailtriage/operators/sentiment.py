"""Lexicon sentiment of cleaned text.

Cleaned text has no case and no punctuation, so only word valences, negations and degree words act.
The lexicon is an input table. ``compound`` joins it; ``compound_in_row`` has it as a constant of the plan, with no shuffle and
no aggregation, which a stream needs. Over tables the join is faster: its lookups are compiled, those of lambdas are not.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mailtriage import constants as K
from mailtriage.functions.ngrams import tokens
from mailtriage.functions.text import let


# Terms that a constant lexicon may have.
LEXICON_TERMS = 20_000


def bounded_lexicon(lexicon: DataFrame, bound: int = LEXICON_TERMS) -> list[tuple[str, float]] | None:
    """The terms and valences, or None where there are more than ``bound``."""
    rows = lexicon.select("term", F.col("valence").cast("double")).limit(bound + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= bound else None


def _context(ts: Column) -> Column:
    """Each word with its three predecessors."""
    return F.transform(ts, lambda t, i: F.struct(t.alias("term"), *[F.when(i >= d, F.get(ts, i - d)).alias(f"p{d}") for d in (1, 2, 3)]))


def _acting(v: Column, before: list[Column], modifiers: bool, negations: Sequence[str], up: Sequence[str], down: Sequence[str]) -> Column:
    """A word's valence after the negation and degree words before it."""
    if not modifiers:
        return v
    sign, negated = F.signum(v), F.lit(False)
    for p, damp in zip(before, K.BOOSTER_DAMP):
        step = F.when(p.isin(*up), K.BOOSTER_STEP * damp).when(p.isin(*down), -K.BOOSTER_STEP * damp).otherwise(0.0)
        v, negated = v + sign * step, negated | F.coalesce(p.isin(*negations), F.lit(False))
    return F.when(negated, v * K.NEGATION_SCALAR).otherwise(v)


def _normalised(s: Column) -> Column:
    return s / F.sqrt(s * s + K.NORMALISER_ALPHA)


def _looked_up(table: dict[str, float], term: Column) -> Column:
    """The valence of a term, null where it has none, by a few probes of hash sets.

    Spark searches a map from its start. Here the number of the valence among the distinct ones is put together bit by bit:
    one constant set per bit holds the terms whose number has it.
    """
    values = sorted(set(table.values()))
    number = {v: i + 1 for i, v in enumerate(values)}
    bits = [F.when(term.isin(*[t for t, v in table.items() if number[v] >> b & 1]), 1 << b).otherwise(0) for b in range(len(values).bit_length())]
    valences = F.split(F.lit(",".join(["", *map(repr, values)])), ",").try_cast("array<double>")
    return F.get(valences, reduce(lambda x, y: x + y, bits))


def compound_in_row(clean: Column, terms: Sequence[tuple[str, float]], modifiers: bool = True, negations: Sequence[str] = K.NEGATIONS,
                    up: Sequence[str] = K.BOOSTERS_UP, down: Sequence[str] = K.BOOSTERS_DOWN) -> Column:
    """The score as an expression over the text; a term that the lexicon lists more than once counts with each of its valences.

    A hash set of terms keeps the few words that act; only these are looked up.
    """
    if not terms:
        return F.lit(0.0)
    # One table per place that a term has in the list: nearly always one.
    tables: list[dict[str, float]] = []
    for term, v in terms:
        free = next((t for t in tables if term not in t), None)
        if free is None:
            tables.append(free := {})
        free[term] = v

    def value(w):
        before = [w[f"p{d}"] for d in (1, 2, 3)]
        acting = [F.coalesce(let(_looked_up(t, w["term"]), lambda v: _acting(v, before, modifiers, negations, up, down)), F.lit(0.0)) for t in tables]
        return reduce(lambda a, b: a + b, acting)

    hits = F.filter(let(tokens(clean, min_chars=1), _context), lambda w: w["term"].isin(*tables[0]))
    return F.coalesce(let(F.aggregate(hits, F.lit(0.0), lambda a, w: a + value(w)), _normalised), F.lit(0.0))


def compound(df: DataFrame, key: str, clean: str, lexicon: DataFrame, modifiers: bool = True,
             negations: Sequence[str] = K.NEGATIONS, up: Sequence[str] = K.BOOSTERS_UP,
             down: Sequence[str] = K.BOOSTERS_DOWN, bound: int = 0) -> DataFrame:
    """``key, compound`` for every row; 0 where no word is in the lexicon.

    Each word takes its three predecessors along from its own row and joins the lexicon; sums are partial before the
    exchange. With a lexicon of at most ``bound`` terms (none unless asked for) one narrow projection instead.
    """
    terms = bounded_lexicon(lexicon, bound) if bound else None
    if terms is not None:
        return df.select(key, compound_in_row(F.col(clean), terms, modifiers, negations, up, down).alias("compound"))
    words = df.select(key, F.explode(let(tokens(F.col(clean), min_chars=1), _context)).alias("w")).select(key, "w.*")
    hits = words.join(lexicon.select("term", "valence"), "term")
    v = _acting(F.col("valence"), [F.col(f"p{d}") for d in (1, 2, 3)], modifiers, negations, up, down)
    sums = hits.groupBy(key).agg(F.sum(v).alias("_s"))
    return df.select(key).join(sums, key, "left").select(key, F.coalesce(_normalised(F.col("_s")), F.lit(0.0)).alias("compound"))
