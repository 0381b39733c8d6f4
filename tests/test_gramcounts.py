"""N-grams counted by Arrow batches, against counts gram by gram."""

import random
from collections import Counter
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest

from mailtriage.functions import gramcounts as G
from mailtriage.operators import vocab as VO


def grams(text, spec):
    if spec.analyzer == "word":
        ts = [t for t in text.split(" ") if len(t) >= 2 and t not in spec.stop_words]
        return [" ".join(ts[i:i + n]) for n in range(spec.min_n, spec.max_n + 1) for i in range(len(ts) - n + 1)]
    words = [f" {w} " for w in text.split()]
    return [w[i:i + n] for w in words for n in range(spec.min_n, spec.max_n + 1) for i in range(len(w) - n + 1)]


def texts():
    rng = random.Random(4)
    words = ["the", "a", "ab", "abc", "abcd", "zebra", "zz", "of"]
    return ["", "a", "the", "ab ab ab"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(60)]


SPECS = [VO.word_spec(9, 1, ("the", "of")), VO.GramSpec("word", 1, 3, 1, 9), VO.GramSpec("word", 2, 2, 1, 9), VO.char_spec(9), VO.GramSpec("char", 3, 4, 1, 9, "char_wb")]


@pytest.mark.parametrize("spec", SPECS)
@pytest.mark.parametrize("limit", [1, 100, 1 << 20])
def test_counts_of_batches(spec, limit):
    tf, df = Counter(), Counter()
    with mock.patch.object(G.chunks, "__defaults__", (limit,)):
        for term, n, d in G.counted_terms(texts(), spec):
            assert len(set(term.to_pylist())) == len(term)
            tf.update(dict(zip(term.to_pylist(), map(int, n))))
            df.update(dict(zip(term.to_pylist(), map(int, d))))
        assert tf == sum((Counter(grams(t, spec)) for t in texts()), Counter())
        assert df == sum((Counter(set(grams(t, spec))) for t in texts()), Counter())
        # Every other term, and one that never occurs, are known.
        known = sorted([*sorted(tf)[::2], "qqq"])
        got = G.counts_function(spec, known, None)(pa.array([None, *texts()], pa.string())).to_pylist()
    for t, row in zip(["", *texts()], got):
        want = Counter(g for g in grams(t, spec) if g in known)
        assert row["idx"] == sorted(row["idx"]) and {known[i]: n for i, n in zip(row["idx"], row["val"])} == want


def test_char_grams_in_order_and_other_characters():
    spec = VO.char_spec(9)
    odd = [None, "", "ab", "abc de", "xéy ab1cd", "tab\there"]
    got = G.sorted_char_grams(3, 5)(pa.array(odd, pa.string())).to_pylist()
    assert got[0] is None and got[1] == [] and got[2] == [" ab", " ab ", "ab "] and got[3] == sorted(grams("abc de", spec))
    # A window with a character outside a to z is no gram.
    assert got[4] == sorted([" ab", "cd "]) and got[5] == sorted(["tab", " ta", " tab", "her", "ere", "re ", "here", "ere ", "here "])


def test_a_batch_of_many_texts_is_counted_in_bounded_parts():
    parts = list(G.chunks(["x" * 10] * 50, 100))
    assert [len(p) for p in parts] == [10] * 5 and list(G.chunks([])) == [] and list(G.chunks(["y" * 500, "z"], 100)) == [["y" * 500], ["z"]]


def test_known_terms_of_an_empty_batch():
    for spec in SPECS:
        out = G.counts_function(spec, ["abc"], np.ones(1))(pa.array([], pa.string()))
        assert len(out) == 0


def test_threads_ship_the_package_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    from mailtriage.session import ship

    sc, was = spark.sparkContext, getattr(spark.sparkContext, "_mailtriage_shipped", False)
    sent = []
    sc._mailtriage_shipped = False
    try:
        with mock.patch.object(type(sc), "addPyFile", lambda self, path: sent.append(path)), ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda _: ship(spark), range(8)))
        assert len(sent) == 1
    finally:
        sc._mailtriage_shipped = was


@pytest.mark.parametrize("spec", SPECS)
def test_task_sends_a_term_once(spec):
    """Over several batches a task sums each term; before, every batch sent its own row."""
    batches = [pa.RecordBatch.from_arrays([pa.array([k % 2 for k in range(4)]), pa.array([*texts()[4 * i:4 * i + 3], None], pa.string())], ["g", "clean"]) for i in range(15)]
    per_group = {0: [], 1: []}
    for b in batches:
        for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            per_group[g] += [] if t is None else [t]
    rows = [r for b in G.term_rows(spec, ["g"], "clean")(iter(batches)) for r in b.to_pylist()]
    assert len({(r["g"], r["term"]) for r in rows}) == len(rows)
    for g, seen in per_group.items():
        assert {r["term"]: r["tf"] for r in rows if r["g"] == g} == sum((Counter(grams(t, spec)) for t in seen), Counter())
        assert {r["term"]: r["df"] for r in rows if r["g"] == g} == sum((Counter(set(grams(t, spec))) for t in seen), Counter())
    with mock.patch.object(G, "HELD_TERMS", 8):
        parts = [r for b in G.term_rows(spec, [], "clean")(iter(b.select(["clean"]) for b in batches)) for r in b.to_pylist()]
    tf = Counter()
    for r in parts:
        tf[r["term"]] += r["tf"]
    assert tf == sum((Counter(grams(t, spec)) for seen in per_group.values() for t in seen), Counter())


def test_long_character_grams():
    """Numbers of grams this long leave no room for the row beside them."""
    spec = VO.GramSpec("char", 3, 12, 1, 9, "char_wb")
    got = {t: (int(n), int(d)) for term, tf, df in G.counted_terms(texts(), spec) for t, n, d in zip(term.to_pylist(), tf, df)}
    assert {t: n for t, (n, _) in got.items()} == sum((Counter(grams(t, spec)) for t in texts()), Counter())
    assert {t: d for t, (_, d) in got.items()} == sum((Counter(set(grams(t, spec))) for t in texts()), Counter())


@pytest.mark.parametrize("size", [3, 40, 5_000])
def test_rare_pairs_are_left_out_and_the_vocabulary_stays_the_same(spark, monkeypatch, size):
    from pyspark.sql import functions as F

    rng = random.Random(size)
    # Frequent words, rare ones, pairs that stand together always, and counts that many terms have.
    words = [f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(150)]
    rows = [None, "", "the", "zz zz zz"]
    for _ in range(500):
        text = [words[min(149, int(rng.expovariate(0.05)))] for _ in range(rng.randrange(25))]
        rows.append(" ".join(text + ["new york"] * rng.randrange(3) + ["the", "end"]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, clean string").repartition(4, "id")
    spec = VO.word_spec(size, 2, ("the",))
    n = df.agg(F.count("*").alias("n_docs"))
    whole = VO.term_table(df, "clean", spec)
    want = [tuple(r) for r in VO.vocabulary(whole, n, spec).orderBy("idx").collect()]
    needed = VO.needed_terms(df, "clean", spec)
    assert [tuple(r) for r in VO.vocabulary(needed, n, spec).orderBy("idx").collect()] == want
    assert size > len(words) or any(" " in r[0] for r in want) or size < 10
    if size < 100:
        # What is counted is right, and rare pairs are not among it.
        assert needed.exceptAll(whole).count() == 0 and needed.count() < whole.count() / 2


def test_hashes_of_tokens_depend_on_their_bytes_alone():
    tokens = ["ab", "", "ba", "abc", "a", "ab" * 40]
    hashes = G.token_hashes(pa.array(tokens))
    assert len(set(hashes.tolist())) == len(tokens)
    assert G.token_hashes(pa.array(["q", *reversed(tokens)])[1:]).tolist() == hashes.tolist()[::-1]
    assert G.token_hashes(pa.array([], pa.string())).tolist() == [] and G.token_hashes(pa.array([""])).tolist() == [0]
