import hashlib
import random
from fractions import Fraction

import numpy as np
from hypothesis import given, settings, strategies as st

from mailtriage.llm import periodic_runs as P
from tests.llm.conftest import texts


def brute(x):
    """Every lag over every word; a stretch counts where no shorter lag fits it."""
    found = []
    for q in range(1, len(x) // 3 + 1):
        k = 0
        while k < len(x) - q:
            s = k
            while k < len(x) - q and x[k] == x[k + q]:
                k += 1
            e = k + q
            if e - s >= max(24, 3 * q) and not any(x[s:e - d] == x[s + d:e] for d in range(1, q)):
                found.append((s, e - s, q))
            k += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def found_in(lists):
    return P.runs_of([np.array(x, np.int64) for x in lists])


block = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=30), st.integers(1, 30), st.integers(0, 29))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(block, max_size=6), min_size=1, max_size=4))
def test_runs_equal_brute_force(given_texts):
    lists = [[w for words, times, cut in parts for w in (words * times)[:max(1, len(words) * times - cut)]] for parts in given_texts]
    assert found_in(lists) == [brute(x) for x in lists]


def test_long_periods_at_every_scale():
    rng = random.Random(5)
    for q in [*range(1, 30), 40, 41, 60, 61, 90, 91, 135, 136, 250]:
        for length in (3 * q - 1, 3 * q, 3 * q + 1, 4 * q + q // 2):
            unit = [rng.randrange(1000) for _ in range(q)]
            x = [2000, 2001, *(unit * 5)[:length], 2002]
            assert found_in([x]) == [brute(x)], (q, length)


def test_hard_words():
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    thue_morse = [bin(i).count("1") % 2 for i in range(500)]
    nested = ([0] * 30 + [1]) * 9
    lists = [b, thue_morse, nested, [0] * 700, [], [1], list(range(50)) * 7]
    assert found_in(lists) == [brute(x) for x in lists]


def test_runs_never_cross_texts():
    unit = list(range(12))
    assert found_in([unit * 2, unit * 2, unit * 2]) == [[], [], []]


def brute_row(doc_id, text, change=None):
    words = text.encode().split()
    if change:
        words = change(doc_id, words)
    runs = brute(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


def key(r):
    return str(r)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 6000")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    got = P.with_runs(docs, P.planted).drop("runs").collect()
    want = [brute_row(i, t, P.planted) for i, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r[1] for r in want) > 5


def test_planted_words_follow_the_rule():
    import zlib

    for doc_id in range(400):
        words = [b"%d" % i for i in range(doc_id % 90)]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        got = P.planted(doc_id, words)
        if h % 10 or not n:
            assert got == words
        else:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert got == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_odd_rows(odd, none):
    got = P.with_runs(odd).collect()
    assert len(got) == odd.count()
    # The long text repeats its first 977 numbers; brute force is too slow for it.
    small = [(i, t) for i, t in texts() if len(t) < 1000]
    assert sorted((tuple(r)[:8] for r in got if r.doc_id not in (6, 7)), key=key) == sorted((brute_row(i, t) for i, t in small), key=key)
    period = 977 * 5
    assert {tuple(r)[1:6] for r in got if r.doc_id in (6, 7)} == {(1, 0, 200_000, period, 1000 * 200_000 // period)}
    assert P.with_runs(none).count() == 0


def test_kept_words_drop_what_any_run_drops():
    assert P.kept_words(8, [(0, 6, 2), (4, 3, 1)]).tolist() == [True, True, False, False, False, False, False, True]
