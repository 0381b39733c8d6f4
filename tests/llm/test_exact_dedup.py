import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from mailtriage.llm import exact_dedup as X
from tests.llm.conftest import texts


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), min_size=1, max_size=200))
def test_golomb_round_trip(values):
    given_values = np.array(sorted(values), np.uint64)
    rice, payload = X.golomb_encode(given_values)
    assert np.array_equal(X.golomb_decode(len(given_values), rice, payload), given_values)


def test_golomb_is_short():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 36, 10_000).astype(np.uint64))
    assert len(X.golomb_encode(values)[1]) * 8 < 26 * len(values)


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), len(groups)


def check(df, rows, **kw):
    got = X.exact_groups(df, **kw).collect()
    want, groups = brute(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_odd_rows(odd):
    check(odd, texts(), block_rows=2)
    check(odd, texts())


def test_many_blocks_and_one_large_group(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), rows, block_rows=100)


def test_one_row_per_group_stays_with_its_columns(odd, none):
    kept = X.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    assert kept.count() == brute(texts())[1]
    assert X.exact_groups(none).count() == X.drop_exact_duplicates(none).count() == 0
