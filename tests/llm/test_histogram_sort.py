import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mailtriage.llm import histogram_sort as H
from tests.llm.conftest import ODD, texts


def rows_of(df, **kw):
    got = H.shard_by_bytes(df, **kw).collect()
    slots = defaultdict(list)
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 1 and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def test_odd_rows(odd, none):
    got = rows_of(odd.drop("size", "shard", "slot"))
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in ODD)
    assert all(r.score == "own score" for r in got)
    assert H.shard_by_bytes(none).count() == 0


@pytest.mark.parametrize("share", [0, 3])
def test_bytes_are_near_equal_even_with_one_large_group(spark, share):
    rows = [(i, "copied text " * 5 if share and i % share == 0 else f"text {i} " * (1 + i % 17)) for i in range(20_000)]
    got = rows_of(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    total, sizes = sum(r["size"] for r in got), Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    largest = max(r["size"] for r in got)
    assert len(sizes) == 16
    assert all(abs(s - total / 16) <= 2 * (H.TOLERANCE * total / 16 + largest) for s in sizes.values())


def test_equal_texts_are_neighbours(spark):
    rows = [(i, f"text {i % 40}") for i in range(2000)]
    got = sorted(rows_of(spark.createDataFrame(rows, "doc_id bigint, text string")), key=lambda r: (r.shard, r.slot))
    runs = sum(a.text != b.text for a, b in zip(got, got[1:]))
    assert runs == 39


def test_splitters_count_exactly(spark):
    rows = [(i, "x" * (i % 50)) for i in range(5000)]
    keys = spark.createDataFrame(rows, "doc_id bigint, text string").select(*H._key_columns(), H.size_of().alias("size"))
    splitters, size, below = H.find_splitters(keys, 32, 16)
    local = sorted((int.from_bytes(H._key_bytes([__import__("numpy").array([x], "int64") for x in (r.k0, r.k1, r.k2)]).tobytes().ljust(24, b"\0"), "big"), r["size"]) for r in keys.collect())
    for s, z, n in zip(splitters, size, below):
        assert n == sum(k < s for k, _ in local) and z == sum(v for k, v in local if k < s)
