import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailtriage.llm import maxscore as M

NAN, INF = float("nan"), float("inf")


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    clip = lambda x: max(-2 ** 63, min(2 ** 63 - 1, x))
    for q, a in {i: v for i, v in sorted(ok, reverse=True) if i % 50 == 0}.items():
        best = sorted((-clip(sum(x * y for x, y in zip(a, b))), i) for i, b in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(parts).withColumnRenamed("none", "none")
    df = df.select("vec_id", M.quantised().alias("ints"))
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in M.top_k(df, df.filter("vec_id % 50 = 0"), **kw).collect())


@pytest.mark.parametrize("dims, kind", [(64, "normal"), (5, "ties"), (40, "sparse"), (8, "negative"), (3, "huge")])
def test_against_brute_force(spark, dims, kind):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(400, dims))
    if kind == "ties":
        x = rng.integers(-1, 2, size=(400, dims)) / 2
    if kind == "sparse":
        x = x * (rng.random((400, dims)) < 0.1)
    if kind == "negative":
        x = -abs(x)
        x[::50] *= -1
    if kind == "huge":
        x = x * 2e5
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    assert run(spark, rows, query_block=3, shard_rows=37) == brute(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (1, None), (2, [1.0, None]), (3, [NAN, 1.0]), (4, [INF, 1.0]), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (100, None), (150, [0.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, shard_rows=1) == brute(rows)


def test_repeated_query_ids_and_huge_components(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [5.0, 1.0]), (2, [1.0, 5.0]), (50, [1e16, -1e16]), (3, [1e16, 1e16]), (4, [-1e16, 1e16]), (5, [3e15, 1.0])]
    got = run(spark, rows)
    assert got == brute(rows) and {q for q, *_ in got} == {0, 50}
    assert run(spark, rows, shard_rows=1) == brute(rows)
    assert len(run(spark, [(0, [1e300, 1.0]), (1, [1e300, -1e300]), (2, [-1e300])])) == 2


def test_clashing_columns(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id bigint, embedding array<double>").select(
        "vec_id", M.quantised().alias("ints"), *[F.lit("own").alias(c) for c in ("query_id", "rank", "score", "block")])
    assert [(r.query_id, r.vec_id) for r in M.top_k(df, df.filter("vec_id = 0")).orderBy("rank").collect()] == [(0, 2), (0, 1)]


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == [] and run(spark, [(1, [1.0])]) == []
