"""Forests grown inside tasks against those that Spark grows level by level, and dense against sparse rows of small fits."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailtriage.models import forest_rows as R, group_forest as G, solver
from tests.test_group_forest import CLASSES, DIM, labels_by_hand, table


def test_equal_to_the_forests_of_spark(spark):
    trees, depth, take = 4, 3, 2
    rows = table(spark)
    cuts = G.cut_points(rows.select(F.array(*[F.lit(i) for i in range(DIM)]).alias("indices"), F.col("x").alias("values")), DIM)
    want = {r.group.user_id: r for r in G.grow(rows, CLASSES, cuts, trees, depth, take, 7).collect()}
    choices = G.node_choices(spark, DIM, trees, depth, take, 7)
    drawn = rows.select("group.user_id", "y", "w", G.binned(cuts, F.col("x")).alias("bins"), G.draws(trees, F.col("row"), 7).alias("boot")).toPandas()
    for user, part in drawn.groupby("user_id"):
        bins, boot = np.array(part["bins"].tolist()), np.array(part["boot"].tolist())
        levels, weights = R.grown(bins, part["y"].to_numpy(), boot * part["w"].to_numpy()[:, None], choices, CLASSES, max(map(len, cuts)) + 1, depth)
        nested = R.levels_array([levels])
        as_rows = [[None if t is None else [(n.feature, n.bin, n["rank"], n["counts"]) for n in t] for t in level] for level in want[user].levels]
        got = [[None if t is None else [(n["feature"], n["bin"], n["rank"], n["counts"]) for n in t] for t in level] for level in nested[0].as_py()]
        assert got == as_rows and list(weights) == want[user].weights
        classes = R.Forests(pa.concat_arrays([nested, nested]).slice(1)).classes(0, weights, bins)
        assert classes.tolist() == [labels_by_hand(as_rows, weights, b) for b in bins]


def test_dense_rows_give_the_fit_of_sparse_ones():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5)) * [0.1, 1, 5, 1, 1]
    y = (x[:, :3] + rng.normal(size=(200, 3))).argmax(axis=1)
    sparse, weight = solver.Rows([list(range(5))] * 200, x.tolist(), 5), solver.balanced(y, 3)
    for got, want in zip(solver.fit_classes(solver.DenseRows(x), y, weight, 3, 2.0), solver.fit_classes(sparse, y, weight, 3, 2.0)):
        assert np.allclose(got, want, atol=1e-5)
