import numpy as np
import pytest
from pyspark.sql import functions as F

from mailtriage.functions.sparse import ml_vector
from mailtriage.models import linear as LM, personal as P, solver
from mailtriage.session import work_path
from mailtriage.sources.sinks import write_training_matrix


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(300):
        x = rng.normal(size=4)
        y = int(np.argmax([x[0] + rng.normal(), x[1] + rng.normal(), x[2] + rng.normal()]))
        data.append((i, [0, 1, 2, 3], x.tolist(), "abc"[y], float(x[0] * 0.5 - x[3] * 0.2 + rng.normal() * 0.1)))
    return data, spark.createDataFrame(data, "id long, indices array<int>, values array<double>, y string, t double")


def matrix(spark, df, *keep):
    m = df.select(*keep, ml_vector(F.lit(4), F.col("indices"), F.col("values")).alias("features"))
    return write_training_matrix(m, work_path(spark, "test-matrix"))


def dense(data):
    return solver.Rows([r[1] for r in data], [r[2] for r in data], 4)


def test_spark_fit_equals_local_fit(spark, rows):
    data, df = rows
    ml = LM.fit_logistic(matrix(spark, df, "y"), "y", 2.0)
    y = np.array(["abc".index(r[3]) for r in data])
    coef, _ = solver.fit_classes(dense(data), y, solver.balanced(y, 3), 3, 2.0)
    assert np.allclose(ml.coefficients - ml.coefficients.mean(0), coef - coef.mean(0), atol=1e-3)
    grad = LM.objective_gradient(df, ml, "y", 2.0).collect()
    assert max(r.max_gradient for r in grad) < 1e-2


def test_binary_fit(spark, rows):
    data, df = rows
    df = df.withColumn("y", (F.col("y") == "a").cast("int"))
    ml = LM.fit_logistic(matrix(spark, df, "y"), "y", 1.0, classes=[0, 1])
    y = np.array([int(r[3] == "a") for r in data])
    coef, b = solver.fit_classes(dense(data), y, solver.balanced(y, 2), 2, 1.0)
    assert np.allclose(ml.coefficients, coef, atol=1e-3) and np.allclose(ml.intercepts, b, atol=1e-3)


def test_ridge_closed_form(spark, rows):
    data, df = rows
    X, t = np.array([r[2] for r in data]), np.array([r[4] for r in data])
    Xc, tc = X - X.mean(0), t - t.mean()
    want = np.linalg.solve(Xc.T @ Xc + 5 * np.eye(4), Xc.T @ tc)
    assert np.allclose(LM.fit_ridge(matrix(spark, df, "t"), "t", 5.0).coefficients[0], want, atol=1e-5)


def test_a_search_without_end_raises(spark, rows):
    m = matrix(spark, rows[1], "y")
    with pytest.raises(RuntimeError, match="not converged"):
        LM.fit_logistic(m, "y", 2.0, max_iter=2)


def test_fit_of_many_rows(spark):
    """More rows than any local bound: the same path, and the slope that the data have."""
    df = spark.range(30_000).select(
        F.array(F.lit(0)).alias("indices"), F.array(F.randn(3)).alias("values")).withColumn("y", (F.get("values", F.lit(0)) + F.randn(4) > 0).cast("int"))
    m = write_training_matrix(df.select("y", ml_vector(F.lit(1), F.col("indices"), F.col("values")).alias("features")), work_path(spark, "many"))
    got = LM.fit_logistic(m, "y", 1.0, classes=[0, 1])
    assert 1.5 < got.coefficients[0][0] < 1.9 and abs(got.intercepts[0]) < 0.1


def test_row_probabilities(spark, rows):
    data, df = rows
    m = LM.fit_logistic(matrix(spark, df, "y"), "y", 2.0)
    z = np.array([r[2] for r in data]) @ m.coefficients.T + m.intercepts
    want = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    got = np.array([r.p for r in df.orderBy("id").select(m.probabilities().alias("p")).collect()])
    assert np.allclose(got, want)


def test_solver_with_empty_rows():
    r = solver.Rows([[], [0], []], [[], [1.0], []], 2)
    assert r.times(np.array([2.0, 3.0])).tolist() == [0.0, 2.0, 0.0]
    coef, b = solver.fit_classes(r, np.array([0, 1, 0]), np.ones(3), 2, 100.0)
    assert solver.predict(r, coef, b).tolist() == [0, 1, 0]


def personal_inputs(spark, df):
    base = df.select("indices", "values", F.col("y").alias("cat")).limit(120)
    gate = df.orderBy(F.desc("id")).select("indices", "values", F.col("y").alias("cat")).limit(60)
    corr = df.filter("id < 12").select(
        F.lit(7).cast("long").alias("user_id"), F.lit("category").alias("model"), F.col("id").alias("event_id"), F.col("id").alias("created_at"),
        F.when(F.col("id") < 6, "mine").otherwise(F.col("y")).alias("corrected_label"), "indices", "values")
    return corr, base, gate


def test_a_fit_reads_the_newest_corrections_and_accuracy_all(spark, rows):
    _, df = rows
    corr, base, gate = personal_inputs(spark, df)
    labels = {"category": "cat"}
    a = P.refit(corr, base, gate, labels, 4).first()
    b = P.refit(corr, base, gate, labels, 4, fit_rows=5).first()
    assert a.classes == ["a", "b", "c", "mine"] and b.classes == ["a", "b", "c"]
    assert a.n_corrections == b.n_corrections == 12 and b.own_accuracy <= 0.5
    x, z = np.array(a.coefficients).reshape(4, 4), np.array(a.intercepts)
    part = corr.collect()
    got = [a.classes[int(np.argmax(x @ np.array(r["values"]) + z))] == r.corrected_label for r in part]
    assert abs(a.own_accuracy - np.mean(got)) < 1e-9


def test_sweep_reports_each_weight(spark, rows):
    _, df = rows
    corr, base, gate = personal_inputs(spark, df)
    split = corr.withColumn("half", (F.col("event_id") % 2).cast("int"))
    got = P.weight_sweep(split, base, gate, {"category": "cat"}, 4).collect()
    assert [r.weight for r in got] == [1.0, 3.0, 10.0, 30.0] and {(r.n_train, r.n_test) for r in got} == {(6, 6)}


def test_a_fit_of_thousands_of_rows_runs_in_several_tasks(spark):
    rows = spark.range(20_000, numPartitions=64)
    cores = spark.sparkContext.defaultParallelism
    parts = lambda n: LM.fit_partitions(rows, n).rdd.getNumPartitions()
    assert parts(500) == 1 and parts(4_000) == min(4, cores) and parts(10 ** 9) == cores


def test_gold_parses_labelled_messages_only(spark, sf):
    from mailtriage.plans import modelling as M

    wanted = M.targets(spark, sf).select("msg_id")
    some = wanted.orderBy("msg_id").limit(7)
    got = M.messages(spark, sf, some)
    whole = M.messages(spark, sf).join(some, "msg_id", "left_semi")
    assert got.count() == 7 and got.exceptAll(whole).isEmpty()


def test_majority_of_a_balanced_fit(spark):
    from mailtriage.plans.modelling import at_least_majority

    def verdict(rows):
        return at_least_majority(spark.createDataFrame(rows, "label string, got string"), "label", "got").first()[0]

    # Five of eight and two of two: 7 rows of 10, under the 8 of the largest class, but 0.81 of the balanced weight.
    assert verdict([("a", "a")] * 5 + [("a", "b")] * 3 + [("b", "b")] * 2) == 1
    # Seven of eight and none of two.
    assert verdict([("a", "a")] * 7 + [("a", "b")] + [("b", "a")] * 2) == 0
    assert verdict([("a", "a")] * 8 + [("b", "a")] * 2) == 1
