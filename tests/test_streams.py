import pandas as pd
from pyspark.sql import functions as F

from mailtriage.operators import corrections as C
from mailtriage.plans import streams as Q
from mailtriage.plans.personalisation import current
from mailtriage.session import work_path
from mailtriage.sources import tables as V
from mailtriage.streaming import streams as R


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_stream_sessions_equal_batch(spark, sf):
    assert rows(Q.r6s(spark, sf)) == rows(Q.r6(spark, sf))


def test_session_gap_edges(spark):
    ts = ["10:00:00", "10:29:59", "10:59:59", "11:00:00", "09:00:00"]
    df = spark.createDataFrame([(1, f"2024-01-01 {t}") for t in ts], "u long, t string").withColumn("ts", F.col("t").cast("timestamp"))
    want = df.groupBy("u", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n")).select("u", "s.start", "s.end", "n")
    got = R.sessions_batch(df, "u", "ts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 2


def test_upsert_is_idempotent(spark, sf):
    root = work_path(spark, "upsert-test")
    sink = R.correction_sink(root)
    f = V.feedback(spark, sf).drop("event_type")
    early, late = f.filter("event_id % 2 = 0"), f.filter("event_id % 2 = 1")
    for batch, i in ((early, 0), (late, 1), (late, 1)):
        sink(batch, i)
    want = rows(current(spark, sf))
    assert rows(R.read_corrections(spark, root)) == want
    R.compact_corrections(spark, root, f"{root}-compacted")
    assert rows(R.read_corrections(spark, f"{root}-compacted")) == want


class State:
    exists, get = False, None

    def update(self, v):
        self.exists, self.get = True, v


def test_trigger_state():
    step, state = R.count_to_threshold(5), State()
    frame = lambda n: iter([pd.DataFrame({"message_id": range(n)})])
    fired = [pd.concat(step((1, "spam"), frame(n), state))["correction_count"].tolist() for n in (3, 2, 4, 12)]
    assert fired == [[], [5], [], [10, 15, 20]]


def test_opt_out_removes_only_those_users(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "user_id long, x string")
    gone = spark.createDataFrame([(1,)], "user_id long")
    assert [r.x for r in C.opt_out(t, gone).collect()] == ["b"]


def files_of(spark, name, *parts):
    """A folder with one file per part, in this order of time."""
    import time

    root = work_path(spark, name)
    for i, df in enumerate(parts):
        df.coalesce(1).write.mode("append").parquet(root)
        time.sleep(1.1)
    return root


def corrections_of(spark, user, start, n):
    return spark.range(start, start + n).selectExpr(f"{user}L AS user_id", "concat('m', id) AS message_id", "'spam' AS model", "CAST(NULL AS BIGINT) AS version", "CAST(NULL AS BIGINT) AS correction_count")


def result_of(spark, user, version, count):
    return spark.range(1).selectExpr(f"{user}L AS user_id", "CAST(NULL AS STRING) AS message_id", "'spam' AS model", f"{version}L AS version", f"{count}L AS correction_count")


def claims_of(spark, *parts, **kw):
    from mailtriage.streaming import claims as CL

    root = files_of(spark, "claims-test", *parts)
    stream = spark.readStream.schema(spark.read.parquet(root).schema).option("maxFilesPerTrigger", 1).parquet(root)
    with CL.rocksdb(spark, idle_batches=False):
        out = R.run_to_table(CL.retrain_claims(stream.filter("version IS NULL"), stream.filter("version IS NOT NULL"), **kw), "claims-out")
    return sorted((r.user_id, r.correction_count) for r in out.collect())


def test_a_claim_stays_open_until_its_late_result(spark):
    c, r = corrections_of, result_of
    # User 1: 6 open a claim, 5 more find it open, the result of the first 6 comes late and the 5 open the next one.
    # User 2: no result, so nothing after the first claim. User 3: never enough since the attempt. User 4: a message again.
    first = c(spark, 1, 0, 6).union(c(spark, 2, 0, 5)).union(c(spark, 3, 0, 7)).union(r(spark, 3, 9, 4)).union(c(spark, 4, 0, 4)).union(c(spark, 4, 0, 4))
    second = c(spark, 1, 6, 5).union(c(spark, 2, 5, 20)).union(r(spark, 3, 8, 0)).union(c(spark, 4, 2, 2))
    third = r(spark, 1, 1, 6).union(c(spark, 4, 50, 1))
    assert claims_of(spark, first, second, third) == [(1, 6), (1, 11), (2, 5), (4, 5)]


class Handle:
    def __init__(self):
        self.timers, self.value = set(), None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_a_timer_closes_a_lost_claim():
    from mailtriage.streaming.claims import Claims

    handle, p = Handle(), Claims(5, 100)
    p.init(handle)
    frame = lambda n, version=None, at=None: pd.DataFrame({"version": pd.array([version] * n, "Int64"), "attempted": pd.array([at] * n, "Int64")})
    emitted = lambda frames: [int(x) for f in frames for x in f["correction_count"]]
    give = lambda now, *f: emitted(p.handleInputRows((1, "spam"), iter(f), Clock(now)))
    assert give(0, frame(3)) == [] and give(1, frame(1), frame(2)) == [6] and handle.timers == {101}
    assert give(50, frame(9)) == []
    handle.timers.clear()
    assert emitted(p.handleExpiredTimer((1, "spam"), Clock(101), None)) == [15] and handle.timers == {201}
    assert give(150, frame(1, 3, 15)) == [] and handle.timers == set()
    assert give(151, frame(5)) == [20] and handle.timers == {251}
    assert give(152, frame(1, 2, 0)) == [] or handle.value[1] == 15


def test_claims_of_a_stream_equal_those_of_tables(spark, sf):
    from mailtriage.streaming.claims import due_claims

    assert rows(Q.r3c(spark, sf)) == rows(due_claims(current(spark, sf), V.attempts(spark, sf)))


def test_a_promotion_between_two_batches_shows_in_the_second(spark):
    from mailtriage.sources.sinks import read_version, write_version

    versions = lambda v: spark.createDataFrame([(1, "spam", v)], "user_id long, model string, version long")
    none = spark.createDataFrame([], "user_id long, message_id string, model string, corrected_label string")
    mail = lambda m: spark.createDataFrame([(1, m, "spam", "ham")], "user_id long, message_id string, model string, predicted_label string")
    root, table = files_of(spark, "promotion-test", mail("a"), mail("b")), work_path(spark, "promotion-versions")
    write_version(versions(1), table)

    def step(batch, i):
        out = R.apply_active(batch, read_version(spark, table), none)
        got = spark.createDataFrame(out.select("message_id", "active_version").collect(), "message_id string, active_version long")
        if i == 0:
            write_version(versions(2), table)
        return got

    stream = spark.readStream.schema(spark.read.parquet(root).schema).option("maxFilesPerTrigger", 1).parquet(root)
    assert sorted(map(tuple, R.run_batches(stream, "promotion-out", step).collect())) == [("a", 1), ("b", 2)]


def test_append_sessions_with_late_rows_and_dropped_state(spark):
    ts = lambda *x: spark.createDataFrame([(1, f"2024-01-01 {t}") for t in x], "user_id long, t string").selectExpr("user_id", "CAST(t AS TIMESTAMP) AS ts")
    # 10:05 comes late but before the watermark of 10:20, and joins its session.
    parts = [ts("10:00:00", "10:20:00", "11:20:00"), ts("10:05:00", "10:25:00"), ts("14:00:00"), ts("14:10:00")]
    root = files_of(spark, "sessions-test", *parts)
    events = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(root)
    end = work_path(spark, "sessions-end")
    spark.sql("SELECT TIMESTAMP '2024-01-03 00:00:00' AS ts").write.parquet(end)
    whole = spark.read.parquet(root)
    plain = R.sessions(whole, "user_id", "ts")
    closed = R.run_to_table(R.sessions(R.event_time(events, delay="2 hours"), "user_id", "ts"), "sessions-open")
    # Without an end mark the last session stays in the state.
    assert closed.count() == plain.count() - 1
    marked = R.with_end(spark.readStream.schema("user_id long, ts timestamp").parquet(root), "ts", spark.readStream.schema("ts timestamp").parquet(end))
    got = R.run_to_table(R.sessions(R.event_time(marked), "user_id", "ts"), "sessions-closed").filter("user_id IS NOT NULL")
    assert rows(got) == rows(plain)


def test_a_table_stream_reads_a_file_or_a_folder(spark, sf):
    stored = spark.read.parquet(f"{sf}/events.parquet")
    folder = work_path(spark, "tables")
    stored.repartition(3).write.parquet(f"{folder}/events.parquet")
    for root in (sf, folder):
        got = R.run_to_table(R.read_table_stream(spark, root, "events"), "events-read")
        assert got.count() == stored.count() and got.exceptAll(stored).isEmpty()
