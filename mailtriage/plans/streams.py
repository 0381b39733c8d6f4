"""Streaming queries, run over the given tables to the end of their data."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailtriage.models import features as FT, scoring as SC
from mailtriage.operators import corrections as C
from mailtriage.plans.personalisation import STATUS, current
from mailtriage.plans.registry import ATTEMPTS, CURRENT, query
from mailtriage.session import work_path
from mailtriage.sources import tables as V
from mailtriage.sources.sinks import read_version, write_version
from mailtriage.streaming import claims, streams as R


def feedback_stream(spark, sf):
    return R.read_table_stream(spark, sf, "events").selectExpr(*V.FEEDBACK).drop("event_type")


@query("r1_stream_scoring", "SELECT doc_id AS msg_id, 1 AS same_as_batch FROM documents")
def r1(spark, sf):
    """Arriving mail scored by the linear models: no state and no shuffle in the stream."""
    from mailtriage.functions.headers import header_map
    from mailtriage.functions.text import body_of, subject_of
    from mailtriage.plans.modelling import fit_linear, gold, messages

    t = fit_linear(gold(spark, sf))
    mail = R.read_table_stream(spark, sf, "documents").selectExpr(*V.MAIL).select(
        "msg_id", "file", header_map("message").alias("headers"), subject_of("message").alias("subject"), body_of("message").alias("body"))
    scored = SC.score_linear(FT.message_features(mail, ["msg_id", "file"]), t)
    out = R.run_to_table(scored.select("msg_id", "spam_conf", "category_label"), "scored-stream")
    batch = SC.score_linear(messages(spark, sf), t).select("msg_id", F.col("spam_conf").alias("p"), F.col("category_label").alias("c"))
    same = (F.abs(F.col("spam_conf") - F.col("p")) < 1e-9) & (F.col("category_label") == F.col("c"))
    return out.join(batch, "msg_id", "left").select("msg_id", F.coalesce(same.cast("int"), F.lit(0)).alias("same_as_batch"))


@query("r2s_stream_upsert", f"WITH {CURRENT} SELECT user_id, message_id, model, event_id, corrected_label, created_at FROM current")
def r2s(spark, sf):
    root = work_path(spark, "corrections")
    q = (feedback_stream(spark, sf).writeStream.foreachBatch(R.correction_sink(root))
         .option("checkpointLocation", work_path(spark, "corrections-state")).trigger(availableNow=True).start())
    q.awaitTermination()
    return R.read_corrections(spark, root).select("user_id", "message_id", "model", "event_id", "corrected_label", "created_at")


@query("r3_retrain_triggers", f"""WITH {CURRENT}, n AS (SELECT user_id, model, count(*) AS c FROM current GROUP BY ALL)
  SELECT user_id, model, (5 * unnest(range(1, c // 5 + 1)))::BIGINT AS correction_count FROM n""")
def r3(spark, sf):
    return R.run_to_table(R.retrain_triggers(feedback_stream(spark, sf)), "triggers")


@query("r4_daily_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def r4(spark, sf):
    events = R.event_time(R.read_table_stream(spark, sf, "events"))
    out = R.run_to_table(R.daily_counts(events, "ts", "event_type"), "daily", "update", ["day", "event_type"])
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("r5_sliding_action_rates", """SELECT window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM
  (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR])::TIMESTAMP AS window_start FROM events) GROUP BY ALL""")
def r5(spark, sf):
    events = R.event_time(R.read_table_stream(spark, sf, "events"))
    out = R.run_to_table(R.action_rates(events, "ts", "event_type"), "rates", "update", ["window_start", "event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, sid"""


@query("r6_sessions", SESSIONS)
def r6(spark, sf):
    out = R.sessions_batch(V.load(spark, sf, "events"), "user_id", "ts")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("r6s_stream_sessions", SESSIONS)
def r6s(spark, sf):
    """Append mode: a session comes out when the watermark passes its end, and leaves the state."""
    events, path = R.read_table_stream(spark, sf, "events"), work_path(spark, "end-mark")
    V.load(spark, sf, "events").agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")).write.parquet(path)
    marked = R.with_end(events, "ts", spark.readStream.schema("ts timestamp_ntz").parquet(path))
    with claims.rocksdb(spark):
        out = R.run_to_table(R.sessions(R.event_time(marked), "user_id", "ts"), "sessions")
    return out.filter("user_id IS NOT NULL").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("r7_duplicate_delivery", "SELECT event_id, user_id, event_type FROM events")
def r7(spark, sf):
    """Every event delivered twice must come out once."""
    twice = R.read_table_stream(spark, sf, "events").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return R.run_to_table(R.suppress_duplicates(R.event_time(twice), ["event_id"]), "deduplicated").select("event_id", "user_id", "event_type")


@query("r8_active_model_join", f"""WITH {CURRENT}, {STATUS}, act2 AS (SELECT user_id, model, version AS active_version FROM st WHERE status = 'active')
  SELECT f.event_id, f.user_id, f.model, a.active_version, coalesce(c.corrected_label, f.predicted_label) AS shown_label FROM feedback f
  LEFT JOIN act2 a ON a.user_id = f.user_id AND a.model = f.model
  LEFT JOIN current c ON c.user_id = f.user_id AND c.message_id = f.message_id AND c.model = f.model""")
def r8(spark, sf):
    """Active versions and corrections are tables of versions that every micro-batch reads anew."""
    root, kept = work_path(spark, "active-versions"), work_path(spark, "current-corrections")
    write_version(C.active_versions(V.attempts(spark, sf)), root)
    write_version(current(spark, sf), kept)

    def step(batch, _):
        shown = R.apply_active(batch, read_version(spark, root), read_version(spark, kept))
        return shown.select("event_id", "user_id", "model", "active_version", "shown_label")

    return R.run_batches(feedback_stream(spark, sf), "shown", step)


@query("r3c_open_claims", f"""WITH {CURRENT}, {ATTEMPTS}, n AS (SELECT user_id, model, count(*) AS correction_count FROM current GROUP BY ALL),
  l AS (SELECT user_id, model, correction_count AS tried FROM attempts QUALIFY row_number() OVER (PARTITION BY user_id, model ORDER BY version DESC) = 1)
  SELECT n.user_id, n.model, n.correction_count FROM n LEFT JOIN l ON l.user_id = n.user_id AND l.model = n.model WHERE n.correction_count - coalesce(tried, 0) >= 5""")
def r3c(spark, sf):
    """One open claim per key, counted from the last attempt."""
    attempts = R.read_table_stream(spark, sf, "events").selectExpr(*V.ATTEMPTS)
    with claims.rocksdb(spark, idle_batches=False):
        return R.run_to_table(claims.retrain_claims(feedback_stream(spark, sf), attempts), "claims")
