"""Queries for corrections, retrain state, model versions and their batch-form streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailtriage.operators import corrections as C, mailbox as MB
from mailtriage.plans.registry import ATTEMPTS, CURRENT, FEEDBACK, MAILBOX, query
from mailtriage.sources import tables as V


def current(spark, sf):
    return C.latest(V.feedback(spark, sf).drop("event_type"), C.CORRECTION_KEY, ["created_at", "event_id"])


LAST = """, last AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY user_id, model ORDER BY version DESC) = 1)"""
BOTH = CURRENT + ", " + ATTEMPTS + LAST
STATUS = ATTEMPTS + """, act AS (SELECT user_id, model, max(version) FILTER (passed = 1) AS av FROM attempts GROUP BY ALL),
  st AS (SELECT a.*, CASE WHEN passed = 0 THEN 'rejected' WHEN version = av THEN 'active' ELSE 'superseded' END AS status
    FROM attempts a JOIN act ON act.user_id = a.user_id AND act.model = a.model)"""


@query("r2_correction_upsert", f"WITH {CURRENT} SELECT user_id, message_id, model, event_id, corrected_label, created_at FROM current")
def r2(spark, sf):
    return current(spark, sf).select("user_id", "message_id", "model", "event_id", "corrected_label", "created_at")


@query("j7_corrections_of_user", """SELECT o.o_orderkey, c.c_custkey, c.c_name, o.o_orderdate FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  WHERE c.c_mktsegment = 'BUILDING'""")
def j7(spark, sf):
    o, c = V.load(spark, sf, "orders"), V.load(spark, sf, "customer")
    out = C.scope_to_user(o, c, o.o_custkey == c.c_custkey, c.c_mktsegment == "BUILDING")
    return out.select("o_orderkey", "c_custkey", "c_name", "o_orderdate")


@query("f7_custom_labels", f"WITH {CURRENT} SELECT DISTINCT user_id, corrected_label FROM current WHERE model = 'category' AND corrected_label NOT IN ('Work', 'Personal', 'Other')")
def f7(spark, sf):
    return C.custom_labels(current(spark, sf))


@query("f8_active_versions", f"WITH {STATUS} SELECT user_id, model, version FROM st WHERE status = 'active'")
def f8(spark, sf):
    return C.active_versions(V.attempts(spark, sf)).orderBy("user_id", "model")


@query("f9_corrections_in_time_order", f"WITH {CURRENT} SELECT user_id, message_id, model, corrected_label, created_at FROM current ORDER BY created_at")
def f9(spark, sf):
    return current(spark, sf).select("user_id", "message_id", "model", "corrected_label", "created_at").orderBy("created_at", "message_id", "model")


@query("j8_resorted_mail", f"""WITH {CURRENT}, {MAILBOX}, b AS (SELECT msg_id, category AS label_before FROM mailbox),
  a AS (SELECT msg_id, CASE WHEN value >= 25 THEN 'Other' ELSE category END AS label_after FROM mailbox)
  SELECT a.msg_id, label_before, label_after FROM a JOIN b ON a.msg_id = b.msg_id WHERE label_before <> label_after
  AND a.msg_id NOT IN (SELECT event_id FROM current WHERE model = 'priority')""")
def j8(spark, sf):
    before = V.mailbox(spark, sf)
    after = before.withColumn("category", F.when(F.col("value") >= 25, "Other").otherwise(F.col("category")))
    corrected = current(spark, sf).filter("model = 'priority'").select(F.col("event_id").alias("msg_id"))
    return MB.resorted(before, after, corrected, "msg_id", "category")


@query("l8_shown_labels", f"""WITH {CURRENT}, res AS (SELECT user_id, message_id, max(CASE WHEN value < 20 THEN 'Work' ELSE 'Other' END) AS category,
    max(CASE WHEN value < 20 THEN 'low' ELSE 'high' END) AS bucket, round(max(value) / 100, 4) AS score FROM feedback GROUP BY ALL),
  w AS (SELECT user_id, message_id, max(corrected_label) FILTER (model = 'category') AS c, max(corrected_label) FILTER (model = 'priority') AS p FROM current GROUP BY ALL)
  SELECT r.user_id, r.message_id, r.category, r.bucket, coalesce(c, category) AS shown_category, coalesce(p, bucket) AS shown_priority,
    coalesce(CASE p WHEN 'low' THEN 0.2 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.8 END, score)::DOUBLE AS shown_score
  FROM res r LEFT JOIN w ON w.user_id = r.user_id AND w.message_id = r.message_id""")
def l8(spark, sf):
    f = V.feedback(spark, sf)
    res = f.groupBy("user_id", "message_id").agg(
        F.max(F.when(F.col("value") < 20, "Work").otherwise("Other")).alias("category"),
        F.max(F.when(F.col("value") < 20, "low").otherwise("high")).alias("bucket"), F.round(F.max("value") / 100, 4).alias("score"))
    out = C.shown_labels(res, current(spark, sf), ["user_id", "message_id"], {"category": "category", "priority": "bucket"})
    return out.select("user_id", "message_id", "category", "bucket", "shown_category", "shown_priority", "shown_score")


@query("a15_corrections_until_retrain", f"""WITH {BOTH}, n AS (SELECT user_id, model, count(*) AS correction_count FROM current GROUP BY ALL)
  SELECT n.*, greatest(0, 5 - (n.correction_count - coalesce(l.correction_count, 0)))::BIGINT AS corrections_until_retrain
  FROM n LEFT JOIN last l ON l.user_id = n.user_id AND l.model = n.model""")
def a15(spark, sf):
    return C.remaining(current(spark, sf), V.attempts(spark, sf))


@query("a16_changed_since_attempt", f"""WITH {BOTH},
  n AS (SELECT user_id, model, max(created_at) AS last_correction FROM current GROUP BY ALL)
  SELECT n.* FROM n LEFT JOIN last l ON l.user_id = n.user_id AND l.model = n.model WHERE l.created_at IS NULL OR n.last_correction > l.created_at""")
def a16(spark, sf):
    """Corrections newer than the last attempt, whether it passed or not."""
    return C.changed_since_attempt(current(spark, sf), V.attempts(spark, sf))


@query("a22_version_key", f"""WITH {STATUS} SELECT user_id, string_agg(concat(model, ':', version), ',' ORDER BY concat(model, ':', version)) AS version_key
  FROM st WHERE status = 'active' GROUP BY user_id""")
def a22(spark, sf):
    return C.version_key(V.attempts(spark, sf))


@query("a22b_attempt_key", f"""WITH {ATTEMPTS} SELECT user_id, concat('category:', coalesce(max(version) FILTER (model = 'category'), 0),
  ',priority:', coalesce(max(version) FILTER (model = 'priority'), 0), ',spam:', coalesce(max(version) FILTER (model = 'spam'), 0)) AS attempt_key
  FROM attempts GROUP BY user_id""")
def a22b(spark, sf):
    return C.attempt_key(V.attempts(spark, sf))


@query("a23_label_maps", f"""WITH {CURRENT} SELECT user_id, message_id, string_agg(concat(model, '=', corrected_label), ';' ORDER BY model) AS corrected
  FROM current GROUP BY ALL""")
def a23(spark, sf):
    m = C.label_maps(current(spark, sf))
    pairs = F.transform(F.array_sort(F.map_keys("corrected")), lambda k: F.concat(k, F.lit("="), F.element_at("corrected", k)))
    return m.select("user_id", "message_id", F.array_join(pairs, ";").alias("corrected"))


@query("a24_status_summary", f"""WITH {CURRENT}, {STATUS}, n AS (SELECT user_id, model, count(*) AS c FROM current GROUP BY ALL),
  lst AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY user_id, model ORDER BY version DESC) = 1),
  cl AS (SELECT user_id, string_agg(DISTINCT corrected_label, ',' ORDER BY corrected_label) AS custom_labels FROM current
    WHERE model = 'category' AND corrected_label NOT IN ('Work', 'Personal', 'Other') GROUP BY user_id),
  grid AS (SELECT user_id, m.model FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('category'), ('priority'), ('spam')) m(model))
  SELECT g.user_id, g.model, coalesce(n.c, 0)::BIGINT AS correction_count, greatest(0, 5 - (coalesce(n.c, 0) - coalesce(l.correction_count, 0)))::BIGINT
    AS corrections_until_retrain, l.version AS last_version, l.status AS last_status, coalesce(cl.custom_labels, '') AS custom_labels
  FROM grid g LEFT JOIN n ON n.user_id = g.user_id AND n.model = g.model LEFT JOIN lst l ON l.user_id = g.user_id AND l.model = g.model
  LEFT JOIN cl ON cl.user_id = g.user_id""")
def a24(spark, sf):
    return C.status_summary(current(spark, sf), V.attempts(spark, sf), V.load(spark, sf, "events"))


@query("w8_next_version", f"WITH {ATTEMPTS} SELECT user_id, model, max(version) + 1 AS next_version FROM attempts GROUP BY ALL")
def w8(spark, sf):
    return C.next_version(V.attempts(spark, sf))


@query("w8b_last_attempt", f"WITH {ATTEMPTS}{LAST} SELECT user_id, model, version, passed, correction_count, created_at FROM last")
def w8b(spark, sf):
    return C.last_attempt(V.attempts(spark, sf)).select("user_id", "model", "version", "passed", "correction_count", "created_at")


@query("w9_promote", f"WITH {STATUS} SELECT user_id, model, version, status FROM st")
def w9(spark, sf):
    """Earlier attempts as history, the newest event of each kind as the new attempt."""
    a = V.attempts(spark, sf)
    newest = a.groupBy("model").agg(F.max("version").alias("version"))
    history = C.with_status(a.join(newest, ["model", "version"], "left_anti"))
    return C.promote(history, a.join(newest, ["model", "version"], "left_semi")).select("user_id", "model", "version", "status")


@query("w10_recent_connection", """SELECT o_custkey, o_orderkey FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def w10(spark, sf):
    return C.recent_connection(V.load(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderdate")


@query("r9_opt_out", f"""WITH {FEEDBACK}, gone AS (SELECT user_id FROM feedback GROUP BY user_id HAVING avg(value) > 10)
  SELECT 'corrections' AS kind, count(*) AS n FROM feedback WHERE user_id NOT IN (SELECT user_id FROM gone)
  UNION ALL SELECT 'versions', count(*) FROM events WHERE user_id NOT IN (SELECT user_id FROM gone)""")
def r9(spark, sf):
    f = V.feedback(spark, sf)
    gone = f.groupBy("user_id").agg(F.avg("value").alias("v")).filter("v > 10").select("user_id")
    left = C.opt_out(f, gone).agg(F.count("*").alias("n")).select(F.lit("corrections").alias("kind"), "n")
    return left.union(C.opt_out(V.attempts(spark, sf), gone).agg(F.count("*").alias("n")).select(F.lit("versions").alias("kind"), "n"))
