"""Queries for samples, folds, deduplication and labelling sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailtriage.functions import text as T
from mailtriage.operators import sampling as SP
from mailtriage.plans.registry import FEEDBACK, PARSED, SCORED, clean_sql, query
from mailtriage.sources import tables as V


def h(seed, key="doc_id"):
    return f"md5(concat('{seed}:', cast({key} AS VARCHAR)))"


@query("w1_stratified_sample", f"""WITH {SCORED} SELECT doc_id, predicted FROM scored
  QUALIFY row_number() OVER (PARTITION BY predicted ORDER BY {h(42)}, doc_id) <= 180""")
def w1(spark, sf):
    return SP.sample_per_group(V.scored(spark, sf).select("doc_id", "predicted"), "predicted", "doc_id", 180, 42)


@query("w2_cap_per_class", f"""WITH {SCORED} SELECT doc_id, predicted, row_number() OVER (ORDER BY {h(7)}, doc_id) AS position FROM
  (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY predicted ORDER BY {h(42)}, doc_id) <= 250)""")
def w2(spark, sf):
    """Cap, then a seeded shuffle; the position is an exact distributed rank, not a one-task sort."""
    capped = SP.sample_per_group(V.scored(spark, sf).select("doc_id", "predicted"), "predicted", "doc_id", 250, 42)
    shuffled = SP.rank_in_group(capped.withColumn("_all", F.lit(1)), "_all", "doc_id", 7, "position")
    return shuffled.select("doc_id", "predicted", "position")


@query("w3_fraction_sample", f"""SELECT doc_id, quality FROM labels
  QUALIFY row_number() OVER (PARTITION BY quality ORDER BY {h(42)}, doc_id) <= round(0.3 * count(*) OVER (PARTITION BY quality))""")
def w3(spark, sf):
    return SP.sample_fraction(V.load(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.3, 42)


@query("w4_class_mix", f"""WITH j AS (SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
  SELECT * FROM (SELECT doc_id, 1 AS label FROM j WHERE toxic = 1 ORDER BY {h(42)}, doc_id LIMIT 500)
  UNION ALL SELECT * FROM (SELECT doc_id, 0 FROM j WHERE toxic = 0 ORDER BY {h(42)}, doc_id LIMIT 300)
  UNION ALL SELECT * FROM (SELECT doc_id, 0 FROM j WHERE toxic IS NULL ORDER BY {h(42)}, doc_id LIMIT 700)""")
def w4(spark, sf):
    return spam_training_mix(spark, sf).select("doc_id", "label")


def spam_training_mix(spark, sf):
    """At most 500 spam, 300 ham and 700 other messages taken as ham: 1,500 rows at any scale."""
    from mailtriage.constants import MIX_HAM, MIX_OTHER_HAM, MIX_SPAM

    labels = V.load(spark, sf, "labels")
    docs = V.load(spark, sf, "documents").select("doc_id")
    spam = labels.filter("toxic = 1").select("doc_id", F.lit(1).alias("label"))
    ham = labels.filter("toxic = 0").select("doc_id", F.lit(0).alias("label"))
    other = docs.join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("label"))
    return SP.class_mix([(spam, MIX_SPAM), (ham, MIX_HAM), (other, MIX_OTHER_HAM)], "doc_id", 42)


@query("w5_chunk_sample", f"""SELECT doc_id FROM (SELECT doc_id, ('0x' || substr({h('5-chunk')}, 1, 6))::BIGINT % 8 AS chunk FROM documents
    QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY {h(5)}, doc_id) <= 60) ORDER BY {h(5)}, doc_id LIMIT 300""")
def w5(spark, sf):
    return SP.bounded_chunk_sample(V.load(spark, sf, "documents").select("doc_id"), "doc_id", 8, 60, 300, 5)


@query("w6_dedup_by_message", """SELECT min(doc_id) AS doc_id FROM documents GROUP BY concat(source, '||', text)""")
def w6(spark, sf):
    """Key: subject and body, whole."""
    d = V.load(spark, sf, "documents")
    return SP.keep_first(d.select("doc_id", "source", "text"), SP.message_key("source", "text"), "doc_id").select("doc_id")


@query("w6b_dedup_by_clean_text", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {clean_sql('text')}")
def w6b(spark, sf):
    """Key: the cleaned text, whole."""
    d = V.load_text(spark, sf, "documents", "doc_id", spread=True).select("doc_id", T.clean_text("text").alias("key"))
    return SP.keep_first(d, F.col("key"), "doc_id").select("doc_id")


@query("w7_least_confident", f"WITH {SCORED} SELECT doc_id, predicted, confidence FROM scored ORDER BY confidence, doc_id LIMIT 200")
def w7(spark, sf):
    return V.scored(spark, sf).select("doc_id", "predicted", "confidence").orderBy("confidence", "doc_id").limit(200)


@query("w7b_active_pool", f"""WITH {SCORED} SELECT doc_id, predicted, confidence, substring(text, 1, 800) AS body, '' AS true_category FROM scored
  WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  QUALIFY row_number() OVER (PARTITION BY concat(source, '||', text) ORDER BY doc_id) = 1 ORDER BY confidence, doc_id LIMIT 100""")
def w7b(spark, sf):
    """The active-learning pool: unlabelled, one row per content, least confident first."""
    fresh = V.scored(spark, sf).join(V.load(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    key = SP.message_key("source", "text")
    pool = SP.keep_first(fresh.select("doc_id", "predicted", "confidence", F.md5(key).alias("key"), F.substring("text", 1, 800).alias("body")),
                         F.col("key"), "doc_id")
    picked = pool.orderBy("confidence", "doc_id").limit(100)
    return picked.select("doc_id", "predicted", "confidence", "body", F.lit("").alias("true_category"))


def folds_sql(k, seed):
    return f"""SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY {h(seed)}, doc_id) - 1) % {k})::INTEGER AS fold FROM labels"""


@query("w11_stratified_folds", folds_sql(5, 42))
def w11(spark, sf):
    return SP.assign_folds(V.load(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 5, 42)


@query("w11b_three_folds", folds_sql(3, 42))
def w11b(spark, sf):
    return SP.assign_folds(V.load(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 3, 42)


@query("w12_holdout", f"""SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {h(42)}, doc_id)
  <= ceil(0.15 * count(*) OVER (PARTITION BY quality)) THEN 1 ELSE 0 END AS is_test FROM labels""")
def w12(spark, sf):
    return SP.holdout(V.load(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.15, 42)


@query("w14_half_split", f"""WITH {FEEDBACK} SELECT event_id, user_id, model, CASE WHEN count(*) OVER g >= 4 THEN CASE WHEN
    row_number() OVER (PARTITION BY user_id, model ORDER BY {h(0, 'event_id')}, event_id) <= count(*) OVER g // 2 THEN 0 ELSE 1 END END AS half
  FROM feedback WINDOW g AS (PARTITION BY user_id, model)""")
def w14(spark, sf):
    return SP.half_split(V.feedback(spark, sf).select("event_id", "user_id", "model"), ["user_id", "model"], "event_id", 0)


@query("s11_labelling_sheet", f"""WITH {PARSED}, r AS (SELECT row_number() OVER (ORDER BY msg_id) - 1 AS i, * FROM hdr)
  SELECT i, concat('=== [', i, '] file=', file, ' ===', chr(10), 'SUBJECT: ', subject, chr(10), 'BODY: ',
    substring(replace(body, chr(10), ' '), 1, 500)) AS entry FROM r WHERE i >= 20 AND i < 120""")
def s11(spark, sf):
    from mailtriage.sources.sinks import labelling_sheet

    return labelling_sheet(V.parsed_mail(spark, sf), 20, 120)


@query("s13_feature_cache", """SELECT md5(text) AS text_key, length(text)::INTEGER AS n FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY text
  EXCEPT SELECT md5(text), length(text)::INTEGER FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def s13(spark, sf):
    """Texts of labelled documents are cached; only new texts are computed."""
    from mailtriage.sources.sinks import new_texts

    d = V.load(spark, sf, "documents").select("doc_id", "text")
    gold = V.load(spark, sf, "labels").select("doc_id")
    cached = d.join(gold, "doc_id", "left_semi").select(T.content_key("text").alias("text_key"))
    fresh = new_texts(d.join(gold, "doc_id", "left_anti").select("text"), "text", cached)
    return fresh.select("text_key", F.length("text").alias("n"))
