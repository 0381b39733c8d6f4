"""Queries for labels, scores, filters, joins, sets and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailtriage import constants as K
from mailtriage.functions import scores as S, text as T
from mailtriage.functions.style import style_features
from mailtriage.operators import evaluate as E, keys, labels as LB, mailbox as MB
from mailtriage.plans.parsing import STYLE_SQL
from mailtriage.plans.registry import FEEDBACK, FOLDERS, GOLD, MAILBOX, SCORED, clean_sql, query
from mailtriage.sources import readers, tables as V

FOLDER_VALUES = ", ".join(f"('{f}', '{lab}')" for lab, names in K.FOLDER_LABELS.items() for f in names)
FOLDER_DIM = f"dim(folder, weak_label) AS (VALUES {FOLDER_VALUES})"
SKIP = ", ".join(f"'{f}'" for f in K.SKIP_FOLDERS)


def in_list(values):
    return ", ".join(f"'{v}'" for v in values)


# --- scans -------------------------------------------------------------------------------------

@query("s2_labelled_text", f"""SELECT l.doc_id, d.text, CASE WHEN lower(trim(CASE WHEN quality = 1 THEN ' Spam ' ELSE 'ham' END))
  IN ('spam', '1', 'yes', 'true') THEN 1 ELSE 0 END AS label FROM labels l JOIN documents d ON d.doc_id = l.doc_id
  WHERE d.text IS NOT NULL""")
def s2(spark, sf):
    raw = V.load(spark, sf, "labels").join(V.load(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", F.col("text").alias(" Message_Text"), F.when(F.col("quality") == 1, " Spam ").otherwise("ham").alias("CLASS "))
    return readers.labelled_text(raw, keep=["doc_id"])


@query("s2b_numeric_labels", """SELECT doc_id, cast(doc_id AS VARCHAR) AS text,
  least(greatest(quality * 3 - toxic, 0), 1)::INTEGER AS label FROM labels""")
def s2b(spark, sf):
    raw = V.load(spark, sf, "labels").select(
        "doc_id", F.col("doc_id").cast("string").alias("body"), (F.col("quality") * 3 - F.col("toxic")).alias("target"))
    return readers.labelled_text(raw, keep=["doc_id"])


@query("s3_narrow_scan", "SELECT doc_id, source FROM documents")
def s3(spark, sf):
    return V.load(spark, sf, "documents").select("doc_id", "source")


@query("s4_wanted_keys_scan", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def s4(spark, sf):
    wanted = V.load(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return V.load(spark, sf, "documents").select("doc_id", "source").join(wanted, "doc_id", "left_semi")


@query("s6_dataset_check", "SELECT count(*) AS n_rows, count(DISTINCT item_id) AS n_keys, count(*) - count(DISTINCT item_id) AS n_duplicates FROM benchmark")
def s6(spark, sf):
    return keys.key_check(V.load(spark, sf, "benchmark"), "item_id")


# --- labels and scores -------------------------------------------------------------------------

@query("l1_weak_label", f"""WITH {FOLDERS}, {FOLDER_DIM} SELECT f.doc_id, f.folder, d.weak_label FROM folders f
  JOIN dim d ON d.folder = f.folder WHERE f.folder NOT IN ({SKIP})""")
def l1(spark, sf):
    return LB.weak_label(V.folders(spark, sf).select("doc_id", "folder")).select("doc_id", "folder", "weak_label")


@query("l2_bucket_of_score", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 < 0.35 THEN 'low'
  WHEN l_discount * 10 < 0.55 THEN 'medium' ELSE 'high' END AS bucket FROM lineitem""")
def l2(spark, sf):
    return V.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.bucket_of(F.col("l_discount") * 10).alias("bucket"))


@query("l3_label_targets", f"""WITH {FEEDBACK} SELECT event_id, model, corrected_label,
  CASE model WHEN 'spam' THEN CASE corrected_label WHEN 'spam' THEN '1' ELSE '0' END ELSE corrected_label END AS target,
  CASE corrected_label WHEN 'low' THEN 0.2::DOUBLE WHEN 'medium' THEN 0.5::DOUBLE WHEN 'high' THEN 0.8::DOUBLE END AS score
  FROM feedback""")
def l3(spark, sf):
    return V.feedback(spark, sf).select(
        "event_id", "model", "corrected_label", S.correction_target(F.col("model"), F.col("corrected_label")).alias("target"),
        S.bucket_score(F.col("corrected_label")).alias("score"))


@query("l4_sentiment_class", f"""WITH {SCORED} SELECT doc_id, CASE WHEN compound >= 0.05 THEN 'positive'
  WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment FROM scored""")
def l4(spark, sf):
    return V.scored(spark, sf).select("doc_id", S.sentiment_class(F.col("compound")).alias("sentiment"))


@query("l6_clip_and_round", """SELECT l_orderkey, l_linenumber, round(least(greatest(l_tax * 20 - 0.3, 0.1), 1.0), 2) AS score
  FROM lineitem""")
def l6(spark, sf):
    return V.load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(S.clip_score(F.col("l_tax") * 20 - 0.3), 2).alias("score"))


@query("l7_spam_suppression", f"""WITH {SCORED} SELECT doc_id, CASE WHEN spam_conf >= 0.5 THEN 0.1 ELSE
  round(least(greatest(confidence, 0.1), 1.0), 2) END::DOUBLE AS score, CASE WHEN spam_conf >= 0.5 OR confidence < 0.35 THEN 'low'
  WHEN confidence < 0.55 THEN 'medium' ELSE 'high' END AS bucket, CASE WHEN spam_conf >= 0.5 THEN 1 ELSE 0 END AS has_note FROM scored""")
def l7(spark, sf):
    d = V.scored(spark, sf)
    r = d.select("doc_id", S.priority_result(F.col("spam_conf"), F.col("confidence"), S.bucket_of(F.col("confidence"))).alias("r"))
    return r.select("doc_id", "r.score", "r.bucket", F.when(F.col("r.note").isNotNull(), 1).otherwise(0).alias("has_note"))


@query("l9_predicted_label", f"""WITH {SCORED} SELECT doc_id, m.model,
  CASE WHEN m.model = 'spam' THEN CASE WHEN spam_conf >= 0.5 THEN 'spam' ELSE 'ham' END ELSE predicted END AS label,
  round(CASE WHEN m.model = 'spam' THEN CASE WHEN spam_conf >= 0.5 THEN spam_conf ELSE 1 - spam_conf END ELSE confidence END, 6) AS confidence
  FROM scored CROSS JOIN (VALUES ('category'), ('spam')) m(model)""")
def l9(spark, sf):
    d = V.scored(spark, sf).withColumn("model", F.explode(F.array(F.lit("category"), F.lit("spam"))))
    r = d.select("doc_id", "model", S.predicted_label(
        F.col("model"), F.col("predicted"), F.create_map("predicted", "confidence"), F.col("spam_conf")).alias("r"))
    return r.select("doc_id", "model", "r.label", F.round("r.confidence", 6).alias("confidence"))


@query("l10_validate_corrections", """WITH v AS (SELECT event_id,
    CASE WHEN event_type = 'view' THEN 'category' WHEN event_type = 'click' THEN 'priority' WHEN event_type = 'error' THEN 'spam'
      WHEN event_type = 'signup' THEN 'category' ELSE 'tone' END AS model,
    CASE WHEN value < 2 THEN '' WHEN value < 4 THEN '   ' WHEN value < 8 THEN ' high ' WHEN value < 14 THEN 'ham'
      WHEN value < 40 THEN 'Travel plans' ELSE repeat('long label ', 5) END AS label, value / 50 AS confidence FROM events)
  SELECT event_id, model, trim(label) AS label, CASE WHEN model = 'tone' THEN 'unknown model' WHEN label = '' THEN 'label is empty'
    WHEN length(label) > 40 THEN 'label is too long' WHEN trim(label) = '' THEN 'label is blank'
    WHEN model = 'priority' AND trim(label) NOT IN ('low', 'medium', 'high') THEN 'not a priority label'
    WHEN model = 'spam' AND trim(label) NOT IN ('spam', 'ham') THEN 'not a spam label'
    WHEN confidence < 0 OR confidence > 1 THEN 'confidence out of range' END AS error FROM v""")
def l10(spark, sf):
    e = V.load(spark, sf, "events")
    model = (F.when(F.col("event_type") == "view", "category").when(F.col("event_type") == "click", "priority")
             .when(F.col("event_type") == "error", "spam").when(F.col("event_type") == "signup", "category").otherwise("tone"))
    v = F.col("value")
    label = (F.when(v < 2, "").when(v < 4, "   ").when(v < 8, " high ").when(v < 14, "ham").when(v < 40, "Travel plans")
             .otherwise("long label " * 5))
    rows = e.select("event_id", model.alias("model"), label.alias("label"), (v / 50).alias("confidence"))
    return LB.validate_corrections(rows, "model", "label", "confidence").select("event_id", "model", "label", "error")


@query("l12_negative_tail", f"""WITH {SCORED} SELECT doc_id, CASE WHEN compound <= -0.6 THEN 0.15::DOUBLE
  WHEN compound <= -0.3 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM scored""")
def l12(spark, sf):
    return V.scored(spark, sf).select("doc_id", S.negative_tail_bonus(F.col("compound")).alias("bonus"))


@query("l13_day_section", """SELECT event_id, CASE date_diff('day', cast(ts AS DATE), DATE '2024-01-15') WHEN 0 THEN 'Today'
  WHEN 1 THEN 'Yesterday' ELSE 'Earlier' END AS section FROM events""")
def l13(spark, sf):
    return V.load(spark, sf, "events").select("event_id", S.day_section(F.col("ts"), F.to_date(F.lit("2024-01-15"))).alias("section"))


@query("l14_unscale_signal", """WITH f AS (SELECT doc_id, ln(1 + n_chars) AS x FROM documents),
  m AS (SELECT avg(x) AS mean, stddev_pop(x) AS scale FROM f)
  SELECT doc_id, greatest(0, round(exp(((x - mean) / scale) * scale + mean) - 1))::INTEGER AS shown_length,
    round((x - mean) / scale, 6) AS scaled FROM f, m""")
def l14(spark, sf):
    from mailtriage.operators.numeric import fit_scaler, scale

    f = V.load(spark, sf, "documents").select("doc_id", F.log1p(F.col("n_chars").cast("double")).alias("x"))
    scaler = fit_scaler(f, ["x"])
    z = scale(f, scaler, ["x"], keep_stats=True)
    raw = F.expm1(S.unscale(F.col("x"), F.col("x_mean"), F.col("x_scale")))
    return z.select("doc_id", S.shown_count(raw).alias("shown_length"), F.round("x", 6).alias("scaled"))


def signal_sql(name, i):
    raw = f"(n_chars * {i + 3} % 997 / 331.0::DOUBLE)"
    label, form = K.SIGNALS[name]
    count = lambda x: f"greatest(0, round({x}))::INTEGER"
    value = {"count": f"{count(raw)}::VARCHAR", "log count": f"{count(f'exp({raw}) - 1')}::VARCHAR", "log characters": f"{count(f'exp({raw}) - 1')} || ' characters'",
             "yes or no": f"CASE WHEN {raw} >= 0.5 THEN 'yes' ELSE 'no' END", "per thousand": f"printf('%.1f per 1,000 characters', {raw})",
             "percent": f"{count(f'least(1.0, {raw}) * 100')} || '%'", "two digits": f"printf('%.2f', {raw})"}[form]
    return f"SELECT doc_id, '{label}' AS label, {value} AS value FROM documents"


@query("l14b_named_signals", " UNION ALL ".join(signal_sql(name, i) for i, name in enumerate(K.SIGNALS)))
def l14b(spark, sf):
    """All twenty signals of a message by name, in the form in which a reader sees them."""
    raw = lambda i: F.col("n_chars") * (i + 3) % 997 / F.lit(331.0)
    shown = F.explode(F.array(*[S.shown_signal(name, raw(i)) for i, name in enumerate(K.SIGNALS)]))
    return V.load(spark, sf, "documents").select("doc_id", shown.alias("s")).select("doc_id", "s.label", "s.value")


# --- filters -----------------------------------------------------------------------------------

@query("f1_min_clean_length", f"SELECT doc_id, clean FROM (SELECT doc_id, {clean_sql('text')} AS clean FROM documents) WHERE length(clean) >= 10")
def f1(spark, sf):
    # A filter after the projection would be moved below it, and every text cleaned twice.
    long = F.filter(F.array(T.clean_text("text")), lambda c: F.length(c) >= K.MIN_CLEAN_CHARS)
    return V.load_text(spark, sf, "documents", "doc_id", spread=True).select("doc_id", F.explode(long).alias("clean"))


@query("f2_f3_usable_labels", """SELECT doc_id, label FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'Work' WHEN toxic = 1 THEN '  ' END AS label
  FROM labels) WHERE label IS NOT NULL AND trim(label) <> ''""")
def f2(spark, sf):
    rows = V.load(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "Work").when(F.col("toxic") == 1, "  ").alias("label"))
    return rows.filter(LB.has_label("label"))


@query("f4_search", "SELECT doc_id FROM documents WHERE contains(lower(source), 'worthless') OR contains(lower(lang), 'worthless') OR contains(lower(text), 'worthless')")
def f4(spark, sf):
    return V.load(spark, sf, "documents").filter(MB.matches_query(" Worthless ", ["source", "lang", "text"])).select("doc_id")


@query("f5_mailbox_view", f"WITH {MAILBOX} SELECT msg_id, user_id FROM mailbox WHERE archived = 0 AND category = 'Work' AND bucket = 'high' AND unread = 1")
def f5(spark, sf):
    return MB.view(V.mailbox(spark, sf), category="Work", only_high=True, only_unread=True).select("msg_id", "user_id")


@query("f5b_archive_view", f"WITH {MAILBOX} SELECT msg_id, user_id FROM mailbox WHERE archived = 1")
def f5b(spark, sf):
    return MB.view(V.mailbox(spark, sf), archived=True, category="Work", only_high=True).select("msg_id", "user_id")


@query("f6_confidence_gate", f"""WITH {GOLD} SELECT decision, count(*) AS n, round(avg(CASE WHEN predicted = true_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
  FROM (SELECT *, CASE WHEN confidence >= CASE predicted WHEN 'Work' THEN 0.60 WHEN 'Other' THEN 0.80 ELSE 0.75 END
    THEN 'accepted' ELSE 'review' END AS decision FROM gold) GROUP BY decision""")
def f6(spark, sf):
    g = E.confidence_gate(V.gold(spark, sf), "predicted", "confidence")
    hit = (F.col("predicted") == F.col("true_label")).cast("double")
    return g.groupBy("decision").agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


# --- joins -------------------------------------------------------------------------------------

@query("j1_features_onto_gold", f"""SELECT d.doc_id, coalesce(k.quality, 0)::INTEGER AS quality, coalesce(k.toxic, 0)::INTEGER AS toxic FROM documents d
  LEFT JOIN labels k ON k.doc_id = d.doc_id""")
def j1(spark, sf):
    d = V.load(spark, sf, "documents").select("doc_id").join(V.load(spark, sf, "labels"), "doc_id", "left")
    return LB.fill_missing(d, ["quality", "toxic"])


@query("j2_exclude_labelled", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j2(spark, sf):
    return V.load(spark, sf, "documents").select("doc_id", "source").join(V.load(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j3_keep_labelled", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j3(spark, sf):
    return V.load(spark, sf, "documents").select("doc_id", "source").join(V.load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("j4_append_batch", """SELECT doc_id, true_category, source FROM (
    SELECT l.doc_id, 'Work' AS true_category, cast(NULL AS VARCHAR) AS source FROM labels l WHERE quality = 1
    UNION ALL SELECT l.doc_id, 'Personal', d.source FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang <> 'fr'
      WHERE toxic = 1 AND l.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1))""")
def j4(spark, sf):
    lab = V.load(spark, sf, "labels")
    master = lab.filter("quality = 1").select("doc_id", F.lit("Work").alias("true_category"))
    batch = lab.filter("toxic = 1").select("doc_id", F.lit("Personal").alias("true_category"))
    pool = V.load(spark, sf, "documents").filter("lang <> 'fr'").select("doc_id", "source")
    return LB.append_new_labels(master, batch, pool, "doc_id")


@query("j5_apply_label_map", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'Other' WHEN quality = 1 THEN 'Work' END AS label FROM labels")
def j5(spark, sf):
    lab = V.load(spark, sf, "labels")
    master = lab.select("doc_id", F.when(F.col("quality") == 1, "Work").alias("label"))
    return LB.apply_label_map(master, lab.filter("toxic = 1").select("doc_id", F.lit("Other").alias("label")), "doc_id", "label")


@query("j6_text_for_sample", """SELECT l.doc_id, coalesce(d.text, '') AS body FROM labels l
  LEFT JOIN (SELECT doc_id, text FROM documents WHERE lang = 'en') d ON d.doc_id = l.doc_id""")
def j6(spark, sf):
    en = V.load(spark, sf, "documents").filter("lang = 'en'").select("doc_id", "text")
    return V.load(spark, sf, "labels").select("doc_id").join(en, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))


@query("j9_u2_leakage_guard", """SELECT key FROM (SELECT md5(lower(trim(text))) AS key FROM documents
    UNION ALL SELECT md5(lower(trim(concat(chr(32), text, chr(32))))) FROM benchmark) a
  INTERSECT SELECT md5(lower(trim(text))) FROM benchmark""")
def j9(spark, sf):
    """Evaluation items in other blanks, added to the documents, must be found again by their key."""
    key = F.md5(F.lower(F.trim("text"))).alias("key")
    bench = V.load(spark, sf, "benchmark").select("text")
    train = V.load(spark, sf, "documents").select("text").union(bench.select(F.concat(F.lit(" "), "text", F.lit(" "))))
    return keys.overlap(train.select(key), bench.select(key), "key")


@query("j9b_leakage_of_pairs", """SELECT count(*) AS n_leaked FROM (SELECT DISTINCT lower(trim(lang)), lower(trim(text)) FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels)
  INTERSECT SELECT lower(trim(lang)), lower(trim(text)) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))""")
def j9b(spark, sf):
    d = V.load(spark, sf, "documents").select("doc_id", keys.normalised_key(F.col("lang"), F.col("text")).alias("key"))
    gold = V.load(spark, sf, "labels").select("doc_id")
    both = keys.overlap(d.join(gold, "doc_id", "left_semi"), d.join(gold, "doc_id", "left_anti"), "key")
    return both.agg(F.count("*").alias("n_leaked"))


@query("j10_u3_missing_keys", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def j10(spark, sf):
    return keys.missing(V.load(spark, sf, "documents"), V.load(spark, sf, "labels"), "doc_id")


@query("j12_label_noise", """WITH k AS (SELECT d.doc_id, l.quality, md5(d.text) AS content FROM documents d JOIN labels l ON l.doc_id = d.doc_id
    UNION ALL SELECT d.doc_id, 1 - l.quality, md5(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1)
  SELECT doc_id, quality, content, n_labels, n_copies FROM k JOIN (SELECT content, count(DISTINCT quality) AS n_labels, count(*) AS n_copies
    FROM k GROUP BY content HAVING count(DISTINCT quality) > 1) m USING (content)""")
def j12(spark, sf):
    """Toxic documents also carry a second, opposite label here, so there is noise to find."""
    d = V.load(spark, sf, "documents").select("doc_id", "text").join(V.load(spark, sf, "labels"), "doc_id")
    second = d.filter("toxic = 1").withColumn("quality", 1 - F.col("quality"))
    return LB.noisy_duplicates(d.union(second), F.col("text"), "quality").select("doc_id", "quality", "content", "n_labels", "n_copies")


# --- sets --------------------------------------------------------------------------------------

@query("u1_union_sources", """SELECT doc_id AS id, text, source, cast(NULL AS VARCHAR) AS role FROM documents
  UNION ALL SELECT conv_id, text, NULL, role FROM conversations""")
def u1(spark, sf):
    a = V.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    b = V.load(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text", "role")
    return a.unionByName(b, allowMissingColumns=True)


@query("u4_label_union", f"WITH {GOLD} SELECT true_label AS label FROM gold UNION SELECT predicted FROM gold")
def u4(spark, sf):
    g = V.gold(spark, sf)
    return g.select(F.col("true_label").alias("label")).union(g.select("predicted")).distinct()


# --- evaluation --------------------------------------------------------------------------------

@query("a1_label_distribution", f"""WITH {GOLD} SELECT true_label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct
  FROM gold GROUP BY true_label""")
def a1(spark, sf):
    return E.label_distribution(V.gold(spark, sf), "true_label")


@query("a2_unmapped_folders", f"""WITH {FOLDERS}, {FOLDER_DIM} SELECT folder, count(*) AS n FROM folders
  WHERE folder NOT IN (SELECT folder FROM dim) AND folder NOT IN ({SKIP}) GROUP BY folder ORDER BY n DESC, folder LIMIT 15""")
def a2(spark, sf):
    return LB.unmapped_folders(V.folders(spark, sf))


@query("a3_accuracy", f"""WITH {GOLD} SELECT count(*) AS n, sum(CASE WHEN true_label = predicted THEN 1 ELSE 0 END)::BIGINT AS n_correct,
  round(avg(CASE WHEN true_label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM gold""")
def a3(spark, sf):
    return E.accuracy(V.gold(spark, sf), "true_label", "predicted")


@query("a4_confusion_matrix", f"""WITH {GOLD} SELECT true_label, count(*) FILTER (predicted = 'Work') AS pred_work,
  count(*) FILTER (predicted = 'Personal') AS pred_personal, count(*) FILTER (predicted = 'Other') AS pred_other FROM gold GROUP BY true_label""")
def a4(spark, sf):
    return E.confusion_matrix(V.gold(spark, sf), "true_label", "predicted", K.CATEGORIES)


REPORT_CTE = GOLD + """, cls AS (SELECT c.label, count(*) FILTER (true_label = c.label) AS support,
    count(*) FILTER (predicted = c.label) AS predicted, count(*) FILTER (predicted = c.label AND true_label = c.label) AS hit
    FROM gold CROSS JOIN (VALUES ('Work'), ('Personal'), ('Other')) c(label) GROUP BY c.label),
  pr AS (SELECT label, support, CASE WHEN predicted > 0 THEN hit::DOUBLE / predicted ELSE 0 END AS p,
    CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0 END AS r FROM cls),
  rep AS (SELECT label, support, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr)"""


@query("a5_class_report", f"WITH {REPORT_CTE} SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM rep")
def a5(spark, sf):
    r = E.class_report(V.gold(spark, sf), "true_label", "predicted")
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("a5b_average_report", f"""WITH {REPORT_CTE} SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1,
  round(sum(p * support) / sum(support), 6) AS weighted_precision, round(sum(r * support) / sum(support), 6) AS weighted_recall,
  round(sum(f * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS support FROM rep""")
def a5b(spark, sf):
    r = E.average_report(E.class_report(V.gold(spark, sf), "true_label", "predicted"))
    return r.select(*[F.round(c, 6).alias(c) if c != "support" else F.col(c) for c in r.columns])


@query("a6_bucket_recall", f"""WITH {GOLD} SELECT true_label, count(*) AS n, sum(CASE WHEN true_label = predicted THEN 1 ELSE 0 END)::BIGINT AS n_correct,
  round(avg(CASE WHEN true_label = predicted THEN 1.0 ELSE 0.0 END), 6) AS recall FROM gold GROUP BY true_label""")
def a6(spark, sf):
    return E.bucket_recall(V.gold(spark, sf), "true_label", "predicted")


@query("a6b_misses", f"WITH {GOLD} SELECT doc_id, true_label, predicted, confidence, source FROM gold WHERE true_label <> predicted")
def a6b(spark, sf):
    return V.gold(spark, sf).filter("true_label <> predicted").select("doc_id", "true_label", "predicted", "confidence", "source")


@query("a7_mae_vs_mean", """SELECT round(avg(abs(l_tax - l_discount)), 6) AS mae,
  round(avg(abs(l_tax - (SELECT avg(l_tax) FROM lineitem))), 6) AS baseline_mae FROM lineitem""")
def a7(spark, sf):
    return E.mae_against_mean(V.load(spark, sf, "lineitem"), F.col("l_tax"), F.col("l_discount"))


@query("a8_majority_baseline", f"""WITH {GOLD}, c AS (SELECT true_label, count(*) AS n FROM gold GROUP BY true_label)
  SELECT (SELECT true_label FROM c ORDER BY n DESC, true_label DESC LIMIT 1) AS majority, round(max(n)::DOUBLE / sum(n), 6) AS baseline FROM c""")
def a8(spark, sf):
    return E.majority_baseline(V.gold(spark, sf), "true_label")


@query("a9_agreement", """SELECT round(corr(l_discount, l_tax), 6) AS r, round(avg(abs(l_discount - l_tax)), 6) AS mae,
  round(avg(CASE WHEN l_discount = l_tax THEN 1.0 ELSE 0.0 END), 6) AS exact FROM lineitem""")
def a9(spark, sf):
    return E.agreement(V.load(spark, sf, "lineitem"), F.col("l_discount"), F.col("l_tax"))


@query("a10_false_positive_rate", f"""WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (spam_conf >= 0.5) AS n_flagged,
  round(avg(CASE WHEN spam_conf >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT * FROM scored
    WHERE doc_id NOT IN (SELECT doc_id FROM labels))""")
def a10(spark, sf):
    fresh = V.scored(spark, sf).select("doc_id", "spam_conf").join(V.load(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    hit = F.col("spam_conf") >= K.SPAM_THRESHOLD
    return fresh.agg(F.count("*").alias("n"), F.count_if(hit).alias("n_flagged"), F.round(F.avg(hit.cast("double")), 6).alias("rate"))


@query("a11_confidence_distribution", f"""WITH {SCORED} SELECT count(*) AS count, round(avg(confidence), 6) AS mean, round(stddev_samp(confidence), 6) AS std,
  min(confidence) AS min, round(quantile_cont(confidence, 0.25), 6) AS p25, round(quantile_cont(confidence, 0.5), 6) AS p50,
  round(quantile_cont(confidence, 0.75), 6) AS p75, max(confidence) AS max FROM scored""")
def a11(spark, sf):
    return E.distribution(V.scored(spark, sf), "confidence")


SWEEP_CTE = GOLD + """, t AS (SELECT DISTINCT predicted AS label, confidence AS threshold FROM gold),
  sweep AS (SELECT t.label, t.threshold, count(*) AS kept, avg(CASE WHEN g.true_label = g.predicted THEN 1.0 ELSE 0.0 END) AS precision,
    count(*)::DOUBLE / (SELECT count(*) FROM gold x WHERE x.predicted = t.label) AS coverage
    FROM t JOIN gold g ON g.predicted = t.label AND g.confidence >= t.threshold GROUP BY t.label, t.threshold)"""


@query("a12_gate_sweep", f"WITH {SWEEP_CTE} SELECT label, threshold, kept, round(precision, 6) AS precision, round(coverage, 6) AS coverage FROM sweep")
def a12(spark, sf):
    s = E.gate_sweep(V.gold(spark, sf), "true_label", "predicted", "confidence")
    return s.withColumns({c: F.round(c, 6) for c in ("precision", "coverage")})


@query("a12b_lowest_threshold", f"""WITH {SWEEP_CTE} SELECT label, threshold, kept, round(precision, 6) AS precision, round(coverage, 6) AS coverage
  FROM sweep WHERE precision >= 0.5 QUALIFY row_number() OVER (PARTITION BY label ORDER BY threshold) = 1""")
def a12b(spark, sf):
    s = E.lowest_threshold(E.gate_sweep(V.gold(spark, sf), "true_label", "predicted", "confidence"), 0.5)
    return s.withColumns({c: F.round(c, 6) for c in ("precision", "coverage")})


@query("a13_pair_frequency", """WITH p AS (SELECT o_custkey, o_orderpriority, count(*) AS pair_freq FROM orders GROUP BY ALL)
  SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n_distinct_to FROM p""")
def a13(spark, sf):
    return MB.pair_frequency(V.load(spark, sf, "orders"), "o_custkey", "o_orderpriority")


COUNTS_SQL = """count(*) FILTER (archived = 0) AS n_all, count(*) FILTER (archived = 0 AND category = 'Work') AS n_work,
  count(*) FILTER (archived = 0 AND category = 'Personal') AS n_personal, count(*) FILTER (archived = 0 AND category = 'Other') AS n_other,
  count(*) FILTER (archived = 0 AND bucket = 'high') AS n_high, count(*) FILTER (archived = 0 AND unread = 1) AS n_unread"""


@query("a14_mailbox_counts", f"WITH {MAILBOX} SELECT user_id, {COUNTS_SQL} FROM mailbox GROUP BY user_id")
def a14(spark, sf):
    return MB.counts(V.mailbox(spark, sf), ["user_id"])


PATTERNS = (("receipt", "receipt|invoice|purchase"), ("notice", "worthless|click here|free"), ("contact", "@|http"))


@query("a17_label_composition", "WITH pat(name, re) AS (VALUES {}) SELECT l.toxic, pat.name AS pattern, count(*) AS n FROM labels l JOIN documents d "
       "ON d.doc_id = l.doc_id JOIN pat ON regexp_matches(lower(d.text), pat.re) GROUP BY l.toxic, pat.name".format(
           ", ".join(f"('{n}', '{r}')" for n, r in PATTERNS)))
def a17(spark, sf):
    """Patterns are a fixed list, so each row is tested in place and no join with it is needed."""
    d = V.load(spark, sf, "documents").select("doc_id", F.lower("text").alias("t")).join(V.load(spark, sf, "labels"), "doc_id")
    hits = F.filter(F.array(*[F.when(F.col("t").rlike(r), F.lit(n)) for n, r in PATTERNS]), lambda x: x.isNotNull())
    return d.select("toxic", F.explode(hits).alias("pattern")).groupBy("toxic", "pattern").agg(F.count("*").alias("n"))


@query("a18_error_share", f"""WITH {GOLD} SELECT true_label, predicted, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share
  FROM gold WHERE true_label <> predicted GROUP BY ALL""")
def a18(spark, sf):
    from pyspark.sql import Window as W

    pairs = V.gold(spark, sf).filter("true_label <> predicted").groupBy("true_label", "predicted").agg(F.count("*").alias("n"))
    return pairs.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query("a19_feature_class_means", f"""WITH s AS ({STYLE_SQL}) SELECT l.quality, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in K.STYLE_COLS)}
  FROM s JOIN labels l ON l.doc_id = s.doc_id GROUP BY l.quality""")
def a19(spark, sf):
    f = V.load_text(spark, sf, "documents", "doc_id", spread=True).select("doc_id", *style_features("source", "text"))
    f = f.withColumns({c: F.round(c, 6) for c in ("text_len_log", "excl_density")})
    return f.join(V.load(spark, sf, "labels"), "doc_id").groupBy("quality").agg(
        F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in K.STYLE_COLS])


@query("a20_gate_metrics", f"""WITH {GOLD}, g AS (SELECT *, CASE WHEN n_chars % 4 = 0 THEN 1 ELSE 0 END AS own,
    CASE WHEN n_chars % 11 = 0 THEN 'Receipts' ELSE predicted END AS new_pred FROM gold),
  m AS (SELECT source, coalesce(avg(CASE WHEN own = 1 THEN CASE WHEN true_label = new_pred THEN 1.0 ELSE 0.0 END END), 0) AS own_accuracy,
    coalesce(avg(CASE WHEN own = 0 AND new_pred <> 'Receipts' THEN CASE WHEN true_label = new_pred THEN 1.0 ELSE 0.0 END END), 0) AS gate_accuracy,
    coalesce(avg(CASE WHEN own = 0 THEN CASE WHEN true_label = predicted THEN 1.0 ELSE 0.0 END END), 0) AS base_accuracy,
    coalesce(avg(CASE WHEN own = 0 THEN CASE WHEN new_pred = 'Receipts' THEN 1.0 ELSE 0.0 END END), 0) AS custom_fraction FROM g GROUP BY source),
  r AS (SELECT *, CASE WHEN own_accuracy < 0.8 THEN 'corrections' WHEN custom_fraction > 0.1 THEN 'custom labels'
    WHEN gate_accuracy < base_accuracy - 0.03 THEN 'accuracy' END AS reason FROM m)
  SELECT source, round(own_accuracy, 6) AS own_accuracy, round(gate_accuracy, 6) AS gate_accuracy, round(base_accuracy, 6) AS base_accuracy,
    round(custom_fraction, 6) AS custom_fraction, reason, CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS passed FROM r""")
def a20(spark, sf):
    g = V.gold(spark, sf).withColumn("new_pred", F.when(F.col("n_chars") % 11 == 0, "Receipts").otherwise(F.col("predicted")))
    m = E.gate_metrics(g, ["source"], F.col("n_chars") % 4 == 0, F.col("true_label"), F.col("new_pred"), F.col("predicted"), K.CATEGORIES)
    return m.withColumns({c: F.round(c, 6) for c in ("own_accuracy", "gate_accuracy", "base_accuracy", "custom_fraction")})


@query("a21_duplicate_content", "SELECT count(*) AS n_rows, count(DISTINCT md5(text)) AS n_keys, count(*) - count(DISTINCT md5(text)) AS n_duplicates FROM documents")
def a21(spark, sf):
    return keys.key_check(V.load(spark, sf, "documents").select(F.md5("text").alias("key")), "key")


@query("w13_inbox_order", f"WITH {MAILBOX} SELECT msg_id, user_id, received_at FROM mailbox WHERE archived = 0 ORDER BY received_at DESC, msg_id")
def w13(spark, sf):
    return MB.inbox_order(V.mailbox(spark, sf).filter("archived = 0").select("msg_id", "user_id", "received_at"), "received_at", "msg_id")
