"""Queries for n-grams, vocabularies, TF-IDF, scaling and lexicon sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailtriage.functions import scores as S, sparse as SV, text as T
from mailtriage.functions.gramcounts import sorted_char_grams
from mailtriage.functions.ngrams import word_ngrams
from mailtriage.operators import numeric as N, vocab as VO
from mailtriage.operators.sentiment import compound
from mailtriage.plans.registry import GOLD, clean_sql, query
from mailtriage.session import materialize, ship
from mailtriage.sources import tables as V

# Stop words are an input: this list serves the queries, a caller may pass another.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "it", "that", "for", "on", "with", "as", "this", "by",
              "die", "der", "und", "le", "la", "de", "les", "el", "en", "los")
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def cleaned(spark, sf):
    return V.load_text(spark, sf, "documents", "doc_id", spread=True).select("doc_id", T.clean_text("text").alias("clean"))


CLEANED = f"cleaned AS (SELECT doc_id, {clean_sql('text')} AS clean FROM documents)"
TOKENS = CLEANED + f""", tok AS (SELECT doc_id, list_filter(string_split(clean, ' '), lambda t: length(t) >= 2 AND t NOT IN ({STOP})) AS ts FROM cleaned),
  wg AS (SELECT doc_id, list_concat(ts, list_transform(range(1, greatest(len(ts), 1)), lambda i: ts[i] || ' ' || ts[i + 1])) AS grams FROM tok)"""
CHARS = CLEANED + """, cg AS (SELECT doc_id, flatten(list_transform(list_filter(string_split(clean, ' '), lambda w: w <> ''),
    lambda w: flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(length(w) + 2 - n + 2, 1)), lambda i: substr(' ' || w || ' ', i, n)))))) AS grams FROM cleaned)"""


@query("m1_word_ngrams", f"WITH {TOKENS} SELECT doc_id, len(grams)::INTEGER AS n, array_to_string(grams, '|') AS grams FROM wg")
def m1(spark, sf):
    g = cleaned(spark, sf).select("doc_id", word_ngrams(F.col("clean"), 1, 2, STOP_WORDS).alias("g"))
    return g.select("doc_id", F.size("g").alias("n"), F.array_join("g", "|").alias("grams"))


@query("m2_char_wb_ngrams", f"WITH {CHARS} SELECT doc_id, len(grams)::INTEGER AS n, md5(array_to_string(list_sort(grams), '|')) AS grams FROM cg")
def m2(spark, sf):
    ship(spark)
    grams = F.arrow_udf(sorted_char_grams(3, 5), "array<string>")
    g = cleaned(spark, sf).select("doc_id", grams("clean").alias("g"))
    return g.select("doc_id", F.size("g").alias("n"), F.md5(F.array_join("g", "|")).alias("grams"))


def vocab_sql(cte, source, min_df, size):
    return f"""{cte}, terms AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(grams) AS term FROM {source}) GROUP BY term),
  top AS (SELECT * FROM terms WHERE df >= {min_df} ORDER BY tf DESC, term LIMIT {size}),
  vocab AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx, tf, df,
    ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM top)"""


WORD_VOCAB = vocab_sql(TOKENS, "wg", 2, 3000)
CHAR_VOCAB = vocab_sql(CHARS, "cg", 3, 1500)
WORD = VO.word_spec(3000, 2, STOP_WORDS)
CHAR = VO.char_spec(1500, 3)


def written(spark, sf):
    """``cleaned`` once for a fit and the rows it is applied to: reading it back costs less than cleaning again."""
    return materialize(cleaned(spark, sf), "cleaned")


def vocabulary(d, spec):
    return VO.vocabulary(VO.term_table(d, "clean", spec), d.agg(F.count("*").alias("n_docs")), spec)


@query("m3_word_vocabulary", f"WITH {WORD_VOCAB} SELECT term, idx, tf, df, round(idf, 6) AS idf FROM vocab")
def m3(spark, sf):
    return vocabulary(cleaned(spark, sf), WORD).withColumns({"idf": F.round("idf", 6), "tf": F.col("tf").cast("long")})


@query("m3b_char_vocabulary", f"WITH {CHAR_VOCAB} SELECT term, idx, tf, df, round(idf, 6) AS idf FROM vocab")
def m3b(spark, sf):
    return vocabulary(cleaned(spark, sf), CHAR).withColumns({"idf": F.round("idf", 6), "tf": F.col("tf").cast("long")})


@query("m3c_pruned_vocabulary", f"WITH {CHAR_VOCAB} SELECT term, idx, tf, df, round(idf, 6) AS idf FROM vocab")
def m3c(spark, sf):
    """The same character vocabulary, with terms that cannot be in it left out before the exchange."""
    d = cleaned(spark, sf)
    terms, _ = VO.pruned_terms(d, "clean", CHAR)
    out = VO.vocabulary(terms, d.agg(F.count("*").alias("n_docs")), CHAR)
    return out.withColumns({"idf": F.round("idf", 6), "tf": F.col("tf").cast("long")})


def tfidf_sql(vocab, source):
    return f"""{vocab}, w AS (SELECT g.doc_id, v.term, v.idx, (1 + ln(g.tf)) * v.idf AS w FROM
    (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(grams) AS term FROM {source}) GROUP BY ALL) g JOIN vocab v ON v.term = g.term),
  tfidf AS (SELECT doc_id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


@query("m4_tfidf_word", f"WITH {tfidf_sql(WORD_VOCAB, 'wg')} SELECT doc_id, term, idx, round(weight, 6) AS weight FROM tfidf")
def m4(spark, sf):
    rows = written(spark, sf)
    model = VO.fit_text(rows, "clean", WORD)
    d = model.transform(rows, "clean")
    return VO.long_weights(d, "doc_id", "word", model).select("doc_id", "term", "idx", F.round("weight", 6).alias("weight"))


@query("m4b_tfidf_char_norms", f"""WITH {tfidf_sql(CHAR_VOCAB, 'cg')} SELECT doc_id, count(*) AS n_terms, round(sum(weight), 6) AS l1, round(max(weight), 6) AS top
  FROM tfidf GROUP BY doc_id""")
def m4b(spark, sf):
    rows = written(spark, sf)
    model = VO.collect_model(vocabulary(rows, CHAR), CHAR)
    d = model.transform(rows, "clean").filter(F.size("char_val") > 0)
    return d.select("doc_id", F.size("char_val").cast("long").alias("n_terms"),
                    F.round(F.aggregate("char_val", F.lit(0.0), lambda a, x: a + x), 6).alias("l1"), F.round(F.array_max("char_val"), 6).alias("top"))


@query("j11_vocabulary_lookup", f"""WITH {WORD_VOCAB} SELECT g.doc_id, v.idx, count(*) AS tf FROM (SELECT doc_id, unnest(grams) AS term FROM wg) g
  JOIN vocab v ON v.term = g.term GROUP BY g.doc_id, v.idx""")
def j11(spark, sf):
    """Terms are counted inside the batch; the vocabulary is bounded, so every task holds it."""
    rows = written(spark, sf)
    model = VO.fit_text(rows, "clean", WORD)
    found = model.counts(rows, "clean").select("doc_id", F.explode(F.arrays_zip(F.col("word_idx").alias("i"), F.col("word_val").alias("n"))).alias("g"))
    return found.select("doc_id", F.col("g.i").alias("idx"), F.col("g.n").cast("long").alias("tf"))


@query("w15_heaviest_terms", f"""WITH {tfidf_sql(WORD_VOCAB, 'wg')}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, idx) AS rank FROM tfidf)
  SELECT doc_id, rank::INTEGER AS rank, round(round(weight, 9), 6) AS weight FROM r WHERE rank <= 5""")
def w15(spark, sf):
    rows = written(spark, sf)
    model = VO.fit_text(rows, "clean", WORD)
    d = model.transform(rows, "clean").withColumn("word_val", F.transform("word_val", lambda x: F.round(x, 9)))
    return VO.heaviest_terms(d, "doc_id", "word", model, 5).select("doc_id", "rank", F.round("weight", 6).alias("weight"))


@query("m5_standardise", """WITH f AS (SELECT l_orderkey, l_linenumber, ln(1 + l_quantity) AS q, l_tax AS t FROM lineitem),
  m AS (SELECT avg(q) AS qm, stddev_pop(q) AS qs, avg(t) AS tm, stddev_pop(t) AS ts FROM f)
  SELECT l_orderkey, l_linenumber, round((q - qm) / qs, 6) AS q, round((t - tm) / ts, 6) AS t FROM f, m""")
def m5(spark, sf):
    f = V.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.log1p("l_quantity").alias("q"), F.col("l_tax").alias("t"))
    z = N.scale(f, N.fit_scaler(f, ["q", "t"]), ["q", "t"])
    return z.withColumns({c: F.round(c, 6) for c in ("q", "t")})


@query("m6_one_hot", """SELECT doc_id, CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lang_en, CASE WHEN lang = 'de' THEN 1.0::DOUBLE
  ELSE 0.0::DOUBLE END AS lang_de FROM documents""")
def m6(spark, sf):
    return V.load(spark, sf, "documents").select("doc_id", *N.one_hot("lang", ["en", "de"]))


@query("m14_class_weights", f"""WITH {GOLD}, c AS (SELECT true_label, count(*) AS n FROM gold GROUP BY true_label)
  SELECT g.doc_id, g.true_label, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * c.n), 6) AS weight
  FROM gold g JOIN c ON c.true_label = g.true_label""")
def m14(spark, sf):
    w = N.class_weights(V.gold(spark, sf).select("doc_id", "true_label"), "true_label")
    return w.select("doc_id", "true_label", F.round("weight", 6).alias("weight"))


BENCH_WORDS = f"SELECT DISTINCT unnest(string_split({clean_sql('text')}, ' ')) AS term FROM benchmark"
LEXICON = f"""lexicon AS (SELECT term, (('0x' || substr(md5(term), 1, 4))::BIGINT % 81 - 40) / 10::DOUBLE AS valence FROM ({BENCH_WORDS}) WHERE term <> '')"""


def lexicon(spark, sf):
    """A stand-in lexicon: the words of the evaluation texts, each with a valence from its hash."""
    words = V.load(spark, sf, "benchmark").select(F.explode(F.split(T.clean_text("text"), " ")).alias("term")).filter("term <> ''").distinct()
    number = F.conv(F.substring(F.md5("term"), 1, 4), 16, 10).cast("long")
    return words.select("term", ((number % 81 - 40) / F.lit(10.0)).alias("valence"))


def word_list(values):
    return ", ".join(f"'{v}'" for v in values)


UP, DOWN, NOT = ("is", "it", "very"), ("this", "by"), ("not", "no", "that")
SENT_SQL = f"""WITH {CLEANED}, {LEXICON}, t AS (SELECT doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM
    (SELECT doc_id, list_filter(string_split(clean, ' '), lambda w: w <> '') AS ts FROM cleaned)),
  c AS (SELECT *, lag(term, 1) OVER w AS p1, lag(term, 2) OVER w AS p2, lag(term, 3) OVER w AS p3 FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  v AS (SELECT c.*, l.valence + sign(l.valence) * (""" + " + ".join(
    f"CASE WHEN p{d} IN ({word_list(UP)}) THEN 0.293::DOUBLE * {damp} WHEN p{d} IN ({word_list(DOWN)}) THEN -0.293::DOUBLE * {damp} ELSE 0 END"
    for d, damp in ((1, "1.0"), (2, "0.95"), (3, "0.9"))) + f""") AS boosted FROM c JOIN lexicon l ON l.term = c.term),
  s AS (SELECT doc_id, sum(CASE WHEN coalesce(p1 IN ({word_list(NOT)}), false) OR coalesce(p2 IN ({word_list(NOT)}), false)
    OR coalesce(p3 IN ({word_list(NOT)}), false) THEN boosted * -0.74::DOUBLE ELSE boosted END) AS total FROM v GROUP BY doc_id)"""


@query("l11_sentiment", SENT_SQL + " SELECT d.doc_id, round(coalesce(total / sqrt(total * total + 15), 0), 6) AS compound FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id")
def l11(spark, sf):
    c = compound(cleaned(spark, sf), "doc_id", "clean", lexicon(spark, sf), negations=NOT, up=UP, down=DOWN)
    return c.select("doc_id", F.round("compound", 6).alias("compound"))


@query("l11b_sentiment_classes", SENT_SQL + """ SELECT CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment, count(*) AS n
  FROM (SELECT coalesce(total / sqrt(total * total + 15), 0) AS c FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id) GROUP BY 1""")
def l11b(spark, sf):
    c = compound(cleaned(spark, sf), "doc_id", "clean", lexicon(spark, sf), negations=NOT, up=UP, down=DOWN)
    return c.groupBy(S.sentiment_class(F.col("compound")).alias("sentiment")).agg(F.count("*").alias("n"))


@query("s8_sparse_vectors", """SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'unreadable' WHEN n_chars % 7 = 1 THEN 'length mismatch' WHEN n_chars % 7 = 2 THEN 'index out of range'
  WHEN n_chars % 7 = 3 THEN 'duplicate index' WHEN n_chars % 7 = 4 THEN 'wrong dimension' END AS error,
  CASE WHEN n_chars % 7 = 0 THEN NULL ELSE (CASE WHEN n_chars % 7 = 1 THEN 2 ELSE 3 END)::INTEGER END AS n_values FROM documents""")
def s8(spark, sf):
    """Vectors as JSON, one in seven of each kind of fault, split into valid and rejected."""
    k = F.col("n_chars") % 7
    dim = F.when(k == 4, 9).otherwise(10)
    third = F.when(k == 2, 10).when(k == 3, 1).otherwise(5)
    values = F.when(k == 1, F.array(F.lit(0.5), F.lit(0.25))).otherwise(F.array(F.lit(0.5), F.lit(0.25), F.lit(1.0)))
    js = F.when(k == 0, F.lit("{not json")).otherwise(
        F.to_json(F.struct(dim.alias("dim"), F.array(F.lit(1), F.lit(3), third).alias("indices"), values.alias("values"))))
    d = V.load(spark, sf, "documents").select("doc_id", js.alias("raw")).select("doc_id", SV.parse_sparse("raw").alias("v"))
    return d.select("doc_id", SV.sparse_error(F.col("v"), 10).alias("error"), F.size("v.values").alias("n")).select(
        "doc_id", "error", F.when(F.col("n") >= 0, F.col("n")).alias("n_values"))
