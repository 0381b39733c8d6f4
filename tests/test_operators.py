import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mailtriage import constants as K
from mailtriage.functions.ngrams import char_wb_ngrams, term_counts, word_ngrams
from mailtriage.functions.sparse import parse_sparse, sparse_error
from mailtriage.operators import corrections as C, evaluate as E, labels as LB, mailbox as MB, numeric as N, sampling as SP, vocab as VO
from mailtriage.operators.sentiment import compound


def order(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds nearly all rows, one has a null label, one is tiny."""
    rows = [(i, "hot" if i % 50 else ("rare" if i % 100 else None)) for i in range(5000)]
    return rows, spark.createDataFrame(rows, "id long, g string").repartition(8)


def groups_of(rows):
    out = defaultdict(list)
    for i, g in rows:
        out[g].append(i)
    return {g: sorted(v, key=lambda i: (order(3, i), i)) for g, v in out.items()}


def test_exact_rank_under_skew(skewed):
    rows, df = skewed
    want = {(g, i): n for g, v in groups_of(rows).items() for n, i in enumerate(v, 1)}
    got = {(r.g, r.id): (r["rank"], r.group_size) for r in SP.rank_in_group(df, "g", "id", 3).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(size == sum(1 for _, h in rows if h == g) for (g, _), (_, size) in got.items())


def test_samples(skewed):
    rows, df = skewed
    for n in (7, 1500):
        got = {(r.g, r.id) for r in SP.sample_per_group(df, "g", "id", n, 3).collect()}
        assert got == {(g, i) for g, v in groups_of(rows).items() for i in v[:n]}
    test = Counter(r.g for r in SP.holdout(df, "g", "id", 0.15, 3).filter("is_test = 1").collect())
    assert test == {g: math.ceil(0.15 * len(v)) for g, v in groups_of(rows).items()}
    folds = Counter((r.g, r.fold) for r in SP.assign_folds(df, "g", "id", 5, 3).collect())
    for g, v in groups_of(rows).items():
        assert max(folds[g, f] for f in range(5)) - min(folds[g, f] for f in range(5)) <= 1


def test_group_limit_runs_before_the_exchange(skewed):
    _, df = skewed
    plan = SP.sample_per_group(df, "g", "id", 7, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_half_split_needs_four(spark):
    df = spark.createDataFrame([("a", i) for i in range(3)] + [("b", i) for i in range(5)], "g string, id long")
    got = defaultdict(list)
    for r in SP.half_split(df, "g", "id", 0).collect():
        got[r.g].append(r.half)
    assert got["a"] == [None] * 3 and sorted(got["b"]) == [0, 0, 1, 1, 1]


def test_keep_first_with_many_copies(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(300)], "id long, t string").repartition(8)
    got = {r.t: r.id for r in SP.keep_first(df, F.col("t"), "id").collect()}
    assert got["same"] == 1 and len(got) == 101


def test_noise_keeps_every_row(spark):
    df = spark.createDataFrame([(i, "hot", "x" if i else "y") for i in range(200)] + [(999, "ok", "x")], "id long, t string, l string")
    got = LB.noisy_duplicates(df, F.col("t"), "l").collect()
    assert len(got) == 200 and {r.n_labels for r in got} == {2} and {r.n_copies for r in got} == {200}


def test_word_and_char_grams(spark):
    df = spark.createDataFrame([("",), ("a",), ("ab cd",), ("the cat the dog",)], "c string")
    w = [r.g for r in df.select(word_ngrams(F.col("c"), 1, 2).alias("g")).collect()]
    assert w == [[], [], ["ab", "cd", "ab cd"], ["the", "cat", "the", "dog", "the cat", "cat the", "the dog"]]
    assert df.select(word_ngrams(F.col("c"), 1, 2, ["the"]).alias("g")).collect()[3].g == ["cat", "dog", "cat dog"]

    def brute(text):
        out = Counter()
        for word in text.split():
            p = f" {word} "
            for n in (3, 4, 5):
                out.update(p[i:i + n] for i in range(len(p) - n + 1))
        return out

    for r in df.select("c", char_wb_ngrams(F.col("c")).alias("g")).collect():
        assert Counter(r.g) == brute(r.c)
    counts = df.select("c", term_counts(char_wb_ngrams(F.col("c"))).alias("g")).collect()
    assert all({x.term: x.tf for x in r.g} == brute(r.c) for r in counts)


def test_tfidf_norms_and_brute_force(spark):
    texts = ["cat dog cat", "dog bird", "fish", "unknown words only here", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, clean string")
    spec = VO.word_spec(3, 1)
    m = VO.fit_text(df, "clean", spec)
    assert m.terms == sorted(["cat", "dog", "bird"])
    got = {r.id: dict(zip(r.word_idx, r.word_val)) for r in m.transform(df, "clean").collect()}
    idf = dict(zip(m.terms, m.idf))
    assert abs(idf["dog"] - (math.log(6 / 3) + 1)) < 1e-12
    cat, dog = (1 + math.log(2)) * idf["cat"], idf["dog"]
    assert abs(got[0][m.terms.index("cat")] - cat / math.hypot(cat, dog)) < 1e-12
    for i in (0, 1):
        assert abs(sum(v * v for v in got[i].values()) - 1) < 1e-12
    assert got[2] == got[3] == got[4] == {}


def test_fold_vocabularies_do_not_see_their_fold(spark):
    df = spark.createDataFrame([(0, "aa bb"), (0, "aa"), (1, "cc"), (1, "cc bb"), (2, "dd bb")], "fold int, clean string")
    models = VO.fit_text_by_fold(df, "clean", VO.word_spec(100, 1), "fold")
    for f, m in models.items():
        want = VO.fit_text(df.filter(F.col("fold") != f), "clean", VO.word_spec(100, 1))
        assert m.terms == want.terms and m.idf == pytest.approx(want.idf)


def test_gate_rules(spark):
    def gate(own_hits, own, hits, scored, base, custom=0):
        rows = [(True, "a", "a" if i < own_hits else "b", "a") for i in range(own)]
        rows += [(False, "a", "a" if i < hits else "b", "a" if i < round(base * (scored + custom)) else "b") for i in range(scored)]
        rows += [(False, "a", "new", "a" if scored + i < round(base * (scored + custom)) else "b") for i in range(custom)]
        df = spark.createDataFrame(rows, "own boolean, t string, p string, b string").withColumn("m", F.lit(1))
        return E.gate_metrics(df, ["m"], F.col("own"), F.col("t"), F.col("p"), F.col("b"), ["a", "b"]).first()

    assert gate(5, 5, 9, 10, 0.9).reason is None
    assert gate(3, 5, 10, 10, 0.9).reason == "corrections"
    assert gate(5, 5, 8, 10, 0.9).reason == "accuracy"
    ok = gate(5, 5, 9, 9, 0.9, custom=1)
    assert ok.reason is None and ok.gate_accuracy == 1.0 and abs(ok.custom_fraction - 0.1) < 1e-12
    assert gate(5, 5, 8, 8, 0.9, custom=2).reason == "custom labels"


def test_report_with_missing_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a")], "t string, p string")
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in E.class_report(df, "t", "p").collect()}
    assert got == {"a": (0.5, 0.5, 0.5, 2), "b": (0.0, 0.0, 0.0, 1), "c": (0.0, 0.0, 0.0, 0)}
    m = E.confusion_matrix(df, "t", "p", ["a", "b", "c"])
    assert sum(sum(r[c] for c in m.columns[1:]) for r in m.collect()) == 3


def test_confidence_gate_never_accepts_an_unknown_class(spark):
    df = spark.createDataFrame([("Work", 0.6), ("Work", 0.59), ("Mystery", 0.99), (None, 0.9)], "p string, c double")
    assert [r.decision for r in E.confidence_gate(df, "p", "c").collect()] == ["accepted", "review", "review", "review"]


def test_correction_counts(spark):
    def frame(n):
        rows = [(1, f"m{i}", "category", f"2024-01-0{i + 1}", i, "Work") for i in range(n)]
        return spark.createDataFrame(rows, "user_id long, message_id string, model string, created_at string, event_id long, corrected_label string")

    none = spark.createDataFrame([], "user_id long, model string, version long, created_at string, correction_count long, passed int")
    one = spark.createDataFrame([(1, "category", 1, "2024-01-06", 5, 1)], none.schema)
    left = lambda n, a: C.remaining(frame(n), a).first().corrections_until_retrain
    assert (left(3, none), left(5, none), left(5, one)) == (2, 0, 5)
    # Correcting a message again keeps the count and makes the key changed since the attempt.
    again = frame(5).unionByName(spark.createDataFrame([(1, "m0", "category", "2024-01-09", 9, "Other")], frame(1).schema))
    cur = C.latest(again, C.CORRECTION_KEY, ["created_at", "event_id"])
    assert C.remaining(cur, one).first().corrections_until_retrain == 5
    assert C.changed_since_attempt(cur, one).count() == 1 and C.changed_since_attempt(frame(5), one).count() == 0


def test_version_history(spark):
    schema = "user_id long, model string, version long, passed int"
    h = C.with_status(spark.createDataFrame([(1, "spam", 1, 1), (1, "spam", 2, 0)], schema))
    got = C.promote(h, spark.createDataFrame([(1, "spam", 3, 1)], schema)).orderBy("version").collect()
    assert [r.status for r in got] == ["superseded", "rejected", "active"]
    assert C.next_version(spark.createDataFrame([(1, "spam", 3, 1)], schema)).first().next_version == 4


def test_sparse_errors(spark):
    raw = ['{"dim":3,"indices":[0,2],"values":[1,2]}', '{"dim":3,"indices":[0],"values":[1,2]}', '{"dim":3,"indices":[0,3],"values":[1,2]}',
           '{"dim":3,"indices":[1,1],"values":[1,2]}', '{"dim":4,"indices":[],"values":[]}', "[]", None]
    df = spark.createDataFrame([(r,) for r in raw], "r string").select(parse_sparse("r").alias("v"))
    got = [r.e for r in df.select(sparse_error(F.col("v"), 3).alias("e")).collect()]
    assert got == [None, "length mismatch", "index out of range", "duplicate index", "wrong dimension", "unreadable", "unreadable"]


def test_validation(spark):
    rows = [("category", "  Trips ", 0.5), ("category", "x" * 41, 0.5), ("category", "   ", 0.5), ("priority", "urgent", 0.5), ("spam", "ham", 1.2), ("mood", "ok", 0.1), ("spam", "spam", 0.0)]
    df = LB.validate_corrections(spark.createDataFrame(rows, "m string, l string, p double"), "m", "l", "p").collect()
    assert [r.error for r in df] == [None, "label is too long", "label is blank", "not a priority label", "confidence out of range", "unknown model", None]
    assert df[0].l == "Trips"


def test_shown_labels_and_views(spark):
    res = spark.createDataFrame([(1, "m1", "Work", "low", 0.3), (1, "m2", "Work", "low", 0.3)], "user_id long, message_id string, cat string, bucket string, score double")
    cur = spark.createDataFrame([(1, "m1", "priority", "high")], "user_id long, message_id string, model string, corrected_label string")
    got = C.shown_labels(res, cur, ["user_id", "message_id"], {"category": "cat", "priority": "bucket"}).orderBy("message_id").collect()
    assert [(r.shown_category, r.shown_priority, r.shown_score, r.bucket) for r in got] == [("Work", "high", 0.8, "low"), ("Work", "low", 0.3, "low")]
    box = spark.createDataFrame([(1, 0, "Work", "high", 1), (2, 1, "Other", "low", 0)], "msg_id long, archived int, category string, bucket string, unread int")
    assert [r.msg_id for r in MB.view(box, archived=True, category="Work").collect()] == [2]
    assert box.filter(MB.matches_query("  ", ["category"])).count() == 2


def test_scaler_and_one_hot(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (3.0, 5.0, "z")], "x double, k double, c string")
    z = N.scale(df, N.fit_scaler(df, ["x", "k"]), ["x", "k"]).collect()
    assert [(r.x, r.k) for r in z] == [(-1.0, 0.0), (1.0, 0.0)]
    assert [tuple(r) for r in df.select(*N.one_hot("c", ["a", "b"])).collect()] == [(1.0, 0.0), (0.0, 0.0)]


def test_sentiment_modifiers(spark):
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "term string, valence double")
    df = spark.createDataFrame([(0, "good"), (1, "not good"), (2, "very bad"), (3, "plain"), (4, "")], "id long, clean string")
    got = {r.id: r.compound for r in compound(df, "id", "clean", lex).collect()}
    norm = lambda s: s / math.sqrt(s * s + 15)
    assert got[0] == pytest.approx(norm(2)) and got[1] == pytest.approx(norm(-1.48)) and got[2] == pytest.approx(norm(-2.293))
    assert got[3] == got[4] == 0.0


def test_sentiment_in_the_row_equals_the_join(spark):
    words = ["good", "bad", "fine", "not", "very", "hardly", "plain", "never", "so"]
    rng = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(200)] + [(200, None)], "id long, clean string")
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.5), ("fine", 0.8), ("fine", 0.1), ("absent", 1.0)], "term string, valence double")
    inside, joined = compound(df, "id", "clean", lex, bound=100), compound(df, "id", "clean", lex, bound=3)
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Exchange" in joined._jdf.queryExecution().executedPlan().toString()
    a, b = ({r.id: r.compound for r in x.collect()} for x in (inside, joined))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-12 for i in a) and len(set(a.values())) > 20
    assert {r.compound for r in compound(df, "id", "clean", lex.limit(0), bound=9).collect()} == {0.0}


def test_versions_stay_for_their_readers(spark):
    from mailtriage.session import work_path
    from mailtriage.sources import sinks as S

    root = work_path(spark, "versions-test")
    with pytest.raises(Exception):
        S.read_version(spark, root)
    S.write_version(spark.range(3), root)
    reader = S.read_version(spark, root)
    # A writer that stopped before its manifest, one that stopped inside it, and one that ended.
    spark.range(9).write.parquet(f"{root}/v-lost")
    spark.range(1).selectExpr("'2 v-lost' AS value").write.text(f"{root}/_manifests/000000000002/_temporary/0")
    assert S.read_version(spark, root).count() == 3
    S.write_version(spark.range(5), root)
    assert S.read_version(spark, root).count() == 5 and reader.count() == 3 and S.read_version(spark, root, 1).count() == 3
    assert sorted(r.number for r in S.versions(spark, root).collect()) == [1, 3]


def test_pruned_terms_give_the_same_vocabulary(spark):
    rng = random.Random(6)
    # Frequent words and many that occur once or twice.
    texts = [" ".join(rng.choice(["red", "green", "blue", "grey"]) if rng.random() < 0.5 else f"x{rng.randrange(4000)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(60)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "clean string").repartition(4)
    n = df.agg(F.count("*").alias("n_docs"))
    whole = VO.term_table(df, "clean", VO.word_spec(8))
    for k, share, pruned in ((8, 2, True), (3_000, 2, None), (8, 64, None), (10 ** 6, 4, False)):
        spec = VO.word_spec(k)
        terms, left_out = VO.pruned_terms(df, "clean", spec, buckets=1 << 14, share=share)
        assert pruned is None or left_out == pruned
        rows = lambda t: [tuple(r) for r in VO.vocabulary(t, n, spec).orderBy("idx").collect()]
        assert rows(terms) == rows(whole)
        if left_out:
            assert terms.count() < whole.count() / 10


def test_fixed_values():
    assert len(K.HEADER_COLS) == 9 and len(K.STYLE_COLS) == 9 and len(K.KEYWORD_COLS) == 4
