"""Vocabularies and TF-IDF weights of word and character n-grams.

Fitting: n-grams are counted inside each Arrow batch, then one aggregation per term gives term and
document frequency, so one small shuffle serves both. Applying: the vocabulary is bounded by
``max_features``, so terms are looked up in a table that tasks hold and weights are computed inside
the batch. No row is exploded and nothing is shuffled while scoring.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from mailtriage.functions.gramcounts import PAIR_SLOTS, SLICE_SLOTS, counts_function, first_rows, full_slots, pairs_in, term_rows
from mailtriage.functions.ngrams import char_wb_ngrams, word_ngrams
from mailtriage.session import ship


@dataclass
class GramSpec:
    """How one block of n-grams is made; ``name`` is its column prefix."""

    name: str
    min_n: int
    max_n: int
    min_df: int
    max_features: int
    analyzer: str = "word"
    stop_words: Sequence[str] = ()

    def grams(self, clean: Column) -> Column:
        if self.analyzer == "word":
            return word_ngrams(clean, self.min_n, self.max_n, self.stop_words)
        return char_wb_ngrams(clean, self.min_n, self.max_n)


def word_spec(max_features: int, min_df: int = 2, stop_words: Sequence[str] = (), name: str = "word") -> GramSpec:
    return GramSpec(name, 1, 2, min_df, max_features, "word", stop_words)


def char_spec(max_features: int, min_df: int = 3, name: str = "char") -> GramSpec:
    return GramSpec(name, 3, 5, min_df, max_features, "char_wb")


def term_table(df: DataFrame, clean: str, spec: GramSpec, groups: Sequence[str] = ()) -> DataFrame:
    """``term, tf, df`` over all rows, optionally per group (for example per fold)."""
    return counted_terms(df, clean, spec, groups).groupBy(*groups, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def counted_terms(df: DataFrame, clean: str, spec: GramSpec, groups: Sequence[str] = ()) -> DataFrame:
    """``term, tf, df`` of batches of rows; the sums per term are those of all rows."""
    ship(df.sparkSession)
    rows = df.select(*groups, clean)
    schema = T.StructType([*rows.select(*groups).schema.fields, T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("df", T.LongType())])
    return rows.mapInArrow(term_rows(spec, list(groups), clean), schema)


def vocabulary(terms: DataFrame, n_docs: DataFrame, spec: GramSpec) -> DataFrame:
    """``term, idx, tf, df, idf``: the most frequent terms that are in enough documents.

    ``n_docs`` is a one-row frame. The inverse document frequency is ``ln((n+1)/(df+1)) + 1``. The
    index order is alphabetical, over at most ``max_features`` rows.
    """
    top = terms.filter(F.col("df") >= spec.min_df).orderBy(F.desc("tf"), "term").limit(spec.max_features)
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    return (
        top.crossJoin(F.broadcast(n_docs))
        .select("term", (F.row_number().over(W.orderBy("term")) - 1).alias("idx"), "tf", "df", idf.alias("idf"))
    )


def needed_terms(df: DataFrame, clean: str, spec: GramSpec) -> DataFrame:
    """``term, tf, df`` of every term that can be in the vocabulary, from two passes over the texts; ``df`` should be written.

    Of single words and pairs, the vocabulary has at least ``max_features`` single words as frequent as the last of that many. A
    pair occurs at most as often as all pairs of its slot, so pairs of a slot below that are left out inside the tasks: most
    pairs are rare, and otherwise each of them crosses the exchange. Other specs, and texts with fewer words, are counted whole.
    """
    from mailtriage.session import materialize

    if spec.analyzer != "word" or (spec.min_n, spec.max_n) != (1, 2):
        return term_table(df, clean, spec)
    ship(df.sparkSession)
    rows = df.select(clean)
    first = materialize(rows.mapInArrow(first_rows(spec, clean), "term string, tf bigint, df bigint, slice int, sums binary"), "word-counts")
    added = lambda terms: terms.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    words = added(first.filter("term is not null"))
    last = words.filter(F.col("df") >= spec.min_df).orderBy(F.desc("tf")).limit(spec.max_features).agg(F.count("*").alias("n"), F.min("tf").alias("tf")).first()
    if not last.n or last.n < spec.max_features:
        return term_table(df, clean, spec)
    bits = bytearray(PAIR_SLOTS // 8)
    slots = first.filter("slice is not null").select("slice", "sums").groupBy("slice").applyInArrow(full_slots(last.tf), "slice int, bits binary")
    for r in slots.collect():
        bits[r.slice * SLICE_SLOTS // 8:(r.slice + 1) * SLICE_SLOTS // 8] = r.bits
    pairs = rows.mapInArrow(term_rows(spec, [], clean, pairs_in(bytes(bits))), "term string, tf bigint, df bigint")
    return words.unionByName(added(pairs))


# Buckets of the bounding counts, and one term in so many that is counted first.
BOUND_BUCKETS, TERM_SHARE = 1 << 20, 64


def pruned_terms(df: DataFrame, clean: str, spec: GramSpec, buckets: int = BOUND_BUCKETS, share: int = TERM_SHARE) -> tuple[DataFrame, bool]:
    """``term, tf, df`` of every term that can be in the vocabulary, and whether rare terms were left out before the exchange.

    1. One term in ``share``, by hash, is counted: that suggests how often the last term of the vocabulary occurs.
    2. Occurrences are summed per hash bucket, by two hashes: at most ``buckets`` rows a task, however many terms there are.
       A term occurs at most as often as any of its buckets, so a bucket below the suggestion holds none that is needed.
    3. Terms of the other buckets are counted exactly. If at least ``max_features`` of them reach the suggestion, no term left
       out can be in the vocabulary; else the suggestion was too high and all terms are counted.
    """
    from mailtriage.session import materialize

    # Four passes read the counts of the batches, one reads the texts.
    counted = materialize(counted_terms(df, clean, spec), "counted-terms")
    exact = lambda rows: rows.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    few = exact(counted.filter(F.pmod(F.xxhash64("term"), F.lit(share)) == 0)).filter(F.col("df") >= spec.min_df)
    place = max(1, spec.max_features // share)
    last = few.orderBy(F.desc("tf")).limit(place).agg(F.count("*").alias("n"), F.min("tf").alias("tf")).first()
    if last.n < place or last.tf <= spec.min_df:
        return exact(counted), False
    hashes = [F.pmod(F.xxhash64("term", F.lit(k)), F.lit(buckets)).cast("int") for k in (1, 2)]
    rows = counted
    for k, h in enumerate(hashes):
        sums = counted.groupBy(h.alias(f"b{k}")).agg(F.sum("tf").alias("n")).filter(F.col("n") >= last.tf).select(f"b{k}")
        rows = rows.withColumn(f"b{k}", h).join(F.broadcast(materialize(sums, f"term-buckets-{k}")), f"b{k}", "left_semi").drop(f"b{k}")
    found = materialize(exact(rows), "terms")
    enough = found.filter((F.col("df") >= spec.min_df) & (F.col("tf") >= last.tf)).limit(spec.max_features).count() >= spec.max_features
    return (found, True) if enough else (exact(counted), False)


def constant_array(values: Sequence[float]) -> Column:
    """A bounded list of numbers as one constant of the plan: no join, and no copy per row."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


@dataclass
class TextModel:
    """A fitted vocabulary. Its size is bounded by ``spec.max_features``, so it may be held and broadcast."""

    spec: GramSpec
    terms: list[str]
    idf: list[float]

    @property
    def size(self) -> int:
        return len(self.terms)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t, i, w) for i, (t, w) in enumerate(zip(self.terms, self.idf))]
        return spark.createDataFrame(rows, "term string, idx int, idf double")

    def transform(self, df: DataFrame, clean: str, prefix: str | None = None) -> DataFrame:
        """Adds ``<name>_idx`` and ``<name>_val``: indices and L2-normalised weights of known terms."""
        return self._looked_up(df, clean, prefix or self.spec.name, self.idf)

    def counts(self, df: DataFrame, clean: str, prefix: str | None = None) -> DataFrame:
        """Adds ``<name>_idx`` and ``<name>_val``: indices and counts of known terms."""
        return self._looked_up(df, clean, prefix or self.spec.name, None)

    def _looked_up(self, df: DataFrame, clean: str, name: str, idf: list[float] | None) -> DataFrame:
        if not self.terms:
            return df.withColumns({f"{name}_idx": F.array().cast("array<int>"), f"{name}_val": F.array().cast("array<double>")})
        ship(df.sparkSession)
        # Called nondeterministic so that a filter on its result is not moved below it, which would look every text up twice.
        known = F.arrow_udf(counts_function(self.spec, self.terms, idf), "idx array<int>, val array<double>").asNondeterministic()
        return df.withColumn(f"_{name}", known(F.col(clean))).withColumns({f"{name}_idx": F.col(f"_{name}.idx"), f"{name}_val": F.col(f"_{name}.val")}).drop(f"_{name}")


def collect_model(vocab: DataFrame, spec: GramSpec) -> TextModel:
    rows = vocab.select("idx", "term", "idf").orderBy("idx").collect()
    return TextModel(spec, [r.term for r in rows], [r.idf for r in rows])


def fit_text_by_fold(df: DataFrame, clean: str, spec: GramSpec, fold: str) -> dict[int, TextModel]:
    """One model per fold, each fitted on all other folds, from a single pass over the text.

    Terms are counted per (fold, term) once; what a fold must not see is subtracted.
    """
    from mailtriage.session import materialize

    terms = materialize(term_table(df, clean, spec, [fold]), "fold-terms")
    sizes = {r[fold]: r.n for r in df.groupBy(fold).agg(F.count("*").alias("n")).collect()}
    def one(f):
        seen = terms.filter(F.col(fold) != f).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        n_docs = df.sparkSession.createDataFrame([(sum(n for k, n in sizes.items() if k != f),)], "n_docs long")
        return collect_model(vocabulary(seen, n_docs, spec), spec)

    with ThreadPoolExecutor(len(sizes)) as pool:
        return dict(zip(sizes, pool.map(one, sizes)))


def fit_text(df: DataFrame, clean: str, spec: GramSpec) -> TextModel:
    n_docs = df.agg(F.count("*").alias("n_docs"))
    return collect_model(vocabulary(needed_terms(df, clean, spec), n_docs, spec), spec)


def long_weights(df: DataFrame, key: str, name: str, spec_model: TextModel) -> DataFrame:
    """``key, term, idx, weight`` rows of transformed documents."""
    pairs = df.select(key, F.explode(F.arrays_zip(F.col(f"{name}_idx").alias("i"), F.col(f"{name}_val").alias("w"))).alias("p"))
    vocab = F.broadcast(spec_model.frame(df.sparkSession))
    return pairs.select(key, F.col("p.i").alias("idx"), F.col("p.w").alias("weight")).join(vocab.select("idx", "term"), "idx")


def heaviest_terms(df: DataFrame, key: str, name: str, model: TextModel, n: int) -> DataFrame:
    """The ``n`` heaviest terms of each document.

    Chosen inside the row: a document's terms never leave it, only the chosen ones are joined.
    """
    ranked = F.sort_array(F.zip_with(f"{name}_val", f"{name}_idx", lambda w, i: F.struct((-w).alias("neg"), i.alias("idx"))))
    top = df.select(key, F.posexplode(F.slice(ranked, 1, n)).alias("pos", "t"))
    vocab = F.broadcast(model.frame(df.sparkSession))
    return top.select(key, (F.col("pos") + 1).alias("rank"), F.col("t.idx").alias("idx"), (-F.col("t.neg")).alias("weight")).join(
        vocab.select("idx", "term"), "idx")
