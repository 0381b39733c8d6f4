"""Readers with fixed schemas: raw corpus, labelled text, label batches, provider messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from mailtriage.functions import headers as H, mime as M

CORPUS = T.StructType([T.StructField("file", T.StringType()), T.StructField("message", T.StringType())])
LABEL_BATCH = T.StructType([T.StructField("file", T.StringType()), T.StructField("true_category", T.StringType())])
TEXT_NAMES = ("text", "message", "body")
LABEL_NAMES = ("label", "class", "spam", "target")


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().strip() for c in df.columns])


def read_corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw mail from CSV with multi-line messages; bad rows are dropped.

    Multi-line CSV cannot be split, so one file is one task: convert it once with
    ``corpus_to_parquet`` and read Parquet from then on.
    """
    return (
        spark.read.schema(CORPUS).option("header", True).option("multiLine", True).option("quote", '"')
        .option("escape", '"').option("mode", "DROPMALFORMED").csv(path)
    )


def corpus_to_parquet(spark: SparkSession, csv_path: str, out: str, partitions: int | None = None) -> DataFrame:
    raw = read_corpus_csv(spark, csv_path)
    spread = raw.repartition(partitions, "file") if partitions else raw.repartition("file")
    spread.write.mode("errorifexists").parquet(out)
    return spark.read.schema(CORPUS).parquet(out)


def read_label_batches(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.schema(LABEL_BATCH).option("header", True).csv(glob)


def find_column(names: Sequence[str], wanted: Sequence[str]) -> str:
    for name in names:
        if any(w in name for w in wanted):
            return name
    raise ValueError(f"none of {list(names)} contains one of {list(wanted)}")


def binary_label(c: Column, dtype: str) -> Column:
    """Text labels: spam, 1, yes and true mean 1, all else 0. Numbers are cut to 0..1."""
    if dtype == "string":
        return F.when(F.lower(F.trim(c)).isin("spam", "1", "yes", "true"), 1).otherwise(0)
    return F.least(F.greatest(c.cast("int"), F.lit(0)), F.lit(1))


def labelled_text(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``text, label`` from a frame with unknown column names; rows with a null are dropped."""
    df = lower_names(df)
    text = find_column([c for c in df.columns if c not in keep], TEXT_NAMES)
    label = find_column([c for c in df.columns if c not in keep and c != text], LABEL_NAMES)
    rows = df.dropna(subset=[text, label])
    return rows.select(*keep, F.col(text).alias("text"), binary_label(F.col(label), dict(df.dtypes)[label]).alias("label"))


def parse_provider_messages(df: DataFrame, raw: str) -> DataFrame:
    """Exported provider messages (one JSON string a row) as mailbox rows; a text that is no JSON gives nulls and no body."""
    v, get = F.try_parse_json(raw), F.try_variant_get
    m = df.select(F.col(raw).alias("raw"), v.alias("v")).select(
        get("v", "$.id", "string").alias("id"), get("v", "$.labelIds", "array<string>").alias("labelIds"),
        get("v", "$.payload.headers", M.HEADERS).alias("headers"), M.flatten_parts(get("v", "$.payload", "variant"), F.col("raw")).alias("parts"))
    text, html = M.select_bodies(F.col("parts"))
    hs = F.col("headers")
    fields = m.select(
        "id", "labelIds", text.alias("body"), html.alias("body_html"),
        *[M.named_header(hs, n).alias(a) for n, a in (
            ("Subject", "subject"), ("To", "to_addr"), ("Cc", "cc_addr"), ("From", "h_from"), ("Date", "h_date"),
            ("List-Unsubscribe", "h_unsub"), ("Precedence", "h_precedence"))],
    )
    name, address = H.sender_name_and_address("h_from")
    return fields.select(
        "id", "subject", "body", "body_html", "to_addr", F.nullif(F.col("cc_addr"), F.lit("")).alias("cc_addr"),
        name.alias("from_name"), address.alias("from_addr"), (F.col("h_unsub") != "").alias("list_unsubscribe"),
        F.nullif(F.col("h_precedence"), F.lit("")).alias("precedence"), H.local_datetime("h_date").alias("sent_at"),
        F.coalesce(F.array_contains("labelIds", "UNREAD"), F.lit(False)).alias("unread"),
    )
