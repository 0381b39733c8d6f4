"""The corpus pipeline: what a training run gets from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Stages are written to
the shared folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailtriage.llm import budget_mixing, exact_dedup, near_jaccard, power_packing, toxicity_pu
from mailtriage.llm.queries import DOMAIN_SQL, mixing_weights, tokenizer_files
from mailtriage.session import materialize

# Of the tokens that reach the stage; no document is taken twice.
MIX_PERCENT = 90


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the labels of the given tables are learnt from, as far as their documents are here."""
    return toxicity_pu.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by pairs at a five-word Jaccard similarity of 0.8 or more the document with the smallest doc_id."""
    return near_jaccard.drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes at least one token, whole; those without tokens stay where their leaf is not cut."""
    mixed = budget_mixing.mix(docs, F.expr(DOMAIN_SQL), mixing_weights(spark), MIX_PERCENT, max_epochs=1)
    return mixed.filter("selected_tokens > 0 or (tokens = 0 and epochs > 0)").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document; no sequence crosses documents."""
    return power_packing.pack(docs, *tokenizer_files(), with_ids=False)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_duplicates), ("simhash_near_dedup", near_duplicates), ("mixing", mixing), ("packing", packing)]

# Learnt scores and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
