"""Sinks: predictions, scored tables, labelling sheets, training matrices, feature cache."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mailtriage.functions.text import content_key, snippet


def append_predictions(df: DataFrame, path: str, run_id: str) -> None:
    """Append one run's predictions; a repeated run replaces its own partition only."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("run_id").parquet(path)


def versions(spark: SparkSession, root: str) -> DataFrame:
    """``number, folder`` of the versions of a table that are complete.

    A manifest is one small file that its commit renames into place: it is there whole or not at all.
    """
    line = F.split("value", " ")
    return spark.read.text(f"{root}/_manifests/*").select(F.get(line, F.lit(0)).cast("long").alias("number"), F.get(line, F.lit(1)).alias("folder"))


def _last_number(spark: SparkSession, root: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifests")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # Folders of writers that are still at work count, so that no number is given twice.
    return max((int(x.getPath().getName()) for x in fs.listStatus(path)), default=0) if fs.exists(path) else 0


def write_version(df: DataFrame, root: str) -> str:
    """Write a table as a new version: its rows to a new folder, then a manifest of the next number.

    Nothing is overwritten or deleted. Readers take the newest complete manifest, those at an older
    version keep it, and a writer that fails leaves none. Of two writers at one number the second
    finds the folder and takes the next.
    """
    version, spark = f"v-{uuid.uuid4().hex}", df.sparkSession
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
    number = _last_number(spark, root) + 1
    while True:
        line = spark.range(1).select(F.concat(F.lit(f"{number} {version}")).alias("value")).coalesce(1)
        try:
            line.write.mode("errorifexists").text(f"{root}/_manifests/{number:012d}")
            return f"{root}/{version}"
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            number += 1


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The newest version, or the one of a number."""
    found = versions(spark, root)
    row = found.filter(F.lit(number is None) | (F.col("number") == F.lit(number))).orderBy(F.desc("number")).first()
    if row is None:
        raise ValueError(f"no version {number} of {root}")
    return spark.read.parquet(f"{root}/{row.folder}")


def labelling_sheet(df: DataFrame, start: int, end: int, key: str = "msg_id") -> DataFrame:
    """Numbered text entries ``[start, end)`` in key order.

    Only the first ``end`` rows by key are ranked, so the one-task window holds ``end`` rows.
    """
    from pyspark.sql import Window as W

    head = df.orderBy(key).limit(end)
    i = F.row_number().over(W.orderBy(key)) - 1
    numbered = head.withColumn("i", i.cast("long")).filter(F.col("i") >= start)
    entry = F.concat(
        F.lit("=== ["), F.col("i").cast("string"), F.lit("] file="), "file", F.lit(" ===\nSUBJECT: "), "subject",
        F.lit("\nBODY: "), snippet("body", 500),
    )
    return numbered.select("i", entry.alias("entry"))


def write_sheet(sheet: DataFrame, path: str) -> None:
    sheet.orderBy("i").select("entry").coalesce(1).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def new_texts(df: DataFrame, text: str, cached: DataFrame) -> DataFrame:
    """Distinct texts whose key is not in the feature cache yet."""
    keyed = df.withColumn("text_key", content_key(text))
    fresh = keyed.join(cached.select("text_key"), "text_key", "left_anti")
    return fresh.groupBy("text_key").agg(F.any_value(text).alias(text))


def write_training_matrix(df: DataFrame, path: str) -> DataFrame:
    """Write ``(…, features struct)`` rows and read them back with an ML vector column.

    The struct has the storage form of an ML vector, so the Parquet reader yields vectors without a
    Python function. The file is the exported training matrix and also ends the lineage.
    """
    df.write.mode("errorifexists").parquet(path)
    return read_training_matrix(df.sparkSession, path, df.schema)


def read_training_matrix(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    from pyspark.ml.linalg import VectorUDT

    fields = [T.StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)
