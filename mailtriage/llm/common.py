"""Column rules and Arrow plumbing that several corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailtriage.session import materialize

# ASCII white space and its complement, as the operators' contracts state them.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def residue(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty string (residue 0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch cut so that ``column`` holds at most about ``limit`` bytes in each piece.

    One larger value makes a piece of its own, so no value is cut or left out.
    """
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)



# Keys that a bounded broadcast filter tells apart.
FILTER_SLOTS = 1 << 20


def slot_of(*columns) -> Column:
    """One of FILTER_SLOTS residues; nulls have one too."""
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_SLOTS))


def split_by_slot(df: DataFrame, slot: Column, keys: DataFrame, key_slot: Column) -> tuple[DataFrame, DataFrame]:
    """(rows in no slot of ``keys``, the others): what no key can match stays where it is.

    The broadcast side has at most FILTER_SLOTS rows, whatever the number of keys.
    """
    slots = keys.select(key_slot.alias("__slot")).distinct().withColumn("__met", F.lit(True))
    met = df.withColumn("__slot", slot).join(F.broadcast(slots), "__slot", "left")
    return met.filter("__met is null").drop("__slot", "__met"), met.filter("__met").drop("__slot", "__met")


# Rows and bytes of text that go to a Python worker at a time: a batch is held on both sides, and the JVM doubles its buffers
# to fill it. A longer text is a batch of its own.
TEXT_ROWS, TEXT_BYTES = 1_000, 8 << 20
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialize_texts(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for a step that sends texts to Python workers: in smaller batches than the session's."""
    conf = df.sparkSession.conf
    rows, size = int(conf.get(_BATCH_ROWS)), conf.get(_BATCH_BYTES)
    conf.set(_BATCH_ROWS, str(min(TEXT_ROWS, rows) if rows > 0 else TEXT_ROWS))
    conf.set(_BATCH_BYTES, str(TEXT_BYTES))
    try:
        return materialize(df, name)
    finally:
        conf.set(_BATCH_ROWS, str(rows))
        conf.set(_BATCH_BYTES, size)


def released(run):
    """``run``, after whose last batch a worker gives its free memory back: it may stay idle beside the JVM for a minute."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library keeps what it keeps.
        pass


def discard(df: DataFrame) -> None:
    """Remove a materialized table whose followers are written: nothing reads it again."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
