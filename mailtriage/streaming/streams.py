"""Structured Streaming jobs: scoring, corrections, retrain triggers, event counts, sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mailtriage import constants as K
from mailtriage.operators import corrections as C
from mailtriage.session import work_path


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """One table, a file or a folder of files, as a stream of files with the schema of the stored table."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A file source takes a folder or a pattern, but no single file: the pattern stands for this one name.
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def event_time(df: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Watermarked event time; a watermark needs a zoned timestamp."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def run_to_table(df: DataFrame, name: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run a stream over the data that is there and return what it wrote.

    Each micro-batch replaces its own folder, so a retried batch is written once. In update mode a
    batch writes only the rows that it changed and the last one per ``keys`` counts: state behind the
    watermark is dropped. In complete mode the last batch is the result.
    """
    spark = df.sparkSession
    out, last = work_path(spark, name), []

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        last.append(batch_id)

    q = (df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", work_path(spark, f"{name}-state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if mode == "update":
        rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(out)
        newest = F.max_by(F.struct(*df.columns), "batch_id").alias("row")
        return rows.groupBy(*keys).agg(newest).select("row.*")
    path = f"{out}/batch_id={max(last)}" if mode == "complete" else f"{out}/batch_id=*"
    return spark.read.schema(df.schema).parquet(path)


def run_batches(df: DataFrame, name: str, step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Run a stream and return what ``step`` makes of its micro-batches.

    Tables that ``step`` reads are read anew for each batch, so a version promoted between two batches shows in
    the second; a retried batch replaces its own folder.
    """
    spark, out = df.sparkSession, work_path(df.sparkSession, name)
    q = (df.writeStream.foreachBatch(lambda batch, i: step(batch, i).write.mode("overwrite").parquet(f"{out}/batch_id={i}"))
         .option("checkpointLocation", work_path(spark, f"{name}-state")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


def with_end(events: DataFrame, time: str, end: DataFrame) -> DataFrame:
    """``events`` and a stream of end marks: rows whose only value is a time after all events that will come.

    The watermark follows an end mark, so append mode gives out everything before it and drops the state.
    """
    return events.unionByName(end.select(F.col(time).cast(events.schema[time].dataType).alias(time)), allowMissingColumns=True)


# --- corrections as a table of deltas ----------------------------------------------------------

def correction_sink(root: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer: last write per key of the batch, as one delta folder.

    A delta costs only its batch, never a rewrite of the table; a repeated batch id replaces its own
    folder, so a retry changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        C.latest(batch, C.CORRECTION_KEY, ["created_at", "event_id"]).write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    return write


def read_corrections(spark: SparkSession, root: str) -> DataFrame:
    """Current corrections over all deltas."""
    return C.latest(spark.read.parquet(root).drop("batch_id"), C.CORRECTION_KEY, ["created_at", "event_id"])


def compact_corrections(spark: SparkSession, root: str, new_root: str) -> None:
    """Fold all deltas into one base delta under a new root; readers and the sink then move there."""
    read_corrections(spark, root).write.mode("errorifexists").parquet(f"{new_root}/batch_id=-1")


# --- retrain triggers --------------------------------------------------------------------------

TRIGGER = "user_id long, model string, correction_count long"


def count_to_threshold(threshold: int = K.RETRAIN_THRESHOLD):
    """State per (user, model): corrections seen. Emits a row at every ``threshold``-th new one.

    A batch of a group arrives in pieces and only its size is used, so a very active user costs a
    pass over the batch and two numbers of state.
    """
    def step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, fired = state.get if state.exists else (0, 0)
        seen += sum(len(p) for p in pieces)
        rows = []
        while seen - fired >= threshold:
            fired += threshold
            rows.append([*key, fired])
        state.update((seen, fired))
        yield pd.DataFrame(rows, columns=["user_id", "model", "correction_count"])

    return step


def retrain_triggers(corrections: DataFrame, threshold: int = K.RETRAIN_THRESHOLD) -> DataFrame:
    """A trigger for each five new corrections of a (user, model).

    Correcting a message again does not count, so deliveries are first reduced to one per message.
    Only the keys travel to the stateful step.
    """
    fresh = corrections.select(*C.CORRECTION_KEY).dropDuplicates(list(C.CORRECTION_KEY))
    return fresh.groupBy(*C.MODEL_KEY).applyInPandasWithState(
        count_to_threshold(threshold), TRIGGER, "seen long, fired long", "append", GroupStateTimeout.NoTimeout)


# --- event counts ------------------------------------------------------------------------------

def daily_counts(events: DataFrame, time: str, label: str) -> DataFrame:
    """Events per day and label: a tumbling window on a table or a stream."""
    w = F.window(time, "1 day")
    return events.groupBy(w.alias("w"), label).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), label, "n")


def action_rates(events: DataFrame, time: str, action: str, size: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    """Events and mean value per action in a sliding window."""
    w = F.window(time, size, slide)
    return events.groupBy(w.alias("w"), action).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(
        F.col("w.start").alias("window_start"), action, "n", "mean_value")


def sessions(events: DataFrame, user: str, time: str, gap: str = "30 minutes") -> DataFrame:
    """Reading sessions on a stream: events closer than the gap belong together."""
    s = F.session_window(time, gap)
    return events.groupBy(user, s.alias("s")).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def sessions_batch(events: DataFrame, user: str, time: str, gap_minutes: int = 30) -> DataFrame:
    """The same sessions over a table.

    Events in one slot as wide as the gap are always in one session, so slots are aggregated first.
    A user then has at most one row per slot of the calendar, however many events there are, and
    only these rows are ordered per user.
    """
    gap = gap_minutes * 60_000_000
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    slots = events.select(user, micros.alias("t")).withColumn("slot", F.floor(F.col("t") / gap)).groupBy(user, "slot").agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    order = W.partitionBy(user).orderBy("slot")
    starts = slots.withColumn("new", F.when(F.col("lo") - F.lag("hi").over(order) <= gap, 0).otherwise(1))
    numbered = starts.withColumn("sid", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(user, "sid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).select(
        user, F.timestamp_micros("lo").alias("session_start"), F.timestamp_micros(F.col("hi") + gap).alias("session_end"), "n")


def suppress_duplicates(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key within the watermark delay; state is dropped after it."""
    return events.dropDuplicatesWithinWatermark(keys)


def apply_active(arriving: DataFrame, versions: DataFrame, current: DataFrame) -> DataFrame:
    """Arriving results with the user's active model version and corrected label where there is one.

    Static sides are joined by key; Spark broadcasts one only if it is small enough.
    """
    shown = current.select(*C.CORRECTION_KEY, F.col("corrected_label").alias("_label"))
    out = arriving.join(versions.withColumnRenamed("version", "active_version"), list(C.MODEL_KEY), "left")
    return out.join(shown, list(C.CORRECTION_KEY), "left").withColumn("shown_label", F.coalesce("_label", "predicted_label")).drop("_label")
