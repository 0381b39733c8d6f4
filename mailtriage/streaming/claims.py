"""Open claims of retrains: at most one per (user, model), from the corrections since the last attempt.

State per key holds the corrections seen, those of the newest attempt, and the open claim with its timer. A claim opens
when enough corrections came after the last attempt, and is emitted once. While it is open nothing more is emitted: an
attempt (a result row, passed or rejected) closes it, and so does its timer where the job that held it never ended.
Closing looks at the count again, so corrections that came in meanwhile open the next claim.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mailtriage import constants as K
from mailtriage.operators import corrections as C
from mailtriage.session import ship

CLAIM = "user_id long, model string, correction_count long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
# How long a claim waits for its result.
PATIENCE_MS = 3_600_000
_STATE = "seen long, attempted long, version long, claimed boolean, timer long"


@contextmanager
def rocksdb(spark: SparkSession, idle_batches: bool = True):
    """Streams that start inside keep their state in RocksDB, off the heap.

    Timers of the wall clock ask for one batch after another, data or not: what a long-running stream needs, and what a run
    over the data that is there must leave out (``idle_batches``), or it never ends.
    """
    wanted = {PROVIDER: ROCKSDB, IDLE: str(idle_batches).lower()}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class Claims(StatefulProcessor):
    """Rows with a version are attempts; the others are new corrections."""

    def __init__(self, threshold: int = K.RETRAIN_THRESHOLD, patience_ms: int = PATIENCE_MS):
        self.threshold, self.patience_ms = threshold, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("claim", _STATE)

    def _look(self, key: Any, now: int, seen: int, attempted: int, version: int, claimed: bool, timer: int) -> Iterator[pd.DataFrame]:
        if not claimed and timer >= 0:
            self.handle.deleteTimer(timer)
            timer = -1
        opens = not claimed and seen - attempted >= self.threshold
        if opens:
            claimed, timer = True, now + self.patience_ms
            self.handle.registerTimer(timer)
        self.state.update((seen, attempted, version, claimed, timer))
        if opens:
            yield pd.DataFrame([[*key, seen]], columns=["user_id", "model", "correction_count"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, attempted, version, claimed, timer = self.state.get() if self.state.exists() else (0, 0, -1, False, -1)
        # A batch comes in pieces, in no order: attempts count before the corrections are looked at.
        for piece in rows:
            results = piece[piece["version"].notna()]
            seen += len(piece) - len(results)
            if len(results):
                claimed = False
                last = results.loc[results["version"].astype("int64").idxmax()]
                if int(last["version"]) > version:
                    version, attempted = int(last["version"]), int(last["attempted"])
        yield from self._look(key, timerValues.getCurrentProcessingTimeInMs(), seen, attempted, version, claimed, timer)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, attempted, version, _, _ = self.state.get()
        # The timer that fired is gone by itself.
        yield from self._look(key, timerValues.getCurrentProcessingTimeInMs(), seen, attempted, version, False, -1)

    def close(self) -> None:
        pass


def retrain_claims(corrections: DataFrame, attempts: DataFrame, threshold: int = K.RETRAIN_THRESHOLD, patience_ms: int = PATIENCE_MS) -> DataFrame:
    """A stream of claims from a stream of corrections and one of attempts (``user_id, model, version, correction_count``).

    Correcting a message again does not count. Only keys and numbers travel to the stateful step. Start it inside ``rocksdb``.
    """
    ship(corrections.sparkSession)
    none = F.lit(None).cast("long")
    fresh = corrections.select(*C.CORRECTION_KEY).dropDuplicates(list(C.CORRECTION_KEY)).select(*C.MODEL_KEY, none.alias("version"), none.alias("attempted"))
    results = attempts.select(*C.MODEL_KEY, F.col("version").cast("long").alias("version"), F.col("correction_count").cast("long").alias("attempted"))
    return fresh.unionByName(results).groupBy(*C.MODEL_KEY).transformWithStateInPandas(
        statefulProcessor=Claims(threshold, patience_ms), outputStructType=CLAIM, outputMode="Append", timeMode="ProcessingTime")


def due_claims(current: DataFrame, attempts: DataFrame, threshold: int = K.RETRAIN_THRESHOLD) -> DataFrame:
    """The same claims over tables, where none is open yet."""
    last = C.last_attempt(attempts).select(*C.MODEL_KEY, F.col("correction_count").alias("_at"))
    counted = C.counts(current).join(last, list(C.MODEL_KEY), "left")
    return counted.filter(F.col("correction_count") - F.coalesce("_at", F.lit(0)) >= threshold).select(*C.MODEL_KEY, "correction_count")
