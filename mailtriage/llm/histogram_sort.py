"""Shards of near-equal bytes by histogram sort.

The order is (hash of the text, hash of the id, id): equal texts lie together and are cut only where a
boundary falls inside their group, so a group of any size spreads over as many shards as its bytes need.
Boundaries are found by counting, never by sampling: each round proposes probes between the bounds
known so far, every task counts the exact bytes and rows below each probe, and partial sums of those
few counters are all that moves. Rounds end when each boundary meets the tolerance or has no room
left. Rows are then exchanged once, to ranges that are finer than shards so that no task gets a whole
shard; a slot is the rank in the range plus the exact count of rows below it.

Defined cases: null text has size 1 and crc32 0, a null id sorts first. Rows equal in text and id cannot be
told apart and stay in one range. Empty input gives no rows. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailtriage.llm.common import shuffle_partitions, text_of
from mailtriage.session import materialize, ship

SHARDS = 16
PROBES = 64
TOLERANCE = 0.001
RANGE_ROWS = 1_000_000
MAX_RANGES = 16_384
KEY_BITS = 192


def size_of(column: str = "text") -> Column:
    return F.octet_length(text_of(column)).cast("bigint") + 1


def _key_columns() -> list[Column]:
    doc_id = F.col("doc_id").cast("bigint")
    return [F.xxhash64(text_of()).alias("k0"), F.xxhash64(doc_id).alias("k1"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("k2")]


def _key_bytes(parts: list[np.ndarray]) -> np.ndarray:
    """Three signed longs as 24 bytes whose byte order is the order of the keys."""
    out = np.empty((len(parts[0]), len(parts)), ">u8")
    for i, p in enumerate(parts):
        out[:, i] = p.view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S24").ravel()


def _as_bytes(keys: list[int]) -> np.ndarray:
    """Keys as integers to fixed-width bytes; NumPy pads a comparison with zeros, as the width demands."""
    return np.frombuffer(b"".join(k.to_bytes(24, "big") for k in keys), "S24")


def _longs(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _count(probes: list[int]):
    """Bytes and rows of this task between neighbouring probes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _as_bytes(probes)
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            k0, k1, k2, n = _longs(batch, ["k0", "k1", "k2", "size"])
            at = np.searchsorted(edges, _key_bytes([k0, k1, k2]), side="right")
            rows += np.bincount(at, minlength=len(rows))
            np.add.at(size, at, n)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), pa.array(rows[full])], ["bin", "size", "rows"])

    return run


def find_splitters(keys: DataFrame, parts: int, shards: int, tolerance: float = TOLERANCE) -> tuple[list[int], list[int], list[int]]:
    """Boundaries of ``parts`` ranges of near-equal bytes, with the exact bytes and rows below each.

    Every (parts / shards)-th boundary is one between shards and is held to the tolerance; the others
    only shape the work and may be off by a tenth of a range. What the driver holds is a few numbers per boundary.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    targets = [total[0] * i // parts for i in range(1, parts)]
    slack = [max(1, int(tolerance * total[0] / shards)) if (i + 1) % (parts // shards) == 0 else max(1, total[0] // parts // 10) for i in range(parts - 1)]
    low, high = [(0, 0, 0)] * (parts - 1), [(1 << KEY_BITS, total[0], total[1])] * (parts - 1)
    best = [min(a, b, key=lambda x: abs(x[1] - t)) for a, b, t in zip(low, high, targets)]
    while True:
        # A gap without rows inside cannot be refined further.
        todo = [i for i in range(parts - 1) if abs(best[i][1] - targets[i]) > slack[i] and high[i][0] - low[i][0] > 1 and high[i][2] - low[i][2] > 1]
        if not todo:
            break
        each = max(2, PROBES * 16 // len(todo)) if len(todo) < 512 else 2
        probes = sorted({low[i][0] + (high[i][0] - low[i][0]) * j // (each + 1) for i in todo for j in range(1, each + 1)} - {0})
        counts = keys.mapInArrow(_count(probes), "bin bigint, size bigint, rows bigint").groupBy("bin").agg(F.sum("size"), F.sum("rows")).collect()
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b, s, r in counts:
            size[b], rows[b] = s, r
        below = list(zip(probes, np.cumsum(size).tolist(), np.cumsum(rows).tolist()))
        sizes = [x[1] for x in below]
        for i in todo:
            at = int(np.searchsorted(sizes, targets[i], side="right"))
            if at > 0 and below[at - 1][0] > low[i][0]:
                low[i] = below[at - 1]
            if at < len(below) and below[at][0] < high[i][0]:
                high[i] = below[at]
            best[i] = min(best[i], low[i], high[i], key=lambda x: abs(x[1] - targets[i]))
    return tuple(list(x) for x in zip(*best)) if best else ([], [], [])


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with size, shard and slot; rows of a shard carry the slots 0, 1, 2 and so on in the order of the key."""
    spark = docs.sparkSession
    ship(spark)
    keys = materialize(docs.select(*_key_columns(), size_of().alias("size")), "shard-keys")
    parts = shards * min(MAX_RANGES // shards, max(-(-shuffle_partitions(spark) // shards), -(-keys.count() // (RANGE_ROWS * shards)), 1))
    splitters, _, below = find_splitters(keys, parts, shards, tolerance)
    per_shard = parts // shards

    @F.pandas_udf("int")
    def range_of(k0, k1, k2):
        import pandas as pd

        at = np.searchsorted(_as_bytes(splitters), _key_bytes([x.to_numpy(np.int64) for x in (k0, k1, k2)]), side="right")
        return pd.Series(at.astype(np.int32))

    own = ["__k0", "__k1", "__k2", "__range", "__first"]
    keyed = docs.withColumns(dict(zip(own, _key_columns())) | {"size": size_of()})
    ranged = keyed.withColumn("__range", range_of("__k0", "__k1", "__k2"))
    starts = [0, *below]
    first = [starts[r] - starts[r - r % per_shard] for r in range(parts)]
    table = spark.createDataFrame([(r, r // per_shard, f) for r, f in enumerate(first)], "__range int, shard int, __first bigint")
    # The one exchange: rows go to their range and are ranked there.
    rank = F.row_number().over(Window.partitionBy("__range").orderBy("__k0", "__k1", "__k2"))
    ranked = ranged.withColumn("__rank", rank).join(F.broadcast(table), "__range")
    return ranked.withColumn("slot", F.col("__first") + F.col("__rank") - 1).drop(*own, "__rank")
