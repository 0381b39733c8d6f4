"""Exact top-k inner products by MaxScore, shard by shard.

A query term is a dimension in which the query is not zero; its postings in a shard are the rows whose
component has the query's sign there, so only postings can raise a score, and each term has a bound: the
largest gain it gives in the shard. With terms in the order of their bounds, the longest run of the smallest
whose bounds sum to less than the k-th best score so far is non-essential: a row found in no essential
posting cannot enter the result. Rows of essential postings get their exact partial score (gains and losses) over
the essential terms; non-essential terms are then probed, largest bound first, only for rows that can
still compete. Ties are kept as long as they can win by their smaller id.

Rows are cut into shards by their task. Queries come in blocks of bounded size, one broadcast and one job
each; results of shards, then of blocks, are merged by score and id. Each block is written before the next, so a
lost executor costs one block at most.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows or
queries without id; a shorter vector counts as zero beyond its end; an empty vector scores zero. Repeated
ids are rows of their own as candidates and never answer a query of their id; of queries with one id the smallest
vector asks, by its components in order. What 64 bits cannot hold, components and scores, is the nearest number that
they can, and ranks as such. Empty input gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailtriage.session import ship, work_path

SCALE = 256
TOP = 5
QUERY_BLOCK = 4096
SHARD_ROWS = 4096
PROBE_STEP = 8
_EXACT = 1 << 53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
# The largest double below 2^63.
_TOP_DOUBLE = float((1 << 63) - 1024)


def quantised(column: str = "embedding") -> Column:
    """floor(256 * x) per component; null for vectors that take no part."""
    doubles = F.transform(column, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(column).isNotNull() & ~bad, F.transform(doubles, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(_TOP_DOUBLE)), F.lit(-_TOP_DOUBLE))).cast("bigint")))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of whole numbers, zero beyond the end of a short one."""
    ends = column.offsets.to_numpy()
    lengths, values = np.diff(ends), column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    out = np.zeros((len(lengths), max([width or 0, *lengths])), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], lengths)] = values
    return out


class Shard:
    """Vectors of one shard by dimension, with what bounds need."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.high, self.low = vectors.max(axis=0, initial=0), vectors.min(axis=0, initial=0)
        top = int(max(self.high.max(initial=0), -int(self.low.min(initial=0))))
        self.top, self.columns = top, np.asfortranarray(vectors, np.float64)
        # Rows by dimension and sign, in order.
        self.postings = {sign: [np.flatnonzero(column) for column in (vectors * sign > 0).T] for sign in (1, -1)}

    def search(self, query_id: int, query: np.ndarray, k: int, best: list[tuple[int, int]]) -> None:
        """Take the rows of this shard into ``best``, a heap of the k best (score, -id)."""
        width = min(len(query), self.vectors.shape[1])
        query = query[:width]
        exact = self.top * int(np.abs(query).max(initial=0)) * max(1, width) < _EXACT
        data, weights = (self.columns, query.astype(np.float64)) if exact else (self.vectors.astype(object), query.astype(object))
        bounds = np.where(query > 0, weights * self.high[:width], weights * self.low[:width])
        order = np.argsort(bounds, kind="stable")
        reach = np.cumsum(bounds[order])
        floor = best[0][0] if len(best) == k else None
        # Terms up to ``cut`` are non-essential: together they cannot lift a row to the k-th score.
        cut = 0 if floor is None else int(np.searchsorted(reach, floor, side="left"))
        essential = order[cut:]
        if cut and not len(essential):
            return
        # Rows that an essential posting names; without a floor every row may enter, by losses alone as well.
        named = np.full(len(self.ids), not cut)
        if not named.all():
            for term in essential.tolist():
                named[self.postings[1 if query[term] > 0 else -1][term]] = True
        rows = np.flatnonzero(named & (self.ids != query_id))
        scores = (data[:, essential] if named.all() else data[np.ix_(rows, essential)]) @ weights[essential]
        scores = scores[rows] if named.all() else scores
        while cut:
            keep = scores + reach[cut - 1] >= floor
            rows, scores = rows[keep], scores[keep]
            if not len(rows):
                return
            probe = order[max(0, cut - PROBE_STEP):cut]
            scores = scores + data[np.ix_(rows, probe)] @ weights[probe]
            cut = max(0, cut - PROBE_STEP)
        if not exact:
            scores = np.clip(scores, _LEAST, _MOST)
        if floor is not None:
            rows, scores = rows[scores >= floor], scores[scores >= floor]
        if len(rows) > k:
            take = np.lexsort((self.ids[rows], -scores))[:k] if exact else sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
            rows, scores = rows[take], scores[take]
        for row, score in zip(rows.tolist(), scores.tolist()):
            item = (int(score), -int(self.ids[row]))
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)


def _search(queries, k: int, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = queries.value
        best = [[] for _ in query_ids]
        for batch in batches:
            for at in range(0, batch.num_rows, shard_rows):
                part = batch.slice(at, shard_rows)
                shard = Shard(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(part.column(1)))
                for query_id, vector, heap in zip(query_ids.tolist(), vectors, best):
                    shard.search(query_id, vector, k, heap)
        out = [(q, -i, s) for q, heap in zip(query_ids.tolist(), best) for s, i in heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs have vec_id and ints (see ``quantised``); a query skips rows of its own id."""
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "ints").filter("vec_id is not null and ints is not null")
    queries = queries.select(F.col("vec_id").cast("bigint").alias("vec_id"), "ints").filter("vec_id is not null and ints is not null")
    queries = queries.groupBy("vec_id").agg(F.min("ints").alias("ints"))
    path = work_path(spark, "maxscore")
    last, n = None, 0
    while True:
        # A block of the next queries by id: bounded, whatever the number of queries.
        ahead = queries if last is None else queries.filter(F.col("vec_id") > last)
        block = ahead.orderBy("vec_id").limit(query_block).toArrow()
        if not block.num_rows:
            break
        ids = block.column("vec_id").to_numpy()
        held = spark.sparkContext.broadcast((ids, _matrix(block.column("ints").combine_chunks())))
        found = vectors.mapInArrow(_search(held, k, shard_rows), "query_id bigint, vec_id bigint, score bigint")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.parquet(f"{path}/block={n}")
        last, n = int(ids[-1]), n + 1
        if block.num_rows < query_block:
            break
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    return spark.read.schema(schema).parquet(*[f"{path}/block={i}" for i in range(n)]) if n else spark.createDataFrame([], schema)
