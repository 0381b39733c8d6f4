"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every task cuts its rows into blocks and sorts the fingerprints of a block.
2. A block sends each owner (a residue of the fingerprint space) its distinct fingerprints as one
   message of sorted gaps in Golomb code: a few bits per row instead of 64. Fingerprints are cut to
   log2(rows) + 8 bits first, so about one row in 256 becomes a suspect for nothing.
3. An owner returns a bitmap per message: bit i is set where fingerprint i occurs in another block
   too. What occurs twice inside a block the block knows by itself.
4. Only rows whose bit is set are suspects. Their texts alone are shuffled and compared byte by byte
   (a grouping on the text itself), so colliding fingerprints never merge two texts.

A group of copies of any size costs one fingerprint per block, one partial aggregate per task when
bytes are compared, and narrow rows in a join that Spark splits where it is skewed.

Defined cases: null text is empty, and all empty texts are one group. Of equal texts the smallest
doc_id stays; null ids come last, and if all are null one row stays with a null keep_id. Of rows equal in
text and id exactly one stays. Empty input gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mailtriage.llm.common import SPACES, shuffle_partitions, slot_of, split_by_slot, text_of
from mailtriage.session import materialize, ship

BLOCK_ROWS = 131_072
OWNER_ROWS = 4_000_000
SPARE_BITS = 8
FILTER_SLOTS = 1 << 20

_BLOCK = "block bigint, n int, fps binary, ids binary, nulls binary, shas binary"
_MESSAGE = "owner int, block bigint, n int, rice int, payload binary"
_REPLY = "block bigint, owner int, bits binary"
_ROW = "block bigint, pos int, doc_id bigint, fp bigint, sha binary, suspect boolean"


def normalised(column: str = "text") -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(text_of(column), SPACES, " ")


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct 64-bit unsigned values as gaps: all quotients in unary, then all remainders."""
    gaps = np.diff(values, prepend=np.uint64(0))
    rice = max(0, (int(values[-1]) // len(values)).bit_length() - 1)
    quotients = (gaps >> np.uint64(rice)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    places = np.arange(rice - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    return rice, len(unary).to_bytes(4, "little") + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(n: int, rice: int, payload: bytes) -> np.ndarray:
    length = int.from_bytes(payload[:4], "little")
    raw = np.frombuffer(payload, np.uint8, offset=4)
    cut = (length + 7) // 8
    ends = np.flatnonzero(np.unpackbits(raw[:cut], count=length) == 0)
    quotients = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(raw[cut:], count=n * rice).reshape(n, rice).astype(np.uint64)
    weights = np.uint64(1) << np.arange(rice - 1, -1, -1, dtype=np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(rice)) + (rest * weights).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``rows`` rows, each sorted by fingerprint and packed into binary columns."""
    from pyspark import TaskContext

    base, count, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

    def block():
        fps, ids, nulls, shas = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(fps, kind="stable")
        packed = [[base + count], [len(fps)], *([x[order].tobytes()] for x in (fps, ids, nulls, shas))]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(packed, types)], names)

    names = ["block", "n", "fps", "ids", "nulls", "shas"]
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    for batch in batches:
        doc_id, fp, sha = (batch.column(i) for i in range(3))
        part = (
            fp.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
            doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), np.frombuffer(b"".join(sha.to_pylist()), np.dtype("V32")),
        )
        for start in range(0, batch.num_rows, rows):
            held.append(tuple(x[start:start + rows] for x in part))
            size += len(held[-1][0])
            if size >= rows:
                yield block()
                held, size, count = [], 0, count + 1
    if size:
        yield block()


def _distinct(fps: bytes, bits: int, owners: int):
    """Of one block: where each row's cut fingerprint is among the distinct ones, their counts, owners and values."""
    cut = np.frombuffer(fps, np.uint64) >> np.uint64(64 - bits)
    values, inverse, counts = np.unique(cut, return_inverse=True, return_counts=True)
    owner = (values % np.uint64(owners)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(owners + 1))
    return inverse, counts, values // np.uint64(owners), order, bounds


def _send(bits: int, owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, values, order, bounds = _distinct(row["fps"], bits, owners)
                out = []
                for owner in np.flatnonzero(np.diff(bounds)).tolist():
                    mine = values[order[bounds[owner]:bounds[owner + 1]]]
                    out.append((owner, row["block"], len(mine), *golomb_encode(mine)))
                types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], ["owner", "block", "n", "rice", "payload"])

    return run


def _reply(messages: pd.DataFrame) -> pd.DataFrame:
    """The owner's side: which fingerprints of each message came from another block as well."""
    lists = [golomb_decode(n, r, p) for n, r, p in zip(messages["n"], messages["rice"], messages["payload"])]
    _, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    repeated = np.split(counts[inverse] > 1, np.cumsum([len(x) for x in lists])[:-1])
    hit = [x.any() for x in repeated]
    out = messages.loc[hit, ["block", "owner"]].copy()
    out["bits"] = [np.packbits(x).tobytes() for x, h in zip(repeated, hit) if h]
    return out


def _mark(bits: int, owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                inverse, counts, values, order, bounds = _distinct(row["fps"], bits, owners)
                hit = counts > 1
                for reply in row["replies"] or ():
                    mine = order[bounds[reply["owner"]]:bounds[reply["owner"] + 1]]
                    hit[mine] |= np.unpackbits(np.frombuffer(reply["bits"], np.uint8), count=len(mine)).astype(bool)
                n = row["n"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, row["block"])), pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool)),
                    pa.array(np.frombuffer(row["fps"], np.int64)),
                    pa.array([row["shas"][i:i + 32] for i in range(0, 32 * n, 32)], pa.binary()), pa.array(hit[inverse]),
                ], ["block", "pos", "doc_id", "fp", "sha", "suspect"])

    return run


def mark_suspects(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One narrow row per document: block, pos, doc_id, fp, sha, suspect."""
    ship(docs.sparkSession)
    text = normalised()
    keys = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("fp"), F.unhex(F.sha2(text, 256)).alias("sha"))
    blocks = materialize(keys.mapInArrow(lambda it: _pack(it, block_rows), _BLOCK), "dedup-blocks")
    rows = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(64, int(rows).bit_length() + SPARE_BITS)
    owners = max(shuffle_partitions(docs.sparkSession), -(-rows // OWNER_ROWS))
    messages = blocks.select("block", "fps").mapInArrow(_send(bits, owners), _MESSAGE)
    replies = messages.groupBy("owner").applyInPandas(_reply, _REPLY)
    # At most one bit per row of the block comes back.
    per_block = replies.groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("replies"))
    marked = blocks.join(per_block, "block", "left").mapInArrow(_mark(bits, owners), _ROW)
    return materialize(marked, "dedup-rows")


def exact_groups(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    rows = mark_suspects(docs, block_rows)
    suspects = rows.filter("suspect").drop("suspect")
    text = normalised()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("norm"))
    # At most FILTER_SLOTS keys: a bounded broadcast that keeps most clean texts out of the shuffle.
    slot = F.pmod(F.col("fp"), F.lit(FILTER_SLOTS)).alias("slot")
    slots = suspects.select(slot).distinct()
    texts = texts.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    wanted = suspects.select(F.col("doc_id").alias("s_id"), F.col("fp").alias("s_fp")).distinct()
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("fp") == F.col("s_fp")), "left_semi")
    verified = texts.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    verified = verified.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "block", "pos")
    stays = suspects.groupBy("sha").agg(F.min(place).alias("stays"))
    classes = materialize(verified.join(stays, "sha"), "dedup-classes")
    grouped = suspects.join(classes, "sha").select(
        "doc_id", "keep_id", "group_size", ((F.col("block") == F.col("stays.block")) & (F.col("pos") == F.col("stays.pos"))).alias("kept"), "sha")
    alone = rows.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.unionByName(grouped).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were.

    Documents move only where their id shares a slot with one that has a copy.
    """
    copies = exact_groups(docs).filter("group_size > 1").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept")
    copies = materialize(copies, "dedup-copies")
    alone, maybe = split_by_slot(docs, slot_of(F.col("doc_id").cast("bigint")), copies, slot_of("__id"))
    # Ids may repeat: what counts is the pair of id and text. Of rows equal in both one stays.
    pairs = copies.groupBy("__id", "__sha").agg(F.max("kept").alias("__kept"))
    marked = maybe.withColumn("__own", F.sha2(normalised(), 256))
    judged = marked.join(pairs, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left")
    single = judged.filter("__kept is null").select(*docs.columns)
    kept = judged.filter("__kept").dropDuplicates(["doc_id", "__own"]).select(*docs.columns)
    return alone.select(*docs.columns).unionByName(single).unionByName(kept)
