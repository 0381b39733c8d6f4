"""Near-duplicates by exact Jaccard similarity of five-word shingles: every pair at 0.8 or more is linked.

1. A text is the set of the hashes of its five-word shingles; rows with one set are one node, which one row stands for.
2. Blocks of rows send the owners of hash ranges their shingles, cut to few bits, as sorted gaps in Golomb code and get back
   a bit for each that another row has too (the exchange of ``exact_dedup``). A text with a partner at 0.8 shares at least
   0.8 of its shingles with it, so texts that share fewer with all others together are done: nothing of them moves.
3. SimHash: of the others, the majority bits over a node's shingles are its fingerprint. BK-trees (``bk_simhash``) find the
   fingerprints at two or fewer differing bits; these pairs are compared set by set and join most near copies.
4. Pairs at 0.8 may differ in ten bits, which fingerprints do not find. For them the shingles have one order: unshared ones
   first, those frequent in a sample last, else by hash. Two sets of s and t at 0.8 share one of their first s - ceil(0.8 s) + 1
   and t - ceil(0.8 t) + 1 in any such order, so nodes that are not joined yet meet at the shared shingles of these prefixes.
   The sample decides only how many meet needlessly, never what is found.
5. At a shingle of few nodes all pairs that can still reach 0.8 by size and position are compared set by set. Where many
   nodes meet, each is compared to the smallest first. Nodes that still are apart are compared inside tasks, in blocks of
   bounded size, by sketches: bit b is the parity of the shingles that hash to b, and two sets differ in at least as many
   shingles as their sketches in bits. Pairs that sketches allow are compared set by set; first enough of them to join all
   that they can join, then those that are still apart. Texts move only where a pair needs them.
6. Links become components; the smallest doc_id of a component names it.

Defined cases: null and empty texts are one shingle, linked like any other, and so are texts under five words. Null
ids get the smallest id of their component. Empty input gives no rows. Repeated rows share their node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mailtriage.llm import bk_simhash, exact_dedup
from mailtriage.llm.bk_simhash import components
from mailtriage.llm.common import discard, materialize_texts, pieces, released, shuffle_partitions, slot_of, split_by_slot, text_of
from mailtriage.session import materialize, ship, spread_groups

WORDS = 5
# Texts that the order of shingles is taken from, and the most frequent shingles that go last.
ORDER_TEXTS, ORDER_SHINGLES = 8_192, 200_000
# Nodes at one shingle above which they are compared to one of them first.
FEW_NODES = 4
# Nodes of a block that are compared inside a task, and bits of their sketches.
BLOCK_NODES, SKETCH_BITS = 256, 1024
# Prefix shingles and rows of one block of the exchange; a larger text is a block of its own.
BLOCK_SHINGLES, BLOCK_ROWS = 1 << 18, 1 << 14
BATCH_BYTES = 4 << 20


def shingles_of(data: bytes) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the shingles; ASCII letters in lower case, ASCII white space between words."""
    import xxhash

    joined = b" ".join(data.lower().split())
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(joined)]
    ends, hash_of = ends[WORDS - 1:] or ends[-1:], xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hash_of(joined[s:e], 42) for s, e in zip(starts, ends)), np.uint64, len(ends))).view(np.int64)


def mixed(cut: np.ndarray) -> np.ndarray:
    """Cut shingles spread over 64 bits again; equal ones stay equal."""
    x = cut ^ cut >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)).view(np.int64)


def simhash_of(shingles: np.ndarray) -> int:
    """Majority bits over the shingles, as a signed number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), bk_simhash.CHUNK_SHINGLES):
        part = shingles[at:at + bk_simhash.CHUNK_SHINGLES].astype(">i8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big", signed=True)


def sketch_of(shingles: np.ndarray) -> bytes:
    """Per bit whether an odd number of shingles hash to it."""
    return np.packbits(np.bincount(shingles.view(np.uint64) % np.uint64(SKETCH_BITS), minlength=SKETCH_BITS) & 1 == 1).tobytes()


def least_shared(size: int) -> int:
    """How many shingles a set of this size has in common with any set at 0.8: ceil(0.8 size)."""
    return -(-4 * size // 5)


def prefix_of(shingles: np.ndarray, shared: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Of the first shingles in the common order, as many as a pair at 0.8 must share one of, the shared ones, and how many stand before them."""
    alone = len(shingles) - int(shared.sum())
    shingles = shingles[shared]
    rank = np.zeros(len(shingles), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rank = np.where(frequent[at] == shingles, counts[at], 0)
    return alone, shingles[np.lexsort((shingles, rank))[:len(shingles) + alone - least_shared(len(shingles) + alone) + 1 - alone]]


def _sets(keys: int):
    """The first ``keys`` columns and the shingles of the text after them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "data", BATCH_BYTES):
                sets = pa.array([shingles_of(x.as_buffer().to_pybytes()) for x in batch.column(keys)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:keys], sets], [*batch.schema.names[:keys], "shingles"])

    return run


_BLOCK = "block bigint, rows array<struct<doc_id:bigint,text_key:bigint,node:bigint,size:int>>, fps binary"
_ROW = pa.struct([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("size", pa.int32())])
_MARKED = "doc_id bigint, text_key bigint, node bigint, size int, simhash bigint, sketch binary, alone int, prefix array<bigint>"


def _packed(hashes: np.ndarray, bits: int) -> bytes:
    """The upper ``bits`` of each hash in as few bytes as hold them."""
    cut = (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype("<u8")
    return np.ascontiguousarray(cut.view(np.uint8).reshape(-1, 8)[:, :-(-bits // 8)]).tobytes()


def _unpacked(data: bytes, bits: int) -> np.ndarray:
    """The hashes with all but the upper ``bits`` zero."""
    width = -(-bits // 8)
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel() << np.uint64(64 - bits)


def _blocks(bits: int):
    """Rows with the cut shingles of their texts end to end, in blocks of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        base, count, rows, held, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([base + count]), pa.array([rows], pa.list_(_ROW)), pa.array([b"".join(held)], pa.binary())], ["block", "rows", "fps"])

        for whole in batches:
            for batch in pieces(whole, "data", BATCH_BYTES):
                for doc_id, text_key, data in zip(*(batch.column(i) for i in range(3))):
                    shingles = shingles_of(data.as_buffer().to_pybytes())
                    if rows and (size + len(shingles) > BLOCK_SHINGLES or len(rows) >= BLOCK_ROWS):
                        yield block()
                        count, rows, held, size = count + 1, [], [], 0
                    node = int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 42)).astype(np.int64))
                    rows.append({"doc_id": doc_id.as_py(), "text_key": text_key.as_py(), "node": node, "size": len(shingles)})
                    held.append(_packed(shingles, bits))
                    size += len(shingles)
        if rows:
            yield block()

    return run


def _messages(bits: int, owners: int):
    send = exact_dedup._send(bits, owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One block at a time: all that is held is of its size.
        for batch in batches:
            for i in range(batch.num_rows):
                whole = pa.array([_unpacked(batch.column(1)[i].as_py(), bits).tobytes()], pa.binary())
                yield from send(iter([pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), whole], ["block", "fps"])]))

    return run


def _shared(bits: int, owners: int, frequent: np.ndarray, counts: np.ndarray):
    """Rows that share enough of their shingles with others, and the shared ones of their prefixes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                fps = _unpacked(row["fps"], bits)
                inverse, times, _, order, bounds = exact_dedup._distinct(fps, bits, owners)
                hit = times > 1
                for reply in row["replies"] or ():
                    mine = order[bounds[reply["owner"]]:bounds[reply["owner"] + 1]]
                    hit[mine] |= np.unpackbits(np.frombuffer(reply["bits"], np.uint8), count=len(mine)).astype(bool)
                hit, tokens, at, out = hit[inverse], fps.view(np.int64), 0, []
                for r in row["rows"]:
                    mine = slice(at, at + r["size"])
                    at += r["size"]
                    if int(hit[mine].sum()) >= least_shared(r["size"]):
                        alone, prefix = prefix_of(tokens[mine], hit[mine], frequent, counts)
                        out.append((r["doc_id"], r["text_key"], r["node"], r["size"], simhash_of(mixed(fps[mine])), sketch_of(mixed(fps[mine])), alone, prefix))
                if out:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [f.split()[0] for f in _MARKED.split(", ")])

    return run


def _order(texts: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut shingles of at least three texts of a sample, and in how many they are."""
    every = max(1, texts.count() // ORDER_TEXTS)
    sample = texts.filter(F.pmod(F.xxhash64("text_key"), F.lit(every)) == 0).select("text_key", "data")
    counts = sample.mapInArrow(released(_sets(1)), "text_key bigint, shingles array<bigint>").select(F.explode("shingles").alias("s")).select(F.col("s").bitwiseAND(F.lit(-1 << (64 - bits))).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    top = counts.filter("n >= 3").orderBy(F.desc("n"), "s").limit(ORDER_SHINGLES).toPandas().sort_values("s")
    return top["s"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def _met(left: DataFrame, right: DataFrame, where) -> DataFrame:
    """a, b: nodes that meet at a token, may reach 0.8 if it is the first they share, and fulfil ``where``."""
    a, b = left.alias("x"), right.alias("y")
    rest = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))
    both = a.join(b, (F.col("x.token") == F.col("y.token")) & (9 * rest >= 4 * (F.col("x.size") + F.col("y.size"))) & where)
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _linked(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The pairs at 0.8 or more: shared shingles against both sizes."""
    pairs = materialize(pairs, f"jaccard-pairs-{name}")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    keys = materialize(nodes.select("node", "text_key").join(wanted, "node"), f"jaccard-keys-{name}")
    _, near = split_by_slot(texts.select("text_key", "data"), slot_of("text_key"), keys, slot_of("text_key"))
    # Copies of a text are one row before the join, which then needs no exchange of texts of its own.
    data = near.groupBy("text_key").agg(F.first("data").alias("data")).join(keys, "text_key").select("node", "data")
    sets = materialize_texts(data.mapInArrow(released(_sets(1)), "node bigint, shingles array<bigint>"), f"jaccard-sets-{name}")
    # The smaller node of a pair is the one that many meet: its set joins last and is copied only inside the task.
    other = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    both = other.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
    return materialize(both.filter(9 * F.size(F.array_intersect("s", "t")) >= 4 * (F.size("s") + F.size("t"))).select("a", "b"), f"jaccard-links-{name}")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: nodes of one fingerprint with the smallest of them, and the smallest ones of fingerprints that BK-trees link."""
    least = materialize(nodes.groupBy("simhash").agg(F.min("node").alias("least")), "jaccard-simhash")
    same = nodes.select("node", "simhash").join(least, "simhash").filter("node <> least").select("node", "least")
    links = bk_simhash.links_of(least.select(F.col("simhash").alias("fp")))
    ends = links.join(least.select(F.col("simhash").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("simhash").alias("b"), F.col("least").alias("y")), "b")
    pairs = same.union(ends.select("x", "y")).toDF("x", "y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _rooted(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``rows`` with the root of their nodes, at tokens where nodes of more than one root meet; n and least node of the token."""
    roots = materialize(components(links), f"jaccard-roots-{name}")
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted.select(*rows.columns, "root"), f"jaccard-rooted-{name}")
    tokens = rooted.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.min("root").alias("low"), F.max("root").alias("high"))
    tokens = materialize(tokens.filter("low < high").drop("low", "high"), f"jaccard-tokens-{name}")
    return materialize(rooted.join(tokens, "token"), f"jaccard-open-{name}")


def allowed_pairs(rows: pd.DataFrame, joining: bool) -> Iterator[tuple[int, int]]:
    """Nodes of different roots that may reach 0.8, by size, position and sketch; ``joining``: only as many as join their roots.

    Rows of one block are paired with each other, those of two blocks across.
    """
    node, root, size, pos, side = (rows[c].to_numpy() for c in ("node", "root", "size", "pos", "side"))
    size, rest = size.astype(np.int64), size.astype(np.int64) - pos
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
    two, up = side.any(), {}

    def find(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for i in range(len(rows) - 1):
        both = size[i] + size[i + 1:]
        maybe = (root[i + 1:] != root[i]) & (9 * np.minimum(rest[i], rest[i + 1:]) >= 4 * both)
        if two:
            maybe &= side[i + 1:] != side[i]
        at = np.flatnonzero(maybe)
        if len(at):
            apart = np.bitwise_count(sketch[i] ^ sketch[i + 1 + at]).sum(axis=1, dtype=np.int64)
            for j in (i + 1 + at[9 * apart <= both[at]]).tolist():
                x, y = find(int(root[i])), find(int(root[j]))
                if x != y or not joining:
                    up[max(x, y)] = min(x, y)
                    yield int(min(node[i], node[j])), int(max(node[i], node[j]))


def _apart(rows: DataFrame, nodes: DataFrame, joining: bool, name: str) -> DataFrame:
    """a, b: ``allowed_pairs`` of every token of ``rows``. A token of many nodes is dealt out as pairs of blocks of them."""
    blocks = F.ceil(F.col("n") / BLOCK_NODES).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", own).join(nodes.select("node", "sketch"), "node")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "token", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("high"), (F.col("own") != F.col("other")).alias("two"),
        "node", "root", "size", "pos", "sketch")
    # Of two blocks the one with the larger number is the other side.
    dealt = dealt.select("token", "p", "q", "node", "root", "size", "pos", "sketch", (F.col("two") & F.col("high")).cast("int").alias("side"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # Two blocks of which one is empty here have no pairs.
        crossing = group["p"].iat[0] != group["q"].iat[0]
        pairs = [] if crossing and group["side"].nunique() < 2 else list(allowed_pairs(group.sort_values("node"), joining))
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return materialize(spread_groups(dealt, "token", "p", "q").groupBy("token", "p", "q").applyInPandas(run, "a bigint, b bigint").distinct(), f"jaccard-apart-{name}")


def links_of(rows: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: pairs of nodes at 0.8 or more, enough to connect all that such pairs connect. ``rows``: token, node, size, pos."""
    links = _linked(simhash_pairs(nodes), texts, nodes, "simhash")
    shared = _rooted(rows, links, "first")
    few, many = shared.filter(F.col("n") <= FEW_NODES), shared.filter(F.col("n") > FEW_NODES)
    first, split = many.filter("node = least"), F.col("x.root") != F.col("y.root")
    pairs = materialize(_met(few, few, (F.col("x.node") < F.col("y.node")) & split).union(_met(first, many, split)).distinct(), "jaccard-met")
    links = links.union(_linked(pairs, texts, nodes, "first"))
    if many.isEmpty():
        return links
    rows = many.select(*rows.columns)
    joining = _apart(_rooted(rows, links, "joining"), nodes, True, "joining").join(pairs, ["a", "b"], "left_anti")
    links = links.union(_linked(joining, texts, nodes, "joining"))
    # Pairs that have been compared are no links, or of one root by now.
    rest = _apart(_rooted(rows, links, "rest"), nodes, False, "rest").join(pairs, ["a", "b"], "left_anti")
    return links.union(_linked(rest, texts, nodes, "rest"))


def _candidates(texts: DataFrame) -> DataFrame:
    """The rows that may have a partner, with the shared shingles of their prefixes."""
    spark = texts.sparkSession
    # A shingle takes two bytes of text at least, save the only one of a short text.
    most = texts.agg(F.coalesce(F.sum(F.octet_length("data") / 2 + 1), F.lit(0)).cast("bigint")).first()[0]
    bits = min(63, int(most).bit_length() + exact_dedup.SPARE_BITS)
    owners = max(shuffle_partitions(spark), -(-most // exact_dedup.OWNER_ROWS))
    blocks = materialize_texts(texts.mapInArrow(released(_blocks(bits)), _BLOCK), "jaccard-blocks")
    messages = blocks.select("block", "fps").mapInArrow(released(_messages(bits, owners)), exact_dedup._MESSAGE)
    replies = messages.groupBy("owner").applyInPandas(exact_dedup._reply, exact_dedup._REPLY)
    # At most one bit per shingle of the block comes back.
    bitmaps = materialize_texts(replies.groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("replies")), "jaccard-bitmaps")
    marked = blocks.join(bitmaps, "block", "left").select("block", "rows", "fps", "replies")
    marked = materialize_texts(marked.mapInArrow(released(_shared(bits, owners, *_order(texts, bits))), _MARKED), "jaccard-marked")
    discard(blocks)
    return marked


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, component_id of every row that may have a partner; the others are components of their own."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("text_key"), text_of().cast("binary").alias("data"))
    marked = _candidates(texts)
    rows = marked.select("doc_id", "text_key", "node")
    one = F.min_by(F.struct("text_key", "size", "simhash", "sketch"), "text_key").alias("one")
    nodes = materialize(marked.select("doc_id", "text_key", "node", "size", "simhash", "sketch").groupBy("node").agg(F.min("doc_id").alias("least_id"), one).select("node", "least_id", "one.*"), "jaccard-nodes")
    # Rows of one node have one prefix.
    prefixes = marked.select("node", "size", F.posexplode("prefix").alias("pos", "token"), "alone").select("token", "node", "size", (F.col("pos") + F.col("alone")).alias("pos")).distinct()
    roots = components(links_of(materialize(prefixes, "jaccard-prefixes"), nodes, texts))
    members = materialize(roots.union(roots.select("root", "root").distinct()), "jaccard-members")
    linked = materialize(nodes.select("node", "least_id").join(members, "node"), "jaccard-linked")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.join(materialize(least, "jaccard-least"), "root").select("node", "component_id")
    named = nodes.select("node", "least_id").join(named, "node", "left").select("node", F.coalesce("component_id", "least_id").alias("component_id"))
    return rows.join(materialize(named, "jaccard-components"), "node")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component, with their columns.

    A component without ids stays whole, and rows equal in id and text stay together: exact copies are another operator's.
    """
    gone = _grouped(docs).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = materialize(gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text_key")).distinct(), "jaccard-gone")
    stay, maybe = split_by_slot(docs, slot_of(F.col("doc_id").cast("bigint")), gone, slot_of("__id"))
    own = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(text_of()) == F.col("__text_key"))
    return stay.unionByName(maybe.join(gone, own, "left_anti")).select(*docs.columns)
