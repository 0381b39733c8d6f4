"""Near-duplicates by SimHash fingerprints and BK-trees.

1. Fingerprints: 64 bits by majority over the hashes of all 3-word shingles of a text. Rows with one
   fingerprint are one node from here on, so copies cost nothing further.
2. Shards: the fingerprint is cut into four bands. At most two differing bits leave at least two bands
   equal, so any linked pair shares one of the six band pairs: nodes are dealt to a shard per band pair and value.
3. In a shard a BK-tree holds the nodes, children keyed by their Hamming distance to the parent. A search
   follows only the edges whose distance is within the radius of the distance to the node. A shard that
   outgrows one task is first split by the distance to its smallest fingerprint (the top edges of its tree):
   a node goes to its own edge and looks into the edges within the radius, until shards are small.
4. Links join shards by alternating large-star and small-star steps, each an aggregation and a join on
   nodes; the smallest doc_id of a component names it.

Trees go to the tasks that search them by shuffle: together they are as large as the set of fingerprints,
for which there is no proven bound, so they are not broadcast.

Defined cases: null and empty texts have fingerprint zero, linked like any other. Texts under three words
are one shingle. Repeated rows share their node. Null ids get the smallest id of their component, null if
it has none. Empty input gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mailtriage.llm.common import pieces, shuffle_partitions, text_of
from mailtriage.session import materialize, ship

RADIUS = 2
BANDS = 4
SHARD_NODES = 4096
MAX_SPLITS = 12
CHUNK_SHINGLES = 1 << 16
BATCH_BYTES = 16 << 20


def fingerprint(data: bytes, words: int = 3) -> int:
    """Majority bits over XXH64 (seed 42) of the shingles; ASCII letters in lower case, ASCII white space between words."""
    import xxhash

    joined = b" ".join(data.lower().split())
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(joined)]
    ends = ends[words - 1:] or ends[-1:]
    counts, total, hash_of = np.zeros(64, np.int64), len(ends), xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK_SHINGLES):
        hashes = np.array([hash_of(joined[s:e], 42) for s, e in zip(starts[at:at + CHUNK_SHINGLES], ends[at:at + CHUNK_SHINGLES])], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "data", BATCH_BYTES):
            fps = np.array([fingerprint(x.as_buffer().to_pybytes()) for x in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "text_key", "fp"])


class BKTree:
    """Nodes in arrays; the children of a node are a dictionary from distance to node."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        node = 0 if self.values else None
        while node is not None:
            edges = self.children[node]
            distance = (self.values[node] ^ value).bit_count()
            node, parent = edges.get(distance), node
            if node is None:
                edges[distance] = len(self.values)
        self.values.append(value)
        self.children.append({})

    def near(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(self.values[node])
            edges = self.children[node]
            todo += [edges[d] for d in range(max(0, distance - radius), distance + radius + 1) if d in edges]
        return found


def _shard_links(members: list[int], guests: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within a shard: members among themselves, and guests to members; enough of them to connect what is linked."""
    tree, root, links = BKTree(), {}, []

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for values, inside in ((members, True), (guests, False)):
        for value in values:
            for other in tree.near(value, radius):
                a, b = find(value), find(other)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((value, other))
            if inside:
                tree.add(value)
    return links


def _links(radius: int):
    """Rows come sorted by shard; one shard at a time is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            got = _shard_links([v for v, guest in rows if not guest], [v for v, guest in rows if guest], radius)
            out.extend(got)

        shard, rows, out = None, [], []
        for batch in batches:
            for key, fp, guest in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != shard:
                    if len(rows) > 1:
                        flush(rows)
                    shard, rows = key, []
                rows.append((fp & 0xFFFFFFFFFFFFFFFF, guest))
            if out:
                yield _pairs(out)
                out = []
        if len(rows) > 1:
            flush(rows)
        if out:
            yield _pairs(out)

    def _pairs(links):
        a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*links))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def shards_of(nodes: DataFrame, radius: int = RADIUS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """shard, fp, guest: every pair within the radius meets in a shard, as two members or as a guest and a member."""
    width = 64 // BANDS
    pairs = list(combinations(range(BANDS), BANDS - radius))
    keys = []
    for i, bands in enumerate(pairs):
        mask = sum(((1 << width) - 1) << (width * b) for b in bands)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask).cast("bigint"))))
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("shard"), F.lit(False).alias("guest"))
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n"), F.min("fp").alias("top")).filter("n > 1")
    sized = materialize(rows.join(materialize(sizes, "simhash-sizes"), "shard"), "simhash-shards")
    done, large = sized.filter(F.col("n") <= shard_nodes), sized.filter(F.col("n") > shard_nodes)
    for level in range(1, MAX_SPLITS + 1):
        if large.isEmpty():
            break
        edge = F.bit_count(F.col("fp").bitwiseXOR(F.col("top")))
        # A member is one at its own edge and a guest at those above; a guest looks both ways.
        steps = F.array(*[F.struct((edge + d).alias("edge"), F.lit(d).alias("step")) for d in range(-radius, radius + 1)])
        deeper = large.select("fp", "shard", "guest", F.explode(steps).alias("to")).filter("guest or to.step >= 0")
        deeper = deeper.select("fp", F.xxhash64(F.lit(level), "shard", "to.edge").alias("shard"), F.expr("guest or to.step > 0").alias("guest"))
        sizes = deeper.groupBy("shard").agg(F.count("*").alias("n"), F.min(F.when(~F.col("guest"), F.col("fp"))).alias("top"))
        # Shards with guests only have nothing to find.
        sizes = materialize(sizes.filter("n > 1 and top is not null"), f"simhash-sizes-{level}")
        sized = materialize(deeper.join(sizes, "shard"), f"simhash-shards-{level}")
        done, large = done.unionByName(sized.filter(F.col("n") <= shard_nodes)), sized.filter(F.col("n") > shard_nodes)
    # What still is large after that many splits is searched as it is.
    return done.unionByName(large).select("shard", "fp", "guest")


def links_of(nodes: DataFrame, radius: int = RADIUS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """a, b: fingerprints within the radius; per shard enough to connect its linked nodes."""
    dealt = shards_of(nodes, radius, shard_nodes).repartition(shuffle_partitions(nodes.sparkSession), "shard").sortWithinPartitions("shard", "fp")
    return dealt.select("shard", "fp", "guest").mapInArrow(_links(radius), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that links reach, for every node of a link. Large-star and small-star steps until nothing changes."""
    pair = lambda a, b: [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    edges = materialize(links.filter("a <> b").select(*pair("a", "b")).distinct(), "star-edges")
    before = None
    while True:
        # Large-star: every larger neighbour of a node goes to the smallest of its neighbourhood.
        both = edges.union(edges.select("v", "u"))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "star-low")
        large = materialize(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "star-large")
        # Small-star: a node and its smaller neighbours go to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "low"), F.struct(F.col("u").alias("v"), "low"))).alias("e"))
        edges = materialize(small.select(F.col("e.v").alias("u"), F.col("e.low").alias("v")).filter("u > v").distinct(), "star-small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _grouped(docs: DataFrame, radius: int) -> DataFrame:
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("text_key"), text_of().cast("binary").alias("data"))
    marked = materialize(texts.mapInArrow(_fingerprints, "doc_id bigint, text_key bigint, fp bigint"), "simhash-rows")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    roots = components(links_of(nodes.select("fp"), radius))
    members = roots.union(roots.select("root", "root").distinct())
    linked = materialize(nodes.join(members, F.col("fp") == F.col("node")).select("fp", "least_id", "root"), "simhash-linked")
    least = materialize(linked.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-least")
    named = linked.join(least, "root").select("fp", "component_id")
    named = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    named = materialize(named, "simhash-components")
    return marked.join(named, "fp")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``."""
    return _grouped(docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component, with their columns.

    A component without ids stays whole, and rows equal in id and text stay together: exact copies are another operator's.
    """
    gone = _grouped(docs, radius).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text_key")).distinct()
    own = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(text_of()) == F.col("__text_key"))
    return docs.join(gone, own, "left_anti")
