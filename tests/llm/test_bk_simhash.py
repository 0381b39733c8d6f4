import random
from collections import defaultdict

import pytest
import xxhash

from mailtriage.llm import bk_simhash as B
from tests.llm.conftest import ODD, texts

MASK = (1 << 64) - 1
signed = lambda v: v - (1 << 64) if v >> 63 else v


def brute_fp(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=2):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(root)
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in order}


def clouds(n, seed):
    rng = random.Random(seed)
    out = {0, MASK, 1 << 63}
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            out.add(base)
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
    return out


def test_fingerprints_of_odd_texts():
    for _, text in texts():
        if len(text) < 1000:
            assert B.fingerprint(text.encode()) == brute_fp(text)
    assert B.fingerprint(b"a b c d", 3) == brute_fp("A  b\tC\nd")


def test_chunks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{i * i % 91}" for i in range(300))
    monkeypatch.setattr(B, "CHUNK_SHINGLES", 7)
    assert B.fingerprint(text.encode()) == brute_fp(text)


def test_tree_finds_all_within_the_radius():
    values, tree = sorted(clouds(600, 1)), B.BKTree()
    for v in values:
        tree.add(v)
    for v in values[::7]:
        assert sorted(tree.near(v, 2)) == [w for w in values if (v ^ w).bit_count() <= 2]


@pytest.mark.parametrize("shard_nodes", [4096, 8])
def test_links_and_components(spark, shard_nodes):
    values = clouds(700, 2)
    rng = random.Random(3)
    center = rng.getrandbits(64)
    # A dense cloud, so that shards outgrow their bound and are split.
    values |= {center ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 5))) for _ in range(300)}
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    roots = {r.node & MASK: r.root for r in B.components(B.links_of(nodes, 2, shard_nodes)).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for v, r in brute_components(values).items():
        want[r].add(v)
        groups[roots.get(v, signed(v))].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_odd_rows(odd, none):
    got = B.near_groups(odd).collect()
    fps = {t: brute_fp(t) for _, t in texts() if len(t) < 1000}
    fps |= {t: B.fingerprint(t.encode()) for _, t in texts() if len(t) >= 1000}
    root = brute_components(set(fps.values()))
    least = defaultdict(list)
    for i, t in texts():
        if i is not None:
            least[root[fps[t]]].append(i)
    want = sorted((str(i), f"{fps[t]:016x}", str(min(least[root[fps[t]]], default=None))) for i, t in texts())
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = B.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t) for i, t in texts() if i is not None and i == min(least[root[fps[t]]]))
    assert B.near_groups(none).count() == B.drop_near_duplicates(none).count() == 0
    assert len(got) == len(ODD)
