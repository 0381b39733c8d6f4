import random

import pytest

import corpus_pipeline as C
from mailtriage.llm import near_jaccard as J
from tests.llm.conftest import ODD


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute_roots(sets):
    """Of each set the first one in its group linked by pairs at 0.8."""
    sets = list(sets)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in root]


def brute_kept(rows):
    """Ids that stay: the smallest of each group."""
    rows = sorted(rows)
    return [i for k, ((i, _), r) in enumerate(zip(rows, brute_roots(shingles(t) for _, t in rows))) if k == r]


def edited(seed):
    """Families of near copies by changed, dropped and added words, all with one common line."""
    rng, line, out = random.Random(seed), "this line stands in every text of the whole set", []
    for family in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(8, 160))]
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 35))):
                at = rng.randrange(len(copy))
                copy[at:at + 1] = rng.choice([[], ["new"], [copy[at], "more"]])
            out.append(f"{line}\n{' '.join(copy)}")
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("few, seed", [(32, 1), (2, 2), (2, 3)])
def test_stage_drops_every_text_at_eight_tenths(spark, sf, monkeypatch, few, seed):
    monkeypatch.setattr(J, "FEW_NODES", few)
    rows = edited(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(r.doc_id for r in C.near_duplicates(spark, docs, sf).collect())
    assert got == brute_kept(rows)
    assert len(got) < len(rows)


def test_odd_rows(odd, none):
    kept = J.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    rows = [(i, t or "") for i, t, *_ in ODD]
    root = brute_roots(shingles(t) for _, t in rows)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min((x for x in (least.get(root[k]), i) if x is not None), default=None)
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t) for k, (i, t) in enumerate(rows) if i is not None and i == least[root[k]])
    assert J.drop_near_duplicates(none).count() == 0


def test_many_texts_of_common_passages(spark, sf):
    """Short texts put together from a few passages: all their shingles are frequent, few pairs are near."""
    rng = random.Random(8)
    passages = [" ".join(f"p{k}w{i}" for i in range(14)) for k in range(9)]
    rows = list(enumerate("\n".join(rng.choice(passages) for _ in range(rng.randint(1, 6))) for _ in range(400)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(r.doc_id for r in C.near_duplicates(spark, docs, sf).collect()) == brute_kept(rows)


def test_small_blocks_and_large_texts(spark, sf, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 64)
    monkeypatch.setattr(J, "BLOCK_ROWS", 3)
    rows = edited(4)
    long = " ".join(f"n{i * 7919 % 5003}" for i in range(9000))
    rows += [(9_000, long), (9_001, long + " and a word"), (9_002, "ONE and more"), (9_003, "one AND more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(r.doc_id for r in C.near_duplicates(spark, docs, sf).collect())
    assert got == brute_kept(rows) and 9_000 in got and 9_001 not in got and 9_003 not in got


def test_simhash_joins_near_copies_first(spark, sf, monkeypatch):
    """The fingerprints' pairs are looked for and compared before any other; before, the stage used no SimHash."""
    seen = []
    linked = J._linked

    def told(pairs, texts, nodes, name):
        out = linked(pairs, texts, nodes, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(J, "_linked", told)
    rng = random.Random(5)
    base = [f"w{rng.randrange(9000)}" for _ in range(3000)]
    rows = list(enumerate(" ".join(base[:k] + ["x"] + base[k:]) for k in range(0, 3000, 300)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert [r.doc_id for r in C.near_duplicates(spark, docs, sf).collect()] == [0] == brute_kept(rows)
    assert seen[0][0] == "simhash" and seen[0][1] > 0


def test_no_join_makes_pairs_of_a_large_group(spark, sf, monkeypatch):
    """Many texts at common shingles, none near: blocks inside tasks compare them, and few pairs come out."""
    made = []
    monkeypatch.setattr(J, "BLOCK_NODES", 16)
    linked = J._linked
    monkeypatch.setattr(J, "_linked", lambda pairs, *rest: made.append(pairs.count()) or linked(pairs, *rest))
    rng = random.Random(9)
    passages = [" ".join(f"p{k}w{i}" for i in range(9)) for k in range(40)]
    rows = list(enumerate("\n".join(rng.sample(passages, 8)) for _ in range(300)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(r.doc_id for r in C.near_duplicates(spark, docs, sf).collect()) == brute_kept(rows)
    assert sum(made) < 10 * len(rows)


def test_sketches_leave_out_no_near_pair():
    sets = [J.shingles_of(t.encode()) for _, t in edited(6)]
    assert any(J.sketch_of(x) != J.sketch_of(y) for x in sets for y in sets)
    for x in sets:
        for y in sets:
            apart = sum((a ^ b).bit_count() for a, b in zip(J.sketch_of(x), J.sketch_of(y)))
            assert apart <= len(x) + len(y) - 2 * len(set(x.tolist()) & set(y.tolist()))
