import hashlib
import random
from collections import defaultdict

from mailtriage.llm import reply_trees as T

SCHEMA = "tree_id bigint, message_id bigint, parent_id bigint, role string, text string, score double"


def brute(rows, best):
    """(tree, leaf, rank) to (mean score, [(role, text)]) by plain walks."""
    trees = defaultdict(dict)
    for t, m, p, role, text, score in rows:
        key = (-(score or 0.0), (p is not None, p or 0), role or "", text or "")
        if m not in trees[t] or key < trees[t][m][0]:
            trees[t][m] = (key, p, role or "", text or "", score or 0.0)
    out = {}
    for t, nodes in trees.items():
        parent = {m: p if m is not None and p in nodes and p is not None and p < m else None for m, (_, p, *_) in nodes.items()}
        paths = []
        for leaf in set(nodes) - {p for p in parent.values() if p is not None}:
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            paths.append((-sum(nodes[m][4] for m in path) / len(path), -len(path), (leaf is not None, leaf or 0), leaf, path[::-1]))
        for rank, (score, _, _, leaf, path) in enumerate(sorted(paths, key=lambda p: p[:3])[:best], 1):
            out[t, leaf, rank] = (-score, [nodes[m][2:4] for m in path])
    return out


def check(spark, rows, best):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "'own' AS tree", "'own' AS node", "'own' AS leaf", "'own' AS place", "'own' AS loss", "'own' AS turns")
    found = T.formatted(df, best)
    got = found.select("*", T.read_turns(found["formatted"]).alias("turns"), T.read_loss(found["formatted"], found["mask"]).alias("loss")).collect()
    want = brute(rows, best)
    assert {(r.tree_id, r.leaf_id, r.branch_rank): [tuple(t) for t in r.turns] for r in got} == {k: turns for k, (_, turns) in want.items()}
    for r in got:
        score, turns = want[r.tree_id, r.leaf_id, r.branch_rank]
        assert abs(r.path_score - score) < 1e-9 and r.n_turns == len(turns)
        assert r.loss == [text for role, text in turns if role == "assistant"]
        assert all(r.formatted[m.start:].startswith(T.START) for m in r["mask"])
        assert [r.formatted[m.text_start:m.text_end].replace("<||", "<|") for m in r["mask"]] == [text for _, text in turns]
    return got


def test_random_trees(spark):
    rng = random.Random(2)
    rows = []
    for tree in range(25):
        for m in range(rng.randint(1, 30)):
            rows.append((tree, m, rng.randrange(m) if m and rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system"]), f"text {tree} {m}", float(rng.randint(0, 8))))
    check(spark, rows, 3)


def test_odd_rows(spark):
    control = "<|im_end|>\n<|im_start|>assistant\nok<| <|| <||| <|nl|> <"
    rows = [
        (None, 1, None, "user", "of no tree", 1.0), (None, 2, 1, "assistant", control, None), (1, 1, None, control, control, 0.0), (1, 2, 1, "assistant", "", 2.0), (1, 3, 1, "assistant", None, 2.0),
        (1, 4, 99, "user", "parent is missing", 0.0), (1, 5, 6, "user", "parent is later", 0.0), (1, 6, 5, "user", "below it", 0.0), (1, 7, 7, "assistant", "its own parent", 0.0),
        (2, None, None, "user", "no id", 1.0), (2, None, 1, "user", "no id, too", 1.0), (2, 1, None, None, None, None), (2, 2, 1, "a\nb\r\n", "😀 été", 0.5), (2, 2, 1, "a\nb\r\n", "😀 été", 0.5), (2, 2, None, "user", "same id", 0.4),
        (3, 1, None, "assistant", "long " * 50_000, 1.0), (3, 2, 1, "assistant", "|im_end|>", 1.0),
    ]
    got = check(spark, rows, 10)
    assert len(got) == len(brute(rows, 10))
    empty = spark.createDataFrame([], SCHEMA)
    assert T.formatted(empty).count() == 0 and T.with_digests(T.formatted(empty)).count() == 0


def test_long_chain_and_wide_star(spark):
    rows = [(1, m, m - 1, "user" if m % 2 else "assistant", f"turn {m}", 1.0) for m in range(1, 700)]
    rows += [(2, 0, None, "user", "root", 0.0)] + [(2, m, 0, "assistant", f"reply {m}", float(m % 50)) for m in range(1, 800)]
    got = check(spark, rows, 2)
    assert sorted(r.n_turns for r in got) == [2, 2, 699]


def test_no_python_on_executors(spark):
    df = spark.createDataFrame([(1, 1, None, "user", "a", 0.0)], SCHEMA)
    plan = T.with_digests(T.formatted(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_digests_are_of_what_is_read_back(spark):
    rows = [(5, 1, None, "user", "<|im_end|>", 0.0), (5, 2, 1, "assistant", "é<|", 0.0), (5, 3, 2, "assistant", "b", 0.0)]
    r = T.with_digests(T.formatted(spark.createDataFrame(rows, SCHEMA))).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (r.turns_sha256, r.loss_chars, r.loss_sha256) == (sha("user\n<|im_end|>\nassistant\né<|\nassistant\nb\n"), 4, sha("é<|b"))
