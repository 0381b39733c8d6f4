import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mailtriage.llm import budget_mixing as M
from tests.llm.conftest import ODD

DOMAIN = "case when source = 'src0' then 'web' when source is null then null else 'rest' end"


def domain_of(source):
    return "web" if source == "src0" else "" if source is None else "rest"


def fill(budget, children):
    """Budget among (name, weight, cap): those short of their share give all, the rest share what is left."""
    share, left = {}, list(children)
    while left:
        rest, total = budget - sum(share.values()), sum(w for _, w, _ in left)
        short = [c for c in left if c[2] * total <= rest * c[1]]
        if not short:
            upto = 0
            for name, w, cap in sorted(left, key=lambda c: (c[2] / c[1], c[0])):
                share[name] = rest * (upto + w) // total - rest * upto // total
                upto += w
            return share
        share |= {name: cap for name, _, cap in short}
        left = [c for c in left if c not in short]
    return share


def brute(rows, weights, percent, epochs, seed=M.SEED):
    docs = [(i, domain_of(s), lang or "", s or "", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, lang, s in rows]
    leaf = defaultdict(int)
    for _, d, lang, s, n in docs:
        leaf[d, lang, s] += n
    budget = {(): min(sum(leaf.values()) * percent // 100, sum(leaf.values()) * epochs)}
    for depth in range(3):
        cap = defaultdict(int)
        for path, n in leaf.items():
            cap[path[:depth + 1]] += n * epochs
        for parent in [p for p in budget if len(p) == depth]:
            children = [(p, weights.get("/".join(p), 1), c) for p, c in cap.items() if p[:depth] == parent]
            budget |= fill(budget[parent], children)
    out = []
    for path, total in leaf.items():
        whole = budget[path] // total if total else 0
        rest = budget[path] - whole * total
        mine = [(hashlib.md5(f"{seed}:{whole}:{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, n) for i, d, lang, s, n in docs if (d, lang, s) == path]
        for _, i, n in sorted(mine):
            last = max(0, min(n, rest))
            rest -= last
            out.append((i, *path, n, whole, last, n * whole + last))
    return sorted(out)


def run(df, weights, percent, epochs):
    table = df.sparkSession.createDataFrame(sorted(weights.items()) or [("x", 1)], "node string, weight bigint")
    got = M.mix(df, F.expr(DOMAIN), table, percent, max_epochs=epochs).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.domain, r.lang or "", r.source or "", r.tokens, r.epochs, r.last_tokens, r.selected_tokens) for r in got)


ROWS = [(i, "w " * (1 + i * 7 % 23), ["en", "de", None][i % 3], [f"src{i % 4}", None][i % 5 == 0]) for i in range(400)]
WEIGHTS = {"web": 5, "rest": 2, "rest/en": 3, "web/de": 4, "rest/en/src1": 7}


@pytest.mark.parametrize("percent, epochs", [(30, 1), (90, 1), (100, 1), (100, 2), (170, 2), (0, 1)])
def test_against_brute_force(spark, percent, epochs):
    got = run(spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string"), WEIGHTS, percent, epochs)
    assert got == brute(ROWS, WEIGHTS, percent, epochs)
    total = sum(r[4] for r in got)
    assert sum(r[7] for r in got) == min(total * percent // 100, total * epochs)


def test_shortage_goes_to_siblings_first():
    share = fill(100, [("a", 1, 10), ("b", 1, 1000), ("c", 2, 1000)])
    assert share == {"a": 10, "b": 30, "c": 60}


def test_odd_rows(odd, none):
    want = [(-1 if r[0] is None else r[0], *r[1:]) for r in brute(ODD, {}, 60, 1)]
    got = run(odd, {}, 60, 1)
    # Rows with equal ids may share a bucket in either order.
    key = lambda rows: sorted((r[0], *r[1:6]) for r in rows)
    assert key(got) == key(want) and sum(r[7] for r in got) == sum(r[7] for r in want)
    assert M.mix(none, F.expr(DOMAIN), odd.sparkSession.createDataFrame([("x", 1)], "node string, weight bigint"), 50).count() == 0
