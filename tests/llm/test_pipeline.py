"""The pipeline against plain Python over the same learnt toxicity scores."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from mailtriage.llm import power_packing, toxicity_pu
from mailtriage.llm.queries import DOMAINS, WEIGHTS
from tests.llm.conftest import CLASHING, LONG
from tests.llm.test_budget_mixing import fill
from tests.llm.test_near_jaccard import brute_kept


def domain_of(source):
    m = re.fullmatch(r"src(\d+)", source or "")
    return DOMAINS[int(m[1]) // 5] if m and int(m[1]) < 20 and str(int(m[1])) == m[1] else "other"


def brute_mix(docs, percent):
    words = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    path = {d["doc_id"]: (domain_of(d["source"]), d["lang"] or "", d["source"] or "") for d in docs}
    leaf = Counter()
    for i, p in path.items():
        leaf[p] += words[i]
    budget = {(): sum(leaf.values()) * percent // 100}
    for depth in range(3):
        cap = Counter()
        for p, n in leaf.items():
            cap[p[:depth + 1]] += n
        for parent in [p for p in budget if len(p) == depth]:
            budget |= fill(budget[parent], [(p, WEIGHTS.get("/".join(p), 1), c) for p, c in cap.items() if p[:depth] == parent])
    keep = set()
    for p, total in leaf.items():
        whole = budget[p] // total if total else 0
        rest = budget[p] - whole * total
        for i in sorted((i for i in path if path[i] == p), key=lambda i: (hashlib.md5(f"20240601:{whole}:{i}".encode()).hexdigest(), i)):
            last = max(0, min(words[i], rest))
            rest -= last
            if words[i] * whole + last > 0 or words[i] == 0 and whole > 0:
                keep.add(i)
    return [d for d in docs if d["doc_id"] in keep]


def test_pipeline_equals_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    model = toxicity_pu.fit(table, labels)
    docs = sorted((r.asDict() for r in table.collect()), key=lambda d: d["doc_id"])
    docs = [d for d in docs if model.score((d["text"] or "").lower().encode()) < 0.5]
    seen, first = set(), []
    for d in docs:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", d["text"] or "")
        if norm not in seen:
            first.append(d)
        seen.add(norm)
    ids = set(brute_kept((d["doc_id"], d["text"] or "") for d in first))
    kept = [d for d in first if d["doc_id"] in ids]
    assert len(kept) < len(first)
    kept = brute_mix(kept, C.MIX_PERCENT)
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for d in kept:
        ids = np.array(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for n in power_packing.piece_lengths(len(ids)):
            want.append((d["doc_id"], at, n, zlib.crc32(ids[at:at + n].tobytes()), len(ids), 0))
            at += n
    got = C.run(spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in got) == sorted(want)
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))


def test_stages_keep_columns_and_bear_odd_rows(spark, odd, none, sf):
    docs = odd.drop(*CLASHING)
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() > 0, name
        assert stage(spark, none.drop(*CLASHING), sf).count() == 0, name
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            docs = out
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    assert len(LONG) > 500_000


def test_package_works_without_the_corpus_part():
    import __spark_entry__ as entry

    assert defaultdict(int, entry.queries()) and all(f"op{n}_" in " ".join(entry.queries()) for n in range(1, 14)) and "pipeline" in entry.queries()
