"""Personal data by a skip-chain conditional random field over number-like and address-like tokens.

Base spans come from fixed patterns with their checks (octets, Luhn, digit counts); they always stay. The
field adds spans where the patterns fail but the document speaks for them:

* Nodes are the tokens (runs without ASCII white space) that hold a digit or an at sign, whole text through.
  All other tokens are certain to be outside; they appear as neighbours only.
* Labels: outside, email, ip, card, phone. Node potentials are learned weights of hashed shape features of
  the token and its neighbours; chain potentials are learned for adjacent nodes.
* Skip edges join nodes with the same digits (seven or more), the same last ten digits, or the same
  letters and digits apart from case and punctuation (six or more); occurrences are joined one to the next, so a repeated token costs as
  many edges as it has occurrences. Their potential rewards equal labels.
* Loopy sum-product with damping, for all documents of a batch at once, gives each node its distribution.
  Nodes labelled with at least ``certain`` probability that no base span covers become spans, neighbours in
  the text with one label a single one; the checks on octets, Luhn sums and digit counts hold for these too.

Nodes inside base spans are observed with their kind, so that certainty flows along skip edges.

Fit: potentials by pseudo-likelihood on the nodes of a bounded sample of documents (``max_documents``, smallest
hashes of the ids), labelled by the base spans; NumPy on the driver gets those nodes' features only.

Defined cases: null text is empty and has no spans; the hash of no spans is that of the empty string. Repeated rows each give a row, empty input none. Other columns are carried along.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mailtriage.llm.common import text_of
from mailtriage.session import ship

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["outside", *KINDS]
MAX_DOCUMENTS = 4_000
TABLE_SIZE = 1 << 12
ROUNDS, DAMPING = 12, 0.3
CERTAIN = 0.7
TEXTS_AT_ONCE = 256

# The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_SIGN, _SPACE, _NOT_DIGIT, _NOT_ALNUM = re.compile(r"[0-9@]"), re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[^0-9]+"), re.compile(r"[^a-z0-9]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_TRIM = "\"'`([{<>}]).,;:!?*&%$#|"
_SPACES = " \t\n\v\f\r"
NEAR = 40
FEATURES = 9

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _plausible(kind: str, text: str) -> bool:
    """The checks of the base patterns, which hold for added spans too."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return "@" in text if kind == "email" else len(text.split(".")) == 4 and all(p.isascii() and p.isdigit() and _octet(p) for p in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of the e-mail pattern, in time linear in the text: a match holds one at sign and starts where its local part does."""
    end, at = 0, text.find("@")
    while at >= 0:
        back = next((m.end() for m in _NOT_LOCAL.finditer(text[end:at][::-1])), None)
        start = end if back is None else at - back + 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            end = domain.end()
        end, at = max(end, at + 1), text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind as listed."""
    found = [("email", *span) for span in _emails(text)]
    if _SIGN.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for kind, least, most in (("card", 14, 19), ("phone", 10, 15)):
            for m in PATTERNS[kind].finditer(text):
                digits = _NOT_DIGIT.sub("", m[0])
                if least <= len(digits) <= most and (kind == "phone" or _luhn(digits)):
                    found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _shape(token: str) -> str:
    return "".join("0" if c in "0123456789" else "a" if c.isalpha() else c for c in token[:NEAR])


def _short(shape: str) -> str:
    return re.sub(r"(.)\1+", r"\1", shape)


@dataclass
class Nodes:
    """Of one text: trimmed spans, features (FEATURES each), labels from base spans (-1: not covered), chain and skip edges."""

    spans: list[tuple[int, int]]
    found: list[list[int]]
    observed: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def nodes_of(text: str, base: list[Span]) -> Nodes:
    spans, found, observed, chain, skip, last = [], [], [], [], set(), {}
    end, raw_end, covered = 0, -1, 0
    while sign := _SIGN.search(text, end):
        start = max(text.rfind(c, end, sign.start()) for c in _SPACES) + 1 or end
        space = _SPACE.search(text, sign.end())
        end = space.start() if space else len(text)
        token = text[start:end]
        left = len(token) - len(token.lstrip(_TRIM))
        core = token.strip(_TRIM)
        if not core:
            continue
        node, span = len(spans), (start + left, start + left + len(core))
        if spans and not text[raw_end:start].strip(_SPACES):
            chain.append((node - 1, node))
        raw_end = end
        while covered < len(base) and base[covered][2] <= span[0]:
            covered += 1
        over = next((b for b in base[covered:covered + len(KINDS)] if b[1] < span[1] and b[2] > span[0]), None)
        before, after = text[max(0, start - NEAR):start].split(), text[end:end + NEAR].split()
        shape, digits = _shape(core), _NOT_DIGIT.sub("", core)
        parts = [
            "bias", f"s{shape}", f"c{_short(shape)}", f"n{min(len(digits), 24)}", f"@{'@' in core}{'.' in core.rpartition('@')[2]}", f"+{token[:1]}",
            f"p{_short(_shape(before[-1])) if before else ''}", f"f{_short(_shape(after[0])) if after else ''}", f"b{_short(shape)}|{_short(_shape(before[-1])) if before else ''}",
        ]
        found.append([zlib.crc32(p.encode()) % TABLE_SIZE for p in parts])
        spans.append(span)
        observed.append(LABELS.index(over[0]) if over else -1)
        letters = _NOT_ALNUM.sub("", core.lower())
        for key in [f"d{digits}"] * (len(digits) >= 7) + [f"l{digits[-10:]}"] * (len(digits) >= 10) + [f"a{letters}"] * (len(letters) >= 6):
            if key in last:
                skip.add((last[key], node))
            last[key] = node
    return Nodes(spans, found, observed, chain, sorted(skip))


@dataclass
class SkipChainModel:
    weights: np.ndarray
    chain: np.ndarray
    skip: float

    def marginals(self, texts: list[Nodes]) -> list[np.ndarray]:
        """Loopy sum-product over all texts at once; observed nodes stand firm."""
        sizes = [len(t.spans) for t in texts]
        shift = np.cumsum([0, *sizes])
        unary = self.weights[np.array([f for t in texts for f in t.found], np.int64)].sum(axis=1)
        seen = np.array([o for t in texts for o in t.observed])
        unary[seen >= 0] = -1e3
        unary[np.flatnonzero(seen >= 0), seen[seen >= 0]] = 0
        k = len(LABELS)
        edges = [(a + s, b + s, kind) for t, s in zip(texts, shift) for kind, pairs in enumerate((t.chain, t.skip)) for a, b in pairs]
        belief = unary
        if edges:
            a, b, kind = np.array(edges).T
            forth = np.where(kind[:, None, None] == 0, self.chain, np.eye(k) * self.skip)
            source, target, pair = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([forth, forth.transpose(0, 2, 1)])
            twin = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            messages = np.zeros((len(source), k))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, messages)
                inner = (belief[source] - messages[twin])[:, :, None] + pair
                top = inner.max(axis=1)
                fresh = top + np.log(np.exp(inner - top[:, None, :]).sum(axis=1))
                fresh -= fresh.max(axis=1)[:, None]
                messages = DAMPING * messages + (1 - DAMPING) * fresh
            belief = unary.copy()
            np.add.at(belief, target, messages)
        probs = np.exp(belief - belief.max(axis=1)[:, None])
        return np.split(probs / probs.sum(axis=1)[:, None], shift[1:-1])

    def added(self, text: str, nodes: Nodes, probs: np.ndarray, certain: float = CERTAIN) -> list[Span]:
        out: list[Span] = []
        joined = {b for a, b in nodes.chain}
        before = None
        for i, (start, end) in enumerate(nodes.spans):
            label = int(probs[i].argmax())
            if nodes.observed[i] >= 0 or label == 0 or probs[i, label] < certain:
                before = None
                continue
            if before == label and i in joined:
                out[-1] = (LABELS[label], out[-1][1], end)
            else:
                out.append((LABELS[label], start, end))
            before = label
        return [s for s in out if _plausible(s[0], text[s[1]:s[2]])]

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """Base spans and all spans of each text."""
        out = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            part = texts[at:at + TEXTS_AT_ONCE]
            base = [base_spans(t) for t in part]
            nodes = [nodes_of(t, b) if _SIGN.search(t) else Nodes([], [], [], [], []) for t, b in zip(part, base)]
            open_at = [i for i, n in enumerate(nodes) if -1 in n.observed]
            more = {}
            if open_at:
                for i, probs in zip(open_at, self.marginals([nodes[i] for i in open_at])):
                    more[i] = self.added(part[i], nodes[i], probs)
            out += [(b, sorted(b + more.get(i, []), key=lambda s: (s[1], KINDS.index(s[0])))) for i, b in enumerate(base)]
        return out


def fit_nodes(rows: list[dict], steps: int = 200, rate: float = 0.3, decay: float = 0.02, skip_prior: float = 3.0) -> SkipChainModel:
    """Pseudo-likelihood: each node given its features and its neighbours' labels. The skip potential keeps to its prior where repeated tokens are rare."""
    k = len(LABELS)
    weights, chain, skip = np.zeros((TABLE_SIZE, k)), np.zeros((k, k)), skip_prior
    if not rows:
        return SkipChainModel(weights, chain, 0.0)
    shift = np.cumsum([0, *[len(r["labels"]) for r in rows]])
    y = np.concatenate([np.array(r["labels"], np.int64) for r in rows])
    found = np.concatenate([np.array(r["found"], np.int64).reshape(-1, FEATURES) for r in rows])
    pairs = {n: np.concatenate([np.array(r[n], np.int64).reshape(-1, 2) + s for r, s in zip(rows, shift)]) for n in ("chain", "skip")}
    target, (ca, cb), (sa, sb) = np.eye(k)[y], pairs["chain"].T, pairs["skip"].T
    agree = np.zeros((len(y), k))
    np.add.at(agree, sa, target[sb])
    np.add.at(agree, sb, target[sa])
    moments = [np.full_like(weights, 1e-8), np.full_like(chain, 1e-8), 1e-8]
    for _ in range(steps):
        logits = weights[found].sum(axis=1) + skip * agree
        np.add.at(logits, cb, chain[y[ca]])
        np.add.at(logits, ca, chain[:, y[cb]].T)
        probs = np.exp(logits - logits.max(axis=1)[:, None])
        miss = target - probs / probs.sum(axis=1)[:, None]
        grad_w, grad_c = -decay * weights, -decay * chain
        for f in range(FEATURES):
            np.add.at(grad_w, found[:, f], miss)
        np.add.at(grad_c, y[ca], miss[cb])
        np.add.at(grad_c.T, y[cb], miss[ca])
        grad_s = float((agree * miss).sum()) - decay * len(y) * (skip - skip_prior)
        moments = [moments[0] + grad_w ** 2, moments[1] + grad_c ** 2, moments[2] + grad_s ** 2]
        weights += rate * grad_w / np.sqrt(moments[0])
        chain += rate * grad_c / np.sqrt(moments[1])
        skip = max(1.0, skip + rate * grad_s / np.sqrt(moments[2]))
    return SkipChainModel(weights, chain, skip)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            nodes = nodes_of(text, base_spans(text))
            if nodes.spans:
                out.append(([max(0, o) for o in nodes.observed], [f for n in nodes.found for f in n], [x for e in nodes.chain for x in e], [x for e in nodes.skip for x in e]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())) for x in zip(*out)], ["labels", "found", "chain", "skip"])


def fit(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> SkipChainModel:
    ship(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id is not null")
    # At most max_documents ids.
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("text")
    rows = texts.mapInArrow(_sample, ", ".join(f"{n} array<int>" for n in ("labels", "found", "chain", "skip"))).toArrow()
    return fit_nodes(sorted(rows.to_pylist(), key=repr))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def with_spans(docs: DataFrame, model: SkipChainModel) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (of base spans), base_sha256 and spans (all)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def find(text: pd.Series) -> pd.DataFrame:
        rows = []
        for base, spans in held.value.spans(list(text)):
            kinds = [s[0] for s in base]
            rows.append((*map(kinds.count, KINDS), hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return docs.withColumn("__found", find(text_of())).withColumns({n: F.col(f"__found.{n}") for n in names}).drop("__found")
