"""Periodic runs of words: every maximal stretch that repeats a block of words, and the text with the repeats taken out.

A run is a stretch of words with smallest period q (words q apart are equal) and at least max(24, 3 q) words that no
neighbouring word extends keeping period q.

1. Periods up to 8 are found by direct scans: where words at that lag are equal for long enough.
2. Longer periods are split into scales, each up to 1.5 times the one before. At the scale of periods up to K every
   stretch of K words has a 64-bit hash, and of each window of such stretches the smallest hash is a minimizer. Inside a
   run window minima repeat at a distance of one period: stretches of K >= q words are equal there only at multiples
   of q, and the window is short enough that a run of 3 q words holds a window and the one a period later. So each run
   has two minimizers, next to each other among those of one hash, that lie a period apart.
3. Such pairs are seeds: words are compared outwards from them, one seed per stretch and period. Stretches that are
   long enough and have no shorter period are runs. Hashes only propose; what is returned was compared word by word.

Texts of one Arrow batch are laid end to end with words that occur once between them, so that each scale costs a few
passes over an array; a scale takes only texts that can hold a run of its periods. No text moves between tasks.

Defined cases: null text has no words. Texts without runs have n_runs 0, nulls for the longest, and the digest of an
empty list. Runs may overlap; words in several of them are dropped if any drops them. Rows may repeat, ids may be
null (decimal digits of no id: the empty string). Empty input gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mailtriage.llm.common import pieces, text_of
from mailtriage.session import ship

LEAST_WORDS, LEAST_PERIODS = 24, 3
# Periods up to this one are scanned for lag by lag.
SHORT = LEAST_WORDS // LEAST_PERIODS
BATCH_BYTES = 4 << 20

_SCHEMA = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, "
           "runs array<struct<start:bigint,length:bigint,period:bigint>>")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, in this order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window, by windows of doubled width."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """The last period of the scale before, the last of this one, and the window: 2 q - K + 1 for its smallest period q."""
    low = SHORT
    while low < longest:
        high = low * 3 // 2
        yield low, high, 2 * (low + 1) - high + 1
        low = high


def _equal_from(x: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on in one direction equal those ``lag`` later."""
    done, size = 0, 64
    while True:
        lo, hi = (at + done, at + done + size) if step > 0 else (at - done - size + 1, at - done + 1)
        lo, hi = max(lo, 0), min(hi, len(x) - lag)
        if hi <= lo:
            return done
        same = x[lo:hi] == x[lo + lag:hi + lag]
        stop = np.flatnonzero(~(same if step > 0 else same[::-1]))
        if len(stop):
            return done + int(stop[0])
        done, size = done + hi - lo, 2 * size


def _primitive(x: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether the stretch, three periods long at least, has no shorter period: that would divide this one."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            lag = period // prime
            if np.array_equal(x[start:end - lag], x[start + lag:end]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def _short_runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    for lag in range(1, min(SHORT, len(x) - 1) + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([False], x[lag:] == x[:-lag], [False])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2] + lag
        for s, e in zip(*(v[ends - starts >= LEAST_WORDS].tolist() for v in (starts, ends))):
            yield s, e, lag


def _seeds(x: np.ndarray, hashes: np.ndarray, low: int, high: int, width: int) -> list[tuple[int, int]]:
    """(period, position) of neighbouring equal minimizers at one of the scale's periods; ``hashes`` are of stretches of ``high`` words."""
    bits = np.uint64(len(hashes).bit_length())
    packed = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    least = _window_min(packed, width)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    order = at[np.argsort(hashes[at], kind="stable")]
    lag = np.diff(order)
    hit = (hashes[order[1:]] == hashes[order[:-1]]) & (lag > low) & (lag <= high)
    return sorted(zip(lag[hit].tolist(), order[:-1][hit].tolist()))


def _long_runs(x: np.ndarray, longest: list[int], starts: list[int]) -> Iterator[tuple[int, int, int]]:
    """Runs of more than SHORT words a period. ``longest`` falls: words of each text; ``starts``: where it begins in ``x``."""
    blocks, size = x.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9), 1
    blocks = blocks ^ (blocks >> np.uint64(31))
    texts = len(longest)
    for low, high, width in scales(longest[0] // LEAST_PERIODS):
        while longest[texts - 1] < LEAST_PERIODS * (low + 1):
            texts -= 1
        end = starts[texts - 1] + longest[texts - 1]
        while 2 * size <= high:
            blocks, size = _mixed(blocks[:-size], blocks[size:]), 2 * size
        rest = high - size
        hashes = _mixed(blocks[:end - high + 1], blocks[rest:rest + end - high + 1])
        if len(hashes) < width:
            continue
        covered: dict[int, int] = {}
        for lag, at in _seeds(x, hashes, low, high, width):
            if at < covered.get(lag, -1):
                continue
            ahead = _equal_from(x, at, lag, 1)
            s, e = at - _equal_from(x, at - 1, lag, -1), at + ahead + lag
            covered[lag] = e - lag
            if e - s >= LEAST_PERIODS * lag:
                yield s, e, lag


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start and period; texts are arrays of non-negative word numbers."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if len(t) >= LEAST_WORDS), key=lambda i: -len(texts[i]))
    if not order:
        return out
    # A word that occurs once follows each text.
    x = np.concatenate([y for k, i in enumerate(order) for y in (texts[i], np.array([-1 - k]))]).astype(np.int64)
    lengths = [len(texts[i]) for i in order]
    starts = np.cumsum([0, *(n + 1 for n in lengths[:-1])])
    for found in (_short_runs(x), _long_runs(x, lengths, starts.tolist())):
        for s, e, q in found:
            if _primitive(x, s, e, q):
                k = int(np.searchsorted(starts, s, "right")) - 1
                out[order[k]].append((s - int(starts[k]), e - s, q))
    return [sorted(set(r), key=lambda r: (r[0], r[2])) for r in out]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those in no run, and the first period of runs where no other run drops them."""
    edges = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edges[s + q] += 1
        edges[s + length] -= 1
    return np.cumsum(edges[:n]) == 0


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


Change = Callable[[int | None, list[bytes]], list[bytes]]


def _detect(change: Change | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "data", BATCH_BYTES):
                ids = batch.column(0).to_pylist()
                words = [value.as_buffer().to_pybytes().split() for value in batch.column(1)]
                if change is not None:
                    words = [change(i, w) for i, w in zip(ids, words)]
                number = defaultdict(count().__next__).__getitem__
                found = runs_of([np.fromiter(map(number, w), np.int64, len(w)) for w in words])
                rows = []
                for w, runs in zip(words, found):
                    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
                    if runs:
                        w = [w[i] for i in np.flatnonzero(kept_words(len(w), runs)).tolist()]
                    rows.append((len(runs), *best, 1000 * best[1] // best[2] if runs else None, _hex("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), _hex(b" ".join(w)),
                                 [dict(start=s, length=n, period=q) for s, n, q in runs]))
                types = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(_RUN)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [f.split()[0] for f in _SCHEMA.split(", ")])

    return run


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's own change of every tenth document: from a word on, the words of one stretch over and over."""
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[:n - a]


def with_runs(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, digests, and all runs; ``change`` edits a text's words first."""
    ship(docs.sparkSession)
    data = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("data"))
    return data.mapInArrow(_detect(change), _SCHEMA)
