"""Language of words and texts by a linear-chain conditional random field.

Words are runs of letters in lower case. A word's potentials for the languages are sums of learned weights
of its features: prefixes and suffixes of 1 to 3 bytes, 2- to 4-grams of its bytes with word edges, and the
word itself (the lexicon), all hashed into one table of fixed size; neighbouring words share learned
transition potentials. Forward-backward over a whole text gives every word its distribution over the
languages, so a text may switch between words. A text's language has the largest mean probability over its
words, and that mean is its score.

Forward-backward runs in lanes: the words of many texts form one chain, cut into equally long lanes. The
product of each lane's steps links the lanes, after which all lanes run side by side. Between texts a step
forgets where it came from, so the result is that of each text alone, however long it is.

Fit: windows of words from a bounded sample of documents (``max_documents``, the smallest hashes of the ids)
whose crc32(doc_id as text) mod 3 is not 1, chained in random order so that sequences switch language;
gradient ascent on the conditional likelihood in NumPy. The driver gets those windows and nothing else.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows with a null id or lang are not
learnt from; without usable documents every text is ``und``. Equal means go to the first name. Repeated rows
each give a row, empty input none. Other columns are carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mailtriage.llm.common import residue, text_of
from mailtriage.session import materialize, ship

MAX_DOCUMENTS = 4_000
WINDOW_WORDS, WINDOWS_PER_DOCUMENT = 20, 2
SEQUENCE_WINDOWS = 8
TABLE_SIZE = 1 << 16
KEPT_WORDS = 400_000
CHUNK_WORDS = 200_000
FOLDS, HELD_OUT = 3, 1

# Bytes of letters: ASCII letters and every byte of another character; the rest separates words.
_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def lowered() -> Column:
    return F.lower(text_of()).cast("binary")


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


def features(word: bytes) -> list[int]:
    edged, hashed = b" " + word + b" ", zlib.crc32
    out = [hashed(b"w" + word)]
    for n in (2, 3, 4):
        out += [hashed(edged[i:i + n]) for i in range(len(edged) - n + 1)]
    for n in (1, 2, 3):
        out += [hashed(b"p" + word[:n]), hashed(b"s" + word[-n:])]
    return [x % TABLE_SIZE for x in out]


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words in one array, and where each word's start."""
    lists = [features(w) for w in words]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.concatenate([np.array(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64), np.cumsum(sizes) - sizes


def forward_backward(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """Distribution of every word, and if wanted the expected transitions inside texts.

    emission: exponentials of the words' potentials, words by labels; first: whether a word begins a text.
    """
    n, k = emission.shape
    length = max(1, int(np.sqrt(n / 4)))
    lanes = -(-n // length)
    e, new = np.ones((lanes * length, k)), np.ones(lanes * length, bool)
    e[:n], new[:n] = emission, first
    e, new, start = e.reshape(lanes, length, k), new.reshape(lanes, length), np.full(k, 1 / k)
    product = np.broadcast_to(np.eye(k), (lanes, k, k)).copy()
    for t in range(length):
        step = (product.reshape(-1, k) @ transition).reshape(lanes, k, k)
        at = new[:, t]
        step[at] = product[at].sum(axis=2)[:, :, None] * start
        step *= e[:, t, None, :]
        product = step / step.max(axis=(1, 2))[:, None, None]
    into, back = np.empty((lanes, k)), np.empty((lanes, k))
    state = start
    for c in range(lanes):
        into[c] = state
        state = state @ product[c]
        state = state / state.sum()
    state = np.ones(k)
    for c in range(lanes - 1, -1, -1):
        back[c] = state
        state = product[c] @ state
        state = state / state.max()
    alpha = np.empty_like(e)
    state = into
    for t in range(length):
        step, at = state @ transition, new[:, t]
        step[at] = state[at].sum(axis=1)[:, None] * start
        step *= e[:, t]
        alpha[:, t] = state = step / step.sum(axis=1)[:, None]
    beta = back
    expected = np.zeros((k, k))
    for t in range(length - 1, -1, -1):
        ahead, at = e[:, t] * beta, new[:, t]
        if pairs:
            before = into if t == 0 else alpha[:, t - 1]
            joint = before[:, :, None] * transition * ahead[:, None, :]
            expected += (joint[~at] / joint[~at].sum(axis=(1, 2))[:, None, None]).sum(axis=0)
        alpha[:, t] *= beta
        beta = ahead @ transition.T
        beta[at] = (ahead[at] @ start)[:, None]
        beta /= beta.max(axis=1)[:, None]
    out = alpha.reshape(-1, k)[:n]
    out /= out.sum(axis=1)[:, None]
    return (out, expected) if pairs else out


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    _known: dict = field(default_factory=dict)
    _rows: np.ndarray | None = None

    def __getstate__(self):
        return {"languages": self.languages, "weights": self.weights, "transition": self.transition, "_known": {}, "_rows": None}

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Exponentials of the potentials; those of words seen before are kept by the worker, up to a bound."""
        if len(self._known) > KEPT_WORDS:
            self._known, self._rows = {}, None
        known = self._known
        fresh = list(dict.fromkeys(w for w in words if w not in known))
        if fresh:
            flat, starts = _flat(fresh)
            potentials = np.add.reduceat(self.weights[flat], starts, axis=0)
            rows = np.exp(potentials - potentials.max(axis=1)[:, None]) + 1e-9
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            self._rows = rows if self._rows is None else np.concatenate([self._rows, rows])
        return self._rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def label_words(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Per text the distribution of each word."""
        words = [w for t in texts for w in t]
        if not words:
            return [np.zeros((0, len(self.languages))) for _ in texts]
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(words), bool)
        first[[e - len(t) for e, t in zip(ends, texts) if t]] = True
        return np.split(forward_backward(self.emissions(words), first, self.transition), ends[:-1])

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        out, held, size = [], [], 0
        for i, data in enumerate(texts):
            held.append(words_of(data))
            size += len(held[-1])
            if size >= CHUNK_WORDS or i == len(texts) - 1:
                for word_probs in self.label_words(held):
                    if len(word_probs):
                        mean = word_probs.mean(axis=0)
                        best = int(mean.argmax())
                        out.append((self.languages[best], min(1.0, float(mean[best]))))
                    else:
                        out.append(("und", 0.0))
                held, size = [], 0
        return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Evenly placed windows of each whole text."""
    for batch in batches:
        out = []
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = words_of(data.as_buffer().to_pybytes())
            for j in range(min(WINDOWS_PER_DOCUMENT, -(-len(words) // WINDOW_WORDS))):
                at = max(0, len(words) - WINDOW_WORDS) * j // max(1, WINDOWS_PER_DOCUMENT - 1)
                out.append((lang, b" ".join(words[at:at + WINDOW_WORDS])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.binary()))], ["lang", "words"])


def fit_windows(windows: list[tuple[str, bytes]], steps: int = 50, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> LanguageModel:
    languages = sorted({lang for lang, _ in windows})
    k = len(languages)
    if not k:
        return LanguageModel([], np.zeros((0, 0)), np.zeros((0, 0)))
    windows = sorted(windows)
    # Languages in turn and then shuffled, so that rare ones are seen and neighbours differ.
    order = np.random.default_rng(seed).permutation(len(windows))
    code = {lang: i for i, lang in enumerate(languages)}
    texts = [windows[i][1].split() for i in order]
    y = np.repeat([code[windows[i][0]] for i in order], [len(t) for t in texts])
    heads = np.cumsum([len(t) for t in texts])[SEQUENCE_WINDOWS - 1::SEQUENCE_WINDOWS]
    first = np.zeros(len(y), bool)
    first[[0, *heads[heads < len(y)]]] = True
    lexicon: dict[bytes, int] = {}
    at = np.array([lexicon.setdefault(w, len(lexicon)) for t in texts for w in t])
    flat, starts = _flat(list(lexicon))
    owner = np.repeat(np.arange(len(lexicon)), np.diff(np.append(starts, len(flat))))
    target = np.eye(k)[y]
    share = 1 / np.bincount(y, minlength=k)[y] / k
    inside = ~first[1:]
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:-1][inside], y[1:][inside]), 1)
    weights, logits = np.zeros((TABLE_SIZE, k)), np.zeros((k, k))
    moments = [np.zeros_like(weights), np.zeros_like(logits)]
    for step in range(1, steps + 1):
        potentials = np.add.reduceat(weights[flat], starts, axis=0)
        emission = np.exp(potentials - potentials.max(axis=1)[:, None]) + 1e-9
        probs, expected = forward_backward(emission[at], first, np.exp(logits), pairs=True)
        miss = (target - probs) * share[:, None]
        per_word = np.stack([np.bincount(at, miss[:, j], len(lexicon)) for j in range(k)], axis=1)
        grads = [np.stack([np.bincount(flat, per_word[owner, j], TABLE_SIZE) for j in range(k)], axis=1) - decay * weights / len(lexicon), (seen - expected) / max(1, seen.sum())]
        for value, moment, grad in zip((weights, logits), moments, grads):
            moment += grad * grad
            value += rate * grad / (np.sqrt(moment) + 1e-9)
    transition = np.exp(logits)
    return LanguageModel(languages, weights.astype(np.float32), transition / transition.sum(axis=1)[:, None])


def fit(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> LanguageModel:
    ship(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang").filter("doc_id is not null and lang is not null")
    chosen = narrow.filter(residue("doc_id", FOLDS) != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents).select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", lowered().alias("data")).filter("lang is not null")
    # At most max_documents ids.
    texts = texts.join(F.broadcast(chosen), "doc_id").select("lang", "data")
    windows = texts.mapInArrow(_windows, "lang string, words binary").toArrow()
    return fit_windows(list(zip(windows.column("lang").to_pylist(), windows.column("words").to_pylist())))


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(held.value.predict(list(data)), columns=["lang_pred", "score"])

    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    # A text without a letter is given to the model as empty.
    lettered = F.when(text_of().rlike(r"\p{L}"), lowered()).otherwise(F.lit(b""))
    return docs.withColumn("__found", predict(lettered)).withColumns({"lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")}).drop("__found")
