"""Packing by power-of-two decomposition: no sequence crosses documents and none needs padding.

A document's ids (and an end id) are cut into pieces whose lengths are powers of two: as many pieces of the
full window as fit, then the binary digits of the rest, longest first. Each piece is a sequence of its
own; sequences of equal length form a bucket, from which a trainer draws batches of one shape. Token
ids are made once, in one narrow stage; numbering the sequences needs only counts per task and bucket.

Defined cases: null text is empty, and an empty document is the end id alone. Repeated rows are packed
each on its own. Empty input gives no rows. Other columns of the input are not read.

Tokens. Ids are those of the ``tokenizers`` file. The same vocabulary as ranks gives the same ids about six
times faster for one chunk, and chunks (a space and what follows up to the next) recur, so each worker
keeps the ids of chunks it has seen. Cutting there is exact because the splitting pattern always starts a
token at a space that is followed by something else than white space. Segments of a text with a space before other
white space, or with a special token written out, are encoded by ``tokenizers``.
"""

from __future__ import annotations

import base64
import re
import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mailtriage.llm.common import give_back, materialize_texts, pieces, released, text_of
from mailtriage.session import ship

WINDOW = 2048
END_ID = 1
KEPT_CHUNKS = 200_000
BATCH_BYTES = 8 << 20
# Characters that are encoded at a time: an encoding of the tokenizers file takes some hundred bytes a character.
SEGMENT_CHARS = 1 << 16

# A space between a letter, digit or stop and a letter or digit: a token always starts there.
_CUT = re.compile(r"(?<=[0-9A-Za-z.,]) (?=[0-9A-Za-z])")
_WHOLE = re.compile(r" \s| \Z|<\|endoftext\|>")
_TOKENIZERS: dict = {}
# Seconds after which a worker without a packing task gives its tokenizer back: workers are reused by the stages that follow.
IDLE_SECONDS = 10.0
_LAST_TASK = [0]


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """The text cut after about ``size`` characters each, only where a token starts."""
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


class ChunkIds(dict):
    """Ids (little-endian 32-bit) of the chunks seen by this worker.

    A full one takes no more, since frequent chunks come early; it is emptied when many were not found after that.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        super().__init__()
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self._full, self.missed = json_path, None, 0

    @property
    def full(self):
        """The tokenizer of the file itself, loaded when a text first asks for it."""
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self.json_path)
        return self._full

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= KEPT_CHUNKS:
            self.missed += 1
            if self.missed > 4 * KEPT_CHUNKS:
                self.clear()
                self.missed = 0
        ids = np.array(self.fast.encode_ordinary(" " + chunk), "<u4").tobytes()
        if len(chunk) <= 64 and len(self) < KEPT_CHUNKS:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._encode, segments(text)))

    def _encode(self, text: str) -> bytes:
        if _WHOLE.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *rest = text.split(" ")
        first = np.array(self.fast.encode_ordinary(head), "<u4").tobytes() if head else b""
        return first + b"".join(map(self.__getitem__, rest))


def tokenizer(json_path: str, ranks_path: str) -> ChunkIds:
    """One per Python worker, kept between tasks that follow each other."""
    import public_tokenizers

    _LAST_TASK[0] += 1
    key = (json_path, ranks_path)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = ChunkIds(json_path, ranks_path, public_tokenizers.PATTERN)
    return _TOKENIZERS[key]


def rest(seconds: float = IDLE_SECONDS) -> threading.Timer:
    """Give the worker's tokenizers and their chunks back after ``seconds``, unless another task takes them before."""
    last = _LAST_TASK[0]

    def drop():
        if _LAST_TASK[0] == last:
            _TOKENIZERS.clear()
            give_back()

    timer = threading.Timer(seconds, drop)
    timer.daemon = True
    timer.start()
    return timer


def piece_lengths(tokens: int, window: int = WINDOW) -> list[int]:
    full, rest = divmod(tokens, window)
    return [window] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut(json_path: str, ranks_path: str, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task, used = tokenizer(json_path, ranks_path).encode, TaskContext.get().partitionId(), {}
        end = np.array([END_ID], "<u4").tobytes()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * with_ids]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth", *["ids"] * with_ids]
        for whole in batches:
            for batch in pieces(whole, "text", BATCH_BYTES):
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py()) + end
                    tokens, start = len(ids) // 4, 0
                    for length in piece_lengths(tokens, window):
                        part = ids[4 * start:4 * (start + length)]
                        nth = used[length] = used.get(length, -1) + 1
                        out.append((doc_id, start, length, zlib.crc32(part), tokens, task, nth, *[part] * with_ids))
                        start += length
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names)
        del encode
        rest()

    return run


def pack(docs: DataFrame, json_path: str, ranks_path: str, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids (binary).

    ``window`` is a power of two. Sequence ids are gapless and ordered by bucket, longest first.
    """
    ship(docs.sparkSession)
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, nth bigint" + ", ids binary" * with_ids
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    cut = materialize_texts(texts.mapInArrow(released(_cut(json_path, ranks_path, window, with_ids)), schema), "packed-pieces")
    # One row per task and bucket.
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc("length"), "task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    return cut.join(bases, ["length", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), *["ids"] * with_ids)
