import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from mailtriage.llm import power_packing as P
from tests.llm.conftest import ODD

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
STRANGE = ["a  b", " a", "a ", "a \n b", "don't  'em ", "x y  z", "a\x1cb \x1d c", "<|endoftext|> and <|endoftext|>", "1 234\n\n 5", "\n a\n b", "é ñ 漢字 😀 ok", "a 'b 's", "tab\t then space ", "\u0085 x", "a \u0085b"]


@pytest.fixture(scope="module")
def full():
    return Tokenizer.from_file(FILES[0])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" ab'.1\n\té  \u0085\x1c<|endoftext>", max_size=40))
def test_chunks_give_the_ids_of_the_whole(text):
    own, want = P.tokenizer(*FILES), Tokenizer.from_file(FILES[0]) if False else _full()
    assert own.encode(text) == np.array(want.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "a", "b1", "3", ".", ",", "'", "\n", "é", "<|endoftext|>", " a b", "1 2. c"]), max_size=60), st.integers(1, 9))
def test_segments_give_the_ids_of_the_whole(parts, size):
    text = "".join(parts)
    cut = list(P.segments(text, size))
    assert "".join(cut) == text
    own, want = P.tokenizer(*FILES), _full()
    assert b"".join(map(own._encode, cut)) == np.array(want.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _full(held=[]):
    if not held:
        held.append(Tokenizer.from_file(FILES[0]))
    return held[0]


@pytest.mark.parametrize("tokens", [1, 2, 3, 7, 2047, 2048, 2049, 5000, 65537])
def test_piece_lengths(tokens):
    lengths = P.piece_lengths(tokens)
    assert sum(lengths) == tokens and all(n <= 2048 and n & (n - 1) == 0 for n in lengths)
    assert len([n for n in lengths if n < 2048]) == len({n for n in lengths if n < 2048})


def test_round_trip(spark, odd, none, full):
    got = P.pack(odd, *FILES).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and {r.offset for r in got} == {0}
    lengths = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    want = Counter()
    for doc_id, text, *_ in ODD:
        want[doc_id, np.array(full.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()] += 1
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for doc_id, pieces in by_id.items():
        ids = {b for d, b in want if d == doc_id}
        if len(ids) == 1:
            whole, copies = ids.pop(), sum(n for (d, _), n in want.items() if d == doc_id)
            assert Counter((r.start, r.ids) for r in pieces) == Counter({(s, whole[4 * s:4 * (s + n)]): copies for s, n in starts(len(whole) // 4)})
    assert P.pack(none, *FILES).count() == 0


def starts(tokens):
    at = 0
    for n in P.piece_lengths(tokens):
        yield at, n
        at += n


def test_strange_texts(full):
    own = P.tokenizer(*FILES)
    for text in STRANGE:
        assert own.encode(text) == np.array(full.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_an_idle_worker_gives_its_tokenizer_back():
    P.tokenizer(*FILES).encode("some words of a text")
    first = P.rest(0.05)
    P.tokenizer(*FILES)
    first.join(5)
    assert P._TOKENIZERS, "a task that came in between keeps it"
    P.rest(0.05).join(5)
    assert not P._TOKENIZERS
    assert P.tokenizer(*FILES).encode("some words") == np.array(_full().encode("some words", add_special_tokens=False).ids, "<u4").tobytes()
