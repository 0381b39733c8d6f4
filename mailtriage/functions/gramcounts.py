"""Counts of n-grams inside tasks: whole Arrow batches at a time with NumPy instead of expressions per gram.

The grams are those of ``ngrams``. A character gram is a number whose digits are its characters from the left (0: past the
end, 1: blank, 2 to 27: a to z), so numbers sort as the grams do and a gram of any length has one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Characters that are counted at a time.
CHUNK_CHARS = 1 << 20
_BASE = 28
_DIGITS = np.zeros(256, np.int64)
_DIGITS[ord(" ")] = 1
_DIGITS[ord("a"):ord("z") + 1] = np.arange(2, _BASE)
_CHARACTERS = np.frombuffer(b"\0 abcdefghijklmnopqrstuvwxyz", np.uint8)


def chunks(texts: Sequence[str], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """The texts in runs of about ``limit`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def char_codes(texts: Sequence[str], min_n: int, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every character gram inside blank-edged words."""
    parts = [f" {t} ".encode() for t in texts]
    buf = np.frombuffer(b"\n".join(parts), np.uint8)
    row = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])[:len(buf)]
    # One pass per place: the numbers of the grams of every size that start at a character, one below the other.
    digit = np.concatenate([_DIGITS[buf], np.zeros(max_n, np.int64)])
    letter, inside, size = digit > 1, digit > 0, len(buf)
    code, middle = np.zeros(size, np.int64), inside[:size].copy()
    rows, codes = [], []
    for n in range(1, max_n + 1):
        code += digit[n - 1:n - 1 + size] * _BASE ** (max_n - n)
        if n > 2:
            middle &= letter[n - 2:n - 2 + size]
        if n >= max(min_n, 3):
            at = np.flatnonzero(middle & inside[n - 1:n - 1 + size])
            rows.append(row[at])
            codes.append(code[at])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(codes)


def char_terms(codes: np.ndarray, max_n: int) -> pa.Array:
    """The grams of the numbers as strings."""
    digits = np.empty((len(codes), max_n), np.uint8)
    rest = codes
    for i in reversed(range(max_n)):
        rest, digits[:, i] = np.divmod(rest, _BASE)
    used = digits > 0
    offsets = np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(_CHARACTERS[digits[used]].tobytes()))


def char_code(term: str, max_n: int) -> int:
    code = 0
    for c in term.encode().ljust(max_n, b"\0"):
        code = code * _BASE + int(_DIGITS[c])
    return code


def word_tokens(texts: Sequence[str], stop: Sequence[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and token number of every token that counts, in order, and the tokens."""
    split = pc.split_pattern(pa.array(texts, pa.string()), " ")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    coded = split.flatten().dictionary_encode()
    wanted = pc.and_(pc.greater_equal(pc.utf8_length(coded.dictionary), 2), pc.invert(pc.is_in(coded.dictionary, pa.array(stop, pa.string()))))
    keep = wanted.to_numpy(zero_copy_only=False)[coded.indices.to_numpy()] if len(row) else np.zeros(0, bool)
    return row[keep], coded.indices.to_numpy().astype(np.int64)[keep], coded.dictionary


def word_levels(row: np.ndarray, token: np.ndarray, n_tokens: int, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per size n: row and gram number of every gram of n tokens, and the grams' keys in order.

    A key is the number of the gram without its last token, times ``n_tokens``, plus the number of that token.
    """
    start, part = np.arange(len(token)), np.zeros(len(token), np.int64)
    for n in range(1, max_n + 1):
        if n > 1:
            inside = start + n - 1 < len(token)
            inside[inside] = row[start[inside]] == row[start[inside] + n - 1]
            start, part = start[inside], part[inside]
        keys, part = np.unique(part * n_tokens + token[start + n - 1], return_inverse=True)
        yield n, row[start], part, keys


def counted_terms(texts: Sequence[str], spec) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """``term, tf, df`` of parts of the texts; a term comes once per part."""
    for keys, tf, df in _counted(texts, spec):
        yield _terms(keys, spec), tf, df


def _terms(keys: pa.Array, spec) -> pa.Array:
    return keys if spec.analyzer == "word" else char_terms(np.asarray(keys), spec.max_n)


def _counted(texts: Sequence[str], spec) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """As ``counted_terms``, but character grams are numbers still."""
    for run in chunks(texts):
        if spec.analyzer == "word":
            row, token, tokens = word_tokens(run, spec.stop_words)
            terms = None
            for n, at, gram, keys in word_levels(row, token, max(1, len(tokens)), spec.max_n):
                word = tokens.take(pa.array(keys % max(1, len(tokens))))
                terms = word if n == 1 else pc.binary_join_element_wise(terms.take(pa.array(keys // len(tokens))), word, " ")
                if n >= spec.min_n:
                    yield terms, *_tf_df(at, gram, len(keys))
        else:
            found, tf, df = _code_counts(*char_codes(run, spec.min_n, spec.max_n), spec.max_n, len(run))
            yield pa.array(found), tf, df


def _code_counts(row: np.ndarray, code: np.ndarray, max_n: int, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in order, how often each occurs and in how many rows."""
    bits = int(n_rows).bit_length()
    if (_BASE ** max_n) << bits >= 1 << 63:
        found, gram = np.unique(code, return_inverse=True)
        return found, *_tf_df(row, gram, len(found))
    # Sorting plain numbers is several times faster than asking for their order.
    pair = np.sort(code << bits | row)
    new = np.diff(pair, prepend=-1) != 0
    starts = np.flatnonzero(np.diff(pair >> bits, prepend=-1))
    df = np.add.reduceat(new.astype(np.int64), starts) if len(pair) else np.zeros(0, np.int64)
    return pair[starts] >> bits, np.diff(starts, append=len(pair)), df


def _tf_df(row: np.ndarray, gram: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(row * max(1, size) + gram)
    return np.bincount(gram, minlength=size).astype(np.int64), np.bincount(pair % max(1, size), minlength=size).astype(np.int64)


# Terms that a task holds before it sends them on; more are sent as they are, so memory is bounded.
HELD_TERMS = 1 << 20


def _summed(parts: list[pa.Table]) -> pa.Table:
    """One row per term."""
    sums = pa.concat_tables(parts).group_by("term", use_threads=False).aggregate([("tf", "sum"), ("df", "sum")])
    return sums.select(["term", "tf_sum", "df_sum"]).rename_columns(["term", "tf", "df"])


def term_rows(spec, groups: Sequence[str], clean: str, counted=_counted):
    """A ``mapInArrow`` function: rows of ``groups, clean`` to ``groups, term, tf, df``, summed over as many batches as their terms allow.

    ``counted`` gives the terms of texts; the spec says which unless a caller wants others.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[pa.Table]] = {}
        size, types = 0, []

        def sent():
            for key, parts in held.items():
                for part in _summed(parts).to_batches():
                    same = [pa.array([k], t).take(pa.array(np.zeros(part.num_rows, np.int32))) for k, t in zip(key, types)]
                    yield pa.RecordBatch.from_arrays([*same, _terms(part.column(0), spec), part.column(1), part.column(2)], [*groups, "term", "tf", "df"])

        for batch in batches:
            parts: dict[tuple, list[str]] = {}
            types = [batch.schema.field(g).type for g in groups]
            keys = zip(*[batch.column(g).to_pylist() for g in groups]) if groups else [()] * batch.num_rows
            for key, t in zip(keys, batch.column(clean).to_pylist()):
                if t is not None:
                    parts.setdefault(key, []).append(t)
            for key, texts in parts.items():
                for term, tf, df in counted(texts, spec):
                    if len(term):
                        held.setdefault(key, []).append(pa.table([term, pa.array(tf), pa.array(df)], ["term", "tf", "df"]))
                        size += len(term)
                    if size > HELD_TERMS:
                        held = {k: [_summed(p)] for k, p in held.items()}
                        size = sum(p[0].num_rows for p in held.values())
                        if size > HELD_TERMS // 2:
                            yield from sent()
                            held, size = {}, 0
        yield from sent()

    return run


# Slots that the occurrences of word pairs are summed in, and slots of one row of sums.
PAIR_SLOTS, SLICE_SLOTS = 1 << 20, 1 << 14
_MULTIPLIERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def token_hashes(tokens: pa.Array) -> np.ndarray:
    """A number per token that depends on its bytes alone."""
    tokens = pa.concat_arrays([tokens])
    ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset:tokens.offset + len(tokens) + 1].astype(np.int64)
    if not len(tokens) or ends[0] == ends[-1]:
        return np.zeros(len(tokens), np.uint64)
    data = np.frombuffer(tokens.buffers()[2], np.uint8)[ends[0]:ends[-1]].astype(np.uint64) + np.uint64(1)
    ends = ends - ends[0]
    sizes = np.diff(ends)
    powers = np.cumprod(np.full(int(sizes.max()), _MULTIPLIERS[0]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * powers[np.arange(len(data)) - np.repeat(ends[:-1], sizes)])])
    mixed = (sums[ends[1:]] - sums[ends[:-1]]) * _MULTIPLIERS[1]
    return mixed ^ mixed >> np.uint64(32)


def pair_slots(row: np.ndarray, token: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two neighbouring tokens of one row start, and the slot of each two."""
    at = np.flatnonzero(row[1:] == row[:-1])
    both = (hashes[token[at]] * _MULTIPLIERS[0] + hashes[token[at + 1]]) * _MULTIPLIERS[1]
    return at, (both >> np.uint64(64 - PAIR_SLOTS.bit_length() + 1)).astype(np.int64)


def first_rows(spec, clean: str):
    """A ``mapInArrow`` function: rows of ``clean`` to ``term, tf, df`` of single words and, in rows of their own, ``slice, sums`` of the slots of pairs."""
    names = ["term", "tf", "df", "slice", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(PAIR_SLOTS, np.int64)

        def seen():
            for batch in batches:
                for texts in chunks([t for t in batch.column(clean).to_pylist() if t is not None]):
                    row, token, tokens = word_tokens(texts, spec.stop_words)
                    sums[:] += np.bincount(pair_slots(row, token, token_hashes(tokens))[1], minlength=PAIR_SLOTS)
                yield batch

        for part in term_rows(replace(spec, max_n=1), [], clean)(seen()):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())], names)
        slices = sums.reshape(-1, SLICE_SLOTS)
        for i in np.flatnonzero(slices.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([i], pa.int32()), pa.array([slices[i].tobytes()], pa.binary())], names)

    return run


def full_slots(least: int):
    """A grouped Arrow function: ``slice, sums`` of one slice to a bit per slot, set where at least ``least`` pairs are."""
    def run(group: pa.Table) -> pa.Table:
        total = np.zeros(SLICE_SLOTS, np.int64)
        for chunk in group.column("sums").chunks:
            for x in chunk:
                total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"slice": group.column("slice")[:1], "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    return run


def pairs_in(bits: bytes):
    """Counts of the word pairs whose slots have a bit, as ``term_rows`` takes them."""
    held = []

    def counted(texts: Sequence[str], spec) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        if not held:
            held.append(np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool))
        for run in chunks(texts):
            row, token, tokens = word_tokens(run, spec.stop_words)
            at, slot = pair_slots(row, token, token_hashes(tokens))
            at = at[held[0][slot]]
            width = max(1, len(tokens))
            keys, gram = np.unique(token[at] * width + token[at + 1], return_inverse=True)
            yield pc.binary_join_element_wise(tokens.take(pa.array(keys // width)), tokens.take(pa.array(keys % width)), " "), *_tf_df(row[at], gram, len(keys))

    return counted


def known_counts(texts: Sequence[str], spec, terms: Sequence[str], table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number of texts, then row, index and count of every known term in them, ordered by row and index."""
    size = len(terms)
    for run in chunks(texts):
        rows, found = [], []
        if spec.analyzer == "word":
            row, token, tokens = word_tokens(run, spec.stop_words)
            width = max(1, len(tokens))
            # Numbers of the known terms' tokens here, -1 where a token does not occur.
            here = pc.fill_null(pc.index_in(table[0], tokens), -1).to_numpy()
            gram_of = np.zeros(size, np.int64)
            for n, at, gram, keys in word_levels(row, token, width, spec.max_n):
                last = np.append(here, -1)[table[1][:, n - 1]] if n <= table[1].shape[1] else np.full(size, -1)
                known = np.where((gram_of >= 0) & (last >= 0), gram_of * width + last, -1)
                place = np.minimum(np.searchsorted(keys, known), max(0, len(keys) - 1))
                gram_of = np.where(keys[place] == known, place, -1) if len(keys) else np.full(size, -1)
                if n >= spec.min_n:
                    whole = (table[2] == n) & (gram_of >= 0)
                    index = np.full(len(keys), -1)
                    index[gram_of[whole]] = np.flatnonzero(whole)
                    hit = index[gram] >= 0
                    rows.append(at[hit])
                    found.append(index[gram][hit])
        else:
            row, code = char_codes(run, spec.min_n, spec.max_n)
            bits = len(run).bit_length()
            if _BASE ** spec.max_n << bits < 1 << 63:
                # The known grams' stretches of the sorted numbers: as many searches as terms, not as grams.
                pair = np.sort(code << bits | row)
                low, high = np.searchsorted(pair, table[0] << bits), np.searchsorted(pair, table[0] + 1 << bits)
                known = np.repeat(np.arange(size), high - low)
                rows.append(pair[np.arange(len(known)) + np.repeat(low - np.cumsum(high - low) + high - low, high - low)] & (1 << bits) - 1)
                found.append(table[1][known])
            else:
                place = np.minimum(np.searchsorted(table[0], code), size - 1)
                hit = table[0][place] == code
                rows.append(row[hit])
                found.append(table[1][place[hit]])
        pair, n = np.unique(np.concatenate(rows) * size + np.concatenate(found), return_counts=True)
        yield len(run), pair // size, pair % size, n


def lookup_table(spec, terms: Sequence[str]):
    """Characters: numbers of the terms in order, and their indices. Words: distinct tokens, token numbers per term (-1 past its end), and sizes."""
    if spec.analyzer == "word":
        split = [t.split(" ") for t in terms]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
        width = max(map(len, split))
        parts = np.array([[number[w] for w in ws] + [-1] * (width - len(ws)) for ws in split], np.int64)
        return pa.array(list(number), pa.string()), parts, np.array([len(ws) for ws in split])
    codes = np.array([char_code(t, spec.max_n) for t in terms], np.int64)
    order = np.argsort(codes)
    return codes[order], order


def counts_function(spec, terms: Sequence[str], idf: Sequence[float] | None):
    """An Arrow function: clean texts to ``idx, val`` of the known terms; values are counts or, with ``idf``, L2-normalised weights."""
    held = []

    def run(clean: pa.Array) -> pa.Array:
        if not held:
            held.append((lookup_table(spec, terms), None if idf is None else np.asarray(idf, float)))
        table, scale = held[0]
        sizes, indices, values = [], [], []
        for n_rows, row, idx, n in known_counts([t or "" for t in clean.to_pylist()], spec, terms, table):
            v = n.astype(float)
            if scale is not None:
                v = (np.log(v) + 1) * scale[idx]
                v = v / np.sqrt(np.bincount(row, v * v, n_rows))[row]
            sizes.append(np.bincount(row, minlength=n_rows))
            indices.append(idx)
            values.append(v)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
        offsets = pa.array(ends.astype(np.int32))
        flat = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, flat(indices, np.int32)), pa.ListArray.from_arrays(offsets, flat(values, float))], ["idx", "val"])

    return run


def sorted_char_grams(min_n: int, max_n: int):
    """An Arrow function: clean texts to their character grams in order; null for null."""
    def run(clean: pa.Array) -> pa.Array:
        texts = clean.to_pylist()
        sizes, grams = [], []
        for part in chunks([t or "" for t in texts]):
            row, code = char_codes(part, min_n, max_n)
            pair = np.sort(row * _BASE ** max_n + code)
            sizes.append(np.bincount(row, minlength=len(part)))
            grams.append(char_terms(pair % _BASE ** max_n, max_n))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
        flat = pa.concat_arrays(grams) if grams else pa.array([], pa.string())
        mask = pa.array([t is None for t in texts], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat, mask=mask)

    return run
