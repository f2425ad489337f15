"""Vectorised words over Arrow text: the numpy half that the text operators share.

A slice of texts is handled as one byte buffer. Word borders come from a 256-entry
byte class table, word hashes from prefix sums of a polynomial, and hashes of runs
of words from prefix sums over the word hashes, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19


def _byte_class(accepts) -> np.ndarray:
    return np.array([bool(accepts(b)) for b in range(256)])


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = _byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
ALNUM = _byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z, all other bytes as they are
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base % 2**64, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _spans(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span, independent of its place."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=sums[1:])
    return (sums[end] - sums[start]) * _power(pow(base, -1, 2**64), len(values) + 1)[start]


class Words(NamedTuple):
    """Words of several texts: byte spans into ``data``; text i has words doc[i] to doc[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word."""
        h = _spans(_BYTE_VALUE[self.data], _BYTE_BASE, self.start, self.end)
        return mixed(h + (self.end - self.start).astype(np.uint64))

    def text_of(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(len(self.doc) - 1), np.diff(self.doc))


def run_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the run of words first..last-1 for each pair."""
    return mixed(_spans(h, _WORD_BASE, first, last) + (last - first).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) and the texts' offsets in them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def split_words(column: pa.Array, accepts: np.ndarray, lower: bool = False) -> Words:
    """All words of a column of texts."""
    data, at = utf8(column)
    if lower:
        data = LOWER[data]
    inside = accepts[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, start, end, np.searchsorted(start, at))


def portions(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose rows' sizes add up to about ``most``; a larger row is a slice of its own."""
    total, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        done = total[begin - 1] if begin else 0
        until = max(begin + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(begin, until - begin)
        begin = until


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` text bytes; a longer text is a slice of its own."""
    for batch in batches:
        yield from portions(batch, pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), most)


def stretches(column: pa.Array, accepts: np.ndarray, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """The texts as (first row, byte of that row, texts): short texts together, a long one in stretches of about ``most`` bytes.

    A stretch ends behind a byte that is in no word, so no word is cut (a longer word makes a longer stretch).
    """
    data, at = utf8(column)
    inside = accepts[LOWER] if lower else accepts
    begin = 0

    def texts(first: int, last: int) -> pa.Array:
        return pa.LargeStringArray.from_buffers(last - first, pa.py_buffer(at[first : last + 1] - at[first]), pa.py_buffer(data[at[first] : at[last]]))

    for long in np.flatnonzero(np.diff(at) > 4 * most).tolist():
        if begin < long:
            yield begin, 0, texts(begin, long)
        begin, here, end = long + 1, int(at[long]), int(at[long + 1])
        while here < end:
            until = min(here + most, end)
            if until < end:
                border = np.flatnonzero(~inside[data[here:until]])
                if len(border):
                    until = here + int(border[-1]) + 1
                else:
                    while until < end and inside[data[until]]:
                        step = ~inside[data[until : until + most]]
                        until = min(until + (int(step.argmax()) + 1 if step.any() else most), end)
            yield long, here - int(at[long]), pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, until - here])), pa.py_buffer(data[here:until]))
            here = until
    if begin < len(column):
        yield begin, 0, texts(begin, len(column))


class Part(NamedTuple):
    """Texts from a row on, all whole, or one row's next stretch; ``led``: behind the end of the stretch before."""

    first: int
    texts: pa.Array
    whole: bool
    led: bool


def overlapping(column: pa.Array, accepts: np.ndarray, tail: Callable[[pa.Array], bytes], lower: bool = False, most: int = SLICE_BYTES) -> Iterator[Part]:
    """The texts as ``stretches`` gives them, each later one of a long text behind a space and ``tail`` of the one before, so that runs across a cut are seen."""
    size, kept = np.diff(utf8(column)[1]), b""
    for first, skipped, texts in stretches(column, accepts, lower, most):
        if len(texts) != 1 or (not skipped and len(utf8(texts)[0]) == size[first]):
            yield Part(first, texts, True, False)
            continue
        kept = kept if skipped else b""
        if kept:
            texts = pa.array([kept + b" " + utf8(texts)[0].tobytes()], pa.large_binary()).cast(pa.large_string())
        yield Part(first, texts, False, bool(kept))
        kept = tail(texts)


def last_words(n: int, accepts: np.ndarray, lower: bool = False) -> Callable[[pa.Array], bytes]:
    """The last n words of one text, joined by spaces."""

    def tail(texts: pa.Array) -> bytes:
        w = split_words(texts, accepts, lower)
        return b" ".join(w.data[a:e].tobytes() for a, e in zip(w.start[-n:].tolist(), w.end[-n:].tolist(), strict=True))

    return tail


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Arrow strings from byte spans that don't overlap and ascend."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    where = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[where]))


def joined_words(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of all texts, each followed by one space, and where each begins and ends there."""
    size = w.end - w.start
    begin = np.cumsum(size + 1) - (size + 1)
    data = np.full(int((size + 1).sum()), 0x20, np.uint8)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    data[np.repeat(begin, size) + inside] = w.data[np.repeat(w.start, size) + inside]
    return data, begin, begin + size
