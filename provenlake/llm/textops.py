"""Words and shingles of whole batches of texts at once, as 64-bit hashes, on UTF-8 bytes.

Lower-casing touches A-Z only and all separators are ASCII, so bytes and code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Fixed values of the finalizer (a bijection of 64-bit integers) and of the polynomials.
GAMMA, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
BASE = 0xD6E8FEB86659FD93
#: Bytes of text that are hashed at a time; a single longer text is taken whole.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(GAMMA)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def _byte_table(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    value = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
    value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    inside = np.ones(256, bool)
    inside[np.frombuffer(separators, np.uint8)] = False
    return value, inside


#: Separators of words [^\x20\x09-\x0D]+ and of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing).
BLANK = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = bytes(x for x in range(0x80) if not (0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or 0x41 <= x <= 0x5A))

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """The words of some texts: hash, the text each stands in, and where each text's words begin."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw: np.ndarray
    text_starts: np.ndarray

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.offsets[k] : self.offsets[k + 1]]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(texts: pa.Array, separators: bytes) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for runs of texts of about PIECE bytes."""
    value, inside = _byte_table(separators)
    raw, offsets = buffers(texts)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, _words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], value, inside)
        lo = hi


def _words(raw: np.ndarray, bounds: np.ndarray, value: np.ndarray, inside: np.ndarray) -> Words:
    size = len(raw)
    is_word = inside[raw]
    first = np.zeros(size + 1, bool)
    first[bounds] = True  # a text's first byte never goes on with the last one's word
    before = np.zeros(size, bool)
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | first[:-1]))
    after = np.zeros(size, bool)
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | first[1:])) + 1
    power, inverse = _power_tables(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(value[raw] * power[:size], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    return Words(hashes, np.searchsorted(starts, bounds), starts, ends, raw, bounds)


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles, sorted; of fewer words, the whole sequence as one."""
    h = words.hashes
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        rolled = rolled * np.uint64(BASE) + h[j : j + len(rolled)]
    rolled = mix(rolled)
    for lo, hi in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
        if hi - lo >= k:
            yield np.unique(rolled[lo : hi - k + 1])
        elif hi > lo:
            one = np.full(1, hi - lo, np.uint64)
            for j in range(lo, hi):
                one = one * np.uint64(BASE) + h[j : j + 1]
            yield mix(one)
        else:
            yield np.zeros(0, np.uint64)
