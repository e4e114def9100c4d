"""Words of many documents as numpy arrays: bounds, 64-bit hashes, hashes of word sequences.

A hash of a byte or word sequence is a difference of prefix sums of value * BASE**position,
divided by BASE**start, modulo 2**64: equal sequences have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BYTE_BASE, WORD_BASE = U(0x9E3779B97F4A7C15 | 1), U(0xD1342543DE82EF95)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Words of `[^\x20\x09-\x0D]+`.
PLAIN = ~byte_set(b" \t\n\x0b\x0c\r")
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = byte_set(b"0123456789abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all 64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n; kept and grown by doubling."""
    key = int(base)
    if key not in _tables or len(_tables[key][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(size, base, U), np.full(size, U(pow(key, -1, 1 << 64)), U)
        up[0] = down[0] = 1
        _tables[key] = np.cumprod(up), np.cumprod(down)
    return _tables[key]


class Sequence:
    """Prefix sums over values; spans() gives a hash for each [start, end)."""

    def __init__(self, values: np.ndarray, base: np.uint64):
        n = len(values)
        up, self.down = powers(base, n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


class Words:
    """Words of the documents in one chunk of bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = PLAIN, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = is_word[self.data]
        n = len(inside)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.inside = inside
        self.starts = np.flatnonzero(inside & (~before | cut[:n]))
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each document's words, and one past the last
        self.n_words = np.diff(self.first)
        self._bytes: Sequence | None = None

    def byte_seq(self) -> Sequence:
        if self._bytes is None:
            self._bytes = Sequence(BYTE_VALUE[self.data], BYTE_BASE)
        return self._bytes

    def hashes(self) -> np.ndarray:
        return self.byte_seq().spans(self.starts, self.ends)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    def window_starts(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of `size` words inside one document, and their documents."""
        count = np.maximum(self.n_words - size + 1, 0)
        doc = np.repeat(np.arange(len(count)), count)
        base = np.cumsum(count) - count
        return np.arange(len(doc)) - base[doc] + self.first[:-1][doc], doc

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a flag per byte, for each document."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def per_doc_words(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per word, for each document."""
        sums = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]


def covered(n: int, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in any of the spans [start, start + size)."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + size, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document and count of words of every line (split at \\n)."""
    nl = np.flatnonzero(words.data == 10)
    start = np.sort(np.concatenate([words.offsets[:-1], nl + 1]))
    end = np.sort(np.concatenate([nl, words.offsets[1:]]))
    count = np.bincount(np.searchsorted(words.offsets, nl, side="right") - 1, minlength=len(words.n_words)) + 1
    doc = np.repeat(np.arange(len(count)), count)
    return start, end, doc, np.searchsorted(words.starts, end) - np.searchsorted(words.starts, start)
