"""A compact n-gram trie: Elias-Fano levels with quantised values.

Words are 64-bit hashes. The vocabulary is the sorted sequence of hashes, a
word's id its rank. Each further level lists the successors of each node of
the level before it, sorted, as word ids; pointers give where a node's
successors begin. Both are monotone: pointers as they are, successors after
adding the last sum of the node before (so ids are relative to their context).
Monotone sequences are kept in Elias-Fano form; an n-gram is found by a
successor search for its word, shifted to its context, in the sequence.
"""

from __future__ import annotations

import struct

import numpy as np

#: Values are kept as 16-bit codes of their logarithm down to 10 ** -RANGE; code 0 is "no value".
RANGE = 12.0
STEPS = (1 << 16) - 2
_POPULATION = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)
_SELECT = np.array([[[i for i in range(8) if b >> i & 1][r] if r < bin(b).count("1") else 0 for r in range(8)] for b in range(256)],
                   dtype=np.int64)


def quantised(values: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(values), dtype=np.uint16)
    some = values > 0
    scaled = (np.log10(values[some]) + RANGE) / RANGE
    codes[some] = 1 + np.rint(np.clip(scaled, 0, 1) * STEPS).astype(np.uint16)
    return codes


def restored(codes: np.ndarray) -> np.ndarray:
    exponent = (codes.astype(np.float64) - 1) / STEPS * RANGE - RANGE
    return np.where(codes > 0, 10.0 ** exponent, 0.0)


class EliasFano:
    """A monotone sequence of 64-bit numbers. Each number's low bits stand
    packed in words; its high bits are the number of zeros before its one in a
    bit sequence, whose ones are found by a directory of counts."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self.before = np.concatenate(([0], np.cumsum(_POPULATION[high].reshape(-1, 8).sum(axis=1))))

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        shift = np.uint64(bits)
        low = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
        if bits:
            part = values & ((np.uint64(1) << shift) - np.uint64(1))
            at = np.arange(n, dtype=np.int64) * bits
            word, offset = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << offset)
            over = offset + shift > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - offset[over]))
        ones = (values >> shift).astype(np.int64) + np.arange(n)
        size = (int(ones[-1]) if n else 0) + 1
        flags = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
        flags[ones] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little"))

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the places ``i``."""
        i = np.asarray(i, dtype=np.int64)
        word = np.searchsorted(self.before, i, side="right") - 1
        rest = i - self.before[word]
        byte = word * 8
        for _ in range(7):
            count = _POPULATION[self.high[byte]]
            go = rest >= count
            rest = np.where(go, rest - count, rest)
            byte = byte + go
            if not go.any():
                break
        high = byte * 8 + _SELECT[self.high[byte], rest] - i
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.bits
        word, offset = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> offset
        more = np.where(offset > 0, self.low[word + 1] << ((np.uint64(64) - offset) & np.uint64(63)), np.uint64(0))
        return (value | more) & ((np.uint64(1) << np.uint64(self.bits)) - np.uint64(1))

    def all(self) -> np.ndarray:
        """All numbers, for many searches at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        i = np.arange(self.n)
        return ((ones - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first number that is at least ``x``, by halving."""
        low, high = np.zeros(len(x), dtype=np.int64), np.full(len(x), self.n, dtype=np.int64)
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            less = open_ & (self.get(np.minimum(middle, self.n - 1)) < x)
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return low

    def to_bytes(self) -> bytes:
        return struct.pack("<4q", self.n, self.bits, len(self.low), len(self.high)) + self.low.astype("<u8").tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, bits, n_low, n_high = struct.unpack_from("<4q", data[at:at + 32].tobytes())
        at += 32
        low = data[at:at + 8 * n_low].view("<u8")
        high = data[at + 8 * n_low:at + 8 * n_low + n_high]
        return cls(n, bits, low, high), at + 8 * n_low + n_high


class Trie:
    """Bigrams over hashed words; ``weights`` has a value for each context,
    ``values`` one for each bigram."""

    def __init__(self, words: EliasFano, pointers: EliasFano, successors: EliasFano, weights: np.ndarray, values: np.ndarray):
        self.words, self.pointers, self.successors = words, pointers, successors
        self.weights, self.values = weights, values
        self._plain: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, value: np.ndarray,
           contexts: np.ndarray, weight: np.ndarray) -> Trie:
        """From distinct bigrams of hashes with their values, and the contexts
        (any order) with their weights."""
        vocabulary = np.unique(np.concatenate((context, word, contexts)))
        c, w = np.searchsorted(vocabulary, context), np.searchsorted(vocabulary, word)
        order = np.lexsort((w, c))
        c, w = c[order], w[order]
        counts = np.bincount(c, minlength=len(vocabulary))
        ends = np.cumsum(counts)
        last = np.zeros(len(vocabulary), dtype=np.int64)  # the largest successor of each node
        last[c] = w  # in order: the last one stays
        base = np.concatenate(([0], np.cumsum(np.where(counts > 0, last + 1, 0))[:-1]))
        weights = np.zeros(len(vocabulary), dtype=np.uint16)
        weights[np.searchsorted(vocabulary, contexts)] = quantised(weight)
        return cls(EliasFano.of(vocabulary), EliasFano.of(np.concatenate(([0], ends))), EliasFano.of(w + base[c]), weights,
                   quantised(value[order]))

    def to_bytes(self) -> bytes:
        """For a file; levels can be used where they lie (see :meth:`at`)."""
        parts = []
        for p in (self.words.to_bytes(), self.pointers.to_bytes(), self.successors.to_bytes(),
                  struct.pack("<q", len(self.weights)) + self.weights.astype("<u2").tobytes(),
                  struct.pack("<q", len(self.values)) + self.values.astype("<u2").tobytes()):
            parts.append(p + b"\0" * (-len(p) % 8))
        return b"".join(parts)

    @classmethod
    def at(cls, data: np.ndarray) -> Trie:
        """The trie in a buffer, or a file mapped by ``np.memmap``."""
        at, levels = 0, []
        for _ in range(3):
            level, at = EliasFano.read(data, at)
            at += -at % 8
            levels.append(level)
        codes = []
        for _ in range(2):
            n = struct.unpack("<q", data[at:at + 8].tobytes())[0]
            codes.append(data[at + 8:at + 8 + 2 * n].view("<u2"))
            at += 8 + 2 * n
            at += -at % 8
        return cls(*levels, *codes)

    def _levels(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._plain is None:
            self._plain = self.words.all(), self.pointers.all().astype(np.int64), self.successors.all()
        return self._plain

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of words, -1 for unknown ones."""
        words = self._levels()[0]
        if not len(words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
        return np.where(words[at] == hashes, at, -1)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(value codes, weight codes)`` of bigrams; a code is 0 if there is
        none."""
        _, pointers, sums = self._levels()
        c, w = self.ids(context), self.ids(word)
        known = (c >= 0) & (w >= 0)
        begin, end = pointers[np.maximum(c, 0)], pointers[np.maximum(c, 0) + 1]
        # the sum that the node's first successor was added to
        base = np.where(begin > 0, sums[np.maximum(begin - 1, 0)] + np.uint64(1), np.uint64(0)) if len(sums) else np.zeros(len(c), np.uint64)
        wanted = base + np.maximum(w, 0).astype(np.uint64)
        at = np.searchsorted(sums, wanted)
        hit = known & (at < end)
        hit[hit] = sums[at[hit]] == wanted[hit]
        values = np.zeros(len(c), dtype=np.uint16)
        values[hit] = self.values[at[hit]]
        return values, np.where(c >= 0, self.weights[np.maximum(c, 0)], 0).astype(np.uint16)
