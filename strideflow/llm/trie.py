"""A two-level n-gram trie in Elias-Fano form, kept in memory-mapped files.

Level one holds the contexts, level two the words that follow them, each with a quantised value. All three integer
sequences (contexts, pointers from a context to its followers, followers) are monotone and stored as Elias-Fano: the low
bits of each number packed, the high bits as unary gaps. The followers of a context are made monotone by adding, from
context to context, the last number before its range; a query for (context, word) is a successor search relative to
that base within the range. All operations work on arrays of queries.
"""

from __future__ import annotations

import os

import numpy as np

ONE = np.uint64(1)
U6, U63 = np.uint64(6), np.uint64(63)


def _save(folder: str, name: str, values: np.ndarray) -> np.ndarray:
    """Written to a file and mapped, so that only the pages in use take memory."""
    path = os.path.join(folder, name)
    values.tofile(path)
    return np.memmap(path, values.dtype, "r", shape=values.shape) if values.size else values


def _pack_low(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits of each number, one after the other in 64-bit words."""
    n = len(values)
    words = np.zeros(n * bits // 64 + 2, np.uint64)
    if bits and n:
        low = values & np.uint64((1 << bits) - 1)
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> U6).astype(np.int64), at & U63
        np.bitwise_or.at(words, word, low << shift)
        over = shift + np.uint64(bits) > np.uint64(64)
        np.bitwise_or.at(words, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
    return words


class EliasFano:
    """A non-decreasing sequence of unsigned integers."""

    def __init__(self, values: np.ndarray, folder: str, name: str):
        values = values.astype(np.uint64)
        self.n = n = len(values)
        top = int(values[-1]) if n else 0
        self.bits = max(0, (top // max(1, n)).bit_length() - 1) if n else 0
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        self.buckets = int(high[-1]) + 1 if n else 1
        ones = high + np.arange(n)
        flags = np.zeros(((n + self.buckets) // 64 + 1) * 64, np.uint8)
        flags[ones] = 1
        upper = np.packbits(flags, bitorder="little").view("<u8")
        self.low = _save(folder, name + ".low", _pack_low(values, self.bits))
        self.upper = _save(folder, name + ".high", upper)
        self.ones_before = _save(folder, name + ".ones", np.concatenate(([0], np.cumsum(np.bitwise_count(upper), dtype=np.int64))))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> U6).astype(np.int64), at & U63
        # a shift by 64 is avoided by shifting twice
        value = self.low[word] >> shift | (self.low[word + 1] << (U63 - shift)) << ONE
        return value & np.uint64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the ``k``-th (from zero) set or unset bit of the upper part."""
        before = self.ones_before if ones else np.arange(len(self.ones_before)) * 64 - self.ones_before
        word = np.searchsorted(before, k, side="right") - 1
        bits = self.upper[word] if ones else ~self.upper[word]
        left = k - before[word]
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = (bits >> place.astype(np.uint64)) & np.uint64((1 << width) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            skip = left >= count
            left -= np.where(skip, count, 0)
            place += np.where(skip, width, 0)
        return word * 64 + place

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return high << np.uint64(self.bits) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element not below each ``x`` (``n`` if there is none), and whether it equals ``x``.

        The bucket of ``x`` lies between two unset bits; a binary search over the low bits of its elements, as a
        context with very many followers fills whole buckets.
        """
        out, equal = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        bucket = (x >> np.uint64(self.bits)).astype(np.int64)
        ask = np.flatnonzero(bucket < self.buckets)
        if not self.n or not len(ask):
            return out, equal
        h = bucket[ask]
        first = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1 - h, 0)
        last = self._select(h, False) - h
        low = x[ask] & np.uint64((1 << self.bits) - 1)
        lo, hi = first, last.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            below = self._low(middle) < low[open_]
            lo[open_] = np.where(below, middle + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], middle)
            open_ = open_[lo[open_] < hi[open_]]
        there = np.flatnonzero(lo < last)
        equal[ask[there]] = self._low(lo[there]) == low[there]
        out[ask] = lo
        return out, equal


class Quantiser:
    """Values as one byte: bins of equal width, each read back as the mean of its values."""

    def __init__(self, values: np.ndarray, bins: int = 256):
        if not len(values):
            self.cuts, self.means = np.zeros(0), np.zeros(1)
            return
        self.cuts = np.linspace(values.min(), values.max(), bins + 1)[1:-1]
        code = self.code(values).astype(np.int64)
        sums = np.bincount(code, weights=values, minlength=len(self.cuts) + 1)
        self.means = sums / np.maximum(1, np.bincount(code, minlength=len(self.cuts) + 1))

    def code(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, values, side="right").astype(np.uint8)


class NgramTrie:
    """Built from sorted unique ``(context, word)`` pairs and a value for each; lives in ``folder``."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray, values: np.ndarray, folder: str):
        first = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1]))) if len(contexts) else np.zeros(0, np.int64)
        pointers = np.append(first, len(contexts))
        self.contexts = EliasFano(contexts[first], folder, "contexts")
        self.pointers = EliasFano(pointers, folder, "pointers")
        base = np.zeros(len(first), np.uint64)
        if len(first) > 1:
            base[1:] = np.cumsum(words[pointers[1:-1] - 1].astype(np.uint64) + ONE)
        self.words = EliasFano(np.repeat(base, np.diff(pointers)) + words, folder, "words")
        self.quantiser = Quantiser(values)
        self.codes = _save(folder, "values", self.quantiser.code(values))

    def find(self, contexts: np.ndarray, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Value of each pair, nan if it is not stored. Context ``i`` is asked for the next ``counts[i]`` words."""
        out = np.full(len(words), np.nan)
        if not self.words.n or not len(words):
            return out
        at, known = self.contexts.successor(contexts)
        at = np.where(known, at, 0)
        start, stop = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        base = np.where(start > 0, self.words.get(np.maximum(start - 1, 0)) + ONE, np.uint64(0))
        ask = np.flatnonzero(np.repeat(known, counts))
        target = np.repeat(base, counts)[ask] + words[ask]
        place, equal = self.words.successor(target)
        hit = np.flatnonzero(equal & (place < np.repeat(stop, counts)[ask]))
        out[ask[hit]] = self.quantiser.means[self.codes[place[hit]]]
        return out
