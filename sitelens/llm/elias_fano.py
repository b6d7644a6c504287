"""Monotone sequences in Elias-Fano form, and a two-level n-gram trie made of them, in one mapped buffer."""

from __future__ import annotations

import mmap

import numpy as np


class Mapped:
    """Arrays one behind the other in a mapped region (anonymous, so nothing is left behind)."""

    def __init__(self, size: int):
        self.region = mmap.mmap(-1, max(1, size))
        self.at = 0

    def put(self, array: np.ndarray) -> np.ndarray:
        data = np.frombuffer(self.region, array.dtype, array.size, self.at)
        data[:] = array
        self.at += -(-array.nbytes // 8) * 8
        return data


class EliasFano:
    """A non-decreasing sequence: upper bits in unary in a bitmap, lower bits in planes of bytes."""

    def __init__(self, values: np.ndarray, store: Mapped):
        values = values.astype(np.uint64)
        self.n = len(values)
        most = int(values[-1]) if self.n else 0
        self.planes = -(-max(0, (most // max(1, self.n)).bit_length() - 1) // 8)
        upper = (values >> np.uint64(8 * self.planes)).astype(np.int64)
        bits = np.zeros(int(upper[-1]) + self.n if self.n else 0, np.uint8)
        bits[upper + np.arange(self.n)] = 1
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(-(-len(packed) // 8) * 8, np.uint8)
        words[: len(packed)] = packed
        self.bits = store.put(words.view(np.uint64))
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = store.put(np.concatenate([[0], np.cumsum(ones)]))
        self.lower = [
            store.put(((values >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8)) for i in range(self.planes)
        ]

    @staticmethod
    def room(n: int) -> int:
        """Bytes that a sequence of n values of up to 64 bits takes at most."""
        return 12 * n + 1024

    def decode(self, lo: int, hi: int) -> np.ndarray:
        """Values at the places lo..hi-1."""
        if hi <= lo:
            return np.zeros(0, np.uint64)
        a = int(np.searchsorted(self.before, lo, "right")) - 1
        b = int(np.searchsorted(self.before, hi, "left"))
        ones = np.flatnonzero(np.unpackbits(self.bits[a:b].view(np.uint8), bitorder="little"))
        skip = lo - int(self.before[a])
        upper = ones[skip : skip + hi - lo] + 64 * a - np.arange(lo, hi)
        out = upper.astype(np.uint64) << np.uint64(8 * self.planes)
        for i, plane in enumerate(self.lower):
            out |= plane[lo:hi].astype(np.uint64) << np.uint64(8 * i)
        return out


class Trie:
    """Contexts, under each the words seen after it, and a byte for each pair.

    Words have numbers in the order of their hashes. A context's successors are
    their numbers added to the last value of the context before, so the whole
    level is one increasing sequence.
    """

    def __init__(self, contexts: np.ndarray, words: np.ndarray, codes: np.ndarray):
        """Distinct pairs in ascending order of (context, word)."""
        first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(contexts) else np.zeros(0, int)
        vocabulary, number = np.unique(words, return_inverse=True)
        ends = np.append(first[1:], len(contexts)) if len(first) else first
        last = number[ends - 1] + 1 if len(first) else np.zeros(0, np.int64)
        base = np.cumsum(last) - last
        store = Mapped(
            EliasFano.room(len(first)) * 2 + EliasFano.room(len(vocabulary)) + EliasFano.room(len(contexts)) + len(codes) + 4096
        )
        self.contexts = EliasFano(contexts[first], store)
        self.pointers = EliasFano(np.append(first, len(contexts)), store)
        self.vocabulary = EliasFano(vocabulary, store)
        self.successors = EliasFano(np.repeat(base, ends - first) + number + 1, store)
        self.codes = store.put(codes)

    def find(self, contexts: np.ndarray, words: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
        """Bytes of the pairs, asked in ascending order of (context, word); 0 for a pair that is not there."""
        out = np.zeros(len(contexts), np.uint8)
        if not self.contexts.n:
            return out
        known = self.contexts.decode(0, self.contexts.n)
        pointers = self.pointers.decode(0, self.pointers.n).astype(np.int64)
        vocabulary = self.vocabulary.decode(0, self.vocabulary.n)
        for at in range(0, len(contexts), at_once):
            c, w = contexts[at : at + at_once], words[at : at + at_once]
            i = np.minimum(np.searchsorted(known, c), len(known) - 1)
            j = np.minimum(np.searchsorted(vocabulary, w), len(vocabulary) - 1)
            ask = np.flatnonzero((known[i] == c) & (vocabulary[j] == w))
            if not len(ask):
                continue
            lo, hi = pointers[i[ask]], pointers[i[ask] + 1]
            start = max(0, int(lo[0]) - 1)  # one before, which the first range is relative to
            values = self.successors.decode(start, int(hi[-1]))
            base = np.where(lo > 0, values[np.maximum(lo - 1 - start, 0)], np.uint64(0))
            wanted = base + j[ask].astype(np.uint64) + np.uint64(1)
            place = np.searchsorted(values, wanted) + start
            good = (place < hi) & (values[np.minimum(place - start, len(values) - 1)] == wanted)
            out[at + ask[good]] = self.codes[place[good]]
        return out
