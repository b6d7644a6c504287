"""Words and word shingles of many texts at once, as 64-bit hashes, in numpy over Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed odd multipliers: one for the bytes of a word, one for each place in a shingle.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
TABLE[65:91] = TABLE[97:123]  # A-Z count as a-z
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
CHUNK = 1 << 20

with np.errstate(over="ignore"):
    POWERS = np.multiply.accumulate(np.full(CHUNK + 1, BASE, np.uint64)) * pow(int(BASE), -1, 1 << 64)
    BACK = np.multiply.accumulate(np.full(CHUNK + 1, pow(int(BASE), -1, 1 << 64), np.uint64)) * BASE


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def hashed_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one behind the other and end at ``ends``; number of words up to each end."""
    word = IS_WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = ends[:-1][ends[:-1] < len(data)]
    first[starts] = word[starts]  # a text's first word is not joined to the text before
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(data) <= CHUNK:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(TABLE[data] * POWERS[: len(data)], dtype=np.uint64)])
        words = (sums[b] - sums[a]) * BACK[a]
    else:  # a long text: the powers begin anew with every word
        words = np.empty(len(a), np.uint64)
        for i in range(0, len(a), 1 << 16):
            lo, hi = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            length = hi - lo
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            terms = TABLE[data[np.repeat(lo, length) + place]] * powers(place)
            words[i : i + (1 << 16)] = np.add.reduceat(terms, np.cumsum(length) - length)
    return mixed(words + (b - a).astype(np.uint64) * MIX[0]), np.searchsorted(a, ends, "left")


def powers(place: np.ndarray) -> np.ndarray:
    high = place // CHUNK
    leaps = np.array([pow(int(BASE), int(i) * CHUNK, 1 << 64) for i in range(int(high.max(initial=0)) + 1)], np.uint64)
    return POWERS[place % CHUNK] * leaps[high]


def texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends): the rows of a string column in chunks of about CHUNK bytes; a null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row + 1 : end + 1] - offsets[row]
        row = end


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, counts up to the end of each text)."""
    with np.errstate(over="ignore"):
        for row, data, ends in texts(column):
            words, upto = hashed_words(data, ends) if len(data) else (np.zeros(0, np.uint64), np.zeros(len(ends), np.int64))
            yield row, words, upto


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``size`` words as sorted hashes; fewer words are one shingle, none none."""
    weights = [np.uint64(pow(int(BASE), i + 1, 1 << 64)) for i in range(size)]
    with np.errstate(over="ignore"):
        for _, words, upto in word_hashes(column):
            whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
            for i, w in enumerate(weights):
                whole += words[i : i + len(whole)] * w
            whole = mixed(whole)
            start = 0
            for end in upto.tolist():
                if end - start >= size:
                    yield np.unique(whole[start : end - size + 1])
                elif end > start:
                    own = sum((words[start + i] * weights[i] for i in range(end - start)), np.uint64(end - start))
                    yield mixed(np.array([own], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)
                start = end
