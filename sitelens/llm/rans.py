"""Static range asymmetric numeral system over blocks of token ids.

One frequency table, summing to 2**BITS, serves all blocks. The ids of a block
lie in rows of ``lanes``; each lane is a coder of its own, so a step codes a
whole row. Lanes share one stream of 32-bit words, in the order in which the
decoder wants them. Every ``GAP`` steps the states and the place in the stream
are kept, so parts of a block can be decoded by themselves. A block ends with
the crc32 of all before.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS, LOWEST, GAP = 18, 1 << 31, 64
LANES = 1024
MAGIC = b"TRNS"
HEADER = struct.Struct("<4sHHIQQIIIII")
U64 = np.uint64


class Table:
    """Frequencies of the ids 0..n-1 (0: never met), scaled to a sum of 2**BITS."""

    def __init__(self, frequency: np.ndarray):
        self.frequency = frequency.astype(U64)
        ends = np.cumsum(self.frequency, dtype=U64)
        self.start = ends - self.frequency
        self.symbol = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency)


def scaled(counts: dict[int, int]) -> np.ndarray:
    """Frequencies that sum to 2**BITS; every id met gets one at least."""
    size = max(counts, default=0) + 1
    found = np.zeros(size, np.float64)
    for k, v in counts.items():
        found[k] = v
    total = 1 << BITS
    if len(counts) > total:
        raise ValueError("more distinct ids than the table has places")
    if not counts:
        found[0] = 1
    out = np.where(found > 0, np.maximum(1, np.floor(found / found.sum() * total)), 0).astype(np.int64)
    order = np.argsort(-out, kind="stable")
    spare = total - int(out.sum())
    if spare > 0:
        out[order[0]] += spare
    for i in order:  # ones given to rare ids are taken back from the commonest
        if spare >= 0:
            break
        take = min(-spare, int(out[i]) // 2)
        out[i] -= take
        spare += take
    return out


def encode(ids: np.ndarray, docs: list[int | None], lengths: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    """A block: ids of whole documents, with the documents' numbers and lengths."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    rows = np.zeros(steps * lanes, np.int64)
    rows[:n] = ids
    rows[n:] = ids[0] if n else 0
    rows = rows.reshape(steps, lanes)
    state = np.full(lanes, LOWEST, U64)
    words: list[np.ndarray] = [None] * steps
    points: list[tuple[int, np.ndarray]] = []
    high, shift = U64(63 - BITS), U64(32)
    for t in range(steps - 1, -1, -1):
        f, c = table.frequency[rows[t]], table.start[rows[t]]
        full = state >= (f << high)
        words[t] = state[full].astype(np.uint32)
        state = np.where(full, state >> shift, state)
        whole = state // f
        state = (whole << U64(BITS)) + (state - whole * f) + c
        if t % GAP == 0:
            points.append((t, state))
    points.reverse()
    sizes = np.cumsum([0, *(len(w) for w in words)])
    places = np.array([sizes[t] for t, _ in points], "<u8")
    states = np.concatenate([s for _, s in points]).astype("<u8") if points else np.zeros(0, "<u8")
    stream = np.concatenate(words).astype("<u4") if steps else np.zeros(0, "<u4")
    head = HEADER.pack(MAGIC, 1, BITS, lanes, n, len(stream), len(docs), steps, len(points), GAP, 0)
    body = b"".join(
        (
            head,
            np.array([d is not None for d in docs], np.uint8).tobytes(),
            np.array([d or 0 for d in docs], "<i8").tobytes(),
            np.asarray(lengths, "<u8").tobytes(),
            places.tobytes(),
            states.tobytes(),
            stream.tobytes(),
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A block opened: its documents, and its ids by part."""

    def __init__(self, data: bytes):
        if len(data) < HEADER.size + 4 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block is damaged")
        magic, version, bits, self.lanes, self.n, words, docs, self.steps, points, self.gap, _ = HEADER.unpack_from(data)
        if (magic, version, bits) != (MAGIC, 1, BITS):
            raise ValueError("not a block of this format")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        known = take("u1", docs)
        self.docs = [int(d) if k else None for d, k in zip(take("<i8", docs), known)]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.places = take("<u8", points)
        self.states = take("<u8", points * self.lanes).reshape(points, self.lanes)
        self.stream = take("<u4", words)

    def part(self, number: int, table: Table) -> np.ndarray:
        """Ids from one checkpoint to the next, the last part with its padding."""
        state, at = self.states[number].astype(U64), int(self.places[number])
        first = number * self.gap
        out = np.empty((min(self.gap, self.steps - first), self.lanes), np.uint32)
        low, shift, mask = U64(LOWEST), U64(32), U64((1 << BITS) - 1)
        for t in range(len(out)):
            slot = state & mask
            symbol = table.symbol[slot.astype(np.int64)]
            out[t] = symbol
            state = table.frequency[symbol] * (state >> U64(BITS)) + slot - table.start[symbol]
            need = np.flatnonzero(state < low)
            state[need] = (state[need] << shift) | self.stream[at : at + len(need)].astype(U64)
            at += len(need)
        return out.reshape(-1)

    def ids(self, table: Table) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint32)
        return np.concatenate([self.part(i, table) for i in range(len(self.places))])[: self.n]
