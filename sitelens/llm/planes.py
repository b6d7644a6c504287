"""Unsigned numbers as planes of bytes, each compressed where that makes it shorter."""

from __future__ import annotations

from functools import cache

import numpy as np
import zstandard

from sitelens.llm.jaccard import opened48, packed48


@cache
def coders() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()


def shrunk(numbers: np.ndarray, rising: bool = False) -> bytes:
    """Count, number of planes, their sizes, planes from the lowest; ``rising`` numbers by their steps, modulo 2**64."""
    n = numbers.astype("<u8")
    if rising:
        n = np.diff(n, prepend=np.uint64(0))
    used = (int(n.max()).bit_length() + 7) // 8 if len(n) else 0
    planes = []
    for plane in n.view(np.uint8).reshape(-1, 8).T[:used]:
        raw = plane.tobytes()
        small = coders()[0].compress(raw)
        planes.append(small if len(small) < len(raw) else raw)
    return np.array([len(n), used, *map(len, planes)], "<u4").tobytes() + b"".join(planes)


def grown(data: bytes, rising: bool = False, kind: str = "<u8") -> np.ndarray:
    n, used = np.frombuffer(data, "<u4", 2).tolist()
    sizes = np.frombuffer(data, "<u4", used, 8).tolist()
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    at = 8 + 4 * used
    for i, size in enumerate(sizes):
        plane = data[at : at + size]
        out[:, i] = np.frombuffer(plane if size == n else coders()[1].decompress(plane), np.uint8)
        at += size
    numbers = out.reshape(-1).view(kind)
    return np.cumsum(numbers, dtype=kind) if rising else numbers


def by_frequency(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below ``size``, commonest first, and the rank of each in that order."""
    order = np.argsort(-np.bincount(numbers, minlength=size), kind="stable")
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    return order, rank


def shrunk_keys(keys: np.ndarray) -> bytes:
    """Keys of 48 bits; where they come twice or more on average, the distinct ones and the rank of each key."""
    distinct, number = np.unique(keys, return_inverse=True)
    if 2 * len(distinct) > len(keys):
        return b"\0\0\0\0" + packed48(keys)
    order, rank = by_frequency(number, len(distinct))
    table = shrunk(distinct[order], rising=True)
    return np.array([len(table)], "<u4").tobytes() + table + shrunk(rank[number])


def grown_keys(data: bytes) -> np.ndarray:
    size = int(np.frombuffer(data, "<u4", 1)[0])
    if not size:
        return opened48(data[4:])
    return grown(data[4 : 4 + size], rising=True)[grown(data[4 + size :], kind="<u4")]
