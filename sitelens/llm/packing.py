"""Best-fit packing of documents into sequences of bounded length, in bulk-synchronous rounds.

Pieces of equal length are interchangeable, and so are gaps of equal size. So
both sides are kept as runs sorted by size: how many pieces have a length, and
which ranges of sequences have a gap of a size. There are at most as many
lengths as a sequence has tokens, whatever the corpus. A round takes all pieces
of the longest length left, sweeps the gap runs from their successor upwards,
gives the pieces their gaps by rank, puts the shrunken gaps back in order and
opens sequences for the pieces without a gap. That is best fit, longest first.

Spark cuts and counts the pieces, ranks them among those of their length
(local ranks and a prefix sum over partitions, no group in one task) and looks
up where each rank was placed. Only the counts by length reach the driver, and
only the placed runs are sent out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import cut_lineage, plain, table
from sitelens.llm.pieces import pieces, tokenizer_path

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = 0


def cut_documents(
    documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, spaced: bool = False, end: int = END
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, place): pieces, and their rank among those of their length in ``part``."""
    path = tokenizer_path(tokenizer)
    last = np.array([end], "<u4").tobytes()
    schema = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "place")]
        + [("piece", pa.int32()), ("part", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces(path, spaced)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            texts = (t.as_py() for t in b.column("text"))
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode.each(texts)):
                ids = memoryview(ids + last)
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    for column, value in zip(rows, (doc, at // 4, length, zlib.crc32(own), int(seen[length]), n)):
                        column.append(value)
                    seen[length] += 1
            count = len(rows[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip([*rows, [part] * count], schema)], schema=schema
            )

    own = plain(documents, doc_id="long", text="string")
    return own.mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, place long, piece int, part int"
    )


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placed runs (length, first rank, count, first sequence, offset) and the number of sequences.

    ``counts`` is how many pieces have each length. The rounds go from the
    longest length down; gap runs are ranges of sequences, by size.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: ranges (first sequence, count)
    sizes: list[int] = []  # those with gaps, ascending
    placed: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):  # none fits: open as many sequences as the rest needs
                fit = capacity // length
                put(capacity, opened, max(1, left // fit) if left >= fit else 1)
                opened += max(1, left // fit) if left >= fit else 1
                continue
            size = sizes[at]
            first, count = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], sizes[at]
            # A gap that takes several of this length takes them at once, as it stays the best fit.
            fit = size // length
            whole = min(count, left // fit)
            for n in range(fit) if whole else ():
                placed.append((length, rank + n * whole, whole, first, capacity - size + n * length))
            rank, left = rank + fit * whole, left - fit * whole
            put(size - fit * length, first, whole)
            if count > whole and left:  # fewer than one gap takes
                take = min(left, fit)
                for n in range(take):
                    placed.append((length, rank + n, 1, first + whole, capacity - size + n * length))
                rank, left, whole = rank + take, left - take, whole + 1
                put(size - take * length, first + whole - 1, 1)
            put(size, first + whole, count - whole)
    return placed, opened


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``cut_documents`` with their sequence_id and offset there."""
    spark = cut.sparkSession
    cut = cut_lineage(cut)  # read by the counts and by the placing; ranks must not change between
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most ``capacity`` rows.
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_fit(total, capacity)
    plan = np.array(sorted(runs), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = (plan[:, 0] << 48) + plan[:, 1]
        for b in batches:
            length, place, base = (b.column(n).to_numpy() for n in ("length", "place", "base"))
            at = np.searchsorted(keys, (length << 48) + place + base, "right") - 1
            columns = {n: b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns["sequence_id"] = pa.array(plan[at, 3] + place + base - plan[at, 1])
            columns["offset"] = pa.array(plan[at, 4])
            yield pa.RecordBatch.from_pydict(columns)

    ranked = cut.join(bases, ["part", "length"])
    return ranked.mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def pack_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens.

    A null or empty text is its end token alone; repeated documents are packed
    each by itself; a null doc_id stays null; longer documents are cut into
    full pieces and a rest. An empty table gives no rows.
    """
    return pack(cut_documents(documents, capacity=capacity), capacity)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
