"""Token ids of a corpus in files, ascending by document, and back.

Documents are range-sorted; each task encodes its range and cuts the ids into
blocks of whole documents. Id counts over all blocks (at most one row per
vocabulary entry) make the one table; blocks are then coded and written as
binary rows of a table in the shared folder, so any store that Spark writes to
will do. Reading needs the table and any block: blocks, and the parts of a
block, decode independently.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm import rans
from sitelens.llm.common import plain, shared_folder, table
from sitelens.llm.pieces import pieces, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
END = 2
BLOCK = 1 << 18

RAW = "part int, number int, first long, tokens long, docs array<long>, lengths array<long>, width int, ids binary, met array<int>, times array<long>"
FILE = "part int, number int, first long, tokens long, block binary"


def id_width(path: str) -> int:
    """Bytes that hold any id of the vocabulary."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else 4


def _tokenise(path: str, spaced: bool, end: int, limit: int):
    width = id_width(path)
    last = np.array([end], f"<u{width}").tobytes()
    schema = pa.schema(
        [("part", pa.int32()), ("number", pa.int32()), ("first", pa.int64()), ("tokens", pa.int64())]
        + [(n, pa.list_(pa.int64())) for n in ("docs", "lengths")]
        + [("width", pa.int32()), ("ids", pa.binary()), ("met", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sitelens.llm.common import batch

        encode, part = pieces(path, spaced, width), TaskContext.get().partitionId()
        number = first = size = 0
        docs: list = []
        held: list[bytes] = []
        counts = np.zeros(0, np.int64)

        def block(final: bool):
            nonlocal counts
            data = b"".join(held)
            own = np.bincount(np.frombuffer(data, f"<u{width}"), minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
            met = np.flatnonzero(counts) if final else np.zeros(0, np.int64)
            row = (part, number, first, len(data) // width, docs, [len(h) // width for h in held], width, data)
            return batch([(*row, met, counts[met])], schema)

        for b in batches:
            texts = (t.as_py() for t in b.column("text"))
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode.each(texts)):
                ids += last
                if held and size + len(ids) // width > limit:
                    yield block(False)
                    number, first, size = number + 1, first + size, 0
                    docs, held = [], []
                docs.append(doc)
                held.append(ids)
                size += len(ids) // width
        if held:
            yield block(True)

    return run


def _encode(shared):
    schema = pa.schema(
        [("part", pa.int32()), ("number", pa.int32()), ("first", pa.int64()), ("tokens", pa.int64()), ("block", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sitelens.llm.common import batch

        codes = rans.Table(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                part, number, first, tokens, docs, lengths, width, ids = (b.column(c)[i].as_py() for c in range(8))
                own = np.frombuffer(ids, f"<u{width}").astype(np.int64)
                data = rans.encode(own, docs, np.array(lengths, np.int64), codes)
                yield batch([(part, number, first, tokens, data)], schema)

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = rans.Table(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                opened = rans.Block(b.column("block")[i].as_py())
                ids = memoryview(opened.ids(codes).astype("<u4").tobytes())
                ends = np.cumsum(opened.lengths)
                starts = ends - opened.lengths
                crc = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([b.column("part")[i].as_py()] * len(crc), pa.int32()),
                        "doc_id": pa.array(opened.docs, pa.int64()),
                        "start": pa.array(starts + b.column("first")[i].as_py(), pa.int64()),
                        "n_tokens": pa.array(opened.lengths, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    return run


def write_tokens(
    documents: DataFrame,
    folder: str,
    tokenizer: str = TOKENIZER,
    spaced: bool = True,
    end: int = END,
    block: int = BLOCK,
) -> str:
    """Writes ``folder``/codes (id, frequency) and ``folder``/blocks; returns ``folder``.

    A null or empty text is its end id alone. Documents of equal or null id
    keep the order in which they were read, nulls first. An empty table writes
    an empty table of blocks.
    """
    spark = documents.sparkSession
    own = plain(documents, doc_id="long", text="string").withColumn("row", F.monotonically_increasing_id())
    keys = [F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    raw = own.repartitionByRange(*keys).sortWithinPartitions(*keys)
    raw = raw.mapInArrow(_tokenise(tokenizer_path(tokenizer), spaced, end, block), RAW)
    raw.write.option("compression", "zstd").parquet(f"{folder}/raw")
    raw = spark.read.schema(RAW).parquet(f"{folder}/raw")
    # One row per vocabulary entry at most.
    met = raw.select(F.explode(F.arrays_zip("met", "times")).alias("m")).groupBy("m.met").agg(F.sum("m.times").alias("n"))
    frequency = rans.scaled({r["met"]: r["n"] for r in met.collect()})
    codes = [(i, int(f)) for i, f in enumerate(frequency) if f]
    spark.createDataFrame(codes, "id int, frequency long").coalesce(1).write.parquet(f"{folder}/codes")
    shared = spark.sparkContext.broadcast(frequency)
    blocks = raw.select("part", "number", "first", "tokens", "docs", "lengths", "width", "ids")
    blocks.mapInArrow(_encode(shared), FILE).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; a damaged block raises."""
    codes = spark.read.parquet(f"{folder}/codes").collect()
    frequency = np.zeros(max((r["id"] for r in codes), default=0) + 1, np.int64)
    for r in codes:
        frequency[r["id"]] = r["frequency"]
    shared = spark.sparkContext.broadcast(frequency)
    blocks = spark.read.schema(FILE).parquet(f"{folder}/blocks")
    # One row per writing task: what lies before it.
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    found = blocks.mapInArrow(_decode(shared), "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"
    )


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    folder = write_tokens(table(spark, sf_dir, "documents"), shared_folder(spark))
    return read_tokens(spark, folder)
