"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.runtime import cut_lineage, ensure_checkpoint_dir

__all__ = ["arrow_rows", "cut_lineage", "keyed", "lower_ascii", "make_room", "plain", "shared_folder", "spare", "table", "word_bytes", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How to drop what a worker process remembers from task to task.
FORGET: list[Callable[[], None]] = []
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, as ``name=type``; a missing one is null. Further columns cannot clash."""
    have = set(df.columns)
    return df.select(
        *((F.col(f"`{c}`") if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items())
    )


def spare(name: str, columns: list[str]) -> str:
    """``name``, with underscores in front until no column is called so (Spark does not tell case apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """A new place in the folder that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again.

    Like a checkpoint, but compressed, and the optimiser knows no more of the
    rows than their types: in a loop, what it derives grows with every round.
    """
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", compression).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def keyed(df: DataFrame, key: str = "_key") -> DataFrame:
    """``df`` with a column that names each row by file and place; what is no file is written first.

    Other than a number given while reading, it stays the same however the
    files are split.
    """
    place = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    try:
        return df.select("*", place.alias(key))
    except AnalysisException:
        return written(df).select("*", place.alias(key))


def make_room() -> None:
    """Drops what other operators remember in this worker process; it is reused by whatever stage comes next."""
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def word_bytes(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").translate(ASCII_LOWER).split()


def arrow_rows(rows: list[tuple], schema: pa.Schema, at_most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``at_most`` bytes of strings and binaries each."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if held >= at_most:
            yield batch(part, schema)
            part, held = [], 0
    if part:
        yield batch(part, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
