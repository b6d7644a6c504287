"""Tables by name, capped SQL, previews, catalog look-ups and scan cost."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BYTES_PER_TB = 1_099_511_627_776
USD_PER_TB = 5.0
PREVIEW_ROWS = 10


def scan_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def run_query(
    spark: SparkSession,
    sql: str,
    max_results: int | None = None,
    args: dict | None = None,
    **tables: DataFrame,
) -> DataFrame:
    """Run SQL text, returning all rows, or at most ``max_results`` if asked.

    ``tables`` are reachable in the text as ``{name}``; ``args`` fill ``:name``
    parameters.
    """
    result = spark.sql(sql, args=args, **tables)
    return result.limit(max_results) if max_results else result


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> dict:
    """First rows, row count and column names of a result.

    Nothing is kept: the count needs no columns, and the first rows stop early.
    """
    return {
        "row_count": df.count(),
        "columns": df.columns,
        "preview_data": [row.asDict() for row in df.take(rows)],
    }


def describe_table(df: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """One row per column: position, name, type, description and the table's row count.

    Descriptions come from the column comments. ``created`` is a one-value frame,
    such as ``file_created`` of a plain file scan.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(f.metadata.get("comment")).cast("string").alias("description"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    described = df.agg(F.count("*").alias("num_rows")).select(F.inline(rows), "num_rows")
    return described if created is None else described.withColumn("created", created.scalar())


def file_created(scan: DataFrame) -> DataFrame:
    """Modification time of the newest file of a plain file scan, as one value."""
    return scan.select("_metadata.file_modification_time").agg(F.max("file_modification_time").alias("created"))


def list_datasets(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def list_tables(spark: SparkSession, dataset: str) -> list[str]:
    return [t.name for t in spark.catalog.listTables(dataset)]


def scan_cost(spark: SparkSession, *paths: str, usd_per_tb: float = USD_PER_TB) -> DataFrame:
    """Bytes, terabytes and price of reading the parquet files under some paths, each file once.

    One row per file: the listing alone, no file is opened.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    files = listed.load(list(dict.fromkeys(paths))).select("path", "length").distinct()
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_processed"))
    return cost_columns(total, usd_per_tb)


def query_scans(df: DataFrame) -> list[tuple[str, list[str]]]:
    """(file, top-level columns) of every parquet file that ``df`` would read, once per scan, without running it.

    Read off the physical plan, so partitions that filters rule out and columns that nothing
    needs are left out; scalar and other subqueries are included.
    """
    execution = df._jdf.queryExecution()
    session = df.sparkSession._jsparkSession
    plans, found = [execution.sparkPlan()], []
    subqueries = execution.optimizedPlan().subqueriesAll()
    for i in range(subqueries.size()):
        plans.append(session.sessionState().executePlan(subqueries.apply(i), execution.mode()).sparkPlan())
    while plans:
        node = plans.pop()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            columns = list(node.requiredSchema().fieldNames())
            found += [(f.filePath().toString(), columns) for f in node.selectedPartitions().toPartitionArray()]
        children = node.children()
        plans += [children.apply(i) for i in range(children.size())]
    return found


def query_cost(df: DataFrame, usd_per_tb: float = USD_PER_TB) -> DataFrame:
    """Bytes, terabytes and price of the column chunks that a query over parquet files would read.

    The files' footers are read as rows of a Spark job, a few thousand bytes each; the query itself does not run.
    A scan of the same file in two places counts twice, as it is read twice. A query that needs
    no column, such as a count of rows, reads footers alone and costs nothing.
    """
    spark = df.sparkSession
    scans = query_scans(df)
    if not scans:
        return cost_columns(spark.range(1).select(F.lit(0).cast("bigint").alias("bytes_processed")), usd_per_tb)
    files = spark.createDataFrame(scans, "path string, columns array<string>")
    files = files.repartition(min(len(scans), spark.sparkContext.defaultParallelism * 4))
    sizes = files.mapInPandas(_chunk_bytes, "bytes long").agg(F.sum("bytes").alias("bytes_processed"))
    return cost_columns(sizes, usd_per_tb)


def _chunk_bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from urllib.parse import unquote

    import pyarrow.parquet as pq
    from pyarrow import fs

    for frame in frames:
        sizes = []
        for path, columns in zip(frame["path"], frame["columns"]):
            uri = unquote(path)
            store, place = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
            with store.open_input_file(place) as opened:
                footer = pq.read_metadata(opened)
            wanted, size = set(columns), 0
            for group in map(footer.row_group, range(footer.num_row_groups)):
                for chunk in map(group.column, range(group.num_columns)):
                    if chunk.path_in_schema.split(".")[0] in wanted:
                        size += chunk.total_compressed_size
            sizes.append(size)
        yield pd.DataFrame({"bytes": sizes})


def cost_columns(sized: DataFrame, usd_per_tb: float = USD_PER_TB) -> DataFrame:
    """Price columns for a frame that has ``bytes_processed``."""
    terabytes = F.col("bytes_processed") / F.lit(BYTES_PER_TB)
    usd = terabytes * F.lit(usd_per_tb)
    return sized.select(
        "bytes_processed",
        terabytes.alias("terabytes_processed"),
        usd.alias("estimated_cost_usd"),
        F.format_string("$%.6f", usd.cast(T.DoubleType())).alias("estimated_cost_formatted"),
    )
