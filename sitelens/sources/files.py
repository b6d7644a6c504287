"""CSV and JSON files, request logs, and the partitioned table layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.catalog import CONTRACTS
from sitelens.operators.skew import borders_up_to
from sitelens.operators.weblog import REQUEST_METHOD


def write_csv(df: DataFrame, path: str, by_market: bool = False, mode: str = "overwrite") -> None:
    """CSV files with a header; one folder per market on request."""
    if by_market:
        writer = df.hint("rebalance", "market_code").write.partitionBy("market_code")
    else:
        writer = df.write
    writer.mode(mode).option("header", True).csv(path)


def append_feedback(feedback: DataFrame, path: str) -> None:
    """Append (sql_query, corrections) records as JSON lines."""
    feedback.select("sql_query", "corrections").write.mode("append").json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parsed events as JSON lines."""
    df.write.mode(mode).json(path)


def read_page_metrics(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Page metrics from CSV; column names are lower-cased unless they contain SessionsCount.

    Without a schema every column is read as text, which needs no extra pass over the data.
    """
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    return df.toDF(*[c if "SessionsCount" in c else c.lower() for c in df.columns])


REQUEST_SCHEMA = (
    "message struct<method: string, params: struct<request: struct<url: string, postData: string>>, button_text: string>"
)


ENTRY_SCHEMA = "message string, url string, body string, timestamp string"


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    """Browser log entries, one JSON object a line, as ``parse_request_entries`` returns them."""
    return parse_request_entries(spark.read.schema(ENTRY_SCHEMA).option("mode", "DROPMALFORMED").json(path))


def parse_request_entries(entries: DataFrame) -> DataFrame:
    """(request_id, method, url, body, button_text) of log entries, ready for the parsers of requests.

    An entry holds a ``message`` that is itself JSON text, or, in the flat form,
    the url and body of a request that was sent. Entries with neither are
    skipped. Without a ``request_id`` the hash of an entry is its id.
    """
    have = set(entries.columns)
    url, body, at = (F.col(c) if c in have else F.lit(None).cast("string") for c in ("url", "body", "timestamp"))
    whole = F.struct("message", url.alias("url"), body.alias("body"), at.alias("timestamp"))
    own = F.col("request_id") if "request_id" in have else F.md5(F.to_json(whole))
    message = F.from_json("message", REQUEST_SCHEMA, {"mode": "PERMISSIVE"})["message"]
    parsed = entries.select(own.alias("request_id"), message.alias("m"), url.alias("flat_url"), body.alias("flat_body"))
    nested, request = F.col("m").isNotNull(), "m.params.request"
    return parsed.where(nested | F.col("flat_url").isNotNull()).select(
        "request_id",
        F.when(nested, F.col("m.method")).otherwise(F.lit(REQUEST_METHOD)).alias("method"),
        F.when(nested, F.col(f"{request}.url")).otherwise(F.col("flat_url")).alias("url"),
        F.when(nested, F.col(f"{request}.postData")).otherwise(F.col("flat_body")).alias("body"),
        F.col("m.button_text").alias("button_text"),
    )


#: Rank bits of each cluster column, and rows drawn to find the ranks.
RANK_BITS, RANK_ROWS = 8, 20_000


def clustered_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """A number by which rows that are near in every one of ``columns`` are near (Z-order).

    Each column is ranked among borders that a sample drawn by hash gives; the bits of the
    ranks are interleaved, the highest of every column first, so that each column alone
    narrows a file's ranges, not only the first. The driver sees at most ``RANK_ROWS`` or so short rows.
    """
    bits = min(RANK_BITS, 62 // len(columns))
    drawn = df.select(*columns)
    share = RANK_ROWS / max(1, drawn.count())
    rows = drawn.where(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))).collect()
    ranks = []
    for column in columns:
        values = sorted(r[column] for r in rows if r[column] is not None)
        # A frequent value is several borders, so that few values use all bits as well.
        borders = [F.lit(values[i * len(values) >> bits]) for i in range(1, 1 << bits)] if values else []
        rank = borders_up_to(F.array(*borders), F.col(column), 1 << bits) if borders else F.lit(0)
        ranks.append(F.when(F.col(column).isNull(), 0).otherwise(rank))
    key = F.lit(0).cast("bigint")
    for bit in reversed(range(bits)):
        for rank in ranks:
            key = key * 2 + F.shiftright(rank, bit).bitwiseAND(1)
    return key


def write_layout(
    df: DataFrame, path: str, partition_by: str, cluster_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Parquet partitioned by a date column and clustered by further columns inside files.

    Rows are gathered by date for few files each; the rebalance lets Spark split a
    heavy date over several writers and merge light ones. Inside a file rows follow
    a Z-order of the cluster columns, so that row groups have narrow min/max ranges in every one of
    them and a filter on any skips most.
    """
    if not cluster_by:
        df.hint("rebalance", partition_by).write.mode(mode).partitionBy(partition_by).parquet(path)
        return
    keyed = df.withColumn("_place", clustered_key(df, cluster_by))
    gathered = keyed.hint("rebalance", partition_by).sortWithinPartitions(partition_by, "_place", *cluster_by)
    gathered.drop("_place").write.mode(mode).partitionBy(partition_by).parquet(path)


def write_table(df: DataFrame, path: str, table: str) -> None:
    """Write a table in the layout its contract names; cluster columns it lacks are left out."""
    layout = CONTRACTS[table]
    cluster = [c for c in layout["cluster_by"] if c in df.columns]
    write_layout(df, path, layout["partition_by"], cluster)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, sort_by: Sequence[str] = ()) -> None:
    """A catalog table bucketed by ``key``, so that joins and groupings on it need no shuffle.

    Rows are brought to their bucket first, so there is a file per bucket and not per task and bucket.
    """
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *sort_by).format("parquet").saveAsTable(table)
