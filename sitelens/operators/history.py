"""Conversation and query history as batch jobs over tables.

An upsert takes the stored table and the new rows and returns the new table.
Every upsert is one grouped aggregate with map-side
combine, so a key with very many rows is reduced before the shuffle. A large
store is kept in buckets by a hash of the key; a batch then reads and replaces only
the buckets that its keys fall into.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators.skew import salted_join


def query_hash(question: Column) -> Column:
    return F.md5(question)


def session_upsert(stored: DataFrame, touches: DataFrame) -> DataFrame:
    """Sessions after ``touches`` (session_id, timestamp, metadata).

    A known session only moves its last interaction; a new one starts at its
    first touch and keeps that touch's metadata (of touches at one time, the
    smallest).
    """
    old = stored.select("session_id", "created_at", "last_interaction", "metadata", F.lit(0).alias("arrival"))
    new = touches.select(
        "session_id",
        F.col("timestamp").alias("created_at"),
        F.col("timestamp").alias("last_interaction"),
        "metadata",
        F.lit(1).alias("arrival"),
    )
    first = F.struct("arrival", "created_at", "metadata")
    return (
        old.unionByName(new)
        .groupBy("session_id")
        .agg(
            F.min_by(F.struct("created_at", "metadata"), first).alias("kept"),
            F.max("last_interaction").alias("last_interaction"),
        )
        .select("session_id", "kept.created_at", "last_interaction", "kept.metadata")
    )


def query_upsert(asked: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Queries by hash: the newest SQL, complexity and time win; session and question stay the first.

    Both inputs have session_id, natural_language_query, sql_query, complexity and
    timestamp; equal timestamps are settled by session id, then by SQL text.
    """
    rows = asked.withColumn("arrival", F.lit(1))
    if stored is not None:
        rows = rows.unionByName(stored.withColumn("arrival", F.lit(0)))
    order = F.struct("arrival", "timestamp", "session_id", "sql_query")
    return (
        rows.withColumn("query_hash", query_hash(F.col("natural_language_query")))
        .groupBy("query_hash")
        .agg(
            F.min_by(F.struct("session_id", "natural_language_query"), order).alias("first"),
            F.max_by(F.struct("sql_query", "complexity", "timestamp"), order).alias("last"),
        )
        .select("query_hash", "first.*", "last.*")
    )


#: Buckets of a store; each should fit some tasks. A store keeps the number it was begun with.
BUCKETS = 256
BUCKET = "key_bucket"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The table kept at ``path``."""
    return spark.read.parquet(path).drop(BUCKET)


def upsert_store(
    batch: DataFrame,
    path: str,
    key: Column,
    merge: Callable[[DataFrame | None, DataFrame], DataFrame],
    merged_key: Column | None = None,
    buckets: int = BUCKETS,
) -> int:
    """Merge ``batch`` into the store at ``path``; returns how many buckets were read and replaced.

    ``merge`` gets the stored rows that share a bucket with the batch (None for a new store) and the
    batch. ``key`` is the key of batch rows, ``merged_key`` that of merged rows if it is written otherwise. Only the
    touched buckets are scanned, and Spark's dynamic partition overwrite replaces only
    these, when all tasks are done: a failed batch leaves the store as it was and can be run again. The
    list of touched buckets, at most ``buckets`` numbers, is all the driver sees.
    """
    spark = batch.sparkSession
    touched = [r[0] for r in batch.select(_bucket(key, buckets).alias(BUCKET)).distinct().collect()]
    if not touched:
        return 0
    stored = _stored(spark, path)
    own = None if stored is None else stored.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    merged = merge(own, batch).withColumn(BUCKET, _bucket(key if merged_key is None else merged_key, buckets))
    writer = merged.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(BUCKET).parquet(path)
    return len(touched)


def upsert_sessions(touches: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """``session_upsert`` into the store at ``path``."""

    def merge(stored: DataFrame | None, new: DataFrame) -> DataFrame:
        if stored is None:
            at = F.col("timestamp")
            stored = new.limit(0).select("session_id", at.alias("created_at"), at.alias("last_interaction"), "metadata")
        return session_upsert(stored, new)

    return upsert_store(touches, path, F.col("session_id"), merge, buckets=buckets)


def upsert_queries(asked: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """``query_upsert`` into the store at ``path``."""

    def merge(stored: DataFrame | None, new: DataFrame) -> DataFrame:
        return query_upsert(new, stored if stored is None else stored.drop("query_hash"))

    key = query_hash(F.col("natural_language_query"))
    return upsert_store(asked, path, key, merge, F.col("query_hash"), buckets)


def store_messages(messages: DataFrame, path: str, ids: Sequence[str] = ("session_id", "turn")) -> None:
    """Append messages to the history files, partitioned by day, each once.

    A message is known by ``ids``; one that is stored already, or comes twice in
    the batch, is not added, so a batch can be run again. Of the store only the days of the
    batch are read; of two messages of one id in a batch the first by time and content is kept.
    """
    spark = messages.sparkSession
    days = messages.withColumn("day", F.to_date("timestamp"))
    others = [c for c in days.columns if c not in ids]
    first = F.struct("timestamp", F.xxhash64(*others).alias("_mark"), *[c for c in others if c != "timestamp"])
    once = days.groupBy(*ids).agg(F.min(first).alias("_first")).select(*ids, *[F.col(f"_first.{c}").alias(c) for c in others])
    stored = _stored(spark, path)
    if stored is not None:
        own = [r[0] for r in days.select("day").distinct().collect()]  # as many as days in the batch
        undated = F.col("day").isNull() if None in own else F.lit(False)
        known = stored.where(F.col("day").isin([d for d in own if d is not None]) | undated).select(
            F.struct(*[F.col(c).cast(days.schema[c].dataType).alias(c) for c in ids]).alias("_known")
        )
        once = once.join(known, F.struct(*ids) == F.col("_known"), "left_anti")
    once.select(*messages.columns, "day").hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def conversation_history(messages: DataFrame, session_id=None, tie_break: str = "turn") -> DataFrame:
    """Messages in time order: of one session, or of all, session by session."""
    wanted = messages if session_id is None else messages.where(F.col("session_id") == session_id)
    return wanted.orderBy("session_id", "timestamp", tie_break)


def lookup_by_hash(
    questions: DataFrame, stored: DataFrame, question_id: Sequence[str] = ("session_id", "turn")
) -> DataFrame:
    """The stored SQL of each question's hash; unknown questions keep NULLs."""
    asked = questions.withColumn("query_hash", query_hash(F.col("natural_language_query")))
    return salted_join(asked, stored.select("query_hash", "sql_query", "complexity"), "query_hash", spread=question_id)


def session_info(sessions: DataFrame, session_id) -> DataFrame:
    return sessions.where(F.col("session_id") == session_id)


def recent_sessions(sessions: DataFrame, most: int = 10) -> DataFrame:
    return sessions.orderBy(F.desc("last_interaction"), "session_id").limit(most)


def feedback_by_message(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Each message with its number of ratings, mean rating and texts given.

    Messages without feedback stay, with a count of 0.
    """
    keys = ["session_id", "message_id"]
    rated = feedback.groupBy(*keys).agg(
        F.count("rating").alias("ratings"),
        F.avg("rating").alias("avg_rating"),
        F.count("feedback_text").alias("comments"),
    )
    return (
        messages.join(rated, keys, "left")
        .withColumn("ratings", F.coalesce("ratings", F.lit(0)))
        .withColumn("comments", F.coalesce("comments", F.lit(0)))
    )
