"""Named visitor metrics over hits and their interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.ratios import percentage

CONFIG_START = 5
CONFIG_COMPLETE = 11


def interaction_visitors(hit_rows: DataFrame, lookup: DataFrame, by: Sequence[str] = ("market_code",)) -> DataFrame:
    """Visitors who enquired, engaged, started and completed a configuration.

    Interaction rows carry their hit's visitor, market and day, so the hits are
    not read. They are reduced to one row per visitor; the distinct counts become
    plain sums, so several of them cost one pass and no row expansion.
    """
    kind = F.col("interaction_id")
    flags = {
        "enquired": F.coalesce("enquiry_flag", F.lit(0)),
        "engaged": F.coalesce("engagement_flag", F.lit(0)),
        "started": F.when(kind == CONFIG_START, 1).otherwise(0),
        "completed": F.when(kind == CONFIG_COMPLETE, 1).otherwise(0),
    }
    per_visitor = (
        hit_rows.where(F.col("visitor_id").isNotNull())
        .select("interaction_id", "visitor_id", *by)
        .join(lookup.select("interaction_id", "enquiry_flag", "engagement_flag"), "interaction_id", "left")
        .groupBy(*by, "visitor_id")
        .agg(*[F.max(flag).alias(name) for name, flag in flags.items()])
    )
    counted = per_visitor.groupBy(*by).agg(
        F.count_if(F.col("enquired") == 1).alias("enquired_visitors"),
        F.count_if(F.col("engaged") == 1).alias("engaged_visitors"),
        F.count_if(F.col("started") == 1).alias("config_start"),
        F.count_if(F.col("completed") == 1).alias("config_completions"),
    )
    return counted.withColumn("uev_enq", percentage(F.col("enquired_visitors"), F.col("engaged_visitors")))


def visitor_metric(
    hit_rows: DataFrame, lookup: DataFrame, metric: str, by: Sequence[str] = ("market_code",)
) -> DataFrame:
    """One of the metrics; Catalyst drops the flags the others would need."""
    return interaction_visitors(hit_rows, lookup, by).select(*by, metric)


def visitors(sessions: DataFrame, name: str = "visitor_count") -> DataFrame:
    return sessions.agg(F.countDistinct("visitor_id").alias(name))


def visitors_by(sessions: DataFrame, dim: str, name: str = "visitor_count") -> DataFrame:
    return sessions.groupBy(dim).agg(F.countDistinct("visitor_id").alias(name)).orderBy(F.desc(name), dim)
