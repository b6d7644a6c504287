"""Click-through rates, period comparison, significance and data checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.ratios import percentage, two_proportion_z

SIGNIFICANT_Z = 1.96


def analyze_ctr(stats: DataFrame, element: str = "element") -> DataFrame:
    """Impressions, clicks and CTR per element; totals are summed before they are divided."""
    summed = stats.groupBy(element).agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks")
    )
    return summed.withColumn("ctr", percentage(F.col("clicks"), F.col("impressions")))


def analyze_performance(
    stats: DataFrame,
    period_a: tuple[str, str],
    period_b: tuple[str, str],
    element: str = "element",
    day: str = "visit_start_date",
) -> DataFrame:
    """Both periods side by side per element, with the change from a to b, in one pass."""
    in_a, in_b = (F.col(day).between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date")) for p in (period_a, period_b))

    def total(column: str, inside: Column) -> Column:
        return F.sum(F.when(inside, F.col(column)).otherwise(0))

    summed = (
        stats.where(in_a | in_b)
        .groupBy(element)
        .agg(
            total("impressions", in_a).alias("impressions_a"),
            total("clicks", in_a).alias("clicks_a"),
            total("impressions", in_b).alias("impressions_b"),
            total("clicks", in_b).alias("clicks_b"),
        )
    )
    rated = summed.withColumn("ctr_a", percentage(F.col("clicks_a"), F.col("impressions_a"))).withColumn(
        "ctr_b", percentage(F.col("clicks_b"), F.col("impressions_b"))
    )
    return rated.select(
        "*",
        (F.col("impressions_b") - F.col("impressions_a")).alias("impressions_change"),
        (F.col("clicks_b") - F.col("clicks_a")).alias("clicks_change"),
        (F.col("ctr_b") - F.col("ctr_a")).alias("ctr_change"),
    )


def significance(compared: DataFrame, threshold: float = SIGNIFICANT_Z) -> DataFrame:
    """Two-proportion z of the CTR change and whether it passes the threshold."""
    z = two_proportion_z(
        F.col("clicks_a"), F.col("impressions_a"), F.col("clicks_b"), F.col("impressions_b")
    )
    return compared.withColumn("z", z).withColumn("significant", F.when(F.abs("z") > threshold, 1).otherwise(0))


def metric_table(rated: DataFrame, element: str = "element") -> DataFrame:
    """Impressions, clicks and CTR in long form: one row per element and metric."""
    metrics = ["impressions", "clicks", "ctr"]
    wide = rated.select(element, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(element, metrics, "metric", "value")


def validate_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Missing values and failed conversions per column, from one pass over ``df``.

    A value counts as missing when it is NULL or blank, and as failed when it is
    present but does not convert to the wanted type.
    """
    checks = []
    for name, wanted in types.items():
        text = F.col(name).cast("string")
        missing = text.isNull() | (F.trim(text) == "")
        failed = ~missing & text.try_cast(wanted).isNull()
        checks += [F.count_if(missing).alias(f"{name}__missing"), F.count_if(failed).alias(f"{name}__failed")]
    counted = df.agg(F.count("*").alias("n_rows"), *checks)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(wanted).alias("wanted_type"),
                F.col("n_rows").alias("n_rows"),
                F.col(f"{name}__missing").alias("missing"),
                F.col(f"{name}__failed").alias("failed"),
            )
            for name, wanted in types.items()
        ]
    )
    return counted.select(F.inline(rows))


def segment_rate_compare(
    hits: DataFrame, enquiry_hits: DataFrame, segments: Mapping[str, Column], threshold: float = SIGNIFICANT_Z
) -> DataFrame:
    """Enquiry rate (enquiring visitors / visitors) of two segments, compared.

    ``enquiry_hits`` has the ids of hits that were enquiries. A visitor belongs
    to a segment through its hits there and enquires in it through one of them.
    """
    (name_a, is_a), (name_b, is_b) = segments.items()
    marked = hits.join(enquiry_hits.select("hit_id").distinct().withColumn("enquiry", F.lit(1)), "hit_id", "left")
    enquired = F.col("enquiry").isNotNull()
    per_visitor = marked.groupBy("visitor_id").agg(
        F.max(is_a).alias("in_a"),
        F.max(is_b).alias("in_b"),
        F.max(is_a & enquired).alias("enquired_a"),
        F.max(is_b & enquired).alias("enquired_b"),
    )
    counted = per_visitor.agg(*[F.count_if(c).alias(c) for c in ("in_a", "in_b", "enquired_a", "enquired_b")])
    a, b = F.col("in_a"), F.col("in_b")
    z = two_proportion_z(F.col("enquired_a"), a, F.col("enquired_b"), b)
    rate_a, rate_b = percentage(F.col("enquired_a"), a), percentage(F.col("enquired_b"), b)
    return counted.select(
        F.lit(name_a).alias("segment_a"),
        F.lit(name_b).alias("segment_b"),
        a.alias("visitors_a"),
        b.alias("visitors_b"),
        F.col("enquired_a").alias("enquiries_a"),
        F.col("enquired_b").alias("enquiries_b"),
        rate_a.alias("rate_a"),
        rate_b.alias("rate_b"),
        (rate_b - rate_a).alias("rate_change"),
        z.alias("z"),
        F.when(F.abs(z) > threshold, 1).otherwise(0).alias("significant"),
    )
