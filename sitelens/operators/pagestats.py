"""Page-level metrics: keep rule, rates, histograms and normality tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import normal
from sitelens.functions.ratios import ratio
from sitelens.functions.urls import path_key
from sitelens.operators import skew
from sitelens.operators.metrics import CONFIG_COMPLETE, CONFIG_START
from sitelens.operators.skew import flag_members
from sitelens.operators.visits import page_visits

# Page paths of total and blank rows.
NOT_A_PAGE = ("Totals", "nan", "")


def crawled_path_flag(pages: DataFrame, links: DataFrame, name: str = "page_path_check") -> DataFrame:
    """Flag page rows whose path is among the crawled links (scheme removed, lower-cased)."""
    crawled = links.select(path_key(F.col("link")).alias("page_path"))
    return flag_members(pages, "page_path", crawled, name, spread=["market_code", "page_path"])


def keep_rule(
    crawled: Column, markets: Sequence[str], crawled_min: int = 100, other_min: int = 500
) -> Column:
    """1 for page rows worth analysing, by the first rule that applies."""
    path, count = F.col("page_path"), F.col("SessionsCount")
    return (
        F.when((crawled == 1) & (count >= crawled_min), 1)
        .when(path.isNull() | path.isin(*NOT_A_PAGE), 0)
        .when(count <= other_min, 0)
        .when(F.col("market_code").isNull() | ~F.col("market_code").isin(*markets), 0)
        .otherwise(1)
    )


def keep_pages(
    pages: DataFrame, links: DataFrame, markets: Sequence[str], crawled_min: int = 100, other_min: int = 500
) -> DataFrame:
    flagged = crawled_path_flag(pages, links)
    return flagged.withColumn("keep", keep_rule(F.col("page_path_check"), markets, crawled_min, other_min))


def keep_check_counts(kept: DataFrame) -> DataFrame:
    """Rows per (keep, path matched)."""
    return kept.groupBy("keep", "page_path_check").agg(F.count("page_path").alias("pages"))


def page_metric_stats(hits: DataFrame, sessions: DataFrame, interactions: DataFrame) -> DataFrame:
    """Means, deviations and rates of the sessions that saw a page, per market and page.

    Of ``sessions`` also ``returning_visitor`` is read, 1 where the visitor came before.

    ``interactions`` (session_id, interaction_id, enquiry_flag, engagement_flag)
    is read once for all the rates that depend on it.
    """
    kind = F.col("interaction_id")
    did = interactions.groupBy("session_id").agg(
        F.max(F.col("enquiry_flag") == 1).alias("enquired"),
        F.max(F.col("engagement_flag") == 1).alias("engaged"),
        F.max(kind == CONFIG_START).alias("started"),
        F.max(kind == CONFIG_COMPLETE).alias("converted"),
    )
    columns = ("session_id", "returning_visitor", "time_on_site_seconds", "total_page_views", "bounced_session")
    per_session = sessions.select(*columns).join(did, "session_id", "left")
    seen = page_visits(hits, per_session, onward=True)
    count = F.count("*")

    def rate(condition: Column) -> Column:
        return ratio(F.count_if(condition), count)

    return seen.groupBy("market_code", "page_path").agg(
        count.alias("SessionsCount"),
        F.avg("time_on_site_seconds").alias("avg_time_on_site_seconds"),
        F.stddev_samp("time_on_site_seconds").alias("stddev_time_on_site_seconds"),
        F.avg("total_page_views").alias("avg_pages_viewed"),
        F.stddev_samp("total_page_views").alias("stddev_pages_viewed"),
        rate(F.col("exited")).alias("exit_rate"),
        rate(F.col("bounced_session") == 1).alias("bounce_rate"),
        F.avg("seconds_after").alias("avg_seconds_after_content"),
        F.avg("pages_after").alias("avg_pages_after_content"),
        F.stddev_samp("pages_after").alias("stddev_pages_after_content"),
        rate(F.col("returning_visitor") == 1).alias("returning_visitor_rate"),
        rate(F.col("enquired")).alias("enquiry_rate"),
        rate(F.col("engaged")).alias("engagement_rate"),
        rate(F.col("started")).alias("config_start_rate"),
        rate(F.col("converted")).alias("conversion_rate"),
    )


def metric_histogram(df: DataFrame, metric: str, by: str = "market_code", bins: int = 10) -> DataFrame:
    """Rows per group and equal-width bin between the group's own minimum and maximum.

    Values are counted per (group, value) first, so a group with most of the
    rows meets its bounds as its distinct values only. The maximum falls into the last
    bin; a group with a single value has one bin.
    """
    valued = df.where(F.col(metric).isNotNull()).groupBy(by, F.col(metric).cast("double").alias("v")).agg(
        F.count("*").alias("n")
    )
    bounds = valued.groupBy(by).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    width = (F.col("high") - F.col("low")) / F.lit(bins)
    position = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("low"), width)), F.lit(0))
    return (
        valued.alias("v")
        .join(bounds.alias("b"), F.col(f"v.{by}").eqNullSafe(F.col(f"b.{by}")))
        .select(
            F.col(f"v.{by}").alias(by),
            F.least(position, F.lit(bins - 1)).cast("bigint").alias("bin"),
            "low",
            width.alias("width"),
            "n",
        )
        .groupBy(by, "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"))
        .agg(F.sum("n").alias("rows"))
    )


def normality_test(df: DataFrame, metrics: Sequence[str], by: str = "market_code", level: float = 0.05) -> DataFrame:
    """Jarque-Bera screen per group and metric; normal when p is above ``level``.

    Skewness and kurtosis are Spark aggregates with mergeable state, so every
    group is reduced where its rows are. A constant metric has no p value.
    """
    long = df.unpivot(by, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    shaped = long.where(F.col("value").isNotNull()).groupBy(by, "metric").agg(
        F.count("value").alias("n"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("excess")
    )
    statistic = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("excess") * F.col("excess") / 4)
    p = F.exp(-F.col("jarque_bera") / 2)
    return (
        shaped.withColumn("jarque_bera", F.nullif(statistic, F.lit(float("nan"))))
        .withColumn("jarque_bera_p", p)
        .select(
            by,
            "metric",
            "n",
            "jarque_bera",
            "jarque_bera_p",
            F.when(F.col("jarque_bera_p") > level, 1).otherwise(0).alias("is_normal"),
        )
    )


def shapiro_francia(
    df: DataFrame, metrics: Sequence[str], tie: str, by: str = "market_code", level: float = 0.05
) -> DataFrame:
    """Shapiro-Francia test per group and metric; normal when p is above ``level``.

    W is the squared correlation of the values with the normal scores of their
    exact ranks, taken at (rank - 3/8) / (n + 1/4); p follows Royston's transformation of
    ln(1 - W). Ranks come from a scan over runs, so one group may hold most rows; the
    column ``tie`` parts equal values, the order among them changes nothing. Null and non-finite values take no
    part; under five values or without spread there is no p and no normality.
    """
    long = df.unpivot([by, tie], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    long = long.where(~F.isnan("value") & (F.abs("value") < float("inf"))).withColumn(
        "_group", F.to_json(F.struct(by, "metric"))
    )
    ranked = skew.numbered(long, ["_group"], "value", [tie], "rank")
    sizes = long.groupBy("_group").agg(F.count("*").alias("_n"))
    scored = skew.salted_join(ranked, sizes, "_group", [tie]).withColumn(
        "score", normal.quantile((F.col("rank") - 0.375) / (F.col("_n") + 0.25))
    )
    # Not corr(): it divides by the spread, and stops the query where there is none.
    squared = F.try_divide(F.pow(F.covar_pop("value", "score"), 2), F.var_pop("value") * F.var_pop("score"))
    tested = scored.groupBy(by, "metric").agg(
        F.count("*").alias("n"), F.when(F.min("value") < F.max("value"), squared).alias("shapiro_w")
    )
    u = F.when(F.col("n") >= 5, F.log(F.col("n").cast("double")))
    v = F.log(u)
    z = (F.log(1 - F.col("shapiro_w")) - (-1.2725 + 1.0521 * (v - u))) / (1.0308 - 0.26758 * (v + 2 / u))
    p = F.when(F.col("shapiro_w") < 1, normal.upper_tail(z)).when((F.col("shapiro_w") >= 1) & (F.col("n") >= 5), 1.0)
    return tested.withColumn("shapiro_p", p).withColumn(
        "is_normal", F.when(F.col("shapiro_p") > level, 1).otherwise(0)
    )
