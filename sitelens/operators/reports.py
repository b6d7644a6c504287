"""Counting reports over hits, sessions and session flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.calendar import week_start
from sitelens.functions.campaigns import campaign_components, campaign_objectives, media_channel
from sitelens.functions.ratios import minutes
from sitelens.functions.urls import configurator_page, landing_class
from sitelens.operators.scope import in_scope
from sitelens.operators.skew import flag_members, joined_text, numbered


def row_count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    """Exact distinct count; Spark pre-aggregates on the column before the final count."""
    return df.agg(F.countDistinct(column).alias(name))


def distinct_by(
    df: DataFrame, dims: str | Sequence[str], column: str = "session_id", name: str = "sessions_count"
) -> DataFrame:
    """Distinct ``column`` values per dimension, most first, ties by dimension."""
    dims = [dims] if isinstance(dims, str) else list(dims)
    counted = df.groupBy(*dims).agg(F.countDistinct(column).alias(name))
    return counted.orderBy(F.desc(name), *dims)


def total_pageviews(hits: DataFrame) -> DataFrame:
    pages = hits.where((F.col("hit_type") == "PAGE") & F.col("page_path").isNotNull())
    return row_count(pages, "total_pageviews")


def config_sessions(hits: DataFrame, host_word: str, host_name: str) -> DataFrame:
    """Sessions with a configurator page view."""
    wanted = configurator_page(
        F.col("host_name"), F.col("page_path"), F.col("content_group_4"), host_word, host_name
    )
    found = hits.where((F.col("hit_type") == "PAGE") & wanted)
    return found.select("session_id").distinct().agg(F.count("*").alias("sessions_with_config"))


def landing_groups(hits: DataFrame, excluded_host: str) -> DataFrame:
    """Sessions per landing page class, most first."""
    pages = hits.where(F.col("hit_type") == "PAGE")
    classed = pages.withColumn("landing_page", landing_class(F.col("host_name"), F.col("page_path"), excluded_host))
    return distinct_by(classed, "landing_page", name="session_count")


def top_landing_group(hits: DataFrame, excluded_host: str) -> DataFrame:
    return landing_groups(hits, excluded_host).limit(1)


def session_page_counts(hits: DataFrame) -> DataFrame:
    """Page views per session that has any."""
    return hits.where(F.col("hit_type") == "PAGE").groupBy("session_id").agg(F.count("*").alias("page_count"))


def single_vs_multi(hits: DataFrame) -> DataFrame:
    pages = F.col("page_count")
    return session_page_counts(hits).agg(
        F.count_if(pages == 1).alias("single_page_sessions"), F.count_if(pages > 1).alias("multi_page_sessions")
    )


def single_page_sessions(hits: DataFrame) -> DataFrame:
    return row_count(session_page_counts(hits).where(F.col("page_count") == 1), "single_page_sessions")


def multi_page_sessions(hits: DataFrame) -> DataFrame:
    return row_count(session_page_counts(hits).where(F.col("page_count") > 1), "multi_page_sessions")


def avg_page_count(hits: DataFrame) -> DataFrame:
    return session_page_counts(hits).agg(F.round(F.avg("page_count"), 2).alias("avg_pages_per_session"))


def pages_per_session(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("session_id").agg(F.sum("total_page_views").alias("total_pages"))


def avg_pages_per_session(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.round(F.avg("total_page_views"), 2).alias("avg_pages_per_session"))


def avg_session_minutes(sessions: DataFrame, *dims: str) -> DataFrame:
    averaged = sessions.groupBy(*dims).agg(minutes(F.avg("time_on_site_seconds")).alias("avg_session_duration_mins"))
    return averaged.orderBy(*dims) if dims else averaged


def total_minutes(sessions: DataFrame, *dims: str) -> DataFrame:
    totalled = sessions.groupBy(*dims).agg(minutes(F.sum("time_on_site_seconds")).alias("total_session_duration_mins"))
    return totalled.orderBy(*dims) if dims else totalled


def visitors_by_dims(
    hits: DataFrame,
    sessions: DataFrame,
    pages: Sequence[str] | DataFrame,
    start: str,
    end: str,
    brand: str,
    markets: Sequence[str],
) -> DataFrame:
    """Visitors per market, page, device, channel and day.

    Hits are reduced to distinct (session, visitor, page, day) before the join;
    the date range is kept on both sides so that both scans prune. ``pages`` is a
    list or a one-column DataFrame of any size.
    """
    listed = isinstance(pages, DataFrame)
    wanted = in_scope(start, end, brand, markets)
    if not listed:
        wanted &= F.col("page_path").isin(*pages)
    keys = ["session_id", "visitor_id", "market_code", "page_path", "visit_start_date"]
    seen = hits.where(wanted).select(*keys).distinct()
    if listed:
        seen = flag_members(seen, "page_path", pages, "on_list", spread=keys).where("on_list = 1")
    dims = sessions.where(in_scope(start, end)).select("session_id", "device_category", "channel_grouping")
    return (
        seen.join(dims, "session_id")
        .groupBy("market_code", "page_path", "device_category", "channel_grouping", "visit_start_date")
        .agg(F.countDistinct("visitor_id").alias("total_visitors"))
    )


def weekly_visitors(hits: DataFrame, sessions: DataFrame, path_like: str, start: str, end: str, brand: str) -> DataFrame:
    """Visitors of a page by traffic dimensions, with week start and day."""
    wanted = in_scope(start, end, brand) & F.col("page_path").like(path_like)
    seen = hits.where(wanted).select("session_id", "visitor_id", "market_code", "visit_start_date").distinct()
    dims = sessions.where(in_scope(start, end)).select(
        "session_id", "campaign", "channel_grouping", "medium", "referrer"
    )
    return (
        seen.join(dims, "session_id")
        .groupBy(
            "market_code",
            "campaign",
            "channel_grouping",
            "medium",
            "referrer",
            week_start(F.col("visit_start_date")).alias("week"),
            "visit_start_date",
        )
        .agg(F.countDistinct("visitor_id").alias("total_users"))
    )


def landing_like(hits: DataFrame, path_like: str) -> DataFrame:
    """Hits on paths matching a wildcard, by path."""
    found = hits.where(F.col("page_path").like(path_like))
    return found.groupBy("page_path").agg(F.count("*").alias("hits"))


def page_sequences(hits: DataFrame, most: int = 10) -> DataFrame:
    """The most common page-group sequences of sessions.

    A session is never gathered to be compared: its sequence is told apart by its
    length and two hashes of (position, group) over all its pages, of bounded size
    and combined before the shuffle. Text is built for the final rows alone. Of
    sequences met equally often those with the smaller session id come first.
    """
    pages = hits.where(F.col("hit_type") == "PAGE").select("session_id", "hit_datetime", "hit_id", "page_group")
    grouped = F.col("page_group").isNotNull()
    # Pages without a group take no place in the sequence, so they are numbered apart.
    placed = numbered(
        pages.withColumn("grouped", grouped), ["session_id", "grouped"], "hit_datetime", ["hit_id"], "position"
    )
    marks = [
        F.bit_xor(F.when(grouped, F.xxhash64(F.lit(seed), "position", "page_group"))).alias(f"mark_{seed}")
        for seed in (1, 2)
    ]
    sequences = (
        placed.groupBy("session_id")
        .agg(F.count("page_group").alias("length"), *marks)
        .groupBy("length", "mark_1", "mark_2")
        .agg(F.count("*").alias("n"), F.min("session_id").alias("example"))
    )
    top = sequences.orderBy(F.desc("n"), "example").limit(most)
    shown = F.broadcast(top.select(F.col("example").alias("session_id")))  # ``most`` rows
    whole = joined_text(
        pages.join(shown, "session_id", "left_semi"), ["session_id"], "hit_datetime", ["hit_id"], "page_group", " > ", "whole"
    ).withColumnRenamed("session_id", "example")
    return (
        top.join(whole, "example", "left")
        .orderBy(F.desc("n"), "example")
        .select(F.col("whole").alias("page_sequence"), F.col("n").alias("sequence_count"))
    )


def campaign_parts(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", *campaign_components(F.col("campaign")))


def campaign_objective(sessions: DataFrame) -> DataFrame:
    named = sessions.where(F.col("campaign").isNotNull())
    return named.select("session_id", *campaign_objectives(F.col("campaign")))


def media_channels(sessions: DataFrame) -> DataFrame:
    named = sessions.where(F.col("campaign").isNotNull())
    return named.select("session_id", "campaign", media_channel(F.col("campaign")).alias("media_channel"))


def campaign_first_channel(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        F.col("campaign").alias("session_first_campaign"), F.col("channel_grouping").alias("first_channel")
    ).distinct()


def flag_totals(flags: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Sum of each flag column under its output name."""
    return flags.agg(*[F.sum(c).cast("bigint").alias(name) for c, name in columns.items()])


def flagged_sessions(flags: DataFrame, condition: Column, name: str) -> DataFrame:
    return row_count(flags.where(condition), name)


def flagged_distinct_sessions(flags: DataFrame, condition: Column, name: str) -> DataFrame:
    return distinct_count(flags.where(condition), "session_id", name)


def nameplate_interactions(flags: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Sessions whose nameplate flag is set, one output column per flag."""
    return flags.agg(*[F.sum(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in columns.items()])


def nameplates_touched(columns: Sequence[str]) -> Column:
    """How many of the nameplate flags are set."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(c, F.lit(0))
    return total


def campaign_performance(flags: DataFrame) -> DataFrame:
    return (
        flags.groupBy("market_code", F.col("page_sequence_1").alias("landing_page_group"))
        .agg(
            F.countDistinct("session_id").alias("num_sessions"),
            F.sum("sessions_with_config_start").alias("total_config_starts"),
            F.sum("sessions_with_any_engagement").alias("total_engagements"),
            F.sum("sessions_with_any_enquiry").alias("total_enquiries"),
        )
        .orderBy(F.desc("num_sessions"), "market_code", "landing_page_group")
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys on more than one row, most rows first."""
    counted = df.groupBy(key).agg(F.count("*").alias("num_rows"))
    return counted.where(F.col("num_rows") > 1).orderBy(F.desc("num_rows"), key)


def market_cluster_cross(flags: DataFrame, clusters: DataFrame) -> DataFrame:
    """Sessions per market and cluster; sessions without a cluster form a NULL group."""
    joined = flags.select("session_id", "market_code").join(clusters, "session_id", "left")
    return distinct_by(joined, ["market_code", "cluster_name"], name="num_sessions")


def market_enrich(df: DataFrame, markets: DataFrame) -> DataFrame:
    """Add market name and region; rows of an unlisted market keep NULLs."""
    return df.join(markets, "market_code", "left")


def first_rows(df: DataFrame, columns: Sequence[str | Column], key: str, most: int | None = None) -> DataFrame:
    """A column list; ``most`` keeps the first by ``key``, in order, as a preview does."""
    listed = df.select(*columns)
    return listed.orderBy(key).limit(most) if most else listed
