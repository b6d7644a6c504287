"""Interaction tables, the wide session-flag table and visitor rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.calendar import period_end, period_id, period_start
from sitelens.functions.campaigns import campaign_components
from sitelens.operators.visits import IN_TIME_ORDER, first_touch

NO_NAMEPLATE = "NONE"


def hit_interactions(hits: DataFrame, rules: Mapping[int, Column], nameplates: Column) -> DataFrame:
    """One row per hit, interaction and nameplate.

    ``rules`` maps interaction ids to the condition that fires them, so
    classification is a projection of the hits, not a join. ``nameplates`` is a
    string column or an array of strings; a hit with none gets ``NONE``.
    """
    fired = F.array_compact(F.array(*[F.when(rule, F.lit(i)) for i, rule in rules.items()]))
    classified = hits.withColumn("interaction_id", F.explode(fired)).withColumn("nameplate_code", nameplates)
    if dict(classified.dtypes)["nameplate_code"].startswith("array"):
        found = F.when(F.size("nameplate_code") > 0, F.col("nameplate_code")).otherwise(F.array(F.lit(NO_NAMEPLATE)))
        classified = classified.withColumn("nameplate_code", F.explode(F.array_distinct(found)))
    code = F.coalesce("nameplate_code", F.lit(NO_NAMEPLATE))
    number = ["hit_number"] if "hit_number" in hits.columns else []
    return classified.withColumn("nameplate_code", code).select(
        F.concat_ws("-", "hit_id", "interaction_id", "nameplate_code").alias("hit_interaction_nameplate_id"),
        "hit_id",
        "session_id",
        *number,
        "interaction_id",
        "nameplate_code",
        "visitor_id",
        "visit_start_date",
        "brand",
        "market_code",
    )


def session_interactions(hit_rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Flags and hit counts per session, interaction and nameplate."""
    return (
        hit_rows.groupBy("session_id", "interaction_id", "nameplate_code", "visit_start_date")
        .agg(F.count("*").alias("interaction_hits"))
        .join(lookup.select("interaction_id", "enquiry_flag", "engagement_flag"), "interaction_id")
        .select(
            "session_id",
            "interaction_id",
            "nameplate_code",
            "visit_start_date",
            "enquiry_flag",
            "engagement_flag",
            "interaction_hits",
        )
    )


def _any(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0))


def session_flags(
    sessions: DataFrame,
    hits: DataFrame,
    session_rows: DataFrame,
    touchpoints: Mapping[str, Column],
    nameplates: Mapping[str, str],
    specific_enquiries: Sequence[int],
    start_id: int = 5,
    complete_id: int = 11,
) -> DataFrame:
    """The wide one-row-per-session flag table.

    ``touchpoints`` maps flag names to hit conditions; ``nameplates`` maps
    nameplate codes to flag names; an enquiry by an interaction outside
    ``specific_enquiries`` counts as "other". Both sides are reduced to one row
    per session before they are joined on the session id.
    """
    order = F.struct(*IN_TIME_ORDER)
    pages = hits.groupBy("session_id").agg(
        F.min_by("page_group", order).alias("page_sequence_1"),
        F.max_by("page_group", order).alias("session_last_page_group"),
        *[_any(condition).alias(name) for name, condition in touchpoints.items()],
    )
    kind, enquiry = F.col("interaction_id"), F.col("enquiry_flag") == 1
    counted = {
        "sessions_with_config_start": _any(kind == start_id),
        "sessions_with_config_completes": _any(kind == complete_id),
        "sessions_with_any_engagement": F.max("engagement_flag"),
        "sessions_with_any_enquiry": F.max("enquiry_flag"),
        "sessions_with_enquiry_other": _any(enquiry & ~kind.isin(*specific_enquiries)),
    }
    acted = session_rows.groupBy("session_id").agg(
        *[value.alias(name) for name, value in counted.items()],
        *[F.max(F.when(F.col("nameplate_code") == code, 1)).alias(name) for code, name in nameplates.items()],
    )
    return (
        first_touch(sessions)
        .join(pages, "session_id", "left")
        .join(acted, "session_id", "left")
        .select(
            "session_id",
            "visitor_id",
            "market_code",
            F.col("campaign").alias("session_first_campaign"),
            F.col("channel_grouping").alias("session_first_channel_grouping"),
            F.col("source").alias("session_first_source"),
            F.col("medium").alias("session_first_medium"),
            "visitor_first_channel_grouping",
            "page_sequence_1",
            "session_last_page_group",
            *touchpoints,
            *[F.coalesce(name, F.lit(0)).alias(name) for name in counted],
            *nameplates.values(),
            *campaign_components(F.col("campaign")),
        )
    )


def visitor_day(sessions: DataFrame, hit_rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """One row per visitor and day: totals, flags, and the day's final brand and market."""
    final = F.max_by(F.struct("brand", "market_code"), F.struct("visit_start_datetime", "session_id"))
    days = sessions.groupBy("visitor_id", "visit_start_date").agg(
        final.alias("final"),
        F.count("*").alias("total_sessions"),
        F.sum("total_hits").alias("total_hits"),
        F.sum("total_page_views").alias("total_page_views"),
        F.sum("time_on_site_seconds").alias("time_on_site_seconds"),
    )
    flags = (
        hit_rows.select("visitor_id", "visit_start_date", "interaction_id")
        .join(lookup, "interaction_id")
        .groupBy("visitor_id", "visit_start_date")
        .agg(F.max("engagement_flag").alias("engaged"), F.max("enquiry_flag").alias("enquired"))
    )
    stamp = F.date_format("visit_start_date", "yyyyMMdd")
    return days.join(flags, ["visitor_id", "visit_start_date"], "left").select(
        F.concat_ws("-", "visitor_id", stamp).alias("visitor_day_id"),
        "visitor_id",
        stamp.cast("int").alias("day_id"),
        "visit_start_date",
        F.col("final.brand").alias("brand"),
        F.col("final.market_code").alias("market_code"),
        "total_sessions",
        "total_hits",
        "total_page_views",
        "time_on_site_seconds",
        F.coalesce("engaged", F.lit(0)).alias("engaged_visitor"),
        F.coalesce("enquired", F.lit(0)).alias("enquiry_visitor"),
    )


def visitor_interaction_rollup(
    sessions: DataFrame, hit_rows: DataFrame, lookup: DataFrame, markets: DataFrame, grain: str = "month"
) -> DataFrame:
    """Engaged visitors per brand, market, period and interaction.

    Brand and market are those of the visitor's final session in the period. A
    period is complete when its last day is not after the newest session date.
    """
    start = period_start(F.col("visit_start_date"), grain)
    finals = (
        sessions.withColumn("period", start)
        .groupBy("visitor_id", "period")
        .agg(F.max_by(F.struct("brand", "market_code"), F.struct("visit_start_datetime", "session_id")).alias("final"))
    )
    engaged = hit_rows.select("visitor_id", start.alias("period"), "interaction_id").distinct()
    counts = (
        engaged.join(finals, ["visitor_id", "period"])
        .groupBy("final.brand", "final.market_code", "period", "interaction_id")
        .agg(F.count("*").alias("total_visitors"))
    )
    newest = sessions.agg(F.max("visit_start_date").alias("d")).scalar()
    finished = F.when(period_end(F.col("period"), grain) <= newest, 1).otherwise(0)
    return (
        counts.join(markets, "market_code", "left")
        .join(lookup.select("interaction_id", "interaction_desc"), "interaction_id", "left")
        .select(
            "brand",
            "market_code",
            "market_name",
            "region",
            period_id(F.col("period"), grain).alias(f"{grain}_id"),
            F.col("period").alias(f"{grain}_id_date"),
            finished.alias(f"completed_{grain}"),
            "interaction_id",
            "interaction_desc",
            "total_visitors",
        )
    )
