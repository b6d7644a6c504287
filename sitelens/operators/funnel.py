"""Click-through after a page view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.operators.scope import in_scope
from sitelens.operators.skew import flag_members

FUNNEL_DIMENSIONS = ("market_code", "page_path", "device_category", "channel_grouping", "medium")


def page_ctr(
    hits: DataFrame,
    sessions: DataFrame,
    pages: Sequence[str] | DataFrame,
    labels: Sequence[str] | DataFrame,
    start: str,
    end: str,
    brand: str,
    markets: Sequence[str],
) -> DataFrame:
    """Visitors of each page, those who clicked a listed label on it after a
    qualifying view, and those who came back to it in a bounced session.

    The plain form joins every qualifying view to every later hit of its session,
    which is quadratic in the session. Only the existence of a later hit matters,
    and one exists exactly when the session's latest hit on the page is after the
    session's earliest qualifying view. So hits are reduced once to (session,
    page) extremes and nothing is joined at hit grain.

    Hits of a session share its visitor and its start date, as the table contract
    says; the date range therefore prunes the later hits too. ``pages`` and
    ``labels`` are lists or one-column DataFrames of any size.
    """
    listed = isinstance(pages, DataFrame)
    viewed = in_scope(start, end) & (F.col("page_path").isNotNull() if listed else F.col("page_path").isin(*pages))
    qualifying = in_scope(brand=brand, markets=markets)
    keys = ["session_id", "visitor_id", "visit_start_date", "market_code", "page_path"]
    relevant = hits.where(viewed)
    if isinstance(labels, DataFrame):
        touched = _touch_by_label_table(relevant, keys, qualifying, labels)
    else:
        touched = relevant.groupBy(*keys).agg(
            F.min(F.when(qualifying, F.col("hit_datetime"))).alias("first_view"),
            F.max("hit_datetime").alias("last_hit"),
            F.max(F.when(F.col("event_label").isin(*labels), F.col("hit_datetime"))).alias("last_click"),
        )
    if listed:  # tested once per session and page
        touched = flag_members(touched, "page_path", pages, "on_list", spread=keys).where("on_list = 1").drop("on_list")
    # At most (pages x markets) rows per session are left, so this window is small for any session.
    opened = touched.withColumn("opened", F.min("first_view").over(Window.partitionBy("session_id")))
    attributed = opened.where(F.col("opened").isNotNull()).join(
        sessions.where(in_scope(start, end)).select(
            "session_id", "bounced_session", "device_category", "channel_grouping", "medium"
        ),
        "session_id",
    )
    # One row per visitor, page, day and dimension value: was the page viewed, clicked, returned to?
    later = F.col("last_hit") > F.col("opened")
    days = ["visitor_id", "page_path", "visit_start_date"]
    dims = [d for d in FUNNEL_DIMENSIONS if d != "page_path"]
    daily = attributed.groupBy(*days, *dims).agg(
        F.max(F.col("first_view").isNotNull()).alias("viewed"),
        F.max(F.coalesce(F.col("last_click") > F.col("opened"), F.lit(False))).alias("clicked"),
        F.max(later & (F.col("bounced_session") == 1)).alias("bounced"),
    )
    # Outcomes are matched on visitor, page and day, whatever session dimensions they happened under.
    same_day = Window.partitionBy(*days)
    matched = daily.select(
        *days, *dims, "viewed", F.max("clicked").over(same_day).alias("clicked"), F.max("bounced").over(same_day).alias("bounced")
    ).where("viewed")
    per_visitor = matched.groupBy(*FUNNEL_DIMENSIONS, "visitor_id").agg(
        F.max("clicked").alias("clicked"), F.max("bounced").alias("bounced")
    )
    return per_visitor.groupBy(*FUNNEL_DIMENSIONS).agg(
        F.count("visitor_id").alias("total_page_visitors"),
        F.count(F.when(F.col("clicked"), F.col("visitor_id"))).alias("ctr_visitors"),
        F.count(F.when(F.col("bounced"), F.col("visitor_id"))).alias("total_bounced_visitor"),
    )


def _touch_by_label_table(relevant: DataFrame, keys: list[str], qualifying: Column, labels: DataFrame) -> DataFrame:
    """As the list form, with label membership tested on pre-aggregated rows."""
    by_label = relevant.groupBy(*keys, "event_label").agg(
        F.min(F.when(qualifying, F.col("hit_datetime"))).alias("first_view"),
        F.max("hit_datetime").alias("last_hit"),
    )
    flagged = flag_members(by_label, "event_label", labels, "listed", spread=keys)
    return flagged.groupBy(*keys).agg(
        F.min("first_view").alias("first_view"),
        F.max("last_hit").alias("last_hit"),
        F.max(F.when(F.col("listed") == 1, F.col("last_hit"))).alias("last_click"),
    )
