"""Sessions, visitors and days built from hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.skew import numbered, preceding, salted_join, tally

IN_TIME_ORDER = ("hit_datetime", "hit_id")


def session_totals(hits: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    """One row per session with its totals, from one map-side combined aggregate.

    Columns named in ``first`` are carried from the session's first hit as ``first_<name>``.
    """
    page = F.when(F.col("hit_type") == "PAGE", 1)
    event = F.when(F.col("hit_type") == "EVENT", 1)
    carried = [F.min_by(c, F.struct(*IN_TIME_ORDER)).alias(f"first_{c}") for c in first]
    totals = hits.groupBy("visitor_id", "visit_start_date", "session_id", "brand", "market_code").agg(
        F.min("hit_datetime").alias("visit_start_datetime"),
        F.max("hit_datetime").alias("last_hit_datetime"),
        F.count("*").alias("total_hits"),
        F.count(page).alias("total_page_views"),
        F.when(F.count(page) == 1, 1).otherwise(0).alias("bounced_session"),
        F.when(F.count(event) > 0, 1).otherwise(0).alias("got_interaction_event"),
        *carried,
    )
    spent = (F.col("last_hit_datetime") - F.col("visit_start_datetime")).cast("interval second")
    return totals.withColumn("time_on_site_seconds", spent.cast("bigint"))


def session_order(sessions: DataFrame) -> DataFrame:
    """Sessions with the visitor's session number and returning flag."""
    order = numbered(sessions, ["visitor_id"], "visit_start_datetime", ["session_id"], "session_number")
    return order.withColumn("returning_visitor", F.when(F.col("session_number") > 1, 1).otherwise(0))


def session_build(hits: DataFrame) -> DataFrame:
    """Session totals with the visitor's session number and returning flag."""
    return session_order(session_totals(hits))


def hit_numbering(hits: DataFrame) -> DataFrame:
    """Hits with their sequence number inside the session, from 1."""
    return numbered(hits, ["session_id"], "hit_datetime", ["hit_id"], "hit_number")


def entrance_exit(hits: DataFrame) -> DataFrame:
    """Hits with 0/1 flags on the first and last page view of each session.

    A page view is the first when it is the first one counted, and the last when all
    are counted with it: one shuffle of the hits, in which a huge session is cut into runs.
    """
    page = F.col("hit_type") == "PAGE"
    counted = tally(hits, ["session_id"], IN_TIME_ORDER[0], IN_TIME_ORDER[1:], page, "_seen", "_views")
    flags = {"entrance": page & (F.col("_seen") == 1), "exit": page & (F.col("_seen") == F.col("_views"))}
    return counted.select(*hits.columns, *[F.when(flag, 1).otherwise(0).alias(name) for name, flag in flags.items()])


def previous_group(hits: DataFrame, group: str = "content_group_4") -> DataFrame:
    """Hits with the content group of the session's preceding hit."""
    return preceding(hits, ["session_id"], "hit_datetime", ["hit_id"], group, f"previous_{group}")


def new_returning(sessions: DataFrame) -> DataFrame:
    """Sessions that are a visitor's first, and all others.

    Numbering the sessions is not needed: a visitor with n sessions has one new and n - 1 returning.
    """
    per_visitor = sessions.groupBy("visitor_id").agg(F.count("*").alias("n"))
    return per_visitor.agg(
        F.count("*").alias("new_sessions"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("returning_sessions"),
    )


def new_returning_pct(sessions: DataFrame) -> DataFrame:
    new, returning = F.col("new_sessions"), F.col("returning_sessions")
    return new_returning(sessions).select(
        F.try_divide(new * 100.0, new + returning).alias("pct_new_sessions"),
        F.try_divide(returning * 100.0, new + returning).alias("pct_returning_sessions"),
    )


def first_touch(sessions: DataFrame, column: str = "channel_grouping") -> DataFrame:
    """Sessions with the value ``column`` had on the visitor's first session."""
    name = f"visitor_first_{column}"
    firsts = sessions.groupBy("visitor_id").agg(
        F.min_by(column, F.struct("visit_start_datetime", "session_id")).alias(name)
    )
    return salted_join(sessions, firsts, "visitor_id", spread=["session_id"])


def page_visits(hits: DataFrame, sessions: DataFrame, onward: bool = False) -> DataFrame:
    """One row per session, market and page, with the session's columns, a flag where it ended and the seconds left.

    ``seconds_after`` runs from the first hit on the page to the session's last hit. ``onward`` adds
    ``pages_after``, the session's page views after its first hit on the page: all of its views but those
    counted by then, from one ordered pass that cuts huge sessions into runs.

    Everything page-level is computed from this reduced form of the hits. The
    rows of a session with very many pages are split for the join: they meet
    the session's columns and its last place by salted key.
    """
    place = F.struct("market_code", "page_path")  # compares NULLs as equal
    placed = hits.select("session_id", place.alias("place"), "hit_type", *IN_TIME_ORDER)
    counts = []
    if onward:
        view = F.col("hit_type") == "PAGE"
        placed = tally(placed, ["session_id"], IN_TIME_ORDER[0], IN_TIME_ORDER[1:], view, "_seen", "_views")
        counts = [F.max(F.col("_views") - F.col("_seen")).alias("pages_after")]  # most are left at the first
    moment, at = F.struct(*IN_TIME_ORDER), IN_TIME_ORDER[0]
    seen = placed.groupBy("session_id", "place").agg(F.max(moment).alias("latest"), F.min(at).alias("came"), *counts)
    # What a session ended with follows from its places; the hits are grouped once.
    end = seen.groupBy("session_id").agg(F.max_by("place", "latest").alias("end_place"), F.max(f"latest.{at}").alias("end_at"))
    whole = sessions.join(end, "session_id", "left")
    extra = ["pages_after"] if onward else []
    attributed = salted_join(seen.select("session_id", "place", "came", *extra), whole, "session_id", spread=["place"])
    return attributed.select(
        "place.*",
        F.col("place").eqNullSafe(F.col("end_place")).alias("exited"),
        (F.timestamp_diff("MICROSECOND", "came", "end_at") / 1e6).alias("seconds_after"),
        *extra,
        *sessions.columns,
    )


def page_metrics(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions seen, bounced and ended per market and page."""
    seen = page_visits(hits, sessions.select("session_id", "bounced_session"))
    return seen.groupBy("market_code", "page_path").agg(
        F.count("*").alias("SessionsCount"),
        F.count(F.when(F.col("bounced_session") == 1, 1)).alias("sessions_bounced"),
        F.count(F.when(F.col("exited"), 1)).alias("sessions_exited_at_content"),
    )
