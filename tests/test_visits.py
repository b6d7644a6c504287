"""Sessions, days and rollups on small hand-made visits."""

from datetime import date, datetime

from pyspark.sql import functions as F

from sitelens.operators import interactions, visits
from tests.conftest import rows

HITS = (
    "hit_id string, hit_type string, session_id string, visitor_id string, hit_datetime timestamp_ntz, "
    "visit_start_date date, brand string, market_code string, page_path string, page_group string, group_name string"
)


def at(day, hour, minute=0):
    return datetime(2024, 1, day, hour, minute)


def make(spark):
    data = [
        ("h1", "PAGE", "s1", "v1", at(1, 9), date(2024, 1, 1), "A", "US", "p", "home", "x"),
        ("h2", "EVENT", "s1", "v1", at(1, 9, 5), date(2024, 1, 1), "A", "US", "p", "home", None),
        ("h4", "PAGE", "s1", "v1", at(1, 9, 7), date(2024, 1, 1), "A", "US", "q", "models", "y"),
        ("h3", "PAGE", "s1", "v1", at(1, 9, 7), date(2024, 1, 1), "A", "US", "p", "home", "z"),  # same time as h4
        ("h5", "PAGE", "s2", "v1", at(3, 8), date(2024, 1, 3), "B", "GB", "p", "home", "x"),
        ("h6", "EVENT", "s3", "v2", at(3, 8), date(2024, 1, 3), "A", "GB", "p", "home", "x"),
    ]
    return spark.createDataFrame(data, HITS)


def test_session_build(spark):
    got = visits.session_build(make(spark)).select(
        "session_id", "total_hits", "total_page_views", "time_on_site_seconds", "bounced_session",
        "got_interaction_event", "session_number", "returning_visitor",
    )
    assert rows(got) == [("s1", 4, 3, 420, 0, 1, 1, 0), ("s2", 1, 1, 0, 1, 0, 2, 1), ("s3", 1, 0, 0, 0, 1, 1, 0)]


def test_hit_numbering_breaks_ties_by_id(spark):
    got = visits.hit_numbering(make(spark)).select("hit_id", "hit_number")
    assert rows(got) == [("h1", 1), ("h2", 2), ("h3", 3), ("h4", 4), ("h5", 1), ("h6", 1)]


def test_entrance_and_exit_are_page_views(spark):
    got = visits.entrance_exit(make(spark)).select("hit_id", "entrance", "exit")
    assert rows(got) == [("h1", 1, 0), ("h2", 0, 0), ("h3", 0, 0), ("h4", 0, 1), ("h5", 1, 1), ("h6", 0, 0)]


def test_previous_group_keeps_missing_values(spark):
    got = visits.previous_group(make(spark), "group_name").select("hit_id", "previous_group_name")
    assert rows(got) == [("h1", None), ("h2", "x"), ("h3", None), ("h4", "z"), ("h5", None), ("h6", None)]


def test_new_and_returning(spark):
    sessions = visits.session_totals(make(spark))
    assert rows(visits.new_returning(sessions)) == [(2, 1)]
    assert rows(visits.new_returning(sessions.limit(0))) == [(0, 0)]
    assert rows(visits.new_returning_pct(sessions.limit(0))) == [(None, None)]


def test_page_metrics(spark):
    hits = make(spark)
    got = visits.page_metrics(hits, visits.session_totals(hits))
    assert rows(got) == [("GB", "p", 2, 1, 2), ("US", "p", 1, 0, 0), ("US", "q", 1, 0, 1)]


def lookup(spark):
    return spark.createDataFrame(
        [(5, "start", 1, 0), (20, "enquiry", 0, 1)],
        "interaction_id int, interaction_desc string, engagement_flag int, enquiry_flag int",
    )


def classified(spark):
    rules = {5: F.col("page_group") == "home", 20: F.col("hit_id") == "h4"}
    nameplates = F.when(F.col("hit_id") == "h2", F.array(F.lit("N1"), F.lit("N2"))).otherwise(F.array().cast("array<string>"))
    return interactions.hit_interactions(make(spark), rules, nameplates)


def test_a_hit_may_have_many_nameplates_or_none(spark):
    got = classified(spark).where("session_id = 's1'").select("hit_interaction_nameplate_id")
    assert [r[0] for r in rows(got)] == ["h1-5-NONE", "h2-5-N1", "h2-5-N2", "h3-5-NONE", "h4-20-NONE"]


def test_visitor_day(spark):
    sessions = visits.session_totals(make(spark))
    got = interactions.visitor_day(sessions, classified(spark), lookup(spark)).select(
        "visitor_day_id", "day_id", "brand", "market_code", "total_sessions", "total_hits", "engaged_visitor", "enquiry_visitor"
    )
    assert rows(got) == [
        ("v1-20240101", 20240101, "A", "US", 1, 4, 1, 1),
        ("v1-20240103", 20240103, "B", "GB", 1, 1, 1, 0),
        ("v2-20240103", 20240103, "A", "GB", 1, 1, 1, 0),
    ]


def test_month_rollup_uses_the_final_session(spark):
    sessions = visits.session_totals(make(spark))
    markets = spark.createDataFrame([("GB", "United Kingdom", "Europe")], "market_code string, market_name string, region string")
    got = interactions.visitor_interaction_rollup(sessions, classified(spark), lookup(spark), markets, "month")
    # v1's January belongs to brand B, market GB, although it enquired in the US session
    assert rows(got.select("brand", "market_code", "region", "month_id", "completed_month", "interaction_id", "total_visitors")) == [
        ("A", "GB", "Europe", 202401, 0, 5, 1), ("B", "GB", "Europe", 202401, 0, 20, 1), ("B", "GB", "Europe", 202401, 0, 5, 1),
    ]
