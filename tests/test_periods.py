"""Click-through, period comparison, significance and data checks."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from sitelens.operators import metrics, periods
from tests.conftest import rows


@pytest.fixture(scope="module")
def stats(spark):
    data = [
        ("hero", date(2024, 1, 1), 100, 10), ("hero", date(2024, 1, 14), 100, 10),
        ("hero", date(2024, 1, 15), 100, 40), ("hero", date(2024, 2, 15), 100, 100),
        ("menu", date(2024, 1, 2), 0, 0), ("menu", date(2024, 1, 16), 50, 5),
    ]
    return spark.createDataFrame(data, "element string, visit_start_date date, impressions long, clicks long")


def test_totals_are_summed_before_dividing(stats):
    got = periods.analyze_ctr(stats)
    assert rows(got) == [("hero", 400, 160, 40.0), ("menu", 50, 5, 10.0)]


def test_period_comparison(stats):
    got = periods.analyze_performance(stats, ("2024-01-01", "2024-01-14"), ("2024-01-15", "2024-01-28"))
    assert rows(got.select("element", "impressions_a", "clicks_b", "ctr_a", "ctr_b", "clicks_change", "ctr_change")) == [
        ("hero", 200, 40, 10.0, 40.0, 20, 30.0), ("menu", 0, 5, None, 10.0, 5, None),
    ]
    judged = {r.element: (r.z, r.significant) for r in periods.significance(got).collect()}
    assert judged["hero"][0] == pytest.approx(6.1237, abs=1e-4) and judged["hero"][1] == 1
    assert judged["menu"] == (None, 0)


def test_metric_table_is_long(stats):
    got = periods.metric_table(periods.analyze_ctr(stats))
    assert rows(got.where("element = 'menu'")) == [
        ("menu", "clicks", 5.0), ("menu", "ctr", 10.0), ("menu", "impressions", 50.0),
    ]


def test_validate_columns(spark):
    df = spark.createDataFrame([("1", "2024-01-01"), ("x", None), (" ", "nope"), (None, "2024-02-30")], "n string, d string")
    got = periods.validate_columns(df, {"n": "int", "d": "date"})
    assert rows(got) == [("d", "date", 4, 1, 2), ("n", "int", 4, 2, 1)]


def test_segment_rate_compare(spark):
    hits = spark.createDataFrame(
        [(1, "v1", "classic"), (2, "v1", "modern"), (3, "v2", "classic"), (4, "v3", "modern"), (5, "v4", "other")],
        "hit_id long, visitor_id string, config string",
    )
    enquiries = spark.createDataFrame([(1,), (1,), (5,)], "hit_id long")
    got = periods.segment_rate_compare(
        hits, enquiries, {"classic": F.col("config") == "classic", "modern": F.col("config") == "modern"}
    ).first()
    assert (got.visitors_a, got.visitors_b, got.enquiries_a, got.enquiries_b) == (2, 2, 1, 0)
    assert (got.rate_a, got.rate_b, got.rate_change, got.significant) == (50.0, 0.0, -50.0, 0)


def test_rate_over_no_engaged_visitor_is_null(spark):
    fired = spark.createDataFrame(
        [("v1", "US", 20), ("v2", "GB", 5), ("v2", "GB", 20), ("v2", "GB", 99), (None, "GB", 20)],
        "visitor_id string, market_code string, interaction_id int",
    )
    lookup = spark.createDataFrame([(20, 0, 1), (5, 1, 0)], "interaction_id int, engagement_flag int, enquiry_flag int")
    assert rows(metrics.interaction_visitors(fired, lookup)) == [("GB", 1, 1, 1, 0, 100.0), ("US", 1, 0, 0, 0, None)]
