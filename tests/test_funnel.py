"""Click-through after a page view: linear form, pairwise form and by hand."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.funnel import FUNNEL_DIMENSIONS, page_ctr
from sitelens.operators.scope import in_scope
from sitelens.plans import views
from sitelens.plans.registry import CTR_LABELS, FUNNEL_PAGES
from tests.conftest import rows

HIT = (
    "hit_id long, session_id string, visitor_id long, hit_datetime timestamp_ntz, visit_start_date date, "
    "brand string, market_code string, page_path string, event_label string"
)
SESSION = (
    "session_id string, visit_start_date date, bounced_session int, device_category string, "
    "channel_grouping string, medium string"
)
DAY = datetime(2024, 1, 5)
ARGS = dict(start="2024-01-01", end="2024-01-28", brand="Alpha", markets=["US", "GB"])


def hit(i, session, visitor, minute, page, label=None, market="US", brand="Alpha", day=DAY):
    return (i, session, visitor, day + timedelta(minutes=minute), day.date(), brand, market, page, label)


def page_ctr_pairwise(
    hits: DataFrame,
    sessions: DataFrame,
    pages: list[str],
    labels: list[str],
    start: str,
    end: str,
    brand: str,
    markets: list[str],
) -> DataFrame:
    """The same report from pairs of a view and a later hit, as many as the square of a session."""
    attributes = sessions.where(in_scope(start, end)).select(
        "session_id", "bounced_session", "device_category", "channel_grouping", "medium"
    )
    views = hits.where(in_scope(start, end, brand, markets) & F.col("page_path").isin(*pages)).join(
        attributes, "session_id"
    )
    keys = ["visitor_id", "page_path", "visit_start_date"]
    opened = views.select("session_id", "visitor_id", "visit_start_date", "bounced_session", F.col("hit_datetime").alias("at"))
    pairs = hits.select("session_id", "hit_datetime", "page_path", "event_label").join(opened, "session_id")
    later = pairs.where(F.col("hit_datetime") > F.col("at"))
    clicked = later.where(F.col("event_label").isin(*labels)).select(*keys).distinct().withColumn("clicked", F.lit(1))
    bounced = later.where(F.col("bounced_session") == 1).select(*keys).distinct().withColumn("bounced", F.lit(1))
    return (
        views.join(clicked, keys, "left")
        .join(bounced, keys, "left")
        .groupBy(*FUNNEL_DIMENSIONS)
        .agg(
            F.countDistinct("visitor_id").alias("total_page_visitors"),
            F.countDistinct(F.when(F.col("clicked") == 1, F.col("visitor_id"))).alias("ctr_visitors"),
            F.countDistinct(F.when(F.col("bounced") == 1, F.col("visitor_id"))).alias("total_bounced_visitor"),
        )
    )


def test_by_hand(spark):
    hits = spark.createDataFrame(
        [
            # visitor 1: view, then click on the same page -> click counts
            hit(1, "s1", 1, 0, "p"), hit(2, "s1", 1, 1, "p", "GO"),
            # visitor 2: the labelled hit is its only view, nothing comes later
            hit(3, "s2", 2, 0, "p", "GO"),
            # visitor 3: click at the very time of the view is not later
            hit(4, "s3", 3, 0, "p"), hit(5, "s3", 3, 0, "p", "GO"),
            # visitor 4: bounced session with a later hit on the page
            hit(6, "s4", 4, 0, "p"), hit(7, "s4", 4, 2, "p"),
            # visitor 5: later click on another listed page counts there, not on p
            hit(8, "s5", 5, 0, "p"), hit(9, "s5", 5, 1, "q", "GO"),
            # visitor 6: session out of the date range; visitor 7: other brand
            hit(10, "s6", 6, 0, "p"), hit(11, "s7", 7, 0, "p", brand="Beta"),
        ],
        HIT,
    )
    sessions = spark.createDataFrame(
        [(s, (DAY if s != "s6" else datetime(2023, 1, 1)).date(), int(s == "s4"), "mobile", "Direct", "(none)")
         for s in ("s1", "s2", "s3", "s4", "s5", "s6", "s7")],
        SESSION,
    )
    got = page_ctr(hits, sessions, ["p", "q"], ["GO"], **ARGS)
    expected = [("US", "p", "mobile", "Direct", "(none)", 5, 1, 1), ("US", "q", "mobile", "Direct", "(none)", 1, 0, 0)]
    # visitor 5's click on q is after its view of p, and q itself is viewed: it counts on q
    expected[1] = ("US", "q", "mobile", "Direct", "(none)", 1, 1, 0)
    assert rows(got) == expected
    assert rows(page_ctr_pairwise(hits, sessions, ["p", "q"], ["GO"], **ARGS)) == expected
    # Pages and labels as tables, with repeated, unknown and missing entries.
    pages = spark.createDataFrame([("p",), ("q",), ("q",), ("unknown",), (None,)], "address string")
    labels = spark.createDataFrame([("GO",), ("GO",), ("never captured on a hit",), (None,)], "label string")
    assert rows(page_ctr(hits, sessions, pages, labels, **ARGS)) == expected
    assert rows(page_ctr(hits, sessions, pages, ["GO"], **ARGS)) == expected
    assert rows(page_ctr(hits, sessions, pages.where("address = 'p'"), labels, **ARGS)) == rows(
        page_ctr(hits, sessions, ["p"], ["GO"], **ARGS)
    )
    assert page_ctr(hits, sessions, pages.limit(0), labels, **ARGS).count() == 0


@pytest.fixture(scope="module")
def busy(spark):
    """Random hits in which one session owns a third; times repeat, markets vary inside a session."""
    rng = random.Random(11)
    sessions, data = {}, []
    for i in range(1500):
        s = "bot" if i % 3 == 0 else f"s{rng.randrange(150)}"
        visitor, day = sessions.setdefault(
            s, (rng.randrange(40), DAY + timedelta(days=rng.randrange(30)))
        )
        data.append(
            hit(i, s, visitor, rng.randrange(60), rng.choice("pqrs"), rng.choice([None, None, "GO", "STAY"]),
                rng.choice(["US", "GB", "DE"]), rng.choice(["Alpha", "Alpha", "Beta"]), day)
        )
    attributes = [
        (s, day.date(), rng.randrange(2), rng.choice(["mobile", "desktop"]), rng.choice(["Direct", None]), "cpc")
        for s, (_, day) in sessions.items() if s != "s7"
    ]
    return spark.createDataFrame(data, HIT).cache(), spark.createDataFrame(attributes, SESSION).cache()


def test_linear_equals_pairwise_on_hot_session(busy):
    linear = rows(page_ctr(*busy, ["p", "q", "r"], ["GO"], **ARGS))
    assert len(linear) > 10
    assert linear == rows(page_ctr_pairwise(*busy, ["p", "q", "r"], ["GO"], **ARGS))


def test_label_table_equals_label_list(spark, busy):
    labels = spark.createDataFrame([("GO",), ("GO",), ("LEAVE",), (None,)], "label string")
    assert rows(page_ctr(*busy, ["p", "q"], labels, **ARGS)) == rows(page_ctr(*busy, ["p", "q"], ["GO", "LEAVE"], **ARGS))


def test_known_totals_on_given_tables(spark):
    root = "/root/testdata/sf0.01"
    hits, sessions = views.hit(spark, root), views.session(spark, root)
    args = (FUNNEL_PAGES, CTR_LABELS, "2024-01-01", "2024-01-28", "Alpha", ("US", "CA", "GB"))
    linear = page_ctr(hits, sessions, *args)
    assert rows(linear) == rows(page_ctr_pairwise(hits, sessions, *args))
    in_groups = hits.where(F.col("page_group").isin("homepage", "models")).select("page_path").distinct()
    listed = [r.page_path for r in in_groups.collect()]
    sums = page_ctr(hits, sessions, listed, *args[1:]).agg(
        F.count("*"), F.sum("total_page_visitors"), F.sum("ctr_visitors"), F.sum("total_bounced_visitor")
    )
    assert tuple(sums.first()) == (72, 473, 61, 89)
