"""Column functions on the awkward values."""

import random
from datetime import date
from urllib.parse import parse_qs

import pytest
from pyspark.sql import functions as F

from sitelens.functions import calendar, campaigns, ratios, urls


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "day, sunday",
    [
        (date(2024, 9, 1), date(2024, 9, 1)),  # a Sunday is its own week start
        (date(2024, 9, 7), date(2024, 9, 1)),
        (date(2024, 9, 8), date(2024, 9, 8)),
        (date(2024, 1, 1), date(2023, 12, 31)),
    ],
)
def test_weeks_start_on_sunday(spark, day, sunday):
    assert one(spark, calendar.week_start(F.col("d")), d=day) == sunday


@pytest.mark.parametrize(
    "grain, start, end, ident",
    [
        ("day", date(2024, 2, 14), date(2024, 2, 14), 20240214),
        ("week", date(2024, 2, 11), date(2024, 2, 17), 20240211),
        ("month", date(2024, 2, 1), date(2024, 2, 29), 202402),
    ],
)
def test_periods(spark, grain, start, end, ident):
    first = calendar.period_start(F.col("d"), grain)
    got = spark.range(1).select(F.lit(date(2024, 2, 14)).alias("d")).select(
        first, calendar.period_end(first, grain), calendar.period_id(first, grain)
    )
    assert tuple(got.first()) == (start, end, ident)


def test_unknown_grain():
    with pytest.raises(ValueError):
        calendar.period_start(F.lit(None), "year")


@pytest.mark.parametrize(
    "campaign, parts",
    [
        ("BE_MK_a560_20my_display", ("mk", "dis", "be", "a560")),
        ("gb_nv_mk_a550_psoc_do_conv_gmc3000", ("mk", "psoc", "gb", "a550")),
        ("brandx", (None, None, None, None)),
        (None, (None, None, None, None)),
    ],
)
def test_campaign_components(spark, campaign, parts):
    df = spark.createDataFrame([(campaign,)], "campaign string")
    assert tuple(df.select(*campaigns.campaign_components(F.col("campaign"))).first()) == parts


@pytest.mark.parametrize(
    "campaign, channel",
    [
        ("x_GMC5000_y", "YouTube"),
        ("x_gmc9000", "CRM / Direct Email"),
        ("x_gmc50001", "Unknown Media Channel"),
        ("plain", "Unknown Media Channel"),
    ],
)
def test_media_channel(spark, campaign, channel):
    assert one(spark, campaigns.media_channel(F.col("c")), c=campaign) == channel


def test_objectives(spark):
    df = spark.createDataFrame([("gb_think_traffic",), ("none",)], "c string")
    got = [tuple(r) for r in df.select(*campaigns.campaign_objectives(F.col("c"))).collect()]
    assert got == [("think", "traffic"), (None, None)]


@pytest.mark.parametrize(
    "host, path, expected",
    [
        ("www.a.example", "www.a.example/index.html", "homepage"),
        ("www.a.example", "www.a.example/index.html?x=1#y", "homepage"),
        ("www.a.example", "www.a.example/index.html&x=1", "homepage"),
        ("www.a.example", "www.a.example/models/index.html", "other"),
        ("www.skip.example", "www.skip.example/index.html", "other"),
        (None, "www.a.example/index.html", "other"),
        ("www.a.example", None, "other"),
    ],
)
def test_landing_class(spark, host, path, expected):
    df = spark.createDataFrame([(host, path)], "host string, path string")
    got = df.select(urls.landing_class(F.col("host"), F.col("path"), "www.skip.example")).first()[0]
    assert got == expected


@pytest.mark.parametrize(
    "text, value",
    [
        ("ep.event_label=FIND%20OUT+MORE", "FIND OUT MORE"),
        ("a=1&ep.event_label=x%26y&b=2", "x&y"),
        ("ep.event_label=&ep.event_label=second", "second"),  # blanks are dropped
        ("ep.event_label=first&ep.event_label=second", "first"),
        ("epXevent_label=x", None),
        ("my_ep.event_label=x", None),
        ("ep.event_label=100%", "100%"),  # a lone percent sign is kept
        ("ep.event_label=%zz%41", "%zzA"),
        ("ep.event_label=a=b", "a=b"),
        ("ep.event_label", None),
        (None, None),
    ],
)
def test_parameter(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(urls.parameter(F.col("t"), "ep.event_label")).first()[0] == value


def test_url_parts(spark):
    df = spark.createDataFrame([("https://A.Example/x?q=1#f?g",), ("http://h",)], "u string")
    got = df.select(urls.site_of(F.col("u")), urls.query_string(F.col("u")), urls.path_key(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [
        ("https://A.Example", "q=1", "a.example/x?q=1#f?g"),
        ("http://h", None, "http://h"),
    ]


def test_ratios_over_nothing(spark):
    assert one(spark, ratios.percentage(F.col("a"), F.col("b")), a=1, b=0) is None
    assert one(spark, ratios.ratio(F.col("a"), F.col("b")), a=1, b=4) == 0.25


def test_two_proportion_z(spark):
    z = one(spark, ratios.two_proportion_z(*map(F.col, "abcd")), a=10, b=100, c=20, d=100)
    assert z == pytest.approx(1.9803, abs=1e-4)
    assert one(spark, ratios.two_proportion_z(*map(F.col, "abcd")), a=0, b=100, c=0, d=100) is None
    assert one(spark, ratios.two_proportion_z(*map(F.col, "abcd")), a=0, b=0, c=1, d=10) is None


def test_parameter_equals_the_standard_parser(spark):
    """Random form-encoded strings against urllib's parse_qs."""
    rng = random.Random(8)
    pieces = ["ep.event_label", "ep.event_action", "=", "&", "+", "%20", "%", "%C3%A9", "a", "b c", "x", "%4", "=&", ""]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", urls.parameter(F.col("t"), "ep.event_label").alias("v")).collect()
    assert {r.t: r.v for r in got} == {t: parse_qs(t).get("ep.event_label", [None])[0] for t in texts}
