"""The skew-safe operators against the plain window or join, with one hot key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelens.operators.skew import flag_members, hot_keys, in_runs, joined_text, numbered, preceding, salted_join, tally
from tests.conftest import rows

START = datetime(2024, 1, 1, 23, 58)


@pytest.fixture(scope="module")
def hits(spark):
    """Key 'bot' owns a third of the rows; times repeat; keys, times and values may be missing."""
    rng = random.Random(5)
    data = []
    for i in range(3000):
        key = "bot" if i % 3 == 0 else rng.choice(["a", "b", "c", "d", None])
        at = None if i % 97 == 0 else START + timedelta(seconds=rng.randrange(400))
        data.append((i, key, at, rng.choice(["x", "y", "z", None])))
    return spark.createDataFrame(data, "id long, key string, at timestamp_ntz, value string").cache()


#: (most, least): no key is cut, the hot key alone, every key.
CUTS = [(None, 20_000), (20, 300), (100, 10)]


@pytest.mark.parametrize("most, least", CUTS)
def test_numbered_equals_row_number(hits, most, least):
    plain = hits.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("at", "id")).cast("bigint"))
    assert rows(numbered(hits, ["key"], "at", ["id"], "n", most, least)) == rows(plain)


@pytest.mark.parametrize("most, least", CUTS)
def test_preceding_equals_lag(hits, most, least):
    plain = hits.withColumn("p", F.lag("value").over(Window.partitionBy("key").orderBy("at", "id")))
    assert rows(preceding(hits, ["key"], "at", ["id"], "value", "p", most, least)) == rows(plain)


@pytest.mark.parametrize("most, least", CUTS)
def test_tally_equals_running_count(hits, most, least):
    whole = Window.partitionBy("key")
    x = F.when(F.col("value") == "x", 1)
    plain = hits.withColumns({"seen": F.count(x).over(whole.orderBy("at", "id")), "total": F.count(x).over(whole)})
    assert rows(tally(hits, ["key"], "at", ["id"], F.col("value") == "x", "seen", "total", most, least)) == rows(plain)


@pytest.mark.parametrize("most, least", CUTS)
def test_joined_text_equals_sorted_join(hits, most, least):
    expected = {}
    for r in sorted(hits.collect(), key=lambda r: (r.at is not None, r.at or START, r.id)):
        expected.setdefault(r.key, []).extend([r.value] if r.value is not None else [])
    found = joined_text(hits, ["key"], "at", ["id"], "value", " > ", "text", most, least).collect()
    assert {r.key: r.text for r in found} == {k: " > ".join(v) for k, v in expected.items()}


@pytest.fixture(scope="module")
def crowded(spark):
    """One key with 100,000 hits inside one minute and 100,000 without a time, among 100,000 others."""
    at = F.when(F.col("id") < 100_000, F.lit(START) + F.make_dt_interval(secs=F.col("id") % 60))
    at = F.when(F.col("id") >= 200_000, F.lit(START) + F.make_dt_interval(hours=F.col("id") % 700)).otherwise(at)
    key = F.when(F.col("id") < 200_000, "bot").otherwise(F.concat(F.lit("v"), F.col("id") % 9000))
    crowd = spark.range(300_000).select("id", key.alias("key"), at.cast("timestamp_ntz").alias("at"))
    return crowd.withColumn("value", F.when(F.col("id") % 7 > 0, F.col("id") % 5)).cache()


def test_crowded_minute_is_cut(crowded):
    runs = in_runs(crowded, ["key"], ["at", "id"], 100, 1000)
    sizes = [r["count"] for r in runs.rows.where("_is_cut").groupBy(*runs.by).count().collect()]
    assert sum(sizes) == 200_000 and len(sizes) >= 60 and max(sizes) < 2 * 3000
    task = F.spark_partition_id().alias("task")
    numbers = numbered(crowded, ["key"], "at", ["id"], "n", 400, 100).groupBy(task).count()
    sizes = [r["count"] for r in numbers.collect()]
    assert sum(sizes) == 300_000 and len(sizes) > 1 and max(sizes) < 2 * 300_000 / len(sizes)


def test_crowded_minute_equals_plain_window(crowded):
    key = Window.partitionBy("key").orderBy("at", "id")
    for found, plain in (
        (numbered(crowded, ["key"], "at", ["id"], "n", 100, 1000), F.row_number().over(key)),
        (preceding(crowded, ["key"], "at", ["id"], "value", "n", 100, 1000), F.lag("value").over(key)),
    ):
        expected = crowded.withColumn("n", plain.cast("bigint")).select("id", F.col("n").alias("m"))
        wrong = found.select("id", "n").join(expected, "id").where("NOT n <=> m")
        assert found.count() == 300_000 and wrong.isEmpty()


def test_repeated_rows_are_numbered_once_each(spark):
    df = spark.createDataFrame([(1, "k", START)] * 50 + [(2, "k", None)] * 50, "id long, key string, at timestamp_ntz")
    found = numbered(df, ["key"], "at", ["id"], "n", 10, 5)
    assert sorted(r.n for r in found.collect()) == list(range(1, 101))
    assert {r.n for r in found.where("id = 2").collect()} == set(range(1, 51))
    assert numbered(df.limit(0), ["key"], "at", ["id"], "n", 10, 5).isEmpty()


def test_joined_text_of_only_nulls_is_null(spark):
    df = spark.createDataFrame([(1, START, None)], "key int, at timestamp_ntz, value string")
    assert rows(joined_text(df, ["key"], "at", [], "value", " > ", "text")) == [(1, None)]


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_salted_join_equals_left_join(spark, hits, most):
    dims = spark.createDataFrame([("bot", 1, "B"), ("a", 2, "A"), ("q", 3, "Q")], "key string, n int, name string")
    plain = hits.join(dims, "key", "left").select(*hits.columns, "n", "name")
    assert rows(salted_join(hits, dims, "key", ["id"], most)) == rows(plain)


def test_hot_keys_are_few(hits):
    for most in (1, 2, 4, 50, 1000):
        found = hot_keys(hits, "key", most).collect()
        assert len(found) < max(most, 2) and sum(r.parts for r in found) < max(2 * most, 2)
    assert [tuple(r) for r in hot_keys(hits, "key", 4).collect()] == [("bot", 2)]
    assert dict(tuple(r) for r in hot_keys(hits, "key", 30).collect())["bot"] == 10


def test_hot_key_is_dealt_over_tasks(spark, hits):
    """No shuffle partition of the join holds more than a small part of the hot key."""
    dims = spark.createDataFrame([("bot", 1)], "key string, n int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false")):
            spark.conf.set(k, v)
        joined = salted_join(hits, dims, "key", ["id"], 100).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in joined.where("key = 'bot'").groupBy("task").count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 1000 and max(sizes) < 400 and len(sizes) >= 6


def test_flag_members(spark, hits):
    members = spark.createDataFrame([("bot",), ("bot",), ("zzz",), (None,)], "k string")
    flagged = flag_members(hits, "key", members, "known", ["id"], 4)
    assert flagged.count() == 3000
    assert {(r.key, r.known) for r in flagged.collect()} == {
        ("bot", 1), ("a", 0), ("b", 0), ("c", 0), ("d", 0), (None, 0)
    }
