"""Reports with small known answers."""

import random
from collections import Counter
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from sitelens.operators import reports
from sitelens.operators.scope import in_scope
from tests.conftest import rows

HITS = "session_id string, hit_id long, hit_datetime timestamp_ntz, hit_type string, page_group string"


def test_page_sequences_with_huge_sessions(spark):
    """Two equal bots and one that differs after page 1,000."""
    rng = random.Random(2)
    start, data = datetime(2024, 1, 1), []
    bot = [rng.choice("abc") for _ in range(1300)]
    plans = {"bot1": bot, "bot2": bot, "bot3": bot[:-1] + ["zzz"], "empty": [None, None]}
    plans |= {f"s{i}": [rng.choice(["a", "b", None]) for _ in range(rng.randrange(1, 4))] for i in range(200)}
    for session, groups in plans.items():
        for i, group in enumerate(groups):
            at = start + timedelta(seconds=i // 2 * 20)  # pairs share a time and are ordered by id
            data.append((session, len(data), at, "PAGE", group))
            data.append((session, 10**6 + len(data), at, "EVENT", "x"))
    texts = {s: " > ".join(g for g in groups if g is not None) or None for s, groups in plans.items()}
    counted = Counter(texts.values())
    first = {text: min(s for s in texts if texts[s] == text) for text in counted}
    best = sorted(counted.items(), key=lambda x: (-x[1], first[x[0]]))[:30]
    got = reports.page_sequences(spark.createDataFrame(data, HITS), 30)
    assert [tuple(r) for r in got.collect()] == best
    bots = [n for text, n in counted.items() if text and len(text) > 500]
    assert sorted(bots) == [1, 2]


def test_scope_bounds_are_inclusive(spark):
    df = spark.createDataFrame(
        [(date(2024, 1, d), "A", m) for d in (1, 2, 3) for m in ("US", "GB", None)],
        "visit_start_date date, brand string, market_code string",
    )
    assert df.where(in_scope("2024-01-01", "2024-01-02")).count() == 6
    assert df.where(in_scope(date(2024, 1, 2), None, "A", ["US"])).count() == 2
    assert df.where(in_scope()).count() == 9


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("c",), ("c",), ("c",)], "session_id string")
    assert [tuple(r) for r in reports.duplicate_keys(df, "session_id").collect()] == [("c", 3), ("a", 2)]


def test_first_rows(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") * 2).alias("twice"))
    assert [r.id for r in reports.first_rows(df, ["id"], "id", 100).collect()] == list(range(100))
    assert reports.first_rows(df, ["id"], "id").count() == 200


def test_sessions_without_cluster_stay(spark):
    flags = spark.createDataFrame([("s1", "US"), ("s2", "US"), ("s3", "GB")], "session_id string, market_code string")
    clusters = spark.createDataFrame([("s1", "Deep")], "session_id string, cluster_name string")
    assert rows(reports.market_cluster_cross(flags, clusters)) == [("GB", None, 1), ("US", "Deep", 1), ("US", None, 1)]


def test_nameplates_touched(spark):
    df = spark.createDataFrame([(1, None, 1), (None, None, None), (1, 0, 0)], "a int, b int, c int")
    assert [r[0] for r in df.select(reports.nameplates_touched(["a", "b", "c"])).collect()] == [2, 0, 1]


def test_empty_inputs(spark):
    hits = spark.createDataFrame([], HITS)
    assert rows(reports.single_vs_multi(hits)) == [(0, 0)]
    assert rows(reports.avg_page_count(hits)) == [(None,)]
    assert reports.page_sequences(hits).count() == 0
