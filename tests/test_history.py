"""History store upserts and look-ups."""

import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from sitelens.operators import history
from tests.conftest import rows


def t(n):
    return datetime(2024, 1, 1, 0, n)


def test_session_upsert(spark):
    stored = spark.createDataFrame(
        [("a", t(5), t(5), '{"x":1}'), ("b", t(1), t(2), None)],
        "session_id string, created_at timestamp_ntz, last_interaction timestamp_ntz, metadata string",
    )
    touches = spark.createDataFrame(
        [("a", t(9), "new"), ("b", t(3), "new"), ("c", t(8), None), ("c", t(7), "first"), ("a", t(4), "early")],
        "session_id string, timestamp timestamp_ntz, metadata string",
    )
    assert rows(history.session_upsert(stored, touches)) == [
        ("a", t(5), t(9), '{"x":1}'), ("b", t(1), t(3), None), ("c", t(7), t(8), "first"),
    ]


QUERIES = "session_id string, natural_language_query string, sql_query string, complexity string, timestamp timestamp_ntz"


def test_query_upsert_has_a_winner_per_column(spark):
    stored = spark.createDataFrame([("s1", "q1", "old", "SIMPLE", t(1))], QUERIES)
    asked = spark.createDataFrame(
        [("s2", "q1", "newest", "COMPLEX", t(9)), ("s3", "q1", "newer", "SIMPLE", t(5)), ("s4", "q2", "only", "SIMPLE", t(2))],
        QUERIES,
    )
    got = history.query_upsert(asked, stored)
    h = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert {tuple(r) for r in got.collect()} == {
        (h("q1"), "s1", "q1", "newest", "COMPLEX", t(9)), (h("q2"), "s4", "q2", "only", "SIMPLE", t(2)),
    }


def test_lookup_misses_stay(spark):
    stored = history.query_upsert(spark.createDataFrame([("s1", "q1", "sql", "SIMPLE", t(1))], QUERIES))
    asked = spark.createDataFrame([(1, 0, "q1"), (1, 1, "zz"), (2, 0, None)], "session_id int, turn int, natural_language_query string")
    got = history.lookup_by_hash(asked, stored).select("session_id", "turn", "sql_query")
    assert rows(got) == [(1, 0, "sql"), (1, 1, None), (2, 0, None)]


def test_messages_append_and_history_order(spark, tmp_path):
    schema = "session_id string, turn int, message_type string, content string, query_type string, sql_query string, timestamp timestamp_ntz"
    path = str(tmp_path / "messages")
    history.store_messages(spark.createDataFrame([("a", 1, "user", "two", None, None, t(2))], schema), path)
    history.store_messages(spark.createDataFrame([("a", 0, "user", "one", None, None, t(1)), ("b", 0, "user", "x", None, None, t(0))], schema), path)
    stored = spark.read.parquet(path)
    assert [r.content for r in history.conversation_history(stored, "a").collect()] == ["one", "two"]
    assert [r.content for r in history.conversation_history(stored).collect()] == ["one", "two", "x"]
    assert history.conversation_history(stored, "none").count() == 0


def test_messages_appended_again_stay_once(spark, tmp_path):
    schema = "session_id string, turn int, content string, timestamp timestamp_ntz"
    path = str(tmp_path / "messages")
    first = spark.createDataFrame([("a", 0, "one", t(1)), ("a", 1, "two", t(2)), ("b", 0, None, None), (None, None, "x", t(3))], schema)
    more = first.unionByName(spark.createDataFrame([("a", 2, "new", t(4)), ("a", 2, "new", t(4)), ("c", 0, "late", datetime(2024, 1, 2))], schema))
    for batch in (first, first, more, more, first.limit(0)):
        history.store_messages(batch, path)
    expected = rows(more.distinct())
    assert rows(spark.read.parquet(path).select(*first.columns)) == expected and len(expected) == 6
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "messages").rglob("*.parquet")}
    history.store_messages(spark.createDataFrame([("d", 0, "n", datetime(2024, 1, 3))], schema), path)
    assert all(f.stat().st_mtime_ns == at for f, at in before.items())


def touches_of(spark, pairs):
    return spark.createDataFrame([(k, t(n), f"m{n}") for k, n in pairs], "session_id string, timestamp timestamp_ntz, metadata string")


def test_store_equals_upserts_of_the_whole(spark, tmp_path):
    path = str(tmp_path / "sessions")
    batches = [[(f"s{i % 40}", (7 * i) % 50) for i in range(start, start + 60)] for start in (0, 30, 90)]
    whole = spark.createDataFrame([], "session_id string, created_at timestamp_ntz, last_interaction timestamp_ntz, metadata string")
    for some in batches:
        history.upsert_sessions(touches_of(spark, some), path, 8)
        whole = history.session_upsert(whole, touches_of(spark, some))
    assert rows(history.read_store(spark, path)) == rows(whole)
    assert history.upsert_sessions(touches_of(spark, batches[0]).limit(0), path, 8) == 0
    history.upsert_sessions(touches_of(spark, batches[2]), path, 8)  # a batch may be run again
    assert rows(history.read_store(spark, path)) == rows(whole)


def test_query_store_equals_upserts_of_the_whole(spark, tmp_path):
    path = str(tmp_path / "queries")
    batches = [
        [(f"s{i}", f"question {i % 13}", f"sql {i}", "SIMPLE", t((11 * i) % 59)) for i in range(start, start + 25)] for start in (0, 10, 50)
    ]
    whole = None
    for some in batches:
        history.upsert_queries(spark.createDataFrame(some, QUERIES), path, 4)
        whole = history.query_upsert(spark.createDataFrame(some, QUERIES), whole and whole.drop("query_hash"))
    assert rows(history.read_store(spark, path)) == rows(whole)


def test_only_touched_buckets_are_read_and_replaced(spark, tmp_path):
    path = tmp_path / "sessions"
    history.upsert_sessions(touches_of(spark, [(f"s{i}", i % 60) for i in range(400)]), str(path), 16)
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    few = touches_of(spark, [("s1", 59), ("s2", 59), ("s1", 58)])
    scanned = []

    def merge(stored, new):
        scanned.append(stored)
        return history.session_upsert(stored, new)

    touched = history.upsert_store(few, str(path), F.col("session_id"), merge, buckets=16)
    plan = scanned[0]._jdf.queryExecution().executedPlan().toString()
    assert touched <= 2 and "PartitionFilters: [" in plan and "key_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    after = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    folders = lambda files: {f.parent.name for f in files}
    assert folders(before) == folders(after) and len(folders(before)) == 16
    assert len(folders(set(before) ^ set(after))) == touched
    same = set(before) & set(after)
    assert len(folders(same)) == 16 - touched and all(before[f] == after[f] for f in same)


def test_recent_sessions_and_info(spark):
    sessions = spark.createDataFrame([(f"s{i:02}", t(i)) for i in range(20)], "session_id string, last_interaction timestamp_ntz")
    assert [r.session_id for r in history.recent_sessions(sessions, 3).collect()] == ["s19", "s18", "s17"]
    assert history.session_info(sessions, "s05").count() == 1
    assert history.session_info(sessions, "nope").count() == 0


def test_feedback_by_message(spark):
    messages = spark.createDataFrame([("a", 1), ("a", 2)], "session_id string, message_id int")
    feedback = spark.createDataFrame(
        [("a", 1, 5, "good"), ("a", 1, 2, None), ("zz", 9, 1, "orphan")],
        "session_id string, message_id int, rating int, feedback_text string",
    )
    assert rows(history.feedback_by_message(messages, feedback)) == [("a", 1, 2, 3.5, 1), ("a", 2, 0, None, 0)]
