"""Readers, writers, catalog look-ups, cost and layout."""

import json
from datetime import date

import duckdb
import pytest
from pyspark.sql import types as T

from sitelens import catalog
from sitelens.operators import weblog
from sitelens.runtime import cut_lineage
from sitelens.sources import files, warehouse
from tests.conftest import rows

ROOT = "/root/testdata/sf0.001"


def test_run_query_cap_and_parameters(spark):
    events = warehouse.scan_table(spark, ROOT, "events")
    text = "SELECT event_id FROM {events} WHERE user_id >= :low ORDER BY event_id"
    assert warehouse.run_query(spark, text, 3, {"low": 0}, events=events).count() == 3
    for everything in (None, 0):
        assert warehouse.run_query(spark, text, everything, {"low": 0}, events=events).count() == events.count()


def test_preview(spark):
    got = warehouse.preview(spark.range(25))
    assert got["row_count"] == 25 and got["columns"] == ["id"]
    assert [r["id"] for r in got["preview_data"]] == list(range(10))


def test_csv_round_trip_and_column_names(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([("GB", "a,b", 3), ("DE", 'say "x"', 4)], "Market_Code string, Page_Path string, SessionsCount int")
    files.write_csv(df, path)
    back = files.read_page_metrics(spark, path, df.schema)
    assert back.columns == ["market_code", "page_path", "SessionsCount"]
    assert rows(back) == rows(df)
    assert dict(files.read_page_metrics(spark, path).dtypes)["SessionsCount"] == "string"


def test_csv_by_market(spark, tmp_path):
    path = tmp_path / "links"
    files.write_csv(spark.createDataFrame([("GB", "u1"), ("DE", "u2")], "market_code string, link string"), str(path), by_market=True)
    assert sorted(p.name for p in path.glob("market_code=*")) == ["market_code=DE", "market_code=GB"]


def test_feedback_is_appended(spark, tmp_path):
    path = str(tmp_path / "feedback")
    for text in ("one", "two"):
        files.append_feedback(spark.createDataFrame([(text, "fix")], "sql_query string, corrections string"), path)
    assert rows(spark.read.json(path).select("sql_query", "corrections")) == [("one", "fix"), ("two", "fix")]


def test_request_log_skips_malformed(spark, tmp_path):
    path = tmp_path / "log.json"
    good = {"message": {"method": "m", "params": {"request": {"url": "u", "postData": "p"}}, "button_text": "b"}}
    bare = {"message": {"method": "m", "params": {}}}
    lines = [
        json.dumps({"message": json.dumps(good)}), "{broken", json.dumps({"message": "not json"}),
        json.dumps({"other": 1}), json.dumps({"message": json.dumps(bare)}),
    ]
    path.write_text("\n".join(lines))
    found = files.read_request_log(spark, str(path))
    assert rows(found.drop("request_id")) == [("m", "u", "p", "b"), ("m", None, None, None)]


def test_request_log_to_events(spark, tmp_path):
    """Nested and flat entries of a log end as event fields."""
    request = {"url": "https://x/g/collect?ep%2Eevent_label=A", "postData": "ep.event_action=go"}
    nested = {"message": {"method": "Network.requestWillBeSent", "params": {"request": request}, "button_text": "Buy"}}
    flat = {"url": "https://x/mp/collect?v=2", "body": "ep.event_label=B+C", "timestamp": "2024-01-01"}
    path = tmp_path / "requests.json"
    path.write_text("\n".join(map(json.dumps, [{"message": json.dumps(nested)}, flat, flat | {"url": "https://x/app.js"}, {"timestamp": "1"}])))
    events = weblog.parse_merged(weblog.collect_requests(files.read_request_log(spark, str(path))))
    assert rows(events.drop("request_id")) == [("A", "go", "", "Buy"), ("B C", "", "", "")]
    assert events.select("request_id").distinct().count() == 2


def test_describe_table(spark):
    schema = T.StructType([T.StructField("a", T.LongType(), True, {"comment": "an a"}), T.StructField("b", T.StringType())])
    got = warehouse.describe_table(spark.createDataFrame([(1, "x"), (2, "y")], schema))
    assert rows(got) == [(0, "a", "bigint", "an a", 2), (1, "b", "string", None, 2)]
    events = warehouse.scan_table(spark, ROOT, "events")
    assert warehouse.describe_table(events, warehouse.file_created(events)).first().created is not None


def test_list_tables(spark):
    spark.range(1).createOrReplaceTempView("listed_view")
    assert "default" in warehouse.list_datasets(spark)
    assert "listed_view" in warehouse.list_tables(spark, "default")


def test_scan_cost(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(1000).repartition(3).write.parquet(str(path))
    size = sum(p.stat().st_size for p in path.glob("*.parquet"))
    got = warehouse.scan_cost(spark, str(path), str(path)).first()  # the same files are not counted twice
    assert got.bytes_processed == size
    assert got.estimated_cost_usd == pytest.approx(size / 1099511627776 * 5)
    priced = warehouse.cost_columns(spark.sql("SELECT 2199023255552 AS bytes_processed")).first()
    assert tuple(priced) == (2199023255552, 2.0, 10.0, "$10.000000")


def test_query_cost_is_that_of_the_chunks_read(spark, tmp_path):
    path = str(tmp_path / "t")
    days = spark.range(20_000).selectExpr("id", "id % 7 AS k", "repeat(md5(string(id)), 3) AS text", "date_add(DATE '2024-01-01', int(id % 4)) AS day")
    days.repartition(4).write.partitionBy("day").parquet(path)
    chunks = duckdb.sql(f"SELECT * FROM parquet_metadata('{path}/**/*.parquet')").df()

    def expected(columns, day=""):
        own = chunks[chunks["path_in_schema"].isin(columns) & chunks["file_name"].str.contains(f"day={day}")]
        return int(own["total_compressed_size"].sum())

    t = spark.read.parquet(path)

    def cost(sql):
        return warehouse.query_cost(warehouse.run_query(spark, sql, t=t)).first()

    assert cost("SELECT * FROM {t}").bytes_processed == expected(["id", "k", "text"])
    assert cost("SELECT k, count(*) FROM {t} GROUP BY k").bytes_processed == expected(["k"])
    assert cost("SELECT sum(id) FROM {t} WHERE day = DATE '2024-01-02' AND k > 3").bytes_processed == expected(["id", "k"], "2024-01-02")
    twice = cost("SELECT id FROM {t} WHERE k > (SELECT avg(k) FROM {t})")
    assert twice.bytes_processed == expected(["id", "k"]) + expected(["k"])
    assert twice.estimated_cost_usd == pytest.approx(twice.bytes_processed / 1099511627776 * 5)
    assert cost("SELECT day FROM {t}").bytes_processed == 0
    assert warehouse.query_cost(spark.range(5)).first().estimated_cost_formatted == "$0.000000"


def test_every_cluster_column_prunes(spark, tmp_path):
    path = tmp_path / "clustered"
    made = spark.range(150_000).selectExpr(
        "id", "int(id * 2654435761 % 97) AS property", "concat('s', id * 40503 % 31) AS source", "double(id * 7919 % 53) AS medium",
        "if(id % 11 = 0, NULL, concat('c', lpad(string(id * 104729 % 64), 2, '0'))) AS campaign", "DATE '2024-01-01' AS day",
    )
    columns = ["property", "source", "medium", "campaign"]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "150")  # as row groups of a large file
    try:
        files.write_layout(made, str(path), "day", columns)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert spark.read.parquet(str(path)).select(*made.columns).exceptAll(made).isEmpty()
    ranges = duckdb.sql(f"SELECT path_in_schema AS c, stats_min_value AS low, stats_max_value AS high FROM parquet_metadata('{path}/**/*.parquet')").fetchall()
    for column, value, kind in (("campaign", "c40", str), ("source", "s17", str), ("medium", 20.0, float), ("property", 50, int)):
        own = [(kind(low), kind(high)) for c, low, high in ranges if c == column and low is not None]
        read = sum(low <= value <= high for low, high in own)
        assert len(own) >= 800 and read <= 0.3 * len(own), (column, read, len(own))


def test_layout_of_nulls_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, None, date(2024, 1, 1)), (2, None, date(2024, 1, 1))], "id int, source string, day date")
    for name, some in (("nulls", df), ("empty", df.limit(0))):
        files.write_layout(some, str(tmp_path / name), "day", ["source", "id"])
    assert spark.read.parquet(str(tmp_path / "nulls")).count() == 2


def test_layout_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "session")
    data = [(f"s{i}", date(2024, 1, 1 + i % 5), "US" if i % 2 else "GB") for i in range(100)]
    df = spark.createDataFrame(data, "session_id string, visit_start_date date, market_code string")
    files.write_layout(df, path, "visit_start_date", ["market_code"])
    back = spark.read.parquet(path)
    one_day = back.where("visit_start_date = DATE '2024-01-03'")
    assert rows(back.select(*df.columns)) == rows(df)
    assert one_day.select("_metadata.file_path").distinct().count() <= 2
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(visit_start_date" in plan


def test_contract_builds_a_table(spark):
    empty = spark.createDataFrame([], catalog.contract("visitor_day"))
    assert dict(empty.dtypes)["visit_start_date"] == "date"
    assert not empty.schema["visitor_day_id"].nullable


def test_checkpoint_uses_the_named_folder(spark):
    before = spark.sparkContext.getCheckpointDir()
    assert cut_lineage(spark.range(5)).count() == 5
    assert spark.sparkContext.getCheckpointDir() is not None
    assert before is None or spark.sparkContext.getCheckpointDir() == before
