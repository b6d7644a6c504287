"""Every registered query against its DuckDB statement."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


#: The text operators have their own tests beside them.
NAMES = [n for n in entry.queries() if n not in entry.LLM_QUERIES]


@pytest.mark.parametrize("name", NAMES)
def test_matches_check_sql(spark, duck, name):
    good, note = compare(spark, duck, name, ROOT)
    assert good, note
    assert "{" not in note, f"types differ: {note}"


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) - set(entry.oracle_sql()) == {"scan_cost", "query_cost"}


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[-3:] == ["total_page_visitors", "ctr_visitors", "total_bounced_visitor"]


def test_no_pairwise_joins(spark):
    """No plan contains a cross or nested-loop join."""
    for name in NAMES:
        plan = entry.queries()[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_shuffle_partition_count_does_not_matter(spark):
    names = ("page_ctr", "session_flags", "hit_numbering", "previous_group", "page_sequences", "query_upsert")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for partitions in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            results.append({n: sorted(map(str, entry.queries()[n](spark, ROOT).collect())) for n in names})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
