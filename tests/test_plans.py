"""What the physical plans of the main operators must and must not contain."""

import re

import pytest

from sitelens.operators import funnel, metrics, reports, visits
from sitelens.operators.skew import numbered
from sitelens.plans import views
from sitelens.plans.registry import CTR_LABELS, FUNNEL_PAGES
from sitelens.sources import files

ROOT = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """hit and session written in their contract layout."""
    base = str(tmp_path_factory.mktemp("layout"))
    files.write_table(views.hit(spark, ROOT), f"{base}/hit", "hit")
    files.write_table(views.session(spark, ROOT), f"{base}/session", "session")
    return spark.read.parquet(f"{base}/hit"), spark.read.parquet(f"{base}/session")


def funnel_on(stored, **change):
    args = dict(
        pages=FUNNEL_PAGES, labels=CTR_LABELS, start="2024-01-02", end="2024-01-05", brand="Alpha", markets=["US", "GB"]
    )
    return funnel.page_ctr(*stored, **(args | change))


def test_funnel_reads_hits_once_and_prunes_both_tables(stored):
    scans = [section for section in formatted(funnel_on(stored)).split("\n\n") if "Scan parquet" in section and "ReadSchema" in section]
    assert len(scans) == 2
    for scan in scans:
        kept = re.search(r"PartitionFilters: (.*)", scan).group(1)
        assert "2024-01-02" in kept and "2024-01-05" in kept
    hit_scan = next(s for s in scans if "page_path" in s)
    assert "In(page_path" in re.search(r"PushedFilters: (.*)", hit_scan).group(1)
    read = re.search(r"ReadSchema: (.*)", hit_scan).group(1)
    assert "page_path" in read and "content_group_4" not in read and "host_name" not in read


def test_funnel_has_no_hit_grain_join(stored):
    """The only join meets sessions, after hits were aggregated."""
    text = plan(funnel_on(stored))
    assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", text)) == 1


def test_funnel_scans_only_the_days_asked_for(stored):
    hits, _ = stored
    pruned = funnel_on(stored)
    pruned.collect()
    days = hits.where("visit_start_date BETWEEN '2024-01-02' AND '2024-01-05'").select("_metadata.file_path").distinct()
    assert days.count() == 4


def test_config_sessions_pushes_filters(stored):
    text = plan(reports.config_sessions(stored[0].where("brand = 'Alpha'"), "buildyour", "x"))
    assert "EqualTo(brand,Alpha)" in text and "EqualTo(hit_type,PAGE)" in text


def test_distinct_counts_do_not_expand_rows(spark, stored):
    metric = metrics.interaction_visitors(
        views.hit_interaction_nameplate(spark, ROOT), views.lookup_interaction(spark)
    )
    assert plan(metric).count("FileScan") == 1  # the interactions alone; no second reading of the hits
    assert "Expand" not in plan(metric) and "Expand" not in plan(funnel_on(stored))


def test_numbering_shuffles_the_hits_once(stored):
    """One exchange carries the rows; with a hot key cut into runs the others carry one row per run."""
    hits = stored[0].select("hit_id", "session_id", "hit_datetime", "hit_type")
    for found in (visits.hit_numbering(hits), visits.entrance_exit(hits)):
        text = plan(found)
        assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
        assert "Window [" in text and "Join" not in text
    text = plan(numbered(hits, ["session_id"], "hit_datetime", ["hit_id"], "n", 1000, 2))
    carriers = [e for e in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text) if "_run" in e]
    assert len(carriers) == 2  # rows by (key, run), and counts by (key, run)
    assert "Window [row_number()" in text and "CartesianProduct" not in text



def test_bucketed_tables_join_without_shuffle(spark, stored):
    hits, sessions = stored
    files.write_bucketed(hits.select("session_id", "hit_id"), "bucketed_hit", "session_id", 4, ["hit_id"])
    files.write_bucketed(sessions.select("session_id", "source"), "bucketed_session", "session_id", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table("bucketed_hit").join(spark.table("bucketed_session"), "session_id")
        assert "Exchange" not in plan(joined) and joined.count() == hits.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE bucketed_hit")
        spark.sql("DROP TABLE bucketed_session")
