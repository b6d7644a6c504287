"""Every registered query: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.catalog import default_schema
from sitelens.functions.urls import path_key
from sitelens.operators import (
    crawl,
    funnel,
    history,
    interactions,
    metrics,
    pagestats,
    periods,
    reports,
    retrieval,
    visits,
    weblog,
)
from sitelens.operators.scope import in_scope
from sitelens.plans import views
from sitelens.runtime import scratch_path
from sitelens.sources import files, warehouse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FIRST_DAY, LAST_DAY = "2024-01-01", "2024-01-31"
BRAND = "Alpha"
MARKETS = ("GB", "DE", "US", "IT")
CTR_LABELS = ("BUILD YOUR OWN :: cta-content", "FIND OUT MORE :: cta-content")
HOSTS = ("www.alpha.example", "buildyour.alpha.example", "www.beta.example")
FUNNEL_PAGES = tuple(
    f"{host}/{page}"
    for host in HOSTS
    for page in ("index.html", "index.html?ref=x", "models/index.html")
)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def register(name: str, function: Query) -> None:
    QUERIES[name] = function


def _hits(spark: SparkSession, root: str) -> DataFrame:
    return views.hit(spark, root).where(in_scope(FIRST_DAY, LAST_DAY, BRAND))


def _sessions(spark: SparkSession, root: str, markets=None) -> DataFrame:
    return views.session(spark, root).where(in_scope(FIRST_DAY, LAST_DAY, BRAND, markets))


# --- scans and catalog -------------------------------------------------------


@query
def scan_table(spark, root):
    return warehouse.scan_table(spark, root, "nation")


@query
def run_query(spark, root):
    text = """
        SELECT session_id, visitor_id, total_hits FROM {sessions}
        WHERE brand = :brand ORDER BY total_hits DESC, session_id
    """
    return warehouse.run_query(spark, text, 1000, {"brand": BRAND}, sessions=views.session(spark, root))


@query
def describe_table(spark, root):
    return warehouse.describe_table(warehouse.scan_table(spark, root, "events"))


@query
def scan_cost(spark, root):
    tables = ("events", "pages", "conversations", "embeddings")
    return warehouse.scan_cost(spark, *[f"{root}/{t}.parquet" for t in tables])


@query
def query_cost(spark, root):
    """What three queries over the given tables would read, none of them run."""
    texts = {
        "one column": "SELECT count(DISTINCT user_id) AS n FROM {events}",
        "all columns": "SELECT * FROM {events}",
        "a join": "SELECT d.lang, count(*) AS n FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.toxic = 1 GROUP BY 1",
    }
    tables = {t: warehouse.scan_table(spark, root, t) for t in ("events", "documents", "labels")}
    costs = [
        warehouse.query_cost(warehouse.run_query(spark, text, **tables)).select(F.lit(name).alias("query"), "*")
        for name, text in texts.items()
    ]
    return reduce(DataFrame.unionByName, costs)


@query
def preview(spark, root):
    shown = warehouse.preview(warehouse.scan_table(spark, root, "events"))
    row = (shown["row_count"], ", ".join(shown["columns"]), len(shown["preview_data"]))
    return spark.createDataFrame([row], "row_count long, column_names string, preview_rows long")


@query
def page_metrics_csv(spark, root):
    """Page metrics written as CSV and read back with lower-case column names."""
    path = scratch_path(spark)
    metrics = views.page_metrics(spark, root).select("market_code", "page_path", "SessionsCount", "sessions_bounced")
    files.write_csv(metrics.withColumnsRenamed({"market_code": "Market_Code", "page_path": "Page_Path"}), path)
    return files.read_page_metrics(spark, path, metrics.schema)


@query
def feedback_file(spark, root):
    """Feedback appended to JSON lines in two batches and read back."""
    path = scratch_path(spark)
    log = views.query_log(spark, root)
    for kind in ("user", "assistant"):
        some = log.where(F.col("message_type") == kind)
        files.append_feedback(some.select(F.col("content").alias("sql_query"), F.col("query_hash").alias("corrections")), path)
    return spark.read.schema("sql_query string, corrections string").json(path)


@query
def clustered_layout(spark, root):
    """One day of sessions, read from a layout by day that is clustered by four columns."""
    path = scratch_path(spark)
    columns = ["source", "medium", "campaign", "market_code"]
    sessions = views.session(spark, root).select("session_id", "visit_start_date", *columns)
    files.write_layout(sessions, path, "visit_start_date", columns)
    day = spark.read.parquet(path).where("visit_start_date = DATE '2024-01-09' AND source = 'google'")
    return day.select("session_id", "visit_start_date", *columns)


# --- flagship ------------------------------------------------------------------


@query
def page_ctr(spark, root):
    return funnel.page_ctr(
        views.hit(spark, root),
        views.session(spark, root),
        FUNNEL_PAGES,
        CTR_LABELS,
        FIRST_DAY,
        "2024-01-28",
        BRAND,
        ("US", "CA", "GB"),
    )


@query
def ctr_by_label(spark, root):
    clicked = views.hit(spark, root).where(F.col("event_label").endswith(":: cta-content"))
    return funnel.page_ctr(
        views.hit(spark, root),
        views.session(spark, root),
        FUNNEL_PAGES,
        clicked.select("event_label").distinct(),
        FIRST_DAY,
        "2024-01-28",
        BRAND,
        ("US", "CA", "GB"),
    )


@query
def ctr_by_captured_label(spark, root):
    """Labels from the requests a browser logged, pages from a table."""
    return funnel.page_ctr(
        views.hit(spark, root),
        views.session(spark, root),
        views.offer_pages(spark, root),
        views.captured_labels(spark, root),
        FIRST_DAY,
        "2024-01-28",
        BRAND,
        ("US", "CA", "GB"),
    )


# --- counts over hits and sessions ----------------------------------------------


@query
def session_count(spark, root):
    return reports.distinct_count(_sessions(spark, root, MARKETS), "session_id", "num_sessions")


@query
def total_pageviews(spark, root):
    return reports.total_pageviews(_hits(spark, root))


@query
def config_sessions(spark, root):
    return reports.config_sessions(_hits(spark, root), "buildyour", "www.range.example")


@query
def landing_like(spark, root):
    return reports.landing_like(_hits(spark, root), "%/index.html")


@query
def landing_group(spark, root):
    return reports.landing_groups(_hits(spark, root), "buildyour.alpha.example")


@query
def top_landing_group(spark, root):
    return reports.top_landing_group(_hits(spark, root), "buildyour.alpha.example")


@query
def mobile_sessions(spark, root):
    return reports.row_count(_sessions(spark, root).where(F.col("device_category") == "mobile"), "mobile_sessions")


@query
def desktop_sessions(spark, root):
    return reports.row_count(_sessions(spark, root).where(F.col("device_category") == "desktop"), "desktop_sessions")


def _by_session_column(column: str, name: str) -> Query:
    return lambda spark, root: reports.distinct_by(_sessions(spark, root).withColumnRenamed(column, name), name)


register("sessions_by_source", _by_session_column("source", "session_first_source"))
register("sessions_by_medium", _by_session_column("medium", "session_first_medium"))
register("sessions_by_channel", _by_session_column("channel_grouping", "session_first_channel_grouping"))
register("sessions_by_market", _by_session_column("market_code", "market_code"))


@query
def avg_session_minutes(spark, root):
    return reports.avg_session_minutes(_sessions(spark, root, MARKETS))


@query
def avg_session_minutes_by_market(spark, root):
    return reports.avg_session_minutes(_sessions(spark, root), "market_code")


@query
def total_minutes_by_market(spark, root):
    return reports.total_minutes(_sessions(spark, root), "market_code")


@query
def avg_pages_per_session(spark, root):
    return reports.avg_pages_per_session(_sessions(spark, root))


@query
def pages_per_session(spark, root):
    return reports.pages_per_session(_sessions(spark, root))


@query
def single_page_sessions(spark, root):
    return reports.single_page_sessions(_hits(spark, root))


@query
def multi_page_sessions(spark, root):
    return reports.multi_page_sessions(_hits(spark, root))


@query
def single_vs_multi(spark, root):
    return reports.single_vs_multi(_hits(spark, root))


@query
def avg_page_count(spark, root):
    return reports.avg_page_count(_hits(spark, root))


@query
def page_sequences(spark, root):
    return reports.page_sequences(_hits(spark, root))


@query
def visitors_by_dims(spark, root):
    return reports.visitors_by_dims(
        views.hit(spark, root),
        views.session(spark, root),
        FUNNEL_PAGES,
        FIRST_DAY,
        LAST_DAY,
        BRAND,
        ("US", "CA", "GB"),
    )


@query
def visitors_of_listed_pages(spark, root):
    return reports.visitors_by_dims(
        views.hit(spark, root),
        views.session(spark, root),
        views.offer_pages(spark, root),
        FIRST_DAY,
        LAST_DAY,
        BRAND,
        ("US", "CA", "GB"),
    )


@query
def weekly_visitors(spark, root):
    return reports.weekly_visitors(
        views.hit(spark, root), views.session(spark, root), "%/models/index.html", FIRST_DAY, LAST_DAY, BRAND
    )


@query
def visitors_in_market(spark, root):
    return metrics.visitors(views.session(spark, root).where(in_scope(FIRST_DAY, LAST_DAY, markets=["US"])))


@query
def visitors_by_device(spark, root):
    us = views.session(spark, root).where(in_scope(FIRST_DAY, LAST_DAY, markets=["US"]))
    return metrics.visitors_by(us, "device_category")


@query
def new_returning(spark, root):
    return visits.new_returning(_sessions(spark, root))


@query
def new_returning_pct(spark, root):
    return visits.new_returning_pct(_sessions(spark, root))


# --- campaigns -------------------------------------------------------------------


@query
def campaign_parts(spark, root):
    return reports.campaign_parts(_sessions(spark, root))


@query
def campaign_objective(spark, root):
    return reports.campaign_objective(views.session(spark, root))


@query
def media_channel(spark, root):
    return reports.media_channels(views.session(spark, root))


@query
def campaign_first_channel(spark, root):
    return reports.campaign_first_channel(_sessions(spark, root))


# --- session flags and clusters ----------------------------------------------------


@query
def session_flags(spark, root):
    return views.session_flags(spark, root)


def _flagged(name: str, condition: Callable, distinct: bool = False) -> Query:
    count = reports.flagged_distinct_sessions if distinct else reports.flagged_sessions
    return lambda spark, root: count(views.session_flags(spark, root), condition(), name)


def _touched(test: Callable) -> Callable:
    return lambda: test(reports.nameplates_touched(list(views.NAMEPLATES.values())))


register(
    "config_start_sessions",
    _flagged("sessions_with_config_start", lambda: F.col("sessions_with_config_start") > 0),
)
register("engaged_sessions", _flagged("sessions_with_engagement", lambda: F.col("sessions_with_any_engagement") > 0))
register(
    "start_and_complete_sessions",
    _flagged(
        "sessions_with_config_start_and_complete",
        lambda: (F.col("sessions_with_config_start") > 0) & (F.col("sessions_with_config_completes") > 0),
    ),
)
register(
    "other_enquiry_sessions",
    _flagged("sessions_with_other_enquiry", lambda: F.col("sessions_with_enquiry_other") > 0, distinct=True),
)
register("touchpoint_electric", _flagged("sessions_with_electric", lambda: F.col("Electric") == 1))
register(
    "build_your_own_sessions",
    _flagged("sessions_with_build_your_own", lambda: F.col("BuildYourOwn") == 1, distinct=True),
)
register("zero_brand", _flagged("zero_brand_sessions", _touched(lambda n: n == 0)))
register("single_brand", _flagged("single_brand_sessions", _touched(lambda n: n == 1)))
register("multi_brand", _flagged("multi_brand_sessions", _touched(lambda n: n > 1)))


@query
def brand_interactions(spark, root):
    named = {flag: f"{flag}_sessions" for flag in views.NAMEPLATES.values()}
    return reports.nameplate_interactions(views.session_flags(spark, root), named)


@query
def touchpoint_totals(spark, root):
    named = {flag: f"total_{flag.lower()}" for flag in views.TOUCHPOINTS if flag != "Config"}
    return reports.flag_totals(views.session_flags(spark, root), named)


@query
def interaction_totals(spark, root):
    named = {
        "sessions_with_config_start": "total_config_starts",
        "sessions_with_config_completes": "total_config_completes",
        "sessions_with_any_enquiry": "total_enquiries",
    }
    return reports.flag_totals(views.session_flags(spark, root), named)


@query
def campaign_performance(spark, root):
    return reports.campaign_performance(views.session_flags(spark, root))


@query
def config_sessions_by_campaign(spark, root):
    configured = views.session_flags(spark, root).where(F.col("Config") == 1)
    return reports.distinct_by(configured, "session_first_campaign", name="sessions_with_config")


@query
def duplicate_sessions(spark, root):
    return reports.duplicate_keys(views.session_interaction_nameplate(spark, root), "session_id")


@query
def landing_exit(spark, root):
    columns = [
        "session_id",
        F.col("page_sequence_1").alias("landing_page_group"),
        F.col("session_last_page_group").alias("exit_page_group"),
    ]
    return reports.first_rows(views.session_flags(spark, root), columns, "session_id")


@query
def session_first_touch(spark, root):
    columns = ["session_id", "session_first_channel_grouping", "session_first_source", "session_first_medium"]
    return reports.first_rows(views.session_flags(spark, root), columns, "session_id")


@query
def visitor_vs_session_channel(spark, root):
    columns = ["session_id", "visitor_first_channel_grouping", "session_first_channel_grouping"]
    return reports.first_rows(views.session_flags(spark, root), columns, "session_id")


@query
def campaign_detail(spark, root):
    columns = [
        "session_id",
        "session_first_campaign",
        "cmp_brand",
        "cmp_channel",
        "cmp_market",
        "cmp_nameplate",
        "sessions_with_config_start",
        "sessions_with_config_completes",
        "sessions_with_any_engagement",
        "sessions_with_any_enquiry",
    ]
    return reports.first_rows(views.session_flags(spark, root), columns, "session_id")


@query
def sessions_per_cluster(spark, root):
    return reports.distinct_by(views.session_clusters(spark, root), "cluster_name")


@query
def market_cluster_cross(spark, root):
    return reports.market_cluster_cross(views.session_flags(spark, root), views.known_clusters(spark, root))


# --- derived tables and windows -----------------------------------------------------


@query
def hit_numbering(spark, root):
    return visits.hit_numbering(views.hit(spark, root).select("hit_id", "session_id", "hit_datetime")).drop(
        "hit_datetime"
    )


@query
def entrance_exit(spark, root):
    return visits.entrance_exit(views.hit(spark, root)).select("hit_id", "session_id", "entrance", "exit")


@query
def previous_group(spark, root):
    needed = views.hit(spark, root).select("hit_id", "session_id", "hit_datetime", "page_group")
    return visits.previous_group(needed, "page_group").drop("hit_datetime")


@query
def first_touch(spark, root):
    return visits.first_touch(views.session(spark, root)).select(
        "session_id", "visitor_id", "visitor_first_channel_grouping", "channel_grouping"
    )


@query
def session_build(spark, root):
    return visits.session_build(views.hit(spark, root))


@query
def hit_interactions(spark, root):
    numbered = visits.hit_numbering(views.hit(spark, root))
    return views.classify(numbered.where(F.col("hit_type") == "EVENT"))


@query
def session_interactions(spark, root):
    return views.session_interaction_nameplate(spark, root)


@query
def enquiry_sessions(spark, root):
    rows = views.session_interaction_nameplate(spark, root).where(in_scope(FIRST_DAY, LAST_DAY))
    return reports.distinct_count(rows.where(F.col("enquiry_flag") == 1), "session_id", "sessions_with_enquiry")


@query
def config_complete_sessions(spark, root):
    rows = views.session_interaction_nameplate(spark, root).where(in_scope(FIRST_DAY, LAST_DAY))
    completed = rows.where(F.col("interaction_id") == metrics.CONFIG_COMPLETE)
    return reports.distinct_count(completed, "session_id", "sessions_with_config_completes")


@query
def engaged_session_list(spark, root):
    rows = views.session_interaction_nameplate(spark, root).where(in_scope(FIRST_DAY, LAST_DAY))
    return rows.where(F.col("engagement_flag") == 1).select("session_id").distinct()


@query
def visitor_day(spark, root):
    return interactions.visitor_day(
        views.session(spark, root), views.hit_interaction_nameplate(spark, root), views.lookup_interaction(spark)
    )


def _rollup(grain: str) -> Query:
    return lambda spark, root: interactions.visitor_interaction_rollup(
        views.session(spark, root),
        views.hit_interaction_nameplate(spark, root),
        views.lookup_interaction(spark),
        views.lookup_market(spark),
        grain,
    )


for _grain in ("month", "week", "day"):
    register(f"visitor_{_grain}_interaction", _rollup(_grain))


@query
def market_enrich(spark, root):
    counted = reports.distinct_by(views.session(spark, root), "market_code")
    return reports.market_enrich(counted, views.lookup_market(spark))


# --- named metrics ---------------------------------------------------------------------


def _metric(metric: str, *by: str) -> Query:
    return lambda spark, root: metrics.visitor_metric(
        views.hit_interaction_nameplate(spark, root),
        views.lookup_interaction(spark),
        metric,
        by,
    )


register("enquired_visitors", _metric("enquired_visitors", "market_code"))
register("engaged_visitors", _metric("engaged_visitors", "market_code"))
register("uev_enq", _metric("uev_enq", "market_code"))
register("uev_enq_by_day", _metric("uev_enq", "market_code", "visit_start_date"))
register("config_start", _metric("config_start"))
register("config_completions", _metric("config_completions"))


# --- history store ------------------------------------------------------------------------


def _touches(spark: SparkSession, root: str) -> DataFrame:
    return views.query_log(spark, root).select(
        "session_id",
        "timestamp",
        "turn",
        F.concat(F.lit('{"first": "'), F.col("message_type"), F.lit('"}')).alias("metadata"),
    )


def _stored_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions as of their opening message; the later messages arrive as touches."""
    return (
        _touches(spark, root)
        .where("turn = 0")
        .select(
            "session_id", F.col("timestamp").alias("created_at"), F.col("timestamp").alias("last_interaction"), "metadata"
        )
    )


def _all_sessions(spark: SparkSession, root: str) -> DataFrame:
    later = _touches(spark, root).where("turn > 0").drop("turn")
    return history.session_upsert(_stored_sessions(spark, root), later)


def _asked(spark: SparkSession, root: str) -> DataFrame:
    """The questions of users, each asked again a day later."""
    log = views.query_log(spark, root).where(F.col("message_type") == "user")
    once = log.select("session_id", "turn", "natural_language_query", F.col("content").alias("sql_query"), "timestamp")
    again = once.select(
        "session_id",
        F.col("turn") + 1000,
        "natural_language_query",
        F.concat("sql_query", F.lit(" again")),
        F.expr("timestamp + INTERVAL 1 DAY"),
    )
    long = F.length("sql_query") > 200
    return once.union(again).withColumn("complexity", F.when(long, "COMPLEX").otherwise("SIMPLE"))


def _opening_queries(spark: SparkSession, root: str) -> DataFrame:
    return history.query_upsert(_asked(spark, root).where("turn <= 1").drop("turn"))


@query
def query_hash(spark, root):
    return views.query_log(spark, root).select(
        "session_id", "turn", history.query_hash(F.col("content")).alias("content_hash")
    )


@query
def session_upsert(spark, root):
    return _all_sessions(spark, root)


@query
def query_upsert(spark, root):
    later = _asked(spark, root).where("turn > 1").drop("turn")
    return history.query_upsert(later, _opening_queries(spark, root).drop("query_hash"))


@query
def session_store(spark, root):
    """Sessions after the opening messages and the later ones went into a bucketed store one after the other."""
    path = scratch_path(spark)
    touches = _touches(spark, root)
    for some in (touches.where("turn = 0"), touches.where("turn > 0")):
        history.upsert_sessions(some.drop("turn"), path, 16)
    return history.read_store(spark, path)


@query
def query_store(spark, root):
    """Queries after the first turns and the later ones went into a bucketed store one after the other."""
    path = scratch_path(spark)
    asked = _asked(spark, root)
    for some in (asked.where("turn <= 1"), asked.where("turn > 1")):
        history.upsert_queries(some.drop("turn"), path, 16)
    return history.read_store(spark, path)


@query
def message_store(spark, root):
    """The message files after all messages came once, and those of users again."""
    path = scratch_path(spark)
    log = views.query_log(spark, root).select("session_id", "turn", "message_type", "content", "timestamp")
    for some in (log, log.where("message_type = 'user'")):
        history.store_messages(some, path)
    return spark.read.parquet(path).drop("day")


@query
def conversation_history(spark, root):
    return history.conversation_history(views.query_log(spark, root)).select(
        "session_id", "turn", "message_type", "content", "timestamp"
    )


@query
def lookup_by_hash(spark, root):
    asked = _asked(spark, root).select("session_id", "turn", "natural_language_query")
    return history.lookup_by_hash(asked, _opening_queries(spark, root))


@query
def session_info(spark, root):
    return history.session_info(_all_sessions(spark, root), 7)


@query
def recent_sessions(spark, root):
    return history.recent_sessions(_all_sessions(spark, root))


@query
def feedback_join(spark, root):
    log = views.query_log(spark, root).withColumnRenamed("turn", "message_id")
    answered = log.where(F.col("message_type") == "assistant")
    first = answered.select(
        "session_id",
        "message_id",
        (1 + F.length("content") % 5).alias("rating"),
        F.when(F.length("content") % 2 == 0, F.col("natural_language_query")).alias("feedback_text"),
    )
    second = answered.select(
        "session_id", "message_id", (1 + F.length("content") % 3).alias("rating"), F.lit(None).alias("feedback_text")
    )
    feedback = first.unionByName(second)
    return history.feedback_by_message(log.select("session_id", "message_id", "message_type"), feedback)


# --- retrieval ---------------------------------------------------------------------------------


@query
def knn_l2(spark, root):
    vectors = warehouse.scan_table(spark, root, "embeddings").select("vec_id", "embedding")
    return retrieval.knn_l2(vectors, vectors, 3).withColumn("distance", F.round("distance", 6))


@query
def split_pairs(spark, root):
    log = views.query_log(spark, root)
    pair = F.concat("natural_language_query", F.lit(" => "), "content")
    documents = log.select(
        "session_id", "turn", F.when(F.col("message_type") == "user", pair).otherwise(F.col("content")).alias("content")
    )
    return retrieval.split_pairs(documents)


def _questions(spark: SparkSession, root: str) -> DataFrame:
    log = views.query_log(spark, root).where(F.col("message_type") == "user")
    breakdown = F.when(F.col("turn") % 6 == 0, " by device_category").when(F.col("turn") % 6 == 2, " per Month_ID")
    return log.select(
        F.concat_ws("-", "session_id", "turn").alias("question_id"),
        F.concat("content", F.coalesce(breakdown, F.lit(""))).alias("question"),
    )


@query
def match_tables(spark, root):
    return retrieval.match_tables(_questions(spark, root), default_schema()["tables"]).select(
        "question_id", "table_name"
    )


@query
def match_term_table(spark, root):
    found = retrieval.match_term_table(_questions(spark, root), views.link_terms(spark, root))
    return found.select("question_id", "table_name")


@query
def select_catalog(spark, root):
    return retrieval.select_catalog(_questions(spark, root), default_schema())


# --- captured requests, links and pages ------------------------------------------------------------


@query
def collect_requests(spark, root):
    return weblog.collect_requests(views.collect_log(spark, root))


@query
def parse_merged(spark, root):
    return weblog.parse_merged(weblog.collect_requests(views.collect_log(spark, root)))


@query
def parse_fallback(spark, root):
    return weblog.parse_fallback(weblog.collect_requests(views.collect_log(spark, root)))


@query
def extract_links(spark, root):
    return weblog.extract_links(warehouse.scan_table(spark, root, "pages"))


@query
def all_links(spark, root):
    return weblog.links_by_market(views.page_links(spark, root))


@query
def distinct_links(spark, root):
    return weblog.distinct_links(views.page_links(spark, root))


@query
def path_match_key(spark, root):
    return warehouse.scan_table(spark, root, "pages").select("page_id", path_key(F.col("url")).alias("path_key"))


@query
def link_closure(spark, root):
    return crawl.link_closure(views.link_edges(spark, root), [0])


@query
def site_closure(spark, root):
    """Pages and links reached from all page addresses, over the links found in the pages."""
    links = views.page_links(spark, root).select(F.col("url").alias("src"), F.col("link").alias("dst"))
    start = warehouse.scan_table(spark, root, "pages").where("url IS NOT NULL").select("url")
    return crawl.link_closure(links, start)


@query
def clickable(spark, root):
    found = weblog.clickable(warehouse.scan_table(spark, root, "pages"), text="the")
    return found


def _crawled(spark: SparkSession, root: str) -> DataFrame:
    """Crawled URLs: the configurator host's pages, as a crawler would report them."""
    paths = views.hit(spark, root).where(F.col("host_name") == HOSTS[1]).select("page_path").distinct()
    return paths.select(F.concat(F.lit("https://"), F.col("page_path")).alias("link"))


@query
def crawled_path_flag(spark, root):
    return pagestats.crawled_path_flag(views.page_metrics(spark, root), _crawled(spark, root)).select(
        "market_code", "page_path", "page_path_check"
    )


def _kept(spark: SparkSession, root: str) -> DataFrame:
    return pagestats.keep_pages(views.page_metrics(spark, root), _crawled(spark, root), ("US", "GB", "DE"), 80, 100)


@query
def keep_pages(spark, root):
    return _kept(spark, root).select("market_code", "page_path", "SessionsCount", "page_path_check", "keep")


@query
def keep_check_counts(spark, root):
    return pagestats.keep_check_counts(_kept(spark, root))


@query
def page_metric_stats(spark, root):
    sessions = visits.session_order(views.session(spark, root))
    stats = pagestats.page_metric_stats(views.hit(spark, root), sessions, views.session_interaction_nameplate(spark, root))
    exact = ("market_code", "page_path", "SessionsCount")
    return stats.select(*exact, *[F.round(c, 6).alias(c) for c in stats.columns if c not in exact])


@query
def metric_histogram(spark, root):
    return pagestats.metric_histogram(views.session(spark, root), "time_on_site_seconds").withColumn(
        "bin_start", F.round("bin_start", 4)
    )


@query
def normality_test(spark, root):
    tested = pagestats.normality_test(views.session(spark, root), ["time_on_site_seconds", "total_hits"])
    return tested.withColumn("jarque_bera", F.round("jarque_bera", 4)).withColumn(
        "jarque_bera_p", F.round("jarque_bera_p", 6)
    )


@query
def shapiro_test(spark, root):
    tested = pagestats.shapiro_francia(views.session(spark, root), ["time_on_site_seconds", "total_hits"], "session_id")
    return tested.withColumn("shapiro_w", F.round("shapiro_w", 6)).withColumn("shapiro_p", F.round("shapiro_p", 6))


# --- periods and hypotheses ---------------------------------------------------------------------------


PERIOD_A, PERIOD_B = ("2024-01-01", "2024-01-14"), ("2024-01-15", "2024-01-28")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query
def analyze_ctr(spark, root):
    return _rounded(periods.analyze_ctr(views.element_stats(spark, root)), "ctr")


@query
def analyze_performance(spark, root):
    compared = periods.analyze_performance(views.element_stats(spark, root), PERIOD_A, PERIOD_B)
    return _rounded(compared, "ctr_a", "ctr_b", "ctr_change")


@query
def significance(spark, root):
    compared = periods.analyze_performance(views.element_stats(spark, root), PERIOD_A, PERIOD_B)
    return _rounded(periods.significance(compared).select("element", "z", "significant"), "z")


@query
def metric_table(spark, root):
    return _rounded(periods.metric_table(periods.analyze_ctr(views.element_stats(spark, root))), "value")


@query
def validate_columns(spark, root):
    return periods.validate_columns(
        warehouse.scan_table(spark, root, "events"),
        {"user_id": "bigint", "value": "double", "event_type": "int", "props": "double"},
    )


@query
def segment_rate_compare(spark, root):
    rows = views.hit_interaction_nameplate(spark, root).join(views.lookup_interaction(spark), "interaction_id")
    compared = periods.segment_rate_compare(
        views.hit(spark, root),
        rows.where(F.col("enquiry_flag") == 1).select("hit_id"),
        {"homepage": F.col("page_group") == "homepage", "models": F.col("page_group") == "models"},
    )
    return _rounded(compared, "rate_a", "rate_b", "rate_change", "z")
