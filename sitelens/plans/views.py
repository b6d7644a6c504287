"""Web-analytics tables derived from the given tables.

Real deployments store these tables. Here they are computed from ``events``,
``pages`` and ``conversations`` so that every operator has input that grows
with the data. None of them runs a window over a bare session or visitor key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import interactions, visits
from sitelens.operators.weblog import collect_requests, extract_links, parse_merged
from sitelens.sources.files import parse_request_entries
from sitelens.sources.warehouse import scan_table


HIT_COLUMNS = """
    cast(event_id AS string) AS hit_id,
    if(event_type IN ('view', 'error', 'signup'), 'PAGE', 'EVENT') AS hit_type,
    concat(user_id, '-', replace(cast(cast(ts AS date) AS string), '-', '')) AS session_id,
    user_id AS visitor_id,
    k,
    ts AS hit_datetime,
    cast(ts AS date) AS visit_start_date,
    if(user_id % 4 = 3, 'Beta', 'Alpha') AS brand,
    CASE user_id % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' WHEN 3 THEN 'CA' ELSE 'IT' END AS market_code,
    host_name,
    page_group,
    CASE WHEN page_group = 'homepage' THEN concat(host_name, '/index.html', if(k % 2 = 1, '?ref=x', ''))
         ELSE concat(host_name, '/', page_group, '/index.html') END AS page_path,
    CASE WHEN event_type = 'click' AND k < 40 THEN 'BUILD YOUR OWN :: cta-content'
         WHEN event_type = 'click' AND k < 70 THEN 'FIND OUT MORE :: cta-content'
         WHEN event_type = 'purchase' AND k < 50 THEN 'CHECK AVAILABILITY :: secondary-link None' END AS event_label,
    if(k % 10 = 0, 'configurator', 'other') AS content_group_4
"""
PLACED_COLUMNS = """
    *,
    CASE user_id % 3 WHEN 0 THEN 'www.alpha.example' WHEN 1 THEN 'buildyour.alpha.example'
         ELSE 'www.beta.example' END AS host_name,
    CASE k % 6 WHEN 0 THEN 'homepage' WHEN 1 THEN 'inspire' WHEN 2 THEN 'summary' WHEN 3 THEN 'models'
         WHEN 4 THEN 'forms' ELSE 'offers' END AS page_group
"""


def hit(spark: SparkSession, root: str) -> DataFrame:
    """One row per event; hit_number is added only by the operators that need it."""
    return spark.sql(
        f"""
        SELECT {HIT_COLUMNS} FROM (
          SELECT {PLACED_COLUMNS} FROM (
            SELECT event_id, ts, user_id, event_type, cast(regexp_extract(props, '[0-9]+', 0) AS int) AS k
            FROM {{events}}))
        """,
        events=scan_table(spark, root, "events"),
    )


# Traffic columns follow from k, the number on the session's first hit.
SESSION_COLUMNS = """
    * EXCEPT (k),
    CASE visitor_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device_category,
    CASE k % 4 WHEN 0 THEN 'Paid Search' WHEN 1 THEN 'Organic' WHEN 2 THEN 'Paid Social' ELSE 'Direct' END AS channel_grouping,
    CASE k % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'bing' WHEN 2 THEN 'facebook' ELSE '(direct)' END AS source,
    CASE k % 4 WHEN 0 THEN 'cpc' WHEN 1 THEN 'organic' WHEN 2 THEN 'display' ELSE '(none)' END AS medium,
    CASE k % 3 WHEN 0 THEN 'https://www.alpha.example/' WHEN 1 THEN 'https://search.example/' END AS referrer,
    CASE WHEN k % 7 = 0 THEN NULL
         WHEN k % 7 < 5 THEN concat(market_code, if(k % 2 = 0, '_nv_', '_'), 'mk_a5', k % 3, '0_',
           CASE k % 3 WHEN 0 THEN 'dis' WHEN 1 THEN 'psoc' ELSE 'vod' END, '_do_conv_gmc', 1 + k % 9, '000')
         ELSE 'brandx' END AS campaign
"""


def session(spark: SparkSession, root: str) -> DataFrame:
    """Sessions with totals from their hits and traffic columns from the first hit."""
    built = visits.session_totals(hit(spark, root), first=["k"]).withColumnRenamed("first_k", "k")
    return spark.sql(f"SELECT {SESSION_COLUMNS} FROM {{built}}", built=built)


def lookup_interaction(spark: SparkSession) -> DataFrame:
    """Five literal rows, which Spark knows to be small."""
    return spark.sql("""
        SELECT * FROM VALUES
          (1, 'Gallery view', 1, 0),
          (5, 'Configuration start', 1, 0),
          (11, 'Configuration complete', 1, 0),
          (20, 'Test drive request', 0, 1),
          (21, 'Brochure download', 1, 1)
        AS t(interaction_id, interaction_desc, engagement_flag, enquiry_flag)
    """)


def lookup_market(spark: SparkSession) -> DataFrame:
    return spark.sql("""
        SELECT * FROM VALUES
          ('US', 'United States', 'North America'),
          ('CA', 'Canada', 'North America'),
          ('GB', 'United Kingdom', 'Europe'),
          ('DE', 'Germany', 'Europe')
        AS t(market_code, market_name, region)
    """)


# Which hits fire which interaction: interaction_id -> condition on the hit.
INTERACTION_RULES: dict[int, Callable[[], Column]] = {
    1: lambda: F.col("k") < 25,
    5: lambda: F.col("k").between(20, 59),
    11: lambda: F.col("k").between(50, 69),
    20: lambda: F.col("k").between(65, 79),
    21: lambda: F.col("k").between(75, 84),
}
NAMEPLATES = {"AERO": "nameplate_aero", "BRISK": "nameplate_brisk", "CREST": "nameplate_crest"}
TOUCHPOINTS: dict[str, Callable[[], Column]] = {
    "Config": lambda: F.col("page_group").isin("inspire", "summary"),
    "Forms": lambda: F.col("page_group") == "forms",
    "ApprovedUsed": lambda: F.col("k") % 11 == 0,
    "BuildYourOwn": lambda: F.col("event_label") == "BUILD YOUR OWN :: cta-content",
    "SavedBuilds": lambda: (F.col("content_group_4") == "configurator") & (F.col("hit_type") == "EVENT"),
    "OffersFinance": lambda: F.col("page_group") == "offers",
    "ModelsSpecifications": lambda: F.col("page_group") == "models",
    "Electric": lambda: F.col("k") % 13 == 0,
    "Ownership": lambda: F.col("k") % 17 == 0,
    "Experience": lambda: F.col("k") % 19 == 0,
}
SPECIFIC_ENQUIRIES = (20,)


def classify(events: DataFrame) -> DataFrame:
    """The interactions of event hits by the rules above."""
    nameplate = F.expr("CASE k % 4 WHEN 0 THEN 'AERO' WHEN 1 THEN 'BRISK' WHEN 2 THEN 'CREST' ELSE 'NONE' END")
    rules = {i: rule() for i, rule in INTERACTION_RULES.items()}
    return interactions.hit_interactions(events, rules, nameplate)


def hit_interaction_nameplate(spark: SparkSession, root: str) -> DataFrame:
    return classify(hit(spark, root).where(F.col("hit_type") == "EVENT"))


def session_interaction_nameplate(spark: SparkSession, root: str) -> DataFrame:
    return interactions.session_interactions(hit_interaction_nameplate(spark, root), lookup_interaction(spark))


def session_flags(spark: SparkSession, root: str) -> DataFrame:
    return interactions.session_flags(
        session(spark, root),
        hit(spark, root),
        session_interaction_nameplate(spark, root),
        {name: rule() for name, rule in TOUCHPOINTS.items()},
        NAMEPLATES,
        SPECIFIC_ENQUIRIES,
    )


def session_clusters(spark: SparkSession, root: str) -> DataFrame:
    """The cluster of every session."""
    name = F.when(F.col("bounced_session") == 1, "Bounce").when(F.col("total_hits") >= 5, "Deep").otherwise("Browse")
    return session(spark, root).select("session_id", name.alias("cluster_name"))


def known_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Clusters as a second table knows them, which lacks some visitors: a left join meets sessions without one."""
    some = session(spark, root).where(F.col("visitor_id") % 10 != 9).select("session_id")
    return session_clusters(spark, root).join(some, "session_id", "left_semi")


def collect_log(spark: SparkSession, root: str) -> DataFrame:
    """Captured analytics requests, one per page, read from the JSON messages a browser logs."""
    requests = spark.sql(
        """
        SELECT page_id AS request_id,
          if(page_id % 7 = 6, 'Network.responseReceived', 'Network.requestWillBeSent') AS method,
          concat('https://stats.example/',
            CASE page_id % 3 WHEN 0 THEN 'g/collect' WHEN 1 THEN 'mp/collect' ELSE 'static/app.js' END, '?v=2&dl=',
            replace(replace(replace(url, '%', '%25'), '&', '%26'), '#', '%23'),
            if(page_id % 4 < 2,
               concat('&ep%2Eevent_label=FIND%20OUT+MORE%20', length(html) % 50, '&ep.event_action=url_action'), '')) AS url,
          CASE WHEN page_id % 5 < 3
               THEN concat('ep.event_label=EXPLORE%20', length(html) % 60, '&ep.event_category=nav%3A%20cta') END AS body,
          concat('BUTTON ', page_id % 3) AS button_text
        FROM {pages}
        """,
        pages=scan_table(spark, root, "pages"),
    )
    message = F.struct(
        "method",
        F.struct(F.struct("url", F.col("body").alias("postData")).alias("request")).alias("params"),
        "button_text",
    )
    logged = requests.select("request_id", F.to_json(F.struct(message.alias("message"))).alias("message"))
    return parse_request_entries(logged)


def captured_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels of the captured events, without the number some end with and with the kind of link; hits need not have them."""
    label = F.regexp_replace("event_label", " [0-9]+$", "")
    events = parse_merged(collect_requests(collect_log(spark, root))).where("event_label <> ''")
    return events.select(F.concat(label, F.lit(" :: cta-content")).alias("event_label")).distinct()


def offer_pages(spark: SparkSession, root: str) -> DataFrame:
    """A list of pages that is a table."""
    return hit(spark, root).where("page_group IN ('offers', 'models')").select("page_path").distinct()


def link_terms(spark: SparkSession, root: str) -> DataFrame:
    """A catalog that grows with the data: per host the last parts of the links on its pages."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    term = F.regexp_extract("link", "/([^/?#]+)$", 1)
    return page_links(spark, root).select(host.alias("table_name"), term.alias("term")).where("term <> ''").distinct()


def query_log(spark: SparkSession, root: str) -> DataFrame:
    """Conversation messages; a message's text is the question asked."""
    question = F.col("text")
    started = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = started + F.make_dt_interval(F.lit(0), F.col("conv_id"), F.col("turn"), F.lit(0))
    return scan_table(spark, root, "conversations").select(
        F.col("conv_id").alias("session_id"),
        "turn",
        F.col("role").alias("message_type"),
        question.alias("content"),
        question.alias("natural_language_query"),
        F.md5(question).alias("query_hash"),
        at.alias("timestamp"),
    )


def link_edges(spark: SparkSession, root: str) -> DataFrame:
    pages = scan_table(spark, root, "pages").select("page_id")
    n = pages.agg(F.count("*").alias("n")).scalar()
    sides = F.explode(F.array((F.col("page_id") * 2 + 1) % n, (F.col("page_id") * 3) % n))
    return pages.select(F.col("page_id").alias("src"), sides.alias("dst"))


LINK_MARKETS = ("GB", "DE", "FR", "XX")


def page_links(spark: SparkSession, root: str) -> DataFrame:
    """Same-site links of each page, with the market its language stands for."""
    return extract_links(scan_table(spark, root, "pages")).withColumn(
        "market_code",
        _pick_language(F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1)),
    )


def _pick_language(code: Column) -> Column:
    return F.when(code == "en", "GB").when(code == "de", "DE").when(code == "fr", "FR").otherwise("XX")


def page_metrics(spark: SparkSession, root: str) -> DataFrame:
    return visits.page_metrics(hit(spark, root), session(spark, root))


def element_stats(spark: SparkSession, root: str) -> DataFrame:
    """Impressions (page hits) and clicks (labelled hits) per page group and hit."""
    return hit(spark, root).select(
        F.col("page_group").alias("element"),
        "market_code",
        "visit_start_date",
        (F.col("hit_type") == "PAGE").cast("int").alias("impressions"),
        F.col("event_label").isNotNull().cast("int").alias("clicks"),
    )
