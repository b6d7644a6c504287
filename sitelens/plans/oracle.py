"""Check SQL for DuckDB: one statement per registered query.

The statements are written from the meaning of each report, in the plain form
(windows, quadratic joins) that the Spark operators avoid. Views are prefixed
as common table expressions.
"""

from __future__ import annotations

import json
import re

VIEWS: dict[str, str] = {}

VIEWS["hit"] = """
SELECT cast(event_id AS string) AS hit_id,
       CASE WHEN event_type IN ('view','error','signup') THEN 'PAGE' ELSE 'EVENT' END AS hit_type,
       session_id, visitor_id, k,
       row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS hit_number,
       ts AS hit_datetime, cast(ts AS date) AS visit_start_date,
       CASE WHEN visitor_id % 4 = 3 THEN 'Beta' ELSE 'Alpha' END AS brand,
       CASE visitor_id % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' WHEN 3 THEN 'CA' ELSE 'IT' END AS market_code,
       host_name, page_group,
       CASE WHEN page_group = 'homepage' THEN concat(host_name, '/index.html', CASE WHEN k % 2 = 1 THEN '?ref=x' ELSE '' END)
            ELSE concat(host_name, '/', page_group, '/index.html') END AS page_path,
       CASE WHEN event_type = 'click' AND k < 40 THEN 'BUILD YOUR OWN :: cta-content'
            WHEN event_type = 'click' AND k < 70 THEN 'FIND OUT MORE :: cta-content'
            WHEN event_type = 'purchase' AND k < 50 THEN 'CHECK AVAILABILITY :: secondary-link None' END AS event_label,
       CASE WHEN k % 10 = 0 THEN 'configurator' ELSE 'other' END AS content_group_4
FROM (SELECT event_id, ts, event_type, user_id AS visitor_id,
             concat(cast(user_id AS string), '-', replace(cast(cast(ts AS date) AS string), '-', '')) AS session_id,
             cast(regexp_extract(props, '[0-9]+', 0) AS int) AS k,
             CASE user_id % 3 WHEN 0 THEN 'www.alpha.example' WHEN 1 THEN 'buildyour.alpha.example' ELSE 'www.beta.example' END AS host_name,
             CASE cast(regexp_extract(props, '[0-9]+', 0) AS int) % 6 WHEN 0 THEN 'homepage' WHEN 1 THEN 'inspire' WHEN 2 THEN 'summary'
                  WHEN 3 THEN 'models' WHEN 4 THEN 'forms' ELSE 'offers' END AS page_group
      FROM events) e
"""

VIEWS["session"] = """
SELECT a.*, row_number() OVER (PARTITION BY visitor_id ORDER BY visit_start_date) AS session_number,
       date_sub('second', visit_start_datetime, last_hit_datetime) AS time_on_site_seconds,
       CASE visitor_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device_category,
       CASE first_k % 4 WHEN 0 THEN 'Paid Search' WHEN 1 THEN 'Organic' WHEN 2 THEN 'Paid Social' ELSE 'Direct' END AS channel_grouping,
       CASE first_k % 4 WHEN 0 THEN 'google' WHEN 1 THEN 'bing' WHEN 2 THEN 'facebook' ELSE '(direct)' END AS source,
       CASE first_k % 4 WHEN 0 THEN 'cpc' WHEN 1 THEN 'organic' WHEN 2 THEN 'display' ELSE '(none)' END AS medium,
       CASE first_k % 3 WHEN 0 THEN 'https://www.alpha.example/' WHEN 1 THEN 'https://search.example/' END AS referrer,
       CASE WHEN first_k % 7 = 0 THEN NULL
            WHEN first_k % 7 < 5 THEN concat(market_code, CASE WHEN first_k % 2 = 0 THEN '_nv_' ELSE '_' END, 'mk_a5', cast(first_k % 3 AS string), '0_',
              CASE first_k % 3 WHEN 0 THEN 'dis' WHEN 1 THEN 'psoc' ELSE 'vod' END, '_do_conv_gmc', cast(1 + first_k % 9 AS string), '000')
            ELSE 'brandx' END AS campaign
FROM (SELECT session_id, visitor_id, visit_start_date, brand, market_code,
             min(hit_datetime) AS visit_start_datetime,
             count(*) AS total_hits,
             count(CASE WHEN hit_type = 'PAGE' THEN 1 END) AS total_page_views,
             CASE WHEN count(CASE WHEN hit_type = 'PAGE' THEN 1 END) = 1 THEN 1 ELSE 0 END AS bounced_session,
             CASE WHEN count(CASE WHEN hit_type = 'EVENT' THEN 1 END) > 0 THEN 1 ELSE 0 END AS got_interaction_event,
             max(CASE WHEN hit_number = 1 THEN k END) AS first_k,
             max(hit_datetime) AS last_hit_datetime
      FROM hit GROUP BY session_id, visitor_id, visit_start_date, brand, market_code) a
"""

VIEWS["lookup_interaction"] = """
SELECT * FROM (VALUES (1,'Gallery view',1,0),(5,'Configuration start',1,0),(11,'Configuration complete',1,0),
  (20,'Test drive request',0,1),(21,'Brochure download',1,1)) AS t(interaction_id, interaction_desc, engagement_flag, enquiry_flag)
"""

VIEWS["lookup_market"] = """
SELECT * FROM (VALUES ('US','United States','North America'),('CA','Canada','North America'),
  ('GB','United Kingdom','Europe'),('DE','Germany','Europe')) AS t(market_code, market_name, region)
"""

VIEWS["hit_interaction_nameplate"] = """
SELECT concat(hit_id, '-', cast(interaction_id AS string), '-', nameplate_code) AS hit_interaction_nameplate_id,
       hit_id, session_id, hit_number, interaction_id, nameplate_code, visitor_id, visit_start_date, brand, market_code
FROM (SELECT h.*, li.interaction_id,
             CASE k % 4 WHEN 0 THEN 'AERO' WHEN 1 THEN 'BRISK' WHEN 2 THEN 'CREST' ELSE 'NONE' END AS nameplate_code
      FROM hit h JOIN lookup_interaction li
        ON (li.interaction_id = 1 AND k < 25) OR (li.interaction_id = 5 AND k BETWEEN 20 AND 59)
        OR (li.interaction_id = 11 AND k BETWEEN 50 AND 69) OR (li.interaction_id = 20 AND k BETWEEN 65 AND 79)
        OR (li.interaction_id = 21 AND k BETWEEN 75 AND 84)
      WHERE h.hit_type = 'EVENT') x
"""

VIEWS["session_interaction_nameplate"] = """
SELECT hin.session_id, hin.interaction_id, hin.nameplate_code, hin.visit_start_date,
       max(li.enquiry_flag) AS enquiry_flag, max(li.engagement_flag) AS engagement_flag, count(*) AS interaction_hits
FROM hit_interaction_nameplate hin JOIN lookup_interaction li ON hin.interaction_id = li.interaction_id
GROUP BY hin.session_id, hin.interaction_id, hin.nameplate_code, hin.visit_start_date
"""

VIEWS["session_flags"] = """
SELECT s.session_id, s.visitor_id, s.market_code, s.campaign AS session_first_campaign,
       s.channel_grouping AS session_first_channel_grouping, s.source AS session_first_source, s.medium AS session_first_medium,
       first_value(s.channel_grouping) OVER (PARTITION BY s.visitor_id ORDER BY s.visit_start_date) AS visitor_first_channel_grouping,
       p.page_sequence_1, p.session_last_page_group, p.Config, p.Forms, p.ApprovedUsed, p.BuildYourOwn, p.SavedBuilds,
       p.OffersFinance, p.ModelsSpecifications, p.Electric, p.Ownership, p.Experience,
       coalesce(i.sessions_with_config_start, 0) AS sessions_with_config_start,
       coalesce(i.sessions_with_config_completes, 0) AS sessions_with_config_completes,
       coalesce(i.sessions_with_any_engagement, 0) AS sessions_with_any_engagement,
       coalesce(i.sessions_with_any_enquiry, 0) AS sessions_with_any_enquiry,
       coalesce(i.sessions_with_enquiry_other, 0) AS sessions_with_enquiry_other,
       i.nameplate_aero, i.nameplate_brisk, i.nameplate_crest,
       nullif(regexp_extract(lower(s.campaign), '^[a-z]{2}_(?:nv_)?([a-z]{2})_', 1), '') AS cmp_brand,
       nullif(regexp_extract(lower(s.campaign), '(aud|dis|psoc|psocdp|prg|rad|olv|vod|sem|prt|ooh|cin|prog)', 1), '') AS cmp_channel,
       nullif(regexp_extract(lower(s.campaign), '^([a-z]{2})_', 1), '') AS cmp_market,
       nullif(regexp_extract(lower(s.campaign), '^[a-z]{2}_(?:nv_)?[a-z]{2}_([a-z0-9]{2,5})_', 1), '') AS cmp_nameplate
FROM session s
JOIN (SELECT h.session_id, max(CASE WHEN h.hit_number = 1 THEN h.page_group END) AS page_sequence_1,
             max(CASE WHEN h.hit_number = s2.total_hits THEN h.page_group END) AS session_last_page_group,
             max(CASE WHEN h.page_group IN ('inspire','summary') THEN 1 ELSE 0 END) AS Config,
             max(CASE WHEN h.page_group = 'forms' THEN 1 ELSE 0 END) AS Forms,
             max(CASE WHEN h.k % 11 = 0 THEN 1 ELSE 0 END) AS ApprovedUsed,
             max(CASE WHEN h.event_label = 'BUILD YOUR OWN :: cta-content' THEN 1 ELSE 0 END) AS BuildYourOwn,
             max(CASE WHEN h.content_group_4 = 'configurator' AND h.hit_type = 'EVENT' THEN 1 ELSE 0 END) AS SavedBuilds,
             max(CASE WHEN h.page_group = 'offers' THEN 1 ELSE 0 END) AS OffersFinance,
             max(CASE WHEN h.page_group = 'models' THEN 1 ELSE 0 END) AS ModelsSpecifications,
             max(CASE WHEN h.k % 13 = 0 THEN 1 ELSE 0 END) AS Electric,
             max(CASE WHEN h.k % 17 = 0 THEN 1 ELSE 0 END) AS Ownership,
             max(CASE WHEN h.k % 19 = 0 THEN 1 ELSE 0 END) AS Experience
      FROM hit h JOIN session s2 ON h.session_id = s2.session_id GROUP BY h.session_id) p ON s.session_id = p.session_id
LEFT JOIN (SELECT session_id,
             max(CASE WHEN interaction_id = 5 THEN 1 ELSE 0 END) AS sessions_with_config_start,
             max(CASE WHEN interaction_id = 11 THEN 1 ELSE 0 END) AS sessions_with_config_completes,
             max(engagement_flag) AS sessions_with_any_engagement, max(enquiry_flag) AS sessions_with_any_enquiry,
             max(CASE WHEN enquiry_flag = 1 AND interaction_id <> 20 THEN 1 ELSE 0 END) AS sessions_with_enquiry_other,
             max(CASE WHEN nameplate_code = 'AERO' THEN 1 END) AS nameplate_aero,
             max(CASE WHEN nameplate_code = 'BRISK' THEN 1 END) AS nameplate_brisk,
             max(CASE WHEN nameplate_code = 'CREST' THEN 1 END) AS nameplate_crest
           FROM session_interaction_nameplate GROUP BY session_id) i ON s.session_id = i.session_id
"""

VIEWS["session_clusters"] = """
SELECT session_id, CASE WHEN bounced_session = 1 THEN 'Bounce' WHEN total_hits >= 5 THEN 'Deep' ELSE 'Browse' END AS cluster_name
FROM session
"""

VIEWS["known_clusters"] = """
SELECT c.* FROM session_clusters c JOIN session s ON s.session_id = c.session_id WHERE s.visitor_id % 10 <> 9
"""

VIEWS["collect_log"] = """
SELECT page_id AS request_id,
       CASE WHEN page_id % 7 = 6 THEN 'Network.responseReceived' ELSE 'Network.requestWillBeSent' END AS method,
       concat('https://stats.example/', CASE page_id % 3 WHEN 0 THEN 'g/collect' WHEN 1 THEN 'mp/collect' ELSE 'static/app.js' END,
              '?v=2&dl=', replace(replace(replace(url, '%', '%25'), '&', '%26'), '#', '%23'),
         CASE WHEN page_id % 4 < 2 THEN concat('&ep%2Eevent_label=FIND%20OUT+MORE%20', cast(length(html) % 50 AS string), '&ep.event_action=url_action') ELSE '' END) AS url,
       CASE WHEN page_id % 5 < 3 THEN concat('ep.event_label=EXPLORE%20', cast(length(html) % 60 AS string), '&ep.event_category=nav%3A%20cta') END AS body,
       concat('BUTTON ', cast(page_id % 3 AS string)) AS button_text
FROM pages
"""

VIEWS["collected"] = """
SELECT * FROM collect_log WHERE method = 'Network.requestWillBeSent' AND (url LIKE '%g/collect%' OR url LIKE '%mp/collect%')
"""

VIEWS["query_log"] = """
SELECT conv_id AS session_id, turn, role AS message_type, text AS content,
       text AS natural_language_query, md5(text) AS query_hash,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS "timestamp"
FROM conversations
"""

VIEWS["log_sessions"] = """
SELECT session_id, min("timestamp") AS created_at, max("timestamp") AS last_interaction,
       concat('{"first": "', arg_min(message_type, turn), '"}') AS metadata
FROM query_log GROUP BY session_id
"""

VIEWS["asked"] = """
SELECT session_id, turn, query_hash, natural_language_query, sql_query,
       CASE WHEN length(sql_query) > 200 THEN 'COMPLEX' ELSE 'SIMPLE' END AS complexity, "timestamp",
       CASE WHEN turn <= 1 THEN 0 ELSE 1 END AS arrival
FROM (
  SELECT session_id, turn, query_hash, natural_language_query, content AS sql_query, "timestamp"
  FROM query_log WHERE message_type = 'user'
  UNION ALL
  SELECT session_id, turn + 1000, query_hash, natural_language_query, concat(content, ' again'), "timestamp" + INTERVAL 1 DAY
  FROM query_log WHERE message_type = 'user')
"""

VIEWS["link_edges"] = """
SELECT p.page_id AS src, (p.page_id * 2 + 1) % n.n AS dst FROM pages p CROSS JOIN (SELECT count(*) AS n FROM pages) n
UNION ALL SELECT p.page_id AS src, (p.page_id * 3) % n.n AS dst FROM pages p CROSS JOIN (SELECT count(*) AS n FROM pages) n
"""

VIEWS["page_links"] = """
SELECT page_id, url, link,
       CASE regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) WHEN 'en' THEN 'GB' WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' ELSE 'XX' END AS market_code
FROM (SELECT page_id, url, base,
             CASE WHEN href LIKE '/%' THEN concat(base, href) WHEN href LIKE 'http%' THEN href END AS link
      FROM (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+', 0) AS base,
                   replace(unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)), '&amp;', '&') AS href
            FROM pages) a) b
WHERE starts_with(link, base)
"""

VIEWS["page_metrics"] = """
SELECT h.market_code, h.page_path, count(DISTINCT h.session_id) AS SessionsCount,
       count(DISTINCT CASE WHEN s.bounced_session = 1 THEN h.session_id END) AS sessions_bounced,
       count(DISTINCT CASE WHEN h.hit_number = s.total_hits THEN h.session_id END) AS sessions_exited_at_content
FROM hit h JOIN session s ON h.session_id = s.session_id GROUP BY h.market_code, h.page_path
"""

VIEWS["crawled"] = "SELECT DISTINCT page_path FROM hit WHERE host_name = 'buildyour.alpha.example'"

VIEWS["kept"] = """
SELECT market_code, page_path, SessionsCount, check_flag AS page_path_check,
       CASE WHEN check_flag = 1 AND SessionsCount >= 80 THEN 1 WHEN page_path IN ('Totals', 'nan', '') THEN 0
            WHEN SessionsCount <= 100 THEN 0 WHEN market_code NOT IN ('US', 'GB', 'DE') THEN 0 ELSE 1 END AS keep
FROM (SELECT *, CASE WHEN page_path IN (SELECT page_path FROM crawled) THEN 1 ELSE 0 END AS check_flag FROM page_metrics) f
"""

VIEWS["element_stats"] = """
SELECT page_group AS element, visit_start_date, CASE WHEN hit_type = 'PAGE' THEN 1 ELSE 0 END AS impressions,
       CASE WHEN event_label IS NOT NULL THEN 1 ELSE 0 END AS clicks
FROM hit
"""

VIEWS["compared"] = """
SELECT element,
       CAST(sum(CASE WHEN a THEN impressions ELSE 0 END) AS BIGINT) AS impressions_a,
       CAST(sum(CASE WHEN a THEN clicks ELSE 0 END) AS BIGINT) AS clicks_a,
       CAST(sum(CASE WHEN NOT a THEN impressions ELSE 0 END) AS BIGINT) AS impressions_b,
       CAST(sum(CASE WHEN NOT a THEN clicks ELSE 0 END) AS BIGINT) AS clicks_b
FROM (SELECT *, visit_start_date <= DATE '2024-01-14' AS a FROM element_stats
      WHERE visit_start_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-28') x
GROUP BY element
"""

VIEWS["scoped_hit"] = """
SELECT * FROM hit WHERE visit_start_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND brand = 'Alpha'
"""
VIEWS["scoped_session"] = """
SELECT * FROM session WHERE visit_start_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AND brand = 'Alpha'
"""
VIEWS["session_pages"] = "SELECT session_id, count(*) AS page_count FROM scoped_hit WHERE hit_type = 'PAGE' GROUP BY session_id"
VIEWS["session_order"] = """
SELECT row_number() OVER (PARTITION BY visitor_id ORDER BY visit_start_date, session_id) AS session_number FROM scoped_session
"""
VIEWS["flag_brands"] = """
SELECT coalesce(nameplate_aero, 0) + coalesce(nameplate_brisk, 0) + coalesce(nameplate_crest, 0) AS touched FROM session_flags
"""
VIEWS["landing_pages"] = """
SELECT session_id, CASE WHEN host_name <> 'buildyour.alpha.example'
    AND replace(regexp_extract(page_path, '^[^?&#]+', 0), host_name, '') = '/index.html' THEN 'homepage' ELSE 'other' END AS landing_page
FROM scoped_hit WHERE hit_type = 'PAGE'
"""
VIEWS["metric_base"] = """
SELECT h.visitor_id, h.market_code, h.visit_start_date, li.enquiry_flag, li.engagement_flag, hin.interaction_id
FROM hit h JOIN hit_interaction_nameplate hin ON h.hit_id = hin.hit_id
JOIN lookup_interaction li ON hin.interaction_id = li.interaction_id
"""

FUNNEL_PAGES = ", ".join(
    f"'{host}/{page}'"
    for host in ("www.alpha.example", "buildyour.alpha.example", "www.beta.example")
    for page in ("index.html", "index.html?ref=x", "models/index.html")
)


OFFER_PAGES = "SELECT page_path FROM hit WHERE page_group IN ('offers', 'models')"


def with_views(sql: str) -> str:
    """Prefix a statement with the views it names, and the views those name."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    recursive = "RECURSIVE " if "WITH RECURSIVE" in sql else ""
    body = re.sub(r"^\s*WITH (RECURSIVE )?", ", ", sql, count=1) if re.match(r"\s*WITH ", sql) else sql
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed) + "\n" + body


def _page_ctr(is_cta: str, pages: str = FUNNEL_PAGES) -> str:
    return f"""
WITH seen AS (
  SELECT h.*, s.bounced_session, s.device_category, s.channel_grouping, s.medium
  FROM scoped_hit h JOIN session s USING (session_id)
  WHERE h.visit_start_date <= DATE '2024-01-28' AND s.visit_start_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-28'
    AND h.market_code IN ('US', 'CA', 'GB') AND h.page_path IN ({pages})),
pairs AS (
  SELECT v.visitor_id, n.page_path, v.visit_start_date, v.bounced_session = 1 AS bounced, {is_cta} AS clicked
  FROM seen v JOIN hit n ON n.session_id = v.session_id WHERE n.hit_datetime > v.hit_datetime),
clicks AS (SELECT DISTINCT visitor_id, page_path, visit_start_date, 1 AS c FROM pairs WHERE clicked),
bounces AS (SELECT DISTINCT visitor_id, page_path, visit_start_date, 1 AS b FROM pairs WHERE bounced)
SELECT market_code, page_path, device_category, channel_grouping, medium, count(DISTINCT visitor_id) AS total_page_visitors,
  count(DISTINCT visitor_id) FILTER (c = 1) AS ctr_visitors, count(DISTINCT visitor_id) FILTER (b = 1) AS total_bounced_visitor
FROM seen LEFT JOIN clicks USING (visitor_id, page_path, visit_start_date)
LEFT JOIN bounces USING (visitor_id, page_path, visit_start_date)
GROUP BY ALL
"""


def _by(column: str, name: str) -> str:
    return f"""
SELECT {column} AS {name}, count(DISTINCT session_id) AS sessions_count FROM scoped_session
GROUP BY 1 ORDER BY sessions_count DESC, 1
"""


def _rollup(grain: str, start: str, last: str, ident: str) -> str:
    return f"""
WITH final AS (
  SELECT visitor_id, {start} AS p, arg_max(brand, visit_start_datetime) AS brand, arg_max(market_code, visit_start_datetime) AS market_code
  FROM session GROUP BY 1, 2),
engaged AS (SELECT visitor_id, {start} AS p, interaction_id FROM hit_interaction_nameplate)
SELECT f.brand, f.market_code, m.market_name, m.region, CAST({ident} AS INT) AS {grain}_id, f.p AS {grain}_id_date,
       CASE WHEN {last} <= (SELECT max(visit_start_date) FROM session) THEN 1 ELSE 0 END AS completed_{grain},
       li.interaction_id, li.interaction_desc, count(DISTINCT e.visitor_id) AS total_visitors
FROM engaged e JOIN final f ON e.visitor_id = f.visitor_id AND e.p = f.p
JOIN lookup_interaction li ON li.interaction_id = e.interaction_id LEFT JOIN lookup_market m ON m.market_code = f.market_code
GROUP BY ALL
"""


WEEK = "CAST(visit_start_date - CAST(dayofweek(visit_start_date) AS INT) AS DATE)"


def _flag_rows(condition: str, name: str, count: str = "count(*)") -> str:
    return f"SELECT {count} AS {name} FROM session_flags WHERE {condition}"


def _parse(field: str, body_first: bool) -> str:
    """Value of one event parameter under either precedence rule."""
    key = f"ep(?:[.]|%2E)event_{field}"
    q = f"nullif(regexp_extract(url, '[?&]{key}=([^&#]+)', 1), '')"
    b = f"nullif(regexp_extract(body, '(?:^|&){key}=([^&]+)', 1), '')"
    label = "nullif(regexp_extract(url, '[?&]ep(?:[.]|%2E)event_label=([^&#]+)', 1), '')"
    value = f"coalesce({b}, {q}, '')" if body_first else f"coalesce(CASE WHEN {label} IS NULL AND body IS NOT NULL THEN {b} ELSE {q} END, '')"
    return f"url_decode(replace({value}, '+', ' ')) AS event_{field}"


def _terms() -> str:
    """(table, term) pairs of the default catalog."""
    from sitelens.catalog import default_schema

    pairs = []
    for table, info in default_schema()["tables"].items():
        pairs += [(table, term.lower()) for term in (table, info["description"], *info["columns"])]
    return ", ".join(f"('{t}', '{term}')" for t, term in pairs)


LINK_TERMS = """
SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS table_name, lower(regexp_extract(link, '/([^/?#]+)$', 1)) AS term
FROM page_links WHERE regexp_extract(link, '/([^/?#]+)$', 1) <> ''"""


def _matched(terms: str) -> str:
    return f"""
terms AS ({terms}),
questions AS (
  SELECT concat(session_id, '-', turn) AS question_id,
    concat(content, CASE turn % 6 WHEN 0 THEN ' by device_category' WHEN 2 THEN ' per Month_ID' ELSE '' END) AS content
  FROM query_log WHERE message_type = 'user'),
found AS (SELECT DISTINCT q.question_id, t.table_name FROM questions q JOIN terms t ON contains(lower(q.content), t.term)),
matched AS (SELECT question_id, table_name FROM found UNION ALL
  SELECT q.question_id, t.table_name FROM questions q CROSS JOIN (SELECT DISTINCT table_name FROM terms) t
  WHERE q.question_id NOT IN (SELECT question_id FROM found))
"""


MATCHED = _matched(f"SELECT * FROM (VALUES {_terms()}) AS t(table_name, term)")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


def _json(info) -> str:
    return json.dumps(info, ensure_ascii=False, sort_keys=True)


def _table_definitions() -> str:
    from sitelens.catalog import default_schema

    return _values([(name, _json(info)) for name, info in default_schema()["tables"].items()])


def _fixed_definitions() -> str:
    from sitelens.catalog import default_schema

    schema = default_schema()
    rows = [("metric", name, _json(info)) for name, info in schema["metrics"].items()]
    return _values(rows + [("relationship", f"{r['from']} -> {r['to']}", _json(r)) for r in schema["relationships"]])


QUERY_UPSERT = """
SELECT f.query_hash, f.session_id, f.natural_language_query, l.sql_query, l.complexity, l."timestamp"
FROM (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY query_hash ORDER BY arrival, "timestamp", session_id) = 1) f
JOIN (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY query_hash ORDER BY arrival DESC, "timestamp" DESC, session_id DESC) = 1) l
  ON f.query_hash = l.query_hash"""

STATEMENTS: dict[str, str] = {
    "preview": """
SELECT count(*) AS row_count, 'event_id, ts, user_id, event_type, value, props' AS column_names, least(count(*), 10) AS preview_rows FROM events""",
    "page_metrics_csv": "SELECT market_code, page_path, SessionsCount, sessions_bounced FROM page_metrics",
    "feedback_file": """
SELECT content AS sql_query, query_hash AS corrections FROM query_log WHERE message_type IN ('user', 'assistant')""",
    "clustered_layout": """
SELECT session_id, visit_start_date, source, medium, campaign, market_code FROM session
WHERE visit_start_date = DATE '2024-01-09' AND source = 'google'""",
    "scan_table": "SELECT * FROM nation",
    "run_query": """
SELECT session_id, visitor_id, total_hits FROM session WHERE brand = 'Alpha' ORDER BY total_hits DESC, session_id LIMIT 1000""",
    "describe_table": """
SELECT CAST(position AS INT) AS position, column_name, data_type, CAST(NULL AS VARCHAR) AS description,
  (SELECT count(*) FROM events) AS num_rows
FROM (VALUES (0, 'event_id', 'bigint'), (1, 'ts', 'timestamp_ntz'), (2, 'user_id', 'bigint'), (3, 'event_type', 'string'),
  (4, 'value', 'double'), (5, 'props', 'string')) AS t(position, column_name, data_type)""",
    "page_ctr": _page_ctr("n.event_label IN ('BUILD YOUR OWN :: cta-content', 'FIND OUT MORE :: cta-content')"),
    "ctr_by_label": _page_ctr("n.event_label IN (SELECT event_label FROM hit WHERE event_label LIKE '%:: cta-content')"),
    "ctr_by_captured_label": _page_ctr(
        f"""n.event_label IN (SELECT concat(regexp_replace(event_label, ' [0-9]+$', ''), ' :: cta-content')
      FROM (SELECT {_parse("label", True)} FROM collected))""",
        OFFER_PAGES,
    ),
    "session_count": """
SELECT count(DISTINCT session_id) AS num_sessions FROM scoped_session WHERE market_code IN ('GB', 'DE', 'US', 'IT')""",
    "total_pageviews": """
SELECT count(*) AS total_pageviews FROM scoped_hit WHERE hit_type = 'PAGE' AND page_path IS NOT NULL""",
    "config_sessions": """
SELECT count(DISTINCT session_id) AS sessions_with_config FROM scoped_hit
WHERE hit_type = 'PAGE' AND (host_name LIKE '%buildyour%' OR host_name = 'www.range.example')
  AND (content_group_4 = 'configurator' OR regexp_matches(page_path, 'inspire|curatedchoices|summary|jdxpayoff'))""",
    "landing_like": "SELECT page_path, count(*) AS hits FROM scoped_hit WHERE page_path LIKE '%/index.html' GROUP BY 1",
    "landing_group": """
SELECT landing_page, count(DISTINCT session_id) AS session_count FROM landing_pages GROUP BY 1""",
    "top_landing_group": """
SELECT landing_page, count(DISTINCT session_id) AS session_count FROM landing_pages GROUP BY 1
ORDER BY session_count DESC, landing_page LIMIT 1""",
    "mobile_sessions": "SELECT count(*) AS mobile_sessions FROM scoped_session WHERE device_category = 'mobile'",
    "desktop_sessions": "SELECT count(*) AS desktop_sessions FROM scoped_session WHERE device_category = 'desktop'",
    "sessions_by_source": _by("source", "session_first_source"),
    "sessions_by_medium": _by("medium", "session_first_medium"),
    "sessions_by_channel": _by("channel_grouping", "session_first_channel_grouping"),
    "sessions_by_market": _by("market_code", "market_code"),
    "avg_session_minutes": """
SELECT round(avg(time_on_site_seconds) / 60, 2) AS avg_session_duration_mins FROM scoped_session
WHERE market_code IN ('GB', 'DE', 'US', 'IT')""",
    "avg_session_minutes_by_market": """
SELECT market_code, round(avg(time_on_site_seconds) / 60, 2) AS avg_session_duration_mins FROM scoped_session GROUP BY 1""",
    "total_minutes_by_market": """
SELECT market_code, round(sum(time_on_site_seconds) / 60, 2) AS total_session_duration_mins FROM scoped_session GROUP BY 1""",
    "avg_pages_per_session": "SELECT round(avg(total_page_views), 2) AS avg_pages_per_session FROM scoped_session",
    "pages_per_session": """
SELECT session_id, CAST(sum(total_page_views) AS BIGINT) AS total_pages FROM scoped_session GROUP BY 1""",
    "single_page_sessions": "SELECT count(*) AS single_page_sessions FROM session_pages WHERE page_count = 1",
    "multi_page_sessions": "SELECT count(*) AS multi_page_sessions FROM session_pages WHERE page_count > 1",
    "single_vs_multi": """
SELECT CAST(sum(CASE WHEN page_count = 1 THEN 1 ELSE 0 END) AS BIGINT) AS single_page_sessions,
       CAST(sum(CASE WHEN page_count > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi_page_sessions FROM session_pages""",
    "avg_page_count": "SELECT round(avg(page_count), 2) AS avg_pages_per_session FROM session_pages",
    "page_sequences": """
WITH sequences AS (
  SELECT session_id, string_agg(page_group, ' > ' ORDER BY hit_datetime, hit_id) AS page_sequence
  FROM scoped_hit WHERE hit_type = 'PAGE' GROUP BY session_id)
SELECT page_sequence, count(*) AS sequence_count FROM sequences GROUP BY 1
ORDER BY sequence_count DESC, min(session_id) LIMIT 10""",
    "visitors_by_dims": f"""
SELECT h.market_code, page_path, device_category, channel_grouping, h.visit_start_date, count(DISTINCT h.visitor_id) AS total_visitors
FROM scoped_hit h JOIN scoped_session s USING (session_id)
WHERE h.market_code IN ('US', 'CA', 'GB') AND page_path IN ({FUNNEL_PAGES}) GROUP BY ALL""",
    "visitors_of_listed_pages": f"""
SELECT h.market_code, page_path, device_category, channel_grouping, h.visit_start_date, count(DISTINCT h.visitor_id) AS total_visitors
FROM scoped_hit h JOIN scoped_session s USING (session_id)
WHERE h.market_code IN ('US', 'CA', 'GB') AND page_path IN ({OFFER_PAGES}) GROUP BY ALL""",
    "weekly_visitors": """
SELECT h.market_code, campaign, channel_grouping, medium, referrer, h.visit_start_date,
  CAST(h.visit_start_date - CAST(dayofweek(h.visit_start_date) AS INT) AS DATE) AS week, count(DISTINCT h.visitor_id) AS total_users
FROM scoped_hit h JOIN scoped_session s USING (session_id) WHERE page_path LIKE '%/models/index.html' GROUP BY ALL""",
    "visitors_in_market": """
SELECT count(DISTINCT visitor_id) AS visitor_count FROM session
WHERE market_code = 'US' AND visit_start_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'""",
    "visitors_by_device": """
SELECT device_category, count(DISTINCT visitor_id) AS visitor_count FROM session
WHERE market_code = 'US' AND visit_start_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1""",
    "new_returning": """
SELECT CAST(sum(CASE WHEN session_number = 1 THEN 1 ELSE 0 END) AS BIGINT) AS new_sessions,
       CAST(sum(CASE WHEN session_number > 1 THEN 1 ELSE 0 END) AS BIGINT) AS returning_sessions FROM session_order""",
    "new_returning_pct": """
SELECT CAST(sum(CASE WHEN session_number = 1 THEN 1 ELSE 0 END) AS DOUBLE) * 100.0 / count(*) AS pct_new_sessions,
       CAST(sum(CASE WHEN session_number > 1 THEN 1 ELSE 0 END) AS DOUBLE) * 100.0 / count(*) AS pct_returning_sessions
FROM session_order""",
    "campaign_parts": """
SELECT session_id,
  nullif(regexp_extract(lower(campaign), '^[a-z]{2}_(?:nv_)?([a-z]{2})_', 1), '') AS cmp_brand,
  nullif(regexp_extract(lower(campaign), '(aud|dis|psoc|psocdp|prg|rad|olv|vod|sem|prt|ooh|cin|prog)', 1), '') AS cmp_channel,
  nullif(regexp_extract(lower(campaign), '^([a-z]{2})_', 1), '') AS cmp_market,
  nullif(regexp_extract(lower(campaign), '^[a-z]{2}_(?:nv_)?[a-z]{2}_([a-z0-9]{2,5})_', 1), '') AS cmp_nameplate
FROM scoped_session""",
    "campaign_objective": """
SELECT session_id,
  nullif(regexp_extract(lower(campaign), '(do|think|see|thk)', 1), '') AS cmp_objective1,
  nullif(regexp_extract(lower(campaign), '(lead|conv|aware|engage|traffic|consideration|purchase|retention)', 1), '') AS cmp_objective2
FROM session WHERE campaign IS NOT NULL""",
    "media_channel": """
-- fixed values: the channel codes of the campaign naming scheme
SELECT session_id, campaign, CASE regexp_extract(lower(campaign), '(gmc[0-9]+)', 1)
  WHEN 'gmc1000' THEN 'Google Search' WHEN 'gmc2000' THEN 'Google Display Network' WHEN 'gmc3000' THEN 'Facebook'
  WHEN 'gmc4000' THEN 'Instagram' WHEN 'gmc5000' THEN 'YouTube' WHEN 'gmc6000' THEN 'LinkedIn' WHEN 'gmc7000' THEN 'Twitter'
  WHEN 'gmc8000' THEN 'Bing Ads' WHEN 'gmc9000' THEN 'CRM / Direct Email' ELSE 'Unknown Media Channel' END AS media_channel
FROM session WHERE campaign IS NOT NULL""",
    "campaign_first_channel": """
SELECT DISTINCT campaign AS session_first_campaign, channel_grouping AS first_channel FROM scoped_session""",
    "session_flags": "SELECT * FROM session_flags",
    "config_start_sessions": _flag_rows("sessions_with_config_start > 0", "sessions_with_config_start"),
    "engaged_sessions": _flag_rows("sessions_with_any_engagement > 0", "sessions_with_engagement"),
    "start_and_complete_sessions": _flag_rows(
        "sessions_with_config_start > 0 AND sessions_with_config_completes > 0", "sessions_with_config_start_and_complete"
    ),
    "other_enquiry_sessions": _flag_rows(
        "sessions_with_enquiry_other > 0", "sessions_with_other_enquiry", "count(DISTINCT session_id)"
    ),
    "touchpoint_electric": _flag_rows("Electric = 1", "sessions_with_electric"),
    "build_your_own_sessions": _flag_rows("BuildYourOwn = 1", "sessions_with_build_your_own", "count(DISTINCT session_id)"),
    "zero_brand": "SELECT count(*) AS zero_brand_sessions FROM flag_brands WHERE touched = 0",
    "single_brand": "SELECT count(*) AS single_brand_sessions FROM flag_brands WHERE touched = 1",
    "multi_brand": "SELECT count(*) AS multi_brand_sessions FROM flag_brands WHERE touched > 1",
    "brand_interactions": """
SELECT count(CASE WHEN nameplate_aero = 1 THEN 1 END) AS nameplate_aero_sessions,
       count(CASE WHEN nameplate_brisk = 1 THEN 1 END) AS nameplate_brisk_sessions,
       count(CASE WHEN nameplate_crest = 1 THEN 1 END) AS nameplate_crest_sessions FROM session_flags""",
    "touchpoint_totals": """
SELECT CAST(sum(Forms) AS BIGINT) AS total_forms, CAST(sum(ApprovedUsed) AS BIGINT) AS total_approvedused,
  CAST(sum(BuildYourOwn) AS BIGINT) AS total_buildyourown, CAST(sum(SavedBuilds) AS BIGINT) AS total_savedbuilds,
  CAST(sum(OffersFinance) AS BIGINT) AS total_offersfinance, CAST(sum(ModelsSpecifications) AS BIGINT) AS total_modelsspecifications,
  CAST(sum(Electric) AS BIGINT) AS total_electric, CAST(sum(Ownership) AS BIGINT) AS total_ownership,
  CAST(sum(Experience) AS BIGINT) AS total_experience FROM session_flags""",
    "interaction_totals": """
SELECT CAST(sum(sessions_with_config_start) AS BIGINT) AS total_config_starts,
  CAST(sum(sessions_with_config_completes) AS BIGINT) AS total_config_completes,
  CAST(sum(sessions_with_any_enquiry) AS BIGINT) AS total_enquiries FROM session_flags""",
    "campaign_performance": """
SELECT market_code, page_sequence_1 AS landing_page_group, count(DISTINCT session_id) AS num_sessions,
  CAST(sum(sessions_with_config_start) AS BIGINT) AS total_config_starts,
  CAST(sum(sessions_with_any_engagement) AS BIGINT) AS total_engagements,
  CAST(sum(sessions_with_any_enquiry) AS BIGINT) AS total_enquiries FROM session_flags GROUP BY 1, 2""",
    "config_sessions_by_campaign": """
SELECT session_first_campaign, count(DISTINCT session_id) AS sessions_with_config FROM session_flags WHERE Config = 1 GROUP BY 1""",
    "duplicate_sessions": """
SELECT session_id, count(*) AS num_rows FROM session_interaction_nameplate GROUP BY 1 HAVING count(*) > 1""",
    "landing_exit": """
SELECT session_id, page_sequence_1 AS landing_page_group, session_last_page_group AS exit_page_group FROM session_flags""",
    "session_first_touch": """
SELECT session_id, session_first_channel_grouping, session_first_source, session_first_medium FROM session_flags""",
    "visitor_vs_session_channel": """
SELECT session_id, visitor_first_channel_grouping, session_first_channel_grouping FROM session_flags""",
    "campaign_detail": """
SELECT session_id, session_first_campaign, cmp_brand, cmp_channel, cmp_market, cmp_nameplate, sessions_with_config_start,
       sessions_with_config_completes, sessions_with_any_engagement, sessions_with_any_enquiry FROM session_flags""",
    "sessions_per_cluster": """
SELECT cluster_name, count(DISTINCT session_id) AS sessions_count FROM session_clusters GROUP BY 1""",
    "market_cluster_cross": """
SELECT f.market_code, c.cluster_name, count(DISTINCT f.session_id) AS num_sessions
FROM session_flags f LEFT JOIN known_clusters c ON f.session_id = c.session_id GROUP BY 1, 2""",
    "hit_numbering": "SELECT hit_id, session_id, hit_number FROM hit",
    "entrance_exit": """
SELECT hit_id, session_id,
  CASE WHEN hit_type = 'PAGE' AND row_number() OVER (PARTITION BY session_id, hit_type ORDER BY hit_datetime, hit_id) = 1 THEN 1 ELSE 0 END AS entrance,
  CASE WHEN hit_type = 'PAGE' AND row_number() OVER (PARTITION BY session_id, hit_type ORDER BY hit_datetime DESC, hit_id DESC) = 1 THEN 1 ELSE 0 END AS "exit"
FROM hit""",
    "previous_group": """
SELECT hit_id, session_id, page_group, lag(page_group) OVER (PARTITION BY session_id ORDER BY hit_datetime, hit_id) AS previous_page_group
FROM hit""",
    "first_touch": """
SELECT session_id, visitor_id, channel_grouping,
  first_value(channel_grouping) OVER (PARTITION BY visitor_id ORDER BY visit_start_date) AS visitor_first_channel_grouping FROM session""",
    "session_build": """
SELECT session_id, visitor_id, visit_start_date, brand, market_code, visit_start_datetime, last_hit_datetime, total_hits,
  total_page_views, bounced_session, got_interaction_event, time_on_site_seconds, session_number,
  CASE WHEN session_number > 1 THEN 1 ELSE 0 END AS returning_visitor FROM session""",
    "hit_interactions": "SELECT * FROM hit_interaction_nameplate",
    "session_interactions": "SELECT * FROM session_interaction_nameplate",
    "enquiry_sessions": """
SELECT count(DISTINCT session_id) AS sessions_with_enquiry FROM session_interaction_nameplate
WHERE enquiry_flag = 1 AND visit_start_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'""",
    "config_complete_sessions": """
SELECT count(DISTINCT session_id) AS sessions_with_config_completes FROM session_interaction_nameplate
WHERE interaction_id = 11 AND visit_start_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'""",
    "engaged_session_list": """
SELECT DISTINCT session_id FROM session_interaction_nameplate
WHERE engagement_flag = 1 AND visit_start_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'""",
    "visitor_day": """
WITH acted AS (
  SELECT h.visitor_id, h.visit_start_date, max(li.engagement_flag) AS engaged, max(li.enquiry_flag) AS enquired
  FROM hit_interaction_nameplate h JOIN lookup_interaction li ON h.interaction_id = li.interaction_id GROUP BY 1, 2)
SELECT concat(s.visitor_id, '-', strftime(s.visit_start_date, '%Y%m%d')) AS visitor_day_id, s.visitor_id,
  CAST(strftime(s.visit_start_date, '%Y%m%d') AS INT) AS day_id, s.visit_start_date,
  arg_max(s.brand, s.visit_start_datetime) AS brand, arg_max(s.market_code, s.visit_start_datetime) AS market_code,
  count(*) AS total_sessions, CAST(sum(s.total_hits) AS BIGINT) AS total_hits,
  CAST(sum(s.total_page_views) AS BIGINT) AS total_page_views, CAST(sum(s.time_on_site_seconds) AS BIGINT) AS time_on_site_seconds,
  coalesce(max(a.engaged), 0) AS engaged_visitor, coalesce(max(a.enquired), 0) AS enquiry_visitor
FROM session s LEFT JOIN acted a ON s.visitor_id = a.visitor_id AND s.visit_start_date = a.visit_start_date
GROUP BY s.visitor_id, s.visit_start_date""",
    "visitor_month_interaction": _rollup(
        "month", "CAST(date_trunc('month', visit_start_date) AS DATE)", "last_day(f.p)", "strftime(f.p, '%Y%m')"
    ),
    "visitor_week_interaction": _rollup("week", WEEK, "f.p + 6", "strftime(f.p, '%Y%m%d')"),
    "visitor_day_interaction": _rollup("day", "visit_start_date", "f.p", "strftime(f.p, '%Y%m%d')"),
    "market_enrich": """
SELECT s.market_code, count(DISTINCT s.session_id) AS sessions_count, m.market_name, m.region
FROM session s LEFT JOIN lookup_market m ON s.market_code = m.market_code GROUP BY ALL""",
    "enquired_visitors": """
SELECT market_code, count(DISTINCT CASE WHEN enquiry_flag = 1 THEN visitor_id END) AS enquired_visitors FROM metric_base GROUP BY 1""",
    "engaged_visitors": """
SELECT market_code, count(DISTINCT CASE WHEN engagement_flag = 1 THEN visitor_id END) AS engaged_visitors FROM metric_base GROUP BY 1""",
    "uev_enq": """
SELECT market_code, count(DISTINCT CASE WHEN enquiry_flag = 1 THEN visitor_id END) * 100.0::DOUBLE
  / nullif(count(DISTINCT CASE WHEN engagement_flag = 1 THEN visitor_id END), 0) AS uev_enq FROM metric_base GROUP BY 1""",
    "uev_enq_by_day": """
SELECT market_code, visit_start_date, count(DISTINCT CASE WHEN enquiry_flag = 1 THEN visitor_id END) * 100.0::DOUBLE
  / nullif(count(DISTINCT CASE WHEN engagement_flag = 1 THEN visitor_id END), 0) AS uev_enq FROM metric_base GROUP BY 1, 2""",
    "config_start": "SELECT count(DISTINCT CASE WHEN interaction_id = 5 THEN visitor_id END) AS config_start FROM metric_base",
    "config_completions": """
SELECT count(DISTINCT CASE WHEN interaction_id = 11 THEN visitor_id END) AS config_completions FROM metric_base""",
    "query_hash": "SELECT session_id, turn, md5(content) AS content_hash FROM query_log",
    "session_upsert": "SELECT * FROM log_sessions",
    "session_store": "SELECT * FROM log_sessions",
    "message_store": 'SELECT session_id, turn, message_type, content, "timestamp" FROM query_log',
    "session_info": "SELECT * FROM log_sessions WHERE session_id = 7",
    "recent_sessions": "SELECT * FROM log_sessions ORDER BY last_interaction DESC, session_id LIMIT 10",
    "query_upsert": QUERY_UPSERT,
    "query_store": QUERY_UPSERT,
    "conversation_history": 'SELECT session_id, turn, message_type, content, "timestamp" FROM query_log',
    "lookup_by_hash": """
WITH stored AS (
  SELECT * FROM asked WHERE turn <= 1
  QUALIFY row_number() OVER (PARTITION BY query_hash ORDER BY "timestamp" DESC, session_id DESC) = 1)
SELECT a.session_id, a.turn, a.natural_language_query, a.query_hash, s.sql_query, s.complexity
FROM asked a LEFT JOIN stored s ON a.query_hash = s.query_hash""",
    "feedback_join": """
SELECT session_id, turn AS message_id, message_type,
  CASE WHEN message_type = 'assistant' THEN 2 ELSE 0 END::BIGINT AS ratings,
  CASE WHEN message_type = 'assistant' THEN (2 + length(content) % 5 + length(content) % 3) / 2.0 END::DOUBLE AS avg_rating,
  CASE WHEN message_type = 'assistant' AND length(content) % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS comments
FROM query_log""",
    "knn_l2": """
WITH pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d
  FROM embeddings a CROSS JOIN embeddings b)
SELECT query_id, vec_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank
FROM pairs QUALIFY rank <= 3""",
    "split_pairs": r"""
SELECT session_id, turn, regexp_replace(left(c, instr(c, '=>') - 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS nl_query,
  regexp_replace(substr(c, instr(c, '=>') + 2), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS sql
FROM (SELECT session_id, turn, CASE WHEN message_type = 'user' THEN concat(natural_language_query, ' => ', content) ELSE content END AS c
      FROM query_log) x WHERE contains(c, '=>')""",
    "match_tables": f"WITH {MATCHED} SELECT question_id, table_name FROM matched",
    "match_term_table": f"WITH {_matched(LINK_TERMS)} SELECT question_id, table_name FROM matched",
    "select_catalog": f"""
WITH {MATCHED} SELECT question_id, 'table' AS kind, table_name AS name, definition
FROM matched JOIN (VALUES {_table_definitions()}) AS d(table_name, definition) USING (table_name)
UNION ALL SELECT q.question_id, f.kind, f.name, f.definition FROM questions q
CROSS JOIN (SELECT * FROM (VALUES {_fixed_definitions()}) AS t(kind, name, definition)) f""",
    "collect_requests": "SELECT * FROM collected",
    "parse_merged": f"""
SELECT request_id, {_parse("label", True)}, {_parse("action", True)}, {_parse("category", True)}, button_text FROM collected""",
    "parse_fallback": f"""
SELECT request_id, {_parse("label", False)}, {_parse("action", False)}, {_parse("category", False)}, button_text FROM collected""",
    "extract_links": "SELECT page_id, url, link FROM page_links",
    "all_links": "SELECT market_code, link FROM page_links",
    "distinct_links": "SELECT DISTINCT link FROM page_links",
    "path_match_key": "SELECT page_id, lower(replace(url, 'https://', '')) AS path_key FROM pages",
    # One row per page, the first found: rounds go on until none is new, at whatever depth.
    "link_closure": """
WITH RECURSIVE reach(page, depth) USING KEY (page) AS (
  SELECT CAST(0 AS BIGINT), 0
  UNION SELECT DISTINCT e.dst, r.depth + 1 FROM reach r JOIN link_edges e ON r.page = e.src
  WHERE NOT EXISTS (SELECT 1 FROM recurring.reach x WHERE x.page = e.dst))
SELECT page, depth FROM reach""",
    "site_closure": """
WITH RECURSIVE reach(page, depth) USING KEY (page) AS (
  SELECT DISTINCT url, 0 FROM pages WHERE url IS NOT NULL
  UNION SELECT DISTINCT l.link, r.depth + 1 FROM reach r JOIN page_links l ON r.page = l.url
  WHERE NOT EXISTS (SELECT 1 FROM recurring.reach x WHERE x.page = l.link))
SELECT page, depth FROM reach""",
    "clickable": r"""
SELECT page_id, 'a' AS tag_name, replace(trim(regexp_replace(regexp_extract(e, '>(.*)</a>', 1), '\s+', ' ', 'g')), '&amp;', '&') AS text,
  replace(regexp_extract(e, 'href="([^"]*)"', 1), '&amp;', '&') AS href, CAST(NULL AS VARCHAR) AS classes,
  CAST(NULL AS VARCHAR) AS data_target, CAST(NULL AS VARCHAR) AS data_link_type, CAST(NULL AS VARCHAR) AS aria_label,
  CAST(NULL AS VARCHAR) AS target
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*>[^<]*</a>')) AS e FROM pages) x WHERE contains(upper(text), 'THE')""",
    "crawled_path_flag": "SELECT market_code, page_path, page_path_check FROM kept",
    "keep_pages": "SELECT market_code, page_path, SessionsCount, page_path_check, keep FROM kept",
    "keep_check_counts": "SELECT keep, page_path_check, count(page_path) AS pages FROM kept GROUP BY 1, 2",
    "page_metric_stats": """
WITH enquired AS (SELECT DISTINCT session_id FROM session_interaction_nameplate WHERE enquiry_flag = 1),
converted AS (SELECT DISTINCT session_id FROM session_interaction_nameplate WHERE interaction_id = 11),
engaged AS (SELECT DISTINCT session_id FROM session_interaction_nameplate WHERE engagement_flag = 1),
started AS (SELECT DISTINCT session_id FROM session_interaction_nameplate WHERE interaction_id = 5),
ends AS (SELECT session_id, max(hit_datetime) AS end_at FROM hit GROUP BY 1),
seen AS (SELECT h.market_code, h.page_path, h.session_id, min(h.hit_datetime) AS came, min(h.hit_number) AS first_number,
           max(CASE WHEN h.hit_number = s.total_hits THEN 1 ELSE 0 END) AS exited
         FROM hit h JOIN session s ON h.session_id = s.session_id GROUP BY 1, 2, 3),
after AS (SELECT v.session_id, v.market_code, v.page_path, count(h.hit_id) AS pages_after
          FROM seen v LEFT JOIN hit h ON h.session_id = v.session_id AND h.hit_type = 'PAGE' AND h.hit_number > v.first_number GROUP BY 1, 2, 3)
SELECT v.market_code, v.page_path, count(*) AS SessionsCount,
  round(avg(a.pages_after), 6) AS avg_pages_after_content, round(stddev_samp(a.pages_after), 6) AS stddev_pages_after_content,
  round(avg(CASE WHEN s.session_number > 1 THEN 1 ELSE 0 END), 6) AS returning_visitor_rate,
  round(avg(s.time_on_site_seconds), 6) AS avg_time_on_site_seconds, round(stddev_samp(s.time_on_site_seconds), 6) AS stddev_time_on_site_seconds,
  round(avg(s.total_page_views), 6) AS avg_pages_viewed, round(stddev_samp(s.total_page_views), 6) AS stddev_pages_viewed,
  round(avg(v.exited), 6) AS exit_rate, round(avg(s.bounced_session), 6) AS bounce_rate,
  round(avg(CASE WHEN e.session_id IS NULL THEN 0 ELSE 1 END), 6) AS enquiry_rate,
  round(avg(CASE WHEN c.session_id IS NULL THEN 0 ELSE 1 END), 6) AS conversion_rate,
  round(avg(CASE WHEN g.session_id IS NULL THEN 0 ELSE 1 END), 6) AS engagement_rate,
  round(avg(CASE WHEN t.session_id IS NULL THEN 0 ELSE 1 END), 6) AS config_start_rate,
  round(avg((epoch_us(x.end_at) - epoch_us(v.came)) / 1e6::DOUBLE), 6) AS avg_seconds_after_content
FROM seen v JOIN session s ON v.session_id = s.session_id
JOIN after a ON a.session_id = v.session_id AND a.market_code = v.market_code AND a.page_path = v.page_path JOIN ends x ON x.session_id = v.session_id
LEFT JOIN engaged g ON g.session_id = v.session_id LEFT JOIN started t ON t.session_id = v.session_id
LEFT JOIN enquired e ON e.session_id = v.session_id LEFT JOIN converted c ON c.session_id = v.session_id
GROUP BY 1, 2""",
    "metric_histogram": """
WITH bounds AS (SELECT market_code, min(time_on_site_seconds)::DOUBLE AS low, max(time_on_site_seconds)::DOUBLE AS high FROM session GROUP BY 1),
binned AS (
  SELECT s.market_code, b.low, (b.high - b.low) / 10 AS width,
    CASE WHEN b.high = b.low THEN 0
         ELSE least(floor((s.time_on_site_seconds - b.low) / ((b.high - b.low) / 10)), 9) END::BIGINT AS bin
  FROM session s JOIN bounds b ON s.market_code = b.market_code)
SELECT market_code, bin, round(low + bin * width, 4) AS bin_start, count(*) AS rows FROM binned GROUP BY 1, 2, low, width""",
    "normality_test": """
WITH long AS (
  SELECT market_code, 'time_on_site_seconds' AS metric, time_on_site_seconds::DOUBLE AS x FROM session
  UNION ALL SELECT market_code, 'total_hits', total_hits::DOUBLE FROM session),
means AS (SELECT market_code, metric, avg(x) AS m, count(*) AS n FROM long GROUP BY 1, 2),
moments AS (
  SELECT l.market_code, l.metric, max(m.n) AS n, avg(power(x - m, 2)) AS m2, avg(power(x - m, 3)) AS m3, avg(power(x - m, 4)) AS m4
  FROM long l JOIN means m ON l.market_code = m.market_code AND l.metric = m.metric GROUP BY 1, 2),
tested AS (SELECT market_code, metric, n, n / 6.0::DOUBLE * (power(m3 / power(m2, 1.5), 2) + power(m4 / power(m2, 2) - 3, 2) / 4) AS jb FROM moments)
SELECT market_code, metric, n, round(jb, 4) AS jarque_bera, round(exp(-jb / 2), 6) AS jarque_bera_p,
  CASE WHEN exp(-jb / 2) > 0.05 THEN 1 ELSE 0 END AS is_normal FROM tested""",
    "shapiro_test": """
WITH long AS (
  SELECT market_code, session_id, 'time_on_site_seconds' AS metric, time_on_site_seconds::DOUBLE AS x FROM session
  UNION ALL SELECT market_code, session_id, 'total_hits', total_hits::DOUBLE FROM session),
ranked AS (
  SELECT market_code, metric, x, (row_number() OVER (PARTITION BY market_code, metric ORDER BY x, session_id) - 0.375::DOUBLE)
    / (count(*) OVER (PARTITION BY market_code, metric) + 0.25::DOUBLE) AS p FROM long WHERE x IS NOT NULL),
parts AS (SELECT *, p - 0.5::DOUBLE AS q, power(p - 0.5::DOUBLE, 2) AS r, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM ranked),
scored AS (  -- fixed values: coefficients of the normal quantile
  SELECT market_code, metric, x, CASE WHEN abs(q) <= 0.47575 THEN
    (((((-39.69683028665376::DOUBLE * r + 220.9460984245205::DOUBLE) * r - 275.9285104469687::DOUBLE) * r + 138.3577518672690::DOUBLE) * r
       - 30.66479806614716::DOUBLE) * r + 2.506628277459239::DOUBLE) * q
    / (((((-54.47609879822406::DOUBLE * r + 161.5858368580409::DOUBLE) * r - 155.6989798598866::DOUBLE) * r + 66.80131188771972::DOUBLE) * r
       - 13.28068155288572::DOUBLE) * r + 1)
    ELSE -sign(q) * (((((-0.007784894002430293::DOUBLE * t - 0.3223964580411365::DOUBLE) * t - 2.400758277161838::DOUBLE) * t
       - 2.549732539343734::DOUBLE) * t + 4.374664141464968::DOUBLE) * t + 2.938163982698783::DOUBLE)
    / ((((0.007784695709041462::DOUBLE * t + 0.3224671290700398::DOUBLE) * t + 2.445134137142996::DOUBLE) * t
       + 3.754408661907416::DOUBLE) * t + 1) END AS score FROM parts),
tested AS (
  SELECT market_code, metric, count(*) AS n, CASE WHEN min(x) < max(x) THEN power(corr(x, score), 2) END AS w FROM scored GROUP BY 1, 2),
z AS (
  SELECT *, (ln(1 - w) - (-1.2725::DOUBLE + 1.0521::DOUBLE * (ln(ln(n)) - ln(n)))) / (1.0308::DOUBLE - 0.26758::DOUBLE * (ln(ln(n)) + 2 / ln(n))) AS z
  FROM tested WHERE n >= 5 AND w < 1),
halves AS (SELECT *, 1 / (1 + abs(z) / (2 * sqrt(2.0::DOUBLE))) AS t FROM z),
tails AS (  -- fixed values: coefficients of the complementary error function
  SELECT *, t * exp(-z * z / 2 - 1.26551223::DOUBLE + t * (1.00002368::DOUBLE + t * (0.37409196::DOUBLE + t * (0.09678418::DOUBLE
    + t * (-0.18628806::DOUBLE + t * (0.27886807::DOUBLE + t * (-1.13520398::DOUBLE + t * (1.48851587::DOUBLE + t * (-0.82215223::DOUBLE
    + t * 0.17087277::DOUBLE))))))))) / 2 AS tail FROM halves),
p AS (SELECT market_code, metric, CASE WHEN z >= 0 THEN tail ELSE 1 - tail END AS p FROM tails)
SELECT a.market_code, a.metric, a.n, round(a.w, 6) AS shapiro_w, round(p.p, 6) AS shapiro_p, CASE WHEN p.p > 0.05 THEN 1 ELSE 0 END AS is_normal
FROM tested a LEFT JOIN p ON a.market_code IS NOT DISTINCT FROM p.market_code AND a.metric = p.metric""",
    "analyze_ctr": """
SELECT element, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks,
  round(sum(clicks) * 100.0::DOUBLE / nullif(sum(impressions), 0), 6) AS ctr FROM element_stats GROUP BY 1""",
    "analyze_performance": """
SELECT *, round(clicks_a * 100.0::DOUBLE / nullif(impressions_a, 0), 6) AS ctr_a, round(clicks_b * 100.0::DOUBLE / nullif(impressions_b, 0), 6) AS ctr_b,
  impressions_b - impressions_a AS impressions_change, clicks_b - clicks_a AS clicks_change,
  round(clicks_b * 100.0::DOUBLE / nullif(impressions_b, 0) - clicks_a * 100.0::DOUBLE / nullif(impressions_a, 0), 6) AS ctr_change
FROM compared""",
    "significance": """
WITH pooled AS (SELECT *, (clicks_a + clicks_b)::DOUBLE / (impressions_a + impressions_b) AS p FROM compared),
z AS (SELECT element, (clicks_b::DOUBLE / impressions_b - clicks_a::DOUBLE / impressions_a)
        / sqrt(p * (1 - p) * (1.0::DOUBLE / impressions_a + 1.0::DOUBLE / impressions_b)) AS z FROM pooled)
SELECT element, round(z, 6) AS z, CASE WHEN abs(z) > 1.96 THEN 1 ELSE 0 END AS significant FROM z""",
    "metric_table": """
WITH summed AS (SELECT element, sum(impressions)::DOUBLE AS i, sum(clicks)::DOUBLE AS c FROM element_stats GROUP BY 1)
SELECT element, 'impressions' AS metric, i AS value FROM summed
UNION ALL SELECT element, 'clicks', c FROM summed
UNION ALL SELECT element, 'ctr', round(c * 100 / nullif(i, 0), 6) FROM summed""",
    "validate_columns": """
SELECT 'user_id' AS column_name, 'bigint' AS wanted_type, count(*) AS n_rows, count(*) FILTER (user_id IS NULL) AS missing,
  count(*) FILTER (user_id IS NOT NULL AND try_cast(user_id AS BIGINT) IS NULL) AS failed FROM events
UNION ALL SELECT 'value', 'double', count(*), count(*) FILTER (value IS NULL),
  count(*) FILTER (value IS NOT NULL AND try_cast(value AS DOUBLE) IS NULL) FROM events
UNION ALL SELECT 'event_type', 'int', count(*), count(*) FILTER (event_type IS NULL OR trim(event_type) = ''),
  count(*) FILTER (trim(event_type) <> '' AND try_cast(event_type AS INT) IS NULL) FROM events
UNION ALL SELECT 'props', 'double', count(*), count(*) FILTER (props IS NULL OR trim(props) = ''),
  count(*) FILTER (trim(props) <> '' AND try_cast(props AS DOUBLE) IS NULL) FROM events""",
    "segment_rate_compare": """
WITH enquiries AS (
  SELECT DISTINCT hin.hit_id FROM hit_interaction_nameplate hin JOIN lookup_interaction li ON hin.interaction_id = li.interaction_id
  WHERE li.enquiry_flag = 1),
counted AS (
  SELECT count(DISTINCT CASE WHEN page_group = 'homepage' THEN visitor_id END) AS visitors_a,
    count(DISTINCT CASE WHEN page_group = 'models' THEN visitor_id END) AS visitors_b,
    count(DISTINCT CASE WHEN page_group = 'homepage' AND e.hit_id IS NOT NULL THEN visitor_id END) AS enquiries_a,
    count(DISTINCT CASE WHEN page_group = 'models' AND e.hit_id IS NOT NULL THEN visitor_id END) AS enquiries_b
  FROM hit h LEFT JOIN enquiries e ON h.hit_id = e.hit_id),
rated AS (
  SELECT *, enquiries_a * 100.0::DOUBLE / visitors_a AS rate_a, enquiries_b * 100.0::DOUBLE / visitors_b AS rate_b,
    (enquiries_a + enquiries_b)::DOUBLE / (visitors_a + visitors_b) AS p FROM counted),
scored AS (
  SELECT *, (enquiries_b::DOUBLE / visitors_b - enquiries_a::DOUBLE / visitors_a)
    / sqrt(p * (1 - p) * (1.0::DOUBLE / visitors_a + 1.0::DOUBLE / visitors_b)) AS z0 FROM rated)
SELECT 'homepage' AS segment_a, 'models' AS segment_b, visitors_a, visitors_b, enquiries_a, enquiries_b,
  round(rate_a, 6) AS rate_a, round(rate_b, 6) AS rate_b, round(rate_b - rate_a, 6) AS rate_change, round(z0, 6) AS z,
  CASE WHEN abs(z0) > 1.96 THEN 1 ELSE 0 END AS significant FROM scored""",
}

ORACLE: dict[str, str] = {name: with_views(sql) for name, sql in STATEMENTS.items()}
