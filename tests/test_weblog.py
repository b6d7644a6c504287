"""Captured requests, links, clickable elements and reachable pages."""

import math
import random
import re
from html.parser import HTMLParser
from statistics import NormalDist, correlation

from pyspark.sql import functions as F

from sitelens.functions import normal
from sitelens.functions.urls import parameter
from sitelens.operators import crawl, pagestats, weblog
from sitelens.sources import warehouse
from tests.conftest import rows

LOG = "request_id long, method string, url string, body string, button_text string"
SENT = "Network.requestWillBeSent"


def test_collect_requests(spark):
    log = spark.createDataFrame(
        [
            (1, SENT, "https://x/g/collect?v=2", None, None),
            (2, SENT, "https://x/mp/collect", None, None),
            (3, SENT, "https://x/app.js", None, None),
            (4, "Network.responseReceived", "https://x/g/collect", None, None),
            (5, None, None, None, None),
        ],
        LOG,
    )
    assert [r[0] for r in rows(weblog.collect_requests(log).select("request_id"))] == [1, 2]


def test_precedence_of_url_and_body(spark):
    log = spark.createDataFrame(
        [
            (1, SENT, "https://x/g/collect?ep.event_label=U&ep.event_action=UA", "ep.event_label=B&ep.event_category=BC", "go"),
            (2, SENT, "https://x/g/collect?ep.event_label=&ep.event_action=UA", "ep.event_label=B", None),
            (3, SENT, "https://x/g/collect?ep.event_action=UA", None, None),
            (4, SENT, "https://x/g/collect?ep.event_action=UA", "", None),
        ],
        LOG,
    )
    assert rows(weblog.parse_merged(log)) == [
        (1, "B", "UA", "BC", "go"), (2, "B", "UA", "", ""), (3, "", "UA", "", ""), (4, "", "UA", "", ""),
    ]
    # as a fallback the body replaces every parameter, but only where the URL has no label
    assert rows(weblog.parse_fallback(log)) == [
        (1, "U", "UA", "", "go"), (2, "B", "", "", ""), (3, "", "UA", "", ""), (4, "", "", "", ""),
    ]


def test_extract_links(spark):
    html = """<A class="b" HREF='/one'>1</a> <a href="https://site.example/two?a=1&amp;b=2">2</a>
      <a href=/three>3</a> <a href="https://other.example/">x</a> <a href="mailto:me@x">m</a>
      <a href="#top">t</a> <a name="none">n</a> <abbr href="/no">z</abbr> <a data-href="/no" href="/four">4</a>"""
    pages = spark.createDataFrame([(1, "https://site.example/start", html)], "page_id long, url string, html string")
    base = "https://site.example"
    assert [r[0] for r in rows(weblog.extract_links(pages).select("link"))] == [
        f"{base}/four", f"{base}/one", f"{base}/three", f"{base}/two?a=1&b=2",
    ]
    moved = weblog.extract_links(pages, base=F.lit("https://other.example"))
    assert [r[0] for r in rows(moved.select("link"))] == [
        "https://other.example/", "https://other.example/four", "https://other.example/one", "https://other.example/three",
    ]


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        href = dict(attrs).get("href")
        if tag == "a" and href:
            self.found.append(href)


def test_links_of_given_pages_equal_an_html_parser(spark):
    pages = warehouse.scan_table(spark, "/root/testdata/sf0.001", "pages")
    expected = []
    for page in pages.collect():
        base = re.match(r"https?://[^/?#]+", page.url).group(0)
        parser = Anchors()
        parser.feed(page.html)
        links = [base + h if h.startswith("/") else h for h in parser.found if h.startswith(("/", "http"))]
        expected += [(page.page_id, page.url, link) for link in links if link.startswith(base)]
    assert rows(weblog.extract_links(pages)) == sorted(expected, key=lambda r: tuple(map(lambda x: (False, str(x)), r)))


def test_comments_and_scripts_hold_no_links(spark):
    html = """<!-- <a href="/c">c</a> --><script>x = '<a href="/s">s</a>';</script><style>a{}</style>
      <a href="/yes" class="cta">yes</a><!-- <button class="cta">b</button> -->"""
    pages = spark.createDataFrame([(1, "https://h.example/", html)], "page_id long, url string, html string")
    assert rows(weblog.extract_links(pages).select("link")) == [("https://h.example/yes",)]
    assert rows(weblog.clickable(pages).select("tag_name", "text")) == [("a", "yes")]


def test_all_and_distinct_links(spark):
    gb = spark.createDataFrame([("a",), ("b",)], "link string")
    de = spark.createDataFrame([("b",)], "link string")
    both = weblog.all_links({"GB": gb, "DE": de})
    assert rows(both) == [("DE", "b"), ("GB", "a"), ("GB", "b")]
    assert rows(weblog.distinct_links(both)) == [("a",), ("b",)]


def test_clickable(spark):
    html = """<button class="x cta-content big" aria-label="Go">Find&nbsp;out
      <b>more</b></button><a class="plain" href="/p" target="_blank">Explore <span class='secondary-link'>now</span></a>
      <span>nothing</span><button>Build &amp; order</button><spanner class="cta">no</spanner>"""
    pages = spark.createDataFrame([(7, html)], "page_id long, html string")
    by_class = weblog.clickable(pages).select("tag_name", "text", "classes", "aria_label")
    assert rows(by_class) == [("button", "Find out more", "x cta-content big", "Go"), ("span", "now", "secondary-link", None)]
    by_text = weblog.clickable(pages, "BUILD & o").select("tag_name", "text")
    assert ("button", "Build & order") in rows(by_text) and len(rows(by_text)) == 3
    link = weblog.clickable(pages, "explore").where("tag_name = 'a'").select("text", "href", "target")
    assert rows(link) == [("Explore now", "/p", "_blank")]


def test_pages_seen_are_not_shuffled_again(spark):
    """A round brings its own pages to those of the rounds before, which stay where they are."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in zip(names, ("-1", "false")):
            spark.conf.set(k, v)
        seen = [crawl._settled(spark.range(a, a + 500).select(F.col("id").alias("page"), F.lit(0).alias("depth"))) for a in (0, 500, 1000)]
        fresh = crawl.unseen(spark.range(400, 1700).select(F.col("id").alias("page")).distinct(), seen)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 3
        assert sorted(r.page for r in fresh.collect()) == list(range(1500, 1700))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rounds_are_merged(spark, monkeypatch):
    monkeypatch.setattr(crawl, "MERGED", 2)
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(5, 0), (3, 3)], "src long, dst long")
    assert {r.page: r.depth for r in crawl.link_closure(chain, [0]).collect()} == {i: i for i in range(10)}


def test_link_closure(spark):
    chain = [(i, i + 1) for i in range(20)] + [(20, 0), (5, 5), (99, 100), (3, 50), (0, 50)]
    hub = [(50, 1000 + i) for i in range(300)]
    edges = spark.createDataFrame(chain + hub, "src long, dst long")
    got = {r.page: r.depth for r in crawl.link_closure(edges, [0], most=20).collect()}
    assert set(got) == set(range(21)) | {50} | {1000 + i for i in range(300)}
    assert got[0] == 0 and got[20] == 20 and got[50] == 1 and got[1000] == 2
    assert crawl.link_closure(edges, [12345]).count() == 1


def test_keep_rule_order(spark):
    pages = spark.createDataFrame(
        [
            ("GB", "site/a", 100), ("FR", "site/a", 100), ("GB", "site/a", 99), ("GB", "Totals", 9999), ("GB", None, 9999),
            ("GB", "", 9999), ("GB", "site/b", 500), ("GB", "site/b", 501), ("FR", "site/b", 501), (None, "site/b", 501),
        ],
        "market_code string, page_path string, SessionsCount long",
    )
    links = spark.createDataFrame([("https://SITE/a",)], "link string")
    kept = pagestats.keep_pages(pages, links, ["GB"])
    assert rows(kept.where("keep = 1").select("market_code", "page_path", "SessionsCount")) == [
        ("FR", "site/a", 100), ("GB", "site/a", 100), ("GB", "site/b", 501),
    ]
    assert rows(pagestats.keep_check_counts(kept)) == [(0, 0, 5), (0, 1, 1), (1, 0, 1), (1, 1, 2)]


def test_histogram(spark):
    df = spark.createDataFrame([("a", v) for v in [0, 1, 5, 9, 10, 10]] + [("b", 4), ("b", 4), (None, 1), ("a", None)], "m string, v int")
    got = pagestats.metric_histogram(df, "v", by="m", bins=5)
    assert rows(got) == [
        ("a", 0, 0.0, 2), ("a", 2, 4.0, 1), ("a", 4, 8.0, 3), ("b", 0, 4.0, 2), (None, 0, 1.0, 1),
    ]


def test_normality(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", 3.0), ("b", 3.0)], "market_code string, v double")
    got = {r.market_code: r for r in pagestats.normality_test(df, ["v"]).collect()}
    assert abs(got["a"].jarque_bera - 1.9) < 0.2 and got["a"].is_normal == 1
    assert got["b"].jarque_bera is None and got["b"].is_normal == 0


def test_normal_functions(spark):
    at = [1e-12, 1e-6, 0.01, 0.02425, 0.3, 0.5, 0.7, 0.98, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in [*at, 0.0, 1.0]], "p double")
    got = [r[0] for r in df.select(normal.quantile(F.col("p"))).collect()]
    assert got[-2:] == [None, None]
    assert all(abs(x - NormalDist().inv_cdf(p)) < 1e-7 for x, p in zip(got, at))
    zs = [-6.0, -1.96, -0.1, 0.0, 0.5, 1.96, 5.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(normal.upper_tail(F.col("z"))).collect()]
    assert all(abs(x - math.erfc(z / 2**0.5) / 2) < 2e-7 for x, z in zip(got, zs))


def restated_shapiro(values):
    x, n = sorted(values), len(values)
    m = [NormalDist().inv_cdf((i + 0.625) / (n + 0.25)) for i in range(n)]
    w = correlation(x, m) ** 2
    u, v = math.log(n), math.log(math.log(n))
    z = (math.log(1 - w) + 1.2725 - 1.0521 * (v - u)) / (1.0308 - 0.26758 * (v + 2 / u))
    return w, math.erfc(z / 2**0.5) / 2


def test_shapiro_francia(spark):
    """Against a restatement: normal, skewed and tied values, a hot group cut into runs, and groups without a result."""
    draw = random.Random(2)
    groups = {
        "normal": [draw.gauss(5, 2) for _ in range(400)],
        "skewed": [draw.expovariate(1) for _ in range(300)],
        "tied": [float(draw.randint(1, 4)) for _ in range(200)],
        None: [draw.gauss(0, 1) for _ in range(50)],
        "hot": [draw.choice([0.0, draw.gauss(0, 1)]) for _ in range(30_000)],
    }
    none = {"few": [1.0, 2.0, 3.0, 9.0], "flat": [3.0] * 20, "one": [1.0]}
    given = [(g, v) for part in (groups, none) for g, values in part.items() for v in values]
    given += [("normal", None), ("normal", float("nan")), ("skewed", float("inf"))]
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(given)], "market_code string, v double, id long")
    got = {r.market_code: r for r in pagestats.shapiro_francia(df, ["v"], "id").collect()}
    for g, values in groups.items():
        w, p = restated_shapiro(values)
        assert got[g].n == len(values) and abs(got[g].shapiro_w - w) < 1e-7 and abs(got[g].shapiro_p - p) < 1e-6
    assert got["normal"].is_normal == 1 and got["skewed"].is_normal == got["hot"].is_normal == 0
    assert all(got[g].shapiro_p is None and got[g].is_normal == 0 for g in none)
    assert pagestats.shapiro_francia(df.limit(0), ["v"], "id").count() == 0


def test_hard_markup(spark):
    """Quoted '>', references by number, nesting, pages without a site, and pages that never close a tag."""
    html = """<a title="a>b" href="/kept">x</a><a title=' href=/no ' href="/two?a=1&#x26;b=2&#38;c&#x1F600;">y</a>
      <span class="cta">one <span>two</span> three</span>"""
    pages = spark.createDataFrame(
        [(1, "https://h.example/", html), (2, "not a url", html), (3, None, None)], "page_id long, url string, html string"
    )
    assert rows(weblog.extract_links(pages).select("page_id", "link")) == [
        (1, "https://h.example/kept"), (1, "https://h.example/two?a=1&b=2&c\U0001f600"),
    ]
    assert [r.text for r in weblog.clickable(pages.where("page_id = 1")).collect()] == ["one two three"]
    assert len(weblog.clickable(pages).columns) == 9
    hard = [(i, "https://h.example/", part * 8000 + end) for i, part in enumerate(("<span>x", "<a ", "<!--", "<a x='", "<script>")) for end in ("", "</span>")]
    broken = spark.createDataFrame(hard, "page_id long, url string, html string")
    assert weblog.clickable(broken, "x").count() <= 2 and weblog.extract_links(broken).count() == 0


def test_encoded_parameter_names(spark):
    df = spark.createDataFrame([("ep%2Eevent_label=A+b",), ("%65p.event%5flabel=A%20b",), ("xep.event_label=no",)], "q string")
    assert [r[0] for r in df.select(parameter(F.col("q"), "ep.event_label")).collect()] == ["A b", "A b", None]
