"""Captured analytics requests, page links and clickable elements."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.markup import attributes, closed_elements, shown
from sitelens.functions.urls import parameter, query_string, site_of

# The request method, URL parts, parameter names, clickable tags
# and class snippets of the captured pages.
REQUEST_METHOD = "Network.requestWillBeSent"
COLLECT_PATHS = ("g/collect", "mp/collect")
EVENT_PARAMETERS = {
    "event_label": "ep.event_label",
    "event_action": "ep.event_action",
    "event_category": "ep.event_category",
}
CLICKABLE_TAGS = ("button", "a", "span")
CLASS_SNIPPETS = ("primary-link icon-dx-search-inventory", "cta-content", "secondary-link", "cta")
ELEMENT_ATTRIBUTES = ("class", "href", "data-target", "data-link-type", "aria-label", "target")
ELEMENT_COLUMNS = ("classes", "href", "data_target", "data_link_type", "aria_label", "target")


def collect_requests(log: DataFrame) -> DataFrame:
    """Sent requests whose URL is an analytics collect call."""
    url = F.col("url")
    is_collect = reduce(Column.__or__, [url.contains(p) for p in COLLECT_PATHS])
    return log.where((F.col("method") == REQUEST_METHOD) & is_collect)


def parse_merged(log: DataFrame) -> DataFrame:
    """Event fields where the body's value of a parameter wins over the URL's."""
    query, body = query_string(F.col("url")), F.col("body")
    fields = [
        F.coalesce(parameter(body, key), parameter(query, key), F.lit("")).alias(name)
        for name, key in EVENT_PARAMETERS.items()
    ]
    return log.select("request_id", *fields, F.coalesce("button_text", F.lit("")).alias("button_text"))


def parse_fallback(log: DataFrame) -> DataFrame:
    """Event fields from the URL, or all of them from the body if the URL has no label."""
    query, body = query_string(F.col("url")), F.col("body")
    label = EVENT_PARAMETERS["event_label"]
    use_body = parameter(query, label).isNull() & body.isNotNull()
    fields = [
        F.coalesce(F.when(use_body, parameter(body, key)).otherwise(parameter(query, key)), F.lit("")).alias(name)
        for name, key in EVENT_PARAMETERS.items()
    ]
    return log.select("request_id", *fields, F.coalesce("button_text", F.lit("")).alias("button_text"))


def _unquoted(value: Column) -> Column:
    return F.btrim(value, F.lit("\"'"))


NUMBERED = r"^(?i)(?:x([0-9a-f]{1,6})|([0-9]{1,7}));"


def _numbered(piece: Column) -> Column:
    """What follows a '&#', with its number decoded if it is one."""
    hexadecimal, decimal = F.regexp_extract(piece, NUMBERED, 1), F.regexp_extract(piece, NUMBERED, 2)
    code = F.when(hexadecimal != "", hexadecimal).otherwise(F.hex(decimal.cast("bigint")))
    valid = piece.rlike(NUMBERED) & F.conv(code, 16, 10).cast("bigint").between(1, 0x10FFFF)
    sign = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
    return F.when(valid, F.concat(sign, F.regexp_replace(piece, NUMBERED, ""))).otherwise(F.concat(F.lit("&#"), piece))


def _unescaped(text: Column) -> Column:
    """Numbers and the common names, '&amp;' last so that nothing is decoded twice."""
    pieces = F.split(text, "&#")
    rest = F.transform(F.slice(pieces, 2, F.size(pieces)), _numbered)
    plain = F.when(text.contains("&#"), F.concat(pieces[0], F.array_join(rest, ""))).otherwise(text)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(text.contains("&"), plain).otherwise(text)


# What looks like an element inside a comment, script or style is not one: these are matched
# whole in the same pass, and leave the captured group empty. Runs are possessive, and what never
# ends goes on to the end of the page, so that no sign is read twice.
SKIPPED = r"!--(?:.*?-->|.*)|(?:script|style)(?=[\s>])(?:.*?</(?:script|style)\s*>|.*)"
ANCHOR = rf"(?is)<(?:{SKIPPED}|a(\s(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\z))"
VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']++)"
HREF = rf"(?is)^(?:\s*+(?!href\s*=)[^\s=]++(?:\s*+=\s*+{VALUE})?)*+\s*+href\s*=\s*({VALUE})"


def extract_links(pages: DataFrame, base: Column | None = None) -> DataFrame:
    """Links of each page that stay on its site.

    A link starting with '/' is put behind the base (by default the scheme and
    host of the page's own URL); other links must start with 'http'; only links
    that start with the base are kept. One row per anchor, repeats included; a
    page without a base has no links of its site.
    """
    site = site_of(F.col("url")) if base is None else base
    found = pages.select(
        "page_id", "url", site.alias("base"), F.explode(F.regexp_extract_all("html", F.lit(ANCHOR), 1)).alias("inside")
    ).where("inside <> '' AND base IS NOT NULL")
    href = _unescaped(_unquoted(F.regexp_extract("inside", HREF, 1)))
    inside = href.startswith("/")
    link = F.when(inside, F.concat("base", href)).otherwise(href)
    on_site = inside | (href.startswith("http") & href.startswith(F.col("base")))
    return found.where(on_site).select("page_id", "url", link.alias("link"))


def all_links(by_market: dict[str, DataFrame]) -> DataFrame:
    """Per-market link lists as one list."""
    parts = [df.select(F.lit(market).alias("market_code"), "link") for market, df in by_market.items()]
    return reduce(DataFrame.unionByName, parts)


def links_by_market(links: DataFrame) -> DataFrame:
    """Links that carry their market already, as one list from one scan."""
    return links.select("market_code", "link")


def distinct_links(links: DataFrame) -> DataFrame:
    return links.select("link").distinct()


def clickable(pages: DataFrame, text: str | None = None) -> DataFrame:
    """Buttons, anchors and spans worth clicking.

    Kept are elements whose text contains ``text`` (any case) or whose class
    contains one of the class snippets; without ``text`` the class decides. The
    text is the element's content with tags removed, that of nested elements
    included; an element without its closing tag is none. Whether an element is
    visible cannot be told from stored HTML.
    """
    id_type = pages.schema["page_id"].dataType
    columns = ["tag_name", "text", *ELEMENT_COLUMNS]
    schema = T.StructType([T.StructField("page_id", id_type), *(T.StructField(c, T.StringType()) for c in columns)])
    wanted = text.upper() if text else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page, source in zip(frame["page_id"], frame["html"]):
                for name, inside, part in closed_elements(source or "", CLICKABLE_TAGS):
                    have = attributes(inside)
                    by_class = any(s in have.get("class", "") for s in CLASS_SNIPPETS)
                    if by_class or wanted:  # the text of others is not put together
                        content = shown(part)
                        if by_class or wanted in content.upper():
                            rows.append((page, name, content, *(have.get(a) for a in ELEMENT_ATTRIBUTES)))
            yield pd.DataFrame(rows, columns=["page_id", *columns])

    return pages.select("page_id", "html").mapInPandas(run, schema)
