"""URL parts, page classes and request parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.campaigns import extract_or_null


def without_query(path: Column) -> Column:
    """The part of a page path before any query string or fragment."""
    return extract_or_null(path, r"^[^?&#]+", 0)


def landing_class(host: Column, path: Column, excluded_host: str) -> Column:
    """'homepage' for a host's index page (one host is never a homepage), else 'other'."""
    local = F.replace(without_query(path), host, F.lit(""))
    is_home = (host != excluded_host) & (local == "/index.html")
    return F.when(is_home, "homepage").otherwise("other")


# Path words and content group of configurator pages.
CONFIGURATOR_PATHS = ("inspire", "curatedchoices", "summary", "jdxpayoff")
CONFIGURATOR_GROUP = "configurator"


def configurator_page(host: Column, path: Column, group: Column, host_word: str, host_name: str) -> Column:
    """True on the pages of the product configurator: its hosts' pages told by path word or content group."""
    by_path = reduce(Column.__or__, [path.contains(word) for word in CONFIGURATOR_PATHS])
    return (host.contains(host_word) | (host == host_name)) & (by_path | (group == CONFIGURATOR_GROUP))


def path_key(url: Column) -> Column:
    """A crawled URL in the form page paths are stored in."""
    return F.lower(F.replace(url, F.lit("https://"), F.lit("")))


def site_of(url: Column) -> Column:
    """Scheme and host."""
    return extract_or_null(url, r"^https?://[^/?#]+", 0)


def query_string(url: Column) -> Column:
    return extract_or_null(url, r"^[^?#]*\?([^#]*)", 1)


def parameter(encoded: Column, key: str) -> Column:
    """First non-blank value of ``key`` in a form-encoded string, name and value decoded.

    A '%' that starts no escape is kept as it is, as browsers do.
    """
    # Each sign of the name as itself or as its escape, so that names need no decoding first.
    name = "".join(f"(?:[{c}]|%{ord(c):02X}|%{ord(c):02x})" for c in key)
    raw = extract_or_null(encoded, f"(?:^|&){name}=([^&]+)", 1)
    return F.url_decode(F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25"))
