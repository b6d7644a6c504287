"""Main text of web pages: what a site repeats on many pages is its template.

A page is cut once into tags and text; elements are matched by name. Elements
get a hash of their subtree, Spark counts, per host, beside how many different
contents a subtree stands, and blocks inside subtrees that recur are deleted.
What a page says beside a subtree is told by its headlines outside of it, or by
its longest block if it has none: near copies of a page, whose date or advert
differs, are one content.
Inside an article only boxes (sections, lists) can be template, not paragraphs,
which may well be quoted twice. Parts that name themselves (navigation,
footers, forms, adverts, notices, comments of readers) go by their tag, role or
class; where a page marks its article, the rest of the page is left out. A part
that holds the page's only article, or most of its text under a name that
sites also give to wrappers, is no such part and stays.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import batch, plain, table, written
from sitelens.operators.skew import salted_join

#: A subtree outside an article is template beside this many contents of a host, if these are this share of its pages or more;
#: one inside an article on this many pages, if these are that share of the host's.
MIN_PAGES, MIN_SHARE, MIN_SHARE_INSIDE = 3, 0.5, 0.1

# A quoted value may hold ">". A tag or comment that never ends goes on to the end of the page, so no sign is read twice.
TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<(script|style|template|noscript|textarea|title|iframe|svg)\b(?:[^"'>]++|"[^"]*+"|'[^']*+'|["'])*+(?:>(?:.*?</\1\s*+>|.*)|\Z)"""
    r"""|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""",
    re.S | re.I,
)
#: Every attribute in turn, so that no name is looked for inside a value or another name.
NAMED = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?|"[^"]*+"|'[^']*+'""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("nav header footer aside form button select menu dialog head object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside widget ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe signup login share sharing social related recommended comment comments respond disqus "
    "reply replies pagination pager toolbar skip".split()
)
#: What a name ends with that only holds the thing named before; what undoes the word after it; whose header is the article's own.
HOLDERS = frozenset("list slot box container wrapper wrap area block section unit bar panel item items link links zone inner outer body group row buttons icons posts widgets".split())
UNDONE = frozenset("has no with without".split())
TITLED = frozenset("entry post article section story content title".split())
KEPT = frozenset(("article", "main"))
HEADLINES = ("h1", "h2", "h3")
BOXES = frozenset("div section ul ol dl table figure fieldset center".split())


def called(token: str) -> bool:
    """Whether a class or id names something beside the article, by its head word: top-menu, comment-list, but not has-sidebar."""
    if token in WORDS:
        return True
    parts = re.split("[-_]+", token)
    while len(parts) > 1 and parts[-1] in HOLDERS:
        parts.pop()
    before = parts[-2] if len(parts) > 1 else ""
    return parts[-1] in WORDS and before not in UNDONE and not (parts[-1] == "header" and before in TITLED)


def named(attributes: str) -> bool:
    """Whether an element says itself that it is no part of the article."""
    for m in NAMED.finditer(attributes):
        name, value = (m.group(1) or "").lower(), (m.group(2) or "").strip("\"'").lower()
        if name in ("class", "id"):
            if any(map(called, value.split())):
                return True
        elif name == "role":
            if value in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


class Element:
    __slots__ = ("name", "drop", "keep", "holds", "parts", "first", "doubt")

    def __init__(self, name: str, drop: bool, keep: bool, first: int, doubt: tuple[int, int, int, bool] | None = None):
        self.name, self.drop, self.keep, self.first, self.doubt = name, drop, keep, first, doubt
        self.holds = False  # an article
        self.parts: list[str] = []  # what the hash of the subtree is taken of


def blocks(page: str | None) -> tuple[list[tuple[str, bool]], list[tuple[int, int, int, bool]]]:
    """Blocks of text as (text, inside the article), and the subtrees as (first block, end, hash, inside)."""
    found, trees = cut(page)
    return [(text, inside) for text, inside, _ in found], trees


def cut(
    page: str | None, spared: frozenset[int] | None = None
) -> tuple[list[tuple[str, bool, bool]], list[tuple[int, int, int, bool]]]:
    """As ``blocks``, which also has whether a block is a headline.

    Unclosed elements end with what holds them; a closing tag without an
    opening one is nothing. Blocks in dropped parts are left out. ``spared``
    has the places of tags whose elements stay whatever they are called; by
    default these are found first: elements that hold an article while no other
    article stands on the page, and those that only their names or attributes,
    or being a form, would drop with more than half of the page's text (beside an
    article they hold none of it, so there only those inside it).
    """
    found: list[tuple[str, bool, bool]] = []
    trees: list[tuple[int, int, int, bool]] = []
    open_: list[Element] = [Element("", False, False, 0)]
    counts: dict[str, int] = {}
    line: list[str] = []
    dropped = 0  # open elements that are dropped
    read = articles = free = 0  # signs of text, articles, and articles outside dropped elements so far
    doubts: list[tuple[int, int, int, bool, bool]] = []  # of dropped elements: place, signs, articles, by name alone, inside

    def flush() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if text:
            found.append((text, open_[-1].keep, any(counts.get(h) for h in HEADLINES)))
            open_[-1].parts.append(text)

    def close() -> None:
        nonlocal dropped
        e = open_.pop()
        counts[e.name] -= 1
        if e.drop:
            dropped -= 1
            place, signs, held, soft = e.doubt
            doubts.append((place, read - signs, articles - held, soft, e.keep))
            return
        open_[-1].holds |= e.holds or e.keep and not open_[-1].keep
        if len(found) > e.first and (e.name in BOXES if e.keep else not e.holds and e.name not in INLINE):
            own = hashed(f"<{e.name}>{'|'.join(e.parts)}</>")
            trees.append((e.first, len(found), own, e.keep))
            open_[-1].parts.append(f"<{own}>")  # a hash of hashes: nesting adds no length
        elif e.parts:
            open_[-1].parts.extend(e.parts)

    def text(piece: str) -> None:
        nonlocal read
        read += len(piece.strip())
        if piece and not dropped:
            line.append(piece)

    at, source = 0, page or ""
    for m in TOKEN.finditer(source):
        text(source[at : m.start()])
        at = m.end()
        if not m.group(3):
            if m.group(1):
                line.append(" ")
            continue  # a comment, a declaration or an element whose text is no text
        name = m.group(3).lower()
        if name not in INLINE:
            if name == "br":
                text(" ")
                continue
            if not dropped:
                flush()
        if m.group(2):
            if counts.get(name):
                while open_[-1].name != name:
                    close()
                if not dropped:
                    flush()
                close()
            continue
        if name in VOID or m.group(4).endswith("/"):
            continue
        if name in ("p", "li", "tr", "td", "th", "option", "dt", "dd") and open_[-1].name == name:
            close()  # its end tag may be left out
        inside = open_[-1].keep
        # The headline of an article may stand in a header of its own.
        hard = name in DROPPED and not (name == "header" and inside)
        drop = (hard or name not in ("html", "body", *KEPT) and named(m.group(4))) and not (spared and m.start() in spared)
        doubt = (m.start(), read, articles, not hard or name == "form") if drop else None
        if name in KEPT:
            articles, free = articles + 1, free + (not dropped)
        dropped += drop
        open_.append(Element(name, drop, inside or name in KEPT, len(found), doubt))
        counts[name] = counts.get(name, 0) + 1
    text(source[at:] if "<" not in source[at:] else source[at:].partition("<")[0])
    if not dropped:
        flush()
    while len(open_) > 1:
        close()
    if spared is None:
        stay = frozenset(at for at, signs, held, soft, inside in doubts if held and not free or soft and 2 * signs > read and (not free or inside))
        if stay:
            return cut(page, stay)
    return found, trees


PARSED = (
    "page_id long, url string, host string, page long, texts array<string>, "
    "trees array<struct<first:int,end:int,hash:long,inside:boolean,beside:long>>"
)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def parsed(page: str | None) -> tuple[list[str], list[dict]]:
    """Texts of the blocks that may be kept, and the subtrees with their places among them."""
    found, trees = cut(page)
    article = any(inside for _, inside, _ in found)
    kept = [block for block in found if block[1] or not article]
    places = [0]  # of a block among those kept
    for _, inside, _ in found:
        places.append(places[-1] + (inside or not article))
    texts = [text for text, _, _ in kept]
    beside = told_outside(texts, [i for i, block in enumerate(kept) if block[2]])
    return texts, [
        {"first": places[a], "end": places[b], "hash": own, "inside": inside, "beside": beside(places[a], places[b])}
        for a, b, own, inside in trees
        if places[a] < places[b]
    ]


def told_outside(texts: list[str], headlines: list[int]):
    """A function of two places: a hash of the headlines not between them, else of the longest text (the first of equals), 0 for no text."""
    before, behind = [-1], [-1]  # the longest text of the first i, and of the last i
    for i, text in enumerate(texts):
        at = before[-1]
        before.append(i if at < 0 or len(text) > len(texts[at]) else at)
    for i in reversed(range(len(texts))):
        at = behind[-1]
        behind.append(i if at < 0 or len(texts[i]) >= len(texts[at]) else at)
    above, below = [0], [0]  # hashes of the first i headlines, and of the last i
    for way, order in ((above, headlines), (below, reversed(headlines))):
        for i in order:
            way.append(hashed(f"{way[-1]} {texts[i]}"))
    hashes: dict[int, int] = {-1: 0}

    def of(first: int, end: int) -> int:
        i, j = bisect_left(headlines, first), bisect_left(headlines, end)
        if i or j < len(headlines):
            return hashed(f"{above[i]} {below[len(headlines) - j]}")
        a, b = before[first], behind[len(texts) - end]
        at = b if a < 0 or b >= 0 and len(texts[b]) > len(texts[a]) else a
        if at not in hashes:
            hashes[at] = hashed(texts[at])
        return hashes[at]

    return of


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("hash", pa.int64()), ("inside", pa.bool_()), ("beside", pa.int64())])
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("page", pa.int64())]
        + [("texts", pa.list_(pa.string())), ("trees", pa.list_(tree))]
    )
    for b in batches:
        rows = []
        for i, url, page in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            host = HOST.match(url or "")
            rows.append((i, url, host.group(1).lower() if host else "", hashed(page or ""), *parsed(page)))
        yield batch(rows, schema)


def templates(pages: DataFrame, least: int, share: float, share_inside: float) -> DataFrame:
    """(host, page, hash, inside) of the subtrees that recur. Copies of a page count once.

    What the pages hold is written once as rows of hashes, which all counting
    reads; a subtree on a great many pages is split for the join back to them.
    """
    tree = ["host", "hash", "inside"]
    held = pages.select("host", "page", F.explode_outer("trees").alias("t")).select("host", "page", "t.hash", "t.inside", "t.beside")
    seen = written(held.groupBy("host", "page", "hash", "inside").agg(F.min("beside").alias("beside")))
    total = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    seen = seen.where(F.col("hash").isNotNull())
    contents = seen.groupBy(*tree, "beside").agg(F.count("*").alias("pages"))
    counts = contents.groupBy(*tree).agg(F.count("*").alias("contents"), F.sum("pages").alias("pages"))
    enough = F.when(F.col("inside"), F.col("pages") >= share_inside * F.col("total")).otherwise(
        F.col("contents") >= share * F.col("pages")
    )
    many = F.when(F.col("inside"), F.col("pages")).otherwise(F.col("contents")) >= least
    # A host has far fewer recurring subtrees than pages, but no number is proven: salted, not broadcast.
    recurring = counts.where(many).join(total, "host").where(enough).select(F.struct(*tree).alias("tree"), F.lit(True).alias("recurs"))
    found = salted_join(seen.select("page", F.struct(*tree).alias("tree")), recurring, "tree", ["page"])
    return found.where("recurs").select("page", "tree.*")


def extract_text(
    pages: DataFrame, least: int = MIN_PAGES, share: float = MIN_SHARE, share_inside: float = MIN_SHARE_INSIDE
) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null, empty and text-free html gives an empty text. Pages without a host in
    their url share the host ''. Repeated rows are kept; equal pages of a host, and
    pages that agree in what tells their content beside a subtree, count once when template outside an article is looked for. A page that would lose all its
    blocks is a copy rather than template and keeps them. Nothing is cut off.
    """
    read = plain(pages, page_id="long", url="string", html="string").mapInArrow(_parse, PARSED)
    # Equal pages of a host lose the same blocks, so the content stands for the row.
    gone = (
        templates(read, least, share, share_inside)
        .groupBy("host", "page")
        .agg(F.collect_set(F.struct("hash", "inside")).alias("gone"))
    )

    def lost(i):
        return F.exists(
            "trees",
            lambda t: (t["first"] <= i)
            & (i < t["end"])
            & F.array_contains("gone", F.struct(t["hash"].alias("hash"), t["inside"].alias("inside"))),
        )

    rest = F.filter("texts", lambda _, i: ~lost(i))
    kept = F.when(F.col("gone").isNull() | (F.size(rest) == 0), F.col("texts")).otherwise(rest)
    text = F.array_join(kept, " ")
    joined = read.join(gone, ["host", "page"], "left").select("page_id", "url", text.alias("text"))
    return joined.withColumn("n_chars", F.length("text").cast("long"))


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
