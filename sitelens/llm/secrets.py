"""Secrets in text, and credentials whose parts stand near each other.

Only Spark's own functions: each pattern brackets its matches with a mark, the
text is split at the mark, and lengths of the pieces add up to positions. The
candidates of all kinds then meet by document. Access identifiers, secrets and
endpoints are linked inside a scope: a section where the text has section
headers, else a block between blank lines. Windows over positions and lines
return the nearest partner and no pairs; weak candidates are reported only where
their complement lies in reach, or on another line of the same run of settings
at any distance. One shuffle carries the candidates, with each document's other
columns once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import plain, table

#: In the order in which spans of equal start are listed; the first three are always reported.
KINDS = ("assign", "access", "hex", "weak_secret", "identifier", "endpoint")
BASE = KINDS[:3]
#: Code points between the end of one part and the start of the next, where no run of settings holds both.
REACH = 200

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "weak_secret": r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])",
    "identifier": r"""(?i)(?<![a-z])(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[a-z0-9@._-]{3,}""",
    "endpoint": r"""(?i)https?://[a-z0-9._~:/?#@!$&()*+,;=%-]+|(?<![a-z])(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9.:_-]{4,}""",
}
MARK, OTHER, WALL, PROSE = "\x01", "\x02", "\x03", "\x04"
END = r"[\x20\t\r]*+(?:\n|\z)"
#: The line break before a section's header or a rule, before a blank line, and before a line that is no setting, comment or single word.
SECTION = rf"\n(?=[\x20\t]*+(?:\[[^\[\]\n=]++\]|-{{3,}}+|={{3,}}+|```\w*+){END})"
BLANK = rf"\n(?={END})"
LOOSE = (
    r"""\n(?![\x20\t]*+(?:[#;/*<>{}\[\]()"'|-]|(?:[^\s=:]++[\x20\t]*+){1,4}[=:]|\S*+"""
    + END
    + r"))"
)
SECRET, ACCESS, PLACE = ("assign", "hex", "weak_secret"), ("access", "identifier"), ("endpoint",)


def scoped(text: Column) -> Column:
    """The text with WALL for the line break before each scope, PROSE for that before each line that ends a run of settings."""
    # No sign swapped here is part of any pattern, so that no match and no length changes.
    clean = F.translate(text, MARK + WALL + PROSE, OTHER * 3)
    walls = F.when(clean.rlike(SECTION) | clean.rlike(rf"\A{SECTION[2:]}"), F.regexp_replace(clean, SECTION, WALL)).otherwise(
        F.regexp_replace(clean, BLANK, WALL)
    )
    return F.regexp_replace(walls, LOOSE, PROSE)


def pieces(text: Column, kind: str) -> Column:
    """The scoped text cut at its matches: between, match, between, match, ..., rest."""
    return F.split(F.regexp_replace(text, F.lit(PATTERNS[kind]), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def proposals(cut: Column, kind: str) -> Column:
    """Array of (kind, n, gap, walls, loose, lines, value): the n-th match, and the code points, scopes, ends of runs and line breaks between it and the one before."""

    def hit(n: Column) -> Column:
        gap = F.element_at(cut, 2 * n - 1)

        def count(signs: str) -> Column:
            return F.length(gap) - F.length(F.translate(gap, signs, ""))

        return F.struct(
            F.lit(kind).alias("kind"),
            n.alias("n"),
            F.length(gap).alias("gap"),
            count(WALL).alias("walls"),
            count(PROSE).alias("loose"),
            count("\n" + WALL + PROSE).alias("lines"),
            F.element_at(cut, 2 * n).alias("value"),
        )

    count = F.floor(F.size(cut) / 2).cast("int")
    return F.transform(F.slice(F.sequence(F.lit(0), count), F.lit(2), F.greatest(count, F.lit(0))), hit)


def confirmed() -> Column:
    kind, value = F.col("kind"), F.col("value")
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    return (
        F.when(kind == "assign", F.length(F.regexp_extract(value, ASSIGN, 2)) >= 6)
        .when(kind == "weak_secret", mixed)
        .otherwise(F.lit(True))
    )


def find_secrets(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """Rows of ``documents`` with ``secrets``: array of (kind, start, end, value, access_at, secret_at, endpoint_at).

    The last three are where the nearest complement of the same scope begins,
    null if there is none: from the end of one to the start of the other
    ``reach`` code points at most, or any number between two lines of one run of
    settings. Null and empty texts have an empty
    array; repeated rows are kept, each judged by itself; a column named
    ``secrets`` is replaced; an empty table gives no rows. A weak secret needs an access identifier or an
    identifier in reach, an identifier a secret, an endpoint both.
    """
    kept = [c for c in documents.columns if c != "secrets"]
    text = F.coalesce(F.col("`text`").cast("string"), F.lit("")) if "text" in documents.columns else F.lit("")
    own = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"),
        scoped(text).alias("scoped"),
    ).select("row", "doc", *(pieces(F.col("scoped"), k).alias(k) for k in KINDS)).select("row", "doc", F.concat(*(proposals(F.col(k), k) for k in KINDS)).alias("found"))
    each = (
        own.select("row", "doc", F.posexplode_outer("found").alias("pos", "c"))
        .select("row", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("doc")).alias("doc"), "c.*")
        .repartition("row")
    )
    by_kind = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(by_kind))
        .withColumn("start", F.col("end") - F.length("value"))
        .withColumns({c: F.sum(c).over(by_kind) for c in ("walls", "loose", "lines")})
    )
    # Frames that only grow, so that a document of many candidates costs no more than its length.
    scope, run = Window.partitionBy("row", "walls"), Window.partitionBy("row", "walls", "loose")
    before, after = (scope.orderBy(c).rangeBetween(Window.unboundedPreceding, 0) for c in (F.asc("start"), F.desc("start")))
    above, below = (run.orderBy(c).rangeBetween(Window.unboundedPreceding, -1) for c in (F.asc("lines"), F.desc("lines")))
    good = placed.withColumn("good", F.col("kind").isNotNull() & confirmed())

    def nearest(kinds: tuple[str, ...]) -> Column:
        own = F.col("good") & F.col("kind").isin(*kinds)
        # The latest end before and the first start after; (gap, start) of the nearest.
        ends, starts = F.when(own, F.struct("end", "start")), F.when(own, F.col("start"))

        def left(w) -> Column:
            last = F.max(ends).over(w)
            return F.when(last.isNotNull(), F.struct(F.greatest(F.col("start") - last["end"], F.lit(0)).alias("gap"), last["start"].alias("at")))

        def right(w) -> Column:
            first = F.min(starts).over(w)
            return F.when(first.isNotNull(), F.struct(F.greatest(first - F.col("end"), F.lit(0)).alias("gap"), first.alias("at")))

        near = F.least(left(before), right(after))
        far = F.least(left(above), right(below))
        return F.when(own, F.col("start")).when(near["gap"] <= reach, near["at"]).otherwise(far["at"])

    linked = good.select(
        "row",
        "doc",
        "good",
        "kind",
        "start",
        "end",
        "value",
        nearest(ACCESS).alias("access_at"),
        nearest(SECRET).alias("secret_at"),
        nearest(PLACE).alias("endpoint_at"),
    )
    complete = (
        F.when(F.col("kind") == "weak_secret", F.col("access_at").isNotNull())
        .when(F.col("kind") == "identifier", F.col("secret_at").isNotNull())
        .when(F.col("kind") == "endpoint", F.col("access_at").isNotNull() & F.col("secret_at").isNotNull())
        .otherwise(F.lit(True))
    )
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "end", "kind", "value", "access_at", "secret_at", "endpoint_at")
    spans = F.array_sort(F.collect_list(F.when(F.col("good") & complete, span)))
    return (
        linked.groupBy("row")
        .agg(F.max(F.struct(F.col("doc").isNotNull().alias("has"), F.col("doc"))).alias("own"), spans.alias("spans"))
        .select(
            *(F.col(f"own.doc.`{c}`").alias(c) for c in kept),
            F.transform(
                "spans",
                lambda s: F.struct(
                    *(s[n].cast(t).alias(n) for n, t in zip(FIELDS, TYPES)),
                ),
            ).alias("secrets"),
        )
    )


FIELDS = ("kind", "start", "end", "value", "access_at", "secret_at", "endpoint_at")
TYPES = ("string", "int", "int", "string", "int", "int", "int")


def masked(text: Column, spans: Column, by: str = "[secret]") -> Column:
    """The text with every span, merged where they overlap, replaced by ``by``."""
    seed = F.expr("cast(array() AS array<struct<start:int,end:int>>)")

    def merge(done, s):
        last = F.element_at(done, -1)
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]), F.concat(rest, F.array(wider))).otherwise(
            F.concat(done, F.array(own))
        )

    whole = F.aggregate(spans, seed, merge)
    starts = F.concat(F.array(F.lit(0)), F.transform(whole, lambda s: s["end"]))
    ends = F.concat(F.transform(whole, lambda s: s["start"]), F.array(F.length(text)))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.substr(text, z["a"] + 1, z["b"] - z["a"]))
    return F.when(F.size(spans) > 0, F.array_join(pieces, by)).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    documents = plain(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    return digest(find_secrets(documents))
