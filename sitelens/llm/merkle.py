"""A Merkle manifest of a table of documents, with a proof for every row.

Each language is a binary tree over its documents' leaves; the languages'
subroots are the leaves of one more tree. Of the levels of a tree only every
``step``-th is kept, written as one row per aligned subtree with the nodes at its
foot. Everything between is computed again when it is wanted: a subtree's
interior nodes from its stored foot, the siblings on the way from each of these
nodes to the subtree's top, and then they are forgotten. Paths are put together
from the root downwards, one join by subtree for each stored level, so a
language of any size is spread over its subtrees of at most 2 ** ``step`` nodes.

Only Spark's own functions; a text is read once and no later step carries it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import keyed, plain, table, written

#: Levels from one that is kept to the next.
STEP = 8
DOCUMENT = dict(doc_id="bigint", source="string", lang="string", n_chars="bigint", text="string")
PATH = "array<struct<sibling:string,left:boolean>>"


def leaf(*fields: Column) -> Column:
    """SHA-256 of the fields, each as its UTF-8 length, a colon and its text, or a dash for null."""
    texts = [f.cast("string") for f in fields]
    named = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.sha2(F.concat(*(F.coalesce(n, F.lit("-")) for n in named)), 256)


def document_leaf(n_chars: Column | None = None) -> Column:
    columns = {c: F.col(c) for c in DOCUMENT} | ({} if n_chars is None else {"n_chars": n_chars})
    return leaf(*columns.values())


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def up(node: Column, step: Column) -> Column:
        other = F.coalesce(step["sibling"], F.lit(""))
        return F.sha2(F.when(step["left"], F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(path, start, up)


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from leaf to root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), ""), 256)


@dataclass(frozen=True)
class Manifest:
    """``subroots``: lang, subroot, n (leaves). ``proofs``: per row lang, position, leaf, the carried
    columns, subroot, root and path, an array of (sibling, left) from the leaf to the root;
    a node without a sibling is hashed alone and has a null there."""

    subroots: DataFrame
    proofs: DataFrame

    def root(self) -> str | None:
        """The root; None for an empty table."""
        row = self.proofs.select("root").first()
        return row and row["root"]


def merkle_manifest(documents: DataFrame, step: int = STEP, **carried: Column) -> Manifest:
    """The manifest of ``documents`` (doc_id, source, lang, n_chars, text; what is missing is null).

    Leaves of a language ascend by doc_id (null first), then by their digest, so
    rows with one doc_id have a defined place and repeated rows one each. A null
    language comes first. An empty table has no subroots, no proofs and no root.
    ``carried`` are further columns of those five, computed while the text is at
    hand and returned beside the proofs; other columns take no part.
    """
    if step < 1:
        raise ValueError("a subtree needs at least one level")
    own = plain(documents, **DOCUMENT).select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"),
        document_leaf().alias("digest"),
        F.struct("lang", "doc_id", *(c.alias(name) for name, c in carried.items())).alias("given"),
    )
    rows = keyed(written(own)).withColumn("place", F.xxhash64("_key")).drop("_key")
    stored, tops = grown(placed(rows, "given.doc_id", "digest", "place"), step)
    named = tops.select(
        F.lit("").alias("tree"), "digest", F.struct(F.col("tree").alias("of"), "n").alias("given")
    )
    crown, peak = grown(placed(named, "given.of"), step)
    end = peak.select("tree", F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot"), F.array().cast(PATH).alias("path"))
    above = proven(crown, end, step).select(
        F.col("given.of").alias("tree"), F.col("digest").alias("subroot"), "root", "path", "given.n"
    )
    above = written(above)
    lang = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    proofs = proven(stored, above.drop("n"), step)
    return Manifest(
        above.select(lang.alias("lang"), "subroot", "n"),
        proofs.select("given.*", "pos", F.col("digest").alias("leaf"), "subroot", "root", "path"),
    )


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with their place ``pos`` in their tree, from 0, and the tree's number of rows ``n``.

    Rows are range-sorted by tree and order and numbered as they lie; the first
    number and the size of each piece of a tree, of which there are as many as
    partitions and trees, tell the rest.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    kept = written(ranged.select("tree", "digest", "given", F.monotonically_increasing_id().alias("row")))
    kept = kept.withColumn("part", F.shiftright("row", 33))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        kept.groupBy("tree", "part")
        .agg(F.min("row").alias("first"), F.count("*").alias("held"))
        .select(
            "tree",
            "part",
            (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("held").over(Window.partitionBy("tree")).alias("n"),
        )
    )
    return kept.join(parts, ["tree", "part"]).select(
        "tree", (F.col("row") + F.col("shift")).alias("pos"), "n", "digest", "given"
    )


def grown(nodes: DataFrame, step: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels, from the leaves up, and each tree's top (tree, digest, n).

    A level is kept as one row per subtree: tree, block, n (nodes of the tree on
    this level), all (its leaves) and foot, the nodes in order.
    """
    width = 1 << step
    most = nodes.agg(F.max("n")).first()[0] or 0
    nodes = nodes.withColumn("all", F.col("n"))
    stored, tops = [], None
    while tops is None or most > 1:
        blocks = written(
            nodes.groupBy("tree", F.shiftright("pos", step).alias("block"), "n", "all").agg(
                F.sort_array(F.collect_list(F.struct("pos", "digest", "given"))).alias("foot")
            )
        )
        stored.append(blocks)
        top = F.element_at(F.element_at("levels", -1), 1)
        met = with_levels(blocks, step).select("tree", "block", "n", "all", top.alias("digest"))
        done = met.where(F.col("n") <= width).select("tree", "digest", F.col("all").alias("n"))
        tops = done if tops is None else tops.unionByName(done)
        if most <= width:
            break
        nodes = met.where(F.col("n") > width).select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("n") / width).alias("n"), "all", "digest", F.lit(None).alias("given")
        )
        most = -(-most // width)
    return stored, tops


def regrown(step: int) -> Column:
    """All levels of a subtree, computed from its ``foot``; the top subtree of a tree ends at its only node."""
    alone = F.col("n") <= 1 << step

    def parents(level: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
        other = lambda i: F.coalesce(F.get(level, 2 * i + 1), F.lit(""))
        return F.transform(pairs, lambda i: F.sha2(F.concat(F.get(level, 2 * i), other(i)), 256))

    def up(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        return F.when(alone & (F.size(last) == 1), levels).otherwise(F.concat(levels, F.array(parents(last))))

    foot = F.transform("foot", lambda node: node["digest"])
    return F.aggregate(F.sequence(F.lit(1), F.lit(step)), F.array(foot), up)


def with_levels(blocks: DataFrame, step: int) -> DataFrame:
    """``blocks`` with their ``levels``, computed once per subtree: what a generator returns is not computed anew where it is used."""
    return blocks.select("*", F.explode(F.array(regrown(step))).alias("levels"))


def proven(stored: list[DataFrame], above: DataFrame, step: int) -> DataFrame:
    """Every leaf of the stored trees with its path, continued by the path of its tree in ``above``."""
    width = 1 << step

    def ways(blocks: DataFrame) -> DataFrame:
        """Paths from the nodes at the foot of subtrees, whose tops' paths are at hand."""
        climbed = F.size("levels") - 1

        def sibling(at: Column, k: Column) -> Column:
            place = F.call_function("shiftright", at, k)
            other = F.get(F.get(F.col("levels"), k), place.bitwiseXOR(1))
            return F.struct(other.alias("sibling"), (place.bitwiseAND(1) == 1).alias("left"))

        def way(node: Column, at: Column) -> Column:
            heights = F.slice(F.sequence(F.lit(0), climbed), F.lit(1), climbed)
            own = F.transform(heights, lambda k: sibling(at, k))
            return F.struct(node["pos"].alias("pos"), node["digest"].alias("digest"), node["given"].alias("given"), F.concat(own, F.col("path")).alias("path"))

        return with_levels(blocks, step).select("tree", "subroot", "root", F.inline(F.transform("foot", way)))

    paths = None
    for blocks in reversed(stored):
        known = blocks.where(F.col("n") <= width).join(above, "tree")
        if paths is not None:
            tops = paths.select("tree", F.col("pos").alias("block"), "subroot", "root", "path")
            known = known.unionByName(blocks.where(F.col("n") > width).join(tops, ["tree", "block"]))
        paths = ways(known)
    return paths


def op11_merkle(spark, root: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether it still verifies after tampering with some."""
    raised = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, document_leaf(raised))
    found = merkle_manifest(table(spark, root, "documents"), changed=tampered).proofs
    shown = found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        siblings_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(codes: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a list of byte values."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: i::UBIGINT)), lambda x, i: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda c, b: {byte}), 4294967295::UBIGINT)"


def _leaf_sql(n_chars: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


_DIGITS = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::UBIGINT)"
#: The trees level by level, and each leaf's siblings looked up in them.
OP11_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
  FROM (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("n_chars")} AS leaf,
               CASE WHEN {crc32_sql(_DIGITS)} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS changed FROM documents)
), up AS (
  SELECT tree, 0 AS lvl, idx, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT tree, any_value(lvl) + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 1) // 2)
  FROM up WHERE n > 1 GROUP BY tree, idx // 2
), subroots AS (
  SELECT tree, digest AS subroot, lvl AS height, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1
), crown AS (
  SELECT 0 AS lvl, idx, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT any_value(lvl) + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 1) // 2)
  FROM crown WHERE n > 1 GROUP BY idx // 2
), peak AS (SELECT digest AS root, lvl AS height FROM crown WHERE n = 1),
numbered AS (SELECT l.*, row_number() OVER () AS row, subroot, s.height, s.idx AS place, root, p.height AS crown_height
  FROM leaves l JOIN subroots s USING (tree) CROSS JOIN peak p),
steps AS (
  SELECT row, tree, lvl AS step, lvl, xor(idx >> lvl, 1) AS other, (idx >> lvl) & 1 AS side, TRUE AS low
  FROM (SELECT *, unnest(range(height))::INT AS lvl FROM numbered)
  UNION ALL
  SELECT row, tree, height + lvl, lvl, xor(place >> lvl, 1), (place >> lvl) & 1, FALSE
  FROM (SELECT *, unnest(range(crown_height))::INT AS lvl FROM numbered)
), met AS (
  SELECT row, step, side, coalesce(u.digest, c.digest, '') AS sibling
  FROM steps s LEFT JOIN up u ON s.low AND u.tree = s.tree AND u.lvl = s.lvl AND u.idx = s.other
  LEFT JOIN crown c ON NOT s.low AND c.lvl = s.lvl AND c.idx = s.other
), proofs AS (
  SELECT row, string_agg(sibling, '' ORDER BY step) AS siblings, list(side || sibling ORDER BY step) AS path FROM met GROUP BY row
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256,
       list_reduce(list_prepend(coalesce(changed, leaf), coalesce(path, [])),
                   lambda h, s: sha256(CASE WHEN s[1] = '1' THEN s[2:] || h ELSE h || s[2:] END)) AS folded_root,
       folded_root = root AS verified
FROM numbered LEFT JOIN proofs USING (row)
"""
