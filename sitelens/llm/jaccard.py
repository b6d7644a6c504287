"""Documents linked by the Jaccard similarity of their word shingles, exactly, and the groups that links form.

Token-combination prefixes. Tokens (shingles) are ordered by how many different
sets hold them, rare ones first. Two sets that link miss at most a fifth of
their tokens in each other, so their prefixes of that many tokens and one share
a token. A rare token is indexed by itself. Frequent tokens would give long
lists, so they are dealt into small classes by hash and indexed by pairs of one
class; each class costs the prefix one more token. Sets that share an indexed
token or pair are candidates and are verified on all their tokens.

- Equal sets are one from the start. Tokens go to reducers packed, as arrays by
  hash range and not as rows. Tokens of a single set can be shared with nobody,
  so only the others come back, and most sets are done with.
- Of a list of candidates only links to its plainest member (the one with the
  fewest tokens of its own) are verified; that joins large groups of copies
  without their pairs. Then every set that is still apart from the plainest
  member of a list is held against the other sets with that member, block by
  block, as far as sizes and the triangle inequality of the Jaccard distance
  leave a link possible. No pair that could link two groups is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import plain, table, written
from sitelens.llm.shingles import mixed, shingle_sets

SIZE = 5
#: Sets that hold a rare token, at most; tokens of a frequent class, about; bytes of text to a reducer.
RARE, CLASS, REDUCER = 16, 10, 16 << 20
#: Tokens that a task holds before it packs them.
PACKED = 1_000_000
#: Sets of one list that a task holds against as many others.
BLOCK = 512
#: Numerator and denominator of the least similarity.
LEAST = (4, 5)
MANY = 255

PACK = "bucket int, tokens binary, nodes binary, counts binary, df binary"
ENTRY = 12
NODE = np.dtype([("hash", "<u8"), ("size", "<u4")])


def node_of(tokens: np.ndarray) -> bytes:
    """Name of a set: 64 bits of its tokens' hash, and how many they are."""
    if not len(tokens):
        return b""
    return hashlib.blake2b(tokens.tobytes(), digest_size=8).digest() + len(tokens).to_bytes(4, "little")


def low48(tokens: np.ndarray) -> np.ndarray:
    return tokens >> np.uint64(16)


def packed48(tokens: np.ndarray) -> bytes:
    """Six bytes a token: the upper four of all, then the lower two."""
    return (tokens >> np.uint64(16)).astype("<u4").tobytes() + (tokens & np.uint64(0xFFFF)).astype("<u2").tobytes()


def opened48(data: bytes) -> np.ndarray:
    n = len(data) // 6
    upper = np.frombuffer(data, "<u4", n).astype(np.uint64)
    return (upper << np.uint64(16)) | np.frombuffer(data, "<u2", n, 4 * n)


def sets(documents: DataFrame, size: int = SIZE, key: str | None = None) -> DataFrame:
    """(row, doc_id, node, n_shingles) of every document; node is null for an empty set."""
    if key:
        own = plain(documents, doc_id="long", text="string", **{key: "string"}).withColumnRenamed(key, "row")
    else:
        row = F.monotonically_increasing_id().cast("string")
        own = plain(documents, doc_id="long", text="string").withColumn("row", row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, counts = [], []
            for t in shingle_sets(b.column("text"), size):
                nodes.append(node_of(t) or None)
                counts.append(len(t))
            yield pa.RecordBatch.from_pydict(
                {
                    "row": b.column("row"),
                    "doc_id": b.column("doc_id"),
                    "node": pa.array(nodes, pa.binary()),
                    "n_shingles": pa.array(counts, pa.int64()),
                }
            )

    return own.select("row", "doc_id", "text").mapInArrow(run, "row string, doc_id long, node binary, n_shingles long")


def packs(documents: DataFrame, buckets: int, size: int = SIZE) -> DataFrame:
    """Tokens of all sets by hash range: in each pack the tokens of one batch, set by set."""
    schema = pa.schema(
        [("bucket", pa.int32())] + [(n, pa.binary()) for n in ("tokens", "nodes", "counts", "df")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sitelens.llm.common import arrow_rows

        found: dict[bytes, np.ndarray] = {}  # copies near each other go once
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nodes = np.frombuffer(b"".join(found), f"V{ENTRY}")
            lengths = np.fromiter(map(len, found.values()), np.int64, len(found))
            tokens = np.concatenate(list(found.values()))
            whose = np.repeat(np.arange(len(nodes)), lengths)
            bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16)
            yield from arrow_rows(list(dealt(bucket, low48(tokens), whose, nodes)), schema)

        for b in batches:
            for t in shingle_sets(b.column("text"), size):
                if len(t) > 3:  # smaller sets can link with none but their equals
                    held += len(t)
                    found.setdefault(node_of(t), t)
                if held >= PACKED:
                    yield from flush()
                    found, held = {}, 0
        if found:
            yield from flush()

    return plain(documents, text="string").mapInArrow(run, PACK)


def dealt(bucket, tokens, whose, nodes, df=None):
    """Rows of PACK, one per bucket; ``whose`` ascends."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        own = whose[part]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        yield (
            int(bucket[part[0]]),
            packed48(tokens[part]),
            nodes[own[first]].tobytes(),
            np.diff(np.append(first, len(own))).astype("<u4").tobytes(),
            df[part].tobytes() if df is not None else None,
        )


def gathered(frame: pd.DataFrame):
    """All packs of a bucket: tokens, node, size and count of the entries, df."""
    tokens = np.concatenate([opened48(x) for x in frame["tokens"]])
    nodes = np.concatenate([np.frombuffer(x, f"V{ENTRY}") for x in frame["nodes"]])
    sizes = nodes.view(NODE)["size"].astype(np.int64)
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in frame["counts"]]).astype(np.int64)
    df = None
    if frame["df"].iloc[0] is not None:
        df = np.concatenate([np.frombuffer(x, "u1") for x in frame["df"]])
    return tokens, nodes, sizes, counts, df


def by_node(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings equal nodes together, number of the node of each entry)."""
    parts = nodes.view(NODE)
    a, b = parts["hash"].copy(), parts["size"].copy()
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    number = np.empty(len(nodes), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, number


def repeated(buckets: int):
    """Reducer of one hash range: the tokens that several different sets hold, dealt by set."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tokens, nodes, _, counts, _ = gathered(frame)
        _, number = by_node(nodes)
        _, first = np.unique(number, return_index=True)
        keep = np.zeros(len(nodes), bool)
        keep[first] = True  # copies from other batches
        entry = np.repeat(np.arange(len(nodes)), counts)
        mine = keep[entry]
        tokens, entry = tokens[mine], entry[mine]
        order = np.argsort(tokens, kind="stable")
        ends = np.flatnonzero(np.concatenate([tokens[order][1:] != tokens[order][:-1], [True]])) + 1
        df = np.empty(len(tokens), np.int64)
        df[order] = np.repeat(np.diff(np.concatenate([[0], ends])), np.diff(np.concatenate([[0], ends])))
        many = df > 1
        tokens, entry, df = tokens[many], entry[many], np.minimum(df[many], MANY).astype("u1")
        if not len(tokens):
            return pd.DataFrame(columns=PACK_NAMES)
        # Sets are spread by their name; entries of one set stay together.
        to = (nodes.view(NODE)["hash"] % np.uint64(buckets)).astype(np.uint16)
        return pd.DataFrame(list(dealt(to[entry], tokens, entry, nodes, df)), columns=PACK_NAMES)

    return run


PACK_NAMES = ("bucket", "tokens", "nodes", "counts", "df")


def signatures(tokens: np.ndarray, df: np.ndarray, size: int) -> np.ndarray:
    """What a set is indexed under, from its shared tokens and their frequencies; empty if it can link with none.

    ``size`` counts all its tokens; those not given are in no other set.
    """
    missing = size - -(-LEAST[0] * size // LEAST[1])  # tokens that a partner may lack
    alone = size - len(tokens)
    if alone > missing or size < 4:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    rare = int(np.searchsorted(df, RARE, "right"))
    single = tokens[: min(rare, missing + 1 - alone)]
    found = [mixed(single + np.uint64(1))]
    need = missing + 1 - alone - rare  # still to come from frequent tokens
    if need > 0:
        frequent = tokens[rare:]
        spread = mixed(frequent + np.uint64(7))
        step = size_class(size)
        for c in (step, step + 1):  # sets that link are of one class or of neighbours, and so share one
            classes = max(2, int(1.25**c) // CLASS)
            of = (spread % np.uint64(classes)).astype(np.int64)
            # A class of k tokens stands for k - 1: every token after the first of its class counts.
            later = np.ones(len(of), bool)
            later[np.unique(of, return_index=True)[1]] = False
            end = int(np.searchsorted(np.cumsum(later), need)) + 1
            by = np.argsort(of[:end], kind="stable")
            t, g = frequent[:end][by], of[:end][by]
            for gap in range(1, int(np.bincount(g).max(initial=0))):
                pair = g[gap:] == g[:-gap]
                a, b = t[:-gap][pair], t[gap:][pair]
                found.append(mixed(mixed(a) + b * np.uint64(3) + np.uint64(c)))
    return np.concatenate(found)


def size_class(size: int) -> int:
    c = int(np.log(size) / np.log(1.25))
    while 1.25 ** (c + 1) <= size:
        c += 1
    while 1.25**c > size:
        c -= 1
    return c


INDEXED = "node binary, size int, alone int, tokens binary, signs array<long>"


def indexed(frame: pd.DataFrame) -> pd.DataFrame:
    """Sets that may link, with their shared tokens in ascending order and their signatures."""
    tokens, nodes, sizes, counts, df = gathered(frame)
    _, number = by_node(nodes)
    of = np.repeat(number, counts)
    order = np.lexsort((tokens, of))
    tokens, df, of = tokens[order], df[order], of[order]
    _, entry = np.unique(number, return_index=True)
    ends = np.cumsum(np.bincount(of))
    rows = []
    with np.errstate(over="ignore"):
        for i, (lo, hi) in enumerate(zip((ends - np.bincount(of)).tolist(), ends.tolist())):
            size = int(sizes[entry[i]])
            if size - (hi - lo) > size - -(-LEAST[0] * size // LEAST[1]):
                continue
            signs = signatures(tokens[lo:hi], df[lo:hi], size)
            if len(signs):
                rows.append((nodes[entry[i]].tobytes(), size, size - (hi - lo), packed48(tokens[lo:hi]), signs.view(np.int64)))
    return pd.DataFrame(rows, columns=["node", "size", "alone", "tokens", "signs"])


def may_link(size_a, alone_a, size_b, alone_b):
    """Whether the sizes and the tokens that each has to itself leave the least similarity possible."""
    size_a, alone_a, size_b, alone_b = map(F.col, (size_a, alone_a, size_b, alone_b))
    same = F.least(size_a - alone_a, size_b - alone_b)  # at most
    return LEAST[1] * same >= LEAST[0] * (size_a + size_b - same)


def verified(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """(a, b, same, every): tokens in both and in either, for pairs of nodes (a, b)."""
    one = kept.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("tokens").alias("tokens_a"))
    two = kept.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("tokens").alias("tokens_b"))
    both = pairs.join(one, "a").join(two, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [
                len(np.intersect1d(opened48(x.as_py()), opened48(y.as_py()), assume_unique=True))
                for x, y in zip(b.column("tokens_a"), b.column("tokens_b"))
            ]
            sizes = b.column("size_a").to_numpy() + b.column("size_b").to_numpy()
            yield pa.RecordBatch.from_pydict(
                {
                    "a": b.column("a"),
                    "b": b.column("b"),
                    "same": pa.array(same, pa.int32()),
                    "every": pa.array(sizes - np.array(same, np.int64), pa.int32()),
                }
            )

    wanted = both.select("a", "b", "size_a", "size_b", "tokens_a", "tokens_b")
    return wanted.mapInArrow(run, "a binary, b binary, same int, every int")


def linked(found: DataFrame) -> DataFrame:
    return found.where(LEAST[1] * F.col("same") >= LEAST[0] * F.col("every")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of a link reaches.

    Every node takes the smallest root among its neighbours, then the root of
    that root, until nothing changes; rounds grow with the logarithm of the
    longest chain.
    """
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        of = roots.select(F.col("node").alias("b"), F.col("root").alias("other"))
        least = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("near"))
        nearer = roots.join(least, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = roots.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = written(
            nearer.join(jump, "next").select("node", F.least("next", "far").alias("root"), (F.col("next") != F.col("root")).alias("new"), (F.col("far") < F.col("next")).alias("jumped"))
        )
        roots = moved.select("node", "root")
        if moved.where("new or jumped").isEmpty():
            return roots


def links(documents: DataFrame, size: int = SIZE, reducer: int = REDUCER) -> DataFrame:
    """(a, b): links between different sets, enough of them to join every group that links join."""
    weight = plain(documents, text="string").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(60_000, max(12, -(-weight // reducer))))
    shared = packs(documents, buckets, size).groupBy("bucket").applyInPandas(repeated(buckets), PACK)
    kept = written(shared.groupBy("bucket").applyInPandas(indexed, INDEXED))
    signs = kept.select(F.explode("signs").alias("sign"), "node", "size", "alone")
    plainest = F.min(F.struct("alone", "node", "size"))
    lists = (
        signs.groupBy("sign")
        .agg(plainest.alias("p"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sign", *(F.col(f"p.{c}").alias(r) for c, r in (("node", "rep"), ("size", "rep_size"), ("alone", "rep_alone"))))
    )
    members = signs.join(lists, "sign")
    pairs = members.where((F.col("node") != F.col("rep")) & may_link("size", "alone", "rep_size", "rep_alone"))
    first = written(verified(pairs.select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct(), kept))
    found = linked(first)
    roots = components(found)

    # What the plainest members did not join: each such set against the sets that share its plainest member.
    of = roots.select("node", "root")
    rep_of = roots.select(F.col("node").alias("rep"), F.col("root").alias("rep_root"))
    far = first.select(F.col("a").alias("node"), F.col("b").alias("rep"), (1 - F.col("same") / F.col("every")).alias("far"))
    placed = written(
        members.select("node", "rep", "size", "alone")
        .distinct()
        .join(of, "node", "left")
        .join(rep_of, "rep", "left")
        .join(far, ["node", "rep"], "left")
        .select(
            "node",
            "rep",
            F.coalesce("root", "node").alias("root"),
            "size",
            "alone",
            F.when(F.col("node") == F.col("rep"), 0.0).otherwise(F.col("far")).alias("far"),
            (F.coalesce("root", "node") != F.coalesce("rep_root", "rep")).alias("apart"),
        )
    )
    blocks = (
        placed.groupBy("rep")
        .agg(F.count("*").alias("n"), F.count_if("apart").alias("m"))
        .where("m > 0 AND n > 2")
        .select("rep", *(F.ceil(F.col(c) / BLOCK).alias(c) for c in ("n", "m")))
    )
    if blocks.isEmpty():
        return found
    own = placed.join(blocks, "rep").join(kept.select("node", "tokens"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("n")).alias("n_block"), F.pmod(F.xxhash64("node"), F.col("m")).alias("m_block")
    every = [F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias(f"{c}_block") for c in ("n", "m")]
    data = ["rep", "node", "root", "size", "alone", "far", "tokens"]
    keys = ["rep", "n_block", "m_block"]
    one = own.where("apart").select(*data, block[1], every[0])
    two = own.select(*data, block[0], every[1])
    two = two.toDF(*two.columns)
    more = one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInPandas(block_links, "a binary, b binary")
    return found.unionByName(written(more.distinct()))


def block_links(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
    """Links between sets of two blocks that share a plainest member and no group yet."""
    rows = []
    if len(one) and len(two):
        held = [opened48(t) for t in two["tokens"]]
        whose = np.repeat(np.arange(len(held)), [len(t) for t in held])
        tokens = np.concatenate(held)
        order = np.argsort(tokens, kind="stable")
        tokens, whose = tokens[order], whose[order]
        size, alone = two["size"].to_numpy(np.int64), two["alone"].to_numpy(np.int64)
        far, root = two["far"].to_numpy(float), two["root"].to_numpy(object)
        reach = 1 - LEAST[0] / LEAST[1] + 1e-9
        for x in one.itertuples():
            most = np.minimum(size - alone, x.size - x.alone)
            may = LEAST[1] * most >= LEAST[0] * (size + x.size - most)
            may &= ~(np.abs(far - x.far) > reach) & (root != x.root)  # an unknown distance rules nothing out
            if not may.any():
                continue
            own = opened48(x.tokens)
            lo, hi = np.searchsorted(tokens, own), np.searchsorted(tokens, own, "right")
            length = hi - lo
            at = np.arange(length.sum()) + np.repeat(lo - (np.cumsum(length) - length), length)
            same = np.bincount(whose[at], minlength=len(held))
            good = may & (LEAST[1] * same >= LEAST[0] * (size + x.size - same))
            rows += [(x.node, n) for n in two["node"].to_numpy(object)[good]]
    return pd.DataFrame(rows, columns=["a", "b"])


def near_duplicates(documents: DataFrame, size: int = SIZE, key: str | None = None) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, first): every row of ``documents`` with its group.

    ``row`` is the column ``key``, which must tell the rows apart, or else a number.
    ``component_id`` is the smallest doc_id in the group, null if it has none;
    ``first`` marks one row per group, that of the smallest doc_id (of equal
    ones that of the smallest row). Null, empty and blank texts have no shingles and are
    groups of their own; repeated rows have equal sets and share a group.
    """
    rows = written(sets(documents, size, key))
    roots = components(links(documents, size))
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(smallest.alias("least"))
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    groups = named.groupBy("root").agg(F.min("least").alias("least"))
    named = named.select("node", "root").join(groups, "root").select("node", "least")
    return rows.join(named, "node", "left").select(
        "row",
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        (F.col("node").isNull() | (F.col("row") == F.col("least.row"))).alias("first"),
    )


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(documents).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT d.doc_id, cast(coalesce(any_value(z.n), 0) AS bigint) AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN reach r USING (doc_id) GROUP BY 1
"""
