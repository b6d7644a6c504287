"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items and documents are normalised alike (A-Z in lower case, every
run of other ASCII signs one space), so a window of an item is a plain string
between two spaces. The automaton holds every window once; a document is
scanned once, whatever the number of windows. Matches are positions in the
normalised text, mapped to word numbers and, for the spans, to code points of
the original.

The automaton is sent to every task, so its size is checked: items are dealt
into groups of at most ``group_chars`` normalised characters (a longer item is
dealt by its windows), one automaton and one scan per group. A benchmark of
ordinary size is one group. Only the results of several groups meet in a
shuffle, by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitelens.llm.common import lower_ascii, plain, spare

WINDOW = 10
GROUP_CHARS = 4_000_000
#: A word before its letters are lowered.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: Bytes of UTF-8: letters to lower case, separators to a space, the rest as it is.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)
SCHEMA = "doc_row long, n_words long, hit_from array<int>, hit_to array<int>, item_ids array<string>, spans array<struct<start:int,end:int>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split()


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, item_ids): each distinct window of the items, and the sorted ids of its items."""
    items = plain(benchmark, item_id="string", text="string")
    tokens = F.filter(
        F.split(F.translate(lower_ascii("text"), SEPARATORS, " " * len(SEPARATORS)), " "), lambda w: w != ""
    )
    held = items.select("item_id", tokens.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    parts = held.select(
        "item_id",
        F.explode(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("w", i + 1, F.lit(size)), " "))
        ).alias("window"),
    )
    return parts.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def automaton(patterns: list[tuple[str, list[str]]]):
    found = ahocorasick.Automaton()
    for window, items in patterns:
        found.add_word(" " + window.encode().decode("latin-1") + " ", (window.count(" ") + 1, tuple(items)))
    found.make_automaton()
    return found


def scan(text: str | None, finder) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, merged word ranges [from, to) that are hit, ids of the items found."""
    own = words(text)
    if not own:
        return 0, [], []
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    starts = None
    for end, (size, ids) in finder.iter((b" " + b" ".join(own) + b" ").decode("latin-1")):
        if starts is None:  # where each word ends in the normalised text
            starts = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        last = int(np.searchsorted(starts, end)) + 1
        ranges.append((last - size, last))
        items.update(ids)
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return len(own), merged, sorted(items)


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code points of the text, end exclusive."""
    if not ranges:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[lo][0], places[hi - 1][1]) for lo, hi in ranges]


def _scanner(shared):
    from sitelens.llm.common import batch

    schema = pa.schema(
        [
            ("doc_row", pa.int64()),
            ("n_words", pa.int64()),
            ("hit_from", pa.list_(pa.int32())),
            ("hit_to", pa.list_(pa.int32())),
            ("item_ids", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton(shared.value)
        for b in batches:
            rows = []
            for row, text in zip(b.column("doc_row").to_pylist(), b.column("text")):
                text = text.as_py()
                n, ranges, items = scan(text, finder) if len(finder) else (len(words(text)), [], [])
                spans = [{"start": s, "end": e} for s, e in original_spans(text or "", ranges)]
                rows.append((row, n, [r[0] for r in ranges], [r[1] for r in ranges], items, spans))
            yield batch(rows, schema)

    return run


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, group_chars: int = GROUP_CHARS
) -> DataFrame:
    """Rows of ``documents`` (all their columns) with n_words, n_hit, item_ids, hits and contaminated.

    ``hits`` holds the found passages as spans of the original text, code
    points, end exclusive. Null and empty texts have no words and no hits; an
    empty benchmark finds nothing; an empty table gives no rows; items with a null id mark words but add no
    id; repeated documents are judged each by itself, repeated items count once
    per id. Columns of ``documents`` named like a result are replaced by it.
    """
    spark = documents.sparkSession
    parts = windows(benchmark, size)
    # The size is known before anything is sent: the driver fetches one bounded group at a time.
    chars = parts.agg(F.sum(F.length("window") + 2)).first()[0] or 0
    groups = max(1, -(-chars // group_chars))
    results = ("n_words", "n_hit", "item_ids", "hits", "contaminated")
    kept = [c for c in documents.columns if c not in results]
    row = spare("doc_row", kept)
    text = F.col("`text`").cast("string") if "text" in documents.columns else F.lit(None).cast("string")
    if groups == 1:
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in parts.collect()])
        return _one_scan(documents, kept, text, shared)
    parts = parts.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(groups)))
    rows = documents.select(*(f"`{c}`" for c in kept)).withColumn(row, F.monotonically_increasing_id())
    found = None
    for g in range(groups):
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in parts.where(F.col("part") == g).collect()])
        own = rows.select(F.col(row).alias("doc_row"), text.alias("text")).mapInArrow(_scanner(shared), SCHEMA)
        found = own if found is None else found.unionByName(own)
    met = found.groupBy("doc_row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_from", "hit_to", "spans")))).alias("ranges"),
    )
    met = met.withColumn("ranges", merged("ranges")).select(
        F.col("doc_row").alias(row),
        "n_words",
        "item_ids",
        F.aggregate("ranges", F.lit(0), lambda n, r: n + r["hit_to"] - r["hit_from"]).cast("long").alias("n_hit"),
        F.transform("ranges", lambda r: r["spans"]).alias("hits"),
    )
    return rows.join(met, row).select(
        *(f"`{c}`" for c in kept),
        "n_words",
        "n_hit",
        "item_ids",
        "hits",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def merged(ranges):
    """Sorted (hit_from, hit_to, spans) with those joined that touch or overlap."""

    def join(done, r):
        last = F.try_element_at(done, F.lit(-1))
        span = F.struct(
            last["spans"]["start"].alias("start"), F.greatest(last["spans"]["end"], r["spans"]["end"]).alias("end")
        )
        wider = F.struct(
            last["hit_from"].alias("hit_from"), F.greatest(last["hit_to"], r["hit_to"]).alias("hit_to"), span.alias("spans")
        )
        rest = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(r["hit_from"] <= last["hit_to"], F.concat(rest, F.array(wider))).otherwise(
            F.concat(done, F.array(r))
        )

    return F.aggregate(ranges, F.slice(ranges, 1, 0), join)


def _one_scan(documents: DataFrame, kept: list[str], text, shared) -> DataFrame:
    """All in one pass over the rows, no shuffle: the columns travel with the text."""
    working = spare("_text", kept)
    own = documents.select(*(f"`{c}`" for c in kept), text.alias(working))
    added = StructType.fromDDL(
        "n_words long, n_hit long, item_ids array<string>, hits array<struct<start:int,end:int>>, contaminated boolean"
    )
    out = StructType(own.drop(working).schema.fields + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton(shared.value)
        for b in batches:
            n_words, n_hit, items, hits = [], [], [], []
            for value in b.column(b.num_columns - 1):
                t = value.as_py()
                n, ranges, ids = scan(t, finder) if len(finder) else (len(words(t)), [], [])
                n_words.append(n)
                n_hit.append(sum(hi - lo for lo, hi in ranges))
                items.append(ids)
                hits.append([{"start": s, "end": e} for s, e in original_spans(t or "", ranges)])
            added = [
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([n > 0 for n in n_hit], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns - 1)] + added,
                names=[b.schema.field(i).name for i in range(b.num_columns - 1)]
                + ["n_words", "n_hit", "item_ids", "hits", "contaminated"],
            )

    return own.mapInArrow(run, out)


def digest(found: DataFrame) -> DataFrame:
    ids = F.array_sort("item_ids")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    from sitelens.llm.common import table

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(find_contamination(documents, table(spark, sf_dir, "benchmark"))).drop("hits")


OP2_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM doc_words, sizes WHERE len(w) >= n)),
found AS (SELECT DISTINCT d.doc_id, d.i, d.n, v.item_id FROM doc_windows d JOIN item_windows v ON d.n = v.n AND d.win = v.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, cast(coalesce(h.n_hit, 0) AS bigint) AS n_hit,
       cast(coalesce(t.n_items, 0) AS bigint) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""
