"""The Merkle manifest against a plain tree in Python."""

import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from sitelens.llm.merkle import document_leaf, folded, merkle_manifest, siblings_digest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    fields = (None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text))
    return h(*("-" if f is None else f"{len(f.encode())}:{f}" for f in fields))


def tree(leaves):
    """The top, and for every leaf its path of (sibling or None, left)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for path, i in zip(paths, at):
            path.append((level[i ^ 1] if i ^ 1 < len(level) else None, i % 2 == 1))
        level, at = [h(*level[i : i + 2]) for i in range(0, len(level), 2)], [i // 2 for i in at]
    return level[0], paths


def manifest(rows):
    """(lang, doc_id, leaf, subroot, root, path) of every row."""
    key = lambda r: (r[2] is not None, (r[2] or "").encode())
    langs = [list(g) for _, g in groupby(sorted(rows, key=key), key)]
    found = []
    for own in langs:
        leaves = sorted(((r[0] is not None, r[0] or 0, plain_leaf(*r)), r) for r in own)
        top, paths = tree([k[2] for k, _ in leaves])
        found.append((top, [(r[2], r[0], k[2], p) for (k, r), p in zip(leaves, paths)]))
    root, crown = tree([top for top, _ in found])
    return [
        (lang, doc_id, leaf, top, root, path + way)
        for (top, own), way in zip(found, crown)
        for lang, doc_id, leaf, path in own
    ]


def collected(df):
    found = df.select("lang", "doc_id", "leaf", "subroot", "root", "path").collect()
    return sorted((*r[:5], [(s["sibling"], s["left"]) for s in r[5]]) for r in found)


def rows_of(n):
    langs = ["en"] * 6 + ["de", "é", "z", "Z"]
    return [(i * 7 % n, f"text {i} é" * (i % 4), langs[i % 10], f"s{i % 3}", i % 50) for i in range(n)]


@pytest.mark.parametrize("n, step", [(1, 8), (2, 1), (3, 8), (10, 2), (97, 3), (300, 1), (700, 8)])
def test_equals_plain_tree(spark, n, step):
    rows = rows_of(n)
    found = merkle_manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), step)
    assert collected(found.proofs) == sorted(manifest(rows))
    assert found.root() == manifest(rows)[0][4]
    sizes = {r["lang"]: (r["subroot"], r["n"]) for r in found.subroots.collect()}
    assert sizes == {m[0]: (m[3], sum(r[2] == m[0] for r in rows)) for m in manifest(rows)}


def test_one_language_holds_all(spark):
    rows = [(i, "same", "en", "s", 4) for i in range(530)]
    got = collected(merkle_manifest(spark.createDataFrame(rows, SCHEMA), 4).proofs)
    assert got == sorted(manifest(rows))


def test_nulls_repeats_and_ties(spark):
    odd = [
        (None, None, None, None, None),
        (None, "", "", "", 0),
        (5, None, "en", None, 3),
        (5, "other", "en", "a", 3),
        (5, "other", "en", "a", 3),
        (5, "other", "en", "a", None),
        (6, "x" * 300_000, None, "b", 9223372036854775807),
    ]
    rows = odd + [(7, "copy", "en", "s", 4)] * 40
    found = merkle_manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), 2).proofs
    key = lambda m: tuple(map(str, m))
    assert sorted(collected_any(found), key=key) == sorted(manifest(rows), key=key)


def collected_any(df):
    found = df.select("lang", "doc_id", "leaf", "subroot", "root", "path").collect()
    return [(*r[:5], [(s["sibling"], s["left"]) for s in r[5]]) for r in found]


def test_proofs_verify_and_tampering_shows(spark):
    rows = rows_of(60)
    raised = F.when(F.col("doc_id") % 7 == 0, document_leaf(F.col("n_chars") + 1))
    proofs = merkle_manifest(spark.createDataFrame(rows, SCHEMA), 3, changed=raised).proofs
    checked = proofs.select(
        "doc_id",
        (folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("own"),
        (folded(F.coalesce("changed", "leaf"), F.col("path")) == F.col("root")).alias("other"),
        siblings_digest(F.col("path")).alias("digest"),
    ).collect()
    assert all(r["own"] for r in checked)
    assert all(r["other"] == (r["doc_id"] % 7 != 0) for r in checked)
    expected = {m[1]: h(*(s for s, _ in m[5] if s)) for m in manifest(rows)}
    assert {r["doc_id"]: r["digest"] for r in checked} == expected


def test_empty_table_and_other_columns(spark):
    empty = merkle_manifest(spark.createDataFrame([], SCHEMA))
    assert empty.root() is None and empty.proofs.isEmpty() and empty.subroots.isEmpty()
    rows = rows_of(20)
    extra = [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "tree", "leaf", "_key", "path", "given", "pos", "a.b"]
    df = spark.createDataFrame([(*r, *"1234567") for r in rows], extra)
    assert collected(merkle_manifest(df).proofs) == sorted(manifest(rows))
    fewer = spark.createDataFrame([(1, "t")], "doc_id long, text string")
    assert collected_any(merkle_manifest(fewer).proofs)[0][2] == plain_leaf(1, "t", None, None, None)
    with pytest.raises(ValueError):
        merkle_manifest(df, 0)
