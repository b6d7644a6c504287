"""Nearest neighbours against brute force; pair splitting; table matching."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens import catalog
from sitelens.operators import retrieval
from tests.conftest import rows

VECTORS = "vec_id long, embedding array<float>"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], VECTORS)


def brute(queries, corpus, k, first_query=0):
    expected = []
    for i, q in enumerate(queries):
        d = ((corpus.astype("float64") - q.astype("float64")) ** 2).sum(axis=1)
        for rank, j in enumerate(np.lexsort((np.arange(len(d)), d))[:k], 1):
            expected.append((first_query + i, int(j), rank))
    return sorted(expected)


@pytest.mark.parametrize("block_rows", [7, 64, 8192])
def test_knn_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(150, 6)).astype("float32")
    corpus[50:100] = corpus[0]  # a third of the corpus are copies of one vector
    queries = np.vstack([corpus[:20], rng.normal(size=(15, 6)).astype("float32")])
    got = retrieval.knn_l2(frame(spark, queries, 1000), frame(spark, corpus), 4, block_rows)
    found = sorted((r.query_id, r.vec_id, r.rank) for r in got.collect())
    assert found == brute(queries, corpus, 4, 1000)
    nearest = {(r.query_id, r.rank): r.distance for r in got.collect()}
    assert nearest[(1000, 1)] == 0.0


def test_knn_with_small_or_empty_corpus(spark):
    queries = frame(spark, [[0.0, 0.0]])
    assert rows(retrieval.knn_l2(queries, frame(spark, [[1.0, 0.0], [0.0, 2.0]]), 3)) == [(0, 0, 1.0, 1), (0, 1, 4.0, 2)]
    assert retrieval.knn_l2(queries, spark.createDataFrame([], VECTORS), 3).count() == 0


def test_knn_visits_few_cells_of_clustered_data(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 6)) * 100
    corpus = np.vstack([c + rng.normal(size=(50, 6)) for c in centres]).astype("float32")
    df = frame(spark, corpus)
    stored = retrieval._usable(df)
    _, homes, sizes, route = retrieval._routed(stored, stored, 100, 4)
    assert homes.count() == len(corpus)
    blind = route(homes.withColumn("reach", F.lit(None).cast("double"))).count()
    assert homes.count() + blind < len(corpus) * sizes(homes).count() / 8
    assert route(homes.withColumn("reach", F.lit(0.0))).count() < blind  # what is known of the k-th distance sends it to fewer
    got = retrieval.knn_l2(df, df, 4, 20)
    assert sorted((r.query_id, r.vec_id, r.rank) for r in got.collect()) == brute(corpus, corpus, 4)


@pytest.mark.parametrize("block_rows", [1, 8192])
def test_knn_leaves_unusable_vectors_out(spark, block_rows):
    nan = float("nan")
    given = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [nan, 0.0]), (4, None), (5, [None, 1.0]), (6, [1.0]), (7, [1.0, 1.0, 1.0]), (None, [0.0, 0.0])]
    df = spark.createDataFrame(given, VECTORS)
    expected = [(1, 1, 0.0, 1), (1, 2, 25.0, 2), (2, 1, 25.0, 2), (2, 2, 0.0, 1), (6, 6, 0.0, 1), (7, 7, 0.0, 1)]
    assert sorted(tuple(r) for r in retrieval.knn_l2(df, df, 3, block_rows).collect()) == sorted(expected)


def test_split_pairs(spark):
    docs = spark.createDataFrame(
        [(1, " how many? => SELECT 1 "), (2, "no arrow"), (3, "a=>b=>c"), (4, "\t x\n=>\ny "), (5, "=>")],
        "id int, content string",
    )
    assert rows(retrieval.split_pairs(docs)) == [
        (1, "how many?", "SELECT 1"), (3, "a", "b=>c"), (4, "x", "y"), (5, "", ""),
    ]


CATALOG = {
    "visits": {"description": "One visit", "columns": {"visit_id": {}, "Device": {}}},
    "users": {"columns": {"id_number": {}, "name": {}}},
}


@pytest.mark.parametrize(
    "question, tables",
    [
        ("Show VISITS by day", ["visits"]),
        ("by DEVICE and NAME", ["users", "visits"]),
        ("is one visit enough", ["visits"]),
        ("unrelated", ["users", "visits"]),
        ("", ["users", "visits"]),
        (None, ["users", "visits"]),
    ],
)
def test_match_tables(spark, question, tables):
    asked = spark.createDataFrame([(1, question)], "question_id int, question string")
    matched = retrieval.match_tables(asked, CATALOG)
    assert sorted(r.table_name for r in matched.collect()) == tables


def test_select_catalog_keeps_metrics_and_relationships(spark):
    schema = {"tables": CATALOG, "metrics": {"m": {"d": 1}}, "relationships": [{"from": "visits", "to": "users"}]}
    asked = spark.createDataFrame([(1, "device")], "question_id int, question string")
    got = retrieval.select_catalog(asked, schema).collect()
    assert [(r.question_id, r.kind, r.name) for r in got] == [
        (1, "table", "visits"), (1, "metric", "m"), (1, "relationship", "visits -> users"),
    ]
    assert json.loads(got[0].definition)["description"] == "One visit"
    bare = retrieval.select_catalog(asked, {"tables": CATALOG})
    assert [r.name for r in bare.collect()] == ["visits"]


def test_load_schema():
    assert catalog.load_schema('{"users": {"columns": {}}}') == {"tables": {"users": {"columns": {}}}}
    assert catalog.load_schema("{broken")["metrics"] == catalog.METRICS
    assert set(catalog.load_schema()["tables"]) == set(catalog.CONTRACTS)


@pytest.mark.parametrize("table, columns", [("session", 30), ("hit", 44), ("visitor_day", 14), ("hit_interaction_nameplate", 13)])
def test_contract_sizes(table, columns):
    assert len(catalog.contract(table).fields) == columns


def term_rows(catalog_):
    for name, info in catalog_.items():
        for term in [name, *([info["description"]] if "description" in info else []), *info.get("columns", {})]:
            yield name, term


def test_term_table_agrees_with_dictionary(spark):
    given = ["Show VISITS by day", "by DEVICE and NAME", "is one visit enough", "unrelated", "", None, "\U0001f600 id_number\n", "Show VISITS by day"]
    asked = spark.createDataFrame(list(enumerate(given)), "question_id int, question string")
    terms = spark.createDataFrame([*term_rows(CATALOG), ("visits", None), (None, "enough")], "table_name string, term string")
    assert rows(retrieval.match_term_table(asked, terms)) == rows(retrieval.match_tables(asked, CATALOG))


def test_term_table_with_short_empty_and_no_terms(spark):
    asked = spark.createDataFrame([(1, "ab"), (2, "a\U0001f600b"), (3, ""), (4, "xyz"), (4, "xyz")], "id int, question string")
    terms = [("one", "A"), ("two", "a\U0001f600"), ("three", "xYZ"), ("four", "\U0001f600b")]
    found = retrieval.match_term_table(asked, spark.createDataFrame(terms, "table_name string, term string"))
    expected = {(1, "ab", "one")} | {(2, "a\U0001f600b", t) for t in ("one", "two", "four")} | {(3, "", t) for t, _ in terms}
    assert rows(found) == sorted([*expected, (4, "xyz", "three"), (4, "xyz", "three")], key=lambda r: tuple((False, str(x)) for x in r))
    empty = spark.createDataFrame([("all", "")], "table_name string, term string")
    assert {(r.id, r.table_name) for r in retrieval.match_term_table(asked, empty).collect()} == {(i, "all") for i in range(1, 5)}
    assert retrieval.match_term_table(asked, empty.limit(0)).count() == 0
    assert retrieval.match_term_table(asked.limit(0), empty).count() == 0


def test_fifty_thousand_terms_and_a_hot_question(spark):
    terms = [(f"t{i % 500}", f"Col_{i:x}_{i * 7919 % 50000}") for i in range(50_000)]
    asked = [f"total of {terms[i * 997][1]} by {terms[i * 613 + 5][1].upper()} please" for i in range(40)]
    asked += [asked[0]] * 200 + ["word " * 20_000 + terms[77][1]]
    of = {}
    for name, term in terms:
        of.setdefault(term.lower(), set()).add(name)
    numbered_ = list(enumerate(asked))
    expected = {(i, t) for i, q in numbered_ for term, names in of.items() if term in q.lower() for t in names}
    questions = spark.createDataFrame(numbered_, "id int, question string")
    catalog_ = spark.createDataFrame(terms, "table_name string, term string")
    got = [(r.id, r.table_name) for r in retrieval.match_term_table(questions, catalog_).select("id", "table_name").collect()]
    assert len(got) == len(set(got)) and set(got) == expected

    def size(df):
        return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())

    few = spark.createDataFrame(terms[:10], "table_name string, term string")
    assert size(retrieval.match_term_table(questions, few)) == size(retrieval.match_term_table(questions, catalog_))
