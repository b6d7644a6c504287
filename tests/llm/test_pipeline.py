"""The pipeline's stages against brute force, each on what its predecessor kept."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitelens.llm import toxicity
from sitelens.llm.common import written
from tests.llm.test_corpus_operators import groups
from tests.llm.test_text_operators import contamination

CLEAN = ["table", "green", "walk", "paper", "river", "house", "quiet", "stone", "light", "music", "cloud", "seven"]
ITEM = "which of these twelve rivers flows north past the old stone mill today"


def corpus():
    draw = random.Random(11)
    texts = {}
    for i in range(600):
        parts = [" ".join(draw.choices(CLEAN, k=12)) + f" n{i} m{i}" for _ in range(draw.randint(2, 5))]
        if i % 5 == 0:
            parts[0] += draw.choice([" grumwort", " snarlish"])
        texts[i] = ". ".join(parts)
    for i in range(600, 640):  # near copies of clean documents
        texts[i] = texts[draw.choice([1, 2, 3])] + " again"
    for i in range(640, 650):
        texts[i] = f"k{i} " + texts[i - 39].replace("grumwort", "") + " " + ITEM.upper()
    for i in range(650, 660):
        texts[i] = f"r{i} q{i} password = hunter{i}22 and AKIAABCDEFGHIJKLM{i} " + " ".join(draw.choices(CLEAN, k=30))
    return [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(700, None, None, None, None), (701, "", "en", "s", 0)]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The documents before and after each stage."""
    root = str(tmp_path_factory.mktemp("corpus"))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(corpus(), columns).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    marks = [(i, 1, int(i % 5 == 0)) for i in range(600)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    docs, found = spark.read.parquet(f"{root}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, root).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        found.append(docs)
    return root, [spark.read.parquet(f"{root}/documents.parquet"), *found]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(kept):
    before, *stages = kept[1]
    for docs in stages[:-1]:
        assert docs.dtypes == before.dtypes


def test_toxic_documents_go(spark, kept):
    before, after = texts(kept[1][0]), texts(kept[1][1])
    labels = spark.read.parquet(f"{kept[0]}/labels.parquet")
    rows = toxicity.training_rows(kept[1][0], labels, toxicity.SAMPLE, toxicity.SAMPLE_CHARS)
    scorer = toxicity.Scorer(*toxicity.fit([r[0] for r in rows], [r[1] for r in rows]))
    assert after == {i: t for i, t in before.items() if scorer.document(t)[0] < toxicity.THRESHOLD}
    bad = {i for i, t in before.items() if re.search("grumwort|snarlish", t or "")}
    assert len(bad & set(after)) <= 0.02 * len(bad) and len(set(before) - bad - set(after)) == 0


def test_one_of_each_group_stays(kept):
    before, after = texts(kept[1][1]), texts(kept[1][2])
    first = {root for _, root in groups(before.items()).values()}
    assert after == {i: before[i] for i in first}


def test_contaminated_documents_go(kept):
    before, after = texts(kept[1][2]), texts(kept[1][3])
    hit = {d for d, _, n, _ in contamination(before.items(), [(1, ITEM)]) if n}
    assert hit and after == {i: t for i, t in before.items() if i not in hit}


def test_secrets_are_masked(kept):
    before, after = texts(kept[1][3]), texts(kept[1][4])
    assert before.keys() == after.keys()
    for i, t in before.items():
        masked = re.sub(r"password = hunter[0-9]+|AKIA[A-Z0-9]{16,}", "[secret]", t or "") if t else t
        assert after[i] == masked
    assert sum("[secret]" in (t or "") for t in after.values()) == 10
    assert all(r.n_chars == len(r.text) for r in kept[1][4].collect() if r.text is not None)


def test_pieces_are_packed(spark, kept):
    docs, pieces = texts(kept[1][4]), kept[1][5].collect()
    assert {r.doc_id for r in pieces} == set(docs)
    filled = defaultdict(int)
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) == -(-sum(filled.values()) // 2048)
    whole = corpus_pipeline.run(spark, kept[0])
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in pieces)


@pytest.mark.parametrize("rows", [[], [(1, None, "t", "k"), (1, None, "t", "k"), (None, "", None, None), (2, "one two", "t", "k")]])
def test_stages_of_few_rows_and_clashing_columns(spark, kept, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _key string")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    given = sorted(map(repr, map(tuple, docs.collect())))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, kept[0]))
        assert sorted(map(repr, map(tuple, docs.collect()))) == given, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, kept[0])
    assert pieces.count() == len(rows)
