"""Spelling groups against brute force over deletions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sitelens.llm import spelling
from sitelens.llm.spelling import Acceptor, near_words, observed, roots, spelling_groups

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(documents, odd):
    found = Counter()
    for doc_id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if odd and doc_id is not None and h % odd == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: c for w, c in found.items() if len(w) >= 5 and c >= 3}


def plain_near(words):
    near, less = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            less[rest, i].add(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for group in less.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain_groups(words):
    near, form = plain_near(words), {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best
    found = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        found.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(found, key=str)


def grouped(spark, words, **sizes):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(map(tuple, spelling_groups(df, **sizes).collect()), key=str)


def invented(seed, n, letters="abé", least=5, most=9):
    rng = random.Random(seed)
    made = {"".join(rng.choice(letters) for _ in range(rng.randrange(least, most + 1))) for _ in range(n)}
    return {w: rng.choice([3, 4, 6, 8, 12, 50, 100, 1000]) for w in made}


@pytest.mark.parametrize("most, bucket", [(2000, 40_000), (30, 100), (1, 20)])
@pytest.mark.parametrize("letters, lengths", [("ab", (5, 8)), ("abcdefghijklmnopqrstuvwxyzé", (5, 6)), ("aé", (9, 12))])
def test_equals_brute_force(spark, most, bucket, letters, lengths):
    words = invented(len(letters), 700, letters, *lengths)
    words |= {w[:-1] + "q": 7 for w in list(words)[::3]} | {"x" + w: 40 for w in list(words)[::4]}
    assert grouped(spark, words, most=most, bucket=bucket) == plain_groups(words)


def test_a_third_of_the_words_shares_one_beginning(spark):
    words = invented(4, 1500, "abc", 6, 8) | {"prefix" + w: n for w, n in invented(5, 900, "abcdefgh", 2, 3).items()}
    assert grouped(spark, words, most=25, bucket=300) == plain_groups(words)


def test_acceptor_is_minimal_and_composes():
    words = sorted(invented(9, 300, "ab", 3, 7))
    acceptor = Acceptor()
    start = acceptor.add(words)
    right = {state: frozenset(acceptor.both(state, state)) for state in range(len(acceptor.arcs))}
    assert right[start] == set(words) and len(set(right.values())) == len(right)
    states = len(right)
    assert acceptor.add(words) == start and len(acceptor.arcs) == states
    pairs = [p for size in range(3, 8) for p in acceptor.accepted(start, size + 1, size)]
    near = plain_near(set(words))
    both = [tuple(sorted(p)) for p in pairs]
    assert len(both) == len(set(both)) and set(both) == {tuple(sorted((w, x))) for w in near for x in near[w]}


def test_each_pair_is_found_once(spark):
    words = invented(6, 900, "ab", 5, 9)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for most in (2000, 5):
        pairs = [(r["word"], r["near"]) for r in near_words(df, most, 200).collect()]
        near = plain_near(words)
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(w, x) for w in near for x in near[w]}


def test_observed_words(spark):
    texts = [
        (1, "Hello hello HELLO Étés×x Étés×x Étés×x hell hell hell Łodzie Łodzie Łodzie"),
        (2, None),
        (3, ""),
        (None, "Nulls nulls nulls"),
        (4, "word" * 60_000 + " " + ("word" * 60_000 + " ") * 2),
        (5, "repeated"),
        (5, "repeated"),
        (5, "repeated"),
    ]
    rng = random.Random(2)
    texts += [(i, " ".join(rng.choice(["Planet", "garden", "sömmar", "planets", "letters"]) for _ in range(200))) for i in range(10, 90)]
    extra = ["doc_id", "text", "word", "run", "n"]
    df = spark.createDataFrame([(*t, "x", 1, 2) for t in texts], "doc_id long, text string, word string, run int, n int").toDF(*extra)
    for odd in (None, 97, 5):
        assert {r["word"]: r["n"] for r in observed(df, odd).collect()} == plain_words(texts, odd)


def test_ties_chains_and_empty_tables(spark):
    chain = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "zzzzz": 5, "zzzzy": 10, "zzzzx": 10, "lonely": 9, "four": 90, "fours": 3}
    got = {r[0]: r for r in grouped(spark, chain)}
    assert got["aaaaa"][1:3] == ("aaaab", "abbbb") and got["zzzzz"][1] == "zzzzx" and got["lonely"][1:] == (None, "lonely", 9, 0, None)
    assert got["fours"][4] == 0
    none = spark.createDataFrame([], "word string, n long")
    assert spelling_groups(none).isEmpty() and near_words(none).isEmpty()
    assert observed(spark.createDataFrame([], "doc_id long, text string"), 97).isEmpty()
    long = {"x" * 40_000: 3, "x" * 40_000 + "y": 6}
    assert [r[1] and len(r[1]) for r in grouped(spark, long)] == [40_001, None]


def test_many_words_with_one_form(spark):
    rows = [(f"w{i}", "hub") for i in range(3000)] + [("hub", "top"), ("top", "end")] + [(f"c{i}", f"c{i + 1}") for i in range(40)]
    found = {r["word"]: r["root"] for r in roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert len(found) == len(rows) and {found[f"w{i}"] for i in range(3000)} == {"end"} and found["c0"] == "c40"


def test_query_equals_brute_force(spark):
    root = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, spelling.op12_spelling(spark, root).collect()), key=str)
    assert got == plain_groups(plain_words(texts, 97))
