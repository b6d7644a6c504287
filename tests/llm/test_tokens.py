"""Token ids, packing and token files against the library and plain restatements."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.core.rdd import RDD
from tokenizers import Tokenizer

from sitelens.llm import packing, pieces, rans, token_files, toxicity
from sitelens.llm.pieces import Pieces, tokenizer_path

LETTERS = "ab1é '’s.,!“€²½ \n\t  Σσ́中あΩİ \x85☃😀_-tre'll\x1c\x00"
DOCS = [(3, "One text."), (1, None), (1, None), (2, ""), (None, "no id"), (7, "long text, " * 3000), (0, "x"), (5, "  \n ")]


def library(name):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("limit", [900_000, 5])
def test_ids_are_the_librarys(name, spaced, limit):
    draw = random.Random(4)
    texts = [f"ab{c}cd {c}x {c}{c} 1{c}!{c}2 's{c}t  {c}\n {c}" for c in map(chr, [*range(1, 0x250), *range(0x2000, 0x2070)])]
    texts += ["".join(draw.choices(LETTERS, k=draw.randint(0, 25))) for _ in range(3000)] + ["<|endoftext|> a<|startoftext|>b"]
    encode, known = Pieces(tokenizer_path(name), spaced, limit=limit), library(name)
    for text in texts[:: 1 if limit > 5 else 10]:
        assert np.frombuffer(encode(text), "<u4").tolist() == known.encode(text, add_special_tokens=False).ids, ascii(text)


def plain_best_fit(counts, capacity):
    gaps, opened = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect_left(gaps, length)
            size = gaps.pop(at) if at < len(gaps) else capacity
            opened += size == capacity
            insort(gaps, size - length)
    return opened


def test_best_fit_places_every_rank():
    draw = random.Random(5)
    for _ in range(200):
        capacity = draw.choice([5, 16, 50, 2048])
        counts = {draw.randint(1, capacity): draw.randint(1, 60) for _ in range(draw.randint(0, 25))}
        runs, opened = packing.best_fit(counts, capacity)
        ranks, filled = defaultdict(list), defaultdict(list)
        for length, rank, count, sequence, offset in runs:
            ranks[length] += range(rank, rank + count)
            for i in range(count):
                filled[sequence + i].append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        assert len(filled) == opened <= plain_best_fit(counts, capacity)
        for parts in filled.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
            assert sum(n for _, n in parts) <= capacity


def test_packing(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'clash' AS place", "1 AS part")
    rows = packing.pack_documents(df).collect()
    known = library(packing.TOKENIZER)
    expected = Counter()
    for doc, text in DOCS:
        ids = np.array(known.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            expected[doc, n, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
    assert len(places) == -(-sum(r.length for r in rows) // 2048)
    assert packing.pack_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1025, 70_000])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 50_000).astype(np.int64)
    codes = rans.Table(rans.scaled(Counter(ids.tolist())))
    data = rans.encode(ids, [1, None], np.array([n, 0]), codes, lanes=64)
    block = rans.Block(data)
    assert (block.ids(codes) == ids).all() and block.docs == [1, None] and block.lengths.tolist() == [n, 0]
    for i in reversed(range(len(block.places))):  # parts decode by themselves, in any order
        own = block.part(i, codes)
        assert (own[: len(ids[i * 64 * block.lanes :])] == ids[i * 64 * block.lanes :][: len(own)]).all()
    for at in (0, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            rans.Block(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_token_files(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'clash' AS part", "2 AS row")
    folder = token_files.write_tokens(df, token_files.shared_folder(spark), block=50)
    rows = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    known, start = library(token_files.TOKENIZER), 0
    for (doc, text), r in zip(sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0)), rows, strict=True):
        ids = np.array(known.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(r) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    folder = token_files.write_tokens(df.limit(0), token_files.shared_folder(spark))
    assert token_files.read_tokens(spark, folder).count() == 0


def test_memory_is_bounded_in_bytes():
    encode = Pieces(tokenizer_path("word_bpe_49k.json"), False, limit=200_000)
    for i in range(40):
        encode(" ".join(f"word{i}x{j}" for j in range(200)) + " " + "long" * 300)
        assert encode.held <= 400_000 and all(len(w) < pieces.LONG for w in encode.words)
        assert encode.held >= sum(map(len, encode.words)) + sum(map(len, encode.words.values()))


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_met_again_outlast_a_full_memory(name, spaced):
    encode, asked = Pieces(tokenizer_path(name), spaced, limit=100_000), Counter()
    own = encode.encode_letters

    def counted(words, *more):
        asked.update([words] if isinstance(words, str) else words)
        return own(words, *more)

    encode.encode_letters = counted
    draw = random.Random(6)
    for _ in range(30):
        encode(" the common, words " + " ".join("".join(draw.choices("abcdefgh", k=12)) for _ in range(100)))
    assert asked["common"] == 1 and asked["words"] == 1 and len(asked) > 2900


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_every_letter_is_written_as_the_library_writes_it(name, spaced):
    encode, known = Pieces(tokenizer_path(name), spaced), library(name)
    letters = [c for c in map(chr, range(0x660)) if c.isalpha()]
    for a, b in zip(letters, letters[1:] + letters[:1]):
        text = f"{a} a{a}, Z{a}{b}!\n{b}{a}. {a}{b}{a}"
        assert np.frombuffer(encode(text), "<u4").tolist() == known.encode(text, add_special_tokens=False).ids, ascii(text)


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("taken", [1, 300, 1 << 20])
def test_texts_taken_together_keep_their_ids(name, spaced, taken, monkeypatch):
    monkeypatch.setattr(pieces, "TAKEN", taken)
    draw = random.Random(7)
    texts = [None, "", " ", "\n", "a", " a", "a\n\nb", "a\n\n\nb", "a\n", "a\n\n", "\n\na", "a \nb", "a\n b", "a.\nB, c", "\x00 \nb", "a\x1cb c"]
    texts += ["".join(draw.choices("ab., \nßé\t" if i % 3 else "ab. \n", [9, 9, 1, 1, 7, 2, 1, 1, 0.2][: 9 if i % 3 else 5], k=30)) for i in range(300)]
    draw.shuffle(texts)
    known = library(name)
    expected = [known.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(i, "<u4").tolist() for i in Pieces(tokenizer_path(name), spaced).each(texts)] == expected


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_a_task_looks_a_word_up_once_for_many_texts(name, spaced, monkeypatch):
    looked = Counter()

    class Counted(pieces.Known):
        def __getitem__(self, word):
            looked[word] += 1
            return super().__getitem__(word)

    monkeypatch.setattr(pieces, "Known", Counted)
    monkeypatch.setattr(pieces, "_KEPT", {})
    monkeypatch.setattr(token_files.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    docs = pa.record_batch({"doc_id": list(range(400)), "text": ["x" + " the common, words\nof all texts" * 20] * 400})
    run = token_files._tokenise(tokenizer_path(name), spaced, 2, 1 << 18)
    (block,) = run([docs])
    assert block["tokens"][0].as_py() == 400 * (len(library(name).encode(docs["text"][0].as_py(), add_special_tokens=False).ids) + 1)
    assert sum(looked.values()) < 2000  # of 56,400 words


def test_a_worker_keeps_no_words_while_it_scores(spark, monkeypatch):
    """The pipeline's workers go on from packing to scoring, with the same memory."""
    df, found = spark.createDataFrame(DOCS, "doc_id long, text string"), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, out: found.append(run) or self)
    packing.cut_documents(df)
    toxicity.score_documents(df, spark.createDataFrame([], "doc_id long, toxic int"))
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    docs = pa.record_batch({"doc_id": [1, 2], "text": ["some words here", None]})
    assert list(found[0]([docs])) and pieces._KEPT
    assert list(found[1]([docs])) and not pieces._KEPT


def test_training_rows_start_no_python_workers(spark, monkeypatch):
    """A second set of them, beside those of mapInArrow, would stay on every executor."""
    df = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    expected = [(f"text {i}", i % 2) for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1]

    def refused(rdd):
        raise AssertionError("rows pickled by Python workers")

    monkeypatch.setattr(RDD, "_to_java_object_rdd", refused)
    assert toxicity.training_rows(df, labels, {1: 9, 0: 9}, 100) == expected
