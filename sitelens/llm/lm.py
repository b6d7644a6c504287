"""Smoothed bigram model of a corpus: an Elias-Fano trie in parts, built and asked by Spark.

A model that grows with the corpus can't be sent to every task, so its trie is
cut into parts: by a hash of the context and of the word, so that a frequent
context lies in many parts. Texts are cut into batches. A batch sends each part
its distinct words and pairs with their counts; the part adds them up over all
batches, builds its levels in mapped memory, looks up what each batch asked and
sends back a byte per pair. Each batch then scores its own texts. What is
shuffled are arrays, no row per word, and these in planes of bytes: numbers by
frequency, sorted hashes by their steps.

    P(w|v) = (1 - b) (c(vw) + k P(w)) / (c(v) + k) + b P(w)

with P(w) the base estimate. The trie keeps c(vw), the part of the probability
that depends on the pair, in one byte: exact to 127, then in steps of 15 %. A
text begins in the context of an end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import arrow_rows, plain, table, written
from sitelens.llm.elias_fano import Trie
from sitelens.llm.jaccard import low48
from sitelens.llm.planes import by_frequency, grown, grown_keys, shrunk, shrunk_keys
from sitelens.llm.shingles import mixed, word_hashes

PRIOR, BLEND, ADD = 20.0, 0.3, 0.1
#: Tokens to a batch; bytes of text to a part.
BATCH, PART = 1_500_000, 16 << 20
END = np.uint64(0x5851F42D4C957F2D)
EXACT, STEP = 127, 1.15

BATCHES = "batch long, docs array<long>, held array<boolean>, lengths array<int>, words binary, stream binary"
ASKED = "part int, batch long, keys binary, counts binary, firsts binary, sizes binary"
ANSWER = "batch long, part int, data binary, words long, tokens long"


def batches(documents: DataFrame, at_once: int = BATCH) -> DataFrame:
    """Texts as numbers of their words in the list of the batch's words, commonest first; each text ends with END."""
    schema = pa.schema(
        [("batch", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))]
        + [("lengths", pa.list_(pa.int32())), ("words", pa.binary()), ("stream", pa.binary())]
    )

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sitelens.llm.common import batch

        number = TaskContext.get().partitionId() << 32
        docs, held, lengths, tokens = [], [], [], []

        def one() -> pa.RecordBatch:
            words, stream = np.unique(np.concatenate(tokens), return_inverse=True)
            order, rank = by_frequency(stream, len(words))
            row = (number, docs, held, lengths, shrunk(words[order], rising=True), shrunk(rank[stream]))
            return batch([row], schema)

        for b in frames:
            ids, out = b.column("doc_id").to_pylist(), b.column("held_out").to_pylist()
            for row, words, upto in word_hashes(b.column("text")):
                # An end goes behind the words of each text.
                tokens.append(np.insert(words, upto, END))
                docs += ids[row : row + len(upto)]
                held += out[row : row + len(upto)]
                lengths += (np.diff(np.append(0, upto)) + 1).tolist()
                if sum(map(len, tokens)) >= at_once:
                    yield one()
                    number += 1
                    docs, held, lengths, tokens = [], [], [], []
        if docs:
            yield one()

    return documents.select("doc_id", "held_out", "text").mapInArrow(run, BATCHES)


def opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch in order, its tokens as numbers there, the tokens before them, and whether they are learnt from."""
    words = grown(row["words"], rising=True)
    order = np.argsort(words)
    words, place = words[order], np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    stream = place[grown(row["stream"], kind="<u4")]
    lengths = np.asarray(row["lengths"], np.int64)
    before = np.empty_like(stream)
    before[1:] = stream[:-1]
    before[np.cumsum(lengths) - lengths] = np.searchsorted(words, END)
    return words, stream, before, np.repeat(~np.asarray(row["held"], bool), lengths)


def range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def pair_order(words: np.ndarray, context: np.ndarray, after: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each pair, and the order by part, context and word in which batches ask and parts answer."""
    spread = max(1, parts // 8)  # parts that the pairs of a context may lie in
    with np.errstate(over="ignore"):
        salt = mixed(words + np.uint64(11)) % np.uint64(spread)
        part = ((range_of(words, parts)[context] + salt[after].astype(np.int64)) % parts).astype(np.uint16)
    return part, np.argsort(part, kind="stable")  # pairs come in order of (context, word) already


def pairs_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, then context, word and learnt count of each distinct pair, and the pair of each token."""
    words, stream, before, learnt = opened(row)
    pair, number = np.unique(before * len(words) + stream, return_inverse=True)
    counts = np.bincount(number, learnt, len(pair)).astype(np.int64)
    return words, pair // len(words), pair % len(words), counts, number


def _ask_words(parts: int):
    schema = asked_schema()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for row in b.to_pylist():
                words, stream, _, learnt = opened(row)
                counts = np.bincount(stream, learnt, len(words)).astype("<u4")
                of = range_of(words, parts)
                cuts = np.flatnonzero(np.diff(of)) + 1
                rows = [
                    (int(of[i[0]]), row["batch"], shrunk(words[i], rising=True), shrunk(counts[i]), None, None)
                    for i in np.split(np.arange(len(words)), cuts)
                ]
                yield from arrow_rows(rows, schema)

    return run


def asked_schema() -> pa.Schema:
    kinds = [("part", pa.int32()), ("batch", pa.int64())]
    return pa.schema(kinds + [(n, pa.binary()) for n in ("keys", "counts", "firsts", "sizes")])


def _ask_pairs(parts: int):
    schema = asked_schema()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for row in b.to_pylist():
                words, context, after, counts, _ = pairs_of(row)
                short = low48(words)
                part, order = pair_order(words, context, after, parts)
                for i in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    first = np.flatnonzero(np.concatenate([[True], np.diff(context[i]) != 0]))
                    yield from arrow_rows(
                        [
                            (
                                int(part[i[0]]),
                                row["batch"],
                                shrunk_keys(short[after[i]]),
                                shrunk(counts[i]),
                                shrunk(short[context[i][first]], rising=True),
                                shrunk(np.diff(np.append(first, len(i)))),
                            )
                        ],
                        schema,
                    )

    return run


def answer_words(frame: pd.DataFrame) -> pd.DataFrame:
    """Learnt counts over all batches for the words of each; the part's totals stand on its first row."""
    asked = [grown(k, rising=True) for k in frame["keys"]]
    words, number = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.concatenate([grown(c, kind="<u4") for c in frame["counts"]])
    total = np.zeros(len(words), np.int64)
    np.add.at(total, number, counts)
    ends = np.cumsum([len(a) for a in asked])[:-1]
    rows = [
        (b, p, shrunk(total[i]), 0, 0)
        for b, p, i in zip(frame["batch"], frame["part"], np.split(number, ends))
    ]
    rows[0] = (*rows[0][:3], int((total > 0).sum()), int(total.sum()))
    return pd.DataFrame(rows, columns=["batch", "part", "data", "words", "tokens"])


def coded(counts: np.ndarray) -> np.ndarray:
    high = EXACT + np.round(np.log(np.maximum(counts, EXACT) / EXACT) / np.log(STEP))
    return np.where(counts <= EXACT, counts, np.minimum(255, high)).astype(np.uint8)


COUNTS = np.concatenate([np.arange(EXACT + 1.0), EXACT * STEP ** np.arange(1, 256 - EXACT)])


def answer_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """Codes for the pairs of each batch, from a trie over the pairs that any batch learnt."""
    after = [grown_keys(k) for k in frame["keys"]]
    context = [
        np.repeat(grown(f, rising=True), grown(s, kind="<u4")) for f, s in zip(frame["firsts"], frame["sizes"])
    ]
    sizes = np.cumsum([len(a) for a in after])[:-1]
    v, w = np.concatenate(context), np.concatenate(after)
    counts = np.concatenate([grown(c, kind="<u4") for c in frame["counts"]]).astype(np.int64)
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
    first = np.flatnonzero(new)
    total = np.add.reduceat(counts[order], first)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    v, w = v[first], w[first]
    learnt = total > 0
    trie = Trie(v[learnt], w[learnt], coded(total[learnt]))
    codes = trie.find(v, w)
    rows = [
        (b, p, zstandard.compress(codes[i].tobytes()), 0, 0) for b, p, i in zip(frame["batch"], frame["part"], np.split(number, sizes))
    ]
    return pd.DataFrame(rows, columns=["batch", "part", "data", "words", "tokens"])


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(parts: int, total: int, known_words: int, prior: float, blend: float):
    floor = np.log10(total + ADD * (known_words + 1)) if total or known_words else 0.0

    def run(rows: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        words, context, after, _, number = pairs_of(row)
        stream = after[number]
        of_words = back[back["pairs"] == 0].sort_values("part")
        of_pairs = back[back["pairs"] == 1].sort_values("part")
        c = np.concatenate([grown(d) for d in of_words["data"]]).astype(np.float64)
        _, order = pair_order(words, context, after, parts)
        codes = np.empty(len(order), np.uint8)
        codes[order] = np.concatenate([np.frombuffer(zstandard.decompress(d), "u1") for d in of_pairs["data"]])
        base = np.log10(c + ADD) - floor
        share = 10.0**base
        p = (1 - blend) * (COUNTS[codes] + prior * share[after]) / (c[context] + prior) + blend * share[after]
        lengths = np.asarray(row["lengths"], np.int64)
        starts = np.cumsum(lengths) - lengths
        return pd.DataFrame(
            {
                "doc_id": pd.array(row["docs"], "Int64") if any(d is None or d != d for d in row["docs"]) else row["docs"],
                "held_out": row["held"],
                "n_tokens": lengths,
                "n_known": np.add.reduceat((c > 0)[stream].astype(np.int64), starts),
                "base_score": np.add.reduceat(base[stream], starts),
                "score": np.add.reduceat(np.log10(p)[number], starts),
            }
        )

    return run


def score_texts(
    documents: DataFrame, held_out, prior: float = PRIOR, blend: float = BLEND, batch: int = BATCH, part: int = PART
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held_out`` is a condition on doc_id; the model learns from the other
    rows. Null and empty texts are their end alone. A null doc_id is learnt
    from unless the condition holds; repeated rows count and are scored each by
    itself. An empty table gives no rows.
    """
    own = plain(documents, doc_id="long", text="string").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    weight = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(60_000, max(12, -(-weight // part))))
    kept = written(batches(own, batch))
    words = kept.mapInArrow(_ask_words(parts), ASKED).groupBy("part").applyInPandas(answer_words, ANSWER)
    words = written(words)
    sums = words.agg(F.sum("words"), F.sum("tokens")).first()
    known, total = sums[0] or 0, sums[1] or 0
    pairs = kept.mapInArrow(_ask_pairs(parts), ASKED).groupBy("part").applyInPandas(answer_pairs, ANSWER)
    back = words.select("batch", "part", "data", F.lit(0).alias("pairs")).unionByName(
        pairs.select("batch", "part", "data", F.lit(1).alias("pairs"))
    )
    run = _score(parts, total, known, prior, blend)
    found = kept.groupBy("batch").cogroup(back.groupBy("batch")).applyInPandas(run, SCORED)
    return found.withColumn("train_tokens", F.lit(total).cast("long"))


def op7_lm(spark, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    found = score_texts(table(spark, sf_dir, "documents"), held)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
