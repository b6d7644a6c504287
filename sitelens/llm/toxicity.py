"""Toxicity by multiple-instance learning.

Labels belong to documents, the cause to a few sentences. Each sentence has a
probability from its words and their letters; a document is toxic if any of its
sentences is, so its probability is the noisy-or of theirs. Only document
labels train it; afterwards the sentences' own probabilities say where the
trouble is. Sentences that are not offending by themselves add up as far as in
the longest texts learnt from; in longer ones their average counts, so that
length alone makes no document toxic.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitelens.llm.common import make_room, plain, spare, table

#: The bounded sample that the model is fitted on: documents of each label, and the longest text taken.
SAMPLE = {1: 1200, 0: 2400}
SAMPLE_CHARS = 8_000
THRESHOLD = 0.7
#: From this probability a sentence is offending by itself and counts in full, however long the text.
OFFENDING = 0.5
#: Of the others at most so many add up: about the sentences of a text of SAMPLE_CHARS signs.
FAINT = 120
SIZE = 1 << 18
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Places of a word (in lower case) and of its runs of four and five letters, edges marked."""
    marked = f"<{word}>"
    found = {marked, *(marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1))}
    return [zlib.crc32(f.encode()) % SIZE for f in sorted(found)]


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, in code points."""
    return [m.span() for m in SENTENCE.finditer(text)]


def telling(toxic: np.ndarray, other: np.ndarray, n1: int, n0: int, least: float = 4.5) -> np.ndarray:
    """Places met in a surely larger share of the n1 toxic documents than of the n0 others, from how many have them."""
    every = toxic + other
    share = np.clip(every / max(1, n1 + n0), 1e-9, 1 - 1e-9)
    surplus = toxic / max(1, n1) - other / max(1, n0)
    return (every >= 3) & (surplus > least * np.sqrt(share * (1 - share) * (1 / max(1, n1) + 1 / max(1, n0))))


def fit(texts: list[str], labels: list[int], epochs: int = 150, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights by place and the bias of a sentence, by gradient descent on the noisy-or's log loss.

    Only places that tell toxic documents from others are weighed; a sentence
    without any has the bias alone.
    """
    known: dict[str, np.ndarray] = {}
    met = np.zeros((2, SIZE))
    for text, label in zip(texts, labels):
        words = set(WORD.findall(text.lower()))
        for w in words - known.keys():
            known[w] = np.array(features(w), np.int32)
        if words:
            met[label, np.unique(np.concatenate([known[w] for w in words]))] += 1
    tells = telling(met[1], met[0], sum(labels), len(labels) - sum(labels))
    known = {w: own for w, f in known.items() if len(own := f[tells[f]])}
    places: list[np.ndarray] = []
    of_doc: list[int] = []
    for d, text in enumerate(texts):
        low = text.lower()
        for s, e in sentences(low):
            own = [known[w] for w in set(WORD.findall(low, s, e)) if w in known]
            of_doc.append(d)
            places.append(np.concatenate(own) if own else np.zeros(0, np.int32))
    weights, bias = np.zeros(SIZE), -7.0
    if not of_doc:
        return weights, bias
    y, doc = np.array(labels, float), np.array(of_doc, np.int32)
    sentence = np.repeat(np.arange(len(doc), dtype=np.int32), list(map(len, places)))
    place = np.concatenate(places)
    used, place = np.unique(place, return_inverse=True)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both labels weigh alike
    w, b = np.zeros(len(used)), bias
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, epochs + 1):
        z = np.bincount(sentence, w[place], minlength=len(doc)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.clip(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)), -30, -1e-9)
        none = np.exp(clean)  # probability that no sentence is toxic
        pull = np.where(y == 1, -none / (1 - none), 1.0) * share
        g = pull[doc] * p
        full = np.append(np.bincount(place, g[sentence], minlength=len(used)) + decay * w, g.sum())
        m = 0.9 * m + 0.1 * full
        v = 0.999 * v + 0.001 * full**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(0.0, w - move[:-1]), min(bias, b - move[-1])
    weights[used] = w
    return weights, float(b)


class Scorer:
    """Sentence and document probabilities; words met before are remembered."""

    def __init__(self, weights: np.ndarray, bias: float, limit: int = 200_000):
        self.weights, self.bias, self.limit = weights, bias, limit
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            got = self.known[word] = float(self.weights[features(word)].sum())
        return got

    def document(self, text: str | None, over: float = OFFENDING) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of the text, and its sentences of at least ``over``."""
        low = (text or "").lower()
        if len(low) != len(text or ""):  # a few letters grow in lower case; positions must not
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        weights = {w: v for w in set(WORD.findall(low)) if (v := self.word(w))}
        spans = sentences(low)
        without = math.log1p(-1 / (1 + math.exp(-self.bias)))  # of a sentence without any weight
        clean, faint, n, bad = 0.0, 0.0, 0, []
        if not weights:
            return -math.expm1(min(len(spans), FAINT) * without), bad
        for s, e in spans:
            z = sum(weights.get(w, 0.0) for w in set(WORD.findall(low, s, e)))
            p = 1 / (1 + math.exp(-min(30.0, self.bias + z)))
            if p >= OFFENDING:
                clean += math.log1p(-min(p, 1 - 1e-9))
            else:
                faint, n = faint + (math.log1p(-p) if z else without), n + 1
            if p >= over:
                bad.append((s, e, p))
        return -math.expm1(clean + faint * min(1.0, FAINT / max(1, n))), bad


def fold(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def training_rows(documents: DataFrame, labels: DataFrame, sample: dict[int, int], chars: int) -> list[tuple[str, int]]:
    """At most the asked number of documents of each label, held-out rows never.

    Labels are drawn by a hash of their doc_id, before any text is read; a
    document labelled twice counts as toxic if any label says so, and of
    documents of one id the first text in order is taken. Longer texts than
    ``chars`` are not learnt from.
    """
    marks = (
        plain(labels, doc_id="long", toxic="int")
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id") != 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    drawn: list[tuple[int, int]] = []
    for label, most in sample.items():
        few = marks.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        drawn += [(r["doc_id"], label) for r in few.collect()]
    if not drawn:
        return []
    # As many rows as the sample asks for, whatever the tables hold.
    # By Arrow: rows would be pickled anew by a second set of Python workers, which then stay on every executor.
    columns = [pa.array(c, kind) for c, kind in zip(zip(*drawn), (pa.int64(), pa.int32()))]
    ids = F.broadcast(documents.sparkSession.createDataFrame(pa.table(columns, ["doc_id", "toxic"])))
    texts = plain(documents, doc_id="long", text="string").where(F.length("text").between(1, chars))
    known = texts.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return [(r["text"], r["toxic"]) for r in known.orderBy("doc_id").collect()]


def score_documents(
    documents: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    sample: dict[int, int] | None = None,
    chars: int = SAMPLE_CHARS,
    keep_text: bool = True,
) -> DataFrame:
    """Rows of ``documents`` with score, predicted and ``toxic_spans`` (start, end, score of offending sentences).

    Every whole text is scored; null and empty ones score 0. Repeated rows are
    kept and score alike. Without labels of both kinds nothing is learnt and
    every score is near the starting bias. Columns named like a result are
    replaced; an empty table gives no rows.
    """
    results = ("score", "predicted", "toxic_spans")
    rows = training_rows(documents, labels, sample or SAMPLE, chars)
    shared = documents.sparkSession.sparkContext.broadcast(fit([r[0] for r in rows], [r[1] for r in rows]))
    kept = [c for c in documents.columns if c not in results and (keep_text or c != "text")]
    text = F.col("`text`").cast("string") if "text" in documents.columns else F.lit(None).cast("string")
    working = spare("_text", kept)
    own = documents.select(*(f"`{c}`" for c in kept), text.alias(working))
    added = StructType.fromDDL("score double, predicted int, toxic_spans array<struct<start:int,end:int,score:double>>")
    out = StructType(own.drop(working).schema.fields + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        scorer = Scorer(*shared.value)
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            found = [scorer.document(t.as_py()) for t in b.column(b.num_columns - 1)]
            new = [
                pa.array([f[0] for f in found], pa.float64()),
                pa.array([int(f[0] >= threshold) for f in found], pa.int32()),
                pa.array([[{"start": s, "end": e, "score": p} for s, e, p in f[1]] for f in found], spans),
            ]
            names = [b.schema.field(i).name for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns - 1)] + new, names=[*names, *results]
            )

    return own.mapInArrow(run, out)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_documents(documents, table(spark, sf_dir, "labels"), keep_text=False)
    return found.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", "predicted", "toxic_spans")
