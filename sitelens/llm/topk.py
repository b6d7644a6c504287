"""Exact top-k by inner product, with blocks of vectors pruned by their bounds.

Vectors are dealt into blocks of consecutive ids; a block is its forward index
(a matrix) with the largest and smallest value of each component. The sum over
components of the larger of q*max and q*min bounds every score in a block. A
query visits blocks by falling bound and stops when the bound is below its k-th
score. A task holds a chunk of queries and a shard of blocks, both of bounded
size; the k best of each shard are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import cut_lineage, plain, table

SCALE, K = 64, 20
#: Vectors in a block, blocks in a shard, queries in a chunk.
BLOCK, SHARD, CHUNK = 512, 32, 1024
NONE = -(1 << 62)
FOUND = "q_part int, q_number int, q_place int, query_id long, vec_id long, score long"


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; vectors that are null or hold null or non-finite ones are left out."""
    kept = plain(embeddings, vec_id="long", embedding="array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return kept.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("v")
    )


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """(part, number, dim, ids, vectors, high, low): blocks of consecutive ids and one dimension; matrices as bytes."""
    schema = pa.schema(
        [("part", pa.int32()), ("number", pa.int32()), ("dim", pa.int32())]
        + [(n, pa.binary()) for n in ("ids", "vectors", "high", "low")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from sitelens.llm.common import batch

        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int):
            nonlocal number
            ids, rows = held.pop(dim)
            m = np.array(rows, "<i8").reshape(len(ids), dim)
            row = (part, number, dim, np.array(ids, "<i8").tobytes(), m.tobytes(), m.max(0).tobytes(), m.min(0).tobytes())
            number += 1
            return batch([row], schema)

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v")):
                own = np.array(v.values.to_numpy(zero_copy_only=False), np.int64)
                ids, rows = held.setdefault(len(own), ([], []))
                ids.append(i)
                rows.append(own)
                if len(ids) >= size:
                    yield block(len(own))
        for dim in list(held):
            yield block(dim)

    # Ids repeat at most as often as rows do; equal ids are told apart by their values.
    dealt = vectors.repartitionByRange(F.col("vec_id"), F.xxhash64("v")).sortWithinPartitions("vec_id")
    return dealt.mapInArrow(
        run, "part int, number int, dim int, ids binary, vectors binary, high binary, low binary"
    )


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of queries (rows) in blocks (columns); exact integers."""
    up = np.maximum(q, 0)
    return product(up, high) + product(q - up, low)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers; floats are used where they are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def merge(ids: np.ndarray, scores: np.ndarray, new_ids: np.ndarray, new_scores: np.ndarray, k: int):
    """The k best of each row by score, then smaller id; unused places have the lowest score."""
    i, s = np.concatenate([ids, new_ids], 1), np.concatenate([scores, new_scores], 1)
    if s.shape[1] > 4 * k:  # only those not below the k-th can stay
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        width = int((s >= kth).sum(1).max())
        if width < s.shape[1]:
            order = np.argsort(s < kth, axis=1, kind="stable")[:, :width]
            i, s = np.take_along_axis(i, order, 1), np.take_along_axis(s, order, 1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(i, order, 1), np.take_along_axis(s, order, 1)


def search(q_ids: np.ndarray, q: np.ndarray, shard: list, k: int):
    """Best k (ids, scores) of each query among the blocks of a shard."""
    n = len(q_ids)
    best_i = np.full((n, k), np.iinfo(np.int64).max)
    best_s = np.full((n, k), NONE)
    bound = bounds(q, np.stack([b[2] for b in shard]), np.stack([b[3] for b in shard]))
    order = np.argsort(-bound, axis=1, kind="stable")
    live = np.arange(n)
    for step in range(len(shard)):
        at = order[live, step]
        ok = bound[live, at] >= best_s[live, k - 1]  # an equal score may have a smaller id
        live, at = live[ok], at[ok]  # bounds only fall from here on, so a query that stops is done
        if not len(live):
            break
        for number in np.unique(at):
            own = live[at == number]
            ids, vectors = shard[number][:2]
            scores = product(q[own], vectors)
            names = np.broadcast_to(ids, scores.shape)
            scores = np.where(names == q_ids[own][:, None], NONE, scores)  # never the query itself
            best_i[own], best_s[own] = merge(best_i[own], best_s[own], names, scores, k)
    return best_i, best_s


def opened(row, *names: str) -> list[np.ndarray]:
    shape = (len(row["ids"]) // 8, row["dim"])
    return [np.frombuffer(row[n], "<i8").reshape(shape if n == "vectors" else -1) for n in names]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, shard: int = SHARD, chunk: int = CHUNK
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over ``vectors``, ties to the smaller id.

    Both have (vec_id, v) from ``whole_vectors``. A query meets vectors of its
    own length only, and none with its own id. Repeated rows count each by
    itself, as candidates and as queries; fewer candidates than k give fewer
    ranks; empty tables give no rows.
    """
    index = cut_lineage(blocks(vectors, block).withColumn("shard", F.floor(F.col("number") / shard)))
    asked = cut_lineage(
        blocks(queries, chunk).select(
            F.col("part").alias("q_part"), F.col("number").alias("q_number"), "dim", "ids", "vectors"
        )
    )
    # Which chunk meets which shard: keys alone, one row for chunk x shard vectors.
    grid = asked.select("dim", "q_part", "q_number").join(index.select("dim", "part", "shard").distinct(), "dim")
    keys = ["q_part", "q_number", "dim", "part", "shard"]

    def run(key, chunk_rows: pd.DataFrame, shard_rows: pd.DataFrame) -> pd.DataFrame:
        row = chunk_rows.iloc[0]
        q_ids, q = opened(row, "ids", "vectors")
        held = [opened(r, "ids", "vectors", "high", "low") for _, r in shard_rows.iterrows()]
        ids, scores = search(q_ids, q, held, k)
        place = np.repeat(np.arange(len(q_ids), dtype=np.int32), ids.shape[1])
        out = pd.DataFrame(
            {
                "q_part": np.int32(key[0]),
                "q_number": np.int32(key[1]),
                "q_place": place,
                "query_id": q_ids[place],
                "vec_id": ids.reshape(-1),
                "score": scores.reshape(-1),
            }
        )
        return out[out["score"] > NONE]

    left = grid.join(asked, ["dim", "q_part", "q_number"]).groupBy(*keys)
    right = grid.join(index.drop("number"), ["dim", "part", "shard"])
    right = right.toDF(*right.columns).groupBy(*keys)  # names of its own: both sides come from one index
    found = left.cogroup(right).applyInPandas(run, FOUND)
    best = Window.partitionBy("q_part", "q_number", "q_place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_topk(spark, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


OP5_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM fine q JOIN fine c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""
