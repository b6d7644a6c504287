"""Nearest neighbours, example pairs and question-to-table matching."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.operators.skew import dealt, parts_by_default, repeated, salted_join
from sitelens.runtime import cut_lineage

BLOCK_ROWS = 8192
# Queries measured at a time inside a block; bounds the distance matrix.
BATCH_ROWS = 1024


# Cells that the corpus is cut into, at most: their centres and sizes are all that is sent to every task.
MOST_CELLS = 1024


def knn_l2(queries: DataFrame, corpus: DataFrame, k: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The exact ``k`` nearest corpus vectors of each query by squared L2, ties by id.

    Inputs have ``vec_id`` and ``embedding``. Vectors that are null or hold null
    or non-finite components take no part, and a query meets vectors of its own
    length only. The corpus is cut into cells around pivots drawn from it. A
    query first meets its own cell; the k-th distance found there, and the cells'
    radii and sizes, bound how far its k-th neighbour can be, and by
    the triangle inequality it is sent only to those other cells that may hold one as
    near. Cells of more than ``block_rows`` vectors, and their queries, are dealt
    into blocks; a task compares one pair of blocks and keeps k candidates per
    query. Copies of one vector are compared once.
    """
    stored, asked = _usable(corpus), _usable(queries)
    cells = min(MOST_CELLS, -(-stored.count() // block_rows))
    if cells <= 1:  # one cell holds all: there is nothing to leave out
        stored, asked = stored.withColumn("cell", F.lit(0)), asked.withColumn("cell", F.lit(0))
        sizes = stored.groupBy("dim", "cell").agg(F.count("*").alias("n"))
        sizes = sizes.withColumn("m", asked.agg(F.count("*").alias("m")).scalar())
        return _k_best(_compared(asked, stored, sizes, k, block_rows), k)
    return _k_best(_in_cells(stored, asked, cells, k, block_rows), k)


def _k_best(candidates: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return (
        candidates.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


def _compared(routed: DataFrame, stored: DataFrame, sizes: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Candidates (query_id, vec_id, distance) of every query in the cells it is sent to; ``sizes`` has a row per cell."""
    blocks = F.broadcast(
        sizes.select(
            "dim",
            "cell",
            F.ceil(F.col("n") / block_rows).cast("int").alias("c_blocks"),
            F.greatest(F.ceil(F.col("m") / block_rows), F.lit(1)).cast("int").alias("q_blocks"),
        )
    )

    def in_blocks(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.join(blocks, ["dim", "cell"]).select(
            "dim",
            "cell",
            "vec_id",
            "embedding",
            F.pmod(F.xxhash64("vec_id"), F.col(f"{own}_blocks")).cast("int").alias(f"{own}b"),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}b"),
        )

    schema = T.StructType(
        [
            T.StructField("query_id", routed.schema["vec_id"].dataType),
            T.StructField("vec_id", stored.schema["vec_id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )

    def nearest(_key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return _block_nearest(q, c, k)

    keys = ["dim", "cell", "qb", "cb"]
    left, right = in_blocks(routed, "q", "c"), in_blocks(stored, "c", "q")
    right = right.toDF(*right.columns)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, schema)


def _in_cells(stored: DataFrame, asked: DataFrame, cells: int, k: int, block_rows: int) -> DataFrame:
    """Candidates of every query from its own cell, then from the others that its k-th distance reaches."""
    placed, homes, sizes, route = _routed(stored, asked, cells, k)
    own = cut_lineage(_k_best(_compared(homes, placed, sizes(homes), k, block_rows), k).drop("rank"))
    reach = own.groupBy("query_id").agg(F.count("*").alias("found"), F.max("distance").alias("farthest"))
    reach = reach.select(F.col("query_id").alias("vec_id"), F.when(F.col("found") >= k, F.sqrt("farthest")).alias("reach"))
    others = route(homes.join(reach, "vec_id", "left"))
    # A cell that no other query reaches is not sent anywhere.
    reached = sizes(others).where("m > 0")
    return own.unionByName(_compared(others, placed, reached, k, block_rows))


def _usable(df: DataFrame) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        "vec_id", vector.alias("embedding"), F.size("embedding").alias("dim")
    )


def _routed(
    stored: DataFrame, asked: DataFrame, cells: int, k: int
) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """The corpus by cell, the queries in their own cells, and two functions.

    The first gives (dim, cell, n vectors, m queries) of queries in cells; the
    second sends queries that know their ``reach`` (null: unknown) to every other cell they have to visit.
    """
    spark = stored.sparkSession
    drawn = stored.select("dim", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).collect()
    pivots: dict[int, np.ndarray] = {}
    for row in drawn:
        pivots.setdefault(row["dim"], []).append(row["embedding"])
    pivots = {dim: np.unique(np.array(p, float).reshape(len(p), dim), axis=0) for dim, p in pivots.items()}

    def distances(frame: pd.DataFrame, dim: int) -> np.ndarray:
        x = np.stack(frame["embedding"].to_numpy()).reshape(len(frame), dim)
        p = pivots.get(dim, np.zeros((1, dim)))  # any point may be a pivot
        squares = (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)[None, :]
        return np.sqrt(np.maximum(squares, 0))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                d = distances(part, dim)
                yield part.assign(cell=d.argmin(1).astype("int32"), away=d.min(1))

    columns = "embedding array<double>, dim int, cell int"

    def typed(df: DataFrame) -> str:
        return f"vec_id {df.schema['vec_id'].dataType.simpleString()}, {columns}"

    placed = stored.mapInPandas(assign, f"{typed(stored)}, away double")
    # One row per cell, and cells are bounded.
    found = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    held = {}
    for row in found:
        held.setdefault(row["dim"], []).append((row["cell"], row["n"], row["radius"]))

    held = {dim: [np.array(x) for x in zip(*rows)] for dim, rows in held.items()}

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                if dim in held:  # else no vector has this length
                    cell = held[dim][0]
                    yield part.assign(cell=cell[distances(part, dim)[:, cell].argmin(1)].astype("int32"))

    def reached(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                cell, n, radius = held[dim]
                d = distances(part, dim)[:, cell]
                # Within the k-th bound there are k vectors for sure; the slack covers rounding.
                order = np.argsort(d + radius, axis=1)
                enough = np.minimum((np.cumsum(n[order], axis=1) < k).sum(1), len(cell) - 1)
                bound = np.take_along_axis(d + radius, np.take_along_axis(order, enough[:, None], 1), 1)
                bound = np.fmin(bound, part["reach"].to_numpy(float)[:, None])
                short = n.sum() < k
                slack = 1e-6 * (1 + np.abs(d) + radius)
                other = cell[None, :] != part["cell"].to_numpy()[:, None]
                rows, at = np.nonzero(((d - radius <= bound + slack) | short) & other)
                yield part.iloc[rows].drop(columns="reach").assign(cell=cell[at].astype("int32"))

    def sizes(routed: DataFrame) -> DataFrame:
        visits = routed.groupBy("dim", "cell").agg(F.count("*").alias("m")).collect()
        m = {(r["dim"], r["cell"]): r["m"] for r in visits}
        rows = [(r["dim"], r["cell"], r["n"], m.get((r["dim"], r["cell"]), 0)) for r in found]
        return spark.createDataFrame(rows, "dim int, cell int, n long, m long")

    def route(homes: DataFrame) -> DataFrame:
        kept = homes.select("vec_id", "embedding", "dim", "cell", "reach")
        return kept.mapInPandas(reached, typed(homes))

    return placed.drop("away"), asked.mapInPandas(home, typed(asked)), sizes, route


def _block_nearest(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """k candidates per query of one block pair, as (query_id, vec_id, distance)."""
    if q.empty or c.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "distance": []})
    dim = len(q["embedding"].iloc[0])
    queries = np.stack(q["embedding"].to_numpy()).reshape(len(q), dim)
    c = c.sort_values("vec_id", kind="stable")
    ids = c["vec_id"].to_numpy()
    # Copies of a vector are compared once; only their k smallest ids can be among the nearest.
    vectors, inverse = np.unique(np.stack(c["embedding"].to_numpy()).reshape(len(c), dim), axis=0, return_inverse=True)
    by_vector = np.argsort(inverse.ravel(), kind="stable")
    starts = np.searchsorted(inverse.ravel()[by_vector], np.arange(len(vectors) + 1))
    squares = (vectors**2).sum(axis=1)
    kth = min(k, len(vectors)) - 1
    query_ids = q["vec_id"].to_numpy()
    found: list[tuple] = []
    for first in range(0, len(queries), BATCH_ROWS):
        batch = queries[first : first + BATCH_ROWS]
        # The matrix product finds the k-th smallest distance up to rounding; every vector within
        # that rounding is then measured exactly, so the choice does not depend on it.
        batch_squares = (batch**2).sum(axis=1)
        rough = batch_squares[:, None] - 2.0 * batch @ vectors.T + squares[None, :]
        slack = 1e-9 * (1.0 + batch_squares + squares.max())
        limit = np.partition(rough, kth, axis=1)[:, kth] + slack
        rows, cols = np.nonzero(rough <= limit[:, None])
        bounds = np.searchsorted(rows, np.arange(len(batch) + 1))
        for i, query in enumerate(batch):
            near = cols[bounds[i] : bounds[i + 1]]
            exact = ((vectors[near] - query) ** 2).sum(axis=1)
            near_ids = [ids[by_vector[starts[v] : min(starts[v + 1], starts[v] + k)]] for v in near]
            distance = np.repeat(exact, [len(x) for x in near_ids])
            flat = np.concatenate(near_ids)
            best = np.lexsort((flat, distance))[:k]
            found.append((np.repeat(query_ids[first + i], len(best)), flat[best], distance[best]))
    columns = [np.concatenate(part) for part in zip(*found)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "distance"), columns)))


PAIR_ARROW = "=>"
_OUTER_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def split_pairs(documents: DataFrame, content: str = "content") -> DataFrame:
    """'question => sql' texts split at the first arrow; texts without one are dropped."""
    at = F.locate(PAIR_ARROW, F.col(content))
    question = F.substring(F.col(content), F.lit(1), at - 1)
    sql = F.substr(F.col(content), at + len(PAIR_ARROW))
    others = [c for c in documents.columns if c != content]
    return documents.where(F.col(content).contains(PAIR_ARROW)).select(
        *others,
        F.regexp_replace(question, _OUTER_SPACE, "").alias("nl_query"),
        F.regexp_replace(sql, _OUTER_SPACE, "").alias("sql"),
    )


def _mentions(question: Column, table: str, info: Mapping) -> Column:
    """True if the table's name, description or a column name occurs in the lower-cased question."""
    terms = [table, *([info["description"]] if "description" in info else []), *info.get("columns", {})]
    return reduce(Column.__or__, [question.contains(t.lower()) for t in terms])


def _relevant_tables(question: Column, catalog: Mapping[str, Mapping]) -> Column:
    """Names of the tables a question mentions; all of them if it mentions none."""
    lowered = F.lower(question)
    asked = F.coalesce(F.length(question) > 0, F.lit(False))
    named = [F.when(asked & _mentions(lowered, t, info), F.lit(t)) for t, info in catalog.items()]
    hits = F.array_compact(F.array(*named))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(*[F.lit(t) for t in catalog]))


def match_tables(questions: DataFrame, catalog: Mapping[str, Mapping], question: str = "question") -> DataFrame:
    """One row per question and relevant table; a question matching none gets every table.

    The catalog is a driver-side dictionary of table contracts, so matching is a
    projection of the questions: no join and no pair of question and word.
    """
    return questions.select("*", F.explode(_relevant_tables(F.col(question), catalog)).alias("table_name"))

# Signs of the pieces that terms are found by.
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """All runs of ``size`` signs in a text, in one pass."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), 1)


def match_term_table(questions: DataFrame, terms: DataFrame, question: str = "question") -> DataFrame:
    """``match_tables`` for a catalog held as rows (table_name, term), of any number.

    The plan is the same for ten terms or a million. Each term is filed under
    that run of three signs in it that the fewest questions hold (a shorter term
    under itself); a question is compared only with the terms filed under its own
    runs, once per different text, and what is found is verified on the whole
    text. Runs and questions that own many rows are split. A question that is null, empty or
    mentions no term gets every table; an empty term is in every other question; rows without a
    table or a term match nothing, and without a table there are no rows. The
    terms found in one question, and the tables, have to fit one row.
    """
    named = terms.where(F.col("table_name").isNotNull())
    known = named.where(F.col("term").isNotNull()).groupBy(F.lower("term").alias("_term"))
    known = known.agg(F.collect_set("table_name").alias("_tables"))
    every = named.agg(F.sort_array(F.collect_set("table_name")).alias("every")).scalar()
    text = F.lower(question)
    marked = questions.withColumn("_text_id", F.when(F.length(text) > 0, F.md5(text)))
    texts = marked.where(F.col("_text_id").isNotNull()).select("_text_id", text.alias("_text")).dropDuplicates(["_text_id"])

    runs = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(F.col("_text"), n) for n in range(1, GRAM + 1)]))
    held = texts.select("_text_id", F.explode(runs).alias("_gram"))
    short = F.length("_term") < GRAM
    of_term = F.when(short, F.array("_term")).otherwise(F.array_distinct(_grams(F.col("_term"), GRAM)))
    offered = known.select("_term", "_tables", F.explode(of_term).alias("_gram"))
    common = held.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram")).alias("_by")
    filed = offered.join(common, "_gram", "left").groupBy("_term").agg(F.first("_tables").alias("_tables"), rarest)
    filed = cut_lineage(filed.select("_term", "_tables", "_by.*").where("_n > 0"))
    sizes = filed.select("_gram", "_n").distinct()
    share = F.col("_n") * parts_by_default(questions.sparkSession) / sizes.agg(F.sum("_n")).scalar()
    hot = sizes.where(share > 1).select("_gram", F.ceil(share).cast("int").alias("parts"))
    # What no term is filed under goes nowhere.
    held = held.join(sizes.select("_gram"), "_gram", "left_semi")
    met = dealt(held, "_gram", hot, ["_text_id"]).join(repeated(filed, "_gram", hot), ["_gram", "salt"])
    likely = met.groupBy("_text_id").agg(F.collect_list(F.struct("_term", "_tables")).alias("_likely"))
    true = F.filter("_likely", lambda t: F.contains(F.col("_text"), t["_term"]))
    found = F.array_distinct(F.flatten(F.transform(true, lambda t: t["_tables"])))
    matched = texts.join(likely, "_text_id").select("_text_id", found.alias("_found"))
    own = salted_join(marked, matched, "_text_id", questions.columns)
    tables = F.when(F.size("_found") > 0, F.col("_found")).otherwise(every)
    return own.select(*questions.columns, F.explode(tables).alias("table_name"))


def select_catalog(questions: DataFrame, schema: Mapping, question: str = "question") -> DataFrame:
    """Per question the definitions of its tables, and always all metrics and relationships.

    ``schema`` has "tables", "metrics" and "relationships"; definitions are JSON
    text. Like the matching, a projection without join or shuffle.
    """
    tables = schema["tables"]
    definitions = F.create_map(*[F.lit(x) for name, info in tables.items() for x in (name, _as_json(info))])
    chosen = F.transform(
        _relevant_tables(F.col(question), tables),
        lambda t: F.struct(F.lit("table").alias("kind"), t.alias("name"), definitions[t].alias("definition")),
    )
    fixed = [("metric", name, _as_json(info)) for name, info in schema.get("metrics", {}).items()]
    fixed += [("relationship", f"{r['from']} -> {r['to']}", _as_json(r)) for r in schema.get("relationships", [])]
    always = [F.struct(*[F.lit(x).alias(n) for x, n in zip(row, ("kind", "name", "definition"))]) for row in fixed]
    entries = F.concat(chosen, F.array(*always)) if always else chosen
    others = [c for c in questions.columns if c != question]
    return questions.select(*others, F.inline(entries))


def _as_json(info) -> str:
    return json.dumps(info, ensure_ascii=False, sort_keys=True)
