"""Pages reachable over links."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.skew import dealt, hot_keys, parts_by_default, repeated
from sitelens.runtime import cut_lineage


#: Rounds whose pages are kept apart before they are merged; merged ones are merged again by as many.
MERGED = 8


def link_closure(edges: DataFrame, start: Sequence | DataFrame, most: int | None = None) -> DataFrame:
    """All pages reachable from the start pages, each once with its link distance.

    Breadth first. Each round joins only the newest pages with the links and
    drops those already seen. What was seen stays where its hash puts it: every round's pages are
    checkpointed in that partitioning, and newly reached ones are brought to them, so a round
    shuffles its own pages alone. Rounds are merged by eights, so a page is moved
    again once in eight times as many rounds. A checkpoint replays no round before it, and a
    lost executor costs one round. The links of a page that
    owns very many are dealt over several parts; whether the newest pages are
    shuffled or sent whole is Spark's choice by their size.
    """
    spark = edges.sparkSession
    src_type = dict(edges.dtypes)["src"]
    distinct = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    hot = cut_lineage(hot_keys(distinct, "src", most or parts_by_default(spark)))
    links = cut_lineage(dealt(distinct, "src", hot, ["dst"]))
    if isinstance(start, DataFrame):
        first = start.select(F.col(start.columns[0]).alias("page")).distinct()
    else:
        first = spark.createDataFrame([(s,) for s in start], f"page {src_type}").distinct()
    frontier = _settled(first.withColumn("depth", F.lit(0)))
    seen, depth = [(1, frontier)], 0
    while not frontier.isEmpty():
        depth += 1
        sources = frontier.select(F.col("page").alias("src"))
        reached = links.join(repeated(sources, "src", hot), ["src", "salt"], "left_semi")
        fresh = unseen(reached.select(F.col("dst").alias("page")).distinct(), [df for _, df in seen])
        frontier = _settled(fresh.withColumn("depth", F.lit(depth)))
        seen = _merged([*seen, (1, frontier)])
    return reduce(DataFrame.unionByName, [df for _, df in seen])


def unseen(pages: DataFrame, seen: Sequence[DataFrame]) -> DataFrame:
    """``pages`` (one column, page) in none of ``seen``; with these settled only ``pages`` are shuffled."""
    return reduce(lambda left, df: left.join(df.select("page"), "page", "left_anti"), seen, pages)


def _settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the partitioning by page that joins ask for."""
    return cut_lineage(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page"))


def _merged(seen: list[tuple[int, DataFrame]]) -> list[tuple[int, DataFrame]]:
    """The same pages with every run of ``MERGED`` tables of equal weight as one."""
    last = [df for weight, df in seen[-MERGED:] if weight == seen[-1][0]]
    if len(last) < MERGED:
        return seen
    whole = _settled(reduce(DataFrame.unionByName, last))
    return _merged([*seen[:-MERGED], (seen[-1][0] * MERGED, whole)])
