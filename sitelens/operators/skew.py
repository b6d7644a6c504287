"""Joins, numbering and text joining that stay balanced under a hot key.

A bot can own a third of all hits. A window or join on its visitor or session
id would then put a third of the data into one task. The operators here split
such a key and still return exactly what the plain window or join returns.

Windows over a hot key are computed as a scan: its rows are cut into runs that
follow each other in order, each run is a window of its own, and what a run
hands on (a count, a last value) is carried over from the runs before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key is hot when it owns more than 1/HOT_KEYS of the rows, so there are
# fewer than HOT_KEYS hot keys whatever the data is: that bounds the broadcast.
HOT_KEYS = 1000


def hot_keys(facts: DataFrame, key: str, most: int = HOT_KEYS) -> DataFrame:
    """The keys (NULL among them) owning more than 1/most of the rows; always fewer than ``most``.

    ``parts`` says into how many parts of at most 1/most of the rows a key divides;
    over all keys these are fewer than 2 x ``most``.
    """
    sizes = facts.groupBy(key).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total")).scalar()
    share = F.col("_n") * most
    return sizes.where(share > total).select(key, F.ceil(share / total).cast("int").alias("parts"))


def _marked(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Add ``_parts``, NULL on rows of ordinary keys.

    Null-safe, so that no filter on the key is inferred: the facts counted for
    the hot keys keep the same plan as the facts joined, and Spark shares their shuffle.
    """
    marks = F.broadcast(hot.select(F.col(key).alias("_hot_key"), F.col("parts").alias("_parts")))
    return df.join(marks, F.col(key).eqNullSafe(F.col("_hot_key")), "left").drop("_hot_key")


def dealt(df: DataFrame, key: str, hot: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Add ``salt``: the part of its key each row goes to, by a hash of the ``spread`` columns.

    Those columns are a row's identity, so the part is the same on every retry of a task.
    """
    part = F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")
    return _marked(df, key, hot).withColumn("salt", part).drop("_parts")


def repeated(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Add ``salt``: rows of hot keys once per part of the key, all others once."""
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return _marked(df, key, hot).withColumn("salt", every).drop("_parts")


def parts_by_default(spark: SparkSession) -> int:
    """No part of a key shall be larger than 1/1000 of the rows or an average shuffle partition."""
    return max(HOT_KEYS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salted_join(
    facts: DataFrame, dims: DataFrame, key: str, spread: Sequence[str], most: int | None = None
) -> DataFrame:
    """Left join ``facts`` to ``dims`` (unique per key) with hot keys split.

    Rows of a hot key are dealt over its parts and only the dim rows of hot keys
    are repeated, once per part. NULL keys match nothing and are dealt the same way.
    """
    hot = hot_keys(facts, key, most or parts_by_default(facts.sparkSession))
    extra = [c for c in dims.columns if c != key]
    joined = dealt(facts, key, hot, spread).join(repeated(dims, key, hot), [key, "salt"], "left")
    return joined.select(*facts.columns, *extra)


def flag_members(
    facts: DataFrame, key: str, members: DataFrame, name: str, spread: Sequence[str], most: int | None = None
) -> DataFrame:
    """Add ``name`` = 1 where ``key`` occurs in the one-column ``members``, else 0."""
    column = members.columns[0]
    known = members.select(F.col(column).alias(key)).where(F.col(key).isNotNull()).distinct()
    joined = salted_join(facts, known.withColumn("_member", F.lit(1)), key, spread, most)
    return joined.withColumn(name, F.coalesce("_member", F.lit(0))).drop("_member")


#: A key with fewer rows is ordered by one task in less time than cutting it takes.
LEAST_RUN = 20_000
#: Rows drawn per run to find where it begins.
DRAWN = 64


@dataclass(frozen=True)
class Runs:
    """Rows and the columns ``by`` that a window has to be partitioned by.

    ``cut`` tells whether any key was cut. If so, rows have ``_key`` (the key as
    one struct, in which NULLs compare equal), ``_run`` (0 for a whole key) and
    ``_is_cut``, and ``by`` is (_key, _run); else rows and key are as given.
    """

    rows: DataFrame
    by: tuple[str, ...]
    cut: bool

    def handed_on(self, *aggregates: Column) -> DataFrame:
        """One row per run of the keys that were cut: fewer than twice the number of runs wanted."""
        return self.rows.where("_is_cut").groupBy("_key", "_run").agg(*aggregates)

    def with_handed_on(self, df: DataFrame, carried: DataFrame) -> DataFrame:
        """``df`` with the columns of ``carried`` (NULL for keys that were not cut)."""
        named = F.broadcast(carried.withColumnsRenamed({"_key": "_from_key", "_run": "_from_run"}))
        same = F.col("_key").eqNullSafe(F.col("_from_key")) & (F.col("_run") == F.col("_from_run"))
        return df.join(named, same, "left")


def in_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], most: int | None = None, least: int = LEAST_RUN
) -> Runs:
    """Cut every key that owns more than 1/most of all rows, and more than ``least``, into runs of consecutive rows.

    The columns ``order`` tell rows of a key apart (the last one is an id). Where runs begin is
    learnt from a sample drawn by a hash of those columns, so a run has about 1/most of
    the rows, and a row falls into the same run whenever it is computed again. Fewer than
    ``most`` keys are cut, into fewer than 2 x ``most`` runs: these borders are all that the driver
    sees. Without such a key nothing is added and a plain window does the work.
    """
    most = most or parts_by_default(df.sparkSession)
    keyed = df.select("*", F.struct(*keys).alias("_key"))
    sizes = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    limit = F.greatest(F.sum("_n") / most, F.lit(least))
    total = sizes.agg(limit.alias("_limit")).scalar()
    hot = sizes.where(F.col("_n") > total).select("_key", "_n", F.ceil(F.col("_n") / total).cast("int").alias("_parts"))
    hot = _bounded(hot)
    if hot is None:
        return Runs(df, tuple(keys), False)
    moment = F.struct(*order)
    near = hot.withColumnRenamed("_key", "_hot_key")
    drawn = (
        keyed.join(near, F.col("_key").eqNullSafe(F.col("_hot_key")))
        .where(F.pmod(F.xxhash64(*order), F.col("_n")) < DRAWN * F.col("_parts"))
        .groupBy("_hot_key", "_parts")
        .agg(F.sort_array(F.collect_list(moment)).alias("_drawn"))
    )
    border = F.transform(
        F.sequence(F.lit(1), F.col("_parts") - 1),
        lambda i: F.get("_drawn", F.floor(i * F.size("_drawn") / F.col("_parts")).cast("int")),
    )
    borders = _bounded(drawn.select("_hot_key", F.array_distinct(border).alias("_borders")))
    if borders is None:
        return Runs(df, tuple(keys), False)
    marked = keyed.join(borders, F.col("_key").eqNullSafe(F.col("_hot_key")), "left")
    cut = F.col("_borders").isNotNull()
    run = F.when(cut, borders_up_to(F.col("_borders"), moment, most)).otherwise(0)
    return Runs(marked.select(*df.columns, "_key", run.alias("_run"), cut.alias("_is_cut")), ("_key", "_run"), True)


def _bounded(df: DataFrame) -> DataFrame | None:
    """A table whose rows are known to be few, read once and sent along with the plan; None if it is empty."""
    found = df.collect()
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema)) if found else None


def borders_up_to(borders: Column, value: Column, most: int) -> Column:
    """How many of the sorted ``borders`` are not above ``value``, by halving."""
    steps = F.lit([1 << i for i in reversed(range(most.bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(borders, at + step - 1) <= value, at + step).otherwise(at)
    )


def _earlier(aggregate: Column) -> Column:
    """The sum over the runs of the same key before this one."""
    before = Window.partitionBy("_key").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(aggregate).over(before), F.lit(0))


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    name: str,
    most: int | None = None,
    least: int = LEAST_RUN,
) -> DataFrame:
    """``row_number`` per ``keys`` ordered by ``ts`` (no time first) and then ``order``."""
    runs = in_runs(df, keys, [ts, *order], most, least)
    number = F.row_number().over(Window.partitionBy(*runs.by).orderBy(ts, *order)).cast("bigint")
    if not runs.cut:
        return df.withColumn(name, number)
    counts = runs.handed_on(F.count("*").alias("_n")).select("_key", "_run", _earlier(F.col("_n")).alias("_before"))
    local = runs.with_handed_on(runs.rows.withColumn("_local", number), counts)
    return local.select(*df.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias(name))


def tally(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    condition: Column,
    seen: str,
    total: str,
    most: int | None = None,
    least: int = LEAST_RUN,
) -> DataFrame:
    """Rows meeting ``condition`` per ``keys``: up to and with this row (``seen``), and in all (``total``)."""
    runs = in_runs(df, keys, [ts, *order], most, least)
    one = F.when(condition, 1)
    whole = Window.partitionBy(*runs.by)
    so_far = F.count(one).over(whole.orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0))
    counted = runs.rows.withColumns({seen: so_far, total: F.count(one).over(whole)})
    if not runs.cut:
        return counted
    key = Window.partitionBy("_key")
    counts = runs.handed_on(F.count(one).alias("_n")).select(
        "_key", "_run", _earlier(F.col("_n")).alias("_before"), F.sum("_n").over(key).alias("_all")
    )
    return runs.with_handed_on(counted, counts).select(
        *df.columns,
        (F.col(seen) + F.coalesce("_before", F.lit(0))).alias(seen),
        F.coalesce("_all", total).alias(total),
    )


def preceding(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    value: str,
    name: str,
    most: int | None = None,
    least: int = LEAST_RUN,
) -> DataFrame:
    """``lag(value)`` per ``keys`` ordered by ``ts`` (no time first) and then ``order``.

    The first row of a run takes the last value of the run before; values travel
    inside a struct so that a NULL on the preceding row stays a NULL.
    """
    runs = in_runs(df, keys, [ts, *order], most, least)
    inside = Window.partitionBy(*runs.by).orderBy(ts, *order)
    if not runs.cut:
        return df.withColumn(name, F.lag(value).over(inside))
    boxed = F.struct(F.col(value).alias("v"))
    along = Window.partitionBy("_key").orderBy("_run")
    last = runs.handed_on(F.max_by(boxed, F.struct(ts, *order)).alias("_last")).select(
        "_key", "_run", F.lag("_last").over(along).alias("_carried")
    )
    local = runs.with_handed_on(runs.rows.withColumn("_local", F.lag(boxed).over(inside)), last)
    return local.select(*df.columns, F.coalesce("_local", "_carried")["v"].alias(name))


def joined_text(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    text: str,
    separator: str,
    name: str,
    most: int | None = None,
    least: int = LEAST_RUN,
) -> DataFrame:
    """One row per ``keys`` with its texts joined in time order, NULLs skipped.

    Runs are joined first, so the ordering work of a hot key is spread; the
    joined text itself is one value and has to fit one row.
    """
    runs = in_runs(df.select(*dict.fromkeys([*keys, ts, *order, text])), keys, [ts, *order], most, least)
    ordering = ", ".join([ts, *order])
    joined = F.expr(f"listagg({text}, '{separator}') within group (order by {ordering})")
    if not runs.cut:
        return runs.rows.groupBy(*keys).agg(joined.alias(name))
    pieces = runs.rows.groupBy(*keys, "_run").agg(joined.alias("_piece"))
    return pieces.groupBy(*keys).agg(
        F.expr(f"listagg(_piece, '{separator}') within group (order by _run)").alias(name)
    )
