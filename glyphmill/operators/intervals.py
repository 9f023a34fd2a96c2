"""Containment between spans of positions, within a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bytes of a task's rows, as Spark estimates them by the columns it reads; packed, they are some 100,000 rows of numbers. Beyond so many tasks each gets more.
_DEAL_BYTES, _DEAL_MOST = 128 << 10, 4_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in tasks by their key, the more the larger the input is, so that what a task holds in memory doesn't grow with it: neither the size of files nor that of packed shuffle blocks says how many rows a task gets.

    What follows within groups of the key, aggregations and joins, needs no further shuffle.
    """
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, min(_DEAL_MOST, size // _DEAL_BYTES)), key)


def nesting(spans: DataFrame, key: str = "path") -> DataFrame:
    """``spans`` (key, ord, start_idx, end_idx) with ``nesting``: the number of spans that strictly contain each.

    The definition: a join on the key with the comparison as a residual condition. It takes any spans; quadratic in a group. Large tables come ``dealt``.
    """
    o = spans.select(F.col(key).alias("o_key"), F.col("start_idx").alias("o_s"), F.col("end_idx").alias("o_e"))
    inside = (
        (F.col(key) == F.col("o_key"))
        & (F.col("o_s") <= F.col("start_idx"))
        & (F.col("o_e") >= F.col("end_idx"))
        & ((F.col("o_s") < F.col("start_idx")) | (F.col("o_e") > F.col("end_idx")))
    )
    names = spans.columns
    return spans.join(o, inside, "left").groupBy(*names).agg(F.count("o_s").alias("nesting"))


def nesting_sweep(spans: DataFrame, key: str = "path") -> DataFrame:
    """As ``nesting``, for spans that are nested or apart but don't overlap, such as those of a syntax tree: n log n, and no self-join.

    Over starts and ends in the order of positions, the spans that are open are a running sum.
    """
    extents = spans.groupBy(key, "start_idx", "end_idx").agg(F.count("*").alias("m"))
    starts = extents.select(key, F.col("start_idx").alias("pos"), F.lit(1).alias("kind"), (-F.col("end_idx")).alias("tie"), "m", "start_idx", "end_idx")
    ends = extents.select(key, F.col("end_idx").alias("pos"), F.lit(0).alias("kind"), (-F.col("start_idx")).alias("tie"), (-F.col("m")).alias("m"), "start_idx", "end_idx")
    order = W.partitionBy(key).orderBy("pos", "kind", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = starts.union(ends).withColumn("open", F.sum("m").over(order)).where("kind = 1")
    depth = swept.select(key, "start_idx", "end_idx", (F.col("open") - F.col("m")).alias("nesting"))
    return spans.join(depth, [key, "start_idx", "end_idx"]).select(*spans.columns, "nesting")


def depth_at(points: DataFrame, spans: DataFrame, key: str = "path", at: str = "row") -> DataFrame:
    """``points`` with ``depth``: the number of spans whose rows, both ends included, hold ``at``.

    A running sum over starts, points and ends in the order of rows: n log n in a group, and no self-join.
    """
    names = points.columns
    here = points.select(F.struct(*names).alias("p_"), F.col(key).alias("k_"), F.col(at).cast("long").alias("at_"), F.lit(1).alias("kind_"), F.lit(0).alias("d_"))
    none = F.lit(None).cast(here.schema["p_"].dataType)
    real = spans.where("start_row <= end_row")
    starts = real.select(none, F.col(key), F.col("start_row").cast("long"), F.lit(0), F.lit(1))
    ends = real.select(none, F.col(key), F.col("end_row").cast("long"), F.lit(2), F.lit(-1))
    order = W.partitionBy("k_").orderBy("at_", "kind_").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = here.union(starts).union(ends).withColumn("depth", F.sum("d_").over(order)).where("p_ is not null")
    return swept.select(*[F.col("p_")[n].alias(n) for n in names], "depth")


def rows_covered(spans: DataFrame, key: str = "path") -> DataFrame:
    """The distinct (key, row) that any span covers."""
    return spans.select(key, F.explode(F.sequence("start_row", "end_row")).alias("row")).distinct()


def outermost(spans: DataFrame, key: str = "path") -> DataFrame:
    """The spans that no other strictly contains, except before its body: ``body_idx`` is where a function's body begins, else null."""
    o = spans.select(F.col(key).alias("o_key"), F.col("start_idx").alias("o_s"), F.col("end_idx").alias("o_e"), F.col("body_idx").alias("o_b"))
    nested = (
        (F.col(key) == F.col("o_key"))
        & (F.col("o_s") <= F.col("start_idx"))
        & (F.col("o_e") >= F.col("end_idx"))
        & ((F.col("o_s") < F.col("start_idx")) | (F.col("o_e") > F.col("end_idx")))
        & (F.col("o_b").isNull() | (F.col("start_idx") < F.col("o_b")))
    )
    return spans.join(o, nested, "left_anti")


def touched(ranges: DataFrame, points: DataFrame, key: str = "path", at: str = "line") -> DataFrame:
    """The ranges (start_line, end_line, both included) that hold a point.

    From the last line to the first, the point met last is the first one at or behind the start of a range: n log n in a group, and no join.
    """
    names = ranges.columns
    here = ranges.select(F.struct(*names).alias("r_"), F.col(key).alias("k_"), F.col("start_line").cast("long").alias("at_"), F.lit(0).alias("kind_"))
    none = F.lit(None).cast(here.schema["r_"].dataType)
    there = points.select(none.alias("r_"), F.col(key).alias("k_"), F.col(at).cast("long").alias("at_"), F.lit(1).alias("kind_"))
    order = W.partitionBy("k_").orderBy(F.desc("at_"), F.desc("kind_")).rowsBetween(W.unboundedPreceding, W.currentRow)
    point = F.when(F.col("kind_") == 1, F.col("at_"))
    swept = here.union(there).withColumn("next_", F.last(point, ignorenulls=True).over(order)).where("r_ is not null and next_ <= r_.end_line")
    return swept.select(*[F.col("r_")[n].alias(n) for n in names])
