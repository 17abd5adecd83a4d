"""Interval merging and one-dimensional clustering.

Neighbour rules (gap to the previous element, running end of intervals) are window functions over a
partition. Anchor rules, which compare with the first element of the open cluster, are not: they are found
by a fold over the sorted elements of an adjacency cluster. A key's elements are sorted in one place in
either case, so keys must be chosen so that one of them fits a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, keys: Sequence[str], low: str = "lo", high: str = "hi", gap: float = 0.0) -> DataFrame:
    """(keys, lo, hi, n) of the unions of intervals that overlap or lie at most ``gap`` apart.

    Intervals with a null bound are ignored.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(low), F.col(high))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.where(F.col(low).isNotNull() & F.col(high).isNotNull())
    reach = F.max(high).over(before)
    fresh = F.when(reach.isNull() | (F.col(low) > reach + gap), 1).otherwise(0)
    marked = rows.withColumn("__fresh", fresh).withColumn("__island", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min(low).alias(low), F.max(high).alias(high), F.count(F.lit(1)).alias("n")).drop("__island")


def intersect_intervals(a: DataFrame, b: DataFrame, keys: Sequence[str], low: str = "lo", high: str = "hi", least: float = 0.0) -> DataFrame:
    """(keys, lo, hi) where an interval of ``a`` and one of ``b`` share more than ``least``.

    Intervals meet in cells as wide as they are on average, so only those that share a cell are compared;
    a pair counts in the first cell that both reach.
    """
    sizes = a.unionByName(b, allowMissingColumns=True).agg(F.avg(F.col(high) - F.col(low))).first()[0]
    cell = float(sizes) if sizes and sizes > 0 else 1.0
    at = lambda c: F.floor(F.col(c) / cell)
    left = a.select(*keys, F.col(low), F.col(high), F.explode(F.sequence(at(low), at(high))).alias("__cell")).where(F.col(low) < F.col(high))
    other = b.where(F.col(low) < F.col(high)).select(*keys, F.col(low).alias("__lo"), F.col(high).alias("__hi"), F.explode(F.sequence(at(low), at(high))).alias("__cell"))
    both = left.join(other, [*keys, "__cell"]).where((F.col("__lo") < F.col(high)) & (F.col(low) < F.col("__hi")) & (F.col("__cell") == F.greatest(at(low), at("__lo"))))
    out = both.select(*keys, F.greatest(low, "__lo").alias(low), F.least(high, "__hi").alias(high))
    return out.where(F.col(high) - F.col(low) > least)


def subtract_intervals(a: DataFrame, b: DataFrame, keys: Sequence[str], low: str = "lo", high: str = "hi", least: float = 0.0) -> DataFrame:
    """(keys, lo, hi) of what the union of ``a`` has beyond the union of ``b``, pieces over ``least``."""
    edges = a.select(*keys, F.col(low).alias("at"), F.lit(1).alias("da"), F.lit(0).alias("db"))
    edges = edges.unionByName(a.select(*keys, F.col(high).alias("at"), F.lit(-1).alias("da"), F.lit(0).alias("db")))
    edges = edges.unionByName(b.select(*keys, F.col(low).alias("at"), F.lit(0).alias("da"), F.lit(1).alias("db")))
    edges = edges.unionByName(b.select(*keys, F.col(high).alias("at"), F.lit(0).alias("da"), F.lit(-1).alias("db")))
    steps = edges.groupBy(*keys, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = Window.partitionBy(*keys).orderBy("at")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    spans = steps.select(*keys, F.col("at").alias(low), F.lead("at").over(order).alias(high), F.sum("da").over(run).alias("__a"), F.sum("db").over(run).alias("__b"))
    pieces = spans.where((F.col("__a") > 0) & (F.col("__b") <= 0) & F.col(high).isNotNull()).select(*keys, low, high)
    return merge_intervals(pieces, keys, low, high).where(F.col(high) - F.col(low) > least).select(*keys, low, high)


def adjacency_clusters(df: DataFrame, keys: Sequence[str], value: str, gap: float, tie: Sequence[str] = (), name: str = "cluster") -> DataFrame:
    """``df`` with a cluster number from 1 on: a new one where the previous value is over ``gap`` away."""
    order = Window.partitionBy(*keys).orderBy(value, *tie)
    step = F.col(value) - F.lag(value).over(order)
    fresh = F.when(step.isNull() | (step > gap), 1).otherwise(0)
    return df.withColumn("__fresh", fresh).withColumn(name, F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def anchor_clusters(df: DataFrame, keys: Sequence[str], value: str, gap: float) -> DataFrame:
    """(keys, anchor, n): clusters whose members lie within ``gap`` of the cluster's first value."""
    # a value over ``gap`` from the one before it opens a cluster under either rule, so the fold only has to run
    # within adjacency clusters; its list grows by a cluster at a time, not by a value
    runs = adjacency_clusters(df.where(F.col(value).isNotNull()), keys, value, gap, name="__run")
    sets = runs.groupBy(*keys, "__run").agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("__v"))
    none = F.array().cast("array<struct<anchor:double,n:bigint>>")
    begin = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).cast("long").alias("n"), none.alias("done"))

    def closed(acc):
        return F.concat(acc["done"], F.array(F.struct(acc["anchor"].alias("anchor"), acc["n"].alias("n"))))

    def step(acc, v):
        opens = acc["anchor"].isNull() | (v - acc["anchor"] > gap)
        done = F.when(opens & (acc["n"] > 0), closed(acc)).otherwise(acc["done"])
        return F.struct(F.when(opens, v).otherwise(acc["anchor"]).alias("anchor"), F.when(opens, F.lit(1).cast("long")).otherwise(acc["n"] + 1).alias("n"), done.alias("done"))

    return sets.select(*keys, F.inline(F.aggregate("__v", begin, step, closed)))


def mode_with_ties(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, mode, n): the most frequent value, the smallest of equally frequent ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("mode")))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.mode").alias("mode"), (-F.col("b.less")).alias("n"))
