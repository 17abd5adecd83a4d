"""Running sums, ranks and medians of few, very large keys.

A window over a key sorts all of its rows in one task. Here rows are dealt to ranges of (key, order), so a key
spreads over as many tasks as it has rows for; each range is summed up once, the sums of the ranges
before it are added, and a window runs inside a key's part of a range only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import materialize


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``, the sum of ``weight`` up to and with each row in ``order``, and ``name``_all, the
    key's whole sum. Null weights count nothing; rows that tie in ``order`` come in any order."""
    count = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weighed = df.withColumn("__w", weight)
    dealt = weighed.repartitionByRange(count, *map(F.col, keys), *order).withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, "running")  # so that every use sees one row in one range
    sums = dealt.groupBy(*(F.col(k).alias(f"__key_{k}") for k in keys), F.col("__part").alias("__of")).agg(F.coalesce(F.sum("__w"), F.lit(0)).alias("__sum"))
    by = Window.partitionBy(*(f"__key_{k}" for k in keys))
    before = F.sum("__sum").over(by.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumns({"__before": F.coalesce(before, F.lit(0)), f"{name}_all": F.sum("__sum").over(by)})
    same = F.col("__part") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("__inside", F.coalesce(F.sum("__w").over(inside), F.lit(0))).join(offsets, same)
    return out.select(*df.columns, (F.col("__inside") + F.col("__before")).alias(name), f"{name}_all")


def exact_medians(df: DataFrame, keys: Sequence[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """(keys, ``name``, n): the exact median of the non-null values of each key and their number, from the
    ranks of the middle rows: no task holds a key's values."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    ranked = running_sum(rows, keys, [F.col(value)], F.lit(1), "__rank", parts)
    n = F.col("__rank_all")
    middle = (F.col("__rank") == F.floor((n + 1) / 2)) | (F.col("__rank") == F.floor((n + 2) / 2))
    low, high = F.min(value), F.max(value)
    return ranked.where(middle).groupBy(*keys).agg((low + (high - low) * 0.5).alias(name), F.max(n).alias("n"))
