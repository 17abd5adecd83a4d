"""Budget caps, shortfalls and even distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.running import running_sum


def suffix_cap(df: DataFrame, keys: Sequence[str], seq: Sequence[str], weight: str, budget: str) -> DataFrame:
    """Rows that stay when rows are dropped from the front while the rest weighs over ``budget``: those
    whose own and later weights add up to no more. Weights must not be negative; ``seq`` is an order."""
    # the suffix sum is a running sum from the back
    summed = running_sum(df, keys, [F.desc(c) for c in seq], F.col(weight), "__rest")
    return summed.where(F.col("__rest") <= F.col(budget) + 1e-9).select(*df.columns)


def keep_outermost(df: DataFrame, keys: Sequence[str], score: Column, most: Column, tie: Sequence[str]) -> DataFrame:
    """The first max(1, most div 2) rows of each key by descending ``score``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), *tie))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= F.greatest(F.floor(most / 2), F.lit(1))).drop("__rank")


def expand_shortfall(df: DataFrame, wanted: str, have: str, most: int = 10_000) -> DataFrame:
    """One row per missing unit, numbered ``unit_no`` from 1; none where nothing is missing. More
    than ``most`` missing units of one row is an error rather than a cut."""
    gap = F.col(wanted) - F.col(have)
    checked = F.when(gap > most, F.raise_error(F.lit(f"shortfall over {most}")).cast("long")).otherwise(gap.cast("long"))
    return df.where(gap > 0).withColumn("unit_no", F.explode(F.sequence(F.lit(1).cast("long"), checked)))


def distribute(total: Column, parts: Column, index: Column) -> Column:
    """Units of part ``index`` (from 0) when ``total`` is dealt over ``parts``: the first get one more."""
    return F.floor(total / parts) + F.when(index < total % parts, 1).otherwise(0)
