"""Data-quality rules as data: a name, a severity and a predicate that marks a violation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    broken: Column
    message: Column | None = None


def findings(df: DataFrame, rules: Sequence[Rule], key: str) -> DataFrame:
    """(key, rule, severity, message) of every violation, in one pass; a null predicate is none."""
    made = [
        F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), (r.message if r.message is not None else F.lit(r.name)).cast("string").alias("message")))
        for r in rules
    ]
    return df.select(F.col(key), F.inline(F.array_compact(F.array(*made))))


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows that break no rule, the others with the names they break)."""
    names = F.array_compact(F.array(*(F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.name)) for r in rules)))
    marked = df.withColumn("broken_rules", names)
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)


def overflow_list(values: Column, most: int) -> Column:
    """The first ``most`` entries joined with commas, then how many more there are."""
    return overflow_text(F.slice(values, 1, most), F.size(values), most)


def overflow_text(first: Column, count: Column, most: int) -> Column:
    """``first``, the first ``most`` of ``count`` entries, joined with commas, then how many more there are."""
    more, shown = count - most, F.concat_ws(", ", first)
    return F.when(more > 0, F.concat(shown, F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(shown)


def first_and_more(df: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, shown): the ``most`` least values of each key as a list, with the number of the others. A
    key's rows are ranked, not gathered: Spark keeps the first ranks of each task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(value))
    first = df.where(F.col(value).isNotNull()).select(key, value).withColumn("__rank", rank).where(F.col("__rank") <= most)
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__rank", F.col(value).cast("string").alias("v")))).alias("__first"))
    counts = df.groupBy(F.col(key).alias("__key")).agg(F.count(value).alias("__n"))
    shown = overflow_text(F.coalesce(F.col("__first")["v"], F.array().cast("array<string>")), F.col("__n"), most)
    return counts.join(lists, F.col("__key").eqNullSafe(F.col(key)), "left").select(F.col("__key").alias(key), shown.alias("shown"))
