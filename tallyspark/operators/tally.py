"""Keyed tallies, their comparison with tolerance, and subtotals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.calc import near, percent
from tallyspark.operators.running import exact_medians
from tallyspark.session import materialize


def tally(df: DataFrame, key: str, sums: dict[str, Column], count: str | None = None) -> DataFrame:
    """Sums per non-null key, nulls as zero."""
    parts = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()]
    if count:
        parts.append(F.count(F.lit(1)).alias(count))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*parts)


def full_outer(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both tallies side by side for every key of either; what a side lacks is zero. Both sides are
    aggregated before, so the join moves one row per key."""
    values = [c for c in (*left.columns, *right.columns) if c != key]
    return left.join(right, key, "full").select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in values))


def compare(table: DataFrame, found: str, expected: str, absolute: float, relative: float = 0.0) -> DataFrame:
    """With ``ok`` (equal within tolerance), ``delta`` and ``status`` OK, SHORT or OVER by sign."""
    delta = F.col(found) - F.col(expected)
    ok = near(F.col(found), F.col(expected), absolute, relative)
    return table.withColumns({"delta": delta, "ok": ok, "status": status(delta, ok)})


def status(delta: Column, ok: Column | None = None) -> Column:
    out = F.when(delta < 0, "SHORT").when(delta > 0, "OVER").otherwise("OK")
    return out if ok is None else F.when(ok, "OK").otherwise(out)


def percent_label(found: Column, expected: Column) -> Column:
    """Whole percent, ``extra`` where nothing was expected, ``-`` where both are zero."""
    value = F.bround(percent(found, expected), 0).cast("long").cast("string")
    return F.when((expected == 0) & (found > 0), "extra").when(expected == 0, "-").otherwise(F.concat(value, F.lit("%")))


def report_status(printed: Column, computed: Column, absolute: float = 0.02, relative: float = 0.005) -> Column:
    return F.when(printed.isNull(), "MISSING_IN_REPORT").when(near(printed, computed, absolute, relative), "OK").otherwise("MISMATCH")


def grand_total(rows: DataFrame, summary: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the summary's grand row (null ``dia``) where there is one, else the rows' sum."""
    own = rows.groupBy(key).agg(F.sum(value).alias("__rows"))
    said = summary.where("dia is null").groupBy(key).agg(F.max(value).alias("__said"))
    return own.join(said, key, "left").select(key, F.coalesce("__said", "__rows").alias(value))


def rollup_totals(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], name: str = "TOTAL") -> DataFrame:
    """Sums per key and in total; a subtotal's key reads ``name``."""
    out = df.rollup(*keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(F.grouping(k).alias(f"__{k}") for k in keys))
    labels = [F.when(F.col(f"__{k}") == 1, name).otherwise(F.col(k).cast("string")).alias(k) for k in keys]
    return out.select(*labels, *sums)


def confidence_split(df: DataFrame, key: str, weight: Column, low: Column) -> DataFrame:
    """(key, low_wt, high_wt, total_wt): weight by whether the row's provenance is weak."""
    return df.groupBy(key).agg(
        F.coalesce(F.sum(F.when(low, weight)), F.lit(0.0)).alias("low_wt"),
        F.coalesce(F.sum(F.when(~low, weight)), F.lit(0.0)).alias("high_wt"),
        F.sum(weight).alias("total_wt"),
    )


def suspicious_matches(split: DataFrame, official: str, least: float = 96.0, most: float = 104.0, share: float = 0.5) -> DataFrame:
    """Rows that match the official weight closely although mostly of low confidence."""
    pct = percent(F.col("total_wt"), F.col(official))
    return split.where(pct.between(least, most) & (F.try_divide("low_wt", "total_wt") >= share))


def consensus_median(df: DataFrame, keys: Sequence[str], value: str, agree: float = 0.2) -> DataFrame:
    """(keys, consensus, n_agreeing): the exact median of the values within ``agree`` of the median,
    if at least two agree, else the median."""
    middle = materialize(exact_medians(df, keys, value, "__m").drop("n"), "medians")
    close = df.select(*keys, value).join(middle, list(keys)).where(F.abs(F.col(value) - F.col("__m")) <= agree * F.abs(F.col("__m")))
    agreed = exact_medians(close, keys, value, "__c").withColumnRenamed("n", "n_agreeing")
    out = middle.join(agreed, list(keys), "left").withColumn("n_agreeing", F.coalesce("n_agreeing", F.lit(0)))
    return out.select(*keys, F.when(F.col("n_agreeing") >= 2, F.col("__c")).otherwise(F.col("__m")).alias("consensus"), F.col("n_agreeing").cast("long").alias("n_agreeing"))


def census(df: DataFrame, sets: Sequence[Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """Counts for several groupings in one pass; (columns, grouping_id, n)."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns)).agg(F.grouping_id().cast("long").alias("grouping_id"), F.count(F.lit(1)).alias("n"))
