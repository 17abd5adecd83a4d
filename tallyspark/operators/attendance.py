"""In/out events to daily rows, status, durations and totals. ``now`` is always an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.calc import BUSINESS_MINUTES, business_day, business_time, date_preset, to_instant


def gate_events(events: DataFrame, in_type: str = "view", out_type: str = "purchase") -> DataFrame:
    """(employee_id, mode, ts, seq) of an event table, whose ``event_id`` is the arrival order."""
    mode = F.when(F.col("event_type") == in_type, "in").when(F.col("event_type") == out_type, "out")
    return events.select(F.col("user_id").alias("employee_id"), mode.alias("mode"), "ts", F.col("event_id").alias("seq")).where("mode is not null")


def daily_rows(gate: DataFrame, minutes: int = BUSINESS_MINUTES) -> DataFrame:
    """(employee_id, day, in_time, out_time): the first arrival fills in, the last one out.

    Arrival order is ``seq``, not time. Times are ``HH:MM:SS`` of the business zone, null if missing.
    """
    clock = F.date_format(business_time(F.col("ts"), minutes), "HH:mm:ss")
    rows = gate.select("employee_id", business_day(F.col("ts"), minutes).alias("day"), "mode", clock.alias("clock"), "seq")
    first = F.min(F.when(F.col("mode") == "in", F.struct("seq", "clock")))
    last = F.max(F.when(F.col("mode") == "out", F.struct("seq", "clock")))
    return rows.groupBy("employee_id", "day").agg(first.alias("i"), last.alias("o")).select("employee_id", "day", F.col("i.clock").alias("in_time"), F.col("o.clock").alias("out_time"))


def _blank(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def with_status(rows: DataFrame, now: datetime, minutes: int = BUSINESS_MINUTES) -> DataFrame:
    """``rows`` with ``status`` and ``duration_ms``; empty times count as missing.

    Present: in and out, out - in, negative where out is earlier. Currently in: in only, today, now -
    in. Else the missing side is named and the duration is null.
    """
    at = F.lit(now.replace(tzinfo=None)).cast("timestamp_ntz")
    today = business_day(at, minutes)
    enter, leave = _blank("in_time"), _blank("out_time")
    status = (
        F.when(enter.isNotNull() & leave.isNotNull(), "present")
        .when(enter.isNotNull() & (F.col("day") == today), "currently-in")
        .when(enter.isNotNull(), "missing-checkout")
        .otherwise("missing-checkin")
    )

    def millis(instant: Column) -> Column:
        return F.unix_millis(instant.cast("timestamp"))

    begin, end = millis(to_instant(F.col("day"), enter, minutes)), millis(to_instant(F.col("day"), leave, minutes))
    span = F.when(status == "present", end - begin).when(status == "currently-in", millis(at) - begin)
    return rows.withColumns({"status": status, "duration_ms": span})


def in_period(rows: DataFrame, preset: str, now: datetime, minutes: int = BUSINESS_MINUTES) -> DataFrame:
    low, high = date_preset(preset, business_day(F.lit(now.replace(tzinfo=None)).cast("timestamp_ntz"), minutes))
    return rows.where(F.col("day").between(low, high))


def totals(rows: DataFrame) -> DataFrame:
    """Per employee: total_ms, days_present (rows with a duration, so currently-in ones count),
    missing_checkouts, missing_checkins."""
    return rows.groupBy("employee_id").agg(
        F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("total_ms"),
        F.count("duration_ms").alias("days_present"),
        F.count(F.when(F.col("status") == "missing-checkout", 1)).alias("missing_checkouts"),
        F.count(F.when(F.col("status") == "missing-checkin", 1)).alias("missing_checkins"),
    )


def share_of_max(table: DataFrame, value: str = "total_ms") -> DataFrame:
    """With ``bar_width``: percent of the largest value (at least 1), not under 2."""
    top = F.greatest(table.agg(F.max(value)).scalar(), F.lit(1))
    return table.withColumn("bar_width", F.greatest(F.lit(2.0), F.col(value) * 100.0 / top))


def debounce(gate: DataFrame, seconds: float = 20.0) -> DataFrame:
    """(employee_id, seq, ts) of the accepted events: the first, then each over ``seconds`` after the
    last accepted one, in arrival order.

    An event more than ``seconds`` after every earlier one is accepted whatever came before, so it
    starts an island; only within an island, a burst, is the rule a fold."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("employee_id").orderBy("seq")
    reach = F.max("at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("at") - reach > seconds * 1e6), 1).otherwise(0)
    marked = gate.select("employee_id", "seq", "ts", at.alias("at")).withColumn("fresh", fresh)
    marked = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    folded = marked.groupBy("employee_id", "island").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "ts"))).alias("e"))
    element = "array<struct<seq:bigint,at:bigint,ts:timestamp_ntz>>"

    def step(kept, x):
        last = F.try_element_at(kept, F.lit(-1))
        return F.when(last.isNull() | (x["at"] - last["at"] > seconds * 1e6), F.concat(kept, F.array(x))).otherwise(kept)

    accepted = F.aggregate(F.col("e").cast(element), F.array().cast(element), step)
    return folded.select("employee_id", F.inline(accepted)).select("employee_id", "seq", "ts")


def distinct_employees(rows: DataFrame, id_column: str, name_column: str, seq: str) -> DataFrame:
    """(id, name) with the name of the first row of each id."""
    return rows.groupBy(id_column).agg(F.min(F.struct(seq, name_column)).alias("f")).select(id_column, F.col(f"f.{name_column}").alias(name_column))
