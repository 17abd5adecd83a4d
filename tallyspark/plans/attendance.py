"""Attendance queries over ``events``: a view is an arrival, a purchase a departure."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.operators import attendance as A
from tallyspark.sources.tables import table

NOW = datetime(2024, 1, 24, 9, 30)
NOW_SQL = "TIMESTAMP '2024-01-24 09:30:00'"
TODAY_SQL = f"CAST({NOW_SQL} + INTERVAL 330 MINUTE AS DATE)"

ATT = """WITH gate AS (SELECT user_id AS employee_id, event_id AS seq, ts, ts + INTERVAL 330 MINUTE AS b,
    CASE event_type WHEN 'view' THEN 'in' ELSE 'out' END AS mode FROM events WHERE event_type IN ('view','purchase')),
att AS (SELECT employee_id, CAST(b AS DATE) AS day,
    strftime(arg_min(b, seq) FILTER (WHERE mode = 'in'), '%H:%M:%S') AS in_time,
    strftime(arg_max(b, seq) FILTER (WHERE mode = 'out'), '%H:%M:%S') AS out_time
    FROM gate GROUP BY ALL),
stat AS (SELECT *, CASE WHEN in_time IS NOT NULL AND out_time IS NOT NULL THEN 'present'
    WHEN in_time IS NOT NULL AND day = {today} THEN 'currently-in'
    WHEN in_time IS NOT NULL THEN 'missing-checkout' ELSE 'missing-checkin' END AS status FROM att),
att_s AS (SELECT *, CASE status
    WHEN 'present' THEN epoch_ms(CAST(day || ' ' || out_time AS TIMESTAMP)) - epoch_ms(CAST(day || ' ' || in_time AS TIMESTAMP))
    WHEN 'currently-in' THEN epoch_ms({now}) - epoch_ms(CAST(day || ' ' || in_time AS TIMESTAMP) - INTERVAL 330 MINUTE)
    END AS duration_ms FROM stat)
""".format(today=TODAY_SQL, now=NOW_SQL)


def _rows(spark, sf_dir):
    return A.daily_rows(A.gate_events(table(spark, sf_dir, "events")))


def _status(spark, sf_dir):
    return A.with_status(_rows(spark, sf_dir), NOW)


def _shown(rows):
    return rows.withColumn("day", F.col("day").cast("string"))


def att_upsert(spark, sf_dir):
    return _shown(_rows(spark, sf_dir))


def att_status(spark, sf_dir):
    return _shown(_status(spark, sf_dir).select("employee_id", "day", "status"))


def att_duration(spark, sf_dir):
    return _shown(_status(spark, sf_dir).select("employee_id", "day", "duration_ms", (F.col("duration_ms") < 0).alias("overnight")))


def att_totals(spark, sf_dir):
    return A.totals(_status(spark, sf_dir)).orderBy(F.col("total_ms").desc(), "employee_id")


def att_week_total(spark, sf_dir):
    return A.totals(A.in_period(_status(spark, sf_dir), "this-week", NOW)).agg(F.coalesce(F.sum("total_ms"), F.lit(0)).cast("long").alias("total_ms"), F.count(F.lit(1)).alias("employees"))


def att_currently_in(spark, sf_dir):
    rows = _status(spark, sf_dir).where("status = 'currently-in'")
    return _shown(rows.select("employee_id", "day", "in_time", "duration_ms")).orderBy(F.col("duration_ms").desc(), "employee_id")


def _preset(name):
    def run(spark, sf_dir):
        return A.totals(A.in_period(_status(spark, sf_dir), name, NOW))

    return run


def att_personal(spark, sf_dir):
    rows = _status(spark, sf_dir).where("employee_id = 7")
    return _shown(rows.select("employee_id", "day", "status", F.coalesce("duration_ms", F.lit(0)).alias("ms"))).orderBy(F.col("day").desc())


def att_share_of_max(spark, sf_dir):
    out = A.share_of_max(A.totals(_status(spark, sf_dir)))
    return out.select("employee_id", "total_ms", F.round("bar_width", 4).alias("bar_width"))


def att_distinct(spark, sf_dir):
    return A.distinct_employees(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").withColumnRenamed("event_type", "first_type")


def att_debounce_20s(spark, sf_dir):
    return A.debounce(A.gate_events(table(spark, sf_dir, "events")), 20).groupBy("employee_id").agg(F.count(F.lit(1)).alias("accepted"), F.sum("seq").alias("seq_sum"))


def att_log_sorted(spark, sf_dir):
    rows = _shown(_status(spark, sf_dir).select("employee_id", "day", F.coalesce("duration_ms", F.lit(-1)).alias("sort_ms")))
    return rows.orderBy(F.col("sort_ms").desc(), "employee_id", "day")


def duration_format(spark, sf_dir):
    return _shown(_status(spark, sf_dir).where("duration_ms is not null").select("employee_id", "day", T.format_duration(F.col("duration_ms")).alias("label")))


def time_12h(spark, sf_dir):
    return _shown(_rows(spark, sf_dir).select("employee_id", "day", T.format_clock(F.col("in_time")).alias("in_label"), T.format_clock(F.col("out_time")).alias("out_label")))


TOTALS = """SELECT employee_id, CAST(COALESCE(SUM(duration_ms), 0) AS BIGINT) AS total_ms, COUNT(duration_ms) AS days_present,
    COUNT(*) FILTER (WHERE status = 'missing-checkout') AS missing_checkouts, COUNT(*) FILTER (WHERE status = 'missing-checkin') AS missing_checkins FROM att_s {where} GROUP BY employee_id"""
PERIODS = {
    "this-week": f"day BETWEEN date_trunc('week', {TODAY_SQL}) AND {TODAY_SQL}",
    "last-week": f"day BETWEEN date_trunc('week', {TODAY_SQL}) - INTERVAL 7 DAY AND date_trunc('week', {TODAY_SQL}) - INTERVAL 1 DAY",
    "this-month": f"day BETWEEN date_trunc('month', {TODAY_SQL}) AND {TODAY_SQL}",
    "last-30": f"day BETWEEN {TODAY_SQL} - INTERVAL 29 DAY AND {TODAY_SQL}",
}


def _clock_sql(c):
    h = f"CAST(substr({c}, 1, 2) AS INT)"
    return f"CASE WHEN {c} IS NULL THEN '—' ELSE (CASE WHEN {h} % 12 = 0 THEN 12 ELSE {h} % 12 END) || ':' || substr({c}, 4, 2) || (CASE WHEN {h} < 12 THEN ' AM' ELSE ' PM' END) END"


QUERIES = {
    "att_upsert": att_upsert,
    "att_status": att_status,
    "att_duration": att_duration,
    "att_totals": att_totals,
    "att_week_total": att_week_total,
    "att_currently_in": att_currently_in,
    "att_preset_week": _preset("this-week"),
    "att_preset_lastweek": _preset("last-week"),
    "att_preset_month": _preset("this-month"),
    "att_preset_last30": _preset("last-30"),
    "att_personal": att_personal,
    "att_share_of_max": att_share_of_max,
    "att_distinct": att_distinct,
    "att_debounce_20s": att_debounce_20s,
    "att_log_sorted": att_log_sorted,
    "duration_format": duration_format,
    "time_12h": time_12h,
}
ORACLES = {
    "att_upsert": ATT + "SELECT employee_id, CAST(day AS VARCHAR) AS day, in_time, out_time FROM att",
    "att_status": ATT + "SELECT employee_id, CAST(day AS VARCHAR) AS day, status FROM att_s",
    "att_duration": ATT + "SELECT employee_id, CAST(day AS VARCHAR) AS day, duration_ms, duration_ms < 0 AS overnight FROM att_s",
    "att_totals": ATT + TOTALS.format(where=""),
    "att_week_total": ATT + f"SELECT CAST(COALESCE(SUM(total_ms), 0) AS BIGINT) AS total_ms, COUNT(*) AS employees FROM ({TOTALS.format(where='WHERE ' + PERIODS['this-week'])})",
    "att_currently_in": ATT + "SELECT employee_id, CAST(day AS VARCHAR) AS day, in_time, duration_ms FROM att_s WHERE status = 'currently-in'",
    "att_preset_week": ATT + TOTALS.format(where="WHERE " + PERIODS["this-week"]),
    "att_preset_lastweek": ATT + TOTALS.format(where="WHERE " + PERIODS["last-week"]),
    "att_preset_month": ATT + TOTALS.format(where="WHERE " + PERIODS["this-month"]),
    "att_preset_last30": ATT + TOTALS.format(where="WHERE " + PERIODS["last-30"]),
    "att_personal": ATT + "SELECT employee_id, CAST(day AS VARCHAR) AS day, status, COALESCE(duration_ms, 0) AS ms FROM att_s WHERE employee_id = 7",
    "att_share_of_max": ATT + f"SELECT employee_id, total_ms, ROUND(GREATEST(2.0::DOUBLE, total_ms * 100.0::DOUBLE / GREATEST(MAX(total_ms) OVER (), 1)), 4) AS bar_width FROM ({TOTALS.format(where='')})",
    "att_distinct": "SELECT user_id, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id",
    "att_debounce_20s": """WITH RECURSIVE gate AS (SELECT user_id AS employee_id, event_id AS seq, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type IN ('view','purchase')),
        walk AS (SELECT employee_id, seq, rn, ts AS last_ts, TRUE AS ok FROM gate WHERE rn = 1
        UNION ALL SELECT g.employee_id, g.seq, g.rn, CASE WHEN epoch_us(g.ts) - epoch_us(w.last_ts) > 20000000 THEN g.ts ELSE w.last_ts END, epoch_us(g.ts) - epoch_us(w.last_ts) > 20000000
        FROM walk w JOIN gate g ON g.employee_id = w.employee_id AND g.rn = w.rn + 1)
        SELECT employee_id, COUNT(*) AS accepted, CAST(SUM(seq) AS BIGINT) AS seq_sum FROM walk WHERE ok GROUP BY employee_id""",
    "att_log_sorted": ATT + "SELECT employee_id, CAST(day AS VARCHAR) AS day, COALESCE(duration_ms, -1) AS sort_ms FROM att_s",
    "duration_format": ATT + """SELECT employee_id, CAST(day AS VARCHAR) AS day, CASE WHEN m // 60 > 0 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE (m % 60) || 'm' END AS label
        FROM (SELECT *, GREATEST(CAST(floor(duration_ms / 60000.0) AS BIGINT), 0) AS m FROM att_s WHERE duration_ms IS NOT NULL)""",
    "time_12h": ATT + f"SELECT employee_id, CAST(day AS VARCHAR) AS day, {_clock_sql('in_time')} AS in_label, {_clock_sql('out_time')} AS out_label FROM att",
}
