"""Streaming queries, run over the events that are there; each equals its batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyspark.plans.attendance import ATT
from tallyspark.session import shared_dir
from tallyspark.sources.tables import table
from tallyspark.streaming import gate as G


def _events(spark, sf_dir):
    return G.read_events(spark, f"{sf_dir}/events.parquet")


def stream_daily_upsert(spark, sf_dir):
    out = G.run_to_end(G.daily_stream(_events(spark, sf_dir)), "daily")
    return out.withColumn("day", F.col("day").cast("string"))


def stream_window_counts(spark, sf_dir):
    out = G.run_to_end(G.window_counts(_events(spark, sf_dir)), "windows")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 2).alias("value"))


def stream_sliding_counts(spark, sf_dir):
    out = G.run_to_end(G.sliding_counts(_events(spark, sf_dir)), "sliding")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def stream_session_counts(spark, sf_dir):
    out = G.run_to_end(G.session_counts(_events(spark, sf_dir)), "sessions")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


def stream_debounce(spark, sf_dir):
    out = G.run_to_end(G.debounce_stream(_events(spark, sf_dir)), "debounce", "append")
    return out.groupBy("employee_id").agg(F.count(F.lit(1)).alias("accepted"), F.sum("seq").alias("seq_sum"))


def _appended(spark, sf_dir, label, make):
    """Run a query whose sink appends below a scratch folder until its input is used up; the folder."""
    folder = f"{shared_dir(spark)}/tallyspark/{label}-{uuid.uuid4().hex}"

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = make(_events(spark, sf_dir), write, folder)
    query.processAllAvailable()
    query.stop()
    return folder


def stream_polled(spark, sf_dir):
    """Events that a query finds when it looks for new input at intervals."""
    folder = _appended(spark, sf_dir, "polled", lambda events, write, folder: G.poll(events, write, folder, 0.5))
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


def stream_book(spark, sf_dir):
    """The daily book that batches are merged into."""
    folder = _appended(spark, sf_dir, "book", lambda events, write, folder: G.poll(events, G.merge_into_book(f"{folder}/book"), folder, 0.5))
    return G.read_book(spark, f"{folder}/book").select("employee_id", F.col("day").cast("string").alias("day"), "in_time", "out_time")


def stream_two_sinks(spark, sf_dir):
    """A stream with a second sink that always fails: the first gets every event, and the failure is noted."""
    failures = []

    def broken(batch, number):
        raise OSError("no mirror")

    folder = _appended(spark, sf_dir, "sinks", lambda events, write, folder: G.poll(events, G.best_effort([write, broken], failures), folder, 0.5))
    rows = spark.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("mirrored", F.lit(not failures))


def stream_registry(spark, sf_dir):
    """Events joined with the registry as it is when their batch comes."""
    registry = lambda: table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("employee_id"), F.col("c_nationkey").alias("team"))

    def start(events, write, folder):
        return G.stream_static(events, registry, write).option("checkpointLocation", f"{folder}/state").start()

    folder = _appended(spark, sf_dir, "registry", start)
    return spark.read.parquet(f"{folder}/out").groupBy("team").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (stream_polled, stream_book, stream_two_sinks, stream_registry, stream_daily_upsert, stream_window_counts, stream_sliding_counts, stream_session_counts, stream_debounce)}
ORACLES = {
    "stream_polled": "SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS value FROM events GROUP BY 1",
    "stream_book": ATT + "SELECT employee_id, CAST(day AS VARCHAR) AS day, in_time, out_time FROM att",
    "stream_two_sinks": "SELECT user_id, COUNT(*) AS n, FALSE AS mirrored FROM events GROUP BY 1",
    "stream_registry": "SELECT c_nationkey AS team, COUNT(*) AS n FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY 1",
    "stream_daily_upsert": ATT + "SELECT employee_id, CAST(day AS VARCHAR) AS day, in_time, out_time FROM att",
    "stream_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS value FROM events GROUP BY 1, 2",
    "stream_sliding_counts": "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, COUNT(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOURS, ts), time_bucket(INTERVAL 12 HOURS, ts) - INTERVAL 12 HOURS]) AS s FROM events) GROUP BY 1",
    "stream_session_counts": """SELECT user_id, CAST(SUM(f) AS BIGINT) AS sessions, COUNT(*) AS n FROM (SELECT user_id, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 7200000000 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1""",
    "stream_debounce": """WITH RECURSIVE gate AS (SELECT user_id AS employee_id, event_id AS seq, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type IN ('view','purchase')),
        walk AS (SELECT employee_id, seq, rn, ts AS last_ts, TRUE AS ok FROM gate WHERE rn = 1
        UNION ALL SELECT g.employee_id, g.seq, g.rn, CASE WHEN epoch_us(g.ts) - epoch_us(w.last_ts) > 20000000 THEN g.ts ELSE w.last_ts END, epoch_us(g.ts) - epoch_us(w.last_ts) > 20000000
        FROM walk w JOIN gate g ON g.employee_id = w.employee_id AND g.rn = w.rn + 1)
        SELECT employee_id, COUNT(*) AS accepted, CAST(SUM(seq) AS BIGINT) AS seq_sum FROM walk WHERE ok GROUP BY employee_id""",
}
