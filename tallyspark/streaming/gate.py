"""Structured Streaming twins of the attendance operators.

Event time needs TIMESTAMP, while Parquet's zone-less timestamps load as TIMESTAMP_NTZ, which
watermarks reject: sources are cast first, with the session zone UTC. Every stream here gives the
same rows as its batch twin once the input is exhausted; the tests hold them to that.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.functions.calc import BUSINESS_MINUTES
from tallyspark.operators.attendance import daily_rows, gate_events
from tallyspark.session import shared_dir
from tallyspark.sources.tables import upsert_rows


def read_events(spark: SparkSession, path: str, schema=None, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files (Parquet), ``ts`` as TIMESTAMP."""
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        stream = reader.parquet(path)
    else:  # the file source watches folders: the one that holds the file, for that file only
        stream = reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_stream(events: DataFrame, minutes: int = BUSINESS_MINUTES, late: str = "1 day") -> DataFrame:
    """First-in, last-out per employee and business day as a windowed aggregate in arrival order."""
    gate = gate_events(events).withColumn("local", F.col("ts") + F.make_dt_interval(mins=F.lit(minutes)))
    clock = F.date_format("local", "HH:mm:ss")
    marked = gate.withWatermark("local", late).groupBy("employee_id", F.window("local", "1 day").alias("w"))
    out = marked.agg(
        F.min(F.when(F.col("mode") == "in", F.struct("seq", clock.alias("clock")))).alias("i"),
        F.max(F.when(F.col("mode") == "out", F.struct("seq", clock.alias("clock")))).alias("o"),
    )
    return out.select("employee_id", F.col("w.start").cast("date").alias("day"), F.col("i.clock").alias("in_time"), F.col("o.clock").alias("out_time"))


def window_counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sliding_counts(events: DataFrame, size: str = "1 day", slide: str = "12 hours", late: str = "1 day") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "n")


def session_counts(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def debounce_stream(events: DataFrame, seconds: float = 20.0) -> DataFrame:
    """Accepted gate events (employee_id, seq, ts): state per employee is the last accepted instant."""
    gate = gate_events(events).withColumn("at", F.unix_micros("ts")).select("employee_id", "seq", "at")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        # a trigger's rows of a key may come in several batches: its events are taken in arrival order
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if last is None or r.at - last > seconds * 1e6:
                last = int(r.at)
                kept.append((key[0], r.seq, last))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=["employee_id", "seq", "at"])

    out = gate.groupBy("employee_id").applyInPandasWithState(step, "employee_id long, seq long, at long", "last long", "append", GroupStateTimeout.NoTimeout)
    return out.select("employee_id", "seq", F.timestamp_micros("at").alias("ts"))


def merge_into_book(path: str, minutes: int = BUSINESS_MINUTES) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that merges daily rows into the book at ``path``.

    Each batch writes a new version next to the last and a repeated batch writes the same one again,
    so a restarted batch neither loses nor doubles rows; one query writes a book.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = daily_rows(gate_events(batch), minutes)
        old = None
        if number:
            old = spark.read.parquet(f"{path}/v{number - 1}")
        book = upsert_rows(old, rows).drop("changed") if old is not None else rows
        book.write.mode("overwrite").parquet(f"{path}/v{number}")
        # the last version may be needed if this batch is repeated; those before it are not
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return sink


def read_book(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the book at ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return spark.read.parquet(f"{path}/v{max(int(n[1:]) for n in names if n[0] == 'v')}")


def poll(stream: DataFrame, sink: Callable[[DataFrame, int], None], folder: str, seconds: float = 45.0) -> StreamingQuery:
    """A running query that looks for new input every ``seconds`` and hands each batch to ``sink``; its
    state is below ``folder``, so a query started again goes on where the last one ended."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(processingTime=f"{seconds} seconds").start()


def best_effort(sinks: list[Callable[[DataFrame, int], None]], failures: list[str]) -> Callable[[DataFrame, int], None]:
    """One ``foreachBatch`` function of several sinks: the first must succeed, an error of any other
    is noted in ``failures`` and does not stop the stream."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            sinks[0](batch, number)
            for sink in sinks[1:]:
                try:
                    sink(batch, number)
                except Exception as e:  # noqa: BLE001
                    failures.append(f"batch {number}: {e!r}"[:200])
        finally:
            batch.unpersist()

    return run


def stream_static(events: DataFrame, registry: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None]):
    """A writer that joins each batch with the registry as it is then."""

    def run(batch: DataFrame, number: int) -> None:
        sink(batch.join(registry(), batch["user_id"] == F.col("employee_id"), "left"), number)

    return events.writeStream.foreachBatch(run)


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what its source has now, into a Parquet table, and return that table.

    Complete mode keeps the last version of the result. The sink and the checkpoint are below the
    shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/tallyspark/stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
