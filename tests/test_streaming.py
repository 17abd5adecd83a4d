import shutil

from pyspark.sql import functions as F

from tallyspark.operators import attendance as A
from tallyspark.streaming import gate as G


def split_events(spark, sf_dir, folder, parts=3):
    """The events in several files, in arrival order, so that a stream takes several batches."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    bounds = events.agg(F.max("event_id")).first()[0] // parts + 1
    (folder / "in").mkdir()
    for i in range(parts):
        events.where((F.col("event_id") >= i * bounds) & (F.col("event_id") < (i + 1) * bounds)).coalesce(1).write.parquet(f"{folder}/tmp{i}")
        (part,) = (folder / f"tmp{i}").glob("part-*.parquet")
        shutil.copy(part, folder / "in" / f"{i}.parquet")
    return events


def test_book_equals_batch(spark, sf_dir, tmp_path):
    events = split_events(spark, sf_dir, tmp_path)
    seen, failures = [], []

    def mirror(batch, number):
        seen.append(number)
        if number == 1:
            raise ValueError("the mirror is down")

    sink = G.best_effort([G.merge_into_book(f"{tmp_path}/book"), mirror], failures)
    stream = G.read_events(spark, f"{tmp_path}/in")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert seen == [0, 1, 2] and len(failures) == 1 and "down" in failures[0]
    want = A.daily_rows(A.gate_events(events)).collect()
    got = spark.read.parquet(f"{tmp_path}/book/v2").collect()
    key = lambda rows: sorted((r.employee_id, str(r.day), r.in_time or "", r.out_time or "") for r in rows)
    assert key(got) == key(want)


def test_debounce_equals_batch_over_batches(spark, sf_dir, tmp_path):
    events = split_events(spark, sf_dir, tmp_path)
    out = G.run_to_end(G.debounce_stream(G.read_events(spark, f"{tmp_path}/in"), 90_000), "t", "append")
    want = A.debounce(A.gate_events(events), 90_000)
    assert sorted((r.employee_id, r.seq) for r in out.collect()) == sorted((r.employee_id, r.seq) for r in want.collect())


def test_registry_is_read_per_batch(spark, sf_dir, tmp_path):
    split_events(spark, sf_dir, tmp_path, 2)
    sizes, known = iter([1, 5]), []

    def registry():
        return spark.range(next(sizes)).select(F.col("id").alias("employee_id"), F.lit("x").alias("name"))

    def sink(batch, number):
        known.append(batch.where("name is not null").select("user_id").distinct().count())

    query = G.stream_static(G.read_events(spark, f"{tmp_path}/in"), registry, sink)
    query.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert len(known) == 2 and known[0] <= 1 and known[1] <= 5
