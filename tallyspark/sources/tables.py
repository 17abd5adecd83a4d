"""Readers and writers of tables, sheets, registries and listings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ATTENDANCE = "employee_id string, name string, date date, in_time string, out_time string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_sheet(raw: DataFrame) -> DataFrame:
    """Attendance rows of a sheet of strings: rows without an id go, empty times become null."""
    a, b, c, d, e = raw.columns[:5]
    blank = lambda x: F.nullif(F.col(x), F.lit(""))
    rows = raw.where(F.length(F.col(a)) > 0)
    return rows.select(F.col(a).alias("employee_id"), F.col(b).alias("name"), F.col(c).try_cast("date").alias("date"), blank(d).alias("in_time"), blank(e).alias("out_time"))


def read_sheet_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"c{i} string" for i in range(5))
    return scan_sheet(spark.read.schema(schema).option("header", True).csv(path))


def with_fallback(primary: Callable[[], DataFrame] | None, fallback: Callable[[], DataFrame]) -> DataFrame:
    """The primary source if it is configured, else the fallback; ``source`` says which."""
    if primary is not None:
        return primary().withColumn("source", F.lit("sheet"))
    return fallback().withColumn("source", F.lit("generated"))


def cached(spark: SparkSession, folder: str, build: Callable[[], DataFrame], now: float, seconds: float = 30.0) -> DataFrame:
    """The result of ``build``, kept below ``folder`` for ``seconds``: asked again within that time of ``now``, an
    epoch time, the newest kept result is read; later, or with none kept, it is built anew. A failing
    build falls back to the last result, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    kept = sorted(int(n[3:]) for n in names if n.startswith("at-"))
    if not kept or now * 1000 - kept[-1] >= seconds * 1000:
        try:
            built = int(now * 1000)
            build().write.mode("overwrite").parquet(f"{folder}/at-{built}")
            for old in kept[:-1]:  # the one before may still be read
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/at-{old}"), True)
            kept.append(built)
        except Exception:
            if not kept:
                raise
    return spark.read.parquet(f"{folder}/at-{kept[-1]}")


def generate_attendance(spark: SparkSession, today: str, people: Sequence[str], days: int = 14, absent: float = 0.12, still_in: float = 0.4, seed: int = 1) -> DataFrame:
    """Seeded attendance rows for the last ``days`` weekdays: in from 8 to 9, out from 17 to 19; a
    share is absent, and a share of today's have not left yet."""
    ids = spark.createDataFrame([(f"E{i + 1:03d}", n) for i, n in enumerate(people)], "employee_id string, name string")
    end = F.lit(today).cast("date")
    rows = ids.withColumn("date", F.explode(F.sequence(F.date_sub(end, days - 1), end))).where(F.dayofweek("date").between(2, 6))

    def roll(k: int):
        digest = F.md5(F.concat_ws("|", "employee_id", F.col("date").cast("string"), F.lit(seed), F.lit(k)).cast("binary"))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / (1 << 32)

    def clock(base: int, spread: int, k: int):
        seconds = F.floor(F.lit(base * 3600) + roll(k) * spread * 3600)
        return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"), (seconds % 60).cast("int"))

    out = F.when((F.col("date") == end) & (roll(4) < still_in), F.lit(None).cast("string")).otherwise(clock(17, 2, 3))
    return rows.where(roll(1) >= absent).select("employee_id", "name", "date", clock(8, 1, 2).alias("in_time"), out.alias("out_time"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(employee_id, name) of a JSON object of objects {id: {name}}."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,struct<name:string>>")
    return text.select(F.explode(entries).alias("employee_id", "entry")).select("employee_id", F.col("entry.name").alias("name"))


def write_registry(registry: DataFrame, path: str) -> None:
    """The registry as one JSON object with sorted keys."""
    entry = F.map_from_entries(F.array_sort(F.collect_list(F.struct("employee_id", F.struct("name").alias("entry")))))
    registry.agg(F.to_json(entry).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def resolve_names(found: DataFrame, registry: DataFrame, id_column: str = "employee_id") -> DataFrame:
    """Names of the registry; an unknown id names itself and is marked ``auto_registered``."""
    known = registry.select(F.col("employee_id").alias("__id"), F.col("name").alias("__name"))
    return found.join(known, F.col(id_column) == F.col("__id"), "left").select(*found.columns, F.coalesce("__name", id_column).alias("name"), F.col("__id").isNull().alias("auto_registered"))


def scan_images(spark: SparkSession, path: str, extensions: Sequence[str] = ("jpg", "jpeg", "png")) -> DataFrame:
    """(path, folder, mtime, length) of image files, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.substring_index("path", ".", -1))
    return files.where(kind.isin(*extensions)).select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("modificationTime").alias("mtime"), "length")


def photo_counts(registry: DataFrame, images: DataFrame) -> DataFrame:
    counts = images.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    return registry.join(counts, registry["employee_id"] == counts["folder"], "left").select("employee_id", "name", F.coalesce("n", F.lit(0)).alias("photo_count")).orderBy("employee_id")


def stale_entries(images: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached vectors that are still good, images to encode): good if path and mtime are equal."""
    hit = images.join(cache, ["path", "mtime"])
    return hit, images.join(cache.select("path", "mtime"), ["path", "mtime"], "left_anti")


def upsert_rows(current: DataFrame, gate_rows: DataFrame) -> DataFrame:
    """Daily rows merged into a book: in_time is only filled where blank, out_time is overwritten;
    ``changed`` says whether a row differs from the book's."""
    old = current.select("employee_id", "day", F.col("in_time").alias("__in"), F.col("out_time").alias("__out"))
    both = old.join(gate_rows, ["employee_id", "day"], "full")
    enter = F.coalesce(F.nullif("__in", F.lit("")), "in_time")
    leave = F.coalesce("out_time", F.nullif("__out", F.lit("")))
    changed = ~enter.eqNullSafe(F.nullif("__in", F.lit(""))) | ~leave.eqNullSafe(F.nullif("__out", F.lit("")))
    return both.select("employee_id", "day", enter.alias("in_time"), leave.alias("out_time"), changed.alias("changed"))


def rank_sources(files: DataFrame, stem: str, mtime: float, core: str) -> DataFrame:
    """Candidate files (path, stem, mtime) by rank: the exact stem, then longer shared core, then the
    nearer time, then names marked (S); rank counts from 1."""
    exact = (F.col("stem") != stem).cast("int")
    size = F.when(F.contains(F.col("stem"), F.lit(core)), F.length(F.lit(core))).otherwise(0)
    order = Window.orderBy(exact, F.desc("core_length"), "age", F.desc("marked"), "path")
    rows = files.withColumns({"core_length": size, "age": F.abs(F.col("mtime") - mtime), "marked": F.contains("stem", F.lit("(S)"))})
    return rows.where((exact == 0) | (size > 0)).withColumn("rank", F.row_number().over(order))


def sheet_sets(files: DataFrame) -> DataFrame:
    """(panel, revision, path) of ``PANEL(R<n>)`` names."""
    name = F.regexp_extract("path", r"([^/]+?)\.\w+$", 1)
    pattern = r"^(.*?)\s*\(R(\d*)\)$"
    return files.withColumn("__n", name).where(F.col("__n").rlike(pattern)).select(F.regexp_extract("__n", pattern, 1).alias("panel"), F.regexp_extract("__n", pattern, 2).try_cast("int").alias("revision"), "path")


def locate_documents(panels: DataFrame, files: DataFrame) -> DataFrame:
    """The document ``<PANEL>.pdf`` or ``<PANEL> .pdf`` of each panel; null if it has none."""
    name = F.trim(F.regexp_extract("path", r"([^/]+)\.pdf$", 1))
    docs = files.where(F.col("path").endswith(".pdf")).select(name.alias("__panel"), "path").groupBy("__panel").agg(F.min("path").alias("path"))
    return panels.join(docs, F.col("panel") == F.col("__panel"), "left").drop("__panel")


def unique_titles(df: DataFrame, base: str, seq: str, name: str = "sheet") -> DataFrame:
    """Worksheet names made unique: the second of a name gets ``_2`` and so on."""
    at = F.row_number().over(Window.partitionBy(base).orderBy(seq))
    return df.withColumn(name, F.when(at == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), at.cast("string"))))


def write_sheets(tables: DataFrame, path: str) -> None:
    """Rows (sheet, ...) as one CSV folder per sheet."""
    tables.write.mode("overwrite").option("header", True).partitionBy("sheet").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def new_files(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.join(before, "path", "left_anti")


def models_with_keys(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """Paths of JSON files that have every required top-level key."""
    text = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    missing = F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")))
    return text.where(F.size(missing) == 0).select("path")
