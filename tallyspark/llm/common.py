"""Small pieces that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import discard, materialize, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts`` (null id: null)."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings_kept(spark: SparkSession) -> Iterator[None]:
    """Give back the session's batch size afterwards; what was made inside must have been written by then."""
    before = spark.conf.get(BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Bound the Arrow batches that Python workers get, so that long texts do not fill their memory."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_ROWS)) > rows:
        conf.set(BATCH_ROWS, str(rows))
    return df


def map_rows(df: DataFrame, id_column: str, columns: dict[str, Column], run, schema: str, rows: int = 1000) -> DataFrame:
    """``mapInPandas`` over ``id`` and ``columns``, yielding ``id`` and the columns of ``schema``.

    The id travels as text and gets its type back afterwards, so that null ids do not turn integer
    ids into floats.
    """
    kind = dict(df.dtypes)[id_column]
    source = small_batches(df.select(F.col(id_column).cast("string").alias("id"), *(c.alias(n) for n, c in columns.items())), rows)
    return source.mapInPandas(run, f"id string, {schema}").withColumn("id", F.col("id").cast(kind))


def slices(sizes: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to about ``budget`` (one item at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
