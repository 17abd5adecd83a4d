"""Session builder and the shared scratch space that survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyspark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with UTC time, AQE, and shuffle partitions near the core count."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or else the context's checkpoint
    folder. Only where a local session leaves both unset, as in tests on one machine, is a temporary folder
    made and set; a cluster without one is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="tallyspark-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = "file://" + made
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files. Otherwise those stay until the driver's JVM happens to collect
    the plan, and add to what the next step shuffles."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


# The tables that this process has made and not yet deleted.
_MADE: list[str] = []


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage ends at files
    that every executor can reread, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyspark/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyspark_path = path  # noqa: SLF001
    return out


@contextmanager
def scratch_cleared(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, on leaving, the tables that :func:`materialize` made inside, but for those handed to the function
    that it yields. What is still to be read afterwards must be handed over or be read from such a table."""
    start, kept = len(_MADE), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._tallyspark_path)  # noqa: SLF001
        return df

    try:
        yield keep
    finally:
        made, _MADE[start:] = _MADE[start:], []
        for path in made:
            if path in kept:
                _MADE.append(path)
            else:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that :func:`materialize` left below the shared folder. Results that are still
    to be read go with them, so this is for the end of a job."""
    _MADE.clear()
    _delete(spark, f"{shared_dir(spark)}/tallyspark")


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` once nothing reads it any more."""
    path = getattr(df, "_tallyspark_path", None)
    if path:
        _delete(df.sparkSession, path)
