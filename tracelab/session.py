"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str = "tracelab", cpus: int | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can read, as named by spark.checkpoint.dir.

    Only a local session may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tracelab-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writes = threading.Lock(), Counter()  # open writes by session
_passing = threading.local()  # .paths: what this thread has stored since `passing` began


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of writes begun inside go when the write ends.

    Otherwise they stay until the driver happens to collect its garbage, so that all shuffles of a long job add up on
    disk. What another thread starts meanwhile loses its files too, once it has ended; Spark makes them anew if asked.
    """
    key = spark._jsparkSession.hashCode()
    with _lock:
        _writes[key] += 1
        if _writes[key] == 1:
            _writes[key, "was"] = spark.conf.get(_CLEANUP, "false") == "true"
            spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _writes[key] -= 1
            if not _writes[key] and not _writes[key, "was"]:
                spark.conf.set(_CLEANUP, "false")


def durable(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    The result has no lineage, survives the loss of executors, keeps the values of
    non-deterministic columns, and still allows column pruning.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if (paths := getattr(_passing, "paths", None)) is not None:
        paths.append(path)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def forget(*stored: DataFrame) -> None:
    """Delete tables that `durable` has returned, when all that is made of them is stored itself."""
    for df in stored:
        _delete(df.sparkSession, df._stored_at)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stores inside by `durable` are deleted at the end; what is to stay is written elsewhere."""
    before, _passing.paths = getattr(_passing, "paths", None), []
    try:
        yield
    finally:
        for path in _passing.paths:
            _delete(spark, path)
        _passing.paths = before


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name in whatever file system the path is of."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
