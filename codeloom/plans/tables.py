"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used by a local master where spark.checkpoint.dir is unset, as in tests.
LOCAL_DIR = "/tmp/checkpoints"
#: While a table is written: shuffles go when they are read, and rows go to Python in small batches, whose buffers lie outside the heap.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_made: dict[str, weakref.ref] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; LOCAL_DIR where a local master has none.

    On a cluster the driver's and the executors' own folders differ, so there the setting must be given.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return where or LOCAL_DIR


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's name in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/codeloom-{what}-{uuid.uuid4().hex}"
    _made[path] = weakref.ref(spark)
    return path


@contextmanager
def _held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The settings hold until the block ends."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """In this block a join broadcasts a side only when the rows themselves were found to be few.

    Before a side is read, Spark knows the sizes of its files only. Rows that repeat much are some MB
    as a stored table and hundreds of MB in the driver, through which a broadcast goes.
    """
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    with _held(spark, {measured: spark.conf.get(measured, None) or spark.conf.get(static), static: "-1"}):
        yield


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again, which cuts its lineage.

    Executors may be lost later without the work being repeated. Spark removes the shuffles behind
    the table when it is written. `discard` deletes the table; the files of others go when the
    driver's Python ends (an interrupted driver leaves them to the folder's own clean-up).
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    with _held(spark, _WRITING):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more."""
    for df in tables:
        _delete(df.sparkSession, df._stored_path)
        _made.pop(df._stored_path, None)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for path, ref in _made.items():
        try:
            _delete(ref(), path)
        except Exception:  # noqa: BLE001  the session has ended already
            return
