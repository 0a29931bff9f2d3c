"""A stored graph: written as snapshots, read again while version, root and files agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.index import Index
from codeloom.sources.files import fresh

#: Raised when what is stored changes; other versions are not read.
VERSION, PARSER = 1, "statements"


def save(index: Index, listing: DataFrame, root: str, where: str) -> str:
    """Write a new snapshot below `where`; returns its folder.

    listing has (path, mtime in ms) of the files that it was made from. The table `meta` is written
    last, so a snapshot is either whole or not there; older ones stay until `prune`.
    """
    spark = index.spark
    number = max([n for n, _ in snapshots(spark, where)], default=0) + 1
    folder = f"{where.rstrip('/')}/{number:08d}"
    index.symbols.write.mode("overwrite").parquet(f"{folder}/symbols")
    index.edges.write.mode("overwrite").parquet(f"{folder}/edges")
    listing.select("path", F.col("mtime").cast("double").alias("mtime")).write.mode("overwrite").parquet(f"{folder}/files")
    spark.createDataFrame([(VERSION, PARSER, root)], "version int, parser string, root string").coalesce(1).write.parquet(f"{folder}/meta")
    return folder


def snapshots(spark: SparkSession, where: str) -> list[tuple[int, str]]:
    """(number, folder) of the whole snapshots below `where`, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    whole = [p for p in found if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "meta/_SUCCESS"))]
    return sorted((int(p.getName()), p.toString()) for p in whole)


def latest(spark: SparkSession, where: str) -> Index | None:
    """The graph of the newest snapshot, whatever the files say; for readers that follow a writer."""
    found = snapshots(spark, where)
    if not found:
        return None
    folder = found[-1][1]
    return Index(spark.read.parquet(f"{folder}/symbols"), spark.read.parquet(f"{folder}/edges"))


def load(spark: SparkSession, where: str, root: str, listing: DataFrame) -> Index | None:
    """The newest snapshot's graph, if its version, parser and root are the given ones and its files are still the same; else None."""
    found = snapshots(spark, where)
    if not found:
        return None
    folder = found[-1][1]
    if tuple(spark.read.parquet(f"{folder}/meta").first()) != (VERSION, PARSER, root):
        return None
    if not fresh(spark.read.parquet(f"{folder}/files"), listing):
        return None
    return latest(spark, where)


def prune(spark: SparkSession, where: str, keep: int = 2) -> None:
    """Delete all but the newest snapshots; readers of the one before may still be at work."""
    for _, folder in snapshots(spark, where)[:-keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
