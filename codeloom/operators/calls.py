"""Call sites: dedup, counts and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What tells rows of one edge_seq apart.
TIES = ["edge_seq", "column_no", "call_kind", "raw", "access", "receiver"]


def dedup_sites(edges: DataFrame, other: str) -> DataFrame:
    """One edge for each (other end, line, column), a resolved one if there is one, with the first place.

    A null column is a value of its own.
    """
    site = Window.partitionBy("from_id" if other == "to_id" else "to_id", other, "line", F.coalesce("column_no", F.lit(-1)))
    rows = edges.withColumn("r", F.row_number().over(site.orderBy(F.desc("resolved"), *TIES))).withColumn("first_seq", F.min("edge_seq").over(site))
    return rows.filter("r = 1").drop("r")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (from, to, line, call_kind, access); the column doesn't count."""
    key = Window.partitionBy("from_id", "to_id", "line", "call_kind", "access").orderBy(*TIES)
    return edges.withColumn("r", F.row_number().over(key)).filter("r = 1").drop("r")


def raw_counts(edges: DataFrame) -> DataFrame:
    """(symbol_id, callers, callees) of every end of an edge: both counts by one aggregation over the ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("to_id").alias("symbol_id"), F.lit(1).alias("i")), F.struct(F.col("from_id").alias("symbol_id"), F.lit(0).alias("i")))).alias("e"))
    return ends.groupBy("e.symbol_id").agg(F.sum("e.i").alias("callers"), F.sum(1 - F.col("e.i")).alias("callees"))


def site_counts(edges: DataFrame, end: str) -> DataFrame:
    """(id, n_raw, n_sites, n_others) by end (from_id or to_id): edges, distinct sites, distinct other ends."""
    other = "from_id" if end == "to_id" else "to_id"
    sites = edges.groupBy(end, other, "line", F.coalesce("column_no", F.lit(-1)).alias("c")).agg(F.count("*").alias("n"))
    ends = sites.groupBy(end, other).agg(F.sum("n").alias("n"), F.count("*").alias("sites"))
    return ends.groupBy(F.col(end).alias("symbol_id")).agg(F.sum("n").alias("n_raw"), F.sum("sites").alias("n_sites"), F.count("*").alias("n_others"))


def usage_counts(edges: DataFrame) -> DataFrame:
    """(symbol_id, n_reads, n_writes)."""
    return edges.filter("access is not null").groupBy(F.col("to_id").alias("symbol_id")).agg(F.count(F.when(F.col("access") == "read", 1)).alias("n_reads"), F.count(F.when(F.col("access") == "write", 1)).alias("n_writes"))


def grouped_by_end(edges: DataFrame, end: str) -> DataFrame:
    """Sites grouped for call hierarchies: (symbol, other, lines in order, n)."""
    other = "from_id" if end == "to_id" else "to_id"
    return edges.groupBy(F.col(end).alias("symbol_id"), F.col(other).alias("other_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_seq", "line"))), lambda x: x["line"].cast("string")), ",").alias("lines"), F.count("*").alias("n_sites"))
