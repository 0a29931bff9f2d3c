"""Changes of a graph by hand, its synthetic symbols, results by test, and markers that move with edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.index import Index
from codeloom.operators.lookup import SYNTHETIC


def add_symbols(index: Index, new: DataFrame) -> Index:
    """The graph with more symbols; an id that it has already stays as it is."""
    rows = new.dropDuplicates(["symbol_id"]).join(index.symbols.select("symbol_id"), "symbol_id", "left_anti")
    return Index(index.symbols.unionByName(rows.select(index.symbols.columns)), index.edges, index.table)


def remove_symbols(index: Index, ids: DataFrame, incoming: bool = False) -> Index:
    """The graph without symbols (column symbol_id) and their calls; with `incoming`, without calls of them too."""
    gone = ids.select("symbol_id").distinct()
    edges = index.edges.join(gone.withColumnRenamed("symbol_id", "from_id"), "from_id", "left_anti")
    if incoming:
        edges = edges.join(gone.withColumnRenamed("symbol_id", "to_id"), "to_id", "left_anti")
    return Index(index.symbols.join(gone, "symbol_id", "left_anti"), edges.select(index.edges.columns), index.table)


def add_edges(index: Index, new: DataFrame) -> Index:
    return Index(index.symbols, index.edges.unionByName(new.select(index.edges.columns)), index.table)


def remove_edges(index: Index, gone: DataFrame) -> Index:
    """The graph without the edges of these numbers (column edge_seq)."""
    return Index(index.symbols, index.edges.join(gone.select("edge_seq").distinct(), "edge_seq", "left_anti").select(index.edges.columns), index.table)


def synthetic_drift(index: Index) -> DataFrame:
    """(symbol_id, problem): synthetic symbols that no edge needs any more (`unused`), and targets without a symbol (`missing`).

    Synthetic symbols are made of the edges, so a graph that was kept by hand must be built anew if there is any.
    """
    made = index.symbols.filter(F.col("kind").isin(SYNTHETIC)).select("symbol_id")
    ends = index.edges.select(F.col("to_id").alias("symbol_id")).distinct()
    unused = made.join(ends, "symbol_id", "left_anti").withColumn("problem", F.lit("unused"))
    return unused.union(ends.join(index.symbols.select("symbol_id"), "symbol_id", "left_anti").withColumn("problem", F.lit("missing")))


def merge_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Results by (suite, name): the new one where there is one, the last of several; columns as of `old`, ordered by `seq`."""
    last = Window.partitionBy("suite", "name").orderBy(F.desc("fresh"), F.desc("seq"))
    rows = old.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
    return rows.withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r", "fresh")


def shift_markers(markers: DataFrame, edits: DataFrame) -> DataFrame:
    """markers (uri, line) with `now`: where each line has gone after the edits (uri, seq, start, end, added) in their order.

    An edit replaces lines start to end by text with `added` line ends; what lies behind it moves. An
    edit with a null start saves the file or reverts it: its markers are where they were.
    """
    steps = edits.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "added"))).alias("steps"))
    back = lambda at, e: F.when(e["start"].isNull(), F.col("line")).when(at > e["end"], at + e["added"] - (e["end"] - e["start"])).otherwise(at)
    now = F.aggregate(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), F.col("line"), back)
    return markers.join(steps, "uri", "left").withColumn("now", now).drop("steps")
