"""Connected components of a table of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._tables import discard, stored

#: Places over which one key's rows are spread in a join with a table of distinct keys.
SALTS = 8


def salted(rows: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with `one`, which has each key once: rows of a hot key are spread over SALTS tasks by the column `by`."""
    spread = one.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread, [key, "salt"], how).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """A stored table (v, root) of every end of the links (a, b); root is one node of v's component.

    Each round gives every node its least neighbour, contracts the links to those and drops loops;
    stars shrink in one or two rounds, paths by more than half. The minimum is taken before the
    shuffle, so a node with many links is no hot spot.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    now, maps = stored(both, "links"), []
    while not now.isEmpty():
        least = stored(now.groupBy("a").agg(F.min("b").alias("r")).select("a", F.least("a", "r").alias("r")), "least")
        maps.append(least)
        other = least.select(F.col("a").alias("b"), F.col("r").alias("s"))
        after = salted(salted(now, least, "a", "b"), other, "b", "r").filter("r != s").select(F.col("r").alias("a"), F.col("s").alias("b")).distinct()
        before, now = now, stored(after, "links")
        discard(before)
    discard(now)
    if not maps:
        return stored(links.select(F.col("a").alias("v"), F.col("a").alias("root")), "roots")
    out = maps[0].select(F.col("a").alias("v"), F.col("r").alias("root"))
    for least in maps[1:]:
        out = salted(out, least.select(F.col("a").alias("root"), "r"), "root", "v", "left").select("v", F.coalesce("r", "root").alias("root"))
    out = stored(out, "roots")
    discard(*maps)
    return out
