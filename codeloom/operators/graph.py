"""Traversals as level-synchronous loops over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.tables import discard, stored


def steps(edges: DataFrame, direction: str = "forward") -> DataFrame:
    """Distinct (src, dst) in the direction: forward, backward or both."""
    ahead = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    back = edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    return {"forward": ahead, "backward": back, "both": ahead.union(back)}[direction].distinct()


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None, direction: str = "forward") -> DataFrame:
    """(id, level) of what is reached from seeds (column id), the seeds at level 0.

    One join of the frontier with the edges a level; known nodes are taken out by an anti join. The
    edges are read from one stored table, so a level costs the frontier's size. Without a depth it
    runs until nothing new is found.
    """
    table = stored(steps(edges, direction), "steps")
    frontier = stored(seeds.select("id").distinct().withColumn("level", F.lit(0)), "level")
    seen, level = frontier, 0
    while (depth is None or level < depth) and not frontier.isEmpty():
        level += 1
        new = table.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = stored(new.join(seen, "id", "left_anti").withColumn("level", F.lit(level)), "level")
        seen = seen.union(frontier)
    return seen


def reached_edges(edges: DataFrame, nodes: DataFrame, depth: int, direction: str = "forward") -> DataFrame:
    """Every edge that a search of this depth looks at: those at nodes above the last level."""
    inner = nodes.filter(F.col("level") < depth).select("id")
    out = []
    if direction in ("forward", "both"):
        out.append(edges.join(inner.withColumnRenamed("id", "from_id"), "from_id", "left_semi"))
    if direction in ("backward", "both"):
        out.append(edges.join(inner.withColumnRenamed("id", "to_id"), "to_id", "left_semi"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def shortest_path(edges: DataFrame, start: str, goal: str, max_depth: int = 8, direction: str = "forward") -> DataFrame:
    """(hop, id) along one shortest path; no rows if there is none, or one row if both are the same.

    Each level keeps one parent of a node (the least edge_seq); at most max_depth + 1 rows are walked
    back on the driver.
    """
    spark = edges.sparkSession
    if start == goal:
        return spark.createDataFrame([(0, start)], "hop int, id string")
    ahead = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "edge_seq")
    back = edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "edge_seq")
    table = stored({"forward": ahead, "backward": back, "both": ahead.union(back)}[direction], "steps")
    seen = frontier = stored(spark.createDataFrame([(start, None, 0)], "id string, parent string, level int"), "level")
    level = 0
    while level < max_depth and not frontier.isEmpty():
        level += 1
        new = table.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min_by("src", F.struct("edge_seq", "src")).alias("parent"))
        frontier = stored(new.join(seen, "id", "left_anti").withColumn("level", F.lit(level)), "level")
        seen = seen.union(frontier)
        if not frontier.filter(F.col("id") == goal).isEmpty():
            path, at = [goal], goal
            for k in range(level, 0, -1):
                at = seen.filter((F.col("id") == at) & (F.col("level") == k)).first()["parent"]
                path.append(at)
            return spark.createDataFrame([(k, x) for k, x in enumerate(reversed(path))], "hop int, id string")
    return spark.createDataFrame([], "hop int, id string")


def closure_by_word(steps_: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each seed (column seed) reaches over (src, dst), itself included, 64 seeds to a word.

    Returns (seed, word, bit) and (id, word, bits): bit k of bits is set if the word's seed k reaches
    id. A level passes whole words over the edges and ors them, so a node costs a row for 64 seeds,
    however many of these reach it, and each step's state is written once. Seeds get their bits
    inside hash buckets, so none is numbered by a single task.
    """
    table = stored(steps_.select("src", "dst").distinct(), "steps")
    own = seeds.select("seed").distinct()
    buckets = max(1, own.count() // 4096)
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("seed")) - 1
    numbered = own.withColumn("bucket", F.pmod(F.xxhash64("seed"), F.lit(buckets))).withColumn("place", place)
    numbered = stored(numbered.select("seed", (F.col("bucket") * (1 << 24) + F.floor(F.col("place") / 64)).alias("word"), (F.col("place") % 64).cast("int").alias("bit")), "seeds")
    start = numbered.groupBy(F.col("seed").alias("id"), "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    state = stored(start.withColumn("fresh", F.col("bits")), "reach")
    while True:
        frontier = state.filter("fresh != 0").select(F.col("id").alias("src"), "word", "fresh")
        new = table.join(frontier, "src").groupBy(F.col("dst").alias("id"), "word").agg(F.bit_or("fresh").alias("more"))
        had, more = F.coalesce("bits", F.lit(0).cast("long")), F.coalesce("more", F.lit(0).cast("long"))
        after = stored(state.select("id", "word", "bits").join(new, ["id", "word"], "full").select("id", "word", had.bitwiseOR(more).alias("bits"), more.bitwiseAND(F.bitwise_not(had)).alias("fresh")), "reach")
        discard(state)
        state = after
        if state.filter("fresh != 0").isEmpty():
            discard(table)
            return numbered, state.select("id", "word", "bits")


def reached_by(numbered: DataFrame, reach: DataFrame) -> DataFrame:
    """(id, n): how many seeds other than itself reach each node; of `closure_by_word`."""
    own = numbered.select(F.col("seed").alias("id"), F.lit(1).alias("own"))
    n = reach.groupBy("id").agg(F.sum(F.bit_count("bits")).alias("n")).join(own, "id", "left")
    return n.select("id", (F.col("n") - F.coalesce("own", F.lit(0))).cast("long").alias("n")).filter("n > 0")


def reach_sizes(numbered: DataFrame, reach: DataFrame) -> DataFrame:
    """(seed, n): how many nodes each seed reaches, itself included; of `closure_by_word`."""
    sums = reach.groupBy("word").agg(F.array(*[F.sum(F.expr(f"shiftrightunsigned(bits, {k}) & 1")) for k in range(64)]).alias("n"))
    return numbered.join(sums, "word").select("seed", F.col("n")[F.col("bit")].cast("long").alias("n"))


def expand_tree(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """(path, id, depth, has_next): the call tree under root, never entering a symbol on its own path."""
    table = stored(steps(edges), "steps")
    level = edges.sparkSession.createDataFrame([([root], root, 0)], "path array<string>, id string, depth int")
    out = [level]
    for k in range(depth):
        nxt = table.join(level.withColumnRenamed("id", "src"), "src").filter(~F.array_contains("path", F.col("dst")))
        level = stored(nxt.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("id"), F.lit(k + 1).alias("depth")), "tree")
        out.append(level)
    rows = out[0]
    for x in out[1:]:
        rows = rows.union(x)
    again = table.select(F.col("src").alias("id")).distinct().withColumn("has_next", F.lit(True))
    return rows.join(again, "id", "left").select("path", "id", "depth", F.coalesce("has_next", F.lit(False)).alias("has_next"))


def ancestors(symbols: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(class_lc, ancestor_lc, depth) of every class, nearest first; a cycle stops the walk.

    A class has one parent at most, so a level is one join with the class table. Of classes with one
    name the first counts; an unknown parent ends the walk. Without a depth it runs until a level is
    empty.
    """
    first = Window.partitionBy("name_lc").orderBy("symbol_seq")
    classes = symbols.filter(F.col("kind") == "Class").withColumn("r", F.row_number().over(first)).filter("r = 1")
    parent = stored(classes.select(F.col("name_lc").alias("child"), F.lower("extends_class").alias("up")), "parents")
    known = parent.select(F.col("child").alias("up"))
    links = stored(parent.filter("up is not null").join(known, "up", "left_semi"), "extends")
    level = links.filter("child != up").select(F.col("child").alias("class_lc"), F.col("up").alias("ancestor_lc"), F.lit(1).alias("depth"), F.array("child", "up").alias("path"))
    out = []
    while max_depth is None or len(out) < max_depth:
        level = stored(level, "ancestors")
        out.append(level)
        nxt = level.join(links.withColumnRenamed("child", "ancestor_lc"), "ancestor_lc").filter(~F.array_contains("path", F.col("up")))
        nxt = nxt.select("class_lc", F.col("up").alias("ancestor_lc"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("up")).alias("path"))
        if nxt.isEmpty():
            break
        level = nxt
    rows = out[0]
    for x in out[1:]:
        rows = rows.union(x)
    return rows.drop("path")
