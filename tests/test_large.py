"""What a query sends to the driver or deals out between tasks, on tables that are small as files."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from codeloom import indexer
from codeloom.operators import classes, graph
from codeloom.plans.tables import measured_joins, stored


@contextmanager
def threshold(spark):
    """Joins may broadcast what is thought to be 256 KB."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "256k")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def broadcast_rows(spark, seen: int) -> int:
    """The most rows that one broadcast sent, in executions behind the first `seen`."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for i in range(runs.size()):
        if (number := runs.apply(i).executionId()) < seen:
            continue
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if node.name().startswith("BroadcastExchange"):
                for m in map(node.metrics().apply, range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def executions(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return 1 + max([-1, *(runs.apply(i).executionId() for i in range(runs.size()))])


def shuffled_rows(spark) -> int:
    """Rows that all stages so far wrote for others."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_dispatch_counts_pair_no_override_with_every_call(spark):
    """300 overrides of a function with 3,000 calls make 900,000 pairs."""
    names = [("Base", None)] + [(f"C{i}", "Base") for i in range(300)]
    rows = [(i, f"Class:{n}", n, n.lower(), "Class", None, up) for i, (n, up) in enumerate(names)] + [(1000 + i, f"ClassFunction:{n}.run", "run", "run", "ClassFunction", n, None) for i, (n, _) in enumerate(names)]
    symbols = spark.createDataFrame(rows, "symbol_seq long, symbol_id string, name string, name_lc string, kind string, owner_class string, extends_class string")
    calls = [("ClassFunction:Base.run", f"m{i}", i % 7, None if i % 2 else i) for i in range(3000)]
    calls += [*calls[:50], ("ClassFunction:C5.run", "m1", 1, None), ("ClassFunction:C5.run", "m2", 2, 2), ("ClassFunction:C5.run", "m3", 3, 3), ("Class:Base", "m9", 1, 1)]
    edges = spark.createDataFrame(calls, "to_id string, from_id string, line int, column_no long")
    before = shuffled_rows(spark)
    got = {r.symbol_id: r.n for r in classes.dispatch_counts(symbols, edges, graph.ancestors(symbols)).collect()}
    assert shuffled_rows(spark) - before < 100_000
    assert got == {f"ClassFunction:C{i}.run": 2998 if i == 5 else 3000 for i in range(300)}


def test_measured_joins_look_at_rows(spark):
    rows = stored(spark.range(60_000).select((F.col("id") % 1000).alias("id"), F.lit("x" * 200).alias("text")), "rows")
    join = lambda: stored(spark.range(600_000).join(rows, "id"), "joined").count()
    with threshold(spark):
        seen = executions(spark)
        assert join() == 60_000
        assert broadcast_rows(spark, seen) == 60_000
        seen = executions(spark)
        with measured_joins(spark):
            assert join() == 60_000
        assert broadcast_rows(spark, seen) == 0


@pytest.fixture(scope="module")
def sources(spark):
    n = F.col("id").cast("string")
    return spark.range(15_000).select(F.concat(F.lit("Project/Sources/Methods/m"), n, F.lit(".4dm")).alias("rel_path"), F.concat(F.lit("var $x : Text\nm"), (F.col("id") + 1).cast("string"), F.lit("($x)\n")).alias("content"), F.concat(F.lit("file:///p/m"), n).alias("uri"), F.lit("method").alias("category"), F.lit(None).cast("string").alias("container"), F.concat(F.lit("m"), n).alias("base"))


def test_no_large_broadcast_when_a_project_is_built_and_patched(spark, sources):
    """15,000 methods are 2 MB or more in the driver."""
    with threshold(spark):
        seen = executions(spark)
        project = indexer.build(sources)
        assert project.index.symbols.filter("kind = 'ProjectMethod'").count() == 15_000
        assert project.index.edges.filter("resolved").count() == 14_999
        gone = sources.filter("base rlike '0$'").select(F.col("rel_path").alias("path"), F.lit("delete").alias("kind"))
        after = indexer.patch(project, gone, sources.limit(0)).index
        assert after.edges.count() == 13_500
        assert after.edges.filter("resolved").count() == 12_000
        assert broadcast_rows(spark, seen) < 15_000
