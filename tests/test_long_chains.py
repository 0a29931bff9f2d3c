"""Chains of classes and of property steps longer than the driver's tables have."""

from codeloom.operators import classes, graph, resolve

SYMBOLS = "symbol_seq long, symbol_id string, name string, name_lc string, kind string, extends_class string"


def chain(spark, n):
    return spark.createDataFrame([(k, f"Class:C{k}", f"C{k}", f"c{k}", "Class", f"C{k + 1}" if k + 1 < n else None) for k in range(n)], SYMBOLS)


def test_ancestors_of_more_than_32_levels(spark):
    n = 36
    rows = {tuple(r) for r in graph.ancestors(chain(spark, n)).select("class_lc", "ancestor_lc", "depth").collect()}
    assert rows == {(f"c{i}", f"c{j}", j - i) for i in range(n) for j in range(i + 1, n)}


def test_paths_of_more_than_six_steps(spark):
    n = 9
    symbols = spark.createDataFrame([(k, f"Class:C{k}", f"C{k}", f"c{k}", "Class", None) for k in range(n)], SYMBOLS)
    props = spark.createDataFrame([(f"c{k}", "next", f"c{k + 1}") for k in range(n - 1)], "class_lc string, member string, type_lc string")
    sites = spark.createDataFrame([(k, "c0", ["next"] * k) for k in range(n + 1)], "site_no int, class_lc string, path array<string>")
    up = classes.with_self(symbols, graph.ancestors(symbols))
    out = {r.site_no: r.end_lc for r in resolve.walk_chain(sites, props, up).collect()}
    assert out == {k: f"c{k}" if k < n else None for k in range(n + 1)}
    assert resolve.walk_chain(sites.limit(0), props, up).collect() == []
