"""The driver's tables as a code graph: one SQL text for Spark and DuckDB.

Regions, nations and suppliers are classes of three levels, part types their members; parts,
orders and customers are methods; line items, orders and parts give the calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.index import Index

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]

CLASSES = """
SELECT CAST(r_regionkey AS BIGINT) AS symbol_seq, concat('Class:', r_name) AS symbol_id, r_name AS name, CAST(NULL AS {string}) AS extends_class, 'Class' AS class_flavor, 'file:///p/Classes/region.4dm' AS uri, CAST(r_regionkey AS INT) AS line FROM {region}
UNION ALL SELECT CAST(1000 + n_nationkey AS BIGINT), concat('Class:', n_name), n_name, r_name, CASE WHEN n_nationkey % 2 = 0 THEN 'Entity' ELSE 'EntitySelection' END, concat('file:///p/Classes/', r_name, '.4dm'), CAST(n_nationkey AS INT) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT CAST(10000 + s_suppkey AS BIGINT), concat('Class:', s_name), s_name, n_name, CASE WHEN s_suppkey % 3 = 0 THEN 'Entity' WHEN s_suppkey % 3 = 1 THEN 'Class' ELSE 'Interface' END, concat('file:///p/Classes/', n_name, '.4dm'), CAST(s_suppkey AS INT) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""
TYPES = "SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS BIGINT) AS k FROM (SELECT DISTINCT p_type FROM {part}) x"
MEMBERS = """
SELECT c.symbol_seq AS class_seq, c.name AS owner_class, t.p_type AS name, t.k,
    CASE WHEN length(t.p_type) = 5 THEN 'ClassGetter' WHEN length(t.p_type) = 8 THEN 'ClassProperty' ELSE 'ClassFunction' END AS kind, c.uri
FROM ({classes}) c JOIN ({types}) t ON c.symbol_seq < 1000 OR (c.symbol_seq < 10000 AND (c.symbol_seq - 1000 + length(t.p_type)) % 2 = 0) OR (c.symbol_seq >= 10000 AND (c.symbol_seq - 10000 + length(t.p_type)) % 3 = 0)
"""
SYMBOLS = """
SELECT symbol_seq, symbol_id, name, lower(name) AS name_lc, kind, uri, line, owner_class, class_flavor, extends_class, return_type, params, scope FROM (
SELECT symbol_seq, symbol_id, name, 'Class' AS kind, uri, line, CAST(NULL AS {string}) AS owner_class, class_flavor, extends_class, CAST(NULL AS {string}) AS return_type, CAST(NULL AS {string}) AS params, CAST(NULL AS {string}) AS scope FROM ({classes}) c
UNION ALL SELECT 1000000 + class_seq * 10 + k, concat(kind, ':', owner_class, '.', name), name, kind, uri, CAST(100 + k AS INT), owner_class, NULL, NULL, CASE WHEN class_seq % 2 = 0 THEN 'Text' END, CASE WHEN kind = 'ClassFunction' THEN concat('size : Integer; ', lower(name)) END, NULL FROM ({members}) m
UNION ALL SELECT 10000000 + p_partkey, concat('ProjectMethod:Part', p_partkey), concat(replace(p_name, ' ', '_'), p_partkey), 'ProjectMethod', concat('file:///p/Methods/', p_brand, '.4dm'), CAST(p_partkey % 1000 AS INT), NULL, NULL, NULL, CASE WHEN p_size % 2 = 0 THEN 'Integer' END, concat('size : Integer; _hue; ', lower(p_type)), NULL FROM {part}
UNION ALL SELECT 100000000 + o_orderkey, concat('ProjectMethod:Order', o_orderkey), concat('Order', o_orderkey), 'ProjectMethod', concat('file:///p/Methods/', o_orderpriority, '.4dm'), CAST(o_orderkey % 1000 AS INT), NULL, NULL, NULL, NULL, NULL, NULL FROM {orders}
UNION ALL SELECT 1000000000 + c_custkey, concat('ProjectMethod:test_', c_custkey), concat(CASE c_custkey % 3 WHEN 0 THEN 'UT_' WHEN 1 THEN 'test_' ELSE 'helper_' END, c_custkey), 'ProjectMethod', concat('file:///p/Tests/', c_mktsegment, '.4dm'), CAST(c_custkey % 1000 AS INT), NULL, NULL, NULL, NULL, NULL, NULL FROM {customer}
UNION ALL SELECT 2000000000 + k, concat('Constant:', p_type), concat('k_', lower(p_type)), 'Constant', 'file:///p/Resources/constants.xlf', CAST(k AS INT), NULL, NULL, NULL, NULL, NULL, 'theme' FROM ({types}) t
UNION ALL SELECT 3000000000 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT), concat('Unresolved:', o_orderpriority), o_orderpriority, 'Unresolved', 'synthetic:', -1, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT o_orderpriority FROM {orders}) u
UNION ALL SELECT 4000000000 + length(l_returnflag), concat('Builtin:', l_returnflag), l_returnflag, 'Builtin', 'synthetic:', -1, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT l_returnflag FROM {lineitem}) b
) s
"""
EDGES = """
SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS edge_seq, concat('ProjectMethod:Order', l_orderkey) AS from_id, concat('ProjectMethod:Part', l_partkey) AS to_id, CASE l_returnflag WHEN 'R' THEN 'Static' WHEN 'A' THEN 'Dynamic' ELSE 'Inherited' END AS call_kind, CAST(l_linenumber AS INT) AS line, CAST(l_suppkey AS BIGINT) AS column_no, CAST(l_shipdate AS {string}) AS raw, l_linestatus = 'F' AS resolved, CASE WHEN (l_partkey + l_linenumber) % 4 = 0 THEN 'write' WHEN (l_partkey + l_linenumber) % 4 = 1 THEN 'read' END AS access, CASE WHEN l_quantity > 45 THEN 'this' WHEN l_quantity > 43 THEN 'super' END AS receiver FROM {lineitem}
UNION ALL SELECT 1000000000000000 + o_orderkey, concat('ProjectMethod:test_', o_custkey), concat('ProjectMethod:Order', o_orderkey), 'Static', CAST(o_orderkey % 50 AS INT), NULL, o_orderstatus, true, NULL, NULL FROM {orders}
UNION ALL SELECT 2000000000000000 + p_partkey, concat('ProjectMethod:Part', p_partkey), concat('ProjectMethod:Part', CAST((p_partkey - p_partkey % 3) / 3 AS BIGINT)), 'Static', 7, NULL, p_name, true, NULL, NULL FROM {part}
UNION ALL SELECT 2500000000000000, 'ProjectMethod:Part0', 'ProjectMethod:Part1', 'Static', 8, NULL, 'cycle', true, NULL, NULL
UNION ALL SELECT 3000000000000000 + p_partkey, concat('ProjectMethod:Part', p_partkey), concat('Class:', s_name), 'Static', 9, 3, s_name, true, NULL, NULL FROM {part} JOIN {supplier} ON s_suppkey = p_partkey % 10
UNION ALL SELECT 4000000000000000 + p_partkey, concat('ProjectMethod:Part', p_partkey), concat(m.kind, ':', m.owner_class, '.', m.name), 'Inherited', 10, CAST(p_size AS BIGINT), p_brand, true, CASE WHEN m.kind <> 'ClassFunction' THEN 'read' END, 'this' FROM {part} JOIN ({members}) m ON m.class_seq = 10000 + p_partkey % 10 AND m.name = p_type
UNION ALL SELECT 5000000000000000 + c_custkey, concat('ProjectMethod:test_', c_custkey), concat(m.kind, ':', m.owner_class, '.', m.name), 'Static', 11, NULL, c_mktsegment, true, CASE WHEN m.kind <> 'ClassFunction' THEN 'write' END, NULL FROM {customer} JOIN ({members}) m ON m.class_seq = c_custkey % 5 AND m.k = c_custkey % 6
UNION ALL SELECT 6000000000000000 + o_orderkey, concat('ProjectMethod:Order', o_orderkey), concat('Unresolved:', o_orderpriority), 'Dynamic', CAST(o_orderkey % 9 AS INT), o_custkey % 5, o_orderpriority, false, NULL, NULL FROM {orders} WHERE o_orderstatus = 'P'
UNION ALL SELECT 7000000000000000 + o_orderkey, concat('ProjectMethod:Order', o_orderkey), 'Constant:PROMO', 'Static', 12, NULL, 'k_promo', true, 'read', NULL FROM {orders} WHERE o_orderkey % 4 = 0
"""


def _text(sql: str, **names: str) -> str:
    types = TYPES.format(**names)
    classes = CLASSES.format(**names)
    return sql.format(classes=classes, types=types, members=MEMBERS.format(classes=classes, types=types, **names), **names)


def model(spark: SparkSession, sf_dir: str) -> Index:
    """The graph of a folder of driver tables, as lazy DataFrames; its `tables` reads any of them."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    names = {t: "{" + t + "}" for t in TABLES} | {"string": "STRING"}
    used = {t: table(t) for t in TABLES[:7]}

    def run(sql: str) -> DataFrame:
        text = _text(sql, **names)
        return spark.sql(text, **{t: d for t, d in used.items() if "{" + t + "}" in text})

    return Index(run(SYMBOLS), run(EDGES), table)


def duck_prelude() -> str:
    """The graph as common table expressions, for the oracles."""
    names = {t: t for t in TABLES} | {"string": "VARCHAR"}
    return f"WITH RECURSIVE symbols AS MATERIALIZED ({_text(SYMBOLS, **names)}), edges AS MATERIALIZED ({_text(EDGES, **names)})"
