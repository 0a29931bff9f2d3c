"""Registered queries: resolution joins over call sites made from part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import calls, classes, graph, resolve
from codeloom.plans.registered import query
from codeloom.plans.traversal_queries import _RESOLVE

# Lookup dimensions of these queries: (name, target).
DIMS = {
    "methods": [("widget", "ProjectMethod:widget"), ("red", "ProjectMethod:red")],
    "components": [("bolt", "ComponentMethod:bolt"), ("widget", "ComponentMethod:widget")],
    "plugins": [("gear", "PluginCommand:gear")],
    "builtins": [("ring", "Builtin:ring"), ("gear", "Builtin:gear")],
    "prefixes": [("sp", ""), ("s", ""), ("pl", "")],
    "constants": [("small", "Constant:small"), ("blue", "BuiltinConstant:blue")],
    "forms": [("bolt", "Form:bolt")],
}
_DIMS = "".join(f", {k}(key, to_id) AS (VALUES {', '.join(str(x) for x in v)})" for k, v in DIMS.items())
_SITES = _DIMS + ", sites AS (SELECT p_partkey AS site_no, concat('ProjectMethod:Part', p_partkey) AS from_id, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, lower(p_type) AS name_lc, concat('supplier#00000000', p_partkey % 10) AS class_lc, p_size FROM part)"


def dims(m) -> dict:
    return {k: m.spark.createDataFrame(v, "key string, to_id string") for k, v in DIMS.items()}


def sites(m):
    return m.table("part").select(F.col("p_partkey").alias("site_no"), F.concat(F.lit("ProjectMethod:Part"), "p_partkey").alias("from_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w1"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w2"), F.lower("p_type").alias("name_lc"), F.concat(F.lit("supplier#00000000"), (F.col("p_partkey") % 10).cast("string")).alias("class_lc"), "p_size")


@query("jon_01_bare_name", _SITES + " SELECT site_no, coalesce(m.to_id, d.to_id, c.to_id, p.to_id, b.to_id, CASE WHEN (SELECT count(*) FROM prefixes x WHERE starts_with(w2, x.key)) > 0 THEN concat('Builtin:', w2) END, concat('Unresolved:', w2)) AS to_id FROM sites LEFT JOIN methods m ON m.key = lower(w2) LEFT JOIN (SELECT name_lc AS key, arg_min(symbol_id, symbol_seq) AS to_id FROM symbols WHERE kind IN ('ProjectMethod', 'DatabaseMethod') GROUP BY 1) d ON d.key = lower(w2) LEFT JOIN components c ON c.key = w2 LEFT JOIN plugins p ON p.key = w2 LEFT JOIN builtins b ON b.key = w2")
def jon_01(m):
    d = dims(m)
    own = resolve.method_dimension(m.symbols).join(d["methods"], "key", "left_anti")
    return resolve.bare_names(sites(m), "w2", d["methods"].union(own), d["components"], d["plugins"], d["builtins"], d["prefixes"]).select("site_no", "to_id")


@query("jon_02_builtin_chain", _SITES + " SELECT site_no, coalesce(p.to_id, b.to_id) AS to_id FROM sites LEFT JOIN plugins p ON p.key = w2 LEFT JOIN builtins b ON b.key = w2 WHERE coalesce(p.to_id, b.to_id) IS NOT NULL")
def jon_02(m):
    d = dims(m)
    return resolve.by_priority(sites(m), [(F.col("w2"), d["plugins"]), (F.col("w2"), d["builtins"])], None).select("site_no", "to_id")


@query("jon_03_cs_new", _SITES + ", c AS (SELECT name_lc AS key, symbol_id AS to_id FROM symbols WHERE kind = 'Class') SELECT site_no, coalesce(c.to_id, concat('Unresolved:cs.', class_lc, '.new')) AS to_id, c.to_id IS NOT NULL AS resolved FROM sites LEFT JOIN c ON c.key = class_lc")
def jon_03(m):
    made = m.symbols.filter("kind = 'ClassConstructor'").select(F.lower("owner_class").alias("key"), F.col("symbol_id").alias("to_id"))
    own = m.symbols.filter("kind = 'Class'").select(F.col("name_lc").alias("key"), F.col("symbol_id").alias("to_id"))
    return resolve.by_priority(sites(m), [(F.col("class_lc"), made), (F.col("class_lc"), own)], F.concat(F.lit("Unresolved:cs."), "class_lc", F.lit(".new"))).select("site_no", "to_id", "resolved")


def _resolution(m):
    return classes.member_resolution(m.symbols, graph.ancestors(m.symbols))


@query("jon_04_cs_call", _RESOLVE + _SITES + " SELECT site_no, r.symbol_id AS to_id FROM sites s JOIN res r ON r.class_lc = s.class_lc AND r.name_lc = s.name_lc AND r.slot = 'call'")
def jon_04(m):
    return resolve.on_class(sites(m).withColumn("slot", F.lit("call")), _resolution(m), None).select("site_no", "to_id")


@query("jon_07_ds_call", _RESOLVE + _SITES + " SELECT site_no, coalesce(r.symbol_id, concat('TableBuiltin:', s.class_lc, '.', s.name_lc)) AS to_id FROM sites s LEFT JOIN res r ON r.class_lc = s.class_lc AND r.name_lc = s.name_lc AND r.slot = 'call'")
def jon_07(m):
    return resolve.on_class(sites(m).withColumn("slot", F.lit("call")), _resolution(m), F.concat(F.lit("TableBuiltin:"), "class_lc", F.lit("."), "name_lc")).select("site_no", "to_id")


@query("jon_08_this_call", _RESOLVE + _SITES + " SELECT site_no, coalesce(r.symbol_id, concat('Unresolved:This.', s.name_lc)) AS to_id, CASE WHEN r.depth = 0 THEN 'Static' WHEN r.depth > 0 THEN 'Inherited' ELSE 'Dynamic' END AS call_kind FROM sites s LEFT JOIN res r ON r.class_lc = s.class_lc AND r.name_lc = s.name_lc AND r.slot = 'call'")
def jon_08(m):
    return resolve.on_class(sites(m).withColumn("slot", F.lit("call")), _resolution(m), F.concat(F.lit("Unresolved:This."), "name_lc")).select("site_no", "to_id", "call_kind")


@query("jon_09_super_call", _RESOLVE + _SITES + ", sup AS (SELECT u.class_lc, r.name_lc, r.symbol_id FROM up u JOIN res r ON r.class_lc = u.ancestor_lc AND r.slot = 'call' WHERE u.depth = 1) SELECT site_no, coalesce(symbol_id, 'Unresolved:Super') AS to_id FROM sites s LEFT JOIN sup USING (class_lc, name_lc)")
def jon_09(m):
    up = graph.ancestors(m.symbols)
    parent = up.filter("depth = 1").select("class_lc", F.col("ancestor_lc").alias("parent_lc"))
    at = sites(m).join(parent, "class_lc", "left").withColumn("slot", F.lit("call"))
    return resolve.on_class(at, classes.member_resolution(m.symbols, up), F.lit("Unresolved:Super"), "parent_lc").select("site_no", "to_id")


@query("jon_10_var_call", _RESOLVE + _SITES + ", types(w1, typ) AS (VALUES ('red', 'asia'), ('blue', 'africa'), ('small', 'nation_1')) SELECT site_no, CASE WHEN typ IS NULL THEN concat('Unresolved:$', w1, '.', s.name_lc) ELSE coalesce(r.symbol_id, concat('Builtin:', typ, '.', s.name_lc)) END AS to_id FROM sites s LEFT JOIN types USING (w1) LEFT JOIN res r ON r.class_lc = typ AND r.name_lc = s.name_lc AND r.slot = 'call'")
def jon_10(m):
    local = m.spark.createDataFrame([("red", "asia"), ("blue", "africa"), ("small", "nation_1")], "w1 string, typ string")
    typed = sites(m).join(F.broadcast(local), "w1", "left").withColumn("slot", F.lit("call"))
    miss = F.when(F.col("typ").isNull(), F.concat(F.lit("Unresolved:$"), "w1", F.lit("."), "name_lc")).otherwise(F.concat(F.lit("Builtin:"), "typ", F.lit("."), "name_lc"))
    return resolve.on_class(typed, _resolution(m), miss, "typ").select("site_no", "to_id")


@query("jon_11_chain_call", _RESOLVE + _SITES + ", props(class_lc, member, type_lc) AS (VALUES ('asia', 'next', 'africa'), ('africa', 'next', 'america'), ('america', 'home', 'asia')), near AS (SELECT s.class_lc, p.member, p.type_lc FROM self s JOIN props p ON p.class_lc = s.ancestor_lc QUALIFY row_number() OVER (PARTITION BY s.class_lc, p.member ORDER BY s.depth) = 1) SELECT site_no, b.type_lc AS end_lc FROM sites s LEFT JOIN near a ON a.class_lc = s.class_lc AND a.member = 'next' LEFT JOIN near b ON b.class_lc = a.type_lc AND b.member = CASE WHEN p_size % 2 = 0 THEN 'next' ELSE 'home' END")
def jon_11(m):
    props = m.spark.createDataFrame([("asia", "next", "africa"), ("africa", "next", "america"), ("america", "home", "asia")], "class_lc string, member string, type_lc string")
    at = sites(m).withColumn("path", F.array(F.lit("next"), F.when(F.col("p_size") % 2 == 0, "next").otherwise("home")))
    return resolve.walk_chain(at, props, classes.with_self(m.symbols, graph.ancestors(m.symbols)), 2).select("site_no", "end_lc")


@query("jon_12_literal_method", _SITES + " SELECT site_no, m.to_id, 'Dynamic' AS call_kind FROM sites JOIN methods m ON m.key = lower(w1)")
def jon_12(m):
    return resolve.by_priority(sites(m), [(F.lower("w1"), dims(m)["methods"])], None).select("site_no", "to_id", F.lit("Dynamic").alias("call_kind"))


@query("jon_13_dynamic_method", _SITES + " SELECT site_no, concat('Unresolved:EXECUTE_METHOD($', w1, ')') AS to_id FROM sites")
def jon_13(m):
    return sites(m).select("site_no", F.concat(F.lit("Unresolved:EXECUTE_METHOD($"), "w1", F.lit(")")).alias("to_id"))


@query("jon_14_subform_method", _SITES + " SELECT site_no, coalesce(f.to_id, m.to_id, concat('Unresolved:', w2)) AS to_id FROM sites LEFT JOIN forms f ON f.key = w2 LEFT JOIN methods m ON m.key = lower(w2)")
def jon_14(m):
    d = dims(m)
    return resolve.by_priority(sites(m), [(F.col("w2"), d["forms"]), (F.lower("w2"), d["methods"])], F.concat(F.lit("Unresolved:"), "w2")).select("site_no", "to_id")


@query("jon_15_this_get_set", _RESOLVE + _SITES + " SELECT site_no, r.symbol_id AS to_id, s.slot AS access FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'read' ELSE 'write' END AS slot FROM sites) s JOIN res r ON r.class_lc = s.class_lc AND r.name_lc = s.name_lc AND r.slot = s.slot")
def jon_15(m):
    slot = F.when(F.col("p_size") % 2 == 0, "read").otherwise("write")
    return resolve.on_class(sites(m).withColumn("slot", slot), _resolution(m), None).select("site_no", "to_id", F.col("slot").alias("access"))


@query("jon_16_var_get_set", _RESOLVE + _SITES + " SELECT site_no, coalesce(r.symbol_id, concat('Builtin:', s.class_lc, '.', s.name_lc)) AS to_id FROM sites s LEFT JOIN res r ON r.class_lc = s.class_lc AND r.name_lc = s.name_lc AND r.slot = 'read'")
def jon_16(m):
    return resolve.on_class(sites(m).withColumn("slot", F.lit("read")), _resolution(m), F.concat(F.lit("Builtin:"), "class_lc", F.lit("."), "name_lc")).select("site_no", "to_id")


@query("jon_17_ds_bracket", _SITES + " SELECT site_no, CASE WHEN m.key IS NOT NULL THEN concat('Class:', w1, 'Entity') ELSE concat('Unresolved:ds[', w1, ']') END AS to_id, 'call' AS part FROM sites LEFT JOIN constants m ON m.key = w1 UNION ALL SELECT site_no, c.to_id, 'constant' FROM sites JOIN constants c ON c.key = w1")
def jon_17(m):
    catalog = dims(m)["constants"]
    tables = catalog.select("key", F.concat(F.lit("Class:"), "key", F.lit("Entity")).alias("to_id"))
    call = resolve.by_priority(sites(m), [(F.regexp_replace("w1", "^_", ""), tables)], F.concat(F.lit("Unresolved:ds["), "w1", F.lit("]"))).select("site_no", "to_id", F.lit("call").alias("part"))
    return call.union(resolve.by_priority(sites(m), [(F.col("w1"), catalog)], None).select("site_no", "to_id", F.lit("constant")))


@query("jon_18_exact_or_drop", _SITES + " SELECT site_no, c.to_id FROM sites JOIN constants c ON c.key = lower(w1) UNION ALL SELECT site_no, f.to_id FROM sites JOIN forms f ON f.key = w2")
def jon_18(m):
    d = dims(m)
    a = resolve.by_priority(sites(m), [(F.lower("w1"), d["constants"])], None).select("site_no", "to_id")
    return a.union(resolve.by_priority(sites(m), [(F.col("w2"), d["forms"])], None).select("site_no", "to_id"))


@query("jon_20_class_chain", _RESOLVE + " SELECT class_lc, name_lc, symbol_id FROM res WHERE slot = 'call'")
def jon_20(m):
    return _resolution(m).filter("slot = 'call'").select("class_lc", "name_lc", "symbol_id")


@query("jon_21_class_for_table", _SITES + " SELECT site_no, coalesce(c.to_id, e.to_id) AS to_id FROM sites LEFT JOIN constants c ON concat(c.key, 'Entity') = concat(w1, 'Entity') LEFT JOIN methods e ON e.key = w1 WHERE coalesce(c.to_id, e.to_id) IS NOT NULL")
def jon_21(m):
    d = dims(m)
    entity = d["constants"].select(F.concat("key", F.lit("Entity")).alias("key"), "to_id")
    return resolve.by_priority(sites(m), [(F.concat("w1", F.lit("Entity")), entity), (F.col("w1"), d["methods"])], None).select("site_no", "to_id")


@query("jon_24_builtin_by_flavor", ", up(class_lc, ancestor_lc, depth) AS (SELECT name_lc, name_lc, 0 FROM symbols WHERE kind = 'Class' UNION SELECT up.class_lc, lower(s.extends_class), depth + 1 FROM up JOIN symbols s ON s.kind = 'Class' AND s.name_lc = up.ancestor_lc WHERE s.extends_class IS NOT NULL) SELECT class_lc, s.class_flavor AS base FROM up JOIN symbols s ON s.kind = 'Class' AND s.name_lc = ancestor_lc WHERE s.class_flavor <> 'Class' QUALIFY row_number() OVER (PARTITION BY class_lc ORDER BY depth) = 1")
def jon_24(m):
    flavor = m.symbols.filter("kind = 'Class' and class_flavor != 'Class'").select(F.col("name_lc").alias("ancestor_lc"), "class_flavor")
    rows = classes.with_self(m.symbols, graph.ancestors(m.symbols)).join(flavor, "ancestor_lc")
    return rows.groupBy("class_lc").agg(F.min_by("class_flavor", "depth").alias("base"))


@query("jon_25_synthetics", " SELECT to_id AS symbol_id, count(DISTINCT from_id) AS origins, split_part(to_id, ':', 1) AS kind FROM edges WHERE to_id NOT IN (SELECT symbol_id FROM symbols WHERE kind NOT IN ('Builtin', 'TableBuiltin', 'Unresolved')) GROUP BY 1")
def jon_25(m):
    return resolve.synthetic_symbols(m.edges, m.symbols.filter(~F.col("kind").isin("Builtin", "TableBuiltin", "Unresolved")))


@query("jon_26_edge_dedup", " SELECT from_id, to_id, line, call_kind, access, count(*) - 1 AS dropped FROM edges GROUP BY 1, 2, 3, 4, 5")
def jon_26(m):
    kept = calls.dedup_edges(m.edges).select("from_id", "to_id", "line", "call_kind", "access")
    n = m.edges.groupBy("from_id", "to_id", "line", "call_kind", "access").agg((F.count("*") - 1).alias("dropped"))
    key = ["from_id", "to_id", "line", "call_kind"]
    a, b = kept.withColumn("a", F.coalesce("access", F.lit(""))), n.withColumn("a", F.coalesce("access", F.lit(""))).drop("access")
    return a.join(b, [*key, "a"]).drop("a")


@query("jon_28_table_relabel", " SELECT s_suppkey, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS owner_table FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey", plain=True)
def jon_28(m):
    ids = m.table("nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return m.table("supplier").join(ids, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.col("s_nationkey").cast("string")).alias("owner_table"))
