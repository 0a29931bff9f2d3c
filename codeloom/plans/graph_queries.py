"""Registered queries: lookups, aggregates, windows, sorts, sets, traversals, classes, coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.operators import calls, classes, graph, lookup
from codeloom.plans.registered import CHAIN, query

_SYN = "('Builtin', 'TableBuiltin', 'Unresolved')"

# ---- lookups and filters


@query("flt_01_symbol", "SELECT symbol_id, name, kind, line FROM symbols WHERE symbol_id = 'ProjectMethod:Part7'")
def flt_01(m):
    return lookup.by_id(m.symbols, "ProjectMethod:Part7").select("symbol_id", "name", "kind", "line")


@query("flt_02_by_name", "SELECT symbol_id, kind FROM symbols WHERE lower(name) = lower('economy')")
def flt_02(m):
    return lookup.by_name(m.symbols, "Economy").select("symbol_id", "kind")


@query("flt_03_symbols_in_file", "SELECT symbol_id, line FROM symbols WHERE uri = 'file:///p/Methods/4-NOT SPECIFIED.4dm'")
def flt_03(m):
    return lookup.in_file(m.symbols, "file:///p/Methods/4-NOT%20SPECIFIED.4dm").select("symbol_id", "line")


@query("flt_04_callees_callers", "SELECT 'callee' AS side, to_id AS other, line FROM edges WHERE from_id = 'ProjectMethod:Order7' UNION ALL SELECT 'caller', from_id, line FROM edges WHERE to_id = 'ProjectMethod:Part7'")
def flt_04(m):
    a = lookup.callees(m.edges, "ProjectMethod:Order7").select(F.lit("callee").alias("side"), F.col("to_id").alias("other"), "line")
    return a.union(lookup.callers(m.edges, "ProjectMethod:Part7").select(F.lit("caller"), "from_id", "line"))


@query("flt_05_reads_writes", "SELECT from_id, line, access FROM edges WHERE to_id = 'Constant:PROMO' AND access = 'read' UNION ALL SELECT from_id, line, access FROM edges WHERE to_id = 'ProjectMethod:Part7' AND access = 'write'")
def flt_05(m):
    a = lookup.callers(m.edges, "Constant:PROMO", "read").select("from_id", "line", "access")
    return a.union(lookup.callers(m.edges, "ProjectMethod:Part7", "write").select("from_id", "line", "access"))


@query("flt_06_resolve_symbol", """, hits AS (SELECT 'small' AS sel, * FROM symbols WHERE name_lc = 'small' AND kind = 'ClassGetter' UNION ALL SELECT 'asia', * FROM symbols WHERE name_lc = 'asia' UNION ALL SELECT 'economy', * FROM symbols WHERE name_lc = 'economy' AND lower(owner_class) = 'africa')
SELECT sel, CASE count(h.symbol_id) WHEN 0 THEN 'notFound' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, coalesce(string_agg(symbol_id, ',' ORDER BY symbol_seq), '') AS candidates
FROM (VALUES ('small'), ('asia'), ('economy'), ('nothing')) v(sel) LEFT JOIN hits h USING (sel) GROUP BY sel""")
def flt_06(m):
    asks = [("small", "classgetter", None), ("asia", None, None), ("economy", None, "Africa"), ("nothing", None, None)]
    out = None
    for name, kind, owner in asks:
        one = lookup.resolve_symbol(m.symbols, name, kind, owner).select(F.lit(name).alias("sel"), "status", "candidates")
        out = one if out is None else out.union(one)
    return out


@query("flt_07_lookup_by_name", f"SELECT 'R' AS name_asked, symbol_id FROM symbols WHERE name_lc = 'r' UNION ALL SELECT 'Economy', symbol_id FROM symbols WHERE name_lc = 'economy' AND kind NOT IN {_SYN}")
def flt_07(m):
    return lookup.lookup_by_name(m.symbols, "R").select(F.lit("R").alias("name_asked"), "symbol_id").union(lookup.lookup_by_name(m.symbols, "Economy").select(F.lit("Economy"), "symbol_id"))


@query("flt_08_document_symbols", "SELECT symbol_id, kind, line FROM symbols WHERE uri = 'file:///p/Classes/ASIA.4dm' AND kind NOT IN ('Builtin', 'Unresolved')")
def flt_08(m):
    return lookup.in_file(m.symbols, "file:///p/Classes/ASIA.4dm").select("symbol_id", "kind", "line")


@query("flt_09_workspace_symbols", "SELECT symbol_id, name FROM symbols WHERE regexp_matches(lower(name), '(?s)r.*d.*1') AND NOT contains(lower(name), 'bolt') AND kind = 'ProjectMethod' ORDER BY symbol_seq LIMIT 500")
def flt_09(m):
    hits = m.symbols.filter(lookup.fuzzy(F.col("name"), "rd1") & ~F.contains(F.lower("name"), F.lit("bolt")) & (F.col("kind") == "ProjectMethod"))
    return hits.orderBy("symbol_seq").limit(500).select("symbol_id", "name")


@query("flt_10_pick_list", f"SELECT symbol_id, name, coalesce(owner_class, '') AS detail FROM symbols WHERE kind NOT IN {_SYN} AND kind <> 'ProjectMethod'")
def flt_10(m):
    return m.symbols.filter(~F.col("kind").isin([*lookup.SYNTHETIC, "ProjectMethod"])).select("symbol_id", "name", F.coalesce("owner_class", F.lit("")).alias("detail"))


@query("flt_11_explorer", ", c AS (SELECT to_id, count(*) AS n FROM edges GROUP BY 1) SELECT symbol_id, CAST(coalesce(n, 0) AS BIGINT) AS n_callers FROM symbols LEFT JOIN c ON to_id = symbol_id WHERE coalesce(n, 0) >= 40 AND regexp_matches(lower(concat_ws('.', owner_class, name)), '(?s)b.*e') AND NOT contains(lower(concat_ws('.', owner_class, name)), 'ring')")
def flt_11(m):
    return lookup.matches(m.symbols, m.edges, "be -ring >=40", "with").select("symbol_id", "n_callers")


@query("flt_12_root_access", "SELECT e.to_id, e.access, count(*) AS n FROM edges e JOIN symbols s ON s.symbol_id = e.to_id WHERE s.kind IN ('ClassGetter', 'ClassSetter', 'ClassProperty', 'Alias', 'Constant', 'ProcessVariable', 'InterprocessVariable') AND e.access = 'read' GROUP BY 1, 2")
def flt_12(m):
    fields = m.symbols.filter(F.col("kind").isin(lookup.FIELD_KINDS)).select(F.col("symbol_id").alias("to_id"))
    return m.edges.filter("access = 'read'").join(fields, "to_id", "left_semi").groupBy("to_id", "access").agg(F.count("*").alias("n"))


#: A test by the default patterns: of functions and flavors, of methods, and of owner classes.
IS_TEST = "(coalesce(class_flavor = 'Test', false) OR regexp_matches(name, '^test_') OR (kind = 'ProjectMethod' AND regexp_matches(name, '^UT_')) OR coalesce(regexp_matches(owner_class, '_Test$'), false))"


@query("flt_13_test_filter", f", t AS (SELECT symbol_id FROM symbols WHERE {IS_TEST}) SELECT to_id, CAST(count(*) FILTER (from_id IN (SELECT symbol_id FROM t)) AS BIGINT) AS n_only, CAST(count(*) FILTER (from_id NOT IN (SELECT symbol_id FROM t)) AS BIGINT) AS n_exclude FROM edges GROUP BY to_id")
def flt_13(m):
    tests = m.symbols.filter(lookup.is_test()).select(F.col("symbol_id").alias("from_id"))
    only = m.edges.join(tests, "from_id", "left_semi").select("to_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    rest = m.edges.join(tests, "from_id", "left_anti").select("to_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    return only.union(rest).groupBy("to_id").agg(F.sum("a").alias("n_only"), F.sum("b").alias("n_exclude"))


@query("flt_14_is_test", f"SELECT symbol_id, {IS_TEST} AS is_test, {IS_TEST.replace('_Test$', 'A$').replace('^test_', '^helper_').replace('^UT_', 'e[0-9]+$')} AS is_own_test FROM symbols")
def flt_14(m):
    own = lookup.test_patterns("^helper_", "A$", "e[0-9]+$")
    return m.symbols.select("symbol_id", lookup.is_test().alias("is_test"), lookup.is_test(own).alias("is_own_test"))


_INVOKES = "(e.access IS NULL OR (s.kind = 'ClassGetter' AND e.access = 'read') OR (s.kind = 'ClassSetter' AND e.access = 'write'))"


@query("flt_15_invocations", f"SELECT s.kind, count(*) AS n FROM edges e JOIN symbols s ON s.symbol_id = e.to_id WHERE {_INVOKES} GROUP BY 1")
def flt_15(m):
    return lookup.is_invocation(m.edges, m.symbols).groupBy(F.col("to_kind").alias("kind")).agg(F.count("*").alias("n"))


@query("flt_16_constants_hidden", "SELECT e.from_id, count(*) AS n FROM edges e JOIN symbols s ON s.symbol_id = e.to_id WHERE s.kind <> 'Constant' GROUP BY 1")
def flt_16(m):
    shown = m.symbols.filter("kind != 'Constant'").select(F.col("symbol_id").alias("to_id"))
    return m.edges.join(shown, "to_id").groupBy("from_id").agg(F.count("*").alias("n"))


@query("flt_17_trace_categories", """ SELECT category, count(*) AS n FROM (SELECT CASE WHEN kind IN ('ProjectMethod', 'DatabaseMethod') THEN 'methods' WHEN kind = 'ClassFunction' THEN 'functions' WHEN kind IN ('ClassGetter', 'ClassProperty', 'Alias') AND coalesce(access, 'read') = 'read' THEN 'reads' WHEN kind IN ('ClassSetter', 'ClassProperty', 'Alias', 'ClassGetter') AND coalesce(access, 'read') = 'write' THEN 'writes' WHEN kind IN ('Class', 'ClassConstructor') THEN 'classes' WHEN kind IN ('Constant', 'BuiltinConstant') THEN 'constants' WHEN kind = 'Unresolved' THEN 'unresolved' END AS category FROM edges JOIN symbols ON symbol_id = to_id) GROUP BY 1""")
def flt_17(m):
    kinds = m.symbols.select(F.col("symbol_id").alias("to_id"), "kind")
    return m.edges.join(kinds, "to_id").groupBy(lookup.trace_category(F.col("kind"), F.col("access")).alias("category")).agg(F.count("*").alias("n"))


@query("flt_18_trace_name_filter", ", r(id) AS (SELECT symbol_id FROM symbols WHERE contains(lower(concat_ws('.', owner_class, name)), 'economy') UNION SELECT e.from_id FROM r JOIN edges e ON e.to_id = r.id) SELECT id FROM r")
def flt_18(m):
    hits = m.symbols.filter(F.contains(F.lower(F.concat_ws(".", "owner_class", "name")), F.lit("economy"))).select(F.col("symbol_id").alias("id"))
    return graph.reachable(m.edges, hits, None, "backward").select("id")


@query("flt_19_free_completion", "SELECT symbol_id, name FROM symbols WHERE kind IN ('ProjectMethod', 'DatabaseMethod', 'ComponentMethod', 'Class', 'Constant', 'BuiltinConstant', 'PluginCommand', 'Builtin', 'ProcessVariable', 'InterprocessVariable') AND starts_with(name_lc, 'order1') ORDER BY symbol_seq LIMIT 200")
def flt_19(m):
    return m.symbols.filter(F.col("kind").isin(lookup.COMPLETION_KINDS) & F.col("name_lc").startswith("order1")).orderBy("symbol_seq").limit(200).select("symbol_id", "name")


@query("flt_20_range_filter", "SELECT edge_seq, from_id, to_id, line FROM edges WHERE from_id = 'ProjectMethod:Order7' AND line BETWEEN 2 AND 5")
def flt_20(m):
    return lookup.callees(m.edges, "ProjectMethod:Order7").filter(F.col("line").between(2, 5)).select("edge_seq", "from_id", "to_id", "line")


@query("flt_21_kind_sets", "SELECT symbol_id, kind IN ('ClassFunction', 'ClassGetter', 'ClassSetter') AS is_function, kind IN ('ClassFunction', 'ClassGetter', 'ClassSetter', 'ClassProperty', 'Alias', 'ClassConstructor') AS is_member, kind IN ('ProjectMethod', 'DatabaseMethod', 'ComponentMethod', 'ClassFunction', 'ClassConstructor', 'PluginCommand') AS is_invocable FROM symbols")
def flt_21(m):
    k = F.col("kind")
    return m.symbols.select("symbol_id", k.isin(lookup.FUNCTION_KINDS).alias("is_function"), k.isin(lookup.CLASS_MEMBER_KINDS).alias("is_member"), k.isin(lookup.INVOCABLE_KINDS).alias("is_invocable"))


# ---- aggregates


@query("agg_01_raw_counts", ", i AS (SELECT to_id, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT from_id, count(*) AS n FROM edges GROUP BY 1) SELECT symbol_id, CAST(coalesce(i.n, 0) AS BIGINT) AS callers, CAST(coalesce(o.n, 0) AS BIGINT) AS callees FROM symbols LEFT JOIN i ON i.to_id = symbol_id LEFT JOIN o ON o.from_id = symbol_id")
def agg_01(m):
    return m.symbols.select("symbol_id").join(calls.raw_counts(m.edges), "symbol_id", "left").na.fill(0)


@query("agg_02_site_counts", " SELECT to_id AS symbol_id, count(*) AS n_raw, count(DISTINCT concat(from_id, '|', line, '|', coalesce(column_no, -1))) AS n_sites, count(DISTINCT from_id) AS n_others FROM edges GROUP BY 1")
def agg_02(m):
    return calls.site_counts(m.edges, "to_id")


@query("agg_03_hover_counts", """, f AS (SELECT to_id, from_id, count(*) AS n, min(edge_seq) AS first_seq FROM edges GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY first_seq, from_id) AS k FROM f)
SELECT to_id AS symbol_id, CAST(count(*) AS BIGINT) AS callers, CAST(sum(n) AS BIGINT) AS sites, string_agg(from_id, ',' ORDER BY k) FILTER (k <= 5) AS top FROM r GROUP BY 1""")
def agg_03(m):
    per = m.edges.groupBy("to_id", "from_id").agg(F.count("*").alias("n"), F.min("edge_seq").alias("first_seq"))
    rank = per.withColumn("k", F.row_number().over(Window.partitionBy("to_id").orderBy("first_seq", "from_id")))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "from_id")))), lambda x: x["from_id"]), ",")
    return rank.groupBy(F.col("to_id").alias("symbol_id")).agg(F.count("*").alias("callers"), F.sum("n").alias("sites"), top.alias("top"))


@query("agg_04_usage", " SELECT to_id AS symbol_id, count(*) FILTER (access = 'read') AS n_reads, count(*) FILTER (access = 'write') AS n_writes FROM edges WHERE access IS NOT NULL GROUP BY 1")
def agg_04(m):
    return calls.usage_counts(m.edges)


@query("agg_05_distinct_ends", " SELECT from_id AS symbol_id, count(DISTINCT to_id) AS n FROM edges GROUP BY 1")
def agg_05(m):
    return m.edges.select("from_id", "to_id").distinct().groupBy(F.col("from_id").alias("symbol_id")).agg(F.count("*").alias("n"))


@query("agg_06_tests_among_callers", f", t AS (SELECT symbol_id FROM symbols WHERE {IS_TEST}) SELECT to_id AS symbol_id, count(DISTINCT from_id) FILTER (from_id IN (SELECT symbol_id FROM t)) AS tests, count(DISTINCT from_id) FILTER (from_id NOT IN (SELECT symbol_id FROM t)) AS others FROM edges GROUP BY 1")
def agg_06(m):
    tests = m.symbols.filter(lookup.is_test()).select(F.col("symbol_id").alias("from_id"), F.lit(1).alias("t"))
    pairs = m.edges.select("to_id", "from_id").distinct().join(tests, "from_id", "left")
    return pairs.groupBy(F.col("to_id").alias("symbol_id")).agg(F.count("t").alias("tests"), F.count(F.when(F.col("t").isNull(), 1)).alias("others"))


@query("agg_07_call_hierarchy", " SELECT to_id AS symbol_id, from_id AS other_id, string_agg(line, ',' ORDER BY edge_seq, line) AS lines, count(*) AS n_sites FROM edges GROUP BY 1, 2")
def agg_07(m):
    return calls.grouped_by_end(m.edges, "to_id")


@query("agg_08_call_tree_groups", ", g AS (SELECT from_id, to_id, count(*) AS n FROM edges GROUP BY 1, 2) SELECT from_id, to_id, n, row_number() OVER (PARTITION BY from_id ORDER BY n >= 2 DESC, name, to_id) AS place FROM g JOIN symbols ON symbol_id = to_id")
def agg_08(m):
    names = m.symbols.select(F.col("symbol_id").alias("to_id"), "name")
    g = m.edges.groupBy("from_id", "to_id").agg(F.count("*").alias("n")).join(names, "to_id")
    w = Window.partitionBy("from_id").orderBy((F.col("n") >= 2).desc(), "name", "to_id")
    return g.select("from_id", "to_id", "n", F.row_number().over(w).cast("long").alias("place"))


@query("agg_09_bundle_rollup", " SELECT owner_class AS bundle, count(*) AS n_edges, count(DISTINCT from_id) AS n_callers, count(DISTINCT to_id) AS n_members FROM edges JOIN symbols ON symbol_id = to_id WHERE owner_class IS NOT NULL GROUP BY 1")
def agg_09(m):
    bridge = m.symbols.filter("owner_class is not null").select(F.col("symbol_id").alias("to_id"), F.col("owner_class").alias("bundle"))
    return m.edges.join(bridge, "to_id").groupBy("bundle").agg(F.count("*").alias("n_edges"), F.countDistinct("from_id").alias("n_callers"), F.countDistinct("to_id").alias("n_members"))


@query("agg_10_subgroups", ", g AS (SELECT from_id, to_id, count(*) AS n FROM edges GROUP BY 1, 2) SELECT from_id, to_id, n FROM g QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY n DESC, to_id) <= 3")
def agg_10(m):
    g = m.edges.groupBy("from_id", "to_id").agg(F.count("*").alias("n"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("from_id").orderBy(F.desc("n"), "to_id"))).filter("r <= 3").drop("r")


KIND_ORDER = ["ProjectMethod", "Class", "ClassFunction", "ClassGetter", "ClassProperty", "Constant", "Builtin", "Unresolved"]


@query("agg_11_kind_tallies", " SELECT place, kind, count(*) AS n FROM symbols JOIN (VALUES (0, 'ProjectMethod'), (1, 'Class'), (2, 'ClassFunction'), (3, 'ClassGetter'), (4, 'ClassProperty'), (5, 'Constant'), (6, 'Builtin'), (7, 'Unresolved')) o(place, kind) USING (kind) GROUP BY 1, 2")
def agg_11(m):
    order = m.spark.createDataFrame(list(enumerate(KIND_ORDER)), "place int, kind string")
    return m.symbols.groupBy("kind").agg(F.count("*").alias("n")).join(F.broadcast(order), "kind").select("place", "kind", "n")


@query("agg_12_group_partition", """, k AS (SELECT kind, symbol_id, CASE WHEN contains(name, '_') AND position('_' IN name) > 1 THEN substr(name, 1, position('_' IN name) - 1) END AS pre FROM symbols WHERE kind = 'ProjectMethod'), c AS (SELECT kind, pre, count(*) AS n FROM k GROUP BY 1, 2)
SELECT kind, CASE WHEN n > 1 AND pre IS NOT NULL THEN pre END AS group_key, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2 UNION ALL SELECT kind, 'ALL', count(*) FROM k GROUP BY 1""")
def agg_12(m):
    at = F.instr("name", "_")
    rows = m.symbols.filter("kind = 'ProjectMethod'").select("kind", F.when(at > 1, F.expr("substring(name, 1, instr(name, '_') - 1)")).alias("pre"))
    sizes = rows.groupBy("kind", "pre").agg(F.count("*").alias("n"))
    parts = sizes.groupBy("kind", F.when((F.col("n") > 1) & F.col("pre").isNotNull(), F.col("pre")).alias("group_key")).agg(F.sum("n").alias("n"))
    return parts.union(rows.groupBy("kind").agg(F.lit("ALL").alias("group_key"), F.count("*").alias("n")).select("kind", "group_key", "n"))


@query("agg_15_last_result", " SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY 1, 2", plain=True)
def agg_15(m):
    return m.table("events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("agg_14_result_totals", " SELECT user_id AS suite, count(*) AS tests, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS skipped, count(*) FILTER (event_type = 'view' AND value < 5) AS failures, round(sum(value), 2) AS duration FROM events GROUP BY 1", plain=True)
def agg_14(m):
    kind = F.col("event_type")
    return m.table("events").groupBy(F.col("user_id").alias("suite")).agg(F.count("*").alias("tests"), F.count(F.when(kind == "error", 1)).alias("errors"), F.count(F.when(kind == "signup", 1)).alias("skipped"), F.count(F.when((kind == "view") & (F.col("value") < 5), 1)).alias("failures"), F.round(F.sum("value"), 2).alias("duration"))


@query("agg_16_class_lens", CHAIN + ", sub AS (SELECT ancestor_lc, count(*) AS total, count(*) FILTER (depth = 1) AS direct FROM up GROUP BY 1), ov AS (SELECT u.ancestor_lc AS a, count(*) AS n FROM up u JOIN funcs b ON b.owner_lc = u.ancestor_lc JOIN funcs d ON d.owner_lc = u.class_lc AND d.name_lc = b.name_lc GROUP BY 1) SELECT s.symbol_id, CAST(coalesce(direct, 0) AS BIGINT) AS direct, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(ov.n, 0) AS BIGINT) AS n_overrides FROM symbols s LEFT JOIN sub ON sub.ancestor_lc = s.name_lc LEFT JOIN ov ON ov.a = s.name_lc WHERE s.kind = 'Class'")
def agg_16(m):
    up = graph.ancestors(m.symbols)
    sub = up.groupBy(F.col("ancestor_lc").alias("name_lc")).agg(F.count(F.when(F.col("depth") == 1, 1)).alias("direct"), F.count("*").alias("total"))
    owners = m.symbols.select(F.col("symbol_id").alias("base_id"), F.lower("owner_class").alias("name_lc"))
    ov = classes.overrides(m.symbols, up).join(owners, "base_id").groupBy("name_lc").agg(F.count("*").alias("n_overrides"))
    return m.symbols.filter("kind = 'Class'").join(sub, "name_lc", "left").join(ov, "name_lc", "left").na.fill(0, ["direct", "total", "n_overrides"]).select("symbol_id", "direct", "total", "n_overrides")


@query("agg_17_members_per_line", " SELECT uri, line, count(*) AS n FROM symbols WHERE kind IN ('ClassGetter', 'ClassSetter', 'ClassProperty', 'Alias') GROUP BY 1, 2")
def agg_17(m):
    return m.symbols.filter(F.col("kind").isin("ClassGetter", "ClassSetter", "ClassProperty", "Alias")).groupBy("uri", "line").agg(F.count("*").alias("n"))


@query("agg_18_index_counts", " SELECT 'symbols' AS what, kind AS key, count(*) AS n FROM symbols GROUP BY 2 UNION ALL SELECT 'edges', CASE WHEN resolved THEN 'resolved' ELSE 'unresolved' END, count(*) FROM edges GROUP BY 2")
def agg_18(m):
    a = m.symbols.groupBy(F.lit("symbols").alias("what"), F.col("kind").alias("key")).agg(F.count("*").alias("n"))
    return a.union(m.edges.groupBy(F.lit("edges"), F.when(F.col("resolved"), "resolved").otherwise("unresolved")).agg(F.count("*")))


@query("agg_19_refcounts", " SELECT count(*) AS owners, (SELECT count(*) FROM (SELECT DISTINCT to_id, from_id FROM edges WHERE starts_with(to_id, 'Unresolved:'))) AS origins FROM (SELECT DISTINCT from_id, to_id FROM edges WHERE starts_with(to_id, 'Unresolved:'))")
def agg_19(m):
    synth = m.edges.filter(F.col("to_id").startswith("Unresolved:")).select("from_id", "to_id").distinct()
    origins = synth.groupBy("to_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("origins"))
    return synth.agg(F.count("*").alias("owners")).crossJoin(origins)


@query("agg_20_name_buckets", " SELECT key, count(*) AS n FROM (SELECT DISTINCT edge_seq, column_no, unnest([lower(s.name), lower(coalesce(s.owner_class, s.kind))]) AS key FROM edges JOIN symbols s ON s.symbol_id = to_id) GROUP BY 1")
def agg_20(m):
    keys = m.symbols.select(F.col("symbol_id").alias("to_id"), F.array(F.lower("name"), F.lower(F.coalesce("owner_class", "kind"))).alias("keys"))
    return m.edges.join(keys, "to_id").select("edge_seq", "column_no", F.explode("keys").alias("key")).distinct().groupBy("key").agg(F.count("*").alias("n"))


# ---- windows

_SITE = "row_number() OVER (PARTITION BY to_id, from_id, line, coalesce(column_no, -1) ORDER BY resolved DESC, edge_seq, column_no, call_kind, raw, access, receiver)"


@query("win_01_site_dedup", f" SELECT from_id, to_id, line, column_no, resolved, call_kind FROM edges QUALIFY {_SITE} = 1")
def win_01(m):
    return calls.dedup_sites(m.edges, "from_id").select("from_id", "to_id", "line", "column_no", "resolved", "call_kind")


@query("win_02_nearest_ancestor", CHAIN + " SELECT u.class_lc, f.name_lc, f.symbol_id, u.depth FROM up u JOIN funcs f ON f.owner_lc = u.ancestor_lc QUALIFY row_number() OVER (PARTITION BY u.class_lc, f.name_lc ORDER BY u.depth, f.symbol_seq) = 1")
def win_02(m):
    return classes.inherited(m.symbols, graph.ancestors(m.symbols))


@query("win_03_first_wins", " SELECT name_lc, symbol_id FROM symbols QUALIFY row_number() OVER (PARTITION BY name_lc ORDER BY symbol_seq) = 1")
def win_03(m):
    return m.symbols.groupBy("name_lc").agg(F.min_by("symbol_id", "symbol_seq").alias("symbol_id"))


@query("win_04_cap_per_file", " SELECT uri, symbol_id FROM symbols QUALIFY row_number() OVER (PARTITION BY uri ORDER BY symbol_seq) <= 100")
def win_04(m):
    return m.symbols.withColumn("r", F.row_number().over(Window.partitionBy("uri").orderBy("symbol_seq"))).filter("r <= 100").select("uri", "symbol_id")


@query("win_05_enclosing_symbol", " SELECT c.cursor, arg_min(symbol_id, symbol_seq) FILTER (line = top) AS symbol_id FROM (SELECT cursor, s.*, max(line) OVER (PARTITION BY cursor) AS top FROM (VALUES (0), (5), (103), (999)) c(cursor) JOIN symbols s ON s.uri = 'file:///p/Classes/ASIA.4dm' AND s.line <= c.cursor) c GROUP BY 1")
def win_05(m):
    cursors = m.spark.createDataFrame([(0,), (5,), (103,), (999,)], "cursor int")
    inside = m.symbols.filter(F.col("uri") == "file:///p/Classes/ASIA.4dm")
    hit = inside.join(F.broadcast(cursors), F.col("line") <= F.col("cursor"))
    return hit.groupBy("cursor").agg(F.max_by("symbol_id", F.struct("line", -F.col("symbol_seq"))).alias("symbol_id"))


@query("win_06_body_owner", ", l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS no, a FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)), x AS (SELECT doc_id, no, CASE WHEN length(a[no]) > 60 THEN no END AS decl FROM l) SELECT doc_id, CAST(no AS BIGINT) AS line_no, CAST(max(decl) OVER (PARTITION BY doc_id ORDER BY no) AS BIGINT) AS owner_line FROM x")
def win_06(m):
    lines = m.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t"))
    w = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.last(F.when(F.length("t") > 60, F.col("p") + 1), True).over(w).cast("long").alias("owner_line"))


@query("win_07_row_budget", " SELECT from_id, to_id, line FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY line, coalesce(column_no, 0), edge_seq, to_id) AS r FROM edges) WHERE r <= 4")
def win_07(m):
    w = Window.partitionBy("from_id").orderBy("line", F.coalesce("column_no", F.lit(0)), "edge_seq", "to_id")
    return m.edges.withColumn("r", F.row_number().over(w)).filter("r <= 4").select("from_id", "to_id", "line")


@query("win_08_token_deltas", ", t AS (SELECT from_id, line, coalesce(column_no, 0) AS c, edge_seq, lag(line) OVER w AS pl, lag(coalesce(column_no, 0)) OVER w AS pc FROM edges WINDOW w AS (PARTITION BY from_id ORDER BY line, coalesce(column_no, 0), edge_seq, to_id)) SELECT from_id, CAST(sum(line - coalesce(pl, 0)) AS BIGINT) AS sum_line, CAST(sum(CASE WHEN pl = line THEN c - pc ELSE c END) AS BIGINT) AS sum_start FROM t GROUP BY 1")
def win_08(m):
    c = F.coalesce("column_no", F.lit(0))
    w = Window.partitionBy("from_id").orderBy("line", c, "edge_seq", "to_id")
    t = m.edges.select("from_id", "line", c.alias("c"), F.lag("line").over(w).alias("pl"), F.lag(c).over(w).alias("pc"))
    return t.groupBy("from_id").agg(F.sum(F.col("line") - F.coalesce("pl", F.lit(0))).alias("sum_line"), F.sum(F.when(F.col("pl") == F.col("line"), F.col("c") - F.col("pc")).otherwise(F.col("c"))).alias("sum_start"))


@query("win_09_consecutive_duplicates", ", t AS (SELECT from_id, line, column_no, lag(line) OVER w AS pl, lag(coalesce(column_no, -1)) OVER w AS pc FROM edges WINDOW w AS (PARTITION BY from_id ORDER BY line, coalesce(column_no, -1), edge_seq, to_id)) SELECT from_id, count(*) AS n FROM t WHERE pl IS NULL OR pl <> line OR pc <> coalesce(column_no, -1) GROUP BY 1")
def win_09(m):
    c = F.coalesce("column_no", F.lit(-1))
    w = Window.partitionBy("from_id").orderBy("line", c, "edge_seq", "to_id")
    span = F.struct(F.col("line").alias("l"), c.alias("c"))
    t = m.edges.select("from_id", span.alias("s"), F.lag(span).over(w).alias("p"))
    return t.filter(F.col("p").isNull() | (F.col("p") != F.col("s"))).groupBy("from_id").agg(F.count("*").alias("n"))


@query("win_10_comment_run", ", l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS no, a FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)), x AS (SELECT doc_id, no, length(a[no]) <= 80 AS c, max(CASE WHEN length(a[no]) > 80 THEN no END) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM l) SELECT doc_id, CAST(no AS BIGINT) AS body_line, CAST(no - 1 - coalesce(stop, 0) AS BIGINT) AS run FROM x WHERE NOT c")
def win_10(m):
    lines = m.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).withColumn("no", F.col("p") + 1)
    w = Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.last(F.when(F.length("t") > 80, F.col("no")), True).over(w)
    return lines.select("doc_id", "no", "t", stop.alias("stop")).filter(F.length("t") > 80).select("doc_id", F.col("no").cast("long").alias("body_line"), (F.col("no") - 1 - F.coalesce("stop", F.lit(0))).cast("long").alias("run"))


# ---- sorts


@query("srt_01_search_rank", " SELECT rank, symbol_id, (SELECT count(*) FROM symbols WHERE regexp_matches(name_lc, '(?s)e.*c.*o')) AS total FROM (SELECT *, CASE WHEN name_lc = 'eco' THEN 0 WHEN starts_with(name_lc, 'eco') THEN 1 ELSE 2 END AS rank FROM symbols WHERE regexp_matches(name_lc, '(?s)e.*c.*o')) ORDER BY rank, name_lc, symbol_seq LIMIT 30")
def srt_01(m):
    return search(m.symbols, "eco", None, 30).select("rank", "symbol_id", "total")


def search(symbols, text: str, kind: str | None, limit: int):
    """Exact names, then prefixes, then subsequences; by name in the UNICODE collation; with the count before the limit."""
    q = text.lower()
    hits = symbols.filter(lookup.fuzzy(F.col("name"), q))
    if kind:
        hits = hits.filter(F.lower("kind") == kind.lower())
    rank = F.when(F.col("name_lc") == q, 0).when(F.col("name_lc").startswith(q), 1).otherwise(2)
    total = hits.agg(F.count("*").alias("total"))
    top = hits.withColumn("rank", rank).orderBy("rank", F.expr("collate(name_lc, 'UNICODE')"), "symbol_seq").limit(limit)
    return top.crossJoin(F.broadcast(total))


@query("srt_02_first_callers", " SELECT from_id, line FROM edges WHERE to_id = 'ProjectMethod:Part7' ORDER BY edge_seq, line, column_no LIMIT 100")
def srt_02(m):
    return lookup.callers(m.edges, "ProjectMethod:Part7").orderBy("edge_seq", "line", "column_no").limit(100).select("from_id", "line")


@query("srt_03_members_by_line", " SELECT owner_class, symbol_id, row_number() OVER (PARTITION BY owner_class ORDER BY line, name) AS place FROM symbols WHERE owner_class IS NOT NULL")
def srt_03(m):
    w = Window.partitionBy("owner_class").orderBy("line", "name")
    return m.symbols.filter("owner_class is not null").select("owner_class", "symbol_id", F.row_number().over(w).cast("long").alias("place"))


@query("srt_04_instantiations_order", " SELECT class_lc, from_id, line, row_number() OVER (PARTITION BY class_lc ORDER BY from_id, line) AS place FROM (SELECT DISTINCT s.name_lc AS class_lc, from_id, edges.line FROM edges JOIN symbols s ON s.symbol_id = to_id AND s.kind = 'Class')")
def srt_04(m):
    rows = classes.instantiations(m.symbols, m.edges)
    return rows.select("class_lc", "from_id", "line", F.row_number().over(Window.partitionBy("class_lc").orderBy("from_id", "line")).cast("long").alias("place"))


@query("srt_05_descendants_by_name", CHAIN + " SELECT ancestor_lc, class_lc, row_number() OVER (PARTITION BY ancestor_lc ORDER BY class_lc) AS place FROM up")
def srt_05(m):
    return graph.ancestors(m.symbols).select("ancestor_lc", "class_lc", F.row_number().over(Window.partitionBy("ancestor_lc").orderBy("class_lc")).cast("long").alias("place"))


@query("srt_06_trace_order", " SELECT from_id, string_agg(to_id, ',' ORDER BY line, coalesce(column_no, 0), edge_seq, to_id) AS row_order FROM edges GROUP BY 1")
def srt_06(m):
    key = F.struct("line", F.coalesce("column_no", F.lit(0)).alias("c"), "edge_seq", "to_id")
    return m.edges.groupBy("from_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["to_id"]), ",").alias("row_order"))


@query("srt_07_explorer_sort", ", c AS (SELECT to_id, count(*) AS n FROM edges GROUP BY 1) SELECT symbol_id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM symbols LEFT JOIN c ON to_id = symbol_id ORDER BY n DESC NULLS LAST, name, symbol_seq LIMIT 100")
def srt_07(m):
    c = m.edges.groupBy(F.col("to_id").alias("symbol_id")).agg(F.count("*").alias("n"))
    return m.symbols.join(c, "symbol_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy(F.desc("n"), "name", "symbol_seq").limit(100).select("symbol_id", "n")


@query("srt_08_tokens_by_place", " SELECT from_id, to_id, line, column_no FROM edges WHERE from_id = 'ProjectMethod:Part0' ORDER BY line, column_no")
def srt_08(m):
    return lookup.callees(m.edges, "ProjectMethod:Part0").orderBy("line", "column_no").select("from_id", "to_id", "line", "column_no")


@query("srt_10_caps", " (SELECT 'completion' AS what, symbol_id FROM symbols WHERE kind = 'ProjectMethod' ORDER BY symbol_seq LIMIT 200) UNION ALL (SELECT 'members', symbol_id FROM symbols WHERE owner_class IS NOT NULL ORDER BY symbol_seq LIMIT 300) UNION ALL (SELECT 'workspace', symbol_id FROM symbols ORDER BY symbol_seq LIMIT 500)")
def srt_10(m):
    def top(what, rows, n):
        return rows.orderBy("symbol_seq").limit(n).select(F.lit(what).alias("what"), "symbol_id")

    return top("completion", m.symbols.filter("kind = 'ProjectMethod'"), 200).union(top("members", m.symbols.filter("owner_class is not null"), 300)).union(top("workspace", m.symbols, 500))


# ---- sets


@query("set_01_union", " SELECT kind, count(*) AS n FROM (SELECT kind, symbol_id FROM symbols WHERE kind = 'Class' UNION SELECT kind, symbol_id FROM symbols WHERE owner_class IS NOT NULL OR kind = 'Class') GROUP BY 1")
def set_01(m):
    a = m.symbols.filter("kind = 'Class'").select("kind", "symbol_id")
    return a.unionByName(m.symbols.filter("owner_class is not null or kind = 'Class'").select("kind", "symbol_id"), allowMissingColumns=True).distinct().groupBy("kind").agg(F.count("*").alias("n"))


@query("set_02_visited_difference", " SELECT DISTINCT to_id AS id FROM edges WHERE to_id NOT IN (SELECT from_id FROM edges)")
def set_02(m):
    return m.edges.select(F.col("to_id").alias("id")).distinct().join(m.edges.select(F.col("from_id").alias("id")), "id", "left_anti")


@query("set_03_file_set_equality", " SELECT (SELECT count(*) FROM (SELECT uri FROM symbols WHERE kind = 'Class' EXCEPT SELECT uri FROM symbols WHERE owner_class IS NOT NULL)) + (SELECT count(*) FROM (SELECT uri FROM symbols WHERE owner_class IS NOT NULL EXCEPT SELECT uri FROM symbols WHERE kind = 'Class')) AS n_different")
def set_03(m):
    a = m.symbols.filter("kind = 'Class'").select("uri").distinct()
    b = m.symbols.filter("owner_class is not null").select("uri").distinct()
    return a.exceptAll(b).union(b.exceptAll(a)).agg(F.count("*").alias("n_different"))


@query("set_04_map_equality", ", a AS (SELECT name AS k, return_type AS v FROM symbols WHERE owner_class = 'ASIA'), b AS (SELECT name AS k, return_type AS v FROM symbols WHERE owner_class = 'AMERICA') SELECT k, a.v IS NOT DISTINCT FROM b.v AS same FROM a FULL JOIN b USING (k)")
def set_04(m):
    a = m.symbols.filter("owner_class = 'ASIA'").select(F.col("name").alias("k"), F.col("return_type").alias("a"))
    b = m.symbols.filter("owner_class = 'AMERICA'").select(F.col("name").alias("k"), F.col("return_type").alias("b"))
    return a.join(b, "k", "full").select("k", F.col("a").eqNullSafe(F.col("b")).alias("same"))


@query("set_05_name_key_union", " SELECT name_lc FROM symbols WHERE kind = 'Class' UNION SELECT name_lc FROM symbols WHERE kind = 'Constant'")
def set_05(m):
    return m.symbols.filter("kind = 'Class'").select("name_lc").union(m.symbols.filter("kind = 'Constant'").select("name_lc")).distinct()


@query("set_06_constant_names", " SELECT DISTINCT lower(name) AS name_lc FROM symbols WHERE kind IN ('Constant', 'BuiltinConstant', 'ProcessVariable')")
def set_06(m):
    return m.symbols.filter(F.col("kind").isin("Constant", "BuiltinConstant", "ProcessVariable")).select(F.lower("name").alias("name_lc")).distinct()


@query("set_07_shadowed", CHAIN + ", inh AS (SELECT u.class_lc, f.name_lc, f.symbol_id, row_number() OVER (PARTITION BY u.class_lc, f.name_lc ORDER BY u.depth, f.symbol_seq) AS r FROM up u JOIN funcs f ON f.owner_lc = u.ancestor_lc) SELECT class_lc, inh.name_lc, inh.symbol_id FROM inh WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM symbols o WHERE lower(o.owner_class) = inh.class_lc AND o.name_lc = inh.name_lc)")
def set_07(m):
    own = classes.members(m.symbols).select(F.col("owner_lc").alias("class_lc"), "name_lc")
    return classes.inherited(m.symbols, graph.ancestors(m.symbols)).join(own, ["class_lc", "name_lc"], "left_anti").select("class_lc", "name_lc", "symbol_id")


@query("set_08_overlap_override", ", a AS (SELECT from_id, line, column_no AS s, column_no + 4 AS e, edge_seq FROM edges WHERE starts_with(from_id, 'ProjectMethod:Order') AND column_no IS NOT NULL AND NOT resolved), b AS (SELECT from_id, line, column_no AS s, column_no + 6 AS e FROM edges WHERE starts_with(from_id, 'ProjectMethod:Order') AND column_no IS NOT NULL AND resolved) SELECT from_id, line, s, 'lex' AS layer FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.from_id = a.from_id AND b.line = a.line AND a.s < b.e AND b.s < a.e) UNION ALL SELECT from_id, line, s, 'symbol' FROM b")
def set_08(m):
    rows = m.edges.filter(F.col("from_id").startswith("ProjectMethod:Order") & F.col("column_no").isNotNull())
    lex = rows.filter("not resolved").select("from_id", "line", F.col("column_no").alias("s"), (F.col("column_no") + 4).alias("e"))
    own = rows.filter("resolved").select("from_id", "line", F.col("column_no").alias("s"), (F.col("column_no") + 6).alias("e"))
    b = own.alias("b")
    a = lex.alias("a")
    free = a.join(b, (F.col("a.from_id") == F.col("b.from_id")) & (F.col("a.line") == F.col("b.line")) & (F.col("a.s") < F.col("b.e")) & (F.col("b.s") < F.col("a.e")), "left_anti")
    return free.select("from_id", "line", "s", F.lit("lex").alias("layer")).union(own.select("from_id", "line", "s", F.lit("symbol")))
