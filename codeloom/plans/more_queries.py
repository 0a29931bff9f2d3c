"""Registered queries: tokens, declarations, results, ranges, sinks and tree views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.functions import tokens
from codeloom.operators import calls, classes, graph, lookup, resolve
from codeloom.plans.registered import query
from codeloom.plans.resolution_queries import _SITES, dims, sites
from codeloom.plans.tables import stored
from codeloom.plans.traversal_queries import _RESOLVE
from codeloom.sources import declared


def _lined(m):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("// note\nC_LONGINT("), F.lower("p_type"), F.lit(";<>g"), k, F.lit(")\nIf ($a>1) /* open\nstill */ $b:=[T]f+"), k, F.lit("\nC_TEXT(M"), k, F.lit(";$0;$1;${2})\nEnd if"))
    return m.table("part").select("p_partkey", F.concat(F.lit("Methods/"), F.when(F.col("p_partkey") % 9 == 0, "Compiler_").otherwise(""), k, F.lit(".4dm")).alias("rel_path"), text.alias("content"))


@query("txt_04_tokens", "SELECT p_partkey, kind, n FROM part, (VALUES ('comment', 3), ('keyword', 2), ('operator', 13), ('localVar', 2), ('interprocessVar', 1), ('identifier', 4), ('number', 2), ('fieldRef', 1), ('parameter', 3)) k(kind, n)", plain=True)
def txt_04(m):
    rows = tokens.tokens_table(_lined(m), "p_partkey", "content")
    return rows.groupBy("p_partkey", "kind").agg(F.count("*").alias("n"))


@query("src_09_variables", "SELECT 'interprocess' AS scope, concat('g', p_partkey) AS name, 'LONGINT' AS type FROM part UNION ALL SELECT DISTINCT 'process', lower(p_type), 'LONGINT' FROM part", plain=True)
def src_09(m):
    return declared.variables(_lined(m)).select("scope", "name", "type")


@query("src_10_compiler_types", "SELECT concat('M', p_partkey) AS method, 'TEXT' AS return_type, 'TEXT' AS first_param, 2 AS variadic_from FROM part", plain=True)
def src_10(m):
    out = declared.compiler_types(_lined(m))
    return out.select("method", "return_type", F.try_element_at("params", F.lit(1)).alias("first_param"), "variadic_from").filter("method like 'M%'")


@query("src_13_test_results", "SELECT CAST(user_id AS VARCHAR) AS suite, concat('t', event_id) AS name, CASE event_type WHEN 'signup' THEN 'skipped' WHEN 'error' THEN 'errored' WHEN 'view' THEN 'failed' ELSE 'passed' END AS status, CASE WHEN event_type = 'view' THEN 'no' END AS message FROM events", plain=True)
def src_13(m):
    kind = F.col("event_type")
    content = F.concat(F.lit('﻿{"suite":"'), F.col("user_id").cast("string"), F.lit('","tests":[{"name":"t'), F.col("event_id").cast("string"), F.lit('","passed":'), F.when(kind == "view", "false").otherwise("true"), F.lit(',"skipped":'), F.when(kind == "signup", "true").otherwise("false"), F.when(kind == "error", ',"runtimeErrors":[{"message":"e"}]').otherwise(""), F.when(kind == "view", ',"assertions":[{"passed":true,"message":"x"},{"passed":false,"message":"no"}]').otherwise(""), F.lit("}]}"))
    return declared.test_results(m.table("events").select(content.alias("content"))).select("suite", "name", "status", "message")


@query("src_16_command_catalog", " SELECT symbol_id FROM symbols WHERE name_lc IN (SELECT lower(p_type) FROM part)")
def src_16(m):
    catalog = m.table("part").select(F.lower("p_type").alias("name_lc")).distinct()
    return m.symbols.join(catalog, "name_lc", "left_semi").select("symbol_id")


@query("snk_04_diagnostics_push", " SELECT s.uri, least(count(*), 100) AS n FROM edges e JOIN symbols s ON s.symbol_id = e.from_id WHERE NOT e.resolved GROUP BY 1")
def snk_04(m):
    src = m.symbols.select(F.col("symbol_id").alias("from_id"), "uri")
    rows = m.edges.filter("not resolved").join(src, "from_id")
    w = Window.partitionBy("uri").orderBy("edge_seq", "column_no")
    return rows.withColumn("r", F.row_number().over(w)).filter("r <= 100").groupBy("uri").agg(F.count("*").alias("n"))


@query("snk_05_semantic_token_deltas", ", t AS (SELECT from_id, line, coalesce(column_no, 0) AS c, row_number() OVER w AS k, lag(line, 1, 0) OVER w AS pl, lag(coalesce(column_no, 0), 1, 0) OVER w AS pc FROM edges WINDOW w AS (PARTITION BY from_id ORDER BY line, coalesce(column_no, 0), edge_seq, to_id)) SELECT from_id, k, CAST(line - pl AS BIGINT) AS delta_line, CAST(CASE WHEN line = pl THEN c - pc ELSE c END AS BIGINT) AS delta_start FROM t")
def snk_05(m):
    c = F.coalesce("column_no", F.lit(0))
    w = Window.partitionBy("from_id").orderBy("line", c, "edge_seq", "to_id")
    t = m.edges.select("from_id", "line", c.alias("c"), F.row_number().over(w).cast("long").alias("k"), F.lag("line", 1, 0).over(w).alias("pl"), F.lag(c, 1, 0).over(w).alias("pc"))
    return t.select("from_id", "k", (F.col("line") - F.col("pl")).cast("long").alias("delta_line"), F.when(F.col("line") == F.col("pl"), F.col("c") - F.col("pc")).otherwise(F.col("c")).cast("long").alias("delta_start"))


@query("srt_09_selection_ranges", ", r AS (SELECT o_custkey AS k, CAST(o_orderkey % 97 AS BIGINT) AS a, CAST(o_orderkey % 97 + o_orderkey % 13 AS BIGINT) AS b FROM orders GROUP BY ALL), h AS (SELECT * FROM r WHERE a <= 40 AND b >= 40), o AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM h WINDOW w AS (PARTITION BY k ORDER BY b - a, a)) SELECT k, a, b FROM o WHERE pa IS NULL OR (a <= pa AND b >= pb AND b - a > pb - pa)")
def srt_09(m):
    k = F.col("o_orderkey")
    r = m.table("orders").select(F.col("o_custkey").alias("k"), (k % 97).alias("a"), (k % 97 + k % 13).alias("b")).distinct().filter("a <= 40 and b >= 40")
    w = Window.partitionBy("k").orderBy(F.col("b") - F.col("a"), "a")
    o = r.withColumn("pa", F.lag("a").over(w)).withColumn("pb", F.lag("b").over(w))
    return o.filter("pa is null or (a <= pa and b >= pb and b - a > pb - pa)").select("k", "a", "b")


@query("jon_06_cs_accessors_namespaced", _SITES + " SELECT site_no, c.to_id FROM sites JOIN constants c ON c.key = w1")
def jon_06(m):
    return resolve.by_priority(sites(m), [(F.col("w1"), dims(m)["constants"])], None).select("site_no", "to_id")


@query("jon_19_formula_no_edge", _SITES + " SELECT site_no FROM sites WHERE w1 <> 'hot'")
def jon_19(m):
    hint = F.when(F.col("w1") == "hot", "Formula").otherwise("BareName")
    return sites(m).withColumn("hint_kind", hint).filter("hint_kind != 'Formula'").select("site_no")


_PROPS = ", props(class_lc, member, type_lc) AS (VALUES ('asia', 'next', 'africa'), ('africa', 'next', 'america'), ('america', 'home', 'asia'))"


@query("jon_22_step_property", _RESOLVE + _PROPS + " SELECT s.class_lc, p.member, p.type_lc FROM self s JOIN props p ON p.class_lc = s.ancestor_lc QUALIFY row_number() OVER (PARTITION BY s.class_lc, p.member ORDER BY s.depth) = 1")
def jon_22(m):
    props = m.spark.createDataFrame([("asia", "next", "africa"), ("africa", "next", "america"), ("america", "home", "asia")], "ancestor_lc string, member string, type_lc string")
    near = classes.with_self(m.symbols, graph.ancestors(m.symbols)).join(props, "ancestor_lc")
    return near.groupBy("class_lc", "member").agg(F.min_by("type_lc", "depth").alias("type_lc"))


@query("jon_23_step_method_return", _RESOLVE + " SELECT r.class_lc, r.name_lc, coalesce(lower(s.return_type), 'variant') AS type_lc FROM res r JOIN symbols s ON s.symbol_id = r.symbol_id WHERE r.slot = 'call'")
def jon_23(m):
    res = classes.member_resolution(m.symbols, graph.ancestors(m.symbols)).filter("slot = 'call'")
    return res.join(m.symbols.select("symbol_id", "return_type"), "symbol_id").select("class_lc", "name_lc", F.coalesce(F.lower("return_type"), F.lit("variant")).alias("type_lc"))


@query("qry_24_explorer_groups", ", c AS (SELECT to_id, count(*) AS n FROM edges GROUP BY 1) SELECT kind, CASE WHEN owner_class IS NOT NULL THEN owner_class END AS owner, count(*) AS n, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS calls FROM symbols LEFT JOIN c ON c.to_id = symbol_id GROUP BY 1, 2")
def qry_24(m):
    c = m.edges.groupBy(F.col("to_id").alias("symbol_id")).agg(F.count("*").alias("c"))
    return m.symbols.join(c, "symbol_id", "left").groupBy("kind", F.col("owner_class").alias("owner")).agg(F.count("*").alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("calls"))


@query("str_06_idempotent_append", " SELECT count(*) AS n FROM (SELECT DISTINCT from_id, to_id, line, call_kind, access FROM edges)")
def str_06(m):
    once = calls.dedup_edges(m.edges)
    again = calls.dedup_edges(once.drop("first_seq").unionByName(m.edges.filter("resolved")))
    return again.agg(F.count("*").alias("n"))
