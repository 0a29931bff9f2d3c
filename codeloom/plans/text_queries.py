"""Registered queries: text functions, lint rules and diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import lookup
from codeloom.plans.registered import query

_LINES = "l AS (SELECT doc_id, p - 1 AS line, a[p] AS t FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)))"


def _lines(m):
    return m.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))


@query("txt_02_recover_string", " SELECT event_id, string_split(props, '\"')[2] AS literal FROM events", plain=True)
def txt_02(m):
    return m.table("events").select("event_id", T.recover_string(T.clean_line("props")["strings"], F.lit(0)).alias("literal"))


@query("txt_03_strip_block_comments", " SELECT page_id, length(html) AS n, length(html) - length(replace(html, chr(10), '')) AS n_lines FROM pages", plain=True)
def txt_03(m):
    s = T.strip_block_comments("html")
    return m.table("pages").select("page_id", F.length(s).cast("long").alias("n"), T.count_newlines(s).cast("long").alias("n_lines"))


@query("txt_06_fuzzy_match", " SELECT symbol_id, regexp_matches(lower(name), '(?s)r.*i.*n.*g') AS hit FROM symbols")
def txt_06(m):
    return m.symbols.select("symbol_id", lookup.fuzzy(F.col("name"), "Ring").alias("hit"))


@query("txt_07_filter_query", ", c AS (SELECT to_id, count(*) AS n FROM edges GROUP BY 1) SELECT symbol_id FROM symbols LEFT JOIN c ON to_id = symbol_id WHERE coalesce(n, 0) > 30 AND regexp_matches(lower(concat_ws('.', owner_class, name)), '(?s)b.*u.*e') AND NOT contains(name_lc, 'gear')")
def txt_07(m):
    return lookup.matches(m.symbols, m.edges, "bue -gear >30").select("symbol_id")


@query("txt_08_prefix_for", """ SELECT symbol_id, CASE WHEN strpos(name, '.') > 1 THEN string_split(name, '.')[1] WHEN strpos(name, '_') = 1 THEN nullif(regexp_extract(name, '^_[A-Za-z0-9]+'), '') WHEN strpos(name, ' ') > 1 THEN string_split(name, ' ')[1] WHEN strpos(name, '_') > 1 THEN string_split(name, '_')[1] END AS prefix FROM symbols""")
def txt_08(m):
    return m.symbols.select("symbol_id", T.prefix_for(F.col("name")).alias("prefix"))


@query("txt_09_word_at", " SELECT doc_id, concat(regexp_extract(substr(text, 1, 20), '[A-Za-z0-9_]*$'), regexp_extract(substr(text, 21), '^[A-Za-z0-9_]*')) AS word FROM documents", plain=True)
def txt_09(m):
    return m.table("documents").select("doc_id", T.word_at(F.col("text"), 20).alias("word"))


@query("txt_10_canonical_uri", " SELECT symbol_id, replace(uri, ' ', '%20') <> uri AS changed, uri AS canonical FROM symbols")
def txt_10(m):
    coded = F.replace("uri", F.lit(" "), F.lit("%20"))
    return m.symbols.select("symbol_id", (coded != F.col("uri")).alias("changed"), lookup.canonical_uri(coded).alias("canonical"))


@query("txt_11_signature", " SELECT symbol_id, concat('(', coalesce(params, ''), ')', CASE WHEN return_type IS NOT NULL THEN concat(' -> ', return_type) ELSE '' END) AS signature, CASE WHEN line >= 0 THEN line + 1 END AS line FROM symbols")
def txt_11(m):
    return m.symbols.select("symbol_id", T.signature(T.param_structs(F.col("params")), F.col("return_type")).alias("signature"), F.when(F.col("line") >= 0, F.col("line") + 1).alias("line"))


@query("txt_12_label_offsets", " SELECT symbol_id, CAST(1 AS BIGINT) AS first_at, CAST(strpos(params, ';') + 2 AS BIGINT) AS second_at FROM symbols WHERE params IS NOT NULL")
def txt_12(m):
    size = F.transform(T.param_structs(F.col("params")), lambda p: F.length(p["name"]) + F.when(p["type"].isNotNull(), F.length(p["type"]) + 3).otherwise(0))
    starts = F.aggregate(size, F.array(F.lit(1)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n + 2)))
    return m.symbols.filter("params is not null").select("symbol_id", F.element_at(starts, 1).cast("long").alias("first_at"), F.element_at(starts, 2).cast("long").alias("second_at"))


@query("txt_14_completion_context", " SELECT event_id, CASE event_type WHEN 'click' THEN 'cs-ns' WHEN 'view' THEN 'cs' WHEN 'error' THEN 'this' WHEN 'signup' THEN 'var' ELSE 'free' END AS context FROM events", plain=True)
def txt_14(m):
    prefix = F.when(F.col("event_type") == "click", "cs.NS.Cl").when(F.col("event_type") == "view", "x:=cs.A").when(F.col("event_type") == "error", "This.na").when(F.col("event_type") == "signup", "$e.sa").otherwise("Sel")
    return m.table("events").select("event_id", T.parse_context(prefix).alias("context"))


@query("txt_16_class_flavor", " SELECT symbol_id, CASE WHEN ends_with(name, '_I') THEN 'Interface' ELSE 'Class' END AS flavor FROM symbols WHERE kind = 'Class'")
def txt_16(m):
    return m.symbols.filter("kind = 'Class'").select("symbol_id", T.classify_flavor(F.col("name"), F.col("extends_class")).alias("flavor"))


@query("txt_17_symbol_id", " SELECT symbol_id, concat(kind, ':', CASE WHEN owner_class IS NULL THEN '' ELSE concat(owner_class, '.') END, name) AS made FROM symbols WHERE kind IN ('Class', 'ClassFunction', 'ClassGetter')")
def txt_17(m):
    return m.symbols.filter(F.col("kind").isin("Class", "ClassFunction", "ClassGetter")).select("symbol_id", T.symbol_id(F.col("kind"), F.col("owner_class"), F.col("name")).alias("made"))


@query("txt_18_split_builtin", " SELECT user_id, event_type AS base, CAST(user_id AS VARCHAR) AS param FROM events GROUP BY ALL", plain=True)
def txt_18(m):
    base, param = T.split_builtin(F.concat("event_type", F.lit("<"), F.col("user_id").cast("string"), F.lit(">")))
    return m.table("events").select("user_id", "event_type").distinct().select("user_id", base.alias("base"), param.alias("param"))


@query("txt_19_truncate", " SELECT doc_id, CASE WHEN length(text) > 40 THEN concat(substr(text, 1, 39), '…') ELSE text END AS short FROM documents", plain=True)
def txt_19(m):
    return m.table("documents").select("doc_id", T.truncate(F.col("text"), 40).alias("short"))


@query("txt_20_usage_title", " SELECT to_id, concat(count(*) FILTER (access = 'read'), ' read', CASE WHEN count(*) FILTER (access = 'read') = 1 THEN '' ELSE 's' END, ' · ', count(*) FILTER (access = 'write'), ' write', CASE WHEN count(*) FILTER (access = 'write') = 1 THEN '' ELSE 's' END) AS title FROM edges WHERE access IS NOT NULL GROUP BY 1")
def txt_20(m):
    n = m.edges.filter("access is not null").groupBy("to_id").agg(F.count(F.when(F.col("access") == "read", 1)).alias("r"), F.count(F.when(F.col("access") == "write", 1)).alias("w"))
    return n.select("to_id", T.usage_title(F.col("r"), F.col("w")).alias("title"))


@query("txt_21_line_shift", " SELECT symbol_id, CASE WHEN line > 10 THEN line + 3 - (10 - 8) ELSE line END AS line FROM symbols")
def txt_21(m):
    return m.symbols.select("symbol_id", T.shift_line(F.col("line"), F.lit(8), F.lit(10), F.lit(3)).alias("line"))


@query("txt_22_edit_span", " SELECT event_id, CAST(6 AS INT) AS start, CAST(length(props) - 1 AS INT) AS old_end, CAST(6 + 3 AS INT) AS new_end FROM events", plain=True)
def txt_22(m):
    edit = T.compute_edit(F.col("props"), F.concat(F.substring("props", 1, 6), F.lit("abc}")))
    return m.table("events").select("event_id", edit.alias("e")).select("event_id", "e.start", "e.old_end", "e.new_end")


#: Source lines with and without directives, one for each event, as SQL of both engines.
_DIRECTIVES = "CASE event_type WHEN 'click' THEN concat('x:=1 // lint-disable-next-line style/', user_id, ', b  c') WHEN 'view' THEN concat('` lint-disable-line\t', props) WHEN 'error' THEN concat('/* lint-disable ', event_type, '/', user_id % 7, ' */ y') WHEN 'signup' THEN concat('lint-disable-line a', user_id) ELSE concat('// lint-disabled and lint-disable-line') END"


@query("txt_23_suppressions", f"WITH l AS (SELECT event_id, {_DIRECTIVES} AS t FROM events), x AS (SELECT event_id, t, regexp_extract(t, '^(.*?)\\b(lint-disable-next-line|lint-disable-line|lint-disable)\\b([^*\\n\\r`]*)', ['b', 'd', 'i']) AS m FROM l), y AS (SELECT event_id, m.b AS b, m.d AS d, list_filter(regexp_split_to_array(m.i, '[,\\s]+'), lambda q: q <> '') AS ids FROM x) SELECT event_id, CASE d WHEN 'lint-disable-next-line' THEN 'next-line' WHEN 'lint-disable-line' THEN 'line' ELSE 'file' END AS scope, array_to_string(ids, '|') AS ids FROM y WHERE len(ids) > 0 AND (contains(b, '//') OR contains(b, '`') OR contains(b, '/*'))", plain=True)
def txt_23(m):
    scope, ids = T.suppressions(F.expr(_DIRECTIVES))
    return m.table("events").select("event_id", scope.alias("scope"), F.array_join(ids, "|").alias("ids")).filter("scope is not null")


@query("txt_24_safe_regex", " SELECT count(*) AS n FROM symbols WHERE regexp_matches(name, '^N')")
def txt_24(m):
    good = [p for p in ("^N", "([") if lookup.safe_regex(p)]
    return m.symbols.filter(F.col("name").rlike(good[0])).agg(F.count("*").alias("n"))


@query("txt_25_should_surface", " SELECT e.to_id, count(*) AS n FROM edges e JOIN symbols s ON s.symbol_id = e.to_id WHERE NOT e.resolved AND s.kind = 'Unresolved' AND NOT regexp_matches(s.name, '^[0-9]') GROUP BY 1")
def txt_25(m):
    names = m.symbols.filter("kind = 'Unresolved'").select(F.col("symbol_id").alias("to_id"), "name")
    return m.edges.filter("not resolved").join(names, "to_id").filter(T.should_surface(F.col("name"), F.lit("ProjectMethod"))).groupBy("to_id").agg(F.count("*").alias("n"))


@query("txt_26_local_type", " SELECT symbol_id, CASE return_type WHEN 'Text' THEN 'Text' WHEN 'Integer' THEN 'Integer' ELSE return_type END AS typ FROM symbols")
def txt_26(m):
    return m.symbols.select("symbol_id", T.normalize_local_type(F.upper("return_type")).alias("typ"))


# ---- lint rules


@query("lnt_01_trailing_whitespace", f" WITH {_LINES} SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(length(regexp_extract(t, '[ \\t]+$')) AS BIGINT) AS size FROM l WHERE regexp_matches(t, '[ \\t]+$')", plain=True)
def lnt_01(m):
    tail = F.regexp_extract("t", "[ \t]+$", 0)
    return _lines(m).filter(F.col("t").rlike("[ \t]+$")).select("doc_id", F.col("line").cast("long").alias("line"), F.length(tail).cast("long").alias("size"))


_PARAMS = ", p AS (SELECT symbol_id, kind, trim(string_split(x, ':')[1]) AS name, trim(string_split(x, ':')[2]) AS typ FROM (SELECT symbol_id, kind, unnest(string_split(params, ';')) AS x FROM symbols WHERE params IS NOT NULL))"


def _params(m):
    return m.symbols.filter("params is not null").select("symbol_id", "kind", F.explode(T.param_structs(F.col("params"))).alias("p")).select("symbol_id", "kind", "p.name", "p.type")


@query("lnt_02_missing_param_type", _PARAMS + " SELECT symbol_id, name FROM p WHERE typ IS NULL AND NOT starts_with(name, '_')")
def lnt_02(m):
    return _params(m).filter("type is null and not startswith(name, '_')").select("symbol_id", "name")


@query("lnt_03_missing_return_type", " SELECT symbol_id, line FROM symbols WHERE kind IN ('ClassFunction', 'ClassGetter') AND return_type IS NULL")
def lnt_03(m):
    return m.symbols.filter(F.col("kind").isin("ClassFunction", "ClassGetter") & F.col("return_type").isNull()).select("symbol_id", "line")


@query("lnt_05_method_no_callers", " SELECT symbol_id FROM symbols WHERE kind = 'ProjectMethod' AND NOT regexp_matches(name, '^test_') AND symbol_id NOT IN (SELECT to_id FROM edges)")
def lnt_05(m):
    called = m.edges.select(F.col("to_id").alias("symbol_id"))
    return m.symbols.filter((F.col("kind") == "ProjectMethod") & ~F.col("name").rlike("^test_")).join(called, "symbol_id", "left_anti").select("symbol_id")


@query("lnt_08_class_pascal_case", " SELECT symbol_id FROM symbols WHERE kind = 'Class' AND NOT regexp_matches(name, '^[A-Z][a-z]+(#[0-9]+)?$')")
def lnt_08(m):
    return m.symbols.filter((F.col("kind") == "Class") & ~F.col("name").rlike("^[A-Z][a-z]+(#[0-9]+)?$")).select("symbol_id")


@query("lnt_09_method_camel_case", " SELECT symbol_id FROM symbols WHERE kind = 'ProjectMethod' AND NOT regexp_matches(regexp_replace(name, '^_', ''), '^[a-z][A-Za-z0-9]*$')")
def lnt_09(m):
    return m.symbols.filter((F.col("kind") == "ProjectMethod") & ~F.regexp_replace("name", "^_", "").rlike("^[a-z][A-Za-z0-9]*$")).select("symbol_id")


@query("lnt_10_missing_docstring", f" WITH {_LINES}, x AS (SELECT doc_id, line, length(t) > 80 AS body, max(CASE WHEN length(t) > 80 THEN line END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM l) SELECT doc_id, CAST(line AS BIGINT) AS line FROM x WHERE body AND line > 0 AND line - 1 - coalesce(stop, -1) < 2", plain=True)
def lnt_10(m):
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    body = F.length("t") > 80
    x = _lines(m).select("doc_id", "line", body.alias("body"), F.last(F.when(body, F.col("line")), True).over(w).alias("stop"))
    return x.filter(F.col("body") & (F.col("line") > 0) & (F.col("line") - 1 - F.coalesce("stop", F.lit(-1)) < 2)).select("doc_id", F.col("line").cast("long").alias("line"))


@query("lnt_11_builtin_collision", " SELECT symbol_id FROM symbols WHERE kind <> 'Constant' AND name_lc IN (SELECT lower(p_type) FROM part) AND name <> 'SMALL'")
def lnt_11(m):
    names = m.table("part").select(F.lower("p_type").alias("name_lc")).distinct()
    return m.symbols.filter("kind != 'Constant' and name != 'SMALL'").join(names, "name_lc", "left_semi").select("symbol_id")


_FOUND = ", f AS (SELECT 0 AS rule_seq, 'types/missing-return-type' AS rule_id, uri, line, symbol_seq FROM symbols WHERE kind IN ('ClassFunction', 'ClassGetter') AND return_type IS NULL UNION ALL SELECT 1, 'style/class-pascal-case', uri, line, symbol_seq FROM symbols WHERE kind = 'Class' AND NOT regexp_matches(name, '^[A-Z][a-z]+(#[0-9]+)?$')), sup AS (SELECT DISTINCT uri, line FROM symbols WHERE kind = 'Class' AND symbol_seq % 2 = 0)"


def _findings(m):
    a = m.symbols.filter(F.col("kind").isin("ClassFunction", "ClassGetter") & F.col("return_type").isNull()).select(F.lit(0).alias("rule_seq"), F.lit("types/missing-return-type").alias("rule_id"), "uri", "line", "symbol_seq")
    return a.union(m.symbols.filter((F.col("kind") == "Class") & ~F.col("name").rlike("^[A-Z][a-z]+(#[0-9]+)?$")).select(F.lit(1), F.lit("style/class-pascal-case"), "uri", "line", "symbol_seq"))


def run_lint(findings, suppressed, cap: int = 100):
    """Findings without suppressed ones (by file, by line, by rule or any rule), at most `cap` a file in rule order."""
    for on in (["uri", "line"], ["uri", "line", "rule_id"], ["uri"], ["uri", "rule_id"]):
        scope = suppressed.filter((F.col("line").isNotNull() if "line" in on else F.col("line").isNull()) & (F.col("rule_id") != "*" if "rule_id" in on else F.col("rule_id") == "*"))
        findings = findings.join(scope.select(*on), on, "left_anti")
    order = Window.partitionBy("uri").orderBy("rule_seq", "symbol_seq")
    return findings.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= cap).drop("r")


@query("lnt_12_runner", _FOUND + " SELECT rule_id, uri, line FROM f WHERE NOT EXISTS (SELECT 1 FROM sup WHERE sup.uri = f.uri AND sup.line = f.line) QUALIFY row_number() OVER (PARTITION BY uri ORDER BY rule_seq, symbol_seq) <= 100")
def lnt_12(m):
    off = m.symbols.filter("kind = 'Class' and symbol_seq % 2 = 0").select("uri", "line", F.lit("*").alias("rule_id")).distinct()
    return run_lint(_findings(m), off).select("rule_id", "uri", "line")


#: A source line for each class, with every form of directive, as SQL of both engines.
_LINTED = "CASE symbol_seq % 5 WHEN 0 THEN '// lint-disable-line style/class-pascal-case' WHEN 1 THEN '` lint-disable-next-line types/missing-return-type, style/class-pascal-case' WHEN 2 THEN '/* lint-disable types/missing-return-type */' WHEN 3 THEN 'lint-disable-line style/class-pascal-case' ELSE '// lint-disable-line' END"


@query("lnt_13_suppression_map", _FOUND.split(", sup AS")[0] + ", d AS (SELECT uri, line, symbol_seq % 5 AS k FROM symbols WHERE kind = 'Class'), off AS (SELECT uri, line, 'style/class-pascal-case' AS rule_id FROM d WHERE k = 0 UNION SELECT uri, line + 1, unnest(['types/missing-return-type', 'style/class-pascal-case']) FROM d WHERE k = 1 UNION SELECT uri, NULL, 'types/missing-return-type' FROM d WHERE k = 2 AND line < 20) SELECT rule_id, f.uri, count(*) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM off WHERE off.rule_id = f.rule_id AND off.uri = f.uri AND off.line IS NULL) AND NOT EXISTS (SELECT 1 FROM off WHERE off.rule_id = f.rule_id AND off.uri = f.uri AND off.line = f.line) GROUP BY 1, 2")
def lnt_13(m):
    lines = m.symbols.filter("kind = 'Class'").select("uri", "line", F.expr(_LINTED).alias("text"))
    return run_lint(_findings(m), T.suppression_map(lines), 1 << 30).groupBy("rule_id", "uri").agg(F.count("*").alias("n"))


@query("lnt_14_severity", " SELECT s AS name, CASE s WHEN 'info' THEN 3 WHEN 'warning' THEN 2 WHEN 'error' THEN 1 END AS severity FROM (VALUES ('off'), ('info'), ('warning'), ('error'), ('loud')) v(s)")
def lnt_14(m):
    names = m.spark.createDataFrame([("off",), ("info",), ("warning",), ("error",), ("loud",)], "name string")
    s = F.col("name")
    return names.select("name", F.when(s == "info", 3).when(s == "warning", 2).when(s == "error", 1).alias("severity"))


@query("dgn_01_unresolved_calls", " SELECT uri, line, to_id FROM (SELECT s.uri, e.line, e.to_id, min(e.edge_seq) AS q FROM edges e JOIN symbols s ON s.symbol_id = e.from_id JOIN symbols t ON t.symbol_id = e.to_id WHERE NOT e.resolved AND t.kind NOT IN ('Builtin', 'TableBuiltin') AND (t.kind <> 'Unresolved' OR NOT regexp_matches(t.name, '^9')) GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY uri ORDER BY line, q, to_id) <= 100")
def dgn_01(m):
    src = m.symbols.select(F.col("symbol_id").alias("from_id"), "uri")
    dst = m.symbols.select(F.col("symbol_id").alias("to_id"), "kind", "name").filter(~F.col("kind").isin("Builtin", "TableBuiltin"))
    rows = m.edges.filter("not resolved").join(src, "from_id").join(dst, "to_id").filter((F.col("kind") != "Unresolved") | ~F.col("name").rlike("^9"))
    one = rows.groupBy("uri", "line", "to_id").agg(F.min("edge_seq").alias("q"))
    return one.withColumn("r", F.row_number().over(Window.partitionBy("uri").orderBy("line", "q", "to_id"))).filter("r <= 100").select("uri", "line", "to_id")


@query("snk_02_cache_name", " SELECT uri, concat('callgraph-', substr(sha256(uri), 1, 12)) AS cache_name FROM symbols GROUP BY 1")
def snk_02(m):
    return m.symbols.select("uri").distinct().select("uri", F.concat(F.lit("callgraph-"), F.substring(F.sha2("uri", 256), 1, 12)).alias("cache_name"))


@query("snk_03_json_result", """ SELECT concat('{"symbol_id":"', symbol_id, '","line":', line, '}') AS json FROM symbols WHERE kind = 'Class'""")
def snk_03(m):
    return m.symbols.filter("kind = 'Class'").select(F.to_json(F.struct("symbol_id", "line")).alias("json"))
