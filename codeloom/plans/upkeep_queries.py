"""Registered queries: patches of an indexed project, changes by hand, results, markers and constants."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom import indexer
from codeloom.functions import extract
from codeloom.functions import text as T
from codeloom.index import Index
from codeloom.operators import signatures
from codeloom.plans.index_queries import _EDGES, _sources
from codeloom.plans.registered import query
from codeloom.plans.tables import measured_joins, scratch, stored
from codeloom.sources import archives, cache, declared
from codeloom.streaming import upkeep

_GONE = "p_partkey % 10 = 0"


def _patched(m):
    """The project of all sources, and the batch that deletes every tenth method."""
    sources = _sources(m)
    gone = m.table("part").filter(_GONE).select(F.concat(F.lit("Project/Sources/Methods/m"), F.col("p_partkey").cast("string"), F.lit(".4dm")).alias("path"), F.lit("delete").alias("kind"))
    return indexer.build(sources), gone, sources


@query("str_04_patch_project", _EDGES.replace(", c AS", "WITH c AS", 1).replace("FROM part)", f"FROM part WHERE NOT {_GONE})") + " SELECT DISTINCT * FROM e", plain=True)
def str_04_patch(m):
    project, gone, sources = _patched(m)
    edges = indexer.patch(project, gone, sources.limit(0)).index.edges
    return edges.select("from_id", "to_id", "call_kind", "line", "access", "resolved")


@query("str_07_reresolve", f"WITH p AS (SELECT p_partkey AS p, CASE p_partkey % 4 WHEN 1 THEN (p_partkey - 1) // 2 WHEN 3 THEN p_partkey + 1 END AS callee FROM part WHERE NOT {_GONE}) SELECT concat('Project/Sources/Methods/m', p, '.4dm') AS rel_path, 2 AS line FROM p WHERE callee IN (SELECT p_partkey FROM part WHERE {_GONE})", plain=True)
def str_07_fan_out(m):
    project, gone, _ = _patched(m)
    paths = gone.select(F.col("path").alias("rel_path"))
    after = project.symbols.join(paths.select(F.concat(F.lit("ProjectMethod:"), F.regexp_extract("rel_path", r"(m\d+)\.4dm", 1)).alias("symbol_id")), "symbol_id", "left_anti")
    sites = project.sites.join(paths, "rel_path", "left_anti")
    again = indexer.affected(sites, project.locals_, project.symbols, after, gone)
    with measured_joins(m.spark):
        return stored(again.join(sites, ["rel_path", "site_no"]).select("rel_path", "line"), "fan")


@query("str_09_synthetic_drift", " SELECT symbol_id, 'unused' AS problem FROM symbols WHERE kind IN ('Builtin', 'TableBuiltin', 'Unresolved') AND symbol_id NOT IN (SELECT to_id FROM edges WHERE line % 7 <> 3) UNION ALL SELECT DISTINCT to_id, 'missing' FROM edges WHERE line % 7 <> 3 AND to_id NOT IN (SELECT symbol_id FROM symbols)")
def str_09(m):
    return upkeep.synthetic_drift(upkeep.remove_edges(m, m.edges.filter("line % 7 = 3").select("edge_seq")))


@query("str_11_mutations", ", s AS (SELECT symbol_id FROM symbols WHERE kind <> 'Class' UNION SELECT concat('Class:New', n_nationkey) FROM nation), gone AS (SELECT symbol_id FROM symbols WHERE kind = 'Class'), e AS (SELECT from_id, to_id FROM edges WHERE from_id NOT IN (SELECT symbol_id FROM gone) AND to_id NOT IN (SELECT symbol_id FROM gone) UNION ALL SELECT concat('Class:New', n_nationkey), 'Class:New0' FROM nation) SELECT s.symbol_id, (SELECT count(*) FROM e WHERE from_id = s.symbol_id) AS n_out, (SELECT count(*) FROM e WHERE to_id = s.symbol_id) AS n_in FROM s")
def str_11(m):
    nations = m.table("nation")
    name = F.concat(F.lit("New"), F.col("n_nationkey").cast("string"))

    def rows(schema, **given):
        return nations.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    new = rows(m.symbols.schema, symbol_seq=F.col("n_nationkey"), symbol_id=F.concat(F.lit("Class:"), name), name=name, kind=F.lit("Class"))
    calls = rows(m.edges.schema, edge_seq=F.col("n_nationkey"), from_id=F.concat(F.lit("Class:"), name), to_id=F.lit("Class:New0"), resolved=F.lit(True))
    less = upkeep.remove_symbols(m, m.symbols.filter("kind = 'Class'"), incoming=True)
    index = upkeep.add_edges(upkeep.add_symbols(upkeep.add_symbols(less, new), new), calls)
    out = index.edges.groupBy(F.col("from_id").alias("symbol_id")).agg(F.count("*").alias("n_out"))
    back = index.edges.groupBy(F.col("to_id").alias("symbol_id")).agg(F.count("*").alias("n_in"))
    rows_ = index.symbols.select("symbol_id").join(out, "symbol_id", "left").join(back, "symbol_id", "left")
    return rows_.select("symbol_id", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


_RESULTS = "SELECT CAST(user_id % 50 AS VARCHAR) AS suite, event_type AS name, event_id AS seq, event_id % 3 AS status FROM events"


@query("str_15_merge_results", f"WITH r AS ({_RESULTS}) SELECT suite, name, arg_max(status, (seq % 4 = 0, seq)) AS status FROM r GROUP BY 1, 2", plain=True)
def str_15(m):
    rows = m.table("events").select((F.col("user_id") % 50).cast("string").alias("suite"), F.col("event_type").alias("name"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("status"))
    return upkeep.merge_results(rows.filter("seq % 4 != 0"), rows.filter("seq % 4 = 0")).select("suite", "name", "status")


_STEPS = "SELECT r_regionkey AS region, n_nationkey AS seq, n_nationkey % 7 * 3 AS a, n_nationkey % 7 * 3 + n_nationkey % 3 AS b, n_nationkey % 5 AS added, n_nationkey % 11 = 10 AS saved FROM {nation}, {region} WHERE n_regionkey = r_regionkey"


@query("str_16_shift_markers", f"WITH st AS ({_STEPS.format(nation='nation', region='region')}), l AS (SELECT region, list({{'a': a, 'b': b, 'd': added - (b - a), 'v': saved}} ORDER BY seq) AS steps FROM st GROUP BY 1) SELECT s_suppkey, CAST(list_reduce([{{'a': 0::BIGINT, 'b': 0::BIGINT, 'd': (s_suppkey % 40)::BIGINT, 'v': false}}] || steps, lambda x, e: {{'a': 0::BIGINT, 'b': 0::BIGINT, 'd': (CASE WHEN e.v THEN s_suppkey % 40 WHEN x.d > e.b THEN x.d + e.d ELSE x.d END)::BIGINT, 'v': false}}).d AS BIGINT) AS now FROM supplier JOIN l ON region = s_suppkey % 5", plain=True)
def str_16(m):
    n = F.col("n_nationkey")
    saved = n % 11 == 10
    edits = m.table("nation").select(F.col("n_regionkey").cast("string").alias("uri"), n.alias("seq"), F.when(~saved, n % 7 * 3).alias("start"), (n % 7 * 3 + n % 3).alias("end"), (n % 5).alias("added"))
    markers = m.table("supplier").select("s_suppkey", (F.col("s_suppkey") % 5).cast("string").alias("uri"), (F.col("s_suppkey") % 40).alias("line"))
    return upkeep.shift_markers(markers, edits).select("s_suppkey", "now")


_XLIFF = "concat('<xliff xmlns:d4=\"u\"><file><group d4:groupName=\"', replace(p_brand, '#', ' '), '\"><trans-unit id=\"k', p_partkey, '\" resname=\"', replace(p_name, ' ', '_'), '\" d4:value=\"', p_size, ':', CASE WHEN p_size % 2 = 0 THEN 'L' ELSE 'S' END, '\"/><trans-unit id=\"b', p_partkey, '\" d4:value=\"a:b\"><source>&lt;', p_type, '</source></trans-unit></group></file>', CASE WHEN p_partkey % 50 = 0 THEN '' ELSE '</xliff>' END)"


@query("src_07_constants", "SELECT replace(p_name, ' ', '_') AS name, CAST(p_size AS VARCHAR) AS value, CASE WHEN p_size % 2 = 0 THEN 'L' ELSE 'S' END AS type_letter, replace(p_brand, '#', ' ') AS theme FROM part WHERE p_partkey % 50 <> 0 UNION ALL SELECT concat('<', p_type), 'a:b', '', replace(p_brand, '#', ' ') FROM part WHERE p_partkey % 50 <> 0", plain=True)
def src_07(m):
    return archives.xliff_constants(m.table("part").select(F.expr(_XLIFF).alias("content")))


@query("src_08_builtin_constants", "WITH own AS (SELECT DISTINCT lower(replace(p_name, ' ', '_')) AS lc FROM part WHERE p_partkey % 50 <> 0 AND p_partkey % 2 = 0), b AS (SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part WHERE p_partkey % 50 <> 0 AND p_partkey % 2 = 1 UNION ALL SELECT p_partkey, concat('<', p_type) FROM part WHERE p_partkey % 50 <> 0 AND p_partkey % 2 = 1) SELECT DISTINCT name FROM b WHERE lower(name) NOT IN (SELECT lc FROM own) AND lower(name) NOT IN (SELECT lower(concat('<', p_type)) FROM part WHERE p_partkey % 50 <> 0 AND p_partkey % 2 = 0)", plain=True)
def src_08_builtin(m):
    own, other = (archives.xliff_constants(m.table("part").filter(F.col("p_partkey") % 2 == k).select(F.expr(_XLIFF).alias("content"))) for k in (0, 1))
    sources = m.spark.createDataFrame([], "rel_path string, content string, uri string, category string, container string, base string")
    empty = m.spark.createDataFrame([], "plugin string, command string"), m.spark.createDataFrame([], "component string, kind string, class string, name string, type string")
    symbols = indexer.assemble(sources, extract.symbols_of(sources), *empty, own, other)
    return symbols.filter("kind = 'BuiltinConstant'").select("name")


@query("txt_01_clean_line", "SELECT p_partkey, concat('$a', p_partkey, '.b', p_partkey, '(\"0\"; \"1\"); Do_', p_partkey, '(1;[2;3];\"2\"; ') AS text, concat('x;(', '|', p_type, '\"', '|', p_type) AS strings FROM part", plain=True)
def txt_01(m):
    line = F.expr("concat('$a', p_partkey, '.b', p_partkey, '(\"x;(\"; \"', p_type, '\"\"\"); Do_', p_partkey, '(1;[2;3];\"', p_type, '\"; // ', p_type)")
    c = T.clean_line(line)
    return m.table("part").select("p_partkey", c["text"].alias("text"), F.array_join(c["strings"], "|").alias("strings"))


@query("txt_13_active_call", "SELECT p_partkey, concat('Do_', p_partkey) AS name, 2 + p_partkey % 3 AS argument FROM part", plain=True)
def txt_13(m):
    line = F.expr("concat('$a', p_partkey, '.b(\"x;(\"; \"', p_type, '\"); Do_', p_partkey, '(1;f(2;3);\"', p_type, '(;', repeat('\"; \"', p_partkey % 3))")
    return m.table("part").select("p_partkey", T.active_call(line).alias("c")).select("p_partkey", "c.name", F.col("c.argument").cast("long").alias("argument"))


@query("txt_15_legacy_types", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Text' WHEN 1 THEN 'Integer' WHEN 2 THEN 'Real' WHEN 3 THEN 'Collection' END AS type, CAST(p_partkey % 4 - 1 AS INT) AS balance, p_partkey % 2 = 0 AS chained FROM part", plain=True)
def txt_15(m):
    k = F.col("p_partkey")
    word = F.when(k % 5 == 0, "ALPHA").when(k % 5 == 1, "longint").when(k % 5 == 2, "Real").when(k % 5 == 3, "COLLECTION").otherwise("NOTYPE")
    line = F.concat(F.repeat(F.lit("("), k % 4 + 1), F.lit('"((" ))'), F.lit(" // ("))
    assign = F.concat(F.lit('$x:=cs.A.new("a)."; (1))'), F.when(k % 2 == 0, " .go()").otherwise("; .b"))
    return m.table("part").select("p_partkey", T.canonical_c_type(word).alias("type"), T.paren_balance(T.clean_line(line)["text"]).alias("balance"), T.new_is_chained(T.clean_line(assign)["text"]).alias("chained"))


@query("ext_03_chains", "WITH s AS (SELECT p_partkey AS p, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) SELECT p, x.hint AS hint_kind, x.name AS name, x.path AS path FROM (SELECT p, unnest(CASE p % 3 WHEN 0 THEN [{'hint': 'VarGet', 'name': a, 'path': NULL}, {'hint': 'VarChainCall', 'name': b, 'path': a}, {'hint': 'VarChainCall', 'name': 'z', 'path': concat(a, '/', b, '()')}] WHEN 1 THEN [{'hint': 'ThisCall', 'name': a, 'path': NULL}, {'hint': 'ThisChainCall', 'name': b, 'path': concat(a, '()/', b)}] ELSE [{'hint': 'VarCall', 'name': a, 'path': NULL}, {'hint': 'VarGet', 'name': b, 'path': NULL}] END) AS x FROM s)", plain=True)
def ext_03(m):
    k = F.col("p_partkey")
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    text = F.when(k % 3 == 0, F.concat(F.lit("$v."), a, F.lit("."), b, F.lit('("(.x()"; [1]).z()'))).when(k % 3 == 1, F.concat(F.lit("This."), a, F.lit("({k: 1})."), b, F.lit("."), b, F.lit("()"))).otherwise(F.concat(F.lit("$v."), a, F.lit("($w."), b, F.lit(")")))
    sources = m.table("part").select(k.cast("string").alias("rel_path"), F.lit("method").alias("category"), F.lit(None).cast("string").alias("container"), F.lit("m").alias("base"), text.alias("content"))
    return extract.sites_of(sources).select(F.col("rel_path").cast("long").alias("p"), "hint_kind", "name", "path")


# ---- signatures


_COMPILED = "SELECT concat('Project/Sources/Methods/Compiler_', p_partkey % 20, '.4dm') AS rel_path, concat('C_TEXT(', replace(p_name, ' ', '_'), p_partkey, ';$0)', chr(10), 'C_LONGINT(', replace(p_name, ' ', '_'), p_partkey, ';$', p_partkey % 5 + 1, ')', CASE WHEN p_partkey % 3 = 0 THEN concat(chr(10), 'C_REAL(', replace(p_name, ' ', '_'), p_partkey, ';$', chr(123), p_partkey % 4 + 2, chr(125), ')') ELSE '' END) AS content FROM {part}"


@query("ext_08_variadic_params", """, s AS (SELECT symbol_id, p_partkey AS p, string_split(params, ';') AS d, return_type, p_partkey % 5 + 1 AS told, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 + 2 END AS tail FROM symbols JOIN part ON symbol_id = concat('ProjectMethod:Part', p_partkey)),
n AS (SELECT *, least(greatest(len(d), least(told, coalesce(tail - 1, 1000))), coalesce(tail - 1, 1000)) AS last FROM s)
SELECT symbol_id, concat(array_to_string(list_transform(range(1, last + 1), lambda i: concat(CASE WHEN i <= len(d) THEN trim(string_split(d[i], ':')[1]) ELSE CAST(i AS VARCHAR) END, ' ', coalesce(CASE WHEN i <= len(d) THEN trim(string_split(d[i], ':')[2]) END, CASE WHEN i = told THEN 'LONGINT' END, '?'))), ','), CASE WHEN tail IS NOT NULL THEN ',...rest REAL' ELSE '' END) AS params, coalesce(return_type, 'TEXT') AS return_type FROM n""")
def ext_08(m):
    compiler = declared.compiler_types(m.spark.sql(_COMPILED, part=m.table("part")))
    rows = signatures.with_compiler_types(m.symbols.filter("symbol_id like 'ProjectMethod:Part%'"), compiler)
    shown = F.transform("parameters", lambda p: F.concat_ws(" ", p["name"], F.coalesce(p["type"], F.lit("?"))))
    return rows.select("symbol_id", F.array_join(shown, ",").alias("params"), "return_type")


@query("qry_20_hover", """, i AS (SELECT to_id, from_id, count(*) AS n, min(edge_seq) AS s FROM edges GROUP BY 1, 2), o AS (SELECT from_id, count(DISTINCT to_id) AS t, count(*) AS n FROM edges GROUP BY 1),
r AS (SELECT to_id, s.name, s.owner_class, row_number() OVER (PARTITION BY to_id ORDER BY i.s, from_id) AS k FROM i JOIN symbols s ON s.symbol_id = from_id),
c AS (SELECT to_id, count(*) AS u, sum(n) AS n FROM i GROUP BY 1), l AS (SELECT to_id, string_agg(concat('- `', name, '`', CASE WHEN owner_class IS NOT NULL THEN concat(' · ', owner_class) ELSE '' END), chr(10) ORDER BY k) AS top FROM r WHERE k <= 5 GROUP BY 1),
t AS (SELECT s.*, c.u, c.n, l.top, o.t, o.n AS m, concat_ws(concat('  ', chr(10)), 'Class: `' || owner_class || '`', 'Flavor: ' || class_flavor, 'Extends: `' || extends_class || '`', 'Returns: `' || return_type || '`') AS meta FROM symbols s LEFT JOIN c ON c.to_id = symbol_id LEFT JOIN l ON l.to_id = symbol_id LEFT JOIN o ON o.from_id = symbol_id)
SELECT symbol_id, concat_ws(concat(chr(10), chr(10)), concat('**', name, '** _(', kind, ')_'), nullif(meta, ''), concat('📄 `', regexp_replace(uri, '^file:///p/', ''), ':', line + 1, '`'), CASE WHEN n > 0 THEN concat('▲ Callers: **', u, '** unique, **', n, '** call site', CASE WHEN n = 1 THEN '' ELSE 's' END) END,
CASE WHEN top IS NOT NULL THEN concat(top, CASE WHEN u > 5 THEN concat(chr(10), '- _…and ', u - 5, ' more_') ELSE '' END) END, CASE WHEN m > 0 THEN concat('▼ Callees: **', t, '** unique, **', m, '** call site', CASE WHEN m = 1 THEN '' ELSE 's' END) END) AS text FROM t""")
def qry_20(m):
    return signatures.hover(m.symbols, m.edges, "/p")


@query("qry_22_signature_help", """, c AS (SELECT p_partkey AS p, p_partkey % 4 AS k FROM part), f AS (SELECT symbol_id, name, owner_class, params, return_type, symbol_seq, kind, name_lc FROM symbols WHERE kind = 'ClassFunction'),
x AS (SELECT p, k, CASE k WHEN 0 THEN (SELECT min(symbol_id) FROM symbols s WHERE s.symbol_id = concat('ProjectMethod:Part', p)) WHEN 1 THEN 'ClassFunction:ASIA.MEDIUM' WHEN 2 THEN 'ClassFunction:ASIA.MEDIUM' END AS id FROM c)
SELECT p, symbol_id, concat(name, '(', params_text, ')', CASE WHEN return_type IS NOT NULL THEN concat(' -> ', return_type) ELSE '' END) AS label, CAST(1 + p % 3 AS INT) AS active FROM x JOIN (SELECT symbol_id, name, return_type, array_to_string(list_transform(string_split(params, ';'), lambda z: concat(trim(string_split(z, ':')[1]), CASE WHEN len(string_split(z, ':')) > 1 THEN concat(' : ', trim(string_split(z, ':')[2])) ELSE '' END)), '; ') AS params_text FROM symbols) s ON s.symbol_id = x.id""")
def qry_22(m):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.regexp_replace("p_name", " ", "_"), k.cast("string"))).when(k % 4 == 1, "cs.ASIA.MEDIUM").when(k % 4 == 2, "This.medium").otherwise("$x.medium")
    text = F.concat(F.lit("If (Other(1;2)) $a:="), name, F.lit('(f("x;(";2);'), F.repeat(F.lit("1;"), (k % 3).cast("int")))
    places = m.table("part").select(k.alias("p"), F.lit("file:///p/Project/Sources/Classes/ASIA.4dm").alias("uri"), text.alias("text"))
    return signatures.signature_help(places, m.symbols).select("p", "symbol_id", "label", F.col("active").cast("int").alias("active"))


# ---- stored graphs


@query("src_14_cache_reload", " SELECT kind AS what, count(*) AS n FROM symbols GROUP BY 1 UNION ALL SELECT unnest(['later time: none', 'missing file: none', 'other root: none', 'within a millisecond: read']), 1")
def src_14(m):
    where, spark = scratch(m.spark, "cache"), m.spark
    listing = m.symbols.select(F.col("uri").alias("path"), (F.length("uri") * 1000).cast("double").alias("mtime")).distinct()
    cache.save(m, listing, "/p", where)
    cases = [("later time", "/p", listing.withColumn("mtime", F.col("mtime") + F.when(F.col("path") == "synthetic:", 2).otherwise(0))), ("missing file", "/p", listing.filter("path != 'synthetic:'")), ("other root", "/q", listing), ("within a millisecond", "/p", listing.withColumn("mtime", F.col("mtime") + 0.5))]
    said = [(f"{name}: {'none' if cache.load(spark, where, root, files_) is None else 'read'}", 1) for name, root, files_ in cases]
    rows = cache.load(spark, where, "/p", listing).symbols.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n"))
    return rows.union(spark.createDataFrame(said, "what string, n long"))


@query("snk_01_persist", " SELECT call_kind, count(*) AS n FROM edges WHERE resolved GROUP BY 1 UNION ALL SELECT 'snapshots', 2")
def snk_01(m):
    where = scratch(m.spark, "cache")
    none = m.spark.createDataFrame([], "path string, mtime double")
    for edges in (m.edges.limit(0), m.edges.filter("not resolved"), m.edges.filter("resolved")):
        cache.save(Index(m.symbols.limit(0), edges), none, "/p", where)
    cache.prune(m.spark, where)
    rows = cache.latest(m.spark, where).edges.groupBy("call_kind").agg(F.count("*").alias("n"))
    return rows.union(m.spark.createDataFrame([("snapshots", len(cache.snapshots(m.spark, where)))], "call_kind string, n long"))
