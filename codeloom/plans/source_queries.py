"""Registered queries: sources, extraction and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import extract
from codeloom.plans.registered import query
from codeloom.sources import files
from codeloom.streaming import incremental

# ---- sources: paths made from the tables


_PATHS = "p AS (SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN concat('Project/Sources/Methods/', p_type, p_partkey, '.4dm') WHEN 1 THEN concat('Project/Sources/Methods/Compiler_', p_type, '.4dm') WHEN 2 THEN concat('Project/Sources/Classes/', p_type, '.4dm') WHEN 3 THEN concat('Project/Sources/DatabaseMethods/', p_type, '.4dm') WHEN 4 THEN concat('Project/Sources/Forms/', p_type, '/method.4dm') WHEN 5 THEN concat('Project/Sources/Forms/', p_type, '/form.4DForm') WHEN 6 THEN concat('Project/Sources/Forms/', p_type, '/ObjectMethods/b.4dm') WHEN 7 THEN concat('Project/Sources/TableForms/', p_size, '/', p_type, '/method.4dm') WHEN 8 THEN concat('Project/Sources/TableForms/', p_size, '/', p_type, '/ObjectMethods/b.4dm') ELSE concat('Resources/', p_type, '.txt') END AS rel_path, p_type, p_size FROM {part})"


def _paths(m):
    return m.spark.sql("WITH " + _PATHS + " SELECT * FROM p", part=m.table("part"))


@query("src_02_classify_file", "WITH " + _PATHS.replace("{part}", "part") + """ SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'method' WHEN 1 THEN 'compilerMethod' WHEN 2 THEN 'class' WHEN 3 THEN 'databaseMethod' WHEN 4 THEN 'formMethod' WHEN 5 THEN 'formDefinition' WHEN 6 THEN 'formObjectMethod' WHEN 7 THEN 'tableFormMethod' WHEN 8 THEN 'tableObjectMethod' END AS category, CASE WHEN p_partkey % 10 IN (2, 4, 5, 6, 7, 8) THEN p_type END AS container, CASE WHEN p_partkey % 10 IN (7, 8) THEN CAST(p_size AS VARCHAR) END AS owner_table_id FROM p""", plain=True)
def src_02(m):
    return _paths(m).select("p_partkey", files.classify(F.col("rel_path")).alias("c")).select("p_partkey", "c.category", "c.container", "c.owner_table_id")


@query("src_03_exclusions", "WITH " + _PATHS.replace("{part}", "part") + " SELECT p_partkey FROM p WHERE NOT contains(rel_path, '/ObjectMethods/') AND NOT starts_with(rel_path, 'Resources/')", plain=True)
def src_03(m):
    return _paths(m).filter(~files.excluded(F.col("rel_path"), ["ObjectMethods", "Resources"])).select("p_partkey")


@query("src_04_catalog_tables", "SELECT DISTINCT p_type AS name FROM part", plain=True)
def src_04(m):
    return files.table_names(m.table("part").select(F.concat(F.lit("Project/Sources/Catalog/Tables/"), "p_type", F.lit(".json")).alias("rel_path")))


@query("src_05_catalog_table_ids", "SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE concat('f', n_nationkey) END AS name FROM nation WHERE n_nationkey % 5 <> 4", plain=True)
def src_05(m):
    key = F.col("n_nationkey").cast("string")
    named = F.concat(F.lit('{"@id":"'), key, F.lit('","@name":"'), "n_name", F.lit('"}'))
    bare = F.concat(F.lit('{"@id":"'), key, F.lit('"}'))
    content = F.when(F.col("n_nationkey") % 5 == 4, "{broken").when(F.col("n_nationkey") % 2 == 0, named).otherwise(bare)
    return files.table_ids(m.table("nation").select(F.concat(F.lit("Project/Sources/Catalog/Tables/f"), key, F.lit(".json")).alias("rel_path"), content.alias("content")))


@query("src_06_plugin_commands", "SELECT n_name AS plugin, unnest([concat('A ', n_nationkey), 'B']) AS command FROM nation", plain=True)
def src_06(m):
    key = F.col("n_nationkey").cast("string")
    content = F.concat(F.lit('{"commands":[{"name":"A '), key, F.lit('"}],"themes":[{"commands":[{"syntax":"B (x;y)"}]}]}'))
    rows = m.table("nation").select(F.concat(F.lit("Plugins/"), "n_name", F.lit(".bundle/Contents/Resources/manifest.json")).alias("rel_path"), content.alias("content"))
    return files.plugin_commands(rows)


@query("src_15_freshness", "SELECT s_name AS path, CASE WHEN s_suppkey % 5 = 1 THEN 'added' WHEN s_suppkey % 5 = 2 THEN 'removed' ELSE 'changed' END AS why FROM supplier WHERE s_suppkey % 5 IN (1, 2) OR s_suppkey % 7 = 0", plain=True)
def src_15(m):
    k = F.col("s_suppkey")
    rows = m.table("supplier").select(F.col("s_name").alias("path"), F.col("s_acctbal").alias("mtime"), k)
    listed = rows.filter(k % 5 != 2).withColumn("mtime", F.col("mtime") + F.when(k % 7 == 0, 5).otherwise(0.5))
    return files.stale(rows.filter(k % 5 != 1), listed)


# ---- extraction: sources made from parts


def _sources(m):
    w1, w2 = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    text = F.concat(F.lit("// run \"me\"\nvar $x : Text\n$r:=cs."), "p_type", F.lit(".new($x) /* c */\n"), w1, F.lit("_"), w2, F.lit("(\"a;b()\"; $r)\n$r.total+=1\nIf ($r.ok)\n  $r.items.first().save()\nEnd if\nEXECUTE METHOD(\""), w2, F.lit("\")\n"))
    return m.table("part").select(F.concat(F.lit("Methods/m"), F.col("p_partkey").cast("string"), F.lit(".4dm")).alias("rel_path"), F.lit("method").alias("category"), F.lit(None).cast("string").alias("container"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("base"), text.alias("content"))


@query("ext_01_symbols", "SELECT concat('Methods/m', p_partkey, '.4dm') AS rel_path, concat('ProjectMethod:m', p_partkey) AS symbol_id, 0 AS line FROM part", plain=True)
def ext_01(m):
    return extract.symbols_of(_sources(m)).select("rel_path", "symbol_id", "line")


@query("ext_02_call_sites", """WITH s AS (SELECT p_partkey, p_type, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part)
SELECT p_partkey, hint.no AS line, hint.kind AS hint_kind, hint.name AS name, hint.path AS path FROM (SELECT p_partkey, unnest([
{'no': 2, 'kind': 'CsNew', 'name': NULL, 'path': NULL}, {'no': 3, 'kind': 'BareName', 'name': concat(w1, '_', w2), 'path': NULL}, {'no': 4, 'kind': 'VarGet', 'name': 'total', 'path': NULL}, {'no': 4, 'kind': 'VarSet', 'name': 'total', 'path': NULL},
{'no': 5, 'kind': 'VarGet', 'name': 'ok', 'path': NULL}, {'no': 6, 'kind': 'VarGet', 'name': 'items', 'path': NULL}, {'no': 6, 'kind': 'VarChainCall', 'name': 'first', 'path': 'items'}, {'no': 6, 'kind': 'VarChainCall', 'name': 'save', 'path': 'items/first()'}, {'no': 8, 'kind': 'ExecuteMethodLiteral', 'name': w2, 'path': NULL}]) AS hint FROM s)""", plain=True)
def ext_02(m):
    out = extract.sites_of(_sources(m))
    return out.select(F.regexp_extract("rel_path", r"m(\d+)\.4dm", 1).cast("long").alias("p_partkey"), "line", "hint_kind", "name", "path")


@query("txt_05_blocks", "SELECT concat('Methods/m', p_partkey, '.4dm') AS rel_path, 'if' AS kind, 5 AS start_line, 7 AS end_line FROM part", plain=True)
def txt_05(m):
    return extract.blocks_table(_sources(m), "rel_path", "content")


# ---- incremental upkeep: events as changes


_CHANGES = "c AS (SELECT event_id AS event_seq, CAST(event_id - event_id % 500 AS BIGINT) AS batch_id, concat('Project/Sources/Methods/m', user_id, '.4dm') AS path, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'change' END AS kind FROM {events})"


def _changes(m):
    return m.spark.sql("WITH " + _CHANGES + " SELECT * FROM c", events=m.table("events"))


_C = "WITH " + _CHANGES.replace("{events}", "events")


@query("str_01_classify_change", "SELECT n_nationkey, ['code', 'catalog', 'constants', 'components', 'unknown'][n_nationkey % 5 + 1] AS category FROM nation", plain=True)
def str_01(m):
    k = F.col("n_nationkey") % 5
    path = F.when(k == 0, F.concat(F.lit("Project/Sources/Classes/"), "n_name", F.lit(".4dm"))).when(k == 1, "Project/Sources/catalog.4DCatalog").when(k == 2, F.concat(F.lit("Resources/Constants_"), "n_name", F.lit(".xlf"))).when(k == 3, F.concat(F.lit("Components/"), "n_name", F.lit(".4DZ"))).otherwise(F.concat(F.lit("docs/"), "n_name"))
    return m.table("nation").select("n_nationkey", files.classify_change(path).alias("category"))


@query("str_02_last_write_wins", _C + " SELECT batch_id, path, arg_max(kind, event_seq) AS kind FROM c GROUP BY 1, 2", plain=True)
def str_02(m):
    return incremental.last_per_path(_changes(m))


@query("str_03_batch_policy", _C + ", n AS (SELECT batch_id, count(DISTINCT path) AS n_changed, count(DISTINCT path) FILTER (kind = 'delete') AS n_deleted FROM c GROUP BY 1) SELECT batch_id, n_deleted > 140 OR n_changed > greatest(200, ceil(150 * 0.2)) AS rebuild FROM n", plain=True)
def str_03(m):
    n = _changes(m).groupBy("batch_id").agg(F.countDistinct("path").alias("n"), F.countDistinct(F.when(F.col("kind") == "delete", F.col("path"))).alias("d"))
    return n.select("batch_id", incremental.must_rebuild(F.col("n"), F.lit(150), F.when(F.col("d") > 140, 1).otherwise(0)).alias("rebuild"))


@query("str_04_apply_batch", _C + ", last AS (SELECT path, arg_max(kind, event_seq) AS kind FROM c WHERE batch_id = 500 GROUP BY 1), old AS (SELECT concat('Project/Sources/Methods/m', c_custkey % 200, '.4dm') AS path, 'old' AS version, count(*) AS n FROM customer GROUP BY 1) SELECT path, version, n FROM old WHERE path NOT IN (SELECT path FROM last) UNION ALL SELECT path, 'new', 1 FROM last WHERE kind <> 'delete'", plain=True)
def str_04(m):
    old = m.table("customer").groupBy(F.concat(F.lit("Project/Sources/Methods/m"), (F.col("c_custkey") % 200).cast("string"), F.lit(".4dm")).alias("path")).agg(F.count("*").alias("n")).select("path", F.lit("old").alias("version"), "n")
    changed = incremental.last_per_path(_changes(m).filter("batch_id = 500")).select("path", "kind")
    new = changed.select("path", F.lit("new").alias("version"), F.lit(1).cast("long").alias("n"))
    return incremental.apply_batch(old, changed, new)


@query("str_05_remove_contribution", _C + " SELECT event_seq, path FROM c WHERE path NOT IN (SELECT path FROM c WHERE batch_id = 0 AND kind = 'delete')", plain=True)
def str_05(m):
    gone = _changes(m).filter("batch_id = 0 and kind = 'delete'").select("path")
    return _changes(m).join(gone, "path", "left_anti").select("event_seq", "path")


@query("str_07_affected_dependents", _C + ", gone AS (SELECT DISTINCT path FROM c WHERE batch_id = 0 AND kind = 'delete'), sites AS (SELECT p_partkey AS site_no, concat('Project/Sources/Methods/m', p_partkey % 150, '.4dm') AS path, split_part(p_name, ' ', 1) AS a, lower(p_type) AS b FROM part) SELECT site_no FROM sites WHERE path NOT IN (SELECT path FROM gone) AND (a IN ('red', 'small') OR b IN ('red', 'small'))", plain=True)
def str_07(m):
    gone = _changes(m).filter("batch_id = 0 and kind = 'delete'").select("path").distinct()
    keys = incremental.name_keys(F.lit("VarCall"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_type"))
    sites = m.table("part").select(F.col("p_partkey").alias("site_no"), F.concat(F.lit("Project/Sources/Methods/m"), (F.col("p_partkey") % 150).cast("string"), F.lit(".4dm")).alias("path"), keys.alias("keys"))
    return incremental.affected_sites(sites, m.spark.createDataFrame([("red",), ("small",)], "key string"), gone).select("site_no")


@query("str_08_name_keys", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(lower(p_type), ',', lower(p_brand)) END AS keys FROM part", plain=True)
def str_08(m):
    kind = F.when(F.col("p_partkey") % 3 == 0, "Formula").otherwise("CsCall")
    return m.table("part").select("p_partkey", F.array_join(incremental.name_keys(kind, F.col("p_type"), F.col("p_brand")), ",").alias("keys"))
