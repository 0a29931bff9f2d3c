"""Registered queries: whole sources made from the driver's tables, indexed and patched."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom import indexer
from codeloom.functions import extract
from codeloom.operators import lint
from codeloom.plans.registered import query

#: Sources as SQL of both engines: a class for each nation (the first five are the others' bases) and a method for each part, of four kinds.
_CLASS = """SELECT concat('Project/Sources/Classes/C', k, '.4dm') AS rel_path, 'class' AS category, concat('C', k) AS container, concat('C', k) AS base, concat(
CASE WHEN k >= 5 THEN concat('Class extends C', k % 5) ELSE '// a base' END, chr(10), 'property note : Text', chr(10),
CASE WHEN k % 2 = 0 THEN concat('Class constructor($a : Text)', chr(10), '  This.note:=$a', chr(10)) ELSE concat('// no', chr(10), '// constructor', chr(10)) END,
CASE WHEN k < 5 THEN concat('Function total($n : Integer) : Text', chr(10), '  return This.label($n)', chr(10)) ELSE concat('Function run()', chr(10), '  $t:=Super.total(1)', chr(10)) END,
CASE WHEN k % 3 = 0 THEN concat('Function get size() : Integer', chr(10), '  return This.note', chr(10)) ELSE '' END) AS content FROM (SELECT n_nationkey AS k FROM {nation}) n"""
_METHOD = """SELECT concat('Project/Sources/Methods/m', p, '.4dm') AS rel_path, 'method' AS category, CAST(NULL AS {string}) AS container, concat('m', p) AS base, concat(
'#declare($n : Integer) -> $r : Text', chr(10), 'var $x : cs.C', p % 25, ' // Missing_0()', chr(10),
CASE p % 4 WHEN 0 THEN concat('$x:=cs.C', p % 25, '.new()') WHEN 1 THEN concat('m', CAST((p - 1) / 2 AS BIGINT), '($n)') WHEN 2 THEN '$r:=$x.total($n)' ELSE concat('CALL WORKER("w"; "M', p + 1, '")') END, chr(10),
'If ($x.size>1)', chr(10), 'Missing_', p % 7, '("m1()"; ', repeat(chr(92), 1), chr(10), '  m', p, '($r))', chr(10), '$x.note:="a"', chr(10), 'End if', chr(10)) AS content FROM (SELECT p_partkey AS p FROM {part}) q"""


def _sources(m):
    names = {"string": "STRING", "nation": "{nation}", "part": "{part}"}
    text = _CLASS.format(**names) + " UNION ALL " + _METHOD.format(**names)
    return m.spark.sql(text, nation=m.table("nation"), part=m.table("part")).withColumn("uri", F.concat(F.lit("file:///p/"), "rel_path"))


#: What the sources say, edge by edge.
_EDGES = """, c AS (SELECT n_nationkey AS k FROM nation), p AS (SELECT p_partkey AS p, p_partkey % 25 AS k FROM part), ids AS (SELECT p_partkey AS p FROM part),
e AS (SELECT concat('ClassConstructor:C', k, '.C', k) AS from_id, concat('ClassProperty:C', k, '.note') AS to_id, 'Static' AS call_kind, 3 AS line, 'write' AS access, true AS resolved FROM c WHERE k % 2 = 0
UNION ALL SELECT concat('ClassFunction:C', k, '.total'), 'Unresolved:This.label', 'Dynamic', 5, NULL, false FROM c WHERE k < 5
UNION ALL SELECT concat('ClassFunction:C', k, '.run'), concat('ClassFunction:C', k % 5, '.total'), 'Inherited', 5, NULL, true FROM c WHERE k >= 5
UNION ALL SELECT concat('ClassGetter:C', k, '.size'), concat('ClassProperty:C', k, '.note'), 'Static', 7, 'read', true FROM c WHERE k % 3 = 0
UNION ALL SELECT concat('ProjectMethod:m', p), CASE WHEN k % 2 = 0 THEN concat('ClassConstructor:C', k, '.C', k) ELSE concat('Class:C', k) END, 'Static', 2, NULL, true FROM p WHERE p % 4 = 0
UNION ALL SELECT concat('ProjectMethod:m', p.p), CASE WHEN i.p IS NULL THEN concat('Unresolved:m', (p.p - 1) // 2) ELSE concat('ProjectMethod:m', i.p) END, CASE WHEN i.p IS NULL THEN 'Dynamic' ELSE 'Static' END, 2, NULL, i.p IS NOT NULL FROM p LEFT JOIN ids i ON i.p = (p.p - 1) // 2 WHERE p.p % 4 = 1
UNION ALL SELECT concat('ProjectMethod:m', p), concat('ClassFunction:C', k % 5, '.total'), 'Static', 2, NULL, true FROM p WHERE p % 4 = 2
UNION ALL SELECT concat('ProjectMethod:m', p.p), CASE WHEN i.p IS NULL THEN concat('Unresolved:M', p.p + 1) ELSE concat('ProjectMethod:m', i.p) END, 'Dynamic', 2, NULL, i.p IS NOT NULL FROM p LEFT JOIN ids i ON i.p = p.p + 1 WHERE p.p % 4 = 3
UNION ALL SELECT concat('ProjectMethod:m', p), concat('ClassGetter:C', CASE WHEN k % 3 = 0 THEN k ELSE k % 5 END, '.size'), 'Static', 3, 'read', true FROM p WHERE k % 3 = 0 OR (k % 5) % 3 = 0
UNION ALL SELECT concat('ProjectMethod:m', p), concat('Unresolved:Missing_', p % 7), 'Dynamic', 4, NULL, false FROM p
UNION ALL SELECT concat('ProjectMethod:m', p), concat('ProjectMethod:m', p), 'Static', 5, NULL, true FROM p
UNION ALL SELECT concat('ProjectMethod:m', p), concat('ClassProperty:C', k, '.note'), 'Static', 6, 'write', true FROM p)"""


@query("qry_12_reindex", _EDGES.replace(", c AS", "WITH c AS", 1) + " SELECT DISTINCT * FROM e", plain=True)
def qry_12(m):
    edges = indexer.index_sources(_sources(m), commands=["Length"]).edges
    return edges.select("from_id", "to_id", "call_kind", "line", "access", "resolved")


@query("jon_27_symbol_assembly", _EDGES.replace(", c AS", "WITH c AS", 1) + """ SELECT kind, count(*) AS n FROM (SELECT 'Class' AS kind, concat('C', k) AS id FROM c UNION ALL SELECT 'ClassProperty', concat('C', k, '.note') FROM c UNION ALL SELECT 'ClassConstructor', concat('C', k) FROM c WHERE k % 2 = 0 UNION ALL SELECT 'ClassFunction', concat('C', k) FROM c UNION ALL SELECT 'ClassGetter', concat('C', k) FROM c WHERE k % 3 = 0
UNION ALL SELECT 'ProjectMethod', concat('m', p) FROM p UNION ALL SELECT DISTINCT 'Unresolved', to_id FROM e WHERE NOT resolved) GROUP BY 1""", plain=True)
def jon_27(m):
    symbols = indexer.index_sources(_sources(m)).symbols
    return symbols.groupBy("kind").agg(F.count("*").alias("n"))


@query("ext_05_bodies", "SELECT concat('ProjectMethod:m', p_partkey) AS symbol_id, 0 AS line, 8 AS end_line FROM part UNION ALL SELECT concat('Class:C', n_nationkey), 0, CAST(6 + CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 0 END AS INT) FROM nation UNION ALL SELECT concat('ClassConstructor:C', n_nationkey, '.C', n_nationkey), 2, 3 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT concat('ClassFunction:C', n_nationkey, CASE WHEN n_nationkey < 5 THEN '.total' ELSE '.run' END), 4, CASE WHEN n_nationkey % 3 = 0 THEN 5 ELSE 6 END FROM nation UNION ALL SELECT concat('ClassGetter:C', n_nationkey, '.size'), 6, 8 FROM nation WHERE n_nationkey % 3 = 0", plain=True)
def ext_05(m):
    return extract.symbols_of(_sources(m)).filter("end_line is not null").select("symbol_id", "line", "end_line")


@query("ext_07_infer_locals", "SELECT concat('ProjectMethod:m', p_partkey) AS from_id, unnest(['n', 'r', 'x']) AS variable, unnest(['Integer', 'Text', concat('cs.C', p_partkey % 25)]) AS type FROM part UNION ALL SELECT concat('ClassConstructor:C', n_nationkey, '.C', n_nationkey), 'a', 'Text' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT concat('ClassFunction:C', n_nationkey, '.total'), 'n', 'Integer' FROM nation WHERE n_nationkey < 5", plain=True)
def ext_07(m):
    return extract.locals_of(_sources(m)).select("from_id", "variable", "type")


#: Methods whose variables are declared, read and written in every way, as SQL of both engines.
_LOCALS = "concat('#declare($p : Text; $_q : Text; $s', p_partkey % 3, ' : Text) -> $r : Text', chr(10), 'var $a : Text', chr(10), '$a:=$p // $s1', chr(10), '$b', p_partkey % 2, ':=$a + $s0', chr(10), '$c:=$b0', chr(10), '$r:=$c')"


def _uses(m):
    sources = m.table("part").select(F.col("p_partkey").cast("string").alias("rel_path"), F.lit("method").alias("category"), F.lit(None).cast("string").alias("container"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("base"), F.expr(_LOCALS).alias("content"))
    return extract.uses_of(sources)


def _found(rows):
    return rows.select(F.col("rel_path").cast("long").alias("p_partkey"), "variable", "line")


@query("lnt_04_implicit_local", "SELECT p_partkey, concat('b', p_partkey % 2) AS variable, 3 AS line FROM part UNION ALL SELECT p_partkey, 'c', 4 FROM part", plain=True)
def lnt_04(m):
    return _found(lint.implicit_locals(_uses(m)))


@query("lnt_06_unused_parameter", "SELECT p_partkey, concat('s', p_partkey % 3) AS variable, 0 AS line FROM part WHERE p_partkey % 3 <> 0", plain=True)
def lnt_06(m):
    return _found(lint.unused_parameters(_uses(m)))


@query("lnt_07_unused_local", "SELECT p_partkey, 'b1' AS variable, 3 AS line FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'r', 5 FROM part", plain=True)
def lnt_07(m):
    return _found(lint.unused_locals(_uses(m)))


# ---- component classes, and members of typed variables


_COMPONENT_SITE = "CASE p % 5 WHEN 0 THEN concat('cs.', space, '.Saw.new()') WHEN 1 THEN concat('cs.', space, '.Saw.cut(1)') WHEN 2 THEN concat('cs.', space, '.Nail.hit()') WHEN 3 THEN concat('cs.', space, '.None.new()') ELSE concat('comp_run_', k, '(1)') END"
_SPACED = "SELECT p_partkey AS p, p_partkey % 25 AS k, concat(CASE WHEN p_partkey % 2 = 0 THEN 'ns' ELSE 'Comp' END, p_partkey % 25 + CASE WHEN p_partkey % 2 = p_partkey % 25 % 2 THEN 0 ELSE 100 END) AS space FROM {part}"


@query("jon_05_component_calls", f"WITH s AS ({_SPACED.format(part='part')}), t AS (SELECT *, p % 2 = k % 2 AS known FROM s) SELECT p, CASE WHEN p % 5 = 4 THEN concat('ComponentMethod:comp_run_', k) WHEN p % 5 = 0 AND known AND k % 3 = 0 THEN concat('ClassConstructor:cs.', space, '.Saw.constructor') WHEN p % 5 = 0 AND known THEN concat('Class:cs.', space, '.Saw') WHEN p % 5 = 0 THEN concat('Unresolved:cs.', space, '.Saw.new') WHEN p % 5 = 1 AND known THEN concat('ClassFunction:cs.', space, '.Saw.cut') WHEN p % 5 = 1 THEN concat('Unresolved:cs.', space, '.Saw.cut') WHEN p % 5 = 2 AND known THEN concat('Class:cs.', space, '.Nail') WHEN p % 5 = 2 THEN concat('Unresolved:cs.', space, '.Nail.hit') ELSE concat('Unresolved:cs.', space, '.None.new') END AS to_id FROM t", plain=True)
def jon_05(m):
    n = m.table("nation").select(F.col("n_nationkey").alias("k"))
    name = F.concat(F.lit("Comp"), F.col("k").cast("string"))
    none = F.lit(None).cast("string")

    def rows(kind, cls, what, keep=F.lit(True)):
        return n.filter(keep).select(name.alias("component"), F.lit(kind).alias("kind"), cls.alias("class"), what.alias("name"), none.alias("type"))

    parts = rows("namespace", none, F.concat(F.lit("ns"), F.col("k").cast("string")), F.col("k") % 2 == 0)
    for x in (rows("class", none, F.lit("Saw")), rows("class", none, F.lit("Nail")), rows("constructor", F.lit("Saw"), F.lit("Saw"), F.col("k") % 3 == 0), rows("function", F.lit("Saw"), F.lit("cut")), rows("method", none, F.concat(F.lit("comp_run_"), F.col("k").cast("string")))):
        parts = parts.union(x)
    sources = m.spark.sql(f"SELECT concat('Project/Sources/Methods/m', p, '.4dm') AS rel_path, {_COMPONENT_SITE} AS content, 'method' AS category, CAST(NULL AS STRING) AS container, concat('m', p) AS base FROM ({_SPACED})", part=m.table("part"))
    edges = indexer.index_sources(sources.withColumn("uri", F.concat(F.lit("file:///p/"), "rel_path")), component_rows=parts).edges
    return edges.select(F.regexp_extract("from_id", r"m(\d+)$", 1).cast("long").alias("p"), "to_id")


_TYPED = "CASE p % 4 WHEN 0 THEN concat('$r:=ds.T', k, '.new()', chr(10), '$r.check()') WHEN 1 THEN concat('$q:=ds.T', k, '.query(\"a\")', chr(10), '$q.first()') WHEN 2 THEN concat('ds[_T', k, '].new()') ELSE concat('$x:=cs.T', k, 'Entity.new()', chr(10), '$x.check()', chr(10), '$x.check().check()') END"
_TYPED_SQL = """WITH s AS (SELECT p_partkey AS p, p_partkey % 25 AS k, p_partkey % 25 % 2 = 0 AS has FROM part)
SELECT p, 0 AS line, concat('TableBuiltin:ds.T', k, '.new') AS to_id FROM s WHERE p % 4 = 0 UNION ALL SELECT p, 1, CASE WHEN has THEN concat('ClassFunction:T', k, 'Entity.check') ELSE 'Unresolved:$r.check' END FROM s WHERE p % 4 = 0
UNION ALL SELECT p, 0, concat('TableBuiltin:ds.T', k, '.query') FROM s WHERE p % 4 = 1 UNION ALL SELECT p, 1, 'Builtin:Entityselection.first' FROM s WHERE p % 4 = 1
UNION ALL SELECT p, 0, CASE WHEN has THEN concat('Class:T', k, 'Entity') ELSE concat('TableBuiltin:ds.T', k, '.new') END FROM s WHERE p % 4 = 2
UNION ALL SELECT p, 0, CASE WHEN has THEN concat('Class:T', k, 'Entity') ELSE concat('Unresolved:cs.T', k, 'Entity.new') END FROM s WHERE p % 4 = 3
UNION ALL SELECT p, 1, CASE WHEN has THEN concat('ClassFunction:T', k, 'Entity.check') ELSE concat('Builtin:T', k, 'Entity.check') END FROM s WHERE p % 4 = 3
UNION ALL SELECT p, 2, CASE WHEN has THEN concat('ClassFunction:T', k, 'Entity.check') ELSE concat('Builtin:T', k, 'Entity.check') END FROM s WHERE p % 4 = 3
UNION ALL SELECT p, 2, 'Unresolved:$x.check().check' FROM s WHERE p % 4 = 3 AND NOT has"""


@query("jon_24_typed_members", _TYPED_SQL, plain=True)
def jon_24(m):
    tables = "SELECT concat('Project/Sources/Catalog/Tables/T', n_nationkey, '.json') AS rel_path, concat('{{\"@id\":\"', n_nationkey, '\",\"@name\":\"T', n_nationkey, '\"}}') AS content, CAST(NULL AS STRING) AS category, CAST(NULL AS STRING) AS container, CAST(NULL AS STRING) AS base FROM {nation}"
    entities = "SELECT concat('Project/Sources/Classes/T', n_nationkey, 'Entity.4dm'), concat('Class extends Entity', chr(10), 'Function check() : cs.T', n_nationkey, 'Entity', chr(10), '  return This'), 'class', concat('T', n_nationkey, 'Entity'), concat('T', n_nationkey, 'Entity') FROM {nation} WHERE n_nationkey % 2 = 0"
    methods = f"SELECT concat('Project/Sources/Methods/m', p, '.4dm'), {_TYPED}, 'method', CAST(NULL AS STRING), concat('m', p) FROM (SELECT p_partkey AS p, p_partkey % 25 AS k FROM {{part}})"
    sources = m.spark.sql(" UNION ALL ".join([tables, entities, methods]), nation=m.table("nation"), part=m.table("part"))
    edges = indexer.index_sources(sources.withColumn("uri", F.concat(F.lit("file:///p/"), "rel_path"))).edges
    return edges.select(F.regexp_extract("from_id", r"m(\d+)$", 1).cast("long").alias("p"), "line", "to_id")
