"""A project's graph from its files, and patches of it."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom import indexer

PROJECT = {
    "Project/Sources/Classes/Box.4dm": "property note, size : Text\nClass constructor($n : Text)\n  This.note:=$n\nFunction open($key : Text) : cs.Lid\n  return cs.Lid.new()\nFunction get big() : Boolean\n  return This.size\nAlias top lid.name\nlocal Function query big($e : Object)\n  $e:=This.missing()\n",
    "Project/Sources/Classes/Lid.4dm": "Function name() : Text\n  return \"x\" // Run_All()\n",
    "Project/Sources/Classes/Crate.4dm": "Class extends Box\nFunction open($key : Text) : cs.Lid\n  $l:=Super.open($key)\n  This.note:=This.big\n  return $l\nFunction weigh()\n  This.open(\"k\").name()\n",
    "Project/Sources/Classes/RulesEntity.4dm": "Class extends Entity\nFunction check()\n  This.save()\n",
    "Project/Sources/Methods/Run_All.4dm": "#declare($b : cs.Box)\nvar $c : cs.Crate\n$c:=cs.Crate.new()\n$c.open(\"a\").name()\n$c.note+=1\nIf ($b.big)\n  Helper(1; \\\n    $c.weigh())\nEnd if\nCALL WORKER(\"w\"; \"helper\")\nEXECUTE METHOD(\"Nowhere\")\nPg Connect(1)\n",
    "Project/Sources/Methods/Helper.4dm": "$r:=ds.Rules.new()\n$r.check()\n$q:=ds.Rules.query(\"a\")\n$q.first()\nx:=Tint Red\n<>count:=<>count+1\nds[_Rules].new()\nRun_All\nUnknown_Bare\n",
    "Project/Sources/Methods/Compiler_Vars.4dm": "C_LONGINT(<>count)\nC_TEXT(total)\n",
    "Project/Sources/DatabaseMethods/onStartup.4dm": "Run_All(cs.Box.new(\"n\"))\ntotal:=\"a\"\n",
    "Project/Sources/Forms/Main/form.4DForm": '{"pages":[{"objects":{"b":{"dataSource":"Helper(1)"}}}]}',
    "Project/Sources/Forms/Main/method.4dm": "cs.Box.new()\n",
    "Project/Sources/Forms/Main/ObjectMethods/Btn.4dm": "DIALOG(\"Main\")\n",
    "Project/Sources/Catalog/Tables/Rules.json": '{"@id":"1","@name":"Rules"}',
    "Plugins/Pg.bundle/Contents/Resources/manifest.json": '{"commands":[{"name":"Pg Connect"}]}',
    "Resources/Constants_A.xlf": '<xliff xmlns:d4="u"><file><group d4:groupName="Tints"><trans-unit id="k_1" resname="Tint Red" d4:value="1:L"/><trans-unit id="k_2" resname="Tint Blue" d4:value="2:L"/></group></file></xliff>',
}


@pytest.fixture
def root(tmp_path):
    for path, text in PROJECT.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return str(tmp_path)


def test_project_counts_and_edges(spark, root):
    index = indexer.index_project(spark, root)
    counts = {r.kind: r["count"] for r in index.symbols.groupBy("kind").count().collect()}
    assert {k: counts[k] for k in ("Class", "ClassFunction", "ClassGetter", "ClassConstructor", "ClassProperty", "Alias", "ProjectMethod", "CompilerMethod", "DatabaseMethod", "Form", "FormMethod", "FormObjectMethod", "Constant", "Plugin", "PluginCommand", "InterprocessVariable", "ProcessVariable")} == {
        "Class": 4, "ClassFunction": 6, "ClassGetter": 1, "ClassConstructor": 1, "ClassProperty": 2, "Alias": 1, "ProjectMethod": 2, "CompilerMethod": 1, "DatabaseMethod": 1, "Form": 1, "FormMethod": 1, "FormObjectMethod": 1, "Constant": 2, "Plugin": 1, "PluginCommand": 1, "InterprocessVariable": 1, "ProcessVariable": 1,
    }
    unresolved = {r.name for r in index.symbols.filter("kind = 'Unresolved'").collect()}
    assert unresolved == {"This.missing", "Nowhere"}
    total, resolved = index.edges.agg(F.count("*"), F.sum(F.col("resolved").cast("int"))).first()
    assert resolved / total > 0.85
    edges = {(r.from_id.split(":")[1], r.to_id, r.line, r.call_kind, r.access) for r in index.edges.collect()}
    for want in [
        ("Crate.open", "ClassFunction:Box.open", 2, "Inherited", None), ("Crate.open", "ClassProperty:Box.note", 3, "Inherited", "write"), ("Crate.open", "ClassGetter:Box.big", 3, "Inherited", "read"),
        ("Crate.weigh", "ClassFunction:Crate.open", 6, "Static", None), ("Crate.weigh", "ClassFunction:Lid.name", 6, "Static", None),
        ("Box.open", "Class:Lid", 4, "Static", None), ("RulesEntity.check", "Builtin:Entity.save", 2, "Static", None),
        ("Run_All", "Class:Crate", 2, "Static", None), ("Run_All", "ClassFunction:Crate.open", 3, "Static", None), ("Run_All", "ClassFunction:Lid.name", 3, "Static", None),
        ("Run_All", "ClassProperty:Box.note", 4, "Static", "read"), ("Run_All", "ClassProperty:Box.note", 4, "Static", "write"), ("Run_All", "ClassGetter:Box.big", 5, "Static", "read"),
        ("Run_All", "ProjectMethod:Helper", 6, "Static", None), ("Run_All", "ClassFunction:Crate.weigh", 7, "Static", None), ("Run_All", "ProjectMethod:Helper", 9, "Dynamic", None),
        ("Run_All", "PluginCommand:Pg Connect", 11, "Static", None), ("Helper", "ClassFunction:RulesEntity.check", 1, "Static", None), ("Helper", "TableBuiltin:ds.Rules.query", 2, "Static", None),
        ("Helper", "Constant:Tint Red", 4, "Static", None), ("Helper", "InterprocessVariable:count", 5, "Static", None), ("Helper", "Class:RulesEntity", 6, "Static", None), ("Helper", "ProjectMethod:Run_All", 7, "Static", None),
        ("onStartup", "ClassConstructor:Box.Box", 0, "Static", None), ("onStartup", "ProcessVariable:total", 1, "Static", None), ("Main", "ProjectMethod:Helper", 0, "Static", None), ("Main.Btn", "Form:Main", 0, "Static", None),
    ]:
        assert want in edges, want


def test_component_classes_and_prefixes(spark):
    rows = [("Tools", "namespace", None, "tools", None), ("Tools", "method", None, "tool_run", None), ("Tools", "class", None, "Saw", None), ("Tools", "constructor", "Saw", "Saw", None), ("Tools", "function", "Saw", "cut", None), ("Tools", "class", None, "Nail", None)]
    parts = spark.createDataFrame(rows, "component string, kind string, class string, name string, type string")
    text = "cs.tools.Saw.new().cut()\ncs.tools.Saw.cut(1)\ncs.tools.Nail.new()\ncs.tools.Nail.hit()\ncs.tools.None.new()\ntool_run(1)\nPX_do(1)\n"
    sources = spark.createDataFrame([("Project/Sources/Methods/m.4dm", text, "file:///m", "method", None, "m")], "rel_path string, content string, uri string, category string, container string, base string")
    index = indexer.index_sources(sources, component_rows=parts, prefixes=["PX_"])
    got = {(r.line, r.to_id) for r in index.edges.collect()}
    assert {(0, "ClassConstructor:cs.tools.Saw.constructor"), (1, "ClassFunction:cs.tools.Saw.cut"), (2, "Class:cs.tools.Nail"), (3, "Class:cs.tools.Nail"), (4, "Unresolved:cs.tools.None.new"), (5, "ComponentMethod:tool_run"), (6, "Builtin:PX_do")} <= got


SOURCE = "rel_path string, content string, uri string, category string, container string, base string"
NAMES = ["A", "B", "C"]


def _source(rnd, kind, name):
    other, third = rnd.choice(NAMES), rnd.choice(NAMES)
    if kind == "class":
        lines = [f"Class extends {other}" if rnd.random() < 0.5 else "//", f"property p{rnd.randrange(3)} : cs.{third}"]
        lines += [f"Class constructor()\n  This.p{rnd.randrange(3)}:=1"] * (rnd.random() < 0.5)
        for k in range(3):
            if rnd.random() < 0.6:
                lines.append(f"Function f{k}() : cs.{rnd.choice(NAMES)}\n  This.p{rnd.randrange(3)}.f{rnd.randrange(3)}()\n  Super.f{rnd.randrange(3)}()\n  M{rnd.randrange(3)}()")
        return (f"Project/Sources/Classes/{name}.4dm", "\n".join(lines), f"file:///{name}", "class", name, name)
    text = f"var $x : cs.{other}\n$x:=cs.{third}.new()\n$x.f{rnd.randrange(3)}().f{rnd.randrange(3)}()\n$x.p{rnd.randrange(3)}:=$x.p{rnd.randrange(3)}\nM{rnd.randrange(4)}(1)\nCALL WORKER(1; \"M{rnd.randrange(4)}\")\ncs.{other}.f{rnd.randrange(3)}()\n"
    return (f"Project/Sources/Methods/{name}.4dm", text, f"file:///{name}", "method", None, name)


def _content(index):
    edges = sorted(tuple(str(r[c]) for c in ("from_id", "to_id", "line", "call_kind", "access", "resolved", "receiver", "column_no")) for r in index.edges.collect())
    return edges, sorted(tuple(str(r[c]) for c in indexer.SYMBOL_COLUMNS) for r in index.symbols.collect())


@pytest.mark.parametrize("seed", range(2))
def test_patch_equals_rebuild(spark, seed):
    rnd = random.Random(seed)
    now = {(k, n): _source(rnd, k, n) for k, n in [("class", x) for x in NAMES] + [("method", f"M{i}") for i in range(3)]}
    project = indexer.build(spark.createDataFrame(list(now.values()), SOURCE))
    for _ in range(2):
        changes = []
        for key in rnd.sample(sorted(now) + [("method", "M3")], 2):
            if key in now and rnd.random() < 0.35:
                changes.append((now.pop(key)[0], "delete"))
            else:
                now[key] = _source(rnd, *key)
                changes.append((now[key][0], "change"))
        new = spark.createDataFrame([x for x in now.values() if (x[0], "change") in changes], SOURCE)
        project = indexer.patch(project, spark.createDataFrame(changes, "path string, kind string"), new)
        assert _content(project.index) == _content(indexer.build(spark.createDataFrame(list(now.values()), SOURCE)).index)
