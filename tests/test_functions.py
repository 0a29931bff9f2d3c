"""Scanning, extraction and text functions on hand-written sources."""

from hypothesis import given
from hypothesis import strategies as st

from codeloom.functions.extract import blocks_of, extract_source, sites_of_line
from codeloom.functions.text import common_edit, open_call, scan_line
from codeloom.operators.lookup import fuzzy_pattern, parse_filter


def hints(line, constants=(), commands=()):
    return [(s["hint_kind"], s.get("name")) for s in sites_of_line(scan_line(line), set(constants), set(commands))]


def test_scan_line_drops_comments_and_numbers_strings():
    assert scan_line('a:="x""y" + "//" // rest')[:2] == ('a:="0" + "1" ', ['x"y', "//"])
    assert scan_line("a /* b */ c ` d")[0] == "a  c "
    assert scan_line("")[2] == [0]
    assert scan_line('"open')[1] == ["open"]


@given(st.text(alphabet='ab"/*` \\', max_size=30))
def test_scan_line_maps_every_place(line):
    text, _, cols = scan_line(line)
    assert len(cols) == len(text) + 1 and cols == sorted(cols) and all(0 <= c <= len(line) for c in cols)


def test_call_sites():
    assert hints("$x:=cs.Order.new().total()") == [("CsNew", None), ("CsChainCall", "total")]
    assert hints("cs.NS.Order.new(1)") == [("CsNewNs", None)]
    assert hints("This.cache.get($k)") == [("ThisGet", "cache"), ("ThisChainCall", "get")]
    assert hints("$i.split+=5") == [("VarGet", "split"), ("VarSet", "split")]
    assert hints("$i.split:=5") == [("VarSet", "split")]
    assert hints("ds[_Rules].new()") == [("DsBracketNew", None)]
    assert hints("ds.Rules.all()") == [("DsCall", "all")]
    assert hints("Super.run()") == [("SuperCall", "run")]
    assert hints("Run_All") == [("ProjectMethodBare", "Run_All")]
    assert hints("If (Check($a))") == [("BareName", "Check")]
    assert hints("x:=My Red Const", constants=["my red const"]) == [("ConstantRef", "My Red Const")]
    assert hints("WP New(1)", commands=["WP New"]) == [("BuiltinChain", "WP New")]
    assert hints('CALL WORKER("w"; "Job"; 1)') == [("CallWorker", "Job")]
    assert hints("EXECUTE METHOD($m)") == [("ExecuteMethodDynamic", None)]
    assert hints('DIALOG([T]; "Edit")') == [("FormRef", "Edit")]
    assert hints("<>count:=1") == [("InterprocessRef", "count")]
    assert hints("// Run_All()") == []


def test_class_source():
    source = "Class extends Base\nproperty a, b : Text\nClass constructor($p : Text)\n  This.a:=$p\nFunction get size() : Integer\n  return This.b.length()\nFunction run($x : Text) -> $r : Text\n  This.go()"
    symbols, sites, *_ = extract_source("class", "Box", "Box", source)
    assert [s["symbol_id"] for s in symbols] == ["Class:Box", "ClassProperty:Box.a", "ClassProperty:Box.b", "ClassConstructor:Box.Box", "ClassGetter:Box.size", "ClassFunction:Box.run"]
    assert symbols[0]["extends_class"] == "Base"
    assert [(s["from_id"], s["hint_kind"]) for s in sites] == [("ClassConstructor:Box.Box", "ThisSet"), ("ClassGetter:Box.size", "ThisGet"), ("ClassGetter:Box.size", "ThisChainCall"), ("ClassFunction:Box.run", "ThisCall")]


def test_blocks():
    assert blocks_of("If (a)\nFor ($i;1;2)\nEnd for\nEnd if") == [("for", 1, 2), ("if", 0, 3)]
    assert blocks_of("Case of\nIf (a)\nEnd case") == [("case", 0, 2)]
    assert blocks_of("While (a)\nEnd\nRepeat") == [("while", 0, 1)]
    assert blocks_of("Function a\nx\nFunction b\ny") == [("function", 0, 1), ("function", 2, 3), ("class", 0, 3)]


def test_small_functions():
    assert common_edit("abcd", "abXd") == (2, 3, 3)
    assert common_edit("aa", "aaa") == (2, 2, 3)
    assert open_call('Run(1; "a(;"; In(2); ') == ("Run", 3)
    assert open_call("Run(1)") is None
    assert parse_filter("ab -x >=3 c") == ("ab c", ["x"], (">=", 3))
    assert fuzzy_pattern("a.b") == r"(?s)a.*\..*b"


def test_suppression_directives(spark):
    from pyspark.sql import functions as F

    from codeloom.functions import text as T

    source = """// lint-disable style/one, style/two
Function a() // lint-disable-line unused/local unused/parameter
` lint-disable-next-line decl/implicit-local
/* lint-disable-line types/missing-param-type */ x
lint-disable-line not/commented
// 4d-lint-disable-line older
// lint-disable-line
// lint-disabled all"""
    lines = source.split("\n") + [""] * 20 + ["// lint-disable too/late", "// lint-disable-line late/line"]
    rows = spark.createDataFrame([("u", i, t) for i, t in enumerate(lines)], "uri string, line int, text string")
    got = {(r.line, r.rule_id) for r in T.suppression_map(rows).collect()}
    assert got == {(None, "style/one"), (None, "style/two"), (1, "unused/local"), (1, "unused/parameter"), (3, "decl/implicit-local"), (3, "types/missing-param-type"), (5, "older"), (29, "late/line")}
    assert rows.filter(T.suppressions(F.col("text"))[0].isNotNull()).count() == 7


def test_test_patterns(spark):
    from codeloom.operators import lookup

    rows = [("a", "test_a", "ProjectMethod", None, None), ("b", "UT_b", "ProjectMethod", None, None), ("c", "UT_c", "ClassFunction", "Box", None), ("d", "run", "ClassFunction", "Box_Test", None), ("e", "x_Test", "ProjectMethod", None, None), ("f", "Any", "Class", None, "Test"), ("g", "test_g", "ClassFunction", "Box", None)]
    symbols = spark.createDataFrame(rows, "symbol_id string, name string, kind string, owner_class string, class_flavor string")
    assert {r.symbol_id for r in symbols.filter(lookup.is_test()).collect()} == {"a", "b", "d", "f", "g"}
    assert {r.symbol_id for r in lookup.coverage_seeds(symbols).collect()} == {"b", "g"}
    assert lookup.test_patterns("([", None, "^Q") == {"function": "^test_", "owner": "_Test$", "method": "^Q"}


def test_statements_join_lines():
    from codeloom.functions.extract import extract_source, statements

    assert [(n, t[0]) for n, t in statements("a(1; \\\n  b)\nc\n(open\nd")] == [(0, "a(1;    b)"), (2, "c"), (3, "(open"), (4, "d")]
    assert [t[1] for _, t in statements('f("x"; (\n"y")\n)')] == [["x", "y"]]
    _, sites, types, _ = extract_source("method", None, "m", 'C_TEXT($a;\n  $b)\nRun("p"; \\\n  EXECUTE METHOD("q"))\n$s:=ds.T.query("z")')
    assert [(s["hint_kind"], s["name"], s["line"], s["column_no"]) for s in sites] == [("BareName", "Run", 2, 0), ("ExecuteMethodLiteral", "q", 3, 17), ("DsCall", "query", 4, 9)]
    assert {t["variable"]: t["type"] for t in types} == {"a": "Text", "b": "Text", "s": "entitySelectionOf:T"}


def test_local_uses():
    from codeloom.functions.extract import extract_source

    source = "#declare($p : Text; $q : Text) -> $r : Text\nvar $a; $b : Text\nvar $c : Text:=$p\n$a:=$b+$d\n$e+=1\n$a.x:=$a[$e]\nC_TEXT($f)"
    uses = {}
    for u in extract_source("method", None, "m", source)[3]:
        uses.setdefault(u["variable"], []).append((u["use"], u["line"]))
    assert uses == {"p": [("param", 0)], "q": [("param", 0)], "r": [("result", 0)], "a": [("var", 1), ("write", 3), ("read", 5), ("read", 5)], "b": [("var", 1), ("read", 3)], "c": [("var", 2)], "d": [("read", 3)], "e": [("write", 4), ("read", 4), ("read", 5)], "f": [("var", 6)]}
