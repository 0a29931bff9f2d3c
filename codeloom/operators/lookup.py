"""Point lookups and filters over symbols and edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sets of symbol kinds.
SYNTHETIC = ["Builtin", "TableBuiltin", "Unresolved"]
FUNCTION_KINDS = ["ClassFunction", "ClassGetter", "ClassSetter"]
CLASS_MEMBER_KINDS = ["ClassFunction", "ClassGetter", "ClassSetter", "ClassProperty", "Alias", "ClassConstructor"]
INVOCABLE_KINDS = ["ProjectMethod", "DatabaseMethod", "ComponentMethod", "ClassFunction", "ClassConstructor", "PluginCommand"]
FIELD_KINDS = ["ClassGetter", "ClassSetter", "ClassProperty", "Alias", "Constant", "ProcessVariable", "InterprocessVariable"]
COMPLETION_KINDS = ["ProjectMethod", "DatabaseMethod", "ComponentMethod", "Class", "Constant", "BuiltinConstant", "PluginCommand", "Builtin", "ProcessVariable", "InterprocessVariable"]
TEST_PATTERNS = {"function": "^test_", "owner": "_Test$", "method": "^UT_"}


def by_id(symbols: DataFrame, symbol_id: str) -> DataFrame:
    return symbols.filter(F.col("symbol_id") == symbol_id)


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.filter(F.col("name_lc") == name.lower())


def in_file(symbols: DataFrame, uri: str) -> DataFrame:
    """Symbols of a file, compared after percent-decoding; synthetic ones have no file."""
    decoded = F.coalesce(F.try_url_decode(F.lit(uri)), F.lit(uri))
    return symbols.filter(~F.col("kind").isin(SYNTHETIC)).filter(canonical_uri(F.col("uri")) == decoded)


def canonical_uri(uri: Column) -> Column:
    """Percent-decoded, as it is where that fails."""
    return F.coalesce(F.try_url_decode(uri), uri)


def callees(edges: DataFrame, symbol_id: str, access: str | None = None) -> DataFrame:
    out = edges.filter(F.col("from_id") == symbol_id)
    return out.filter(F.col("access") == access) if access else out


def callers(edges: DataFrame, symbol_id: str, access: str | None = None) -> DataFrame:
    out = edges.filter(F.col("to_id") == symbol_id)
    return out.filter(F.col("access") == access) if access else out


def resolve_symbol(symbols: DataFrame, name: str, kind: str | None = None, owner_class: str | None = None) -> DataFrame:
    """One row: status found, ambiguous or notFound, and the candidates in order."""
    hits = by_name(symbols, name)
    if kind:
        hits = hits.filter(F.lower("kind") == kind.lower())
    if owner_class:
        hits = hits.filter(F.lower("owner_class") == owner_class.lower())
    found = hits.agg(F.transform(F.array_sort(F.collect_list(F.struct("symbol_seq", "symbol_id"))), lambda x: x["symbol_id"]).alias("candidates"))
    size = F.size("candidates")
    return found.select(F.when(size == 1, "found").when(size == 0, "notFound").otherwise("ambiguous").alias("status"), F.array_join("candidates", ",").alias("candidates"))


def lookup_by_name(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of a name; synthetic ones only if there is no other."""
    hits = by_name(symbols, name)
    real = hits.filter(~F.col("kind").isin(SYNTHETIC))
    none = real.limit(1).agg(F.count("*").alias("n_real"))
    return hits.crossJoin(F.broadcast(none)).filter((F.col("n_real") == 0) | ~F.col("kind").isin(SYNTHETIC)).drop("n_real")


def fuzzy_pattern(query: str) -> str:
    """A pattern that fits texts which hold the query's characters in order."""
    return "(?s)" + ".*".join(re.escape(c) for c in query.lower())


def fuzzy(text: Column, query: str) -> Column:
    """Case-insensitive subsequence; an empty query fits all, an empty text nothing else."""
    return F.lower(text).rlike(fuzzy_pattern(query)) if query else F.lit(True)


def parse_filter(query: str) -> tuple[str, list[str], tuple[str, int] | None]:
    """Fuzzy part, excludes (-x) and caller predicate (>=3) of a filter query."""
    words, excludes, predicate = [], [], None
    for token in query.split():
        if m := re.fullmatch(r"(>=|<=|>|<|=)(\d+)", token):
            predicate = (m[1], int(m[2]))
        elif token.startswith("-") and len(token) > 1:
            excludes.append(token[1:])
        else:
            words.append(token)
    return " ".join(words), excludes, predicate


def matches(symbols: DataFrame, edges: DataFrame, query: str, callers_state: str = "all") -> DataFrame:
    """The explorer's predicate: caller counts joined, then state, count predicate, excludes and fuzzy name."""
    text, excludes, predicate = parse_filter(query)
    counts = edges.groupBy(F.col("to_id").alias("symbol_id")).agg(F.count("*").alias("n_callers"))
    out = symbols.join(counts, "symbol_id", "left").withColumn("n_callers", F.coalesce("n_callers", F.lit(0)))
    hay = F.lower(F.concat_ws(".", "owner_class", "name"))
    if callers_state != "all":
        out = out.filter(F.col("n_callers") > 0 if callers_state == "with" else F.col("n_callers") == 0)
    if predicate:
        op, n = predicate
        c = F.col("n_callers")
        out = out.filter({">=": c >= n, "<=": c <= n, ">": c > n, "<": c < n, "=": c == n}[op])
    for x in excludes:
        out = out.filter(~F.contains(hay, F.lit(x.lower())))
    return out.filter(fuzzy(hay, text))


def safe_regex(pattern: str | None) -> bool:
    """Whether a user's pattern is a valid one; a rule with an invalid pattern finds nothing."""
    try:
        re.compile(pattern)
        return True
    except (re.error, TypeError):
        return False


def test_patterns(function: str | None = None, owner: str | None = None, method: str | None = None) -> dict[str, str]:
    """The patterns of test functions, test classes and test methods; the default stands in for a missing or invalid one."""
    given = {"function": function, "owner": owner, "method": method}
    return {k: given[k] if safe_regex(given[k]) else v for k, v in TEST_PATTERNS.items()}


def is_test(patterns: dict[str, str] | None = None) -> Column:
    """Whether a row of symbols is a test: of flavor Test, named like a test function, a project method
    named like a test method, or a member of a class named like a test class."""
    p = patterns or TEST_PATTERNS
    own = F.coalesce(F.col("owner_class").rlike(p["owner"]), F.lit(False))
    flavor = F.coalesce(F.col("class_flavor") == "Test", F.lit(False))
    return flavor | F.col("name").rlike(p["function"]) | ((F.col("kind") == "ProjectMethod") & F.col("name").rlike(p["method"])) | own


def coverage_seeds(symbols: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """The tests that run on their own: class functions named like test functions, project methods named like test methods."""
    p = patterns or TEST_PATTERNS
    return symbols.filter(((F.col("kind") == "ClassFunction") & F.col("name").rlike(p["function"])) | ((F.col("kind") == "ProjectMethod") & F.col("name").rlike(p["method"])))


def is_invocation(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges that run their target: calls, reads of a getter and writes of a setter; other reads and writes of fields run nothing."""
    target = symbols.select(F.col("symbol_id").alias("to_id"), F.col("kind").alias("to_kind"))
    runs = F.col("access").isNull() | ((F.col("to_kind") == "ClassGetter") & (F.col("access") == "read")) | ((F.col("to_kind") == "ClassSetter") & (F.col("access") == "write"))
    return edges.join(target, "to_id").filter(runs)


#: Trace categories: (name, kinds, access) in the order they are tried.
TRACE_CATEGORIES = [
    ("methods", ["ProjectMethod", "DatabaseMethod"], None),
    ("functions", ["ClassFunction"], None),
    ("reads", ["ClassGetter", "ClassProperty", "Alias"], "read"),
    ("writes", ["ClassSetter", "ClassProperty", "Alias", "ClassGetter"], "write"),
    ("classes", ["Class", "ClassConstructor"], None),
    ("constants", ["Constant", "BuiltinConstant"], None),
    ("unresolved", ["Unresolved"], None),
]


def trace_category(kind: Column, access: Column) -> Column:
    """The first category whose kinds hold the kind and whose access, if any, is the edge's (read by default)."""
    out = None
    for name, kinds, need in TRACE_CATEGORIES:
        fits = kind.isin(kinds) if need is None else kind.isin(kinds) & (F.coalesce(access, F.lit("read")) == need)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out
