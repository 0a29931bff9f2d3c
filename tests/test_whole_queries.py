"""Traversals and tokens against plain Python over all rows of the smallest tables."""

import pytest

from codeloom import registry
from codeloom.operators import lookup
from codeloom.plans.projection import model


@pytest.fixture(scope="module")
def graph(spark, sf_dir):
    m = model(spark, sf_dir)
    calls = lookup.is_invocation(m.edges, m.symbols).select("from_id", "to_id").distinct().collect()
    return m.symbols.select("symbol_id", "symbol_seq", "name", "name_lc", "kind", "owner_class").collect(), calls, m.edges.collect()


def closure(steps, seeds):
    seen, todo = set(seeds), list(seeds)
    while todo:
        for x in steps.get(todo.pop(), ()):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def ahead(edges):
    out = {}
    for e in edges:
        out.setdefault(e.from_id, set()).add(e.to_id)
    return out


def test_coverage_follows_every_test(spark, sf_dir, graph):
    symbols, calls, _ = graph
    steps = ahead(calls)
    seeds = [s.symbol_id for s in symbols if (s.kind == "ProjectMethod" and s.name.startswith("UT_")) or (s.kind == "ClassFunction" and s.name.startswith("test_"))]
    reached = {s: closure(steps, [s]) for s in seeds}
    assert len(seeds) > 40
    assert {(r.seed, r.n) for r in registry.queries()["grf_06_call_only_reached"](spark, sf_dir).collect()} == {(s, len(x)) for s, x in reached.items()}
    tests, direct = {}, {}
    for s, ids in reached.items():
        for x in ids - {s}:
            tests[x] = tests.get(x, 0) + 1
            direct[x] = direct.get(x, 0) + (x in steps.get(s, ()))
    maps = {(r.symbol_id, r.n_transitive, r.n_direct) for r in registry.queries()["agg_13_coverage_maps"](spark, sf_dir).collect()}
    assert maps == {(x, n, direct[x]) for x, n in tests.items()}
    is_test = lambda s: s.name.startswith("test_") or (s.kind == "ProjectMethod" and s.name.startswith("UT_")) or (s.owner_class or "").endswith("_Test")
    rows = [s.symbol_id for s in symbols if s.kind in ("ProjectMethod", "ClassFunction") and not is_test(s)]
    got = {(r.symbol_id, r.n_tests, r.covered) for r in registry.queries()["cov_02_coverage"](spark, sf_dir).collect()}
    assert got == {(x, tests.get(x, 0), x in tests) for x in rows}


def test_closure_by_word_numbers_many_seeds(spark):
    """More seeds than a word has bits, in a ring with side ways."""
    from codeloom.operators import graph as g

    steps = [(f"n{i}", f"n{(i + 1) % 150}") for i in range(0, 140)] + [(f"n{i}", f"m{i % 7}") for i in range(150)]
    out = {}
    for a, b in steps:
        out.setdefault(a, set()).add(b)
    seeds = [f"n{i}" for i in range(150)] + ["alone"]
    numbered, reach = g.closure_by_word(spark.createDataFrame(steps, "src string, dst string"), spark.createDataFrame([(s,) for s in seeds], "seed string"))
    want = {s: closure(out, [s]) for s in seeds}
    assert {r.seed: r.n for r in g.reach_sizes(numbered, reach).collect()} == {s: len(x) for s, x in want.items()}
    by = {}
    for s, ids in want.items():
        for x in ids - {s}:
            by[x] = by.get(x, 0) + 1
    assert {r.id: r.n for r in g.reached_by(numbered, reach).collect()} == by


def test_closure_begins_at_every_match(spark, sf_dir, graph):
    symbols, _, edges = graph
    hits = [s.symbol_id for s in symbols if s.kind == "ProjectMethod" and "gear" in s.name_lc]
    got = [r.id for r in registry.queries()["grf_05_filter_visibility"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(closure(ahead(edges), hits))


def test_tokens_of_every_caller(spark, sf_dir, graph):
    by_caller = {}
    for e in graph[2]:
        by_caller.setdefault(e.from_id, []).append((e.line, e.column_no or 0, e.edge_seq, e.to_id))
    tokens, sums = set(), set()
    for caller, rows in by_caller.items():
        line = start = n_line = n_start = 0
        for k, (at, c, *_) in enumerate(sorted(rows)):
            first = k == 0
            tokens.add((caller, k + 1, at - line, c - start if at == line else c))
            n_line, n_start = n_line + at - line, n_start + (c - start if at == line and not first else c)
            line, start = at, c
        sums.add((caller, n_line, n_start))
    got = [tuple(r) for r in registry.queries()["snk_05_semantic_token_deltas"](spark, sf_dir).select("from_id", "k", "delta_line", "delta_start").collect()]
    assert len(got) == len(graph[2]) and set(got) == tokens
    assert {tuple(r) for r in registry.queries()["win_08_token_deltas"](spark, sf_dir).select("from_id", "sum_line", "sum_start").collect()} == sums
