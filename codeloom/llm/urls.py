"""URL filters: a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm._tables import carry, stored

#: Rules in one broadcast trie, and characters of them: a trie takes some 1.7 KB a rule in a worker. Longer lists take rounds.
MAX_RULES, MAX_RULE_BYTES = 50_000, 4 << 20
ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict)
RULES = [("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", ALLOW), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK)]

_LOWER = {c: c + 32 for c in range(65, 91)}
_ENDS = ("/", "?", "#")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without `://`."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in map(rest.find, _ENDS) if i >= 0), default=len(rest))
    host, path = rest[:cut].translate(_LOWER), rest[cut:]
    return host, path[: min((i for i in (path.find("?"), path.find("#")) if i >= 0), default=len(path))]


class Trie:
    """Host labels from the last to the first, then path segments.

    A host node holds a path trie, whose edges are whole segments; what follows a rule's last slash
    is a prefix of the next segment, kept at the node by its text.
    """

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            tails = node.setdefault("tails", {})
            if tails.get(tail, ("", ""))[1] != BLOCK:  # of equal rules the block holds
                tails[tail] = (host.translate(_LOWER) + path, verdict)

    @staticmethod
    def _paths(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            tails = node.get("tails")
            if tails:
                for size in range(min(len(segment), max(map(len, tails))), -1, -1):
                    if segment[:size] in tails:
                        best = tails[segment[:size]]
                        break
            node = node.get("segments", {}).get(segment)
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """The longest rule that fits: most host labels, then the longest path."""
        best, node, depth = None, self.root, 0
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            depth += 1
            if "paths" in node and (found := self._paths(node["paths"], path)):
                best = (depth, len(found[0]), *found)
        return best


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", keep: list[str] | None = None, default: str = ALLOW, max_rules: int = MAX_RULES, max_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """The columns `keep` (all by default) of every row, then host, path, rule and verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. The rule
    with most host labels holds, then the longest path, then block before allow. Without a fitting
    rule `rule` is null and the verdict is `default`. A null url, or one without `://`, has an empty
    host and path, which no rule fits. Input columns named like an output give way, other names
    don't clash; an empty table has no rows. No shuffle.

    Lists beyond `max_rules` rules or `max_bytes` of them are matched in rounds: each round but the
    last is stored with the best rule so far, and its trie is given up before the next is built.
    """
    added = ["host", "path", "rule", "verdict"]
    kept = carry(pages, url, keep, added)
    spark, width = pages.sparkSession, len(kept.rows.columns)
    best = "labels int, length int, rule string, verdict string"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.rows.schema.fields)
    out, tries = kept.rows, list(_rounds(sorted(rules), max_rules, max_bytes))
    for turn, some in enumerate(tries):
        trie, last = spark.sparkContext.broadcast(Trie(some)), turn == len(tries) - 1

        def run(batches: Iterator[pa.RecordBatch], trie=trie, last=last, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = zip(*[c.to_pylist() for c in batch.columns[width:]], strict=True) if turn else [(None,) * 4] * len(batch)
                parts = [split_url(u) for u in batch.column(0).to_pylist()]
                rows = []
                for (host, path), old in zip(parts, before, strict=True):
                    new = trie.value.match(host, path)
                    rows.append(max((x for x in (old, new) if x and x[0] is not None), key=lambda x: (x[0], x[1], x[3] == BLOCK), default=(None,) * 4))
                rule, verdict = pa.array([r[2] for r in rows], pa.string()), [r[3] for r in rows]
                if last:
                    arrays = [*kept.take(batch), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), rule, pa.array([v or default for v in verdict], pa.string())]
                else:
                    arrays = [*batch.columns[:width], pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), rule, pa.array(verdict, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[str(k) for k in range(len(arrays))])

        if last:
            return kept.named(out.mapInArrow(run, kept.schema + "host string, path string, rule string, verdict string"), added)
        out = stored(out.mapInArrow(run, f"{kinds}, {best}"), "rules")
        trie.destroy()


def _rounds(rules: list[tuple[str, str, str]], max_rules: int, max_bytes: int) -> Iterator[list[tuple[str, str, str]]]:
    """Runs of rules within both bounds; one empty run for no rules at all."""
    held, size = [], 0
    for rule in rules:
        more = len(rule[0]) + len(rule[1])
        if held and (len(held) == max_rules or size + more > max_bytes):
            yield held
            held, size = [], 0
        held.append(rule)
        size += more
    yield held


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, longest rule and verdict for every page's url."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, keep=["page_id"])


OP5_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
rules(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'allow'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(rhost, '.')) DESC, length(rpath) DESC) AS k
    FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM h LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (page_id)
"""
