"""N-gram Jaccard join over groups of similar documents (token-group matrix)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm._components import components, salted
from codeloom.llm._exchange import Part, corpus
from codeloom.llm._tables import column, discard, stored
from codeloom.llm._text import Words, mix, split_words, windows

#: Words of a shingle; two sets link at a similarity of PERCENT hundredths.
SHINGLE, PERCENT = 5, 75
#: Rounds in which sets are grouped by one more sketch and linked inside their group.
ROUNDS = 3
#: Sets and tokens in a group on average, and queries that meet a group in one task.
GROUP, GROUP_TOKENS, QUERIES = 128, 1 << 20, 128
_SALT = np.uint64(0xD1B54A32D192ED03)
_SKETCHES = [f"k{s}" for s in range(ROUNDS)]
_TURNS = np.arange(1, 2 * ROUNDS, 2, dtype=np.uint64) * _SALT


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of every text; the whole of a text with fewer words."""
    h, out = windows(w.hash, size), []
    for a, n in zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(h[a : a + n - size + 1]))
        else:
            out.append(mix(windows(w.hash[a : a + n], n) + np.uint64(n)) if n else np.zeros(0, np.uint64))
    return out


def set_node(s: np.ndarray) -> int:
    """A 63-bit name of a set."""
    return int((mix(s ^ _SALT).sum(dtype=np.uint64) ^ np.uint64(len(s))) & np.uint64(2**63 - 1))


def least_overlap(n, percent: int = PERCENT):
    """ceil(percent / 100 * n): what a set of n shares with any partner at least."""
    return -(-percent * n // 100)


class Sets:
    """The shingle sets of a part, and its distinct ones as one run of tokens."""

    def __init__(self, texts: list[bytes | None], shingle: int):
        self.all = shingle_sets(split_words(texts, lower=True), shingle)
        self.nodes = [set_node(s) for s in self.all]
        self.where = {v: k for k, v in reversed(list(enumerate(self.nodes))) if len(self.all[k])}  # a node's first text
        own = list(self.where.values())
        self.tokens = np.concatenate([self.all[k] for k in own]) if own else np.zeros(0, np.uint64)
        self.stop = np.cumsum([len(self.all[k]) for k in own])
        self.keys, self.which, self.times = np.unique(self.tokens, return_inverse=True, return_counts=True)


def candidate(s: np.ndarray, df: np.ndarray, percent: int) -> tuple | None:
    """Of a set whose tokens stand in `df` sets: the shared tokens, its rare ones, and its sketches.

    None if fewer tokens are shared at all than any link needs. By rarity (df, then value) a set
    and a partner have one of each other's first common - needed + 1 shared tokens.
    """
    many = df > 1
    shared, least = s[many], least_overlap(len(s), percent)
    if len(shared) < max(1, least):
        return None
    rare = shared[np.lexsort((shared, df[many]))][: len(shared) - least + 1]
    return shared.tobytes(), rare.tobytes(), *[int(mix(shared ^ turn).min().view(np.int64)) for turn in _TURNS]


def _in(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return sorted_[at] == x


class Group:
    """Similar sets (node, component, size, shared tokens) with the union of their tokens."""

    def __init__(self, members: list[tuple[int, int, int, np.ndarray]]):
        self.members = members
        self.union, self.times = np.unique(np.concatenate([m[3] for m in members]), return_counts=True) if members else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def ask(self, v: int, n: int, s: np.ndarray, percent: int, wanted, inside: bool = False) -> Iterator[tuple[int, int]]:
        """Links (component, node) of a query with members that are `wanted`, one for each component.

        If the union (of the other members, for a query from `inside`) has too few of the query's
        tokens, no member links and the group is not opened. `wanted` is asked again before each member.
        """
        at = np.searchsorted(self.union, s)
        at[at == len(self.union)] = 0
        held = (self.union[at] == s) & (self.times[at] > int(inside))
        if 100 * int(held.sum()) < percent * n:
            return
        s = s[held]
        for node, root, size, tokens in self.members:
            if node != v and wanted(root) and percent * size <= 100 * n and percent * n <= 100 * size:
                both = int(_in(s, tokens).sum())
                if 100 * both >= percent * (n + size - both):
                    yield root, node


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a sorted stream that agree in the first `keys` columns."""
    at, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != at:
                if held:
                    yield at, held
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield at, held


def _links(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []
    for x in found:
        held.append(x)
        if len(held) == 1 << 14:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=["a", "b"])
            held = []
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], pa.int64()) for k in range(2)], names=["a", "b"])


def _inside(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[int, int]]:
    """Links that join the components inside each group; rows (g, v, root, n, tokens) sorted by g."""
    for _, rows in _runs(batches, 1):
        group = Group([(v, root, n, np.frombuffer(raw, np.uint64)) for v, root, n, raw in rows])
        of = {root: root for _, root, _, _ in group.members}

        def top(x: int, of=of) -> int:
            while of[x] != x:
                of[x] = x = of[of[x]]
            return x

        for v, root, n, s in group.members:
            for other, node in group.ask(v, n, s, percent, lambda r, root=root: top(r) != top(root), inside=True):
                of[top(other)] = top(root)
                yield v, node


def _opened(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[int, int]]:
    """Links of queries with groups; rows (g, salt, query, v, root, above, n, tokens) sorted by the first three."""
    for _, rows in _runs(batches, 2):
        group = Group([(v, root, n, np.frombuffer(raw, np.uint64)) for query, v, root, _, n, raw in rows if not query])
        for query, v, _, above, n, raw in rows:
            if query and group.members:
                done: set[int] = set()
                for other, node in group.ask(v, n, np.frombuffer(raw, np.uint64), percent, lambda r, done=done, above=above: r > above and r not in done):
                    done.add(other)
                    yield v, node


def _grouped(sets: DataFrame, kind: Column) -> DataFrame:
    """sets (v, root, n, ...) with a group g: those of one kind, cut by hash into groups of about GROUP sets and GROUP_TOKENS tokens.

    Kinds whose sets are in one component already are left out. Only narrow rows are joined, and salted, so a large kind is spread.
    """
    named = sets.withColumn("kind", kind)
    size = named.groupBy("kind").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"), F.min("root").alias("low"), F.max("root").alias("high"))
    cells = F.ceil(F.greatest(F.col("sets") / F.lit(GROUP), F.col("tokens") / F.lit(GROUP_TOKENS)))
    size = size.select("kind", cells.alias("cells"), (F.col("low") != F.col("high")).alias("mixed"), F.col("sets").alias("weight"))
    out = salted(named, size, "kind", "v")
    return out.withColumn("g", F.xxhash64("kind", F.pmod(F.xxhash64("v", "kind"), F.col("cells"))))


def _open(asks: DataFrame, grouped: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that queries find in groups; asks (v, g, above), grouped (g, v, root), sets (v, n, tokens)."""
    load = asks.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("parts"))
    queries = asks.join(load, "g").select("g", F.pmod(F.xxhash64("v"), F.col("parts")).alias("salt"), F.lit(True).alias("query"), "v", F.lit(None).cast("long").alias("root"), "above")
    doors = load.select("g", F.explode(F.expr("sequence(0L, parts - 1L)")).alias("salt"))
    rows = doors.join(grouped.select("g", "v", "root"), "g").select("g", "salt", F.lit(False).alias("query"), "v", "root", F.lit(None).cast("long").alias("above")).union(queries)
    full = rows.join(sets.select("v", "n", "tokens"), "v").select("g", "salt", "query", "v", "root", "above", "n", "tokens")
    return full.repartition("g", "salt").sortWithinPartitions("g", "salt", "query", "v").mapInArrow(lambda it: _links(_opened(it, percent)), "a long, b long")


def rooted(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, row, n, root) of every row: its shingles and its component (null for the empty set).

    A-Z are lower-cased. Rows with equal shingle sets are one node. Each part of the corpus learns
    in how many sets each of its shingles stands; a set can link only if it shares as many tokens
    as a link needs with any others, and such sets keep their shared tokens, the rare ones among
    which any partner has one, and sketches (least hashes of the shared tokens).

    Sets of one sketch are similar: they form groups of bounded size, each with the union of its
    tokens. Over a few rounds, one a sketch, every set asks its own group, unless all of it is one
    component. Then the token-group matrix is asked across groups: those of a component, and those
    of similar sets without a link. A set asks each group of a larger component, or of later sets
    without a link, with which it shares a rare token, if what is left of both behind that token
    can reach the threshold. In either case the union bounds the overlap first, and only groups
    that can hold a link are opened. All links between different sets are so found, or lie inside
    one component already. `row` is a hash of key and text.

    A null or empty text, or one without words, has the empty set and links with nothing. Rows
    with a null key take part. Repeated rows are in one component. An empty table has no rows.
    Tokens and nodes are 64-bit hashes.
    """
    body = column(docs, text).cast("string")
    own = column(docs, key)
    texts = corpus(docs, body, [own, F.xxhash64(own, body)], [own], ["key", "row"])

    def questions(part: Part) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        x = Sets(part.texts, shingle)
        yield 0, x.keys, x.times

    def named(part: Part) -> Iterator[pa.RecordBatch]:
        x = Sets(part.texts, shingle)
        df = part.answers.get(0, np.zeros(0, np.uint64))[x.which]
        out = [None] * len(part.texts)
        for k, b in zip(x.where.values(), x.stop.tolist(), strict=True):
            out[k] = candidate(x.all[k], df[b - len(x.all[k]) : b], percent)
        more = list(zip(*[o or (None,) * (2 + ROUNDS) for o in out], strict=True))
        columns = [*part.columns, pa.array(x.nodes, pa.int64()), pa.array([len(s) for s in x.all], pa.int64()), *[pa.array(c, pa.binary() if k < 2 else pa.int64()) for k, c in enumerate(more)]]
        batch = pa.RecordBatch.from_arrays(columns, names=["key", "row", "node", "n", "tokens", "rare", *_SKETCHES])
        for k in range(0, len(batch), 1024):
            yield batch.slice(k, 1024)

    def rare_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each rare token of a set, with the number of shared tokens from it on."""
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                rare = [np.frombuffer(b, np.int64) for b in part.column(0).to_pylist()]
                sizes = np.array([len(r) for r in rare])
                have = part.column(1).to_numpy()
                inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                left = np.repeat(have // 8, sizes) - inside
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rare)), *[pa.array(np.repeat(part.column(c).to_numpy(), sizes)) for c in range(2, 7)], pa.array(left)], names=["t", "v", "n", "root", "weight", "g", "left"])

    answers = texts.ask(questions, "tokens")
    key_type = texts.rows.schema["key"].dataType.simpleString()
    rows = stored(texts.map(named, f"key {key_type}, row long, node long, n long, tokens binary, rare binary, " + ", ".join(f"{k} long" for k in _SKETCHES), answers), "named")
    discard(answers)
    sets = stored(rows.filter("tokens is not null").select(F.col("node").alias("v"), "n", "tokens", "rare", *_SKETCHES).dropDuplicates(["v"]), "sets")

    links: list[DataFrame] = []
    roots = None

    def with_root() -> DataFrame:
        small = sets.drop("tokens", "rare")
        if roots is None:
            return small.withColumn("root", F.col("v")).withColumn("linked", F.lit(False))
        return small.join(roots, "v", "left").select(*small.columns, F.coalesce("root", "v").alias("root"), F.col("root").isNotNull().alias("linked"))

    for sketch in _SKETCHES:
        group = _grouped(with_root(), F.col(sketch)).filter("mixed").select("g", "v", "root", "n")
        full = group.join(sets.select("v", "tokens"), "v").select("g", "v", "root", "n", "tokens")
        links.append(stored(full.repartition("g").sortWithinPartitions("g", "v").mapInArrow(lambda it: _links(_inside(it, percent)), "a long, b long"), "links"))
        if roots is not None:
            discard(roots)
        roots = components(_all(links))

    # groups of components, and of sets without a link by their first sketch; the latter weigh 1
    kind = F.when(F.col("linked"), F.xxhash64("root", F.lit(1))).otherwise(F.xxhash64(_SKETCHES[0], F.lit(2)))
    grouped = stored(_grouped(with_root(), kind).select("v", "n", "root", F.when(F.col("linked"), F.col("weight")).otherwise(1).alias("weight"), "g"), "groups")
    cells = sets.select("v", "rare", F.octet_length("tokens").alias("have")).join(grouped, "v").select("rare", F.col("have").cast("long"), "v", "n", "root", "weight", "g")
    cells = stored(cells.mapInArrow(rare_of, "t long, v long, n long, root long, weight long, g long, left long"), "rare")
    mixed = cells.groupBy("t").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("t")
    cells_ = stored(cells.join(mixed, "t"), "cells")
    spread = grouped.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    by_group = cells_.groupBy("t", "g").agg(F.max("left").alias("most"), F.max("root").alias("top"), F.max("weight").alias("heft")).join(spread, "g").withColumnRenamed("g", "door")
    asks = cells_.join(by_group, "t").filter("heft > weight or (heft = weight and top > root)")
    # at the first token that both have, what is left of either bounds their overlap
    asks = asks.filter(F.least("left", "most") * (100 + percent) >= (F.col("n") + F.col("low")) * percent)
    asks = asks.filter(F.col("n") * 100 >= F.col("low") * percent).filter(F.col("high") * 100 >= F.col("n") * percent)
    asks = stored(asks.select("v", F.col("door").alias("g"), F.when(F.col("heft") > F.col("weight"), F.lit(-(2**63))).otherwise(F.col("root")).alias("above")).distinct(), "asks")
    links.append(stored(_open(asks, grouped, sets, percent), "links"))
    discard(roots, cells, cells_)
    roots = components(_all(links))
    discard(asks, grouped, sets, *links)
    out = rows.select("key", "row", "node", "n").join(roots.withColumnRenamed("v", "node"), "node", "left")
    return out.select("key", "row", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root"))


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The key, n_shingles and component_id of every row; see `rooted`.

    component_id is the least key of the component that is not null (null if there is none); a row
    with the empty set has its own key.
    """
    out = rooted(docs, text, key, shingle, percent)
    least = out.filter("root is not null").groupBy("root").agg(F.min("key").alias("component_id"))
    out = salted(out, least, "root", "row", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def jaccard_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: of each component the one of least key (null keys last), and
    every row with the empty set. Of fully equal (key, text) rows one stays. Columns are kept."""
    out = rooted(docs, text, key, shingle, percent)
    order = F.struct(F.col("key").isNull().alias("a"), F.col("key").alias("b"), F.col("row").alias("c"))
    first = out.filter("root is not null").groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.c").alias("row"))
    stays = stored(first.union(out.filter("root is null").select("row")).distinct(), "stays")
    inner = [f"c{k}" for k in range(len(docs.columns))]
    named = docs.select(F.xxhash64(column(docs, key), column(docs, text).cast("string")).alias("row"), *[column(docs, c).alias(i) for c, i in zip(docs.columns, inner, strict=True)])
    kept = named.join(stays, "row", "left_semi").withColumn("turn", F.row_number().over(Window.partitionBy("row").orderBy("row")))
    return kept.filter("turn = 1").select(*inner).toDF(*docs.columns)


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.union(x)
    return out


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    """Shingle counts and components of all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + least(5, len(w)) - 1], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, y FROM reach r JOIN link ON r.other = x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""
