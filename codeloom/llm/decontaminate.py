"""Benchmark decontamination with an FM-index per training shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._suffix import FMIndex
from codeloom.llm._tables import carry, column, stored
from codeloom.llm._text import NOT_ALNUM, Words, blocks, per_text, spans_to_mask, split_words, windows

#: Words of a test phrase; an item with fewer is one phrase.
WINDOW = 10
#: Test texts of more bytes are searched in several rounds, so what is broadcast stays bounded.
MAX_PHRASE_BYTES = 4 << 20
#: Bytes of training text in one shard's index.
SHARD_BYTES = 4 << 20
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass
class Group:
    """Distinct phrases of one length as rows of word numbers, and the items that have each: runs of `items` that begin at `first`."""

    rows: np.ndarray
    items: np.ndarray
    first: np.ndarray


@dataclass
class Phrases:
    """Test phrases over word numbers (1 up: the place in `vocabulary`, which is sorted), by length."""

    vocabulary: np.ndarray
    groups: list[Group]
    names: list[str]
    shortest: int


def build_phrases(ids: list[str], texts: list[bytes | None], window: int) -> Phrases:
    """Every distinct window of the items, and the whole of items with fewer words."""
    w = split_words(texts, lower=True, breaks=NOT_ALNUM)
    vocabulary, inverse = np.unique(w.hash, return_inverse=True)
    number = (inverse + 1).astype(np.int32)
    length = np.minimum(w.counts, window)[w.text]  # of the phrases of each word's item
    begins = np.arange(len(number)) + length <= w.first[1:][w.text]
    groups = []
    for size in np.unique(length):
        at = np.flatnonzero(begins & (length == size))
        _, first, which = np.unique(windows(w.hash, size)[at], return_index=True, return_inverse=True)
        pairs = np.unique(which * len(texts) + w.text[at])
        groups.append(Group(number[at[first][:, None] + np.arange(size)], pairs % len(texts), np.searchsorted(pairs // len(texts), np.arange(len(first) + 1))))
    return Phrases(vocabulary, groups, ids, int(length.min(initial=window)) if len(length) else 0)


def search_shard(w: Words, phrases: Phrases) -> tuple[np.ndarray, list[list[str]]]:
    """Which words of a shard lie in an occurrence of a phrase, and the items found in each text.

    The index holds the shard's texts with each stretch that cannot hold a phrase (words no phrase
    has, and runs shorter than any phrase) put down to one separator; nothing else is left out.
    """
    n = len(w.hash)
    hit, items = np.zeros(n, bool), [[] for _ in w.counts]
    if not n or not phrases.groups:
        return hit, items
    slot = np.searchsorted(phrases.vocabulary, w.hash)
    slot[slot == len(phrases.vocabulary)] = 0
    number = np.where(phrases.vocabulary[slot] == w.hash, slot + 1, 0)
    known = np.concatenate([[0], (number > 0).astype(np.int8), [0]])
    edge = np.diff(known)
    # runs of known words, cut where a text ends
    cut = w.first[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[(number[cut - 1] > 0) & (number[cut] > 0)]
    start = np.union1d(np.flatnonzero(edge == 1), cut)
    end = np.union1d(np.flatnonzero(edge == -1), cut)
    fits = end - start >= phrases.shortest
    start, end = start[fits], end[fits]
    if not len(start):
        return hit, items
    size = end - start + 1
    stop = np.cumsum(size)
    place = np.arange(int(stop[-1])) - np.repeat(stop - size, size) + np.repeat(start, size)
    tokens = np.where(place == np.repeat(end, size), 0, number[np.minimum(place, n - 1)])
    index = FMIndex(tokens, len(phrases.vocabulary))
    spans, found = [], []
    for group in phrases.groups:
        lo, hi = index.search(group.rows)
        there = np.flatnonzero(hi > lo)
        if not len(there):
            continue
        count = (hi - lo)[there]
        ranks = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[there], count)
        at = place[index.locate(ranks)]
        spans.append((at, at + group.rows.shape[1]))
        # one (text, item) for each text, phrase in it and item that has the phrase
        phrase = np.repeat(np.arange(len(there)), count)
        pairs = np.unique(w.text[at] * len(there) + phrase)
        text, phrase = pairs // len(there), there[pairs % len(there)]
        per = group.first[phrase + 1] - group.first[phrase]
        pick = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + np.repeat(group.first[phrase], per)
        found.append(np.unique(np.repeat(text, per) * len(phrases.names) + group.items[pick]))
    if spans:
        hit = spans_to_mask(np.concatenate([s for s, _ in spans]), np.concatenate([e for _, e in spans]), n)
        for x in np.unique(np.concatenate(found)).tolist():
            items[x // len(phrases.names)].append(phrases.names[x % len(phrases.names)])
    return hit, items


def hit_spans(hit: np.ndarray, w: Words) -> list[list[dict]]:
    """The hit words of each text as merged spans of word numbers."""
    out = [[] for _ in w.counts]
    if hit.any():
        step = np.concatenate([[False], hit, [False]])
        cut = w.first[1:-1]
        cut = cut[(cut > 0) & (cut < len(hit))]
        cut = cut[hit[cut - 1] & hit[cut]]
        start = np.union1d(np.flatnonzero(~step[:-1] & step[1:]), cut)
        end = np.union1d(np.flatnonzero(step[:-1] & ~step[1:]), cut)
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            t = int(w.text[s])
            out[t].append({"start": s - int(w.first[t]), "end": e - int(w.first[t])})
    return out


def _cut(text: bytes, w: Words, t: int, hit: np.ndarray) -> bytes:
    """The text without its hit words and the bytes between two neighbouring hit words."""
    a, b = int(w.first[t]), int(w.first[t + 1])
    out, at, base = [], 0, int(w.offsets[t])
    k = a
    while k < b:
        if hit[k]:
            e = k
            while e + 1 < b and hit[e + 1]:
                e += 1
            out.append(text[at : int(w.start[k]) - base])
            at, k = int(w.end[e]) - base, e
        k += 1
    return b"".join(out) + text[at:]


def phrase_blocks(benchmark: DataFrame, item: str, text: str, max_bytes: int) -> Iterator[tuple[list, list]]:
    """The test set in blocks of bounded size, read by the driver one after the other."""
    rows = benchmark.select(column(benchmark, item).cast("string").alias("i"), column(benchmark, text).cast("string").alias("t")).filter("t is not null and i is not null")
    held = rows.select(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-2 * held // max_bytes)) if held > max_bytes else 1
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == k).toArrow()
        yield part["i"].to_pylist(), [x.encode() for x in part["t"].to_pylist()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW, cut: str | None = None, max_phrase_bytes: int = MAX_PHRASE_BYTES) -> DataFrame:
    """The columns `keep` (all by default) of every row, then n_words, n_hit, items, spans.

    A-Z are lower-cased; words are runs outside ASCII non-alphanumerics. Each task indexes its
    shard of texts (a wavelet-tree FM-index), searches every test phrase backwards, locates its
    occurrences through sampled suffix positions and merges the spans. `items` lists the items with
    a phrase in the text (sorted as strings), `spans` the merged spans of word numbers. `cut` names
    a column for the text without its hit words (null for a null text).

    A null text, or one without words, has no hits; items that are null or have no words match
    nothing; two items with the same id count as one. Repeated rows are treated alike. Input
    columns with the name of an output column give way to it, other names don't clash; an empty
    table has no rows. A test set beyond `max_phrase_bytes` is searched in rounds: each but the last
    is stored with the spans so far, and its phrases are given up before the next are built. No shuffle.
    """
    added = ["n_words", "n_hit", "items", "spans", *([cut] if cut else [])]
    kept = carry(docs, text, keep, added)
    spark, width = docs.sparkSession, len(kept.rows.columns)
    found = "items array<string>, spans array<struct<start:long,end:long>>"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.rows.schema.fields)
    some = phrase_blocks(benchmark, item, item_text, max_phrase_bytes)
    out, turn, now = kept.rows, 0, next(some)
    while now is not None:
        after = next(some, None)
        phrases = spark.sparkContext.broadcast(build_phrases(*now, window))

        def run(batches: Iterator[pa.RecordBatch], phrases=phrases, turn=turn, last=after is None) -> Iterator[pa.RecordBatch]:
            for batch, texts in blocks(batches, "text", SHARD_BYTES):
                w = split_words(texts, lower=True, breaks=NOT_ALNUM)
                hit, items = search_shard(w, phrases.value)
                if turn:
                    old_items, old = (c.to_pylist() for c in batch.columns[width:])
                    items = [i + j for i, j in zip(old_items, items, strict=True)]
                    for t, s in enumerate(old):
                        for x in s:
                            hit[w.first[t] + x["start"] : w.first[t] + x["end"]] = True
                spans = pa.array(hit_spans(hit, w), _SPANS)
                items = pa.array([sorted(set(i)) for i in items], pa.list_(pa.string()))
                if not last:
                    arrays = [*batch.columns[:width], items, spans]
                else:
                    n_hit = per_text(hit, w)
                    arrays = [*kept.take(batch), pa.array(w.counts.astype(np.int64)), pa.array(n_hit), items, spans]
                    if cut:
                        whole = batch.column(0)
                        less = [_cut(x, w, t, hit).decode() if n_hit[t] else whole[t].as_py() for t, x in enumerate(texts)]
                        arrays.append(pa.array(less, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[str(k) for k in range(len(arrays))])

        if after is None:
            own = "n_words long, n_hit long, " + found + (", less string" if cut else "")
            return kept.named(out.mapInArrow(run, kept.schema + own), added)
        out = stored(out.mapInArrow(run, f"{kinds}, {found}"), "phrases")
        phrases.destroy()
        turn, now = turn + 1, after


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark's windows."""
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, benchmark, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS phrase
    FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
hits AS (SELECT a.doc_id, a.p, s.size, win.item FROM spots a JOIN sizes s ON a.p + s.size - 1 <= len(a.w)
    JOIN win ON win.size = s.size AND win.phrase = array_to_string(a.w[a.p:a.p + s.size - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT doc_id, p, size FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
