"""Substring dedup by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm._exchange import Part, corpus
from codeloom.llm._tables import column
from codeloom.llm._text import Words, per_text, spans_to_mask, split_words, windows

#: Words of a window, and the period of the cover: anchors have WINDOW - PERIOD + 1 words.
WINDOW, PERIOD = 35, 21


def difference_cover(period: int) -> list[int]:
    """A smallest set whose differences are all residues modulo the period.

    For any places i and j there is a shift below the period that brings both onto the set.
    """
    size = 1
    while True:
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
        size += 1


class Windows:
    """The anchors of a part, and the windows around anchors that stand elsewhere too."""

    def __init__(self, texts: list[bytes | None], window: int, period: int, cover: np.ndarray):
        self.words = w = split_words(texts)
        self.window, self.period = window, period
        short = window - period + 1
        h = windows(w.hash, short)
        owner = w.text[: len(h)]
        place = np.arange(len(h)) - w.first[owner]
        self.at = np.flatnonzero(cover[place % period] & (place + short <= w.counts[owner]) & (w.counts[owner] >= window))
        self.anchors, self.which, self.times = np.unique(h[self.at], return_inverse=True, return_counts=True)

    def near(self, seen: np.ndarray) -> np.ndarray:
        """Where windows begin that hold an anchor seen twice or more: at the anchor or up to period - 1 words before it."""
        w = self.words
        hot = self.at[seen[self.which] > 1] if len(seen) else self.at[:0]
        owner = w.text[hot]
        low = np.maximum(hot - self.period + 1, w.first[owner])
        high = np.minimum(hot, w.first[owner] + w.counts[owner] - self.window) + 1
        ok = low < high
        return np.flatnonzero(spans_to_mask(low[ok], high[ok], len(w.hash)))

    def whole(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct windows that begin at `near`, which one each is, and how often it does."""
        return np.unique(windows(self.words.hash, self.window)[near], return_inverse=True, return_counts=True)


def _joined(w: Words, t: int, gone: np.ndarray) -> bytes:
    """The words of a text that stay, joined by one space."""
    left = np.flatnonzero(~gone[w.first[t] : w.first[t + 1]]) + w.first[t]
    return b" ".join([w.data[s:e] for s, e in zip(w.start[left].tolist(), w.end[left].tolist(), strict=True)])


def substring_dedup(docs: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW, period: int = PERIOD, digests: bool = True, kept_text: str | None = None) -> DataFrame:
    """The columns `keep` (all by default) of every row, then n_words, n_removed, kept_sha256.

    A word is removed if a window of `window` words that covers it starts anywhere else too, in
    the same text or another. Anchors of window - period + 1 words are hashed only where the place
    in the text, modulo the period, lies on a difference cover: two equal windows always share
    an anchor at one shift. Texts are then extended around shared anchors: each window that holds
    one is hashed whole, and removed if its words stand elsewhere. kept_sha256 is over the kept
    words joined by one space (left out without `digests`); `kept_text` names a column for the
    kept words so joined (the text as it is where nothing was removed; null for null).

    A null or empty text has no words; a text shorter than the window loses nothing; repeated rows
    are each other's copies. Input columns named like an output give way. Keys are 64-bit hashes.
    Texts are dealt to parts of bounded size; anchors and then windows are counted over the whole
    corpus, each once for a part however often it stands there, so no passage is a hot spot.
    """
    added = ["n_words", "n_removed", *["kept_sha256"] * digests, *([kept_text] if kept_text else [])]
    names = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    inner = [f"c{k}" for k in range(len(names))]
    own = [column(docs, c) for c in names]
    hashed = [c for c, n in zip(own, names, strict=True) if "map<" not in docs.schema[n].dataType.simpleString()]
    texts = corpus(docs, column(docs, text).cast("string"), own, hashed, inner)
    cover = np.isin(np.arange(period), difference_cover(period))
    none = np.zeros(0, np.uint64)

    def anchors(part: Part) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        x = Windows(part.texts, window, period, cover)
        yield 0, x.anchors, x.times

    def wholes(part: Part) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        x = Windows(part.texts, window, period, cover)
        keys, _, times = x.whole(x.near(part.answers.get(0, none)))
        yield 1, keys, times

    shared = texts.ask(anchors, "anchors")
    copied = texts.ask(wholes, "windows", shared)

    def finish(part: Part) -> Iterator[pa.RecordBatch]:
        x = Windows(part.texts, window, period, cover)
        w, near = x.words, x.near(part.answers.get(0, none))
        at = near[part.answers[1][x.whole(near)[1]] > 1] if len(near) else near
        gone = spans_to_mask(at, at + window, len(w.hash))
        lost = per_text(gone, w)
        columns = [*part.columns, pa.array(w.counts.astype(np.int64)), pa.array(lost)]
        if digests:
            columns.append(pa.array([hashlib.sha256(_joined(w, t, gone) if lost[t] else b" ".join((body or b"").split())).hexdigest() for t, body in enumerate(part.texts)], pa.string()))
        if kept_text:
            columns.append(pa.array([_joined(w, t, gone) if lost[t] else body for t, body in enumerate(part.texts)], pa.binary()).cast(pa.string()))
        out = pa.RecordBatch.from_arrays(columns, names=[*inner, *[f"o{k}" for k in range(len(added))]])
        for k in range(0, len(out), 1024):
            yield out.slice(k, 1024)

    kinds = "".join(f"{i} {texts.rows.schema[i].dataType.simpleString()}, " for i in inner)
    kinds += ", ".join(f"o{k} {'long' if k < 2 else 'string'}" for k in range(len(added)))
    return texts.map(finish, kinds, shared, copied).toDF(*names, *added)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words, removed words and the digest of what is kept, for every document."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])


OP4_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
win AS (SELECT doc_id, p, CASE WHEN p + 34 <= len(w) THEN md5(array_to_string(w[p:p+34], ' ')) END AS h, w[p] AS word FROM spots),
rep AS (SELECT doc_id, p, word, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS again FROM win),
gone AS (SELECT doc_id, p, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS cut FROM rep),
agg AS (SELECT doc_id, count(*) AS n, count(*) FILTER (cut) AS lost, string_agg(word, ' ' ORDER BY p) FILTER (NOT cut) AS kept FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN agg USING (doc_id)
"""
