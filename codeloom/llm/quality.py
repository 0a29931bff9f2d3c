"""Quality rules by suffix-array repetition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm._suffix import common_prefixes, longest_repeats, suffix_array
from codeloom.llm._tables import carry
from codeloom.llm._text import blocks, per_text, spans_to_mask, split_words

#: Repeats of at least so many words count towards the covered fraction.
MIN_REPEAT = 10
#: A text is rejected if repeats cover more than this part of its words ...
MAX_COVERED = 0.30
#: ... or if one repeat is at least so many words long.
MAX_LONGEST = 100
MIN_WORDS, MAX_REPEAT_WORDS, REPEAT_WINDOW = 50, 0.50, 3

_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, repeats array<struct<start:long,end:long>>, kept boolean"


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])


def _duplicate_lines(text: bytes | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or b"\n" not in text:
        return 0
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.split(None, 1)]
    return len(lines) - len(set(lines))


def repetition(texts: list[bytes | None], min_repeat: int = MIN_REPEAT) -> tuple:
    """Words of a block of texts, the longest repeat at each, which lie in a repeat of 3 words or
    more and of `min_repeat` or more, all by one suffix array over the block's texts: each text's
    words are tokens of their own, and a token of its own ends it, so repeats stay in one text."""
    w = split_words(texts)
    n, m = len(w.hash), len(texts)
    place = np.arange(n) + w.text  # after each text stands its end
    _, ids = np.unique(w.hash, return_inverse=True)
    key = np.empty(n + m, np.int64)
    key[place] = w.text * (int(ids.max(initial=0)) + 2) + ids.astype(np.int64) + 1
    key[w.first[1:] + np.arange(m)] = np.arange(m) * (int(ids.max(initial=0)) + 2)
    sa, levels = suffix_array(key)
    longest = longest_repeats(sa, common_prefixes(sa, levels))[place]
    at = np.arange(n)

    def covered(least: int) -> np.ndarray:
        far = longest >= least
        return spans_to_mask(at[far], at[far] + longest[far], n)

    return w, longest, covered(REPEAT_WINDOW), covered(min_repeat)


def judge(texts: list[bytes | None], min_repeat: int, max_covered: float, max_longest: int, spans: bool) -> list:
    """The columns of _SCHEMA for a block of texts."""
    w, longest, three, far = repetition(texts, min_repeat)
    raw = np.frombuffer(w.data, np.uint8)
    letters, symbols = _running((raw & 0xC0) != 0x80), _running(_SYMBOLS[raw])
    n = w.counts.astype(np.int64)
    chars = per_text(letters[w.end] - letters[w.start], w)
    repeat, cover = per_text(three, w), per_text(far, w)
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, w.text, longest)
    top[top < min_repeat] = 0
    failed = (n < MIN_WORDS) | (repeat > MAX_REPEAT_WORDS * n)
    kept = ~failed & ~(cover > max_covered * n) & ~(top >= max_longest)
    found = [None] * len(texts)
    if spans:
        edge = np.diff(np.concatenate([[0], far.astype(np.int8), [0]]))
        # a run that meets the next text's is cut at the text's first word
        starts = np.union1d(np.flatnonzero(edge == 1), w.first[:-1][(w.counts > 0)][far[w.first[:-1][w.counts > 0]]])
        ends = np.union1d(np.flatnonzero(edge == -1), w.first[1:][(w.counts > 0)][far[w.first[1:][w.counts > 0] - 1]])
        found = [[] for _ in texts]
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            t = int(w.text[s])
            found[t].append({"start": s - int(w.first[t]), "end": e - int(w.first[t])})
    return [n, chars, symbols[w.offsets[1:]] - symbols[w.offsets[:-1]], np.fromiter(map(_duplicate_lines, texts), np.int64, len(texts)), repeat, failed, cover, top, found, kept]


def quality_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, spans: bool = False) -> DataFrame:
    """The columns `keep` (all by default) of every row, then the rule columns.

    A suffix array over the words of a text with its longest-common-prefix intervals gives the
    maximal repeated substrings; their spans are united. `covered_words` counts the words in
    repeats of `min_repeat` words or more, `longest_repeat` is the longest such repeat (0 if none),
    `repeats` holds the united spans of word numbers if `spans` is set (null otherwise). `kept` is
    false if the base rules fail, if repeats cover more than `max_covered` of the words, or if one
    is `max_longest` words or longer.

    A null or empty text has no words and is not kept. Repeated rows are judged alike. Columns of
    the input that share a name with a rule column are left out in its favour; other names don't
    clash. An empty table has no rows. No shuffle.
    """
    own = [x.split()[0] for x in _SCHEMA.replace("array<struct<start:long,end:long>>", "x").split(", ")]
    kept = carry(docs, text, keep, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            out = judge(texts, min_repeat, max_covered, max_longest, spans)
            found = pa.array(out[8], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [pa.array(x) for x in (*out[:8],)] + [found, pa.array(out[9])]
            arrays = kept.take(batch) + columns
            yield pa.RecordBatch.from_arrays(arrays, names=[str(k) for k in range(len(arrays))])

    return kept.named(kept.rows.mapInArrow(run, kept.schema + _SCHEMA), own)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Word, symbol, line and repetition counts and the verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, keep=["doc_id"]).drop("repeats", "longest_repeat")


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, text, w, len(w) AS n_words FROM d),
spots AS (SELECT doc_id, w, n_words, unnest(range(1, n_words + 1)) AS p FROM n),
win AS (SELECT doc_id, p, n_words,
    CASE WHEN p + 2 <= n_words THEN md5(array_to_string(w[p:p+2], ' ')) END AS w3,
    CASE WHEN p + {MIN_REPEAT - 1} <= n_words THEN md5(array_to_string(w[p:p+{MIN_REPEAT - 1}], ' ')) END AS wm,
    CASE WHEN p + {MAX_LONGEST - 1} <= n_words THEN md5(array_to_string(w[p:p+{MAX_LONGEST - 1}], ' ')) END AS wl FROM spots),
rep AS (SELECT doc_id, p, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w3) > 1 AS r3,
    wm IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, wm) > 1 AS rm,
    wl IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, wl) > 1 AS rl FROM win),
hit AS (SELECT doc_id, bool_or(r3) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
    bool_or(rm) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {MIN_REPEAT - 1} PRECEDING AND CURRENT ROW) AS cm, rl FROM rep),
agg AS (SELECT doc_id, count(*) FILTER (c3) AS n3, count(*) FILTER (cm) AS nm, bool_or(rl) AS far FROM hit GROUP BY doc_id),
ln AS (SELECT doc_id, sum(k - 1) AS dup FROM (SELECT doc_id, l, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2) GROUP BY 1)
SELECT n.doc_id, CAST(n.n_words AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(ln.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n3, 0) AS BIGINT) AS n_repeat_words,
    n.n_words < {MIN_WORDS} OR 100 * coalesce(n3, 0) > 50 * n.n_words AS base_failed,
    CAST(coalesce(nm, 0) AS BIGINT) AS covered_words,
    NOT (n.n_words < {MIN_WORDS} OR 100 * coalesce(n3, 0) > 50 * n.n_words) AND NOT coalesce(nm, 0) > {MAX_COVERED} * n.n_words AND NOT coalesce(far, false) AS kept
FROM n LEFT JOIN agg USING (doc_id) LEFT JOIN ln USING (doc_id)
"""
