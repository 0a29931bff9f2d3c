"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._tables import carry, column, discard, stored
from codeloom.llm._text import NOT_ALNUM, blocks, hash_spans, split_words

#: Hash slots of terms, and factors of a term.
SLOTS, FACTORS = 1 << 18, 4
#: Labelled texts that the machine is fitted on, and terms of them: a bounded sample in the order of a hash of the id.
MAX_LABELLED, MAX_TERMS = 12_000, 24_000_000
#: Passes over the sample, step size, weight decay and texts in a step.
EPOCHS, RATE, L2, BATCH = 10, 0.05, 1e-4, 64
#: What a pass takes off a linear weight, over all its steps: weights that only follow noise stay 0.
L1 = 0.2
#: Besides its words a text's terms are the stems of longer words: their first so many bytes.
STEMS = (4, 5)
#: Terms are learned, and count in a score, if at least so many texts of the sample have them.
MIN_TEXTS = 3
#: predicted is 1 from this score on.
THRESHOLD = 0.3


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); x is 1 for a known term in the text.

    The pair part is over the root of the text's number of known terms.
    """

    bias: float
    w: np.ndarray
    v: np.ndarray
    known: np.ndarray  # whether a slot's terms were learned

    def learned(self, terms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of `terms` without those that were not learned."""
        known = self.known[terms]
        return terms[known], np.concatenate([[0], np.cumsum(known)])[first]

    def raw(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid; texts are runs of learned `terms` that begin at `first` (one longer)."""
        out = np.full(len(first) - 1, self.bias)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            at = first[:-1][full]
            v = self.v[terms]
            s = np.add.reduceat(v, at)
            size = np.diff(first)[full]
            pair = 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), at)) / np.sqrt(size)
            out[full] += np.add.reduceat(self.w[terms], at) + pair
        return out

    def score(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.learned(terms, first)), -30, 30)))


def text_terms(texts: list[bytes | None], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of the words and stems of every text in order, and where each text's begin."""
    w = split_words(texts, lower=True, breaks=NOT_ALNUM)
    raw = np.frombuffer(w.data + bytes(8), np.uint8)
    owner, hashes = [w.text], [w.hash]
    for size in STEMS:
        far = w.end - w.start > size
        owner.append(w.text[far])
        hashes.append(hash_spans(w.data, raw, w.start[far], w.start[far] + size) + np.uint64(size))
    key = np.unique(np.concatenate(owner).astype(np.int64) * slots + (np.concatenate(hashes) % np.uint64(slots)).astype(np.int64))
    return key % slots, np.searchsorted(key // slots, np.arange(len(texts) + 1))


def fit(terms: np.ndarray, first: np.ndarray, labels: np.ndarray, slots: int = SLOTS, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> FactorizationMachine:
    """AdaGrad on the log loss over shuffled batches; the same input gives the same machine."""
    rng = np.random.default_rng(seed)
    rate = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    m = FactorizationMachine(float(np.log(rate / (1 - rate))), np.zeros(slots), rng.normal(0, 0.01, (slots, factors)), np.bincount(terms, minlength=slots) >= MIN_TEXTS)
    terms, first = m.learned(terms, first)
    gw, gv, gb = np.full(slots, 1e-2), np.full((slots, factors), 1e-2), 1.0
    n = len(labels)
    shrink = L1 / max(1, -(-n // BATCH))
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            rows = order[k : k + BATCH]
            size = first[rows + 1] - first[rows]
            rows, size = rows[size > 0], size[size > 0]
            if not len(rows):
                continue
            stop = np.cumsum(size)
            pick = np.arange(int(stop[-1])) - np.repeat(stop - size, size) + np.repeat(first[rows], size)
            t = terms[pick]
            begin = np.concatenate([[0], stop])
            p = 1 / (1 + np.exp(-np.clip(m.raw(t, begin), -30, 30)))
            err = (p - labels[rows]) / len(rows) * BATCH / 8
            e = np.repeat(err, size)
            scale = np.repeat(1 / np.sqrt(size), size)
            s = np.add.reduceat(m.v[t], stop - size)
            dv = (e * scale)[:, None] * (np.repeat(s, size, axis=0) - m.v[t])
            slot, inverse = np.unique(t, return_inverse=True)
            dw = np.bincount(inverse, e, len(slot)) + L2 * m.w[slot]
            dv = np.stack([np.bincount(inverse, dv[:, f], len(slot)) for f in range(factors)], 1) + L2 * m.v[slot]
            gw[slot] += dw * dw
            gv[slot] += dv * dv
            step = RATE * 4 / np.sqrt(gw[slot])
            w = m.w[slot] - step * dw
            m.w[slot] = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
            m.v[slot] -= RATE * dv / np.sqrt(gv[slot])
            gb += err.sum() ** 2
            m.bias -= RATE * err.sum() / np.sqrt(gb)
    return m


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS) -> FactorizationMachine:
    """Fit on at most `max_labelled` labelled texts with at most `max_terms` distinct terms in all, first in the order of a hash of the key.

    Rows whose label or key is null are passed over; a key labelled twice counts as labelled 1 if
    any row says so, and of a key with several texts the least is learned from. Without labelled
    texts every score is 0.5. The sample's keys are broadcast (a proven bound), so only its own
    texts are shuffled; the driver reads their terms.
    """
    chosen = labels.select(column(labels, key).alias("k"), column(labels, label).cast("double").alias("y")).dropna().groupBy("k").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("k"), "k").limit(max_labelled)
    texts = docs.select(column(docs, key).alias("k"), column(docs, text).cast("string").alias("t")).filter("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches, "t"):
            terms, first = text_terms(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(1), pa.float64()), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(terms.astype(np.int32)))], names=["k", "y", "terms"])

    joined = texts.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t"))
    kind = joined.schema["k"].dataType.simpleString()
    learned = stored(joined.mapInArrow(run, f"k {kind}, y double, terms array<int>").select("*", F.xxhash64("k").alias("at")), "terms")
    sizes = learned.select("at", F.size("terms").alias("n")).toArrow().sort_by("at")  # max_labelled narrow rows
    within = np.cumsum(sizes["n"].to_numpy(), dtype=np.int64) <= max_terms
    last = sizes["at"].to_numpy()[within].max(initial=-(2**63))
    rows = learned.filter(F.col("at") <= F.lit(int(last))).toArrow().sort_by([("at", "ascending"), ("k", "ascending")])
    discard(learned)
    y = (rows["y"].to_numpy() > 0.5).astype(float)
    lists = rows["terms"].combine_chunks()
    flat = lists.flatten().to_numpy().astype(np.int64)
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))]).astype(np.int64)
    return fit(flat, first, y)


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep` (all by default) of every row, then score (0 to 1) and predicted.

    All distinct terms of the whole text that were learned count. A null or empty text has no terms: its score is the
    machine's bias alone. Repeated rows score alike. Input columns named score or predicted give
    way, other names don't clash; an empty table has no rows. No shuffle; the broadcast machine has a fixed size.
    """
    added = ["score", "predicted"]
    kept = carry(docs, text, keep, added)
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32), machine.known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = FactorizationMachine(*sent.value)
        for batch, texts in blocks(batches, "text"):
            score = m.score(*text_terms(texts)).astype(np.float64)
            arrays = [*kept.take(batch), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[str(k) for k in range(len(arrays))])

    return kept.named(kept.rows.mapInArrow(run, kept.schema + "score double, predicted int"), added)


def held_out(key: str = "doc_id"):
    """A quarter of the documents, never learned from."""
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out quarter."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = train(docs, labels.filter(~held_out()))
    scored = score_toxicity(docs, machine, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
