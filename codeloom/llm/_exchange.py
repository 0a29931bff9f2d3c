"""Corpus-wide counts of the 64-bit keys of a corpus, answered to the part of the corpus that asked.

The texts are dealt to shards by hash, and each shard is cut into parts of bounded size. A part
sends its distinct keys, sorted and packed, to the buckets that own their ranges; a bucket adds up
what all parts say of a key and answers each part in the order it asked, so an answer is a list of
counts without keys, each with a bit for whether other parts asked too. Whatever a key's frequency, a part asks for it once, so no bucket holds more
of it than there are parts. A lost executor's part is dealt again alike: rows of a shard are sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._tables import stored

#: Bytes of text in a shard on average, and in a part at most (one longer text is a part of its own).
SHARD_BYTES, PART_BYTES = 5 << 20, 7 << 20
#: Bytes of text whose keys a bucket owns, on average.
BUCKET_BYTES = 10 << 20
_ASK = "kind int, bucket long, shard long, part long, keys binary, n binary"
_ANSWER = "kind int, bucket long, shard long, part long, n binary, keys_seen long, total long"


def pack(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, entropy-coded: the high planes of small numbers are zeros, which compress away."""
    planes = np.ascontiguousarray(x.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    planes = pa.Codec("zstd").decompress(raw[8:], decompressed_size=8 * size, asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


@dataclass
class Part:
    """Rows of one shard: their carried columns, their texts, and by kind the counts that were answered, and whether other parts have the key."""

    shard: int
    number: int
    columns: list[pa.Array]
    texts: list[bytes | None]
    answers: dict[int, np.ndarray]
    shared: dict[int, np.ndarray]


@dataclass
class Corpus:
    """Texts to be dealt: `rows` has id, shard and text, then the carried columns.

    There are as many tasks as shards, and as buckets, so what a task reads at once is bounded too.
    """

    rows: DataFrame
    carried: list[str]
    shards: int
    bits: int  # the owner of a key is its highest `bits` bits

    def ask(self, keys_of: Callable[[Part], Iterator[tuple[int, np.ndarray, np.ndarray]]], what: str, *given: DataFrame) -> DataFrame:
        """Stored answers to (kind, sorted distinct keys, their counts in the part) of every part.

        `given` are earlier answers, which the parts have at hand.
        """
        bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts(batches):
                for kind, keys, n in keys_of(part):
                    yield from _questions(kind, part.shard, part.number, keys, n, bits)

        asked = self.dealt(*given).mapInArrow(run, _ASK)
        return stored(asked.repartition(1 << bits, "kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(lambda it: _answers(it, bits), _ANSWER), what)

    def map(self, f: Callable[[Part], Iterator[pa.RecordBatch]], schema: str, *given: DataFrame) -> DataFrame:
        """f over every part with the answers it was given."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts(batches):
                yield from f(part)

        return self.dealt(*given).mapInArrow(run, schema)

    def dealt(self, *given: DataFrame) -> DataFrame:
        """Rows (shard, number, id, kind, n, text, carried): of a shard first the answers, then the texts."""
        null = F.lit(None)
        every = self.rows.select("shard", F.lit(-1).cast("long").alias("number"), "id", null.cast("int").alias("kind"), null.cast("binary").alias("n"), "text", *self.carried)
        for answers in given:
            empty = [null.cast(self.rows.schema[c].dataType).alias(c) for c in ["text", *self.carried]]
            every = every.union(answers.select("shard", F.col("part").alias("number"), F.col("bucket").alias("id"), "kind", "n", *empty))
        # an answer's number is its part, a text's is none: nulls first would put texts first, so they carry -1 and sort down
        return every.repartition(self.shards, "shard").sortWithinPartitions("shard", F.col("number").desc(), "kind", "id")


def corpus(docs: DataFrame, text: Column, columns: list[Column], hashed: list[Column], names: list[str], shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> Corpus:
    """The rows of docs with their text and carried columns (under `names`).

    The shard of a row is a hash of the text and the columns `hashed`, so copies of one text lie in many shards.
    """
    bytes_ = F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64), F.lit(0))
    total = docs.select(bytes_).first()[0]
    shards = max(1, -(-total // shard_bytes))
    rows = docs.select(F.xxhash64(text, *hashed).alias("id"), text.alias("text"), *[c.alias(n) for c, n in zip(columns, names, strict=True)])
    rows = rows.select("id", F.pmod("id", F.lit(shards)).alias("shard"), "text", *names)
    return Corpus(rows, names, shards, max(0, int(-(-total // bucket_bytes) - 1).bit_length()))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """Parts in the order of `Corpus.dealt`, with the answers that came before them."""
    shard, number, held, bytes_, answers = None, 0, [], 0, {}

    def cut() -> Part:
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns]
        got = {k: np.concatenate(v) for (p, k), v in answers.items() if p == number}
        for p, k in [x for x in answers if x[0] == number]:
            del answers[p, k]
        counts, shared = ({k: f(v) for k, v in got.items()} for f in (lambda v: v >> np.uint64(1), lambda v: (v & np.uint64(1)).astype(bool)))
        return Part(shard, number, columns[1:], columns[0].to_pylist(), counts, shared)

    for batch in batches:
        where, numbers, kinds = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
        texts = batch.column(5).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
        rest = [texts, *batch.columns[6:]]
        names = [str(k) for k in range(len(rest))]
        at = 0
        while at < len(batch):
            if where[at] != shard:
                if held:
                    yield cut()
                shard, number, held, bytes_, answers = int(where[at]), 0, [], 0, {}
            if numbers[at] >= 0:
                answers.setdefault((int(numbers[at]), int(kinds[at])), []).append(unpack(batch.column(4)[at].as_py()))
                at += 1
                continue
            to = at
            while to < len(batch) and where[to] == shard and ((not held and to == at) or bytes_ + sizes[to] + 64 <= PART_BYTES):
                bytes_ += int(sizes[to]) + 64
                to += 1
            if to > at:
                held.append(pa.RecordBatch.from_arrays([c.slice(at, to - at) for c in rest], names=names))
            if to < len(batch) and where[to] == shard:  # the next text doesn't fit any more
                yield cut()
                number, held, bytes_ = number + 1, [], 0
            at = to
    if held:
        yield cut()


def _questions(kind: int, shard: int, number: int, keys: np.ndarray, n: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    if not len(keys):
        return
    owner = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    stop = np.append(first[1:], len(keys))
    asked, said = [], []
    for a, b in zip(first.tolist(), stop.tolist(), strict=True):
        asked.append(pack(np.diff(keys[a:b], prepend=np.uint64(0))))
        said.append(pack(n[a:b]))
    size = len(first)
    yield pa.RecordBatch.from_arrays(
        [pa.array([kind] * size, pa.int32()), pa.array(owner[first]), pa.array([shard] * size, pa.int64()), pa.array([number] * size, pa.int64()), pa.array(asked, pa.binary()), pa.array(said, pa.binary())],
        names=["kind", "bucket", "shard", "part", "keys", "n"],
    )


def _answers(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Sums over all parts, sent back to each; keys_seen and total of a bucket's keys with a count stand once."""
    at, held = None, []
    for batch in batches:
        kind, bucket = (batch.column(k).to_pylist() for k in range(2))
        for k in range(len(batch)):
            if (kind[k], bucket[k]) != at:
                yield from _bucket(at, held)
                at, held = (kind[k], bucket[k]), []
            held.append(tuple(batch.column(c)[k].as_py() for c in range(2, 6)))
    yield from _bucket(at, held)


def _bucket(at: tuple[int, int] | None, held: list[tuple[int, int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    asked = [np.cumsum(unpack(x[2]), dtype=np.uint64) for x in held]
    keys = np.concatenate(asked)
    n = np.concatenate([unpack(x[3]) for x in held])
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    first = np.flatnonzero(head)
    sums, several = np.add.reduceat(n[order], first), np.diff(np.append(first, len(keys))) > 1
    back = np.empty(len(keys), np.uint64)
    back[order] = (sums << np.uint64(1) | several.astype(np.uint64))[np.cumsum(head) - 1]
    stop = np.cumsum([len(x) for x in asked])
    for i, (x, b) in enumerate(zip(held, stop.tolist(), strict=True)):
        seen, total = (int((sums > 0).sum()), int(sums.sum())) if not i else (0, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([x[0]], pa.int64()), pa.array([x[1]], pa.int64()), pa.array([pack(back[b - len(asked[i]) : b])], pa.binary()), pa.array([seen], pa.int64()), pa.array([total], pa.int64())],
            names=["kind", "bucket", "shard", "part", "n", "keys_seen", "total"],
        )
