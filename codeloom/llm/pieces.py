"""SentencePiece encoding and decoding by a distinct-chunk table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm._tables import carry
from codeloom.llm._text import blocks

#: Chunks that a task's table keeps from one block of texts to the next; a fuller one is begun anew.
MAX_CHUNKS = 400_000
_MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")


def crossing_pieces(model) -> int:
    """Pieces with a white-space marker behind another character: such a model can't be cut at markers."""
    return sum(_MARK in model.id_to_piece(i).lstrip(_MARK) for i in range(model.get_piece_size()))


class ChunkTable:
    """Ids and decoded text of each distinct marked word (white-space markers, then a word).

    No piece crosses from a word into the next marker, so merges never do, and a text's ids are
    those of its chunks in order. The library adds one marker in front of what it encodes, which
    stands for the chunk's own first one.
    """

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        if crossing_pieces(self.model):
            raise ValueError("pieces of this model cross white-space markers")
        if self.model.decode(self.model.encode("  a  b ")) != "  a  b ":
            raise ValueError("this model's normalizer doesn't keep white space as it is")
        self.ids: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}

    def learn(self, words: list[str]) -> None:
        """Segment words that the table lacks, each once."""
        found = self.model.encode(words, num_threads=1)
        back = self.model.decode(found, num_threads=1)
        for word, ids, text in zip(words, found, back, strict=True):
            if not word:  # a lone marker: what a space at the end of a text adds
                ids, text = self.model.encode("a ")[len(self.model.encode("a")) :], ""
            self.ids[word] = np.array(ids, "<u4").tobytes()
            if text != word:
                self.odd[word] = text

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Of each text: the ids without begin and end, and what they decode to."""
        split = []
        for text in texts:
            words = text.replace(_MARK, " ").split(" ") if text else []
            if len(words) > 1 and "" in words:  # runs of spaces, or spaces at the ends
                words = [x[1:] for x in _CHUNK.findall(" " + text.replace(_MARK, " "))]
            split.append(words)
        self.learn(list(set().union(*split).difference(self.ids)))
        get = self.ids.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        if self.odd:
            back = [" ".join(self.odd.get(w, w) for w in words) for words in split]
        else:
            back = [" ".join(words) for words in split]
        if len(self.ids) > MAX_CHUNKS:
            self.ids, self.odd = {}, {}
        return list(zip(out, back, strict=True))


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """The columns `keep` (all by default) of every row, then n_tokens, ids and decoded.

    `ids` are those of the sentencepiece library with begin and end ids, `decoded` is its decode()
    of them. With `digests`, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (of UTF-8) stand in their place. The driver reads the model and ships it with
    the task. A null text is encoded as an empty one: begin and end only. Repeated rows get the
    same ids. Input columns named like an output give way. No shuffle; a task's table is bounded.
    """
    with open(model_path, "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())
    added = ["n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    kept = carry(docs, text, keep, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(proto.value)
        begin, end = (np.array([x], "<u4").tobytes() for x in (table.model.bos_id(), table.model.eos_id()))
        for batch, texts in blocks(batches, "text"):
            out = table.encode([t.decode() if t else "" for t in texts])
            ids = [begin + i + end for i, _ in out]
            columns = [pa.array([len(i) // 4 for i in ids], pa.int64())]
            if digests:
                columns += [pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in out], pa.string())]
            else:
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
                columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([d for _, d in out], pa.string())]
            arrays = [*kept.take(batch), *columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[str(k) for k in range(len(arrays))])

    return kept.named(kept.rows.mapInArrow(run, kept.schema + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string")), added)


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_pieces(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text for every document."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_file(), keep=["doc_id"], digests=True)
