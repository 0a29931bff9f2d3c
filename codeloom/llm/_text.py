"""Vectorised word splitting and hashing over blocks of UTF-8 texts.

A block of texts is joined into one byte buffer; words are found with table lookups and hashed
eight bytes at a time, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of `[\x20\x09-\x0D]`, which end a word for most operators.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` once A-Z are lower-cased.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Texts are handled in blocks of about this many bytes (one longer text is a block of its own).
BLOCK_BYTES = 2 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 512

_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _P2
    h = (h ^ (h >> np.uint64(27))) * _P3
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of a block: hash, first byte, end byte and text number of each, in order."""

    data: bytes
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    #: Words of each text, and where each text's words begin.
    counts: np.ndarray
    first: np.ndarray
    #: Where each text begins in the buffer (one longer than the texts).
    offsets: np.ndarray


def split_words(texts: list[bytes | None], lower: bool = False, breaks: np.ndarray = SPACE) -> Words:
    """Words of every text; None has none. `lower` lower-cases A-Z only."""
    texts = [t or b"" for t in texts]
    data = b" ".join(texts) + b" "
    if lower:
        data = data.translate(LOWER)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    raw = np.frombuffer(data + bytes(8), np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    np.logical_not(breaks[raw[: len(data)]], out=inside[1:].view(bool))
    inside[offsets[1:]] = 0  # the joining byte belongs to no word, whatever the class
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(offsets, start, side="right") - 1
    counts = np.bincount(text, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    return Words(data, hash_spans(data, raw, start, end), start, end, text, counts, first, offsets)


def hash_spans(data: bytes, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes on every machine."""
    size = end - start
    h = size.astype(np.uint64) * _P1
    eight = np.lib.stride_tricks.as_strided(raw[: 8 * (len(raw) // 8)].view(np.uint64), (max(0, len(raw) - 7),), (1,))
    todo = np.flatnonzero(size <= LONG_WORD)
    at, left = start[todo], size[todo]
    while len(todo):
        h[todo] = mix((h[todo] ^ (eight[at] & _KEEP[np.minimum(left, 8)])) * _P1)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return h


def hash_word(word: bytes) -> int:
    """The hash that `split_words` gives this word."""
    return int(hash_spans(word, np.frombuffer(word + bytes(16), np.uint8), np.zeros(1, np.int64), np.full(1, len(word)))[0])


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive values (empty if there are fewer)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + m]) * _P1
        out ^= out >> np.uint64(29)
    return mix(out)


def spans_to_mask(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any span [start, end)."""
    step = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(step[:n]) > 0


def per_text(values: np.ndarray, words: Words) -> np.ndarray:
    """Sums of values of words by text."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[words.first[1:]] - total[words.first[:-1]]


def blocks(batches: Iterator[pa.RecordBatch], text: str, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of batches whose texts hold about `size` bytes, and those texts as UTF-8."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        texts = texts.cast(pa.large_binary())
        lens = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else []
        at = 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and (to == at or held + lens[to] <= size):
                held += lens[to]
                to += 1
            yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()
            at = to


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
