"""Suffix arrays, longest common prefixes and an FM-index over arrays of integer tokens."""

from __future__ import annotations

import numpy as np


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and the rank of every suffix by its first 1, 2, 4, ... tokens.

    Prefix doubling that sorts again only the suffixes that are still tied. The last token must
    occur once; ranks are the first place of a group of ties, so rank k of i and j agree exactly
    if their first 2**k tokens do.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), []
    sa = np.argsort(tokens, kind="stable")
    rank, tied = _ranks(tokens[sa], sa, np.zeros(n, np.int64), np.arange(n))
    levels, step = [rank], 1
    while len(tied):
        place = sa[tied]
        key = rank[place] * n + rank[place + step]  # a tied suffix has more than `step` tokens
        order = np.argsort(key, kind="stable")
        sa[tied] = place = place[order]
        rank, tied = _ranks(key[order], place, rank, tied)
        levels.append(rank)
        step *= 2
    return sa, levels


def _ranks(key: np.ndarray, place: np.ndarray, rank: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New ranks, where suffixes `place` sit in `slots` sorted by key; and the slots still tied."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    out = rank.copy()
    out[place] = slots[head][group]
    alone = np.diff(np.append(head, len(key))) == 1
    return out, slots[~alone[group]]


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """lcp[x]: tokens shared by the suffixes at places x-1 and x of the suffix array; lcp[0] = 0."""
    lcp = np.zeros(len(sa), np.int64)
    if len(sa) < 2:
        return lcp
    pairs = 1 + np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    i, j, got = sa[pairs - 1], sa[pairs], np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][i] == levels[k][j]
        step = same.astype(np.int64) << k
        i, j, got = i + step, j + step, got + step
    lcp[pairs] = got
    return lcp


def longest_repeats(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For every place of the text: the length of its longest repeat.

    A suffix lies in nested longest-common-prefix intervals; the innermost one is a maximal
    repeated substring that begins there, as long as the larger lcp beside the suffix.
    """
    out = np.zeros(len(sa), np.int64)
    out[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


class FMIndex:
    """Backward search over tokens 1..sigma; 0 separates texts and is never searched for.

    The Burrows-Wheeler transform is held as a wavelet tree (one bit vector a level, levels
    concatenated by bit), with running counts of ones as ranks. Every `sample`-th place of the
    text, and each place after a separator, keeps its position.
    """

    def __init__(self, tokens: np.ndarray, sigma: int, sample: int = 8):
        n = len(tokens)
        gaps = tokens == 0
        unique = np.where(gaps, np.cumsum(gaps) - 1, tokens + int(gaps.sum()))
        self.sa_order, _ = suffix_array(unique)
        sa = self.sa_order
        bwt = tokens[sa - 1]  # place 0 wraps round to the last token, a separator
        self.bwt, self.n = bwt, n
        counts = np.bincount(tokens, minlength=sigma + 2)
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        self.levels = max(1, int(sigma).bit_length())
        self.ones, self.zeros = [], []
        row = bwt
        for k in range(self.levels - 1, -1, -1):
            bit = (row >> k) & 1
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(n - int(bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.base = self._descend(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))
        kept = (sa % sample == 0) | (bwt == 0)
        self.sampled, self.position = kept, np.cumsum(kept) - 1
        self.positions = sa[kept]
        del self.sa_order

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros, strict=True):
            up = ones[i]
            i = np.where((c >> k) & 1, zeros + up, i - up)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often token c stands in the first i tokens of the transform."""
        return self._descend(c, i) - self.base[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [lo, hi) of suffixes that begin with each phrase (rows of equally many tokens)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of rows of the suffix array: step back to a sampled one."""
        out, steps, at, todo = np.zeros(len(rows), np.int64), 0, rows, np.arange(len(rows))
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.positions[self.position[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            c = self.bwt[at]
            at = self.before[c] + self.rank(c, at)
            steps += 1
        return out
