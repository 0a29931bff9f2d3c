"""Language-model scoring with a weighted backoff automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._exchange import Part, corpus
from codeloom.llm._tables import column
from codeloom.llm._text import hash_word, mix, split_words

#: Add-k of the unigrams; how many tokens the shorter history's distribution counts as (chosen on a fold of training rows).
ADD, WEIGHTS = 0.1, (1000.0, 5.0)
#: Tokens that one step of the traversal takes side by side from as many segments of texts.
SEGMENT = 256
END = np.uint64(hash_word(b"\n"))  # no word holds a line feed
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@dataclass
class Grams:
    """The n-grams of a part of the corpus: sorted distinct keys of order 1, 2 and 3, and which one ends at each token.

    A text's tokens are its words and one END, and END stands before its first; the first token of a text ends no trigram (-1).
    """

    keys: list[np.ndarray]
    at: list[np.ndarray]
    owner: np.ndarray  # the text of each token
    first: np.ndarray  # where the tokens of each text begin (one longer)
    end: int  # END among the unigrams
    # of each bigram its words, of each trigram the bigrams that it begins and ends with
    history: np.ndarray
    word: np.ndarray
    long: np.ndarray
    short: np.ndarray

    def counts(self, texts: np.ndarray) -> list[np.ndarray]:
        """How often the n-grams stand in the texts that `texts` is true for."""
        here = texts[self.owner]
        return [np.bincount(at[here & (at >= 0)], minlength=len(k)).astype(np.uint64) for at, k in zip(self.at, self.keys, strict=True)]


def grams(texts: list[bytes | None]) -> Grams:
    w = split_words(texts, lower=True)
    n, m = len(w.hash), len(w.counts)
    tokens = np.full(n + m, END)
    tokens[np.arange(n) + w.text] = w.hash
    size = w.counts + 1
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(m), size)
    starts = np.zeros(n + m, bool)
    starts[first[:-1]] = True
    before = np.concatenate([[END], tokens[:-1]])
    before[starts] = END
    pair = mix(mix(before ^ _SALTS[1]) + tokens)
    triple = mix(np.concatenate([pair[:1], pair[:-1]]) ^ mix(tokens ^ _SALTS[2]))
    one, at1 = np.unique(mix(tokens ^ _SALTS[0]), return_inverse=True)
    two, at2 = np.unique(pair, return_inverse=True)
    three, inner = np.unique(triple[~starts], return_inverse=True)
    at3 = np.full(n + m, -1)
    at3[~starts] = inner
    end = int(at1[first[1] - 1]) if m else -1
    left = np.concatenate([[end], at1[:-1]])
    left[starts] = end
    history, word = np.empty(len(two), np.int64), np.empty(len(two), np.int64)
    history[at2], word[at2] = left, at1
    long, short = np.empty(len(three), np.int64), np.empty(len(three), np.int64)
    long[inner], short[inner] = np.concatenate([at2[:1], at2[:-1]])[~starts], at2[~starts]
    return Grams([one, two, three], [at1, at2, at3], owner, first, end, history, word, long, short)


class Automaton:
    """The part of the model that can be reached from the texts of a part of the corpus.

    States are the root, every word and every pair of words that the training texts have. The arcs
    of a state are the n-grams that extend it, weighted with the log10 of their smoothed
    probability; a token without an arc takes the state's failure arc, which has a weight of its
    own, to the state of the history without its first word. The root has an arc for every token,
    unknown ones included. Smoothing is Dirichlet: a history h of k words seen c(h) times counts
    as c(h) + WEIGHTS[k - 1] tokens, of which the shorter history's distribution gives the rest:
    p(w | h) = (c(hw) + WEIGHTS[k - 1] * p(w | h')) / (c(h) + WEIGHTS[k - 1]).

    State 0 is the root, then come the part's unigrams and bigrams, in the order of Grams.
    """

    def __init__(self, g: Grams, counts: list[np.ndarray], total: int, kinds: int):
        one, two, three = (c.astype(np.float64) for c in counts)
        n1, n2 = len(one), len(two)
        p1 = (one + ADD) / (total + ADD * (kinds + 1))
        p2 = (two + WEIGHTS[0] * p1[g.word]) / (one[g.history] + WEIGHTS[0])
        p3 = (three + WEIGHTS[1] * p2[g.short]) / (two[g.long] + WEIGHTS[1])
        self.arcs = [np.log10(p1), np.log10(p2), np.log10(p3)]
        self.there = [one > 0, two > 0, three > 0]
        self.failure = np.concatenate([[0.0], np.log10(WEIGHTS[0] / (one + WEIGHTS[0])), np.log10(WEIGHTS[1] / (two + WEIGHTS[1]))])
        #: Where the failure arc leads: from a word to the root, from a pair to its last word.
        self.shorter = np.concatenate([[0], np.zeros(n1, np.int64), g.word + 1])
        self.order = np.concatenate([[0], np.ones(n1, np.int64), np.full(n2, 2)])
        self.pairs = n1 + 1
        self.start = g.end + 1 if n1 and one[g.end] else 0
        self.g = g

    def step(self, state: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the tokens at `pos`, and the weights of the failure arcs and the arc taken."""
        at1, at2, at3 = (a[pos] for a in self.g.at)
        weight = np.zeros(len(pos))
        three = (self.order[state] == 2) & (at3 >= 0)
        three[three] = self.there[2][at3[three]]
        fails = (self.order[state] == 2) & ~three
        weight[fails] += self.failure[state[fails]]
        state = np.where(fails, self.shorter[state], state)
        two = self.order[state] == 1
        two[two] = self.there[1][at2[two]]
        fails = (self.order[state] == 1) & ~two
        weight[fails] += self.failure[state[fails]]
        one = ~(three | two)
        weight[three] += self.arcs[2][at3[three]]
        weight[two] += self.arcs[1][at2[two]]
        weight[one] += self.arcs[0][at1[one]]
        # an arc leads to the longest history that is a state: two words, or one behind the root, or none behind an unknown word
        after = np.where(one, np.where(self.there[0][at1], at1 + 1, 0), at2 + self.pairs)
        return after, weight

    def walk(self) -> np.ndarray:
        """The weight of every token: one traversal of each text from left to right that carries the state.

        Long texts are walked as several segments side by side; after two tokens a state doesn't
        depend on where the walk began, so a later segment begins two tokens early.
        """
        out = np.zeros(len(self.g.owner))
        size = np.diff(self.g.first)
        many = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), many)
        k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        low = self.g.first[text] + k * SEGMENT
        high = np.minimum(low + SEGMENT, self.g.first[text + 1])
        begin = np.where(k > 0, low - 2, low)
        order = np.argsort(begin - high, kind="stable")  # longest first
        begin, low, high = begin[order], low[order], high[order]
        state = np.where(begin == low, self.start, 0)
        for t in range(int((high - begin).max(initial=0))):
            live = int(np.searchsorted(begin - high, -t))
            pos = begin[:live] + t
            state, weight = self.step(state[:live], pos)
            counts = pos >= low[:live]
            out[pos[counts]] = weight[counts]
        return out


def lm_scores(docs: DataFrame, training, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of every row, then n_tokens, n_known, train_tokens, base_score, score.

    `training` is a boolean column: the rows that the model learns from (null: not). A-Z are
    lower-cased; the tokens of a text are its words and one end. Every word, pair and triple of
    the training rows counts, at any size of the corpus; nothing is pruned. Each part of the corpus asks for
    the counts of the words and pairs that its texts hold, then of the triples that may stand in
    other parts too, builds the automaton over these, and walks its texts through it once. base_score is the add-0.1 unigram score, score the log10 probability of
    the text by the automaton; see `Automaton` for the smoothing.

    A null or empty text is its end alone. Without training rows all words are unknown. Repeated
    rows count each. Input columns named like an output give way. N-grams are 64-bit hashes.
    """
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    names = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    inner = ["learn", *[f"c{k}" for k in range(len(names))]]
    learn = F.coalesce(training, F.lit(False))
    own = [column(docs, c) for c in names]
    hashed = [c for c, n in zip(own, names, strict=True) if "map<" not in docs.schema[n].dataType.simpleString()]
    texts = corpus(docs, column(docs, text).cast("string"), [learn, *own], [learn, *hashed], inner)

    def learned(part: Part) -> np.ndarray:
        return part.columns[0].to_numpy(zero_copy_only=False).astype(bool)

    def shorter(part: Part) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        g = grams(part.texts)
        for kind, n in enumerate(g.counts(learned(part))[:2]):
            yield kind, g.keys[kind], n

    def open_(g: Grams, part: Part) -> np.ndarray:
        """Trigrams whose pairs other parts have too; of any other the count here is that of the corpus."""
        shared = part.shared.get(1, np.zeros(0, bool))
        return shared[g.long] & shared[g.short]

    def triples(part: Part) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        g = grams(part.texts)
        some = open_(g, part)
        yield 2, g.keys[2][some], g.counts(learned(part))[2][some]

    none = np.zeros(0, np.uint64)
    pairs = texts.ask(shorter, "pairs")
    kinds, total = pairs.filter("kind = 0").agg(F.coalesce(F.sum("keys_seen"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    more = texts.ask(triples, "triples", pairs)

    def scored(part: Part) -> Iterator[pa.RecordBatch]:
        g = grams(part.texts)
        three = g.counts(learned(part))[2]
        three[open_(g, part)] = part.answers.get(2, none)
        m = Automaton(g, [part.answers.get(0, none), part.answers.get(1, none), three], total, kinds)
        at, size, n = g.at[0], np.diff(g.first), len(part.texts)
        known = np.bincount(g.owner, m.there[0][at], n).astype(np.int64)
        base, score = np.bincount(g.owner, m.arcs[0][at], n), np.bincount(g.owner, m.walk(), n)
        columns = [*part.columns[1:], pa.array(size.astype(np.int64)), pa.array(known), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=inner[1:] + added)

    fields = "".join(f"{i} {texts.rows.schema[i].dataType.simpleString()}, " for i in inner[1:])
    return texts.map(scored, fields + "n_tokens long, n_known long, train_tokens long, base_score double, score double", pairs, more).toDF(*names, *added)


def held_out(key: str = "doc_id"):
    """A tenth of the documents, never learned from."""
    return F.crc32(F.col(key).cast("string")) % 10 == 0


def op10_lm(spark, sf_dir: str) -> DataFrame:
    """Base score and automaton score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = lm_scores(docs, ~held_out(), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
