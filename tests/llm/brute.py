"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter
from functools import cache

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode())


def lower(text):
    return (text or "").encode().lower()  # of bytes: A-Z only


def quality(text, min_repeat, max_covered, max_longest):
    w = words(text)
    n = len(w)

    def covered(size):
        spots = Counter(tuple(w[i : i + size]) for i in range(n - size + 1))
        return sum(any(spots[tuple(w[i : i + size])] > 1 for i in range(max(0, p - size + 1), min(p, n - size) + 1)) for p in range(n))

    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line.encode()):
            dup += line in seen
            seen.add(line)
    far = any(c > 1 for c in Counter(tuple(w[i : i + max_longest]) for i in range(n - max_longest + 1)).values())
    three, cover = covered(3), covered(min_repeat)
    failed = n < 50 or 100 * three > 50 * n
    return {"n_words": n, "word_chars": sum(len(x.decode()) for x in w), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": dup, "n_repeat_words": three, "base_failed": failed, "covered_words": cover, "kept": not failed and not cover > max_covered * n and not far}


def contamination(text, items, window=10):
    w = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for size, phrases in _phrases(tuple(items), window).items():
        for i in range(len(w) - size + 1):
            names = phrases.get(tuple(w[i : i + size]))
            if names:
                hit.update(range(i, i + size))
                found |= names
    return len(w), hit, sorted(found)


@cache
def _phrases(items, window):
    out = {}
    for name, body in items:
        b = ALNUM.findall(lower(body))
        size = min(window, len(b))
        for k in range(len(b) - size + 1 if size else 0):
            out.setdefault(size, {}).setdefault(tuple(b[k : k + size]), set()).add(str(name))
    return out


def substrings(texts, window=35):
    """(words, kept words) of every text."""
    split = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {p for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((w, [x for p, x in enumerate(w) if p not in gone]))
    return out


def shingles(text, size=5):
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def components(docs, percent=75):
    """{row: (set size, least id of its component)} for rows (id, text)."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(docs)]


def sha(data):
    return hashlib.sha256(data).hexdigest()


class Trigrams:
    """Interpolated Dirichlet smoothing over words, pairs and triples, by the definition."""

    def __init__(self, texts, add, weights):
        self.add, self.weights, self.c = add, weights, {1: Counter(), 2: Counter(), 3: Counter()}
        for t in texts:
            w = [b"\n", *WORD.findall(lower(t)), b"\n"]
            for i in range(1, len(w)):
                for k in (1, 2, 3):
                    if i - k + 1 >= 0:
                        self.c[k][tuple(w[i - k + 1 : i + 1])] += 1
        self.total = sum(self.c[1].values())

    def p(self, word, history):
        if not history:
            return (self.c[1][(word,)] + self.add) / (self.total + self.add * (len(self.c[1]) + 1))
        k = len(history)
        return (self.c[k + 1][(*history, word)] + self.weights[k - 1] * self.p(word, history[1:])) / (self.c[k][history] + self.weights[k - 1])

    def score(self, text):
        w = [b"\n", *WORD.findall(lower(text)), b"\n"]
        return sum(math.log10(self.p(w[i], tuple(w[max(0, i - 2) : i]))) for i in range(1, len(w)))


def auc(scores, labels):
    pos, neg = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def cut(text, items):
    """The text without its hit words and what stands between two hit words that are neighbours."""
    if text is None:
        return None
    data = text.encode()
    _, hit, _ = contamination(text, items)
    out, at, last = [], 0, None
    for k, m in enumerate(ALNUM.finditer(data.lower())):
        if k in hit:
            if last != k - 1:
                out.append(data[at : m.start()])
            at, last = m.end(), k
    return (b"".join(out) + data[at:]).decode()


def style_tree(rows, html):
    """(pages, different pages, importance) of every (host, node), and the text of every page, by plain counting."""
    ways, pages = {}, []
    for key, url, body in rows:
        host = html.split_url(url)[0]
        pages.append((key, host, html.Page(body or "", ways)))
    name = {h: h for _, h, _ in pages}
    count = {}  # (host, node) -> what -> signature -> pages
    for _, host, page in pages:
        for site in (name[host], None):
            for node, children in page.nodes:
                for what in (0, ("children", children))[: 2 if children else 1]:
                    seen = count.setdefault((site, node), {}).setdefault(what, Counter())
                    seen[page.signature()] += 1
            for block, node in page.blocks:
                count.setdefault((site, node), {}).setdefault(("block", block.replace(host, "") if host else block), Counter())[page.signature()] += 1
    one = {}
    for (site, node), whats in count.items():
        if 0 not in whats:
            continue
        m = len(whats[0])
        log = math.log(m) if m > 1 else 1.0
        below = [(len(seen), len(w[0])) for (s, n), w in count.items() if s == site and 0 in w and node in ways[n][0] for what, seen in w.items() if what != 0 and what[0] == "block"]
        if not below:
            continue
        content = sum(1 - (math.log(k) / math.log(x) if x > 1 else 0) for k, x in below) / len(below)
        formed = [len(s) for what, s in whats.items() if what != 0 and what[0] == "children"]
        style = 1 - sum(k * math.log(k) for k in [*formed, max(m - sum(formed), 1)]) / (m * log) if m > 1 else 1.0
        one[site, node] = (sum(whats[0].values()), m, html.CONTENT_SHARE * content + (1 - html.CONTENT_SHARE) * max(style, 0))
    out, gone = {}, set()
    for (site, node), (_, m, value) in one.items():
        if site is None:
            continue
        n_all, m_all, every = one[None, node]
        weight = min(m_all, html.ALL_SITES)
        mixed = (m * value + weight * every) / (m + weight)
        out[site, node] = (n_all, m_all, mixed)
        flags = ways[node][1]
        enough = n_all >= html.EVIDENCE and (not flags & html.INSIDE or m_all >= html.EVIDENCE)
        if not flags & html.WHOLE and (flags & html.NEVER or (enough and mixed < html.LOW) or (flags & html.MARKED and not (enough and mixed >= html.HIGH))):
            gone.add((site, node))
    texts = {key: "\n".join(t for t, n in page.blocks if not any((name[host], x) in gone for x in ways[n][0])) for key, host, page in pages}
    return out, texts
