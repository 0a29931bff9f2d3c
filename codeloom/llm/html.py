"""Main text of web pages by a site style tree."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm._tables import column, discard, stored
from codeloom.llm._text import blocks
from codeloom.llm.urls import split_url

#: A node's importance is this share content and the rest presentation.
CONTENT_SHARE = 0.9
#: Below LOW a branch goes; below HIGH, or without enough evidence, its tag, role and class break the tie.
LOW, HIGH = 0.8, 0.85
#: The tree of all sites counts as so many pages of the host, or as its own pages if these are fewer.
ALL_SITES = 16
#: The tree judges a node from so many pages on, inside an article from so many different pages on.
EVIDENCE = 8
#: Levels of a page; what lies deeper belongs to its ancestor at the last one.
MAX_DEPTH = 64
#: A page's signature is made of so many of its longest blocks: copies of an article count once, whatever surrounds them.
LONGEST = 3
#: Hosts and removed nodes that are broadcast; more are joined to the pages.
MAX_BROADCAST = 500_000

# Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "select", "object", "canvas", "video", "audio", "title", "button", "label"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEEPS_P_OPEN = {"br", "hr", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body"}
#: Elements beyond which an element that is left open isn't closed by a later one.
BOUNDS = {"ul", "ol", "dl", "table", "article", "div", "section", "body", "blockquote", "main"}
# What tells, where the tree can't, that a branch is no main text: tags, ARIA roles and words of class and id.
ASIDE_TAGS = {"nav", "footer", "aside", "form", "head", "dialog", "menu", "header", "fieldset"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
ASIDE_WORDS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "banner", "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "popup", "modal", "overlay", "widget", "pagination", "pager", "toolbar", "skip", "copyright", "disclaimer", "teaser"}
#: Readers write anew on every page, so no tree can tell their comments from an article; these words decide.
COMMENT_WORDS = {"comment", "comments", "respond", "reply", "replies", "disqus"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_TAG_END = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_ATTR = re.compile(r"([a-zA-Z][-\w:]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STYLED = re.compile(r"class|id|role|hidden|style", re.I)
#: Flags of nodes: by its names no main text, inside an article or main element, reader comments, the whole page.
MARKED, INSIDE, NEVER, WHOLE = 1, 2, 4, 8


def tags(text: str) -> Iterator[tuple[str, str, str]]:
    """(what, name, attributes) of a page in order: `text`, `open` or `close`; raw elements and comments are left out.

    Every character is looked at a bounded number of times. A tag ends at the first `>` outside
    quotes; from the first tag on for which there is none, quotes are not heeded, and a tag
    without any `>` is text.
    """
    at, n, quotes, last = 0, len(text), True, text.rfind(">")
    unclosed: set[str] = set()
    while at < n:
        begin = text.find("<", at)
        if begin < 0 or begin > last:
            break
        if begin > at:
            yield "text", text[at:begin], ""
        at = begin + 1
        if text.startswith("!--", at):
            end = text.find("-->", at + 3)
            at = end + 3 if end >= 0 else n
            continue
        if text[at] in "!?":
            at = text.find(">", at) + 1
            continue
        shut = text[at] == "/"
        name = _NAME.match(text, at + shut)
        if not name:
            yield "text", "<", ""
            continue
        end = _TAG_END.match(text, name.end()) if quotes else None
        if not end:
            quotes = False
            stop = text.find(">", name.end()) + 1
        else:
            stop = end.end()
        tag, attrs, at = name[0].lower(), text[name.end() : stop - 1], stop
        if shut:
            yield "close", tag, ""
        elif tag in RAW:
            if not attrs.endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{tag}[\s>]", re.I).search(text, at)
                if end:
                    at = text.find(">", end.start()) + 1 or n
                else:
                    unclosed.add(tag)
                    if tag in ("script", "style", "template", "noscript"):
                        at = n
        else:
            yield "open", tag, attrs
    if at < n:
        yield "text", text[at:], ""


class Page:
    """The blocks of a page, each with the node that holds it, and its nodes with the sequence of their children.

    A node is a place of the site: the tags of the block elements down to it, each with the letters
    of its class and id, its role and whether it is hidden. `ways` collects, for every node of
    the pages so far, the nodes from the root down to it and its flags.
    """

    def __init__(self, text: str, ways: dict[int, tuple[tuple[int, ...], int]]):
        self.blocks: list[tuple[str, int]] = []
        self.nodes: set[tuple[int, int]] = set()
        self.ways = ways
        # of the open elements: tag, node, style of the last child, running hash of the children's styles, unseen
        self.open: list[list] = [["#", 0, "", 0, False]]
        self.depths: dict[str, list[int]] = {}
        self.bounds: list[int] = [0]
        self.buffer: list[str] = []
        ways.setdefault(0, ((), 0))
        for what, name, attrs in tags(text):
            if what == "text":
                if not self.open[-1][4]:
                    self.buffer.append(name)
            elif what == "close":
                if self.depths.get(name):
                    self.shut(self.depths[name][-1])
            else:
                self.begin(name, attrs)
        self.shut(1)
        self.flush()

    def begin(self, tag: str, attrs: str) -> None:
        block = tag in BLOCK
        if tag in CLOSES or (block and tag not in KEEPS_P_OPEN):
            low = self.bounds[-1]
            first = [d[k] for t in CLOSES.get(tag, ("p",)) if (d := self.depths.get(t)) and (k := bisect_right(d, low)) < len(d)]
            if first:
                self.shut(min(first))
        if block:
            self.flush()
        over = self.open[-1]
        style, flags, unseen = self.style(tag, attrs) if attrs and _STYLED.search(attrs) else (tag, 0, False)
        if style != over[2]:  # a run of like children counts as one
            over[2] = style
            over[3] = xxhash.xxh3_64_intdigest(f"{over[3]}/{style}")
        if tag in VOID or attrs.endswith("/"):
            return
        node = over[1]
        if block and not over[4]:
            node = self.node(over[1], tag, style, flags)
        if block and tag in BOUNDS:
            self.bounds.append(len(self.open))
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append([tag, node, "", 0, over[4] or unseen])

    def style(self, tag: str, attrs: str) -> tuple[str, int, bool]:
        own = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(attrs)}
        names = [_WORD.findall(own[k]) for k in ("class", "id") if own.get(k)]
        words = {w.lower() for x in names for w in x}
        role = own.get("role", "").lower()
        unseen = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
        flags = MARKED * bool(words & ASIDE_WORDS and tag not in ("html", "body", "article", "main") or role in ASIDE_ROLES) | NEVER * bool(words & COMMENT_WORDS and tag not in ("html", "body"))
        return ".".join([tag, *(" ".join(x).lower() for x in names), role]), flags, unseen

    def node(self, parent: int, tag: str, style: str, flags: int) -> int:
        way, over = self.ways[parent]
        if len(way) == MAX_DEPTH:
            return parent
        node = xxhash.xxh3_64_intdigest(f"{parent}/{style}") >> 1
        if node not in self.ways:
            inside = INSIDE if tag in ("article", "main") else over & INSIDE
            marked = MARKED if tag in ASIDE_TAGS and not (tag == "header" and over & INSIDE) else 0
            whole = WHOLE if tag in ("html", "body") else 0
            self.ways[node] = ((*way, node), flags | inside | marked | whole)
        return node

    def shut(self, depth: int) -> None:
        """End the open elements from this depth on."""
        while len(self.open) > depth:
            tag, node, _, children, _ = self.open[-1]
            if tag in BLOCK:
                self.flush()
                self.nodes.add((node, (children >> 3 << 1) + 2 if children else 0))
            self.open.pop()
            self.depths[tag].pop()
            if self.bounds[-1] == len(self.open):
                self.bounds.pop()

    def flush(self) -> None:
        if self.buffer:
            text = " ".join(entities.unescape("".join(self.buffer)).split())
            if text:
                self.blocks.append((text, self.open[-1][1]))
            self.buffer.clear()

    def signature(self) -> int:
        longest = sorted({t for t, _ in self.blocks}, key=lambda t: (-len(t), t))[:LONGEST]
        return xxhash.xxh3_64_intdigest("\n".join(longest)) >> 1


def parsed(pages: DataFrame, url: Column, html: Column, columns: list[Column], inner: list[str]) -> DataFrame:
    """Stored rows of two kinds: pages (`texts` is not null) and nodes (`way` is not null).

    A page has its carried columns, host, signature, block texts, each block's node, and the distinct
    (node, children) of it (0 for no children). A node has the nodes from the root down to it, and flags.
    """
    rows = pages.select(html.alias("html"), url.alias("url"), *[c.alias(i) for c, i in zip(columns, inner, strict=True)])
    own = [("host", pa.string()), ("sig", pa.int64()), ("texts", pa.list_(pa.string())), ("holders", pa.list_(pa.int64())), ("nodes", pa.list_(pa.int64())), ("children", pa.list_(pa.int64())), ("way", pa.list_(pa.int64())), ("flags", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict[int, tuple[tuple[int, ...], int]] = {}
        sent: set[int] = set()
        kinds: list[pa.DataType] = []

        def table(carried: list[pa.Array], values: list[tuple], size: int) -> pa.RecordBatch:
            held = [pa.array(v, t) for v, (_, t) in zip(zip(*values, strict=True) if values else [()] * len(own), own, strict=True)]
            return pa.RecordBatch.from_arrays([*(carried or [pa.nulls(size, t) for t in kinds]), *held], names=[str(k) for k in range(len(inner) + len(own))])

        for batch, texts in blocks(batches, "html"):
            kinds = [c.type for c in batch.columns[2:]]
            out = []
            for u, t in zip(batch.column(1).to_pylist(), texts, strict=True):
                host = split_url(u)[0]
                page = Page(t.decode() if t else "", ways)
                nodes = sorted(page.nodes)
                out.append((host, page.signature(), [x for x, _ in page.blocks], [h for _, h in page.blocks], [a for a, _ in nodes], [b for _, b in nodes], None, None))
            yield table(batch.columns[2:], out, len(out))
            new = [(None,) * 6 + (list(way), flags) for node, (way, flags) in ways.items() if way and node not in sent]
            sent.update(ways)
            if new:
                yield table([], new, len(new))
            if len(ways) > 200_000:  # a site with ever new names: begin anew
                ways, sent = {}, set()

    names = "host string, sig long, texts array<string>, holders array<long>, nodes array<long>, children array<long>, way array<long>, flags int"
    carried = "".join(f"{i} {f.dataType.simpleString()}, " for i, f in zip(inner, rows.schema.fields[2:], strict=True))
    return stored(rows.mapInArrow(run, carried + names), "pages")


def importance(table: DataFrame) -> DataFrame:
    """(host, node, pages, different, flags, importance) of the site style tree of `parsed` pages.

    All pages of a host are merged by their nodes; the tree of all sites is host null. Pages with one
    signature count as one. Of m pages with a node, a block on k of them has the entropy
    ln k / ln m (0 on a single page); the content importance of a branch is 1 less the mean over the
    distinct blocks of all its nodes, the presentation importance of a node is the entropy of its
    sequences of children, no children being one of them. A host's tree is mixed with that of all sites by their number of pages.
    """
    pages = table.filter("texts is not null")
    shape = pages.select("host", "sig", F.explode(F.arrays_zip("nodes", "children")).alias("x")).select("host", "sig", F.col("x.nodes").alias("node"), F.col("x.children").alias("what"))
    block = pages.select("host", "sig", F.explode(F.arrays_zip("holders", "texts")).alias("x"))
    # a page's own host is the same name everywhere
    block = block.select("host", "sig", F.col("x.holders").alias("node"), F.xxhash64(F.replace("x.texts", "host", F.lit(""))).bitwiseOR(F.lit(1)).alias("what"))
    # the node itself is what = 0; its children are even, its blocks odd
    what = shape.select("host", "node", F.lit(0).cast("long").alias("what"), "sig").union(shape.filter("what != 0").select("host", "node", "what", "sig")).union(block.select("host", "node", "what", "sig"))
    site = F.xxhash64("host").bitwiseAND(F.lit(2**63 - 1))
    what = what.select(F.explode(F.array(site, F.lit(None).cast("long"))).alias("host"), "node", "what", "sig")
    k = what.groupBy("host", "node", "what", "sig").agg(F.count("*").alias("n")).groupBy("host", "node", "what").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    odd, even = F.col("what").bitwiseAND(F.lit(1)) == 1, (F.col("what") != 0) & (F.col("what").bitwiseAND(F.lit(1)) == 0)
    own = k.groupBy("host", "node").agg(
        F.max(F.when(F.col("what") == 0, F.col("k"))).alias("m"), F.max(F.when(F.col("what") == 0, F.col("n"))).alias("pages"),
        F.count(F.when(odd, 1)).alias("blocks"), F.sum(F.when(odd, F.ln("k"))).alias("shared"), F.coalesce(F.sum(F.when(even, F.col("k") * F.ln("k"))), F.lit(0.0)).alias("same"), F.coalesce(F.sum(F.when(even, F.col("k"))), F.lit(0)).alias("formed"),
    )
    # the root of a page without elements has no row of its own
    own = stored(own.filter("m is not null"), "nodes")
    log = F.when(F.col("m") > 1, F.ln("m")).otherwise(1.0)
    leaf = own.filter("blocks > 0").select("host", "node", "blocks", (F.col("blocks") - F.least(F.coalesce("shared", F.lit(0.0)) / log, F.col("blocks"))).alias("content"))
    ways = stored(table.filter("way is not null").groupBy(F.element_at("way", -1).alias("node")).agg(F.first("way").alias("way"), F.first("flags").alias("flags")), "ways")
    branch = leaf.join(ways, "node").select("host", "blocks", "content", F.explode("way").alias("node"))
    branch = branch.groupBy("host", "node").agg((F.sum("content") / F.sum("blocks")).alias("content"))
    bare = F.greatest(F.col("m") - F.col("formed"), F.lit(0))
    style = F.when(F.col("m") > 1, 1 - (F.col("same") + F.when(bare > 0, bare * F.ln(bare)).otherwise(0.0)) / (F.col("m") * log)).otherwise(1.0)
    alone = own.alias("o").join(branch.alias("b"), (F.col("o.node") == F.col("b.node")) & F.col("o.host").eqNullSafe(F.col("b.host")))
    alone = alone.select("o.host", "o.node", "m", "pages", (F.lit(CONTENT_SHARE) * F.col("content") + F.lit(1 - CONTENT_SHARE) * F.greatest(style, F.lit(0.0))).alias("one"))
    every = alone.filter("host is null").select("node", F.col("m").alias("different"), F.col("pages").alias("all_pages"), F.col("one").alias("all"))
    mixed = alone.filter("host is not null").join(every, "node").join(ways.select("node", "flags"), "node")
    weight = F.least(F.col("different"), F.lit(ALL_SITES))
    return mixed.select("host", "node", F.col("all_pages").alias("pages"), "different", "flags", ((F.col("m") * F.col("one") + weight * F.col("all")) / (F.col("m") + weight)).alias("importance"))


def removed(nodes: DataFrame) -> DataFrame:
    """(host, node) of the branches that are no main text; see `extract`."""
    flag = lambda x: F.col("flags").bitwiseAND(F.lit(x)) != 0
    enough = (F.col("pages") >= EVIDENCE) & (~flag(INSIDE) | (F.col("different") >= EVIDENCE))
    low = enough & (F.col("importance") < LOW)
    tie = flag(MARKED) & ~(enough & (F.col("importance") >= HIGH))
    return nodes.filter(~flag(WHOLE) & (low | tie | flag(NEVER))).select("host", "node")


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The columns `keep` (all by default) of every row, then text and n_chars.

    The text is that of the page's blocks whose branch the site's style tree finds important. A
    branch goes if its importance is below LOW. Between LOW and HIGH, and where fewer than
    EVIDENCE pages of all sites have the node (inside an article or main element: that many different
    ones, so copies of one article aren't taken for boilerplate), the tag, role, class or id of its top
    breaks the tie: menus, headers, footers, sidebars, notices, adverts and forms go, anything else
    stays. Reader comments go by their names, since they repeat no more than articles do; hidden
    elements, scripts, styles and form controls are no text. Character references are decoded,
    white space in a block is one space, blocks are joined by a line feed; a br ends a block.

    Null or empty html, or a page of boilerplate alone, gives an empty text. A host with few pages
    is judged mostly by the tree of all sites, a null url as a host of its own. Repeated rows give
    equal texts and count once. Input columns named like an output give way, other names don't clash;
    an empty table has no rows. Pages are parsed once, in time linear in their length.
    """
    added = ["text", "n_chars"]
    names = [c for c in (keep if keep is not None else pages.columns) if c not in added]
    inner = [f"c{k}" for k in range(len(names))]
    table = parsed(pages, column(pages, url).cast("string"), column(pages, html).cast("string"), [column(pages, c) for c in names], inner)
    nodes = importance(table)
    top = stored(removed(nodes).distinct(), "removed")
    # with a branch go all nodes below it
    ways = table.filter("way is not null").groupBy(F.element_at("way", -1).alias("below")).agg(F.first("way").alias("way")).select("below", F.explode("way").alias("node"))
    gone = stored(top.join(ways, "node").groupBy("host").agg(F.collect_set("below").alias("gone")), "gone")
    discard(top)
    size = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    held = table.filter("texts is not null").select(*inner, F.xxhash64("host").bitwiseAND(F.lit(2**63 - 1)).alias("host"), "texts", "holders").join(F.broadcast(gone) if size <= max_broadcast else gone, "host", "left")
    here = F.array_intersect("holders", F.coalesce("gone", F.array().cast("array<long>")))
    held = held.select(*inner, "texts", "holders", here.alias("here"))
    whole = F.filter(F.arrays_zip("texts", "holders"), lambda x: ~F.array_contains(F.col("here"), x["holders"]))
    text = F.array_join(F.transform(whole, lambda x: x["texts"]), "\n")
    return held.select(*inner, text.alias("text")).select(*inner, "text", F.char_length("text").cast("long").alias("n_chars")).toDF(*names, *added)


def op9_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
