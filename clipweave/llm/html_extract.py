"""HTML main-text extraction: gradient-boosted trees over DOM nodes, decoded on the tree.

A tag-soup parser makes a tree of block nodes (inline tags only pass their text on). Each
node has features: its tag's kind, attribute tokens of content and of page furniture on
itself and above, depth, text and link density of its subtree, punctuation, children and
siblings, place in the page. Boosted trees give the log odds of content.

Decoding chooses, from the root down, the set of nodes with the largest sum of log odds
times text where a node under a dropped node is dropped as well; so an ancestor and a
descendant never contradict each other. The text of kept nodes is joined in page order.

The trees are trained here on a bounded sample (the pages with the MOST_PAGES smallest
hashes of page_id, and of their nodes the MOST_NODES first by the page's hash). Their labels
are of nodes whose place is named by the page itself: semantic tags and attribute tokens;
pages that name nothing are labelled by density (long, linkless, punctuated text against link
lists). A name gives its label away, so every page is learned from twice: as it is, and with
its names hidden (attribute tokens, and in every second page the semantic tags too), where the
trees have to tell the same labels from density, depth, siblings and place. So they judge
pages that name nothing, even if no such page is in the sample.

Null and empty html have an empty text. Cut-off pages are read as far as they go; a tag
without an end is no text. Pages of any length are read whole. Nodes with equal log odds of
zero are dropped. Rows that repeat are extracted alike. An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PAGES, MOST_NODES = 2_000, 60_000
TREES, DEPTH, BINS, RATE = 60, 4, 32, 0.25
#: How much of a page's names its features hide: nothing, attribute tokens, semantic tags as well.
SHOWN, UNNAMED, BARE = range(3)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
RAW = {"script", "style"}
HIDDEN = {"head", "script", "style", "template", "noscript", "svg", "iframe", "object", "textarea", "select", "canvas", "title"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "track", "wbr", "area", "base", "col", "embed", "param"}
INLINE = {"a", "b", "i", "u", "s", "em", "strong", "span", "small", "big", "sub", "sup", "code", "kbd", "samp", "var", "cite", "abbr", "time", "mark", "q", "label", "font", "tt", "ins", "del", "bdi", "bdo", "dfn", "data", "acronym"}
#: An opening tag of the key ends an open element of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KINDS = [{"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "button", "fieldset", "input"}, {"article"}, {"main"}, {"section"}, {"div"}, {"p", "blockquote", "pre"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"table", "tbody", "tr", "td", "th"}, {"figure", "figcaption", "dialog", "details"}]
KIND_OF = {t: i for i, s in enumerate(KINDS) for t in s}
FURNITURE_KINDS, CONTENT_KINDS = {0, 2, 3, 4}, {5, 6}
# Attribute tokens that name a place in the page; fixed values of this library.
CONTENT_NAMES = {"article", "content", "entry", "post", "story", "body", "main", "text", "maintext", "articlebody", "postbody"}
FURNITURE_NAMES = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "copyright", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "recommended", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "teaser", "toolbar", "widget",
}
#: Kinds that say what a part of the page is for, and the kind they have where that is hidden.
SEMANTIC, PLAIN = {0, 1, 2, 3, 4, 5, 6}, KIND_OF["div"]
PARAGRAPH, HEADING = KIND_OF["p"], KIND_OF["h1"]
N_FEATURES = len(KINDS) + 21


class Page:
    """Block nodes in page order, parent before child, and text pieces (node, text); node -1 is a break between blocks."""

    def __init__(self, html: str):
        self.kind, self.parent, self.good, self.bad, self.hidden, self.tag = [-1], [-1], [0], [0], [False], ["html"]
        self.pieces: list[tuple[int, str]] = []
        self.link: list[int] = [0]
        self._parse(html)

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        good = bad = 0
        if attrs and "=" in attrs:
            for m in _ATTR.finditer(attrs):
                for part in _PART.findall((m[2] or m[3] or m[4] or "").lower()):
                    good += part in CONTENT_NAMES
                    bad += part in FURNITURE_NAMES
        self.kind.append(KIND_OF.get(tag, -1))
        self.parent.append(parent)
        self.good.append(good)
        self.bad.append(bad)
        self.hidden.append(self.hidden[parent] or tag in HIDDEN)
        self.tag.append(tag)
        self.link.append(0)
        return len(self.kind) - 1

    def _parse(self, html: str) -> None:
        stack, at, in_link, pieces = [0], 0, False, self.pieces
        size = len(html)

        def text(a: int, b: int) -> None:
            if b > a:
                s = html[a:b]
                if "&" in s:
                    s = unescape(s)
                node = stack[-1]
                pieces.append((node, s))
                if in_link:
                    self.link[node] += len(s)

        pos = 0
        while pos < size:
            m = _TAG.search(html, pos)
            if not m:
                break
            text(at, m.start())
            at = pos = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            closing = (m[1] if m[2] else m[4]) == "/"
            attrs = (m[3] if m[2] else m[6]) or ""
            if tag in INLINE:
                if tag == "a":
                    in_link = not closing
                if closing or not _named(attrs):
                    if closing and tag in (self.tag[n] for n in stack[-1:]):
                        stack.pop()
                    continue
                stack.append(self._open(tag, attrs, stack[-1]))
                continue
            pieces.append((-1, " "))
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] == tag:
                        del stack[i:]
                        break
                in_link = False
                continue
            if tag in VOID:
                continue
            ends = CLOSES.get(tag)
            if ends:
                for i in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[i]]
                    if t in ends:
                        del stack[i:]
                        break
                    if t in ("ul", "ol", "dl", "table"):
                        break
            elif len(stack) > 1:
                for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    t = self.tag[stack[i]]
                    if t == "p":
                        del stack[i:]
                        break
                    if t not in INLINE:
                        break
            node = self._open(tag, attrs, stack[-1])
            if tag in RAW:
                end = re.compile(rf"</{tag}", re.I).search(html, pos)
                pos = at = end.start() if end else size
            if not attrs.endswith("/"):
                stack.append(node)
        cut = _OPEN.search(html, at)  # a tag that the page's end cuts off is no text
        text(at, cut.start() if cut else size)

    def features(self, hide: int = SHOWN) -> np.ndarray:
        n = len(self.kind)
        kind = [PLAIN if k in SEMANTIC else k for k in self.kind] if hide == BARE else self.kind
        named_good, named_bad = (self.good, self.bad) if hide == SHOWN else ([0] * n, [0] * n)
        parent = np.array(self.parent)
        own, words, marks = np.zeros(n), np.zeros(n), np.zeros(n)
        for node, s in self.pieces:
            if node >= 0:
                own[node] += len(s)
                words[node] += s.count(" ") + 1
                marks[node] += s.count(".") + s.count(",")
        hidden = np.array(self.hidden)
        own[hidden], words[hidden], marks[hidden] = 0, 0, 0
        self.own = own
        total, links, many, children = own.copy(), np.array(self.link, float), np.ones(n), np.zeros(n)
        punct, all_words = marks.copy(), words.copy()
        kinds = np.array(kind)
        paragraphs, headings, largest, second = (kinds == PARAGRAPH).astype(float), (kinds == HEADING).astype(float), np.zeros(n), np.zeros(n)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            paragraphs[p] += paragraphs[i]
            headings[p] += headings[i]
            if total[i] > largest[p]:
                largest[p], second[p] = total[i], largest[p]
            elif total[i] > second[p]:
                second[p] = total[i]
            total[p] += total[i]
            links[p] += links[i]
            many[p] += many[i]
            punct[p] += punct[i]
            all_words[p] += all_words[i]
            children[p] += 1
        self.total = total
        depth, good, bad, inside, furn = np.zeros(n), np.array(named_good, float), np.array(named_bad, float), np.zeros(n), np.zeros(n)
        rank, last = np.zeros(n), {}
        for i in range(1, n):
            p, k = self.parent[i], kind[i]
            depth[i] = depth[p] + 1
            inside[i] = inside[p] or k in CONTENT_KINDS or named_good[i] > 0
            furn[i] = furn[p] or k in FURNITURE_KINDS or named_bad[i] > 0 or (k == 1 and not inside[i])
            rank[i] = last.get(p, 0)
            last[p] = rank[i] + 1
        if hide == SHOWN:
            self.inside, self.furniture = inside, furn
        upto = np.cumsum(own)
        x = np.zeros((n, N_FEATURES))
        at = np.flatnonzero(kinds >= 0)
        x[at, kinds[at]] = 1
        c = len(KINDS)
        p = np.maximum(parent, 0)
        beside = np.where(total >= largest[p], second[p], largest[p])  # text of the largest other child
        cols = (good, bad, inside, furn, depth, np.log1p(own), np.log1p(total), links / np.maximum(total, 1), total / many, punct / np.maximum(all_words, 1), np.log1p(children), np.log1p(children[p]), rank / np.maximum(children[p], 1), total / np.maximum(total[p], 1), (upto - own) / max(upto[-1], 1), total / np.maximum(all_words, 1), np.log1p(total[p]), total / max(total[0], 1), np.log1p(paragraphs), np.log1p(headings), total / np.maximum(beside, 1))
        for j, v in enumerate(cols):
            x[:, c + j] = v
        return x

    def labels(self) -> np.ndarray:
        """1 content, 0 furniture, -1 unnamed; call after features(), which shows the names."""
        y = np.full(len(self.kind), -1)
        y[self.inside > 0] = 1
        y[self.furniture > 0] = 0
        y[(self.total == 0) | np.array(self.hidden)] = -1
        if not (y == 1).any() and len(y) > 1:
            links = np.array(self.link, float) / np.maximum(self.own, 1)
            y[(self.own >= 80) & (links < 0.2) & (self.furniture == 0)] = 1
            y[(self.own > 0) & (links > 0.5)] = 0
        y[0] = -1
        return y

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """Kept nodes: the best choice in which whatever is under a dropped node is dropped."""
        n = len(odds)
        value = np.where(self.own > 0, odds * np.log1p(self.own), 0.0)
        # A container without text of its own counts against keeping when it looks like furniture.
        value += np.where((self.own == 0) & (odds < -1.0), odds * np.log1p(self.total), 0.0)
        value[np.array(self.hidden)] = -1e9
        for i, t in enumerate(self.tag):
            if t in ("html", "body"):
                value[i] = max(value[i], 0.0) if self.own[i] else 0.0
        best = value.copy()
        for i in range(n - 1, 0, -1):
            if best[i] > 0:
                best[self.parent[i]] += best[i]
        keep = np.zeros(n, bool)
        keep[0] = True
        for i in range(1, n):
            keep[i] = keep[self.parent[i]] and (best[i] > 0 or (self.tag[i] == "body" and not self.hidden[i]))
        # The page's root and body keep only what stands in them directly when that itself looks like content.
        for i, t in enumerate(self.tag):
            if t in ("html", "body") and self.own[i] and odds[i] <= 0:
                self.own[i] = -1
        return keep

    def text(self, keep: np.ndarray) -> str:
        ok = keep & (self.own >= 0)
        return " ".join("".join(s for n, s in self.pieces if n < 0 or ok[n]).split())


def _named(attrs: str) -> bool:
    return "class" in attrs or "id=" in attrs


class Trees:
    """Gradient-boosted regression trees for logistic loss over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        self.depth, self.trees = depth, []
        b = self.bins(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(trees if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, cut, leaf = self._grow(b, g, h)
            self.trees.append((feature, cut, leaf))
            score += leaf[self._leaves(b, feature, cut)]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def _grow(self, b, g, h):
        """One tree, level by level: every node of a level takes its own best split."""
        inner = 2**self.depth - 1
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(len(g), np.int64)
        for level in range(self.depth):
            width, first = 2**level, 2**level - 1
            best = np.zeros(width)
            for j in range(b.shape[1]):
                key = node * (BINS + 1) + b[:, j]
                gs = np.bincount(key, g, width * (BINS + 1)).reshape(width, -1)
                hs = np.bincount(key, h, width * (BINS + 1)).reshape(width, -1)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                k = gain.argmax(1)
                v = gain[np.arange(width), k]
                better = v > best + 1e-9
                best[better], feature[first : first + width][better], cut[first : first + width][better] = v[better], j, k[better]
            f, c = feature[first + node], cut[first + node]
            node = 2 * node + (b[np.arange(len(g)), f] > c)
        n = 2**self.depth
        leaf = RATE * np.bincount(node, g, n) / (np.bincount(node, h, n) + 1)
        return feature, cut, leaf

    def _leaves(self, b, feature, cut):
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for level in range(self.depth):
            at = 2**level - 1 + node
            node = 2 * node + (b[rows, feature[at]] > cut[at])
        return node

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            out += leaf[self._leaves(b, feature, cut)]
        return out


def train(pages: DataFrame, most_pages: int = MOST_PAGES, most_nodes: int = MOST_NODES) -> Trees:
    """Trees from a bounded sample: features and labels are made by tasks, at most most_nodes rows come to the driver."""
    sample = pages.filter("html IS NOT NULL").select("page_id", F.xxhash64("page_id").alias("h"))
    ids = sample.orderBy("h", "page_id").limit(most_pages).select("page_id")
    rows = pages.select("page_id", F.col("html").cast("string")).join(F.broadcast(ids), "page_id", "left_semi").select("html", F.xxhash64("page_id", "html").alias("h"))

    def run(batches):
        for batch in batches:
            for html, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html)
                x = page.features()
                y = page.labels()
                at = np.flatnonzero(y >= 0)
                hidden = page.features(BARE if h & 1 else UNNAMED)
                seen = np.concatenate([x[at], hidden[at]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), h, np.int64)), pa.array(np.tile(at, 2)), pa.array(np.tile(y[at], 2).astype(np.int32)), pa.array([r.tolist() for r in seen], pa.list_(pa.float64()))], names=["h", "i", "y", "x"])

    got = rows.mapInArrow(run, "h long, i long, y int, x array<double>").orderBy("h", "i", "x").limit(most_nodes).select("y", "x").toArrow()
    y = got.column("y").to_numpy().astype(float)
    x = np.array(got.column("x").to_pylist(), float).reshape(len(y), N_FEATURES)
    return Trees(x, y)


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page: one pass, no shuffle."""
    model = pages.sparkSession.sparkContext.broadcast(trees or train(pages))

    def run(batches):
        for batch in batches:
            html = batch.column(2).to_pylist()
            texts = []
            for a in range(0, len(html), 200):
                parsed = [Page(h or "") for h in html[a : a + 200]]
                x = [p.features() for p in parsed]
                odds = model.value.log_odds(np.concatenate(x))
                cut = np.cumsum([0, *map(len, x)])
                texts += [p.text(p.decode(odds[s:e])) for p, s, e in zip(parsed, cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
