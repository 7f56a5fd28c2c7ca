"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is cut into tags and text by one pass of a regular expression and built
into a tree of its block elements; text that stands in the body beside elements is
a node of its own. Each node has features of its subtree (text, link and tag
density), its attribute tokens, its depth and its siblings (how many are built like
it, whether a heading before it speaks of comments), and where it stands to the
element that most text is in. Attribute tokens are
hashed; what a bucket tells for or against is learned. Gradient
boosted trees give the probability that a node is part of the article. The
decoding picks the likeliest labels of all nodes under the condition that nothing
below a dropped node is kept, by one pass from the leaves to the root.

Pages carry no labels, so the trees are fitted on pages whose parts are known by
construction: the blocks found in a bounded sample of the input (``FIT_PAGES``
pages, drawn by a hash of the id), laid out again in varied templates between
menus, notices, adverts, sidebars, forms, reader comments and footers.

Defined cases: null or empty html gives the empty text; text outside any tag
belongs to the body, and is all the main text of a page without block elements;
unknown character references stay as they are; a tag that is
never closed ends with its parent; one without its ``>`` is text; scripts and styles
that are never closed go on to the page's end, other hidden elements without an end
are passed over. Every row gives one output row, whatever ids repeat or are null; an
empty table gives an empty result; long pages are read whole. Other columns stay, and
a column of the output's name is replaced by it.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

FIT_PAGES = 150
LAYOUTS = 14
TREES, DEPTH, RATE, BINS = 90, 4, 0.2, 32

# Elements by the part they play.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img input link meta base col area source track embed param object svg noscript template iframe".split())
VOID = frozenset("br img input link meta base col area source track embed param wbr hr".split())
SILENT = frozenset("head title".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body article section div main nav aside footer header form td th select".split())
GROUPS = ("nav", "header", "footer", "aside", "form fieldset button select option label dialog menu", "article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table thead tbody tfoot tr td th caption", "blockquote pre figure figcaption", "body html")
#: Buckets of hashed attribute tokens, and how much one can tell for or against (a log ratio).
BUCKETS, MOST_SAID = 1 << 14, 3.0

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<hidden>noscript|template|iframe|svg|object)\b[^>]*>.*?</(?P=hidden)\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^<>]*>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TRUTH = re.compile(r"\bdata-part=(\w+)")
PART = re.compile(r"[a-z]+")
FEATURES = len(GROUPS) + 38

# What short texts of notices of rights, of headings of reader comments, and of adverts say.
RIGHTS = re.compile(r"©|\(c\) ?\d{4}|\bcopyright\b|\brights reserved\b|\btous droits réservés\b|\balle rechte vorbehalten\b|\btodos los derechos\b", re.I)
COMMENTS = re.compile(r"\b(?:comments?|repl(?:y|ies)|responses?|discussion|commentaires?|réponses?|kommentare?|antworten|comentarios?|respuestas?)\b", re.I)
ADVERT = re.compile(r"\b(?:advertisement|advertising|sponsored|promoted|publicité|sponsorisé|anzeige|werbung|publicidad|patrocinado)\b", re.I)
#: A notice of rights says so within so many characters; texts of comments and adverts are looked at if not longer.
SAYING = 120


class Node:
    __slots__ = ("attributes", "children", "controls", "depth", "link", "parent", "place", "tag", "text", "truth")

    def __init__(self, tag: str, parent: int, depth: int, place: int) -> None:
        self.tag, self.parent, self.depth, self.place = tag, parent, depth, place
        self.attributes: frozenset[str] | list[str] = ()
        self.children = self.text = self.link = self.controls = 0
        self.truth = None


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements in page order (the first is the root), and the runs of text as (node, raw text)."""
    nodes = [Node("body", -1, 0, 0)]
    runs: list[tuple[int, str]] = []
    stack, run, links, at, silent = [0], [], 0, 0, 0

    def flush() -> None:
        if run:
            text = html.unescape("".join(run))
            run.clear()
            if text and not text.isspace() and not silent:
                k = stack[-1]
                if k == 0:  # beside elements: a node without a tag
                    nodes.append(Node("", 0, 1, nodes[0].children))
                    nodes[0].children += 1
                    k = len(nodes) - 1
                    nodes[k].link, nodes[0].link = nodes[0].link, 0
                runs.append((k, " ".join(text.split())))

    def write(text: str) -> None:
        run.append(text)
        n = len(text)
        if links and not silent:
            nodes[stack[-1]].link += n

    def close(to: int) -> None:
        nonlocal silent
        flush()
        while len(stack) > to:
            silent -= nodes[stack.pop()].tag in SILENT

    for m in TOKEN.finditer(page):
        if m.start() > at:
            write(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m["end"] else 1
            elif tag == "br":
                run.append(" ")
            elif tag == "input":
                nodes[stack[-1]].controls += 1
            continue
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    close(k)
                    break
            else:
                flush()
            links = 0
            continue
        flush()
        if tag in ("html", "body", "hr"):
            continue
        # An open paragraph ends before any block; items, rows and cells end before the next one.
        if nodes[stack[-1]].tag == "p":
            close(len(stack) - 1)
        if ends := CLOSES.get(tag):
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag in ends:
                    close(k)
                    break
                if nodes[stack[k]].tag in SCOPE:
                    break
        parent = nodes[stack[-1]]
        node = Node(tag, stack[-1], parent.depth + 1, parent.children)
        parent.children += 1
        if rest := m["rest"]:
            if "=" in rest:
                node.attributes = frozenset(PART.findall(" ".join(a or b or c for a, b, c in ATTRIBUTE.findall(rest)).lower()))
                if t := TRUTH.search(rest):
                    node.truth = t[1]
            if rest.endswith("/") and tag not in SCOPE:
                nodes.append(node)
                continue
        stack.append(len(nodes))
        nodes.append(node)
        silent += tag in SILENT
    if at < len(page):
        write(page[at:])
    close(1)
    return nodes, runs


_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}


def bucket_of(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def said_by_tokens(parsed: list[tuple[list[Node], list[bool]]]) -> np.ndarray:
    """What each bucket of attribute tokens tells: the log ratio of kept to dropped nodes that have it."""
    kept, dropped = np.ones(BUCKETS), np.ones(BUCKETS)
    for nodes, label in parsed:
        for x, keep in zip(nodes, label, strict=True):
            for t in x.attributes:
                (kept if keep else dropped)[bucket_of(t)] += 1
    return np.clip(np.log(kept / dropped), -MOST_SAID, MOST_SAID)


def features(nodes: list[Node], runs: list[tuple[int, str]], said: np.ndarray) -> np.ndarray:
    """One row a node; ``said``: what the buckets of attribute tokens tell."""
    n = len(nodes)
    own, link, words, punctuation, digits, pieces, longest, rights, talk, advert = ([0] * n for _ in range(10))
    start = [0] * n
    total = 0
    for k, text in runs:
        rights[k] += RIGHTS.search(text, 0, SAYING) is not None
        if len(text) <= SAYING:
            talk[k] += COMMENTS.search(text) is not None
            advert[k] += ADVERT.search(text) is not None
        own[k] += len(text)
        words[k] += text.count(" ") + 1
        punctuation[k] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        digits[k] += sum(map(text.count, "0123456789"))
        pieces[k] += 1
        longest[k] = max(longest[k], len(text))
    size, tags, heads, controls, bad, good = list(own), [1] * n, [0] * n, [x.controls for x in nodes], [0.0] * n, [0.0] * n
    paragraphs = [0] * n
    same: dict[tuple[int, str], int] = {}
    for k, x in enumerate(nodes):
        link[k] = x.link
        start[k] = total
        total += own[k]
        heads[k] = x.tag in ("h1", "h2", "h3")
        paragraphs[k] = x.tag == "p"
        controls[k] += x.tag in ("button", "select", "form", "label")
        if x.attributes:
            told = [said[bucket_of(t)] for t in x.attributes]
            bad[k], good[k] = min(0.0, *told), max(0.0, *told)
        same[x.parent, x.tag] = same.get((x.parent, x.tag), 0) + 1
    hub, inside = _hub(nodes, own)
    alike, most_alike = _alike(nodes, own)
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        for sums in (size, link, words, punctuation, digits, pieces, tags, heads, controls, paragraphs, rights, talk, advert):
            sums[p] += sums[k]
        longest[p] = max(longest[p], longest[k])
    out = np.zeros((n, FEATURES))
    above_bad, above_good, in_part, in_main = [0.0] * n, [0.0] * n, [0] * n, [0] * n
    #: Whether a short text about comments stands in a node above, or before the node in the same one; likeness of what is above.
    said_comments, opened, above_alike = [0] * n, [0] * n, [0.0] * n
    base = len(GROUPS)
    for k, x in enumerate(nodes):
        group = _GROUP.get(x.tag)
        if group is not None:
            out[k, group] = 1
        p = max(x.parent, 0)
        up = nodes[p]
        if k:
            above_bad[k], above_good[k] = min(above_bad[p], bad[p]), max(above_good[p], good[p])
            in_part[k] = in_part[p] + (up.tag in ("nav", "footer", "aside", "form", "header"))
            in_main[k] = in_main[p] + (up.tag in ("article", "main"))
            above_alike[k] = max(above_alike[p], alike[p])
            said_comments[k] = said_comments[p] + opened[p]
            if talk[k] and size[k] <= SAYING:
                opened[p] = 1
        s = size[k] or 1
        out[k, base:] = (
            bad[k], good[k], above_bad[k], above_good[k], bad[p], good[p], in_part[k], in_main[k],
            x.depth, math.log1p(size[k]), math.log1p(words[k]), min(1.0, link[k] / s), size[k] / (total or 1),
            s / (pieces[k] or 1), math.log1p(longest[k]), punctuation[k] / s, digits[k] / s, s / tags[k], x.children,
            (x.place + 1) / (up.children or 1), same[x.parent, x.tag] / (up.children or 1), up.children, start[k] / (total or 1),
            heads[k], controls[k], paragraphs[k] / tags[k], _GROUP.get(up.tag, -1),
            inside[k], start[k] >= start[hub], rights[k] / (pieces[k] or 1), rights[k], talk[k] / (pieces[k] or 1), said_comments[k], advert[k] / (pieces[k] or 1),
            alike[k], above_alike[k], most_alike[k], math.log1p(own[k]),
        )
    return out


def _hub(nodes: list[Node], own: list[int]) -> tuple[int, list[int]]:
    """The element that most text stands in directly (children count in full, theirs by half), and of each
    node whether it is that or below (2), above (1), or beside (0)."""
    n = len(nodes)
    weight = [0.0] * n
    for k in range(1, n):
        p = nodes[k].parent
        weight[p] += own[k]
        if p:
            weight[nodes[p].parent] += own[k] / 2
    hub = max(range(n), key=weight.__getitem__)
    inside = [0] * n
    k = nodes[hub].parent
    while k >= 0:
        inside[k] = 1
        k = nodes[k].parent
    inside[hub] = 2
    for k in range(hub + 1, n):
        if inside[nodes[k].parent] == 2:
            inside[k] = 2
    return hub, inside


def _alike(nodes: list[Node], own: list[int]) -> tuple[list[float], list[float]]:
    """Of each element with others in it, how many siblings are built like it (tag, tags in it, text of its own);
    and of each, how many of its children are built alike. Both as logarithms."""
    inner: list[list[str]] = [[] for _ in nodes]
    for x in nodes[1:]:
        if len(inner[x.parent]) < 4:  # enough to tell two forms apart
            inner[x.parent].append(x.tag)
    form = [(x.parent, x.tag, own[k] > 0, *inner[k]) if x.children else None for k, x in enumerate(nodes)]
    count = Counter(form)
    alike = [math.log(count[f]) if f else 0.0 for f in form]
    most = [0.0] * len(nodes)
    for k in range(1, len(nodes)):
        p = nodes[k].parent
        most[p] = max(most[p], alike[k])
    return alike, most


class Trees:
    """Gradient boosted trees for a yes-or-no label, on binned features; ``said`` goes with them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, said: np.ndarray) -> None:
        self.said = said
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._bins(x)
        self.base = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        score = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._walk(tree, binned)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1).astype(np.int32)

    @staticmethod
    def _grow(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full tree: feature and last left bin of each inner node, value of each leaf."""
        inner = (1 << DEPTH) - 1
        feature, split = np.zeros(inner, np.int32), np.full(inner, BINS, np.int32)
        at = np.zeros(len(gradient), np.int64)
        width = binned.shape[1]
        for level in range(DEPTH):
            first, count = (1 << level) - 1, 1 << level
            local = at - first
            g, h = np.zeros((count, width, BINS)), np.zeros((count, width, BINS))
            for f in range(width):
                cell = local * BINS + binned[:, f]
                g[:, f] = np.bincount(cell, gradient, count * BINS).reshape(count, BINS)
                h[:, f] = np.bincount(cell, hessian, count * BINS).reshape(count, BINS)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            best = gain.reshape(count, -1).argmax(1)
            worth = gain.reshape(count, -1).max(1) > 1e-6
            feature[first : first + count] = best // BINS
            split[first : first + count] = np.where(worth, best % BINS, BINS)
            at = 2 * at + 1 + (binned[np.arange(len(at)), feature[at]] > split[at])
        leaf = at - inner
        value = RATE * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, hessian, inner + 1) + 1)
        return feature, split, value

    @staticmethod
    def _walk(tree: tuple[np.ndarray, np.ndarray, np.ndarray], binned: np.ndarray) -> np.ndarray:
        feature, split, value = tree
        at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (binned[rows, feature[at]] > split[at])
        return value[at - len(feature)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = self._bins(x)
        return self.base + sum(self._walk(t, binned) for t in self.trees)


def decode(nodes: list[Node], log_odds: np.ndarray) -> list[bool]:
    """Likeliest labels with no kept node below a dropped one; the root is kept.

    Against dropping all of a subtree, keeping its top gains the top's log odds
    and, for each child, what keeping that gains, if anything.
    """
    gain = log_odds.tolist()
    for k in range(len(nodes) - 1, 0, -1):
        if gain[k] > 0:
            gain[nodes[k].parent] += gain[k]
    keep = [True] * len(nodes)
    for k in range(1, len(nodes)):
        keep[k] = keep[nodes[k].parent] and gain[k] > 0
    return keep


def main_texts(model: Trees, pages: list[str | None]) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    odds = model.log_odds(np.concatenate([features(*p, model.said) for p in parsed])) if parsed else np.zeros(0)
    out, at = [], 0
    for nodes, runs in parsed:
        keep = decode(nodes, odds[at : at + len(nodes)]) if any(x.tag for x in nodes[1:]) else [True] * len(nodes)
        at += len(nodes)
        out.append("\n".join(text for k, text in runs if keep[k]))
    return out


# Names that the parts of pages commonly go by, for the layouts that are fitted on.
NAMES = {
    "menu": "nav menu navbar main-navigation site-nav topbar breadcrumb breadcrumbs pagination pager toolbar skip-link".split(),
    "head": "site-header masthead header banner branding top".split(),
    "notice": "cookie-notice cookie-banner consent notice alert popup modal dialog disclaimer gdpr".split(),
    "advert": "ad ads advert ad-slot sponsored sponsor promo banner-ad advertisement ad-bottom cta teaser shop".split(),
    "form": "search login searchform newsletter subscribe signup feedback contact-form".split(),
    "foot": "footer site-footer legal contentinfo colophon copyright imprint".split(),
    "side": "sidebar widget widget-area related recommended trending secondary complementary more-stories popular".split(),
    "comments": "comments comment-list replies disqus respond responses discussion comments-area".split(),
    "comment": "comment reply comment-body response post-comment".split(),
    "share": "share social tags sharing social-links meta-links tag-list".split(),
    "article": "post content article-body entry-content story post-text article entry body-text prose main-content text hentry single".split(),
    "wrap": "wrap page container site wrapper layout".split(),
}


# What such parts say in the fitted layouts.
SAYINGS = {
    "comments": ["Comments", "3 comments", "12 Responses", "Replies", "Discussion", "Leave a reply", "Reader comments", "Commentaires", "2 commentaires", "Kommentare", "5 Kommentare", "Comentarios", "Respuestas"],
    "rights": ["&copy; {}", "&copy; 2021 {}", "Copyright 2019 {}", "Copyright &copy; {}", "{}. All rights reserved.", "Copyright 2020 {}. All rights reserved.", "(c) 2022 {}", "&copy; {}. Tous droits réservés.", "{}. Alle Rechte vorbehalten.", "{}. Todos los derechos reservados."],
    "advert": ["Advertisement", "Sponsored", "Sponsored: {}", "Advertisement {}", "Anzeige", "Anzeige: {}", "Publicité {}", "Publicidad {}", "{}", "{}", "{}"],
}


class _Layout:
    """Makes one page around given blocks, with ``data-part`` on what is kept and what is not."""

    def __init__(self, blocks: list[str], rng: np.random.Generator) -> None:
        self.blocks, self.rng = blocks, rng
        self.words = " ".join(blocks).split() or ["text"]
        #: Share of parts whose name tells nothing, and of those without a name; a page is of one maker.
        self.vague, self.bare = [(0.1, 0.1), (0.1, 0.1), (0.5, 0.3), (0.1, 0.8)][int(rng.integers(4))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, *of: str) -> str:
        return of[int(self.rng.integers(len(of)))]

    def number(self, least: int, most: int) -> int:
        return int(self.rng.integers(least, most))

    def some(self, least: int, most: int) -> str:
        i = self.number(0, len(self.words))
        return html.escape(" ".join(self.words[i : i + self.number(least, most)]) or self.words[0])

    def says(self, what: str) -> str:
        return self.pick(*SAYINGS[what]).format(self.some(1, 8))

    def naming(self, of: str) -> str:
        """An attribute with a name of that kind, with one that tells nothing, or none."""
        drawn = self.rng.random()
        if drawn < self.bare:
            return ""
        name = self.pick(*NAMES[of])
        if drawn < self.bare + self.vague:
            letters = "".join(chr(97 + self.number(0, 26)) for _ in range(self.number(1, 4)))
            name = self.pick(f"{letters}{self.number(0, 100)}", letters, f"{self.pick('box', 'block', 'row', 'col', 'region', 'wrapper')}-{self.number(0, 100)}")
        return f' {self.pick("class", "id")}="{name}"'

    def drop(self, tag: str, inner: str, of: str) -> str:
        return f"<{tag}{self.naming(of)} data-part=drop>{inner}</{tag}>"

    def keep(self, tag: str, inner: str, of: str) -> str:
        return f"<{tag}{self.naming(of)} data-part=keep>{inner}</{tag}>"

    def links(self, least: int, most: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.some(1, 4)}</a></li>' for i in range(self.number(least, most))) + "</ul>"

    def row_of_links(self, between: str) -> str:
        return between.join(f'<a href="/{i}">{self.some(1, 3)}</a>' for i in range(self.number(1, 8)))

    def menu(self) -> str:
        inner = self.pick(self.links(3, 10), self.row_of_links(" "), self.row_of_links(" | "))
        return self.drop(self.pick("nav", "nav", "div", "ul" if inner.startswith("<a") else "div"), inner, "menu")

    def head(self) -> str:
        inner = self.pick(f"<div>{self.some(1, 4)}</div>{self.links(3, 6)}", f"<h1>{self.some(1, 4)}</h1><p>{self.some(2, 9)}</p>", f"<h1>{self.some(1, 4)}</h1>", f"<a href=/>{self.some(1, 3)}</a>{self.row_of_links(' ')}")
        return self.drop(self.pick("header", "header", "div") if "href" in inner else "header", inner, "head")

    def notice(self) -> str:
        return self.drop("div", f"<p>{self.some(4, 40)}</p><button>{self.some(1, 3)}</button>", "notice")

    def advert(self) -> str:
        inner = self.says("advert")
        text = self.pick(inner, f"<p>{inner}</p>", f"<a href=/ad>{inner}</a>", self.some(3, 30))
        name = f' {self.pick("class", "id")}="{self.pick(*NAMES["advert"])}"'  # a block of any text is told by its name only
        return f"<div{name} data-part=drop>{text}</div>"

    def form(self) -> str:
        return self.pick(self.drop("form", f"<label>{self.some(1, 3)}</label><input name=q><button>{self.some(1, 2)}</button>", "form"), self.drop("div", f"<p>{self.some(2, 10)}</p><form><input><button>{self.some(1, 2)}</button></form>", "form"))

    def foot(self) -> str:
        if self.chance(0.3):
            return self.drop("footer", self.pick(self.some(2, 40), f"<p>{self.some(2, 40)}</p>", self.links(2, 5)), "foot")
        said = self.says("rights")
        inner = self.pick(said, f"<p>{said}</p>", f"{said} &middot; {self.some(2, 14)}", f"{said} &middot; {self.some(2, 50)}", f"<p>{said}</p>{self.links(2, 5)}", f"{self.links(2, 5)}<div>{said}</div>")
        return self.drop(self.pick("footer", "div", "div"), inner, "foot")

    def side(self) -> str:
        listing = f"<h3>{self.some(1, 4)}</h3>{self.links(2, 9)}"
        return self.pick(self.drop("div", listing, "side"), self.drop("aside", self.pick(listing, f"<p>{self.some(4, 60)}</p>", f"<h3>{self.some(1, 4)}</h3><p>{self.some(4, 30)}</p>"), "side"))

    def comments(self) -> str:
        """Remarks of one build, each with its writer; often under a heading that says so."""
        item, build, n = self.pick("div", "div", "article", "li"), self.number(0, 5), self.number(1, 7)
        attribute, remarks = self.naming("comment"), ""
        for _ in range(n):
            who, text = self.some(1, 3), f"<p>{self.some(3, 60)}</p>"
            inner = [f"<b>{who}</b>{text}", f"<p>{who}:</p>{text}", f"<div>{who} <time>{self.number(1, 13)}:{self.number(10, 60)}</time></div>{text}", f"<h4>{who}</h4>{text}", f"<cite>{who}</cite>{text}<a href=#>{self.some(1, 2)}</a>"][build]
            remarks += f"<{item}{attribute}>{inner}</{item}>"
        if item == "li":
            remarks = f"<ol>{remarks}</ol>"
        heading = self.pick("h2", "h3", "h4", "p")
        # Without a word that says so, a section of remarks is told by its name.
        headed = self.chance(0.8)
        text = f"<{heading}>{self.says('comments') if headed else self.some(1, 3)}</{heading}>{remarks}"
        if headed:
            return self.drop(self.pick("section", "div", "div"), text, "comments")
        return f'<section class="{self.pick(*NAMES["comments"])}" data-part=drop>{text}</section>'

    def share(self) -> str:
        return self.drop("div", " ".join(f'<a href="/s">{self.some(1, 2)}</a>' for _ in range(4)), "share")

    def several(self, makers: list, least: int, most: int) -> str:
        order = self.rng.permutation(len(makers))[: self.number(least, most)]
        return "".join(makers[int(i)]() for i in order)

    def title(self) -> str:
        title = html.escape(self.blocks[0][:60]) if self.blocks and self.chance(0.5) else self.some(1, 13)
        if self.chance(0.15):  # articles are about such things too
            title = f"{title} {self.says(self.pick('comments', 'rights', 'advert'))}"
        head = self.pick("h1", "h1", "h1", "h2")
        title = f"<{head}>{title}</{head}>"
        drawn = self.rng.random()
        if drawn < 0.2:
            return f"<header data-part=keep>{title}{self.pick('', '', f'<p>{self.some(3, 20)}</p>')}</header>"
        if drawn < 0.3:
            return f"<div data-part=keep>{title}</div>"
        return title

    def block(self, b: str) -> str:
        text, form = html.escape(b), self.rng.random()
        if form < 0.7:
            return self.pick(f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>")
        if form < 0.76:
            return f"<h2>{html.escape(' '.join(b.split()[:6]))}</h2><p>{text}</p>"
        if form < 0.84:
            return f"<ul>{''.join(f'<li>{html.escape(x)}</li>' for x in b.split('. ')[:6])}</ul>"
        if form < 0.9:
            return f"<blockquote><p>{text}</p></blockquote>"
        if form < 0.94:
            return f"<table><tr><td>{self.some(1, 4)}</td><td>{self.some(1, 4)}</td></tr></table><p>{text}</p>"
        return f"<pre>{text}</pre>" if form < 0.97 else f"<div>{text}</div>"

    def page(self) -> str:
        blocks = self.blocks
        if len(blocks) > 2 and self.chance(0.25):  # many pages are short
            blocks = blocks[: self.number(1, 5)]
        if self.chance(0.2):  # or very short
            blocks = [" ".join(b.split()[: self.number(1, 9)]) for b in blocks[:2]]
        title, body = self.title(), [self.block(b) for b in blocks]
        front, back = [self.menu, self.menu, self.head, self.notice, self.advert, self.form], [self.foot, self.foot, self.side, self.comments, self.comments, self.form, self.share, self.advert]
        before, after = self.several(front, 1, 5), self.several(back, 1, 5)
        if self.chance(0.15):  # no element around the article, and some of its blocks without one
            loose = [html.escape(b) if self.chance(0.4) and made.startswith("<p") else made for b, made in zip(blocks, body, strict=True)]
            opening = [self.some(1, 6)] if self.chance(0.6) else []
            return f"<html><body>{self.pick(before, '')}{'<hr>'.join([*opening, title, *loose])}{self.pick(after, '')}</body></html>"
        body = [b + (self.pick(self.advert(), self.share(), self.side()) if self.chance(0.05) else "") for b in body]
        inner = "".join(body)
        if len(body) > 3 and self.chance(0.15):
            tag, each, headed = self.pick("section", "div"), self.number(1, 4), self.chance(0.7)
            parts = ["".join(body[k : k + each]) for k in range(0, len(body), each)]
            inner = "".join(f"<{tag}>{f'<h2>{self.some(1, 6)}</h2>' if headed else ''}{x}</{tag}>" for x in parts)
        elif self.chance(0.15):
            inner = self.keep("div", inner, "article")
        if self.chance(0.15):
            inner += self.several([self.comments, self.share, self.form], 1, 2)
        article = self.keep(self.pick("article", "article", "main", "div", "div", "section"), title + inner, "article")
        if self.chance(0.4):
            article = self.keep(self.pick("div", "main", "div"), article + self.several(back, 0, 3), "wrap")
        return f"<html><body>{before}{article}{after}</body></html>"


def _laid_out(blocks: list[str], rng: np.random.Generator) -> str:
    return _Layout(blocks, rng).page()


def labels_of(nodes: list[Node]) -> list[bool]:
    """Whether each node is kept, by the ``data-part`` of itself or of what is nearest above it."""
    label = [True] * len(nodes)
    for k in range(1, len(nodes)):
        label[k] = label[nodes[k].parent] if nodes[k].truth is None else nodes[k].truth == "keep"
    return label


def fit_layouts(made: list[str]) -> Trees:
    """Fit on pages with ``data-part`` on their parts. Tokens learn from one half of them, the trees from the other."""
    parsed = [(*parsed, labels_of(parsed[0])) for parsed in map(parse, made)]
    said = said_by_tokens([(nodes, label) for nodes, _, label in parsed[::2]])
    rows = parsed[1::2] or parsed
    return Trees(np.concatenate([features(nodes, runs, said)[1:] for nodes, runs, _ in rows]), np.concatenate([label[1:] for _, _, label in rows]).astype(float), said)


def laid_out(sample: list[str]) -> list[str]:
    """``LAYOUTS`` pages around the blocks of each page of the sample."""
    rng, out = np.random.default_rng(11), []
    for page in sample or ["<p>text</p>"]:
        blocks = [t for _, t in parse(page)[1]]
        blocks = [b for b in blocks if len(b) > 40] or blocks
        out += [_laid_out(blocks, rng) for _ in range(LAYOUTS)]
    return out


def fit(pages: DataFrame) -> Trees:
    """Fit on layouts of the text of at most about ``FIT_PAGES`` pages."""
    rows = pages.select("page_id", "html").where(F.col("html").isNotNull())
    n = rows.count()
    if n > FIT_PAGES:
        rows = rows.where(F.pmod(F.xxhash64("page_id", F.lit(5)), F.lit(1 << 30)) < int(FIT_PAGES / n * (1 << 30)))
    sample = [r[0] for r in rows.orderBy(F.xxhash64("page_id", "html")).limit(2 * FIT_PAGES).select("html").collect()]
    return fit_layouts(laid_out(sample))


def with_main_text(pages: DataFrame, model: Trees, page: str = "html", out: str = "main_text") -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([t for i in range(0, len(s), 64) for t in main_texts(shared.value, list(s.iloc[i : i + 64]))], dtype=object)

    return bounded(pages).withColumn(out, extract(F.col(page)))


def main_text_report(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    found = with_main_text(pages.select("page_id", "url", "html"), fit(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
