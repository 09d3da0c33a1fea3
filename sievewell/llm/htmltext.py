"""Main text of web pages: boosted trees over DOM nodes, and one decoding of each whole tree.

A page is read as a tree of its block elements. Boosted trees give each node log-probabilities
of three states: OUT (nothing of it is main text), IN (main text) and MIXED (it only holds
parts of both). The tree is then decoded as a whole: below OUT everything is OUT, IN may hold IN
and OUT, MIXED may hold any, and the states of highest total probability are chosen from
the leaves up. So no node can contradict an ancestor. The trees learn from invented pages
(`samplepages`), a third of them without any name or box around their text, and see tags, attribute tokens, depth,
text density, siblings, and whether the page has a landmark that the node is outside of.

Cases: null and empty html, and pages without main text, give an empty text; markup that is cut
off is read as far as it goes; rows with equal ids are read one by one; null ids and urls are
kept; other columns are ignored. Scripts, styles, templates and the head are never text. A head without an end tag ends
at the first thing that no head holds; another dropped element without one ends with the block that it is in, or, where
the page has no such end tag at all, at the next block. Formulas are text, their annotations are not.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewell.llm import boost
from sievewell.llm.common import small_batches, table
from sievewell.llm.samplepages import MAIN, NAMES, OTHER, Page

BLOCKS = (
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "header footer nav aside form fieldset legend label button select option textarea address details summary dialog menu center hgroup search"
).split()
DROPPED = frozenset("script style template noscript svg iframe object title canvas audio video annotation annotation-xml".split())
#: Anything else ends a head that has no end tag.
IN_HEAD = frozenset("head title meta link base script style noscript template".split())
RAW = frozenset("script style textarea title iframe noscript".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
HOLDS = frozenset("ul ol dl table select menu body".split())
_IS_BLOCK = frozenset(BLOCKS)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: The kinds of page part that an attribute token is a common name of.
_KINDS = {t: [j for j, names in enumerate(NAMES.values()) if any(t in x.split("-") for x in names)] for names in NAMES.values() for x in names for t in x.split("-")}
OUT, IN, MIXED = 0, 1, 2
_BELOW = {OUT: (OUT,), IN: (OUT, IN), MIXED: (OUT, IN, MIXED)}


class Tree:
    """The block elements of a page in page order, and its text as (node, text, in a link)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.names, self.pieces = ["html"], [-1], [()], []
        open_, depth, link, skip, at = [0], Counter(["html"]), False, None, 0
        head, body, inner, lone, last = False, False, [], False, {}
        ends = html.rfind(">") + 1  # no tag ends behind it, so none is looked for there
        if (comment := html.find("<!--", ends)) >= 0:
            html = html[:comment]

        def close(place: int) -> None:
            depth.subtract(self.tag[x] for x in open_[place:])
            del open_[place:]

        while m := _TAG.search(html, at, ends):
            if head and html[at : m.start()].strip():
                head = False
            if skip is None and not head and m.start() > at:
                self.pieces.append((open_[-1], html[at : m.start()], link))
            at = len(html) if m[0].startswith("<!--") and m.end() == ends and not m[0].endswith("-->") else m.end()
            end, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if name is None:
                continue
            name = name.lower()
            if name == "head":
                head = not end and not body
                continue
            if name not in IN_HEAD and not (end and name not in ("body", "html")):
                head = False
            if skip is not None:
                closed = attrs.endswith("/")
                if name in RAW:
                    if not end and not closed:
                        stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at, ends)
                        at = stop.end() if stop else len(html)
                    continue
                if name != skip and name not in _IS_BLOCK:
                    continue
                if end and name in inner:
                    while inner.pop() != name:
                        pass
                    continue
                if end and name == skip:
                    skip = None
                    continue
                if not (lone and name in _IS_BLOCK or end and depth[name] > 0):
                    if not end and not closed:
                        inner.append(name)
                    continue
                skip = None
            if name in RAW and not end:
                stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at, ends)
                if name == "textarea":
                    self.pieces.append((open_[-1], None, False))
                at = stop.end() if stop else len(html)
            elif name in DROPPED:
                skip = None if end or attrs.endswith("/") else name
                if skip and skip not in last:
                    last[skip] = max((x.start() for x in re.finditer(rf"</{skip}\b", html, re.I)), default=-1)
                inner, lone = [], skip is not None and last[skip] < at
            elif name == "a":
                link = not end
            elif name not in _IS_BLOCK:
                if name in ("br", "hr", "img", "input"):
                    self.pieces.append((open_[-1], " ", False))
                    if name == "hr":
                        self.pieces.append((open_[-1], None, False))
            elif end:
                if depth[name] > 0 and name != "html":
                    close(next(i for i in range(len(open_) - 1, 0, -1) if self.tag[open_[i]] == name))
                    link = False
                self.pieces.append((open_[-1], None, False))
            elif name == "html" or name == "body" and body:
                pass
            else:
                if self.tag[open_[-1]] == "p":
                    close(-1)
                closes = CLOSES.get(name, ())
                while closes and len(open_) > 1 and self.tag[open_[-1]] not in HOLDS:
                    if any(self.tag[i] in closes for i in open_[max(1, len(open_) - 4) :]):
                        closed = self.tag[open_[-1]]
                        close(-1)
                        if closed in closes and self.tag[open_[-1]] not in closes:
                            break
                    else:
                        break
                self.tag.append(name)
                self.parent.append(open_[-1])
                found = " ".join(x.strip("\"'") for x in _NAME.findall(attrs)) if attrs else ""
                self.names.append(tuple(t.lower() for t in _TOKEN.findall(found)))
                open_.append(len(self.tag) - 1)
                depth[name] += 1
                body = body or name == "body"
                link = False
                self.pieces.append((open_[-1], None, False))
        if skip is None and at < len(html):
            self.pieces.append((open_[-1], html[at:], link))

    def text(self, states: np.ndarray) -> str:
        """The text of IN nodes: white space inside a block as one space, a line for each block."""
        lines, now = [], []
        for node, piece, _ in self.pieces:
            if piece is None:
                lines.append("".join(now))
                now = []
            elif states[node] == IN:
                now.append(unescape(piece))
        lines.append("".join(now))
        return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def features(tree: Tree, vocabulary: dict[str, int]) -> np.ndarray:
    n = len(tree.tag)
    own, linked, marks, first = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -1.0)
    seen = 0.0
    for node, piece, link in tree.pieces:
        if piece:
            size = len(piece) if not piece.isspace() else 0
            own[node] += size
            linked[node] += size * link
            marks[node] += piece.count(".") + piece.count(",") + piece.count("?") + piece.count("!")
        if first[node] < 0:
            first[node] = seen
        seen += len(piece) if piece else 0
    sub, sublink, submarks, nodes, children, depth = own.copy(), linked.copy(), marks.copy(), np.ones(n), np.zeros(n), np.zeros(n)
    parent = np.array(tree.parent)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        sub[p] += sub[i]
        sublink[p] += sublink[i]
        submarks[p] += submarks[i]
        nodes[p] += nodes[i]
        children[p] += 1
    kind = {t: j for j, t in enumerate(BLOCKS)}
    place, same, counts = np.zeros(n), np.zeros(n), {}
    up = np.zeros((n, 4))  # an ancestor is: article or main; nav, aside, footer or header; form; the node or an ancestor is: nav, aside, footer or form
    some = float(any(t in ("article", "main") for t in tree.tag))
    outside = np.zeros(n)  # the page has an article or main, and the node is in none
    for i in range(1, n):
        p, t = parent[i], tree.tag[i]
        depth[i] = depth[p] + 1
        counts[p] = counts.get(p, 0) + 1
        place[i] = counts[p]
        counts[p, t] = same[i] = counts.get((p, t), 0) + 1
        up[i] = up[p]
        if (a := tree.tag[p]) in ("article", "main"):
            up[i, 0] = 1
        elif a in ("nav", "aside", "footer", "header"):
            up[i, 1] = 1
        elif a == "form":
            up[i, 2] = 1
        if t in ("nav", "aside", "footer", "form"):
            up[i, 3] = 1
        outside[i] = some * (1 - up[i, 0]) * (t not in ("article", "main"))
    p = np.maximum(parent, 0)
    total, siblings = max(sub[0], 1.0), np.maximum(children[p], 1)
    others = (sub[p] - own[p] - sub) / np.maximum(siblings - 1, 1)
    tags = np.array([kind.get(t, 0) for t in tree.tag])
    numbers = [depth, np.log1p(own), np.log1p(sub), sublink / np.maximum(sub, 1), np.log1p(nodes), np.log1p(sub / nodes), 100 * submarks / np.maximum(sub, 1), siblings, place / siblings,
               np.array([counts.get((parent[i], tree.tag[i]), 1) for i in range(n)]) / siblings, np.log1p(np.maximum(others, 0)), sub / total, first / max(seen, 1.0), sublink[p] / np.maximum(sub[p], 1),
               np.log1p(sub[p]), sub / np.maximum(sub[p], 1), children, own / np.maximum(sub, 1), outside]
    width = len(NAMES) + len(vocabulary)
    out = np.zeros((n, len(numbers) + 4 + 2 * len(BLOCKS) + 2 * width), np.float32)
    for j, x in enumerate(numbers):
        out[:, j] = x
    at = len(numbers)
    out[:, at : at + 4] = up
    at += 4
    rows = np.arange(n)
    out[rows, at + tags] = 1
    out[rows, at + len(BLOCKS) + tags[p]] = 1
    at += 2 * len(BLOCKS)
    for i, names in enumerate(tree.names):
        for t in names:
            for j in _KINDS.get(t, ()):
                out[i, at + j] = 1
            if (j := vocabulary.get(t)) is not None:
                out[i, at + len(NAMES) + j] = 1
    for i in range(1, n):  # names of the node or of any ancestor
        out[i, at + width :] = np.maximum(out[parent[i], at + width :], out[i, at : at + width])
    return out


def decoded(tree: Tree, logs: np.ndarray) -> np.ndarray:
    """The states of highest total log-probability in which none contradicts an ancestor's."""
    n = len(tree.tag)
    best = logs.astype(float).copy()
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        for s, below in _BELOW.items():
            best[p, s] += max(best[i, b] for b in below)
    states = np.zeros(n, np.int64)
    states[0] = int(best[0].argmax())
    for i in range(1, n):
        states[i] = max(_BELOW[states[tree.parent[i]]], key=lambda s: best[i, s])
    return states


def labelled(seed: int) -> tuple[str, Tree, np.ndarray]:
    """An invented page: its html, its tree, and the true states of its nodes."""
    marked = Page(seed).html()
    # the marks become attributes of the next element, where the tree keeps them as names
    pieces, inside, inset, out = re.split(f"({MAIN}(?=<|$)|(?<=>){MAIN}|{OTHER}(?=<)|(?<=>){OTHER})", marked), False, False, []
    for x in pieces:
        if x == MAIN:
            inside = not inside
            if inside:
                out.append("\x01")
        elif x == OTHER:
            inset = not inset
            if inset:
                out.append("\x02")
        else:
            out.append(x)
    text = re.sub(r"([\x01\x02])<(\w+)", lambda m: f'<{m[2]} role="{"zzmain" if m[1] == chr(1) else "zzother"}"', "".join(out))
    tree = Tree(text)
    states = np.full(len(tree.tag), OUT)
    if text.startswith('<html role="zzmain"'):
        states[0] = IN
    for i in range(1, len(tree.tag)):
        names, above = tree.names[i], states[tree.parent[i]]
        states[i] = IN if "zzmain" in names else OUT if "zzother" in names else above
    for i in range(len(states) - 1, 0, -1):
        if states[i] != OUT and states[tree.parent[i]] != IN:
            states[tree.parent[i]] = MIXED
    tree.names = [tuple(t for t in x if not t.startswith("zz")) for x in tree.names]
    return re.sub(r' role="zz\w+"', "", text), tree, states


@lru_cache(maxsize=2)
def learned(pages: int = 540, words: int = 60) -> tuple[boost.Trees, dict[str, int]]:
    """Boosted trees and attribute vocabulary, from invented pages. Made once a process; the same every time."""
    rows = [labelled(seed)[1:] for seed in range(pages)]
    counts: dict[str, int] = {}
    for tree, _ in rows:
        for t in {t for x in tree.names for t in x}:
            counts[t] = counts.get(t, 0) + 1
    common = sorted((t for t, n in counts.items() if n >= 3), key=lambda t: (-counts[t], t))[:words]
    vocabulary = {t: i for i, t in enumerate(common)}
    x = np.concatenate([features(tree, vocabulary) for tree, _ in rows])
    return boost.train(x, np.concatenate([s for _, s in rows]), 3), vocabulary


def main_text(html: str | None, trees: boost.Trees, vocabulary: dict[str, int]) -> str:
    if not html:
        return ""
    tree = Tree(html)
    return tree.text(decoded(tree, trees.scores(features(tree, vocabulary))))


def extracted(html: Column) -> Column:
    """The main text of each whole page."""
    small_batches()
    trees, vocabulary = learned()

    @F.arrow_udf("string")
    def judge(pages: pa.Array) -> pa.Array:
        out, waiting, size = [], [], 0

        def flush() -> None:
            nonlocal waiting
            real = [t for t in waiting if t is not None]
            x = [features(t, vocabulary) for t in real]
            logs = iter(np.split(trees.scores(np.concatenate(x)), np.cumsum([len(a) for a in x])[:-1]) if x else ())
            out.extend("" if t is None else t.text(decoded(t, next(logs))) for t in waiting)
            waiting = []

        for html in pages:  # a few pages at a time share one pass over the trees
            html = html.as_py()
            waiting.append(Tree(html) if html else None)
            size += len(html or "")
            if len(waiting) >= 64 or size > 4 << 20:
                flush()
                size = 0
        flush()
        return pa.array(out, pa.string())

    return judge(html)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of `pages`."""
    got = pages.select("page_id", "url", extracted(F.col("html")).alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
