"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded over the tree.

parse() builds the block-level tree of a page (implied end tags and unclosed elements included) and the text runs
between block boundaries. Every node gets features: subtree text, link and sentence density, tag and attribute
tokens of itself and its ancestors, depth and sibling statistics. Boosted trees estimate the share of a node's
text that belongs to the article. Decoding cuts the tree into subtrees that are wholly article or wholly not, with
the best total likelihood by dynamic programming: below a cut no descendant can contradict its ancestor.

The trees are trained on labelled pages from a seeded generator (pages(), a documented parameter): menus, notices,
adverts, side bars, forms, comments and footers around and inside articles, in many mark-ups, broken ones included; a
fifth of their attribute tokens are made up (UNLISTED).

Text rules: character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined in page order by one newline. <br> is white space. Scripts, styles, the head and form controls never count.
Defined cases: a null or empty page, or one without article text, gives the empty string; plain text without
mark-up is one block; repeated rows give repeated results; null ids and urls stay null; other input columns are
dropped; an empty table gives no rows. No part of a page is skipped for its length.
"""

from __future__ import annotations

import bisect
import html
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.common import built

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|[^>]*(?:>|\Z))|[!?/][^>]*(?:>|\Z))", re.S)
ATTRIBUTES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style textarea title noscript template iframe svg select button xmp object canvas audio video".split())
#: Skipped elements whose content is no mark-up: without an end tag they reach to the page's end.
RAW_TEXT = frozenset("script style textarea title iframe xmp noframes".split())
#: Start tags that leave a head open.
HEAD = frozenset("html head title meta link base basefont bgsound noframes script style noscript template".split())
#: Start tags that never stand in a button or select.
SECTIONS = frozenset("article main section nav header footer aside".split())
BLOCKS = "html body div p section article main nav header footer aside form ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption address fieldset details summary h1 h2 h3 h4 h5 h6 center hr dialog menu legend caption hgroup search".split()
CODE = {t: i for i, t in enumerate(BLOCKS)}
CLOSES_P = frozenset(BLOCKS) - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "legend", "summary"}
#: What an opening tag closes, and the elements that keep it from reaching further.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
#: Groups of attribute tokens, one feature each.
GROUPS = (
    "article content contents main post entry story body text articlebody prose mainentity",
    "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager topbar",
    "header masthead banner top logo",
    "footer bottom copyright colophon legal",
    "sidebar side aside rail related recommended recent popular widget widgets more tags tagcloud",
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion dfp adsense",
    "cookie cookies consent notice gdpr alert popup modal overlay privacy",
    "comment comments reply replies discussion disqus respond thread commentlist feedback reviews",
    "form search subscribe newsletter login signup register contact",
    "share social sharing follow twitter facebook",
)
GROUP_OF = {w: 1 << g for g, words in enumerate(GROUPS) for w in words.split()}
#: Landmark tags count like tokens, after the groups.
LANDMARKS = {t: 1 << (len(GROUPS) + i) for i, t in enumerate(("article", "main", "nav", "header", "footer", "aside", "form", "table", "ul", "ol"))}
#: The share of the generator's attribute tokens that are made up, for they are in no group on many real pages.
UNLISTED = 0.2
N_BITS = len(GROUPS) + len(LANDMARKS)
CONTENT_MARK, OTHER_MARK = chr(0xE000), chr(0xE001)


@dataclass
class Nodes:
    """The block nodes of several pages in page order; runs: (node, text)."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    tags: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


@lru_cache(maxsize=1 << 14)
def _bits(tag: str, attributes: str) -> int:
    """Bit mask of the token groups and landmark tags; lists of links are told by ul and ol."""
    found = LANDMARKS.get(tag, 0)
    for m in ATTRIBUTES.finditer(attributes):
        for w in TOKEN.findall((m[1] or m[2] or m[3] or "").lower()):
            found |= GROUP_OF.get(w, 0)
    return found


def _closed(tail: str) -> bool:
    """Whether a start tag ends with a slash."""
    return tail.rstrip(">").endswith("/")


def _raw_end(text: str, at: int, name: str) -> int:
    close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(text, at)
    return close.end() if close else len(text)


def _skip(text: str, at: int, name: str, around: dict[str, list[int]], last: dict[str, int]) -> int:
    """Where a skipped element ends whose start tag ends here: behind its own end tag, or before the end tag (also an
    implied one) of a block around it, or before a tag that can't stand in it. Without any end tag of its own on the
    rest of the page the first block ends it. around has the open elements; last keeps the place of each name's
    last end tag on the page."""
    if name not in last:
        last[name] = max((m.start() for m in re.finditer(rf"</{re.escape(name)}\b", text, re.I)), default=-1)
    foreign = frozenset(BLOCKS) if last[name] < at else SECTIONS if name in ("button", "select") else frozenset(("body",))
    inner: list[str] = []
    count: dict[str, int] = {}
    while m := TAG.search(text, at):
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if count.get(tag):
                while (x := inner.pop()) != tag:
                    count[x] -= 1
                count[tag] -= 1
            elif tag == name:
                return at
            elif tag in ("head", "body", "html") or tag in CODE and around.get(tag):
                return m.start()
            continue
        if tag in foreign or tag == name and name in ("button", "select"):
            return m.start()
        if tag in IMPLIED:
            closed, bounds = IMPLIED[tag]
            if any(around.get(x) for x in closed) and not any(count.get(x) for x in closed | bounds):
                return m.start()
        if _closed(m[3]) or tag in VOID:
            continue
        if tag in RAW_TEXT:
            at = _raw_end(text, at, tag)
        else:
            inner.append(tag)
            count[tag] = count.get(tag, 0) + 1
    return len(text)


def _head_end(text: str, at: int, last: dict[str, int]) -> int:
    """Where the head ends whose start tag ends here: behind its end tag or before what can't stand in it."""
    while True:
        m = TAG.search(text, at)
        stop = m.start() if m else len(text)
        if text[at:stop].strip() or not m:
            return at if text[at:stop].strip() else stop
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "head":
                return at
            if name in ("body", "html", "br"):
                return stop
        elif name not in HEAD:
            return stop
        elif name in RAW_TEXT and not _closed(m[3]):
            at = _raw_end(text, at, name)
        elif name in ("noscript", "template") and not _closed(m[3]):
            at = _skip(text, at, name, {}, last)


def parse(text: str, page: int, nodes: Nodes) -> None:
    """Appends the page's nodes and runs. The root is a body node of its own."""
    parent, end, tags, chars, links = nodes.parent, nodes.end, nodes.tags, nodes.chars, nodes.links

    def add(tag: str, up: int, bits: int) -> int:
        i = len(parent)
        nodes.page.append(page)
        parent.append(up)
        end.append(0)
        nodes.depth.append(nodes.depth[up] + 1 if up >= 0 else 0)
        nodes.tag.append(CODE[tag])
        nodes.own.append(bits)
        nodes.above.append(nodes.above[up] | nodes.own[up] if up >= 0 else 0)
        chars.append(0)
        links.append(0)
        tags.append(0)
        return i

    root = add("body", -1, 0)
    stack: list[tuple[str, int]] = [("#", root)]  # open elements, each with its innermost block node
    places: dict[str, list[int]] = {"": []}  # where on the stack each name is open; all block elements under ""
    parts: list[str] = []
    linked = 0

    def flush(node: int) -> None:
        nonlocal linked
        if parts:
            run = " ".join("".join(parts).split())
            parts.clear()
            if run:
                nodes.runs.append((node, run))
                chars[node] += len(run)
                links[node] += min(linked, len(run))
        linked = 0

    def pop_to(k: int) -> None:
        """Closes the open elements from the k-th on."""
        while len(stack) > k:
            name, node = stack.pop()
            if name != "#gone":
                places[name].pop()
                if name in CODE:
                    places[""].pop()
            if node != stack[-1][1]:
                flush(node)
                end[node] = len(parent)

    at, size = 0, len(text)
    last: dict[str, int] = {}
    search = TAG.search
    while at < size:
        m = search(text, at)
        stop = m.start() if m else size
        if stop > at:
            piece = text[at:stop]
            parts.append(html.unescape(piece) if "&" in piece else piece)  # a reference ends with its piece of text
            if places.get("a"):
                linked += stop - at
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        node = stack[-1][1]
        tags[node] += 1
        if m[1]:
            if open_at := places.get(name):
                k = open_at[-1]
                # an inline end tag does not close blocks opened inside the element
                if name in CODE or not places[""] or places[""][-1] < k:
                    pop_to(k)
                else:
                    open_at.pop()
                    stack[k] = ("#gone", stack[k][1])
            elif name == "p" or name in CODE:
                flush(node)
            continue
        if name in SKIPPED:
            if name == "head":
                at = _head_end(text, at, last)
            elif not _closed(m[3]):
                at = _raw_end(text, at, name) if name in RAW_TEXT else _skip(text, at, name, places, last)
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush(node)
            elif name == "br":
                parts.append(" ")
            continue
        if name not in CODE:
            if not _closed(m[3]):
                places.setdefault(name, []).append(len(stack))
                stack.append((name, node))
            continue
        if name in ("html", "body"):
            nodes.own[root] |= _bits(name, m[3])
            continue
        if name in CLOSES_P and places.get("p"):
            pop_to(places["p"][-1])
        if name in IMPLIED:
            closed, bounds = IMPLIED[name]
            bound = max((places[x][-1] for x in bounds if places.get(x)), default=0)
            # the outermost of what it closes within the bound
            inside = [at_[i] for x in closed if (at_ := places.get(x)) and (i := bisect.bisect_right(at_, bound)) < len(at_)]
            if inside:
                pop_to(min(inside))
        node = stack[-1][1]
        flush(node)
        places.setdefault(name, []).append(len(stack))
        places[""].append(len(stack))
        stack.append((name, add(name, node, _bits(name, m[3]))))
    pop_to(1)
    flush(root)
    end[root] = len(parent)


SENTENCE_END = re.compile(r"[.!?…][\"'”’)]*(?:\s|$)")


def features(n: Nodes) -> np.ndarray:
    """One row a node, from the columns of all pages at once; subtree sums come from prefix sums in page order."""
    size = len(n.parent)
    parent, end, depth = np.array(n.parent), np.array(n.end), np.array(n.depth)
    me = np.arange(size)
    sums = np.zeros((6, size + 1))
    raw = np.zeros((6, size))
    raw[0], raw[1], raw[2] = n.chars, n.links, n.tags
    for node, run in n.runs:
        raw[3, node] += 1
        raw[4, node] += run.count(" ") + 1
        raw[5, node] += len(SENTENCE_END.findall(run))
    sums[:, 1:] = np.cumsum(raw, 1)
    chars, links, tags, runs, words, ends = sums[:, end] - sums[:, me]
    up = np.maximum(parent, 0)
    root = parent < 0
    page = np.array(n.page)
    first = np.flatnonzero(root)
    home = first[np.cumsum(root) - 1]  # the page's root
    tag = np.array(n.tag)
    siblings = np.bincount(up[~root], minlength=size)
    # position among the siblings, and siblings of the same tag
    order = np.lexsort((me, up, page))
    index = np.zeros(size)
    groups = np.flatnonzero(np.append(True, np.diff(np.where(root, -1 - page, up)[order]) != 0))
    index[order] = np.arange(size) - np.repeat(groups, np.diff(np.append(groups, size)))
    alike_key = up * len(BLOCKS) + tag
    _, inverse, counts = np.unique(alike_key, return_inverse=True, return_counts=True)
    paragraphs = np.concatenate([[0], np.cumsum(tag == CODE["p"])])
    per = lambda a, b: a / np.maximum(b, 1)
    columns = [
        np.log1p(chars), per(links, chars), per(tags, chars) * 100, per(words, runs), per(ends, words) * 20, np.log1p(runs), per(chars, words),
        per(chars, chars[home]), per(chars, chars[up]), np.log1p(raw[0]), paragraphs[end] - paragraphs[me],
        depth, siblings[up], index, per(index, siblings[up]), counts[inverse], per(counts[inverse], siblings[up]), siblings, end - me,
        per(me - home, end[home] - home), per(sums[0, me] - sums[0, home], chars[home]), per(links, chars)[up], per(ends, words)[up] * 20,
    ]
    own, above = np.array(n.own), np.array(n.above)
    bits = np.arange(N_BITS)
    kinds = [tag == CODE[t] for t in ("p", "li", "div", "section", "td", "blockquote", "pre", "figure")]
    headings = [np.isin(tag, [CODE[f"h{k}"] for k in range(1, 7)])]
    return np.column_stack([*columns, (own[:, None] >> bits) & 1, (above[:, None] >> bits) & 1, *kinds, *headings]).astype(np.float32)


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays."""

    depth: int
    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += v[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 24, ridge: float = 1.0, share: float = 0.3) -> Trees:
    """Second-order boosting of the log loss with soft labels; splits at quantiles of each feature, found on a random
    share of the rows, another one for each tree."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    mean = float(np.average(y, weights=weight))
    z = np.full(len(x), np.log(mean / (1 - mean)))
    prior, inner = float(z[0]), 2**depth - 1
    trees = []
    flat = binned + np.arange(x.shape[1]) * bins
    drawn = np.random.default_rng(1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (y - p), weight * p * (1 - p)
        used = drawn.random(len(x)) < share
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        at = np.zeros(len(x), np.int64)
        for k in range(inner):
            here = np.flatnonzero(at == k)
            some = here[used[here]]
            if len(some) >= 20:
                cells = flat[some].ravel()
                gs, hs = (np.bincount(cells, np.repeat(v[some], x.shape[1]), x.shape[1] * bins).reshape(-1, bins).cumsum(1) for v in (g, h))
                all_g, all_h = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + ridge) + (all_g - gs) ** 2 / (all_h - hs + ridge) - all_g**2 / (all_h + ridge)
                for j, c in enumerate(cuts):
                    gain[j, len(c) :] = -1
                j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, b] > 1e-6:
                    f[k], t[k] = j, cuts[j][b]
            at[here] = 2 * k + 1 + (x[here, f[k]] > t[k])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        z += value[leaf]
        trees.append((f, t, value))
    f, t, v = (np.array(a) for a in zip(*trees, strict=True))
    return Trees(depth, prior, f, t, v)


def decode(n: Nodes, p: np.ndarray) -> list[bool]:
    """For each node, whether its own text is article text. Each subtree is all article, all other, or split into
    the node's own text and its children, whichever is likeliest. A subtree's likelihood is that of its runs, each
    judged half by its own node and half by the subtree's; runs count by the logarithm of their length, so that a
    menu weighs something beside a long article. A page's root is split unless it is all there is."""
    size = len(n.parent)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = np.log(p), np.log(1 - p)
    own = np.zeros(size)
    for node, run in n.runs:
        own[node] += np.log1p(len(run))
    end, me = np.array(n.end), np.arange(size)
    below = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[end] - c[me]
    weight = below(own)
    as_yes, as_no = yes * weight + below(own * yes), no * weight + below(own * no)
    whole_yes = as_yes >= as_no
    whole = (np.maximum(as_yes, as_no) / 2).tolist()
    split = (np.maximum(yes, no) * own).tolist()
    parent, side, whole_side = n.parent, (yes >= no).tolist(), whole_yes.tolist()
    cut = [False] * size
    for i in range(size - 1, -1, -1):
        if parent[i] < 0:
            if n.end[i] == i + 1:
                cut[i] = whole_side[i] = True  # text without elements
            continue
        best = split[i]
        if whole[i] >= best:
            best, cut[i] = whole[i], True
        split[parent[i]] += best
    fixed: list[bool | None] = [None] * size
    out = [False] * size
    for i in range(size):
        above = fixed[parent[i]] if parent[i] >= 0 else None
        fixed[i] = above if above is not None else whole_side[i] if cut[i] else None
        out[i] = side[i] if fixed[i] is None else fixed[i]
    return out


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    n = Nodes()
    for k, text in enumerate(pages):
        parse(text or "", k, n)
    keep = decode(n, trees.predict(features(n)))
    out: list[list[str]] = [[] for _ in pages]
    for node, run in n.runs:
        if keep[node]:
            out[n.page[node]].append(run)
    return ["\n".join(x) for x in out]


class Generator:
    """Labelled training pages: article text carries one mark, all other text another."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.style = 0.0  # of the page's words: plain, capitals, or with symbols
        self.pool = ["".join(self.r.choices("aeioubcdfghlmnprst", k=self.r.randint(2, 9))) for _ in range(20_000)]

    def words(self, low: int, high: int) -> list[str]:
        return self.r.choices(self.pool, k=self.r.randint(low, high))

    def text(self, mark: str, low: int = 8, high: int = 60) -> str:
        out = self.words(low, high)
        if self.style > 0.9:
            out = [w.upper() + "!!" for w in out]
        elif self.style > 0.8:
            out = [w + self.r.choice(("$$$", "***", "###")) for w in out]
        elif self.style > 0.75:
            out = [w for w in out for _ in range(4)]
        k = 0
        while k < len(out):
            out[k] = out[k].capitalize()
            k += self.r.randint(3, 16)
            if k <= len(out):
                out[k - 1] += self.r.choice("....,!?")
        if self.r.random() < 0.2:
            out[self.r.randrange(len(out))] += "&amp;"
        return mark + " ".join(out) + self.r.choice((".", ".", ".", ""))

    def attributes(self, *groups: int, none: float = 0.25) -> str:
        if self.r.random() < none:
            return ""
        token = self.r.choice(GROUPS[self.r.choice(groups)].split())
        if self.r.random() < UNLISTED:
            token = self.r.choice(self.pool)
        shape = self.r.choice(("{}", "{}", "site-{}", "{}-box", "page_{}", "{} wide"))
        return f' {self.r.choice(("class", "class", "id"))}="{shape.format(token)}"'

    def links(self, low: int = 2, high: int = 10) -> str:
        r = self.r
        items = [f'<a href="/{k}">{OTHER_MARK}{" ".join(self.words(1, 3))}</a>' for k in range(r.randint(low, high))]
        if r.random() < 0.75:
            kind = r.choice(("ul", "ul", "ol"))
            return f"<{kind}>" + "".join(f"<li>{x}" + "</li>" * (r.random() < 0.9) for x in items) + f"</{kind}>"
        return r.choice((" | ", " ", " &middot; ")).join(items)

    def other(self, kind: str) -> str:
        r = self.r
        short = lambda: self.text(OTHER_MARK, 2, 25)
        if kind == "nav":
            tag, a = r.choice((("nav", ""), ("nav", self.attributes(1)), ("div", self.attributes(1, none=0)), ("ul", self.attributes(1, none=0))))
            return f"<{tag}{a}>{self.links(3, 14)}</{tag}>"
        if kind == "header":
            return r.choice((f"<header{self.attributes(2)}>", f"<div{self.attributes(2, none=0)}>")) + r.choice((f"<a href='/'>{short()}</a>", f"<a href='/'>{short()}</a>", f"<h1>{short()}</h1>", f"<h2><a href='/'>{short()}</a></h2>")) + (f"<p>{short()}</p>" if r.random() < 0.5 else "") + (self.links(2, 6) if r.random() < 0.4 else "")
        if kind == "footer":
            return f"&copy; {short()}" + (f"<p>{short()}</p>" if r.random() < 0.4 else "") + (self.links(2, 6) if r.random() < 0.5 else "")
        if kind == "aside":
            return f"<h3>{short()}</h3>" * (r.random() < 0.6) + r.choice((self.links(), f"<p>{short()}</p>", self.links() + f"<p>{self.text(OTHER_MARK)}</p>"))
        if kind == "ad":
            return r.choice((short(), self.text(OTHER_MARK), f"<p>{short()}</p>", f'<a href="http://x">{short()}</a>', f"<b>{short()}</b> <a href='#'>{short()}</a>"))
        if kind == "notice":
            return f"<p>{self.text(OTHER_MARK, 5, 30)}</p><button>OK</button>" if r.random() < 0.5 else f"{self.text(OTHER_MARK, 5, 30)} <a href='#'>{short()}</a>"
        if kind == "form":
            return f"<label>{short()}</label><input name=q>" + f"<p>{short()}</p>" * (r.random() < 0.5) + f"<button>{short()}</button>"
        if kind == "share":
            return self.links(2, 5)
        one = lambda: r.choice((f"<p>{self.text(OTHER_MARK)}</p>", self.text(OTHER_MARK), f"<b>{short()}</b><p>{self.text(OTHER_MARK, 4, 40)}</p><p>{self.text(OTHER_MARK, 4, 40)}</p>"))
        tag = r.choice(("div", "li", "article", "section"))
        body = "".join(f"<{tag}{self.attributes(7, none=0.4)}>{one()}</{tag}>" for _ in range(r.randint(1, 7)))
        return f"<h3>{short()}</h3>" * (r.random() < 0.6) + (f"<ol>{body}</ol>" if tag == "li" else body)

    def boxed(self, kind: str) -> str:
        r = self.r
        group = {"nav": 1, "header": 2, "footer": 3, "aside": 4, "ad": 5, "notice": 6, "form": 8, "share": 9, "comments": 7}[kind]
        inner = self.other(kind)
        if kind == "nav":
            return inner
        tag = {"header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        if kind == "header":
            return inner + ("</header>" if inner.startswith("<header") else "</div>")
        if tag and r.random() < 0.6:
            return f"<{tag}{self.attributes(group, none=0.6)}>{inner}</{tag}>"
        tag = r.choice(("div", "div", "section", "aside" if kind in ("ad", "aside", "share") else "div"))
        return f"<{tag}{self.attributes(group, none=0.03)}>{inner}</{tag}>"

    def article(self) -> str:
        r, mark = self.r, CONTENT_MARK
        out = [f"<h1>{self.text(mark, 2, 12)}</h1>"] if r.random() < 0.85 else []
        if r.random() < 0.15:
            out = ["<header>", *out, f"<p>{self.text(mark, 3, 12)}</p></header>"]
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14, 25))):
            pick = r.random()
            short = r.random() < 0.25
            body = self.text(mark, 1, 6) if short else self.text(mark, 8, 90)
            if r.random() < 0.2:
                body = body.replace(" ", ' <a href="/x">', 1).replace(" ", "</a> ", 2).replace("</a> ", " ", 1) if body.count(" ") > 4 else body
            if pick < 0.7:
                out.append(f"<p>{body}" + "</p>" * (r.random() < 0.85))
            elif pick < 0.75:
                out.append(f"<p><b>{body}<br>")
            elif pick < 0.82:
                out.append(f"<h2>{self.text(mark, 1, 8)}</h2>")
            elif pick < 0.88:
                out.append("<ul>" + "".join(f"<li>{self.text(mark, 2, 25)}</li>" for _ in range(r.randint(2, 7))) + "</ul>")
            elif pick < 0.91:
                out.append(f"<blockquote>{r.choice(('', '<p>'))}{body}</blockquote>")
            elif pick < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.text(mark, 1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif pick < 0.96:
                out.append(f"<figure><img src=x><figcaption>{self.text(mark, 3, 15)}</figcaption></figure>")
            elif pick < 0.98:
                out.append(f"<pre>{body}</pre>")
            else:
                out.append(f"<div>{body}</div>")
            for kind, share in (("ad", 0.04), ("share", 0.02), ("aside", 0.02), ("form", 0.015)):
                if r.random() < share:
                    out.append(self.boxed(kind))
        if r.random() < 0.15:
            out.append(self.boxed("share"))
        if r.random() < 0.2:
            out.append(self.boxed("comments"))
        inner = "".join(out)
        shape = r.random()
        if shape < 0.5:
            return f"<article{self.attributes(0, none=0.6)}>{inner}</article>"
        if shape < 0.65:
            return f"<main{self.attributes(0, none=0.6)}>{inner}</main>"
        if shape < 0.95:
            tag = r.choice(("div", "div", "section"))
            return f"<{tag}{self.attributes(0, none=0.15)}>{inner}</{tag}>"
        return inner

    def page(self) -> str:
        r = self.r
        before = [k for k, share in (("notice", 0.25), ("header", 0.5), ("nav", 0.8), ("ad", 0.5), ("form", 0.15), ("aside", 0.15)) if r.random() < share]
        after = [k for k, share in (("share", 0.15), ("comments", 0.35), ("aside", 0.35), ("ad", 0.3), ("form", 0.15), ("nav", 0.1), ("notice", 0.1), ("footer", 0.85)) if r.random() < share]
        if r.random() < 0.4:
            r.shuffle(before)
        wrap = r.random() < 0.35
        self.style = r.random()
        middle = self.article()
        body = "".join(map(self.boxed, before)) + (f"<div{self.attributes(0, 4, none=0.5)}>" if wrap and r.random() < 0.3 else "<div>" if wrap else "") + middle + "</div>" * wrap + "".join(map(self.boxed, after))
        return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}" + "</body></html>" * (r.random() < 0.8)


def labelled(count: int, seed: int) -> tuple[Nodes, np.ndarray, np.ndarray]:
    """Nodes of generated pages, the article's share of each node's text, and the nodes that have text."""
    g, n = Generator(seed), Nodes()
    for k in range(count):
        parse(g.page(), k, n)
    good, size = np.zeros(len(n.parent) + 1), np.zeros(len(n.parent) + 1)
    for node, run in n.runs:
        size[node + 1] += len(run)
        good[node + 1] += len(run) * (CONTENT_MARK in run)
    n.runs = [(i, x.replace(CONTENT_MARK, "").replace(OTHER_MARK, "")) for i, x in n.runs]
    good, size = np.cumsum(good), np.cumsum(size)
    end, me = np.array(n.end), np.arange(len(n.parent))
    total = size[end] - size[me]
    return n, (good[end] - good[me]) / np.maximum(total, 1), total > 0


@lru_cache(maxsize=2)
def trained(pages: int = 2000, seed: int = 7) -> Trees:
    """The model, fitted on the driver once a session; the same pages and seed give the same trees."""
    n, share, used = labelled(pages, seed)
    x = features(n)
    return boost(x[used], share[used], np.ones(int(used.sum())))


def main_text(pages: DataFrame, trees: Trees | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: the id, the url, text and n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(trees or trained())

    def run(batches):
        model = built(sent, lambda value: value)
        for b in batches:
            texts: list[str] = []
            for at in range(0, b.num_rows, 64):
                texts += extract(b.column(2).slice(at, 64).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]
    return pages.select(id_col, url_col, pages[html_col].cast("string")).mapInArrow(run, f"{', '.join(kinds)}, text string, n_chars long")
