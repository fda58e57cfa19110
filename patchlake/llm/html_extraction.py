"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded along the tree.

A page is parsed into a tree (implied ends as in HTML: a paragraph ends where a
block begins). Every element gets features of itself, its subtree, its siblings
and its ancestors: text and link density, counts, depth, place, tag, and which
kinds of words its class, id and role hold, unless it holds most of the page and
looks like an article's holder (`misnamed`). Boosted regression trees give each
element the log-odds of being content. Decoding goes over the tree at once: a
node can only be kept below kept nodes, siblings of one shape lean on each
other's odds, and the choice of the whole tree has the
largest sum of log-odds, so no ancestor and descendant contradict each other.

The trees are trained here, on pages that `training_page` draws from a seed, with
articles, menus, notices, adverts, forms, sidebars and comments in many shapes;
`PAGES` and, with text directly in the body, `BARE_PAGES` and, with content in no
named holder (paragraphs in the body, nested divisions, sections, cells of a layout
table), `PLAIN_PAGES` bound their number. No page of the corpus is needed for it.
Each tree looks at a drawn share of the features.

Text directly in the body is judged like an element: each run of it, with the
inline elements between, is put into an element of its own (`BARE`). A page that is
one such run is kept.

Defined cases: null or blank html gives an empty text; text outside of any tag
belongs to the body; unclosed and stray tags are tolerated, scripts, styles and
comments never count, even with tags inside; a tag without an end is text; repeated rows get equal texts;
nesting beyond `DEEPEST` levels is flattened.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from patchlake.llm.common import map_texts

PAGES, BARE_PAGES, PLAIN_PAGES, SEED = 500, 500, 500, 7
TREES, DEPTH, RATE, BINS, LEAST_LEAF, SHARE = 60, 5, 0.25, 32, 20, 0.3
DEEPEST = 256
FOUND = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

OPENED = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
SPECIAL = re.compile("[>\"']")
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile("[a-z]+")
RAW = frozenset("script style noscript template textarea title svg iframe object select xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: The tag of a run of text directly in the body; no tag of a page has this name.
BARE = "#text"
BLOCKS = frozenset(f"{BARE} address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
INLINE = frozenset("abbr b bdi bdo cite code em font i mark q s small span strong sub sup u".split())
TEXTUAL = frozenset(f"{BARE} p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Tags that end by the start of another: an open tag, and those that end it.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
TAGS = f"{BARE} article main section div p h1 h2 h3 ul ol li a nav header footer aside form table td blockquote pre figure span".split()
#: Kinds of words in class, id and role.
KINDS = {
    "content": "article content post entry story main body text prose page blog".split(),
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc tabs pager pagination".split(),
    "edge": "header footer masthead banner contentinfo copyright legal bottom top".split(),
    "side": "sidebar aside related widget complementary recommended trending tags".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup".split(),
    "reader": "comment comments reply replies discussion disqus respond responses".split(),
    "form": "form search login share social buttons toolbar".split(),
}


class Node:
    __slots__ = ("tag", "parent", "children", "kinds", "index")

    def __init__(self, tag: str, parent: Node | None, kinds: frozenset = frozenset()) -> None:
        self.tag, self.parent, self.kinds = tag, parent, kinds
        self.children: list = []  # nodes and strings, in page order


def kinds_of(attributes: str) -> frozenset:
    words = {w for m in NAMES.finditer(attributes) for w in WORD.findall((m[1] or m[2] or m[3] or "").lower())}
    return frozenset(k for k, own in KINDS.items() if words & set(own)) if words else frozenset()


class TagEnds:
    """Where tags end: at the next `>` outside of quotes. Asked for growing places, all answers together take time in proportion to the page.

    Two searches that meet at one place outside of quotes go on alike, so what a search
    without an end has gone through isn't gone through again.
    """

    def __init__(self, page: str) -> None:
        self.page, self.dead = page, set()  # quotes that open in a search without an end
        self.asked, self.next = -1, -1

    def special(self, at: int) -> int:
        """The first `>` or quote from `at` on; the page's length if there's none."""
        if not self.asked <= at <= self.next:
            m = SPECIAL.search(self.page, at)
            self.asked, self.next = at, m.start() if m else len(self.page)
        return self.next

    def __call__(self, at: int) -> int:
        """The place of the `>` that ends a tag whose attributes begin at `at`; -1 if nothing does."""
        page, seen, place = self.page, [], self.special(at)
        while place < len(page):
            if page[place] == ">":
                return place
            closing = -1 if place in self.dead else page.find(page[place], place + 1)
            seen.append(place)
            if closing < 0:
                break
            m = SPECIAL.search(page, closing + 1)
            place = m.start() if m else len(page)
        self.dead.update(seen)
        return -1


def tokens(page: str):
    """Texts (as such), and tags as (closing, name, attributes). Comments and declarations are left out, a `<` that begins none of these is text. Sending a name skips to that element's end."""
    ends, at, n = TagEnds(page), 0, len(page)
    unclosed = False  # no `>` is left
    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
            yield page[at:end]
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        m = OPENED.match(page, at)
        end = ends(m.end()) if m and not unclosed else -1
        if end >= 0:
            at = end + 1
            skipped = yield m[1], m[2].lower(), page[m.end() : end]
            if skipped:
                close = re.compile(rf"</{re.escape(skipped)}[\s/>]", re.I).search(page, at)
                end = page.find(">", close.end() - 1) if close else -1
                at = end + 1 if end >= 0 else n
                yield None
        else:
            if not unclosed and page[at + 1 : at + 2] in ("!", "?", "/") and not m:
                end = page.find(">", at)
                unclosed = end < 0
            if end >= 0:
                at = end + 1
            else:
                yield "<"
                at += 1


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all elements in page order. Texts keep their character references."""
    root = Node("body", None)
    nodes, here, depth = [root], root, 0
    found = tokens(page)
    for token in found:
        if isinstance(token, str):
            here.children.append(token)
            continue
        closing, tag, attributes = token
        if closing:
            up, steps = here, 0
            while up is not root and up.tag != tag:
                up, steps = up.parent, steps + 1
            if up is not root:
                here, depth = up.parent, depth - steps - 1
            elif tag in BLOCKS and tag == "p":
                here.children.append(" ")
            continue
        if tag in RAW:
            found.send(tag)
            continue
        if tag in ("html", "head", "body"):
            continue
        if tag in BLOCKS:  # ends an open paragraph, with what is open in it
            up, steps = here, 0
            while up is not root and up.tag not in BLOCKS:
                up, steps = up.parent, steps + 1
            if up.tag == "p":
                here, depth = up.parent, depth - steps - 1
        for inner, enders in ENDED_BY.items():
            if tag in enders and here.tag == inner:
                here, depth = here.parent, depth - 1
        node = Node(tag, here, kinds_of(attributes) if attributes else frozenset())
        here.children.append(node)
        nodes.append(node)
        if tag not in VOID and not attributes.endswith("/") and depth < DEEPEST:
            here, depth = node, depth + 1
    return root, with_runs(root, nodes)


def with_runs(root: Node, nodes: list[Node]) -> list[Node]:
    """All elements in page order, after each run of bare text and inline elements below the root got an element around it. A page without elements stays as it is."""
    if len(nodes) == 1 or all(isinstance(c, Node) or c.isspace() for c in root.children):
        return nodes
    below: dict[Node, list[Node]] = {}
    for x in nodes[1:]:
        if x.parent is root:
            own = below[x] = []
        own.append(x)
    children, out, run = [], [root], []

    def close() -> None:
        if any(isinstance(c, str) and not c.isspace() for c in run):
            bare = Node(BARE, root)
            bare.children = run.copy()
            children.append(bare)
            out.append(bare)
            for c in run:
                if isinstance(c, Node):
                    c.parent = bare
        else:
            children.extend(run)
        for c in run:
            out.extend(below[c] if isinstance(c, Node) else ())
        run.clear()

    for c in root.children:
        if isinstance(c, Node) and c.tag in BLOCKS:
            close()
            children.append(c)
            out.extend(below[c])
        else:
            run.append(c)
    close()
    root.children = children
    return out


OWN = 8
STOPS = ".,!?\u3002\uff0c\uff01\uff1f\u060c\u0964"
FEATURES = 3 * len(KINDS) + 2 * len(TAGS) + 18


#: An element with this share of a page's text is more than what its name says, if it looks like an article's holder.
LARGE, LEAST_PROSE = 0.5, 150


def misnamed(nodes: list[Node], up: np.ndarray, chars: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Elements whose names (or tag, of forms) say nothing: they hold most of the page's text, and in it a first heading, an article, or most of it in an element named as content, or paragraphs of their own."""
    n = len(nodes)
    marked, prose, own_p, core = np.zeros(n, bool), np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
    content = frozenset(["content"])
    for i in range(n - 1, 0, -1):
        x = nodes[i]
        marked[i] |= x.tag in ("h1", "main") or x.tag == "article" and x.kinds <= content
        marked[up[i]] |= marked[i]
        core[up[i]] = max(core[up[i]], core[i], chars[i] if x.kinds == content or x.tag == "main" else 0)
        if x.tag == "p":
            prose[up[i]] += chars[i]
            own_p[up[i]] += 1
    named = np.array([bool(x.kinds - content) or x.tag == "form" for x in nodes])
    readers = np.array(["reader" in x.kinds for x in nodes])
    holder = marked | (core >= LARGE * chars) | ((own_p > 1) & (prose >= LEAST_PROSE) & ~readers)
    out = named & (chars >= LARGE * chars[0]) & (linked < LARGE * chars) & holder
    out[0] = False
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each element."""
    n = len(nodes)
    for i, x in enumerate(nodes):
        x.index = i
    chars, linked, links, words, stops, elements, paragraphs, heads = (np.zeros(n) for _ in range(OWN))
    up = np.array([-1 if x.parent is None else x.parent.index for x in nodes])
    for i, x in enumerate(nodes):
        for c in x.children:
            if isinstance(c, str):
                chars[i] += len(c)
                words[i] += c.count(" ") + 1
                stops[i] += sum(c.count(mark) for mark in STOPS)
        elements[i] = 1
        links[i] = x.tag == "a"
        paragraphs[i] = x.tag == "p"
        heads[i] = x.tag in ("h1", "h2", "h3")
    own_chars = chars.copy()
    for i in range(n - 1, 0, -1):  # children come after their parents
        for a in (chars, words, stops, elements, links, paragraphs, heads, linked):
            if a is linked and nodes[i].tag == "a":
                linked[i] = chars[i]
            a[up[i]] += a[i]
    unnamed = misnamed(nodes, up, chars, linked)
    depth, place, siblings, alike = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    out = np.zeros((n, FEATURES))
    kinds, tags = list(KINDS), {t: k for k, t in enumerate(TAGS)}
    k, t = len(kinds), len(TAGS)
    for i, x in enumerate(nodes):
        for kind in () if unnamed[i] else x.kinds:
            out[i, kinds.index(kind)] = 1
        if x.tag in tags and not (unnamed[i] and x.tag == "form"):
            out[i, 3 * k + tags[x.tag]] = 1
        if i:
            depth[i] = depth[up[i]] + 1
            out[i, k : 2 * k] = np.maximum(out[up[i], k : 2 * k], out[up[i], :k])  # of ancestors
            out[i, 3 * k + t : 3 * k + 2 * t] = np.maximum(out[up[i], 3 * k + t : 3 * k + 2 * t], out[up[i], 3 * k : 3 * k + t])
        own = [c for c in x.children if not isinstance(c, str)]
        same = Counter(c.tag for c in own)
        for j, c in enumerate(own):
            place[c.index], siblings[c.index] = (j + 1) / len(own), len(own)
            alike[c.index] = same[c.tag] / len(own)
    for i in range(n - 1, 0, -1):  # of descendants
        out[up[i], 2 * k : 3 * k] = np.maximum(out[up[i], 2 * k : 3 * k], np.maximum(out[i, 2 * k : 3 * k], out[i, :k]))
    total, parent = max(1.0, chars[0]), np.maximum(up, 0)
    out[:, 3 * k + 2 * t :] = np.stack(
        [
            np.log1p(chars), chars / total, linked / np.maximum(1, chars), links / elements, np.log1p(words), stops / np.maximum(1, words),
            np.log1p(elements), chars / elements, paragraphs / elements, np.log1p(heads), depth, place, np.log1p(siblings), alike,
            np.log1p(own_chars), chars / np.maximum(1, chars[parent]), linked[parent] / np.maximum(1, chars[parent]), np.arange(n) / n,
        ],
        axis=1,
    )
    return out


class Boosted:
    """Logistic gradient boosting on histograms; a tree is four arrays over its complete levels."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> None:
        self.trees, self.depth, self.rate, self.fitted = trees, depth, rate, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        score, nodes = np.zeros(len(y)), (1 << self.depth) - 1
        rng, usable = np.random.default_rng(SEED), np.array([f for f, c in enumerate(self.cuts) if len(c)])
        for _ in range(self.trees):
            tried = rng.choice(usable, max(1, round(SHARE * len(usable))), replace=False)
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            which, feature, cut = np.zeros(len(y), np.int64), np.zeros(nodes, np.int64), np.full(nodes, np.inf)
            for node in range(nodes):
                rows = np.flatnonzero(which == node)
                best = (1e-6, 0, BINS)
                g, h = grad[rows].sum(), hess[rows].sum()
                for f in tried if len(rows) >= 2 * LEAST_LEAF else ():
                    b, size = binned[rows, f], len(self.cuts[f]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[rows], hess[rows], None))
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    gain[(nl < LEAST_LEAF) | (len(rows) - nl < LEAST_LEAF)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = gain[k], f, k
                feature[node] = best[1]
                cut[node] = self.cuts[best[1]][best[2]] if best[2] < BINS else np.inf
                which[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            leaf = which - nodes
            value = np.bincount(leaf, grad, nodes + 1) / (np.bincount(leaf, hess, nodes + 1) + 1) * self.rate
            self.fitted.append((feature, cut, value))
            score += value[leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, value in self.fitted:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out


def shared(nodes: list[Node], up: list[int], odds: np.ndarray) -> np.ndarray:
    """The mean log-odds of the siblings with an element's own tag and kinds of names, itself included."""
    groups: dict[tuple, int] = {}
    own = np.array([groups.setdefault((u, x.tag, x.kinds), len(groups)) for u, x in zip(up, nodes, strict=True)])
    return (np.bincount(own, odds) / np.bincount(own))[own]


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which elements are kept: the subtree at the root with the largest sum. Elements without text weigh nothing themselves."""
    up = [-1 if x.parent is None else x.parent.index for x in nodes]
    odds = (odds + shared(nodes, up, odds)) / 2
    for i, x in enumerate(nodes):  # words within a paragraph go with it
        if i and x.tag not in BLOCKS and nodes[up[i]].tag in TEXTUAL | INLINE:
            odds[i] = odds[up[i]]
        elif x.tag == BARE and len(nodes[0].children) == 1:  # all of the page
            odds[i] = abs(odds[i]) + 1
    weight = odds * np.array([any(isinstance(c, str) and not c.isspace() for c in x.children) for x in nodes])
    weight += 0.01 * np.tanh(odds)
    best = weight.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[up[i]] += best[i]
    kept = best > 0
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] &= kept[up[i]]
    return kept


def blocks_of(root: Node, kept: np.ndarray) -> list[str]:
    """The kept text by blocks: character references decoded, white space as one space."""
    out, held = [], []

    def flush() -> None:
        if held:
            block = " ".join(html.unescape("".join(held)).split())
            if block:
                out.append(block)
            held.clear()

    stack: list = [(root, iter(root.children))]
    while stack:
        node, left = stack[-1]
        child = next(left, None)
        if child is None:
            stack.pop()
            if node.tag in BLOCKS:
                flush()
        elif isinstance(child, str):
            held.append(child)
        elif child.tag in ("br", "img", "wbr"):
            held.append(" " if child.tag == "br" else "")
        else:
            if child.tag in BLOCKS:
                flush()
            if kept[child.index]:
                stack.append((child, iter(child.children)))
    flush()
    return out


def prose(rng: random.Random, least: int, most: int) -> str:
    words = ["".join(rng.choice("ba ce di fo gu la me ni ro su ta ve".split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(least, most))]
    for i in range(0, len(words), rng.randint(5, 14)):
        words[i] = words[i].capitalize()
        words[i - 1] += rng.choice(".,.,!?")
    return " ".join(words)


def training_page(seed: int, bare: bool = False, plain: bool = False) -> tuple[str, set[int]]:
    """A page and the places, in page order, of its elements that are content.

    With `bare`, the article and parts of the rest are text directly in the body;
    with `plain`, the article has no named holder of its own.
    """
    rng = random.Random(seed)
    parts: list[str] = []
    good: set[int] = set()
    count = [0]  # the root is element 0

    def put(tag: str, name: str, inner, content: bool) -> None:
        count[0] += 1
        if content:
            good.add(count[0])
        label = f' {rng.choice(("class", "id", "role"))}="{name}"' if name else ""
        parts.append(f"<{tag}{label}>")
        if callable(inner):
            inner()
        else:
            parts.append(inner)
        parts.append(f"</{tag}>")

    def name(kind: str, share: float = 0.8) -> str:
        return rng.choice(("", "site-", "x_")) + rng.choice(KINDS[kind]) + rng.choice(("", "-inner", " box")) if rng.random() < share else ""

    def links(tag: str) -> None:
        bare = rng.random() < 0.3
        for _ in range(rng.randint(2, 10)):
            put("li" if tag == "ul" else "div" if not bare else "span", "", lambda: put("a", "", prose(rng, 1, 3), False), False)

    def menu() -> None:
        put(rng.choice(("nav", "nav", "div", "ul")), name("menu"), lambda: put("ul", "", lambda: links("ul"), False) if rng.random() < 0.7 else links("div"), False)

    def edge(tag: str) -> None:
        put(tag if rng.random() < 0.8 else "div", name("edge", 0.6 if tag == "footer" else 1), lambda: (parts.append("&copy; host.example &middot; " if tag == "footer" else ""), put("p", "", prose(rng, 2, 14), False) if rng.random() < 0.5 else parts.append(prose(rng, 2, 14))), False)

    def boxed(kind: str, tags: tuple, most: int) -> None:
        def inner() -> None:
            if kind == "form" and rng.random() < 0.5:
                for _ in range(rng.randint(1, 3)):
                    put(rng.choice(("label", "span", "p")), "", prose(rng, 1, 3), False)
                    void("input", False)
                return put("button", "", prose(rng, 1, 3), False)
            if rng.random() < 0.4:
                put(rng.choice(("h2", "h3", "h4")), "", prose(rng, 1, 3), False)
            if rng.random() < 0.4:
                parts.append(prose(rng, 2, most))
            else:
                for _ in range(rng.randint(1, 4)):
                    put("p", "", prose(rng, 2, most), False)
                if rng.random() < 0.4:
                    put("ul", "", lambda: links("ul"), False)

        tag = rng.choice(tags)
        put(tag, name(kind, 0.5 if tag in ("form", "aside") else 1), inner, False)

    def reader() -> None:
        def one() -> None:
            put("div", name("reader"), lambda: (put("span", "", prose(rng, 1, 2), False), put("p", "", prose(rng, 3, 60), False)), False)

        put(rng.choice(("section", "div", "ul")), name("reader", 1), lambda: [one() for _ in range(rng.randint(1, 5))], False)

    def inside() -> None:
        for _ in range(rng.randint(0, 1)):
            rng.choice((lambda: boxed("advert", ("div", "aside"), 20), lambda: boxed("side", ("aside", "div"), 20), lambda: boxed("form", ("div",), 6)))()

    def article() -> None:
        if rng.random() < 0.85:
            put(rng.choice(("h1", "h1", "h2")), "", prose(rng, 1, 12), True)
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 12))):
            kind = rng.random()
            if kind < 0.75:
                put("p", "", (lambda: (put("b", "", prose(rng, 1, 80), True), parts.append(rng.choice(("", "<br>")))) if rng.random() < 0.15 else parts.append(prose(rng, 1, 120))), True)
                count[0] += parts[-2:].count("<br>") or parts[-1] == "<br>"
            elif kind < 0.82:
                put("ul", "", lambda: [put("li", "", prose(rng, 2, 25), True) for _ in range(rng.randint(2, 6))], True)
            elif kind < 0.88:
                put("blockquote", "", prose(rng, 5, 40), True)
            elif kind < 0.94:
                put("h2", "", prose(rng, 1, 6), True)
            else:
                put("p", "", lambda: (parts.append(prose(rng, 10, 40)), put("a", "", prose(rng, 1, 4), True), parts.append(prose(rng, 5, 20))), True)
            if rng.random() < 0.05:
                inside()

    def body() -> None:
        holder = rng.choice(("article", "article", "main", "div", "section"))
        put(holder, name("content", 0.3 if holder in ("article", "main") else 1), article, True)

    def run(inner, content: bool) -> None:
        count[0] += 1
        if content:
            good.add(count[0])
        inner()

    def bare_words(content: bool, least: int, most: int) -> None:
        def inner() -> None:
            for i in range(rng.choice((1, 1, 2, 3))):
                if i:
                    put_inline(rng.choice(("b", "i", "a", "span")), prose(rng, 1, 4), content)
                parts.append(prose(rng, least, most))
                if rng.random() < 0.4:
                    void("br", content)
                    parts.append(prose(rng, least, most))

        run(inner, content)

    def put_inline(tag: str, inner: str, content: bool) -> None:
        parts.append(" ")
        put(tag, "", inner, content)
        parts.append(" ")

    def void(tag: str, content: bool) -> None:
        count[0] += 1
        if content:
            good.add(count[0])
        parts.append(f"<{tag}>")

    def bare_article() -> None:
        if rng.random() < 0.7:
            put(rng.choice(("h1", "h2")), "", prose(rng, 1, 12), True)
        else:
            void("hr", False)
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8))):
            bare_words(True, 5, 100)
            if rng.random() < 0.6:
                put("h2", "", prose(rng, 1, 6), True)
            elif rng.random() < 0.5:
                put("p", "", prose(rng, 1, 120), True)
            elif rng.random() < 0.5:
                put("ul", "", lambda: [put("li", "", prose(rng, 2, 25), True) for _ in range(rng.randint(2, 6))], True)
            else:
                void("hr", False)

    def spoken(tag: str, least: int, most: int) -> None:
        """Text, with a link or words set apart in it now and then."""

        def inner() -> None:
            parts.append(prose(rng, least, most))
            while rng.random() < 0.25:
                put_inline(rng.choice(("a", "a", "b", "em", "code", "span")), prose(rng, 1, 4), True)
                parts.append(prose(rng, least, most))

        put(tag, "", inner, True)

    def piece() -> None:
        kind = rng.random()
        if kind < 0.62:
            spoken("p", *rng.choice(((1, 12), (8, 40), (20, 120))))
        elif kind < 0.7:
            put(rng.choice(("ul", "ol")), "", lambda: [spoken("li", 2, 25) for _ in range(rng.randint(1, 8))], True)
        elif kind < 0.76:
            put("blockquote", "", (lambda: spoken("p", 5, 40)) if rng.random() < 0.5 else prose(rng, 5, 40), True)
        elif kind < 0.84:
            put(rng.choice(("h2", "h3")), "", prose(rng, 1, 8), True)
        elif kind < 0.87:
            put("pre", "", (lambda: put("code", "", prose(rng, 2, 30), True)) if rng.random() < 0.5 else prose(rng, 2, 30), True)
        elif kind < 0.91:
            put("dl", "", lambda: [(put("dt", "", prose(rng, 1, 4), True), spoken("dd", 3, 30)) for _ in range(rng.randint(1, 5))], True)
        elif kind < 0.96:
            width = rng.randint(2, 4)
            put("table", "", lambda: [put("tr", "", lambda: [put(rng.choice(("td", "td", "th")), "", prose(rng, 1, 4), True) for _ in range(width)], True) for _ in range(rng.randint(1, 6))], True)
        else:
            put("figure", "", lambda: (void("img", True), put("figcaption", "", prose(rng, 2, 15), True)), True)

    def pieces(titled: float = 0.6) -> None:
        if rng.random() < titled:
            put(*(("header", "", lambda: put("h1", "", prose(rng, 1, 12), True)) if rng.random() < 0.1 else (rng.choice(("h1", "h1", "h2")), "", prose(rng, 1, 12))), True)
        for _ in range(rng.choice((1, 1, 2, 2, 3, 4, 6, 10))):
            piece()
            if rng.random() < 0.04:
                inside()

    def nested(levels: int) -> None:
        put("div", name("content", 0.1), (lambda: nested(levels - 1)) if levels else pieces, True)

    def plain_body() -> None:
        layout = rng.random()
        if layout < 0.35:
            pieces()
        elif layout < 0.5:
            nested(rng.randint(0, 4))
        elif layout < 0.6:
            tag = rng.choice(("section", "div"))
            for _ in range(rng.randint(2, 4)):
                put(tag, "", pieces, True)
        elif layout < 0.75:
            if rng.random() < 0.6:
                put(rng.choice(("h1", "h2")), "", prose(rng, 1, 12), True)
            for _ in range(rng.randint(1, 6)):
                spoken("div", *rng.choice(((3, 15), (8, 40), (20, 120))))
        elif layout < 0.85:
            menus = rng.random() < 0.4
            put("table", "", lambda: put("tr", "", lambda: (put("td", "", lambda: links("div"), False) if menus else None, put("td", "", pieces, True)), True), True)
        else:
            put("div", rng.choice(("", "wrap", "container", "row")), lambda: (menu() if rng.random() < 0.3 else None, nested(0) if rng.random() < 0.7 else put(rng.choice(("main", "article", "section")), "", pieces, True), boxed("side", ("aside", "div"), 30) if rng.random() < 0.6 else None), True)

    def bare_edge() -> None:
        void("hr", False)
        if rng.random() < 0.5:
            run(lambda: [(put("a", "", prose(rng, 1, 3), False), parts.append(rng.choice((" | ", " - ", " &middot; ")))) for _ in range(rng.randint(2, 10))], False)
        else:
            run(lambda: parts.append("&copy; host.example " + prose(rng, 1, 6)), False)
        void("hr", False)

    before = [menu, lambda: edge("header"), lambda: boxed("advert", ("div", "aside", "section"), 15), lambda: boxed("notice", ("div", "section"), 30), lambda: boxed("form", ("form", "div"), 8)]
    after = [lambda: edge("footer"), lambda: boxed("side", ("aside", "div"), 30), reader, lambda: boxed("form", ("form", "div"), 10), lambda: boxed("advert", ("div",), 15)]
    if bare:
        before, after = [*before, bare_edge], [*after, bare_edge]
    surround = rng.choice((0, 0.3, 0.6)) if plain else 0.6
    for part in before:
        if rng.random() < surround:
            part()
    if plain:
        plain_body()
    elif bare:
        bare_article()
    elif rng.random() < 0.3:
        put("div", name("content", 0.5), body, True)
    else:
        body()
    for part in after:
        if rng.random() < surround:
            part()
    return "".join(parts), good


@lru_cache(maxsize=1)
def model() -> Boosted:
    """Fitted on elements that hold text, or hold such elements: parent choices need odds too."""
    rows, truth = [], []
    for place in range(PAGES + BARE_PAGES + PLAIN_PAGES):
        page, good = training_page(SEED + place, PAGES <= place < PAGES + BARE_PAGES, place >= PAGES + BARE_PAGES)
        _, nodes = parse(page)
        own = features(nodes)
        rows.append(own[1:])
        truth.append(np.array([i in good for i in range(1, len(nodes))], float))
    return Boosted().fit(np.concatenate(rows), np.concatenate(truth))


def main_texts(pages: list, trees: Boosted) -> list[str]:
    """The main text of each page; the trees judge all pages of a batch at once."""
    parsed = [parse(p) for p in pages if p]
    tables = [features(nodes) for _, nodes in parsed]
    odds = trees.log_odds(np.concatenate(tables)) if tables else np.empty(0)
    out, at = [], 0
    for root, nodes in parsed:
        kept = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n\n".join(blocks_of(root, kept)))
    left = iter(out)
    return [next(left) if p else "" for p in pages]


def worker(shipped):
    trees = shipped.value

    def work(texts: list) -> list:
        found = main_texts(texts, trees)
        return [found, [len(t) for t in found]]

    return work


def extract(pages: DataFrame, page: str = "html", keep: list[str] | None = None, into: str = "found") -> DataFrame:
    """`keep` columns and a struct: text (blocks apart by blank lines), n_chars."""
    shipped = pages.sparkSession.sparkContext.broadcast(model())
    return map_texts(pages, partial(worker, shipped), FOUND, page, keep, into, 4 << 20)
