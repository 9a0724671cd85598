"""Operator 7: main text of web pages by a tree-structured graphical model.

Every element of a page but inline ones is a node that is content or not. A node has an evidence term, a logistic
function of its tag, the words in its class, id and role, its text, links and place, and each edge from parent to child a
potential for the child's tag, learnt from how often labels pass on. As the graph is a tree, one pass of sum-product messages upward and one downward gives each
node's exact marginal. The trees of a batch are solved together, one NumPy step per depth.

Training. ``labelled_pages`` makes them from a bounded sample of the table (``SAMPLE`` pages, drawn by a hash of page_id): its
own pages labelled by their ``article`` element, and the same texts set into drawn layouts, whose parts are known: content in
containers of many names, menus, headers, footers, sidebars, notices, adverts, forms and reader comments around and inside it.
The fit runs on the driver, on the sample alone; it is seeded, so a rerun gives the same model. All pages are then extracted with it.

Text: the blocks of content nodes in page order, joined by line breaks. Scripts, styles, head, form controls and comments in the
markup never count; a script, style, noscript, textarea, title or iframe goes on to its end tag or the end of the page, other controls, svg and
templates without an end tag to the next block or the end of their parent. Character references are decoded; white space, also ``<br>``, becomes one space.

Defined cases: a null or empty page gives an empty text; markup that breaks off, unclosed or stray tags are read as browsers do in
the main (a block ends an open paragraph, an end tag closes what is open inside it); a page of any length is read whole;
equal rows give equal texts; an empty table gives no rows; columns of other names are not read.
"""

from __future__ import annotations

import html as _html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, ROUNDS, SEED = 80, 120, 7

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# A raw element is read to its end tag, or to the end of the page as in browsers. The text of muted ones never counts.
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.S | re.I) for t in "script style noscript textarea title iframe".split()}
MUTED = frozenset("svg select button template".split())
_NEXT = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in MUTED}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

# The tags and the name words that the evidence term knows, a weight each.
TAGS = "body article main section div p h1 h2 h3 h4 ul ol li dl table tr td blockquote pre figure figcaption nav header footer aside form fieldset address head hr dialog".split()
NAMES = [
    "content article post entry story body text main prose page", "nav navigation menu menubar breadcrumb breadcrumbs tabs pagination pager",
    "header masthead banner topbar branding logo", "footer copyright legal colophon bottom contentinfo", "sidebar side aside widget complementary rail",
    "related recommended more trending popular teaser", "cookie cookies consent gdpr notice notices alert banner popup modal overlay warning",
    "newsletter subscribe signup paywall", "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion promoted",
    "comment comments reply replies respond disqus discussion thread responses", "share social sharing follow tags meta byline toolbar", "form login search contact",
]
# Blocks that end a muted element which has no end tag of its own.
BLOCKS = frozenset(TAGS)
_NAME_OF = {w: i for i, group in reversed(list(enumerate(NAMES))) for w in group.split()}
_TAG_OF = {t: i for i, t in enumerate(TAGS)}
N_FEATURES = 1 + len(TAGS) + len(NAMES) + 7


class Page:
    """The nodes of one page, parents first, and its text blocks as (node, text)."""

    __slots__ = ("parent", "tag", "names", "depth", "own", "linked", "stops", "blocks")

    def __init__(self, html: str):
        self.parent, self.tag, self.names, self.depth, self.own, self.linked, self.stops = [-1], [-1], [()], [0], [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        stack, kinds, links, parts = [0], ["#"], 0, []
        # Where the outermost muted element is on the stack (0: none), and whether its end tag is missing. It is part of its parent's node.
        mute, unclosed, at = 0, False, 0

        def flush() -> None:
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    self.blocks.append((stack[-1], text))
                    self.own[stack[-1]] += len(text)
                    self.stops[stack[-1]] += text.count(". ") + text.count(", ") + text.endswith(".")

        def pop_to(i: int) -> None:
            nonlocal mute
            if not mute or i < mute:
                flush()
            del stack[i:], kinds[i:]
            if i <= mute:
                mute = 0

        while m := _TOKEN.match(html, at):
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                if mute or m[0].startswith("<") and len(m[0]) > 1:
                    continue
                piece = _html.unescape(m[0]) if "&" in m[0] else m[0]
                parts.append(piece)
                if links:
                    self.linked[stack[-1]] += len(piece)
                continue
            tag = tag.lower()
            if m["end"] or m["end2"]:
                if tag == "a":
                    links = max(0, links - 1)
                elif tag in INLINE or tag in VOID:
                    if tag == "br":
                        parts.append(" ")
                elif tag in kinds:
                    pop_to(len(kinds) - 1 - kinds[::-1].index(tag))
                    links = 0
                continue
            attrs = m["attrs"] or m["attrs2"] or ""
            if tag in _RAW_END:
                parts.append(" ")
                # Within svg, these may be empty.
                if not ("svg" in kinds and attrs.endswith("/")):
                    at = _RAW_END[tag].search(html, at).end()
                continue
            if mute and unclosed and tag in BLOCKS:
                pop_to(mute)
            if mute and (kinds[mute] == tag == "button"):
                pop_to(mute)
            if mute:
                if tag not in VOID and tag not in INLINE and not attrs.endswith("/"):
                    stack.append(stack[-1])
                    kinds.append(tag)
                continue
            if tag in MUTED:
                parts.append(" ")
                if tag == "svg" and attrs.endswith("/"):
                    continue
                after = _NEXT[tag].search(html, at)
                mute, unclosed = len(kinds), not (after and after[1])
                stack.append(stack[-1])
                kinds.append(tag)
                continue
            if tag in INLINE:
                links += tag == "a"
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    parts.append(" ")
                continue
            if "p" in kinds:
                inner = len(kinds) - 1 - kinds[::-1].index("p")
                if not {"table", "td"} & set(kinds[inner:]):
                    pop_to(inner)
            if tag in CLOSES:
                for i in range(len(kinds) - 1, 0, -1):
                    if kinds[i] in SCOPE.get(tag, ()):
                        break
                    if kinds[i] in CLOSES[tag]:
                        pop_to(i)
                        break
            flush()
            found = ()
            if "=" in attrs:
                found = tuple({_NAME_OF[w] for v in _NAMED.findall(attrs) for w in (x.lower() for x in _WORD.findall("".join(v))) if w in _NAME_OF})
            self.parent.append(stack[-1])
            self.tag.append(_TAG_OF.get(tag, -1))
            self.names.append(found)
            self.depth.append(len(stack))
            self.own.append(0)
            self.linked.append(0)
            self.stops.append(0)
            stack.append(len(self.parent) - 1)
            kinds.append(tag)
        flush()
        # Text in the head, as an unclosed one may hold, is no block of the page.
        head = {i for i, t in enumerate(self.tag) if t == _TAG_OF["head"]}
        self.blocks = [(n, t) for n, t in self.blocks if n not in head]


class Forest:
    """The trees of several pages as arrays: parents first, with features and depths."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.first[-1])
        base = np.repeat(self.first[:-1], sizes)
        column = lambda name: np.fromiter((x for p in pages for x in getattr(p, name)), np.int64, n)
        self.parent, self.depth = column("parent"), column("depth")
        self.parent = np.where(self.parent < 0, -1, self.parent + base)
        own, linked, stops, tag = column("own"), column("linked"), column("stops"), column("tag")
        self.levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max(initial=0)) + 1)] if n < 1 << 12 else self._by_depth()
        below, below_links = own.astype(float), np.minimum(linked, own).astype(float)
        for level in self.levels[:0:-1]:
            np.add.at(below, self.parent[level], below[level])
            np.add.at(below_links, self.parent[level], below_links[level])
        page_text = np.maximum(1.0, np.repeat(below[self.first[:-1]], sizes))
        x = np.zeros((n, N_FEATURES), np.float32)
        x[:, 0] = 1
        has = np.flatnonzero(tag >= 0)
        x[has, 1 + tag[has]] = 1
        at = 1 + len(TAGS)
        named = [(self.first[i] + j, k) for i, p in enumerate(pages) for j, f in enumerate(p.names) for k in f]
        if named:
            r, k = np.array(named).T
            x[r, at + k] = 1
        at += len(NAMES)
        x[:, at] = np.log1p(own) / 8
        x[:, at + 1] = np.log1p(below) / 10
        x[:, at + 2] = below_links / np.maximum(1, below)
        x[:, at + 3] = np.minimum(1, 20 * stops / np.maximum(20, own))
        x[:, at + 4] = below / page_text
        x[:, at + 5] = np.minimum(self.depth, 20) / 20
        x[:, at + 6] = (own == 0)
        # The child's tag picks the potential of the edge above it.
        self.x, self.kind = x, np.where(tag >= 0, tag, len(TAGS))

    def _by_depth(self) -> list[np.ndarray]:
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)


class Model:
    """Evidence weights and the parent-child potentials (log; by the child's tag, the parent's label, the child's)."""

    def __init__(self, weights: np.ndarray, edge: np.ndarray):
        self.weights, self.edge = weights, edge

    def solve(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """The chance that each node is content, and each node's joint chances with its parent (parent's label first).

        Messages upward by depth, then downward.
        """
        n = len(forest.parent)
        below = np.zeros((n, 2))
        below[:, 1] = forest.x @ self.weights
        edge, up = self.edge[forest.kind], np.zeros((n, 2))
        join = lambda a: np.logaddexp(a[..., 0], a[..., 1])
        for level in forest.levels[:0:-1]:
            up[level] = join(below[level][:, None, :] + edge[level])
            for label in (0, 1):
                below[:, label] += np.bincount(forest.parent[level], up[level, label], n)
        belief, pair = below.copy(), np.zeros((n, 2, 2))
        for level in forest.levels[1:]:
            above = belief[forest.parent[level]] - up[level]
            pair[level] = above[:, :, None] + edge[level] + below[level][:, None, :]
            belief[level] = below[level] + join((above[:, :, None] + edge[level]).transpose(0, 2, 1))
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair / pair.sum(axis=(1, 2), keepdims=True)

    def texts(self, pages: list[Page]) -> list[str]:
        forest = Forest(pages)
        chance, _ = self.solve(forest)
        return ["\n".join(t for node, t in p.blocks if chance[f + node] > 0.5) for p, f in zip(pages, forest.first)]


def fit(labelled: list[tuple[str, frozenset[str]]], rounds: int = ROUNDS) -> Model:
    """Train on (html, blocks of content). A node is content if most text of its own or below it is."""
    pages = [Page(h) for h, _ in labelled]
    forest = Forest(pages)
    good, every = np.zeros(len(forest.parent)), np.zeros(len(forest.parent))
    for (_, blocks), page, first in zip(labelled, pages, forest.first):
        for node, text in page.blocks:
            every[first + node] += len(text)
            good[first + node] += len(text) * (text in blocks)
    for level in forest.levels[:0:-1]:
        # A container with content blocks around a menu is content; so only own text and content below count against.
        np.add.at(every, forest.parent[level], every[level])
        np.add.at(good, forest.parent[level], good[level])
    y = (good > 0.5 * every).astype(np.int64)
    for level in forest.levels[1:]:
        # Nodes without text take their parent's label.
        bare = level[every[level] == 0]
        y[bare] = y[forest.parent[bare]]
    child = np.flatnonzero(forest.parent >= 0)
    kind, above, x = forest.kind[child], y[forest.parent[child]], forest.x.astype(np.float64)
    model = Model(np.zeros(x.shape[1]), np.zeros((len(TAGS) + 1, 2, 2)))
    # Gradient ascent (Adam) on the likelihood of whole trees: observed less expected counts, with a ridge penalty.
    steps = [np.zeros(x.shape[1]), np.zeros_like(model.edge)]
    squares = [np.zeros(x.shape[1]), np.zeros_like(model.edge)]
    observed = np.zeros_like(model.edge)
    np.add.at(observed, (kind, above, y[child]), 1)
    for turn in range(1, rounds + 1):
        chance, pair = model.solve(forest)
        expected = np.zeros_like(model.edge)
        np.add.at(expected, kind, pair[child])
        slopes = [x.T @ (y - chance) - 0.1 * model.weights, observed - expected - 0.1 * model.edge]
        for value, slope, m, v in zip((model.weights, model.edge), slopes, steps, squares):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            value += 0.05 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-9)
    return model


def _pick(r: random.Random, names: str) -> str:
    return r.choice(names.split())


def _layout(r: random.Random, article: list[str], other: list[str]) -> tuple[str, frozenset[str]]:
    """A page of drawn layout around ``article`` (a heading first), and its content blocks."""
    esc = _html.escape
    line = lambda: " ".join(r.choice(other).split()[: r.randint(2, 14)]) or "x"
    para = lambda: " ".join(r.choice(other).split()[: r.randint(8, 60)]) or "x"
    attr = lambda names: f' {r.choice(["class", "class", "id"])}="{_pick(r, names)}"' if r.random() < 0.85 else ""
    links = lambda: "<ul>" + "".join(f'<li><a href="#">{esc(" ".join(line().split()[:3]))}</a></li>' for _ in range(r.randint(2, 9))) + "</ul>"

    def box(names: str, body: str, tags: str = "div section") -> str:
        tag = _pick(r, tags)
        return f'<{tag} {r.choice(["class", "class", "id"])}="{_pick(r, names)}">{body}</{tag}>'

    menu = lambda: r.choice([f"<nav{attr('menu main-nav')}>{links()}</nav>", box("menu nav navbar-menu breadcrumbs", links())])
    header = lambda: r.choice([f"<header{attr('site-header top')}><p>{esc(line())}</p>{links() if r.random() < 0.5 else ''}</header>", box("header masthead site-header", f"<p>{esc(line())}</p>", "div")])
    footer = lambda: r.choice([f"<footer>{esc(line())}</footer>", f"<footer{attr('site-footer')}><p>{esc(line())}</p>{links() if r.random() < 0.4 else ''}</footer>", box("footer copyright site-footer", f"<p>&copy; {esc(line())}</p>", "div")])
    side = lambda: r.choice([f"<aside{attr('sidebar')}><h3>{esc(line())}</h3><p>{esc(para())}</p></aside>", box("sidebar side-column widget related", f"<h3>{esc(line())}</h3>{links()}<p>{esc(para())}</p>")])
    notice = lambda: r.choice([box("cookie-notice notice consent cookie-banner alert newsletter gdpr", f"<p>{esc(para())}</p>", "div section aside"), box("notice cookie-consent popup", esc(line()), "div p")])
    advert = lambda: r.choice([box("ad ads advert sponsored promo ad-slot advertisement", esc(line()), "div aside p"), box("ad advert sponsored", f"<p>{esc(para())}</p>", "div section")])
    form = lambda: f"<form{attr('search login signup')}><label>{esc(line())}</label><input name=q><p>{esc(line())}</p></form>"
    remark = lambda: r.choice([f"<p>{esc(para())}</p>", f'<div class="comment"><p>{esc(para())}</p></div>', f"<li>{esc(para())}</li>"])
    comments = lambda: box("comments comment-list reader-comments discussion responses", f"<h3>{esc(line())}</h3>" + "".join(remark() for _ in range(r.randint(1, 5))), "div section ol aside")
    extras = [menu, advert, notice, side, form, comments]
    body, content = [], []
    for i, text in enumerate(article):
        tag = r.choice(["h1", "h1", "h2"]) if i == 0 else r.choices(["p", "h2", "blockquote", "li", "div", "pre"], [30, 2, 1, 1, 1, 0.3])[0]
        close = "" if tag == "p" and r.random() < 0.2 else f"</{tag}>"
        inner = esc(text)
        body.append(f"<ul><li>{inner}</li></ul>" if tag == "li" else f"<{tag}>{inner}{close}")
        content.append(text)
        if r.random() < 0.05:
            body.append(r.choice([advert, side, notice, menu, form])())
    if r.random() < 0.2:
        body.append(comments())
    shell = r.choice(["article", "main", "section", "div", "div", "div", "td"])
    inner = "".join(body)
    named = attr("content article post story entry-content post-body article-body main-content text") if shell in ("div", "section", "td") else attr("post article")
    inner = f"<{shell}{named}>{inner}</{shell}>"
    if shell == "td":
        inner = f"<table><tr>{inner}</tr></table>"
    if r.random() < 0.4:
        inner = f"<div{attr('wrapper container page layout')}>{inner}{r.choice(extras)() if r.random() < 0.5 else ''}</div>"
    top = "".join(f() for f in (header, menu, notice, advert, form) if r.random() < 0.5)
    bottom = "".join(f() for f in (side, comments, advert, footer, notice) if r.random() < 0.5)
    return f"<html><head><title>{esc(article[0])}</title></head><body>{top}{inner}{bottom}</body></html>", frozenset(" ".join(t.split()) for t in content)


def labelled_pages(pages: DataFrame, sample: int = SAMPLE, layouts: int = 6, seed: int = SEED) -> list[tuple[str, frozenset[str]]]:
    """(html, content blocks): at most ``sample`` pages of the table, as they are and in ``layouts`` drawn layouts each.

    Empty if the table has no page with an ``article`` element; ``fit`` then has the built-in texts.
    """
    ids = [r[0] for r in pages.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    rows = pages.where(F.col("page_id").isin([i for i in ids if i is not None])).select("page_id", F.substring("html", 1, 200_000).alias("html")).orderBy("page_id").limit(sample).collect()
    r, out, stock = random.Random(seed), [], []
    for row in rows:
        page = Page(row["html"] or "")
        inside = _inside(page, "article")
        good = [t for n, t in page.blocks if inside[n]]
        rest = [t for n, t in page.blocks if not inside[n]]
        if good:
            out.append((row["html"], frozenset(good)))
            stock.append((good, rest))
    if not stock:
        words = "the report says that work went on for a year, and people in the town were glad of it. A second part was then built".split()
        stock = [([" ".join(r.choices(words, k=r.randint(4, 60))) + "." for _ in range(8)], [" ".join(r.choices(words, k=5)) for _ in range(4)]) for _ in range(40)]
    every = [t for g, o in stock for t in g[1:4] + o]
    for good, _ in stock:
        for _ in range(layouts):
            out.append(_layout(r, good[: r.randint(2, 14)], every))
    return out


def _inside(page: Page, tag: str) -> list[bool]:
    kind, inside = _TAG_OF[tag], []
    for i, p in enumerate(page.parent):
        inside.append(page.tag[i] == kind or (p >= 0 and inside[p]))
    return inside


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``; the model is trained here if none is given."""
    model = model or fit(labelled_pages(pages))

    def run(batches):
        for batch in batches:
            source = batch.column(2)
            for lo in range(0, len(source), 200):
                raw = source.slice(lo, 200).to_pylist()
                texts = model.texts([Page(h or "") for h in raw])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, 200), batch.column(1).slice(lo, 200), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
