"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element that stands as a block and every run of text is a node with two states, content or not. Unary potentials
come from tag, class and id words, text length and share of link text; pairwise potentials tie a node to its parent.
Messages go from the leaves up and from the root down (sum-product), which gives exact marginals on a tree. Weights are
trained by gradient ascent on the exact likelihood of labelled pages; all pages of a batch are passed level by level.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelore.llm.common import slices

# Fixed values of HTML: elements without content, elements with raw text, and elements that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
                   "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul").split())
# An open element of the first kind ends where an element of the second kind begins, unless one of the third is between.
CLOSES = {"p": (frozenset(BLOCK - {"body", "html", "head", "button", "option", "optgroup", "title"}), frozenset({"button", "table", "td", "th"})),
          "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
          "tr": (frozenset({"tr", "tbody", "tfoot", "thead"}), frozenset({"table"})), "td": (frozenset({"td", "th", "tr", "tbody", "tfoot", "thead"}), frozenset({"table"})),
          "th": (frozenset({"td", "th", "tr", "tbody", "tfoot", "thead"}), frozenset({"table"})), "option": (frozenset({"option", "optgroup"}), frozenset({"select"})),
          "head": (frozenset({"body"}), frozenset())}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BITS = 12


class Page:
    """The nodes of one page in document order: parent, tag, words of class, id and role, and the text of runs.

    ``training``: whether ``data-label`` is the mark of ``labelled``; in any other page it is an ordinary attribute.
    """

    __slots__ = ("parent", "tag", "names", "text", "linked", "label")

    def __init__(self, source: str, training: bool = False):
        self.parent, self.tag, self.names, self.text, self.linked, self.label = [-1], ["#root"], [()], [None], [0], [None]
        stack = [(0, "#root", None)]  # node of the nearest block, tag, label
        run, links, anchors = [], 0, 0
        at, n = 0, len(source)

        def flush() -> None:
            nonlocal links
            if run:
                text = " ".join(entities.unescape("".join(run)).split())
                if text:
                    self.add(stack[-1][0], "#text", (), text, links, stack[-1][2])
                run.clear()
            links = 0

        while at < n:
            m = TOKEN.search(source, at)
            begin = m.start() if m else n
            if begin > at:
                piece = source[at:begin]
                run.append(piece)
                if anchors:
                    links += len(piece)
            if not m:
                break
            at = m.end()
            name = m[2]
            if not name:
                if m[0].startswith("<![CDATA["):
                    run.append(m[0][9:].removesuffix("]]>"))
                continue
            name = name.lower()
            if m[1]:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][1] == name), 0)
                if name in BLOCK:
                    flush()
                if depth:
                    if any(tag in BLOCK for _, tag, _ in stack[depth:]):
                        if name in BLOCK:
                            del stack[depth:]
                        else:  # an inline end tag ends that element only
                            del stack[depth]
                    else:
                        del stack[depth:]
                if name == "a":
                    anchors = max(0, anchors - 1)
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}[^>]*>?", re.I).search(source, at) if not m[3].rstrip().endswith("/") else None
                if name in BLOCK:
                    flush()
                at = end.end() if end else n if not m[3].rstrip().endswith("/") else at
                continue
            if name in ("br", "wbr"):
                if name == "br":
                    run.append(" ")
                continue
            if name in BLOCK:
                flush()
                for i in range(len(stack) - 1, 0, -1):
                    rule = CLOSES.get(stack[i][1])
                    if rule and name in rule[0] and not any(t in rule[1] for _, t, _ in stack[i + 1:]):
                        del stack[i:]
                    elif stack[i][1] in BLOCK and not rule:
                        break
            if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCK:
                continue
            words, label = (), stack[-1][2]
            if "=" in m[3]:
                found = ATTRIBUTE.findall(m[3])
                words = tuple(w.lower() for _, a, b, c in found for w in NAME.findall(a or b or c))
                if training and "data-label" in m[3]:
                    label = int(re.search(r"data-label=.?(\d)", m[3])[1])
            node = stack[-1][0]
            if name in BLOCK:
                node = self.add(node, name, words, None, 0, label)
                anchors = 0
            elif name == "a":
                anchors += 1
            stack.append((node, name, label))
        flush()

    def add(self, parent, tag, names, text, linked, label) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        self.label.append(label)
        return len(self.parent) - 1


def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


KNOWN: dict[str, int] = {}


def code(feature: str) -> int:
    got = KNOWN.get(feature)
    if got is None:
        if len(KNOWN) > 100_000:
            KNOWN.clear()
        got = KNOWN[feature] = hashed(feature)
    return got


def bucket(n: int) -> int:
    return min(n.bit_length(), 10)


class Forest:
    """All nodes of several pages as arrays: features, parents, depth, and the kind of edge to the parent."""

    def __init__(self, pages: list[Page]):
        parent, features, first, texts, labels, is_text = [], [], 0, [], [], []
        for p in pages:
            for i in range(len(p.parent)):
                tag, up = p.tag[i], p.tag[p.parent[i]] if i else ""
                own = [code(f"t:{tag}")]
                if tag == "#text":
                    size = len(p.text[i])
                    own += [code(f"in:{up}"), code(f"long:{bucket(size)}"), code(f"link:{min(4, 4 * p.linked[i] // max(1, size))}")]
                else:
                    own.append(code(f"under:{up}>{tag}"))
                    for w in p.names[i]:
                        own += [code(f"w:{w}"), code(f"s:{w[:4]}")]
                features.append(own)
                parent.append(first + p.parent[i] if i else -1)
            texts += p.text
            labels += p.label
            is_text += [t == "#text" for t in p.tag]
            first += len(p.parent)
        self.parent = np.array(parent, np.int64)
        self.texts, self.labels, self.is_text = texts, labels, np.array(is_text, bool)
        self.starts = np.concatenate([[0], np.cumsum([len(p.parent) for p in pages])]).astype(np.int64)
        size = np.array([len(f) for f in features], np.int64)
        self.feature = np.fromiter((x for f in features for x in f), np.int64, int(size.sum()))
        self.node = np.repeat(np.arange(len(size)), size)
        self.kind = self.is_text.astype(np.int64)  # of the edge to the parent
        depth = np.zeros(len(parent), np.int64)
        for i, p in enumerate(parent):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1)) if len(order) else []
        self.levels = np.split(order, cuts)[1:] if len(order) else []


@dataclass
class Model:
    unary: np.ndarray  # log-odds of content for each hashed feature
    pair: np.ndarray  # [kind of edge, state of the parent, state of the node]


def marginals(model: Model, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Probability of content for each node, and of (parent, node) states for each node but roots, by sum-product."""
    n = len(forest.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(forest.node, model.unary[forest.feature], minlength=n)
    up = np.zeros((n, 2))  # sum of what the children say about this node
    say = np.zeros((n, 2))  # what this node says about its parent
    table = model.pair[forest.kind]
    for level in reversed(forest.levels):
        inner = table[level] + (own + up)[level][:, None, :]
        top = inner.max(axis=2)
        say[level] = top + np.log(np.exp(inner - top[:, :, None]).sum(axis=2))
        for s in (0, 1):
            up[:, s] += np.bincount(forest.parent[level], say[level, s], minlength=n)
    down = np.zeros((n, 2))
    both = np.zeros((n, 2, 2))
    for level in forest.levels:
        rest = (own + up + down)[forest.parent[level]] - say[level]  # what the rest of the tree says about the parent
        joint = rest[:, :, None] + table[level] + (own + up)[level][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        both[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        inner = rest[:, :, None] + table[level]
        top = inner.max(axis=1)
        down[level] = top + np.log(np.exp(inner - top[:, None, :]).sum(axis=1))
    total = own + up + down
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -60, 60))), both


def train(pages: list[Page], rounds: int = 250, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """Gradient ascent (with step sizes by the sum of squares) on the likelihood of the labels of all nodes."""
    forest = Forest(pages)
    y = np.array([x or 0 for x in forest.labels])
    model = Model(np.zeros(1 << BITS), np.zeros((2, 2, 2)))
    seen = [np.full(1 << BITS, 1e-6), np.full((2, 2, 2), 1e-6)]
    child = forest.parent >= 0
    hit = np.zeros((2, 2, 2))
    np.add.at(hit, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    for _ in range(rounds):
        p, both = marginals(model, forest)
        grad = np.bincount(forest.feature, (y - p)[forest.node], minlength=1 << BITS) - decay * len(pages) * model.unary
        pair = hit - np.stack([both[child & (forest.kind == k)].sum(axis=0) for k in (0, 1)]) - decay * len(pages) * model.pair
        for w, g, s in ((model.unary, grad, seen[0]), (model.pair, pair, seen[1])):
            s += g * g
            w += rate * g / np.sqrt(s)
    return model


# Shapes of labelled pages. Each is the opening markup of a region; what follows is put in by ``labelled``.
CONTENT = ["article", "article", "article", "main", "main", 'div class="content"', 'div id="content"', 'div class="post-body"', 'div class="entry-content"', 'div class="article-text"', 'section class="story"',
           'div id="main"', 'div class="page"', 'td class="text"', 'div role="main"']
OTHER = ["nav", 'ul class="menu"', 'div class="navbar"', 'div id="nav"', "header", 'div class="site-header"', 'div id="header"', 'div class="masthead"', "footer", 'div id="footer"',
         'div class="site-footer"', "aside", 'div class="sidebar"', 'div id="sidebar-right"', 'div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"',
         'div class="banner"', 'div class="sponsored"', 'div class="promo"', 'div class="notice"', 'div class="cookie-notice"', 'div class="cookie-banner"', 'div id="consent"',
         'div class="alert"', 'div class="popup"', 'form', 'form class="search"', 'div class="newsletter"', 'div class="subscribe"', 'div class="login"', 'div class="comments"',
         'div id="comments"', 'section class="comments"', 'ol class="comment-list"', 'div class="comment"', 'div class="reader-comments"', 'div id="disqus"', 'div class="related"',
         'div class="share"', 'div class="social"', 'div class="breadcrumb"', 'div class="pagination"', 'div class="tags"', 'div class="widget"', 'div role="navigation"',
         'div role="banner"', 'div role="complementary"', 'div role="contentinfo"', "menu", "dialog", 'div class="toolbar"', 'div class="copyright"', "select", "button", "fieldset"]
SHAPES = ["<p>{s}</p>", "<p>{l}</p>", "<p>{l}<p>{l}</p>", "<h2>{s}</h2><p>{l}</p>", "<ul><li>{s}</li><li>{l}</li></ul>", "<ol><li>{s}<li>{s}</ol>", "<blockquote><p>{l}</p></blockquote>",
          "<pre>{s}</pre>", "<table><tr><th>{s}</th><td>{s}</td></tr><tr><td>{l}</td><td>{s}</td></tr></table>", "<figure><figcaption>{s}</figcaption></figure>", "<div>{l}</div>", "{l}",
          "<div><p>{s}</p><p>{l}</p></div>", "<section><h3>{s}</h3><p>{l} <a href=x>{s}</a> {l}</p></section>", "<dl><dt>{s}</dt><dd>{l}</dd></dl>", "<h1>{s}</h1><p>{s}</p>", "<p>{l}<br>{l}</p>",
          "<p>{s}", "<h4>{s}</h4>", "<p><a href=x>{s}</a></p>", "<details><summary>{s}</summary><p>{l}</p></details>", "<header><h1>{s}</h1></header><p>{l}</p>"]
NOISE = ["<ul><li><a href=x>{s}</a></li><li><a href=x>{s}</a></li><li><a href=x>{s}</a></li></ul>", "{s}", "<p>{s}</p>", "<p>{l}</p>", "<a href=x>{s}</a> <a href=x>{s}</a>", "<div>{s}</div>",
         "<h3>{s}</h3><p>{s}</p>", "<p>{s} <a href=x>{s}</a></p>", "<div><p>{l}</p></div>", "<span>{s}</span>", "<ol><li>{l}</li><li><p>{s}</p></li></ol>", "<label>{s}</label><input><button>{s}</button>", "{l}"]


def labelled(number: int = 900, seed: int = 11) -> list[Page]:
    """Labelled pages drawn from the shapes: regions around one region of content, some regions inside it.

    A third of the content regions have names that say nothing, regions of both kinds stand in plain or oddly named
    wrappers of any depth, other regions take various elements, and some pages have no content element or no markup.
    """
    rng = np.random.default_rng(seed)

    def pick(values):
        return values[rng.integers(len(values))]

    def text(long: bool) -> str:
        return " ".join("x" * int(k) for k in rng.integers(2, 10, rng.integers(12, 90) if long else rng.integers(1, 8)))

    def fill(shape: str) -> str:
        return re.sub(r"\{([sl])\}", lambda m: text(m[1] == "l"), shape)

    def odd() -> str:
        return "".join(chr(97 + int(k)) for k in rng.integers(0, 26, rng.integers(3, 9)))

    def wrapped(inside: str, deep: float) -> str:
        for _ in range(rng.integers(1, 13) if rng.random() < deep else 0):
            inside = f"<div>{inside}</div>" if rng.random() < 0.7 else f"<div class={odd()}>{inside}</div>"
        return inside

    def region(opening: str, label: int, inside: str) -> str:
        tag = opening.split()[0]
        return f"<{opening} data-label={label}>{inside}</{tag}>"

    def noise() -> str:
        opening = pick(OTHER)
        if opening.startswith("div ") and rng.random() < 0.3:
            tag = pick(["p", "p", "section", "ul", "aside", "div"])
            opening = tag + opening[3:]
            if tag == "p":
                return region(opening, 0, text(rng.random() < 0.5))
        return region(opening, 0, wrapped("".join(fill(pick(NOISE)) for _ in range(rng.integers(1, 4))), 0.15))

    def all_content(source: str) -> Page:
        page = Page(source, training=True)
        page.label = [1] * len(page.label)
        return page

    pages = []
    for _ in range(number):
        opening = pick(CONTENT)
        if rng.random() < 0.4:
            opening = pick(["div", f"div class={odd()}", f"div id={odd()}", f"section class={odd()}"])
        parts = [fill("<h1>{s}</h1>")] * int(rng.random() < 0.7) + [wrapped(fill(pick(SHAPES)), 0.1) for _ in range(rng.integers(1, 9))]
        if rng.random() < 0.1:
            bare = pick(["{l}", "<p>{l}</p>", "<p>{l}</p><p>{l}</p>", "<html><body>{l}</body></html>", "<html><body><p>{l}</p></body></html>", f"<html><body><div class={odd()}><p>{{l}}</p></div></body></html>"])
            pages.append(all_content(fill(bare)))
            continue
        for _ in range(rng.integers(0, 5)):
            parts.insert(int(rng.integers(len(parts) + 1)), noise())
        if rng.random() < 0.06:  # no element of its own: every part stands in the body
            body = "".join(x if "data-label" in x.split(">")[0] else f"<p data-label=1>{text(True)}</p>" if x[0] != "<" else re.sub(r"<(\w+)", r"<\1 data-label=1", x) for x in parts)
            pages.append(Page(f"<html><body>{noise()}{body}{noise()}</body></html>", training=True))
            continue
        if opening.startswith("td"):
            body = f"<table data-label=0><tr>{region('td class=menu', 0, fill(NOISE[0]))}{region(opening, 1, ''.join(parts))}</tr></table>"
        else:
            body = region(opening, 1, wrapped("".join(parts), 0.4))
        for _ in range(rng.integers(0, 3)):
            body = f"<div class={pick(['wrap', 'container', 'outer', odd()])}>{noise() if rng.random() < 0.4 else ''}{body}{noise() if rng.random() < 0.4 else ''}</div>"
        alone = rng.random() < 0.15
        around = [[noise() for _ in range(0 if alone else rng.integers(0, 5))] for _ in range(2)]
        pages.append(Page(f"<html><body>{''.join(around[0])}{wrapped(body, 0.6 if alone else 0.1)}{''.join(around[1])}</body></html>", training=True))
    return pages


def extract(model: Model, sources: list[str | None]) -> list[str]:
    """Text blocks whose marginal is at least one half, one per line, in page order."""
    pages = [Page(s or "") for s in sources]
    forest = Forest(pages)
    p, _ = marginals(model, forest)
    keep = forest.is_text & (p >= 0.5)
    return ["\n".join(forest.texts[i] for i in np.flatnonzero(keep[a:b]) + a) for a, b in zip(forest.starts[:-1].tolist(), forest.starts[1:].tolist())]


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text and n_chars (code points).

    Null and empty pages and pages without content give an empty text. Repeated rows give repeated results.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = extract(shared.value, batch.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
