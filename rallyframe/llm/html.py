"""Main text of web pages by a tree-structured model over DOM nodes.

Each block element of a page is a binary variable: content or not. Features of the node
(tag, class and id words, length and links of its text) give its own log-odds, a 2x2
potential for each kind of parent joins it to its parent, and one sum-product pass up and
one down the tree give exact marginals. Weights come from gradient ascent on the
likelihood of labelled pages: pages composed by ``labelled_pages`` and a bounded sample of
``sample_rows`` pages of the table whose sectioning tags label them. Extraction is one pass
over the pages without a shuffle.

Text of nodes with a marginal over one half is kept: references decoded, white space in a
block turned into one space, blocks joined by a line feed in page order. Null or empty
pages give an empty text. Repeated rows are extracted each; null ids stay null. An empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.shared import sample_by_hash

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAME_PART = re.compile(r"[a-z]+")
#: Element names of HTML by their role.
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext noscript object q rp rt ruby s samp semantics small span strike strong sub sup svg time tt u var video wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style head template iframe select textarea button title".split())
RAW = frozenset("script style textarea title".split())
CLOSES_P = frozenset("address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
TOP = frozenset(("", "html", "body"))


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    names: tuple[str, ...]
    words: int = 0
    link_words: int = 0
    sentence: bool = False
    label: int | None = None


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, list[str]]] = field(default_factory=list)  #: node and pieces of text, in page order


def tags(source: str):
    """(start, end, closing, name, attributes) of each tag; name is empty for comments and declarations. What has no end is text.

    Never goes back: quotes are respected up to a quote without an end; tags before that one end at the next ``>``.
    """
    at, last, plain_until = 0, source.rfind(">"), 0
    while 0 <= (start := source.find("<", at)) < last:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            end = len(source) if end < 0 else end + 3
            yield start, end, False, "", ""
            at = end
            continue
        if source[start + 1] in "!?":
            at = source.index(">", start) + 1
            yield start, at, False, "", ""
            continue
        m = NAME.match(source, start + 1)
        if m is None:
            at = start + 1
            continue
        walk = m.end()
        while True:
            if start < plain_until:
                end = source.find(">", m.end())
                break
            got = QUOTE_OR_END.search(source, walk)
            if got is None or got[0] == ">":
                end = -1 if got is None else got.start()
            else:
                close = source.find(got[0], got.end())
                if close >= 0:
                    walk = close + 1
                    continue
                end = -1
            if end < 0:  # a quote without an end, or none but quoted ends
                plain_until = len(source) if got is None else got.start() + 1
                end = source.find(">", m.end())
            break
        if end < 0:
            return
        at = end + 1
        yield start, at, bool(m[1]), m[2].lower(), source[m.end() : end]


def parse(source: str, want_labels: bool = False) -> Page:
    """Block elements of a page as a tree in document order, and its text blocks."""
    page = Page([Node("", -1, ())])
    nodes, blocks = page.nodes, page.blocks
    stack, links, current, at = [0], 0, None, 0

    def text(s: str) -> None:
        nonlocal current
        if not s.strip():
            if current is not None and s:
                current.append(s)
            return
        if current is None:
            current = []
            blocks.append((stack[-1], current))
        current.append(s)
        n = len(s.split())
        node = nodes[stack[-1]]
        node.words += n
        node.link_words += n if links > 0 else 0
        node.sentence |= any(c in s for c in ".!?")

    open_: Counter = Counter()  #: elements on the stack by tag
    without_end: set[str] = set()  #: tags of which no closing tag is left

    def close(depth: int) -> None:
        nonlocal current
        open_.subtract(nodes[i].tag for i in stack[depth:])
        del stack[depth:]
        current = None

    size = len(source)
    for start, stop, closing, tag, attributes in tags(source):
        if start < at:  # inside an element that is skipped
            continue
        if start > at:
            text(source[at:start])
        at = stop
        if not tag:
            continue
        if tag in SKIPPED:
            if not closing and not attributes.endswith("/"):
                end = None if tag in without_end else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if end:
                    at = end.end()
                    continue
                without_end.add(tag)
                if tag == "head" and "body" not in without_end:
                    body = re.compile(r"<body\b", re.I).search(source, at)
                    at = body.start() if body else at
                    without_end.add("body")
                elif tag in RAW:
                    at = size
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            text(" ") if current is not None else None
            continue
        if tag in INLINE:
            continue
        if tag in VOID:
            if tag == "hr":
                current = None
            continue
        if closing:
            if open_[tag] > 0:
                for d in range(len(stack) - 1, 0, -1):
                    if nodes[stack[d]].tag == tag:
                        close(d)
                        break
            current = None
            continue
        if tag in CLOSES_P and nodes[stack[-1]].tag == "p":
            close(len(stack) - 1)
        if tag in SIBLINGS and any(open_[t] > 0 for t in SIBLINGS[tag]):
            for d in range(len(stack) - 1, 0, -1):
                t = nodes[stack[d]].tag
                if t in SCOPES[tag]:
                    break
                if t in SIBLINGS[tag]:
                    close(d)
                    break
        names = tuple(w for a in ATTRIBUTE.findall(attributes) for w in NAME_PART.findall((a[1] or a[2] or a[3]).lower())) if attributes else ()
        node = Node(tag, stack[-1], names)
        if want_labels:
            y = re.search(r'data-y="([01])"', attributes)
            node.label = int(y[1]) if y else nodes[stack[-1]].label
        nodes.append(node)
        current, links = None, 0
        if not attributes.endswith("/"):
            stack.append(len(nodes) - 1)
            open_[tag] += 1
    if at < size:
        text(source[at:])
    return page


def length_bin(n: int) -> int:
    return 0 if n == 0 else 1 if n < 4 else 2 if n < 12 else 3 if n < 30 else 4


def features(page: Page) -> list[list[str]]:
    nodes = page.nodes
    words, linked = [n.words for n in nodes], [n.link_words for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        words[p] += words[i]
        linked[p] += linked[i]
    out = []
    for i, n in enumerate(nodes):
        f = ["bias", f"tag {n.tag}", f"own {length_bin(n.words)}", f"all {length_bin(words[i] // 2)}"]
        f += [f"name {w}" for w in n.names]
        if words[i]:
            share = linked[i] / words[i]
            f.append("links " + ("none" if share == 0 else "few" if share < 0.3 else "many"))
        if n.words:
            f.append(f"sentence {n.sentence}")
        out.append(f)
    return out


def kind(tag: str) -> int:
    return 0 if tag in TOP else 1 if tag in ("div", "section", "table", "tr", "td", "tbody") else 2


@dataclass
class Model:
    weight: dict[str, float] = field(default_factory=dict)
    edge: list[list[list[float]]] = field(default_factory=lambda: [[[0.0, 0.0], [0.0, 0.0]] for _ in range(3)])

    def marginals(self, page: Page, feats: list[list[str]]) -> tuple[list[float], list[list[float]]]:
        """P(content) of each node, and of each node with its parent P(parent, node) as [00, 01, 10, 11]."""
        nodes, get, exp = page.nodes, self.weight.get, math.exp
        n = len(nodes)
        own = [max(-30.0, min(30.0, sum([get(f, 0.0) for f in fs]))) for fs in feats]
        table = [[exp(e[a][b]) for a in (0, 1) for b in (0, 1)] for e in self.edge]
        edge = [table[kind(nodes[nodes[i].parent].tag)] if i else None for i in range(n)]
        up, message = own[:], [0.0] * n  # log-odds
        for i in range(n - 1, 0, -1):
            x = exp(min(60.0, max(-60.0, up[i])))
            e = edge[i]
            message[i] = math.log((e[2] + e[3] * x) / (e[0] + e[1] * x))
            up[nodes[i].parent] += message[i]
        full, pair = up[:], [[]] * n
        for i in range(1, n):
            p, e = nodes[i].parent, edge[i]
            rest = exp(min(60.0, max(-60.0, full[p] - message[i])))  # of the parent, without this child
            x = exp(min(60.0, max(-60.0, up[i])))
            down = math.log((e[1] + e[3] * rest) / (e[0] + e[2] * rest))
            joint = [e[0], e[1] * x, e[2] * rest, e[3] * rest * x]
            total = sum(joint)
            pair[i] = [j / total for j in joint]
            full[i] = up[i] + down
        return [1 / (1 + exp(-max(-60.0, min(60.0, v)))) for v in full], pair


def train(pages: list[Page], epochs: int = 25, rate: float = 0.25, decay: float = 1e-3) -> Model:
    """Adaptive gradient ascent on the log-likelihood of pages whose nodes have labels."""
    model, seen = Model(), [features(p) for p in pages]
    square: dict = {}
    order = list(range(len(pages)))
    shuffle = random.Random(5).shuffle
    for _ in range(epochs):
        shuffle(order)
        for k in order:
            page, feats = pages[k], seen[k]
            one, two = model.marginals(page, feats)
            gradient: dict = {}
            for i, node in enumerate(page.nodes):
                for f in feats[i]:
                    gradient[f] = gradient.get(f, 0.0) + node.label - one[i]
                if i:
                    t, parent = kind(page.nodes[node.parent].tag), page.nodes[node.parent].label
                    for a in (0, 1):
                        for b in (0, 1):
                            g = (parent == a and node.label == b) - two[i][2 * a + b]
                            gradient[t, a, b] = gradient.get((t, a, b), 0.0) + g
            for f, g in gradient.items():
                edge = isinstance(f, tuple)
                was = model.edge[f[0]][f[1]][f[2]] if edge else model.weight.get(f, 0.0)
                g -= decay * was
                square[f] = square.get(f, 0.0) + g * g
                now = was + rate * g / math.sqrt(square[f] + 1e-6)
                if edge:
                    model.edge[f[0]][f[1]][f[2]] = now
                else:
                    model.weight[f] = now
    return model


def settle_labels(page: Page) -> Page:
    """Containers without a label of their own take the side of most of their text."""
    n = len(page.nodes)
    good, bad = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        x = page.nodes[i]
        if x.label == 1:
            good[i] += x.words
        else:
            bad[i] += x.words
        if i:
            good[x.parent] += good[i]
            bad[x.parent] += bad[i]
    for i, x in enumerate(page.nodes):
        if x.label is None or not x.words:
            x.label = int(good[i] > bad[i]) if good[i] + bad[i] else x.label or 0
    return page


#: Names that sites give to the parts of a page; the labelled pages are composed of them.
CONTENT_NAMES = "content article post entry story main body text article-body post-content entry-content story-body main-content page-content prose markdown".split()
BLOCKS_OFF = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs main-menu site-nav topnav toc".split(),
    "header": "header site-header masthead top page-header branding topbar".split(),
    "footer": "footer site-footer bottom page-footer copyright colophon legal".split(),
    "aside": "sidebar aside widget related side rail recommended trending popular more-stories promo".split(),
    "notice": "notice cookie cookie-banner consent alert banner gdpr popup modal privacy-notice message subscribe newsletter".split(),
    "ad": "ad ads advert advertisement sponsor sponsored ad-slot adsense banner-ad promo promotion".split(),
    "form": "form search search-form login newsletter signup contact-form subscribe-form".split(),
    "comments": "comments comment comment-list discussion replies reply responses reader-comments disqus user-comments".split(),
    "share": "share social social-links sharing tags meta byline author-box pagination".split(),
}
SYLLABLES = "ra len to mi shu ba ker an thi os el du par ven cor ita no fe gra lis um pol".split()


def labelled_pages(n: int, seed: int = 3) -> list[Page]:
    """Pages put together from the parts above, in many arrangements, each block marked as content or not."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))

    def words(lo: int, hi: int, stop: bool = True) -> str:
        w = " ".join(word() for _ in range(r.randint(lo, hi)))
        return w.capitalize() + (r.choice(". . . ! ?".split()) if stop else "")

    def link(lo: int = 1, hi: int = 4) -> str:
        return f'<a href="/{word()}">{words(lo, hi, False)}</a>'

    def named(names: list[str]) -> str:
        if r.random() < 0.25:
            return ""
        got = " ".join(r.sample(names, min(len(names), r.choice((1, 1, 1, 2)))))
        return f' {r.choice(("class", "class", "id"))}="{got}"'

    def listing() -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>"

    def off(part: str) -> str:
        tag = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "form": ("form",), "comments": ("section", "div", "ol")}.get(part, ("div", "div", "section", "p", "aside"))
        tag = r.choice(tag)
        generic = tag in ("div", "section", "p", "ul", "ol")
        at = f' class="{r.choice(BLOCKS_OFF[part])}"' if generic else named(BLOCKS_OFF[part])
        said = lambda: f"<p>{words(4, 30)}</p>"
        heading = lambda: f"<{(h := r.choice(('h2', 'h3', 'h4')))}>{words(1, 4, False)}</{h}>"
        inner = {
            "nav": lambda: listing() if tag != "ul" else "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))),
            "header": lambda: r.choice((f"<h1>{link()}</h1>", f"<div>{words(1, 4, False)}</div>", f"<p>{words(2, 8, False)}</p>")) + r.choice(("", listing())),
            "footer": lambda: r.choice((f"&copy; {words(2, 9)}", said(), listing() + said(), f"&copy; {word()}.example &middot; {words(4, 9)}")),
            "aside": lambda: heading() + r.choice((listing(), said(), said() + listing())),
            "notice": lambda: r.choice((words(5, 30), said())) if tag != "p" else words(5, 30),
            "ad": lambda: r.choice((words(4, 24), said(), link(3, 9))) if tag != "p" else words(4, 20),
            "form": lambda: f"<label>{words(1, 3, False)}</label><input name=q>" + r.choice(("", said(), f"<div>{words(2, 8)}</div>")),
            "comments": lambda: r.choice(("", heading())) + "".join(r.choice((f'<div class="comment">{said()}</div>', f"<li>{words(5, 40)}</li>", f'<div class="reply"><b>{word()}</b> {words(6, 40)}</div>', said())) for _ in range(r.randint(1, 6))),
            "share": lambda: r.choice((" ".join(link() for _ in range(r.randint(1, 5))), words(1, 5, False))) if tag != "p" else words(1, 5, False),
        }[part]()
        return f'<{tag}{at} data-y="0">{inner}</{tag}>'

    def body_block() -> str:
        text = " ".join(words(1, 40) for _ in range(r.choice((1, 1, 2, 4))))
        if r.random() < 0.25:
            text = f"<b>{text}" + r.choice(("</b>", "<br>"))
        if r.random() < 0.2:
            text += f" {link()} {words(2, 9)}"
        cell = lambda: words(1, 6, r.random() < 0.3)
        return r.choice([
            *[lambda: f"<p>{text}" + r.choice(("</p>", "</p>", ""))] * 10,
            *[lambda: f"<{(h := r.choice(('h2', 'h3')))}>{words(1, 8, False)}</{h}>"] * 2,
            *[lambda: f"<{(t := r.choice(('ul', 'ul', 'ol')))}>" + "".join(f"<li>{words(1, 20, r.random() < 0.5)}</li>" for _ in range(r.randint(1, 6))) + f"</{t}>"] * 2,
            lambda: f"<blockquote>{r.choice((text, f'<p>{text}</p>'))}</blockquote>",
            lambda: f"<p>{words(1, 3)}</p>",
            lambda: f"<div>{text}</div>",
            lambda: f"<section><p>{text}</p></section>",
            lambda: "<table>" + "".join(f"<tr><td>{cell()}</td><td>{cell()}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>",
            lambda: f"<pre>{words(2, 20, False)}</pre>",
            lambda: f"<figure><img src=x><figcaption>{words(2, 12)}</figcaption></figure>",
            lambda: f"<dl><dt>{words(1, 3, False)}</dt><dd>{words(2, 12)}</dd></dl>",
        ])()

    def headline() -> str:
        h = f"<{(t := r.choice(('h1', 'h1', 'h2')))}>{words(1, 10, False)}</{t}>"
        kind_ = r.random()
        if kind_ < 0.15:
            byline = f'<p class="byline" data-y="0">{words(2, 5, False)}</p>' if r.random() < 0.6 else ""
            return f"<header>{h}{byline}</header>"
        return "" if kind_ > 0.9 else h

    pages = []
    for _ in range(n):
        tag = r.choice("article article article main div div section none".split())
        at = named(CONTENT_NAMES) if tag in ("article", "main") else f' class="{r.choice(CONTENT_NAMES)}"'
        inner = [headline()] + [body_block() for _ in range(r.choice((1, 2, 2, 4, 8, 16)))]
        for part in r.sample(["ad", "aside", "notice", "share", "comments", "form", "nav", "footer"], r.choice((0, 0, 1, 1, 2))):
            inner.insert(r.randint(1, len(inner)) if part not in ("comments", "footer") else len(inner), off(part))
        if tag == "none":  # content right under the body: what isn't marked otherwise
            article = "".join(inner)
        else:
            article = f'<{tag}{at} data-y="1">{"".join(inner)}</{tag}>'
        if tag != "none" and r.random() < 0.45:
            wrap = named(["wrapper", "container", "page", "row", "site", "layout", "main", "outer"])
            inside = [article] + [off(p) for p in ("aside", "comments", "share") if r.random() < 0.25]
            article = f"<div{wrap}>{''.join(inside)}</div>"
        before = [off(p) for p in ("notice", "header", "nav", "share", "ad", "form") if r.random() < 0.4]
        after = [off(p) for p in ("comments", "aside", "ad", "share", "notice", "form", "footer") if r.random() < 0.4]
        r.shuffle(before)
        rest = "1" if tag == "none" else "0"
        pages.append(settle_labels(parse(f'<html><body data-y="{rest}">{"".join(before)}{article}{"".join(after)}</body></html>', want_labels=True)))
    return pages


def label_by_sections(page: Page) -> Page | None:
    """Labels a real page by its sectioning tags; None if it has no article or main element."""
    inside = []
    for n in page.nodes:
        above = inside[n.parent] if n.parent >= 0 else 0
        inside.append(0 if n.tag in ("nav", "footer", "aside", "form") else 1 if n.tag in ("article", "main") else above)
        n.label = inside[-1]
    return settle_labels(page) if 1 in inside else None


def main_text(source: str, model: Model) -> str:
    page = parse(source)
    one, _ = model.marginals(page, features(page))
    kept = (" ".join(html.unescape("".join(pieces)).split()) for node, pieces in page.blocks if one[node] > 0.5)
    return "\n".join(k for k in kept if k)


def fit(pages: DataFrame, sample_rows: int = 200, sample_chars: int = 50_000, composed: int = 900) -> Model:
    """Learns from composed pages and at most ``sample_rows`` pages of the table of under ``sample_chars`` characters, the same ones each time."""
    sample = sample_by_hash(pages.filter(F.length("html") < sample_chars).select("html"), sample_rows)
    real = [p for p in (label_by_sections(parse(h)) for h in sample) if p]
    return train(labelled_pages(composed) + real)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages))
    rows = pages.select(F.col("page_id").alias("i"), F.col("url").alias("u"), F.col("html").alias("h"))

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py() or "", shared.value) for h in b["h"]]
            yield pa.record_batch([b["i"], b["u"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {types['i']}, url {types['u']}, text string, n_chars long")
