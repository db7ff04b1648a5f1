"""HTML main-text extraction by a tree-structured graphical model over DOM nodes.

Every element has a hidden label, content or not. Unary potentials are its observed
features given the label (words of class, id and role, link density, depth, and of its own
text the length, share and place in the page's, first sign and sentence marks); parent-child potentials tie an element to its parent, by its tag. Sum-product
messages go up the tree, then down, and give each element's exact marginal. All
potentials are smoothed counts over labelled pages, which ``labelled_pages`` composes from
a seeded description of page layouts (the tables hold no page labels).

Text of elements whose marginal is at least one half is kept: character references
decoded, white space in a block to one space, blocks joined by newlines in page order.

Defined results: null and empty html give an empty text; a page without any element is
plain text and is kept; null keys and urls are kept; repeated rows each give a row; other
columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.dom import INLINE, Node, attributes, parse
from loomgraph.llm.workers import mapped

TRAIN_PAGES, TRAIN_SEED = 1500, 5
NAME = re.compile(r"[a-z]+")
#: Features that say the same thing in part count for less.
WEIGHT = {"name": 1.0, "links": 0.5, "size": 0.4, "marks": 0.4, "share": 0.6, "depth": 0.3, "place": 0.4, "opens": 0.4}
FRAME = {"#page", "html", "head", "body"}
SHARES = (0.02, 0.1, 0.3, 0.6, 0.9)
PLACES = (0.0, 0.1, 0.5, 0.9)
SENTENCE = re.compile(r"[.!?][\"')\]]*(?:\s|$)")


def _kind(ch: str) -> str:
    return "upper" if ch.isupper() else "letter" if ch.isalpha() else "digit" if ch.isdigit() else ch if ch in "©" else "sign"


def observe(nodes: list[Node], pieces: list[tuple[int, str | None]]) -> list[list[tuple[str, str]]]:
    """Features of each element. Its own text is what stands in it or in its inline elements."""
    n = len(nodes)
    own_size, marks, depth, begin, opens = [0] * n, [0] * n, [0] * n, [-1] * n, [""] * n
    before = 0
    for k, text in pieces:
        if text:
            size = len(text) - sum(map(text.count, " \n\t\r"))
            own_size[k] += size
            marks[k] += len(SENTENCE.findall(text)) if size > 16 else 0
            if size and begin[k] < 0:
                begin[k], opens[k] = before, _kind(text.lstrip()[0])
            before += size
    size, linked = list(own_size), [0] * n
    for k in range(n - 1, 0, -1):  # children come after their parents
        p = nodes[k].parent
        if nodes[k].tag == "a":
            linked[k] = size[k]
        size[p] += size[k]
        linked[p] += linked[k]
        if nodes[k].tag in INLINE:
            own_size[p] += own_size[k]
            marks[p] += marks[k]
            if begin[k] >= 0 and not 0 <= begin[p] < begin[k]:
                begin[p], opens[p] = begin[k], opens[k]
    for k in range(1, n):
        depth[k] = depth[nodes[k].parent] + (nodes[k].tag not in INLINE and nodes[k].tag not in FRAME)
    out = []
    for k, node in enumerate(nodes):
        own: list[tuple[str, str]] = []
        if node.attributes:
            a = attributes(node)
            names = set(NAME.findall(" ".join((a.get("class", ""), a.get("id", ""), a.get("role", ""))).lower()))
            own += [("name", w) for w in sorted(names)]
        if node.tag not in INLINE and node.tag not in FRAME:
            share = linked[k] / size[k] if size[k] else -1
            own.append(("links", "none" if share < 0 else "0" if share == 0 else "low" if share < 0.2 else "some" if share < 0.6 else "most"))
            own.append(("depth", str(min(depth[k], 6))))
            if own_size[k]:
                own.append(("size", str(min(4, int(math.log(own_size[k] + 1, 4))))))
                own.append(("marks", str(min(marks[k], 2))))
                own.append(("share", str(bisect_left(SHARES, own_size[k] / size[0]))))
                own.append(("place", str(bisect_left(PLACES, begin[k] / size[0])) + str(int(begin[k] + own_size[k] == size[0]))))
                own.append(("opens", opens[k]))
        out.append(own)
    return out


class TreeModel:
    """Log potentials from labelled trees."""

    def __init__(self, pages: list[tuple[list[Node], list, list[int]]]):
        emit: dict[str, Counter] = {}
        kinds: dict[str, set] = {}
        labels, pairs = Counter(), Counter()
        for nodes, seen, y in pages:
            for k, node in enumerate(nodes):
                labels[y[k]] += 1
                if node.parent >= 0:
                    pairs[node.tag, y[node.parent], y[k]] += 1
                    pairs["", y[node.parent], y[k]] += 1
                for kind, value in seen[k]:
                    emit.setdefault(kind, Counter())[y[k], value] += 1
                    kinds.setdefault(kind, set()).add(value)
        total = {k: [sum(n for (y, _), n in c.items() if y == label) for label in (0, 1)] for k, c in emit.items()}
        self.unary = {
            (kind, v): tuple(WEIGHT[kind] * math.log((c[y, v] + 0.5) / (total[kind][y] + 0.5 * (len(kinds[kind]) + 1))) for y in (0, 1))
            for kind, c in emit.items() for v in kinds[kind]
        }
        share = lambda p, c: (pairs["", p, c] + 1) / (pairs["", p, 0] + pairs["", p, 1] + 2)
        self.pair = {
            tag: tuple(math.log((pairs[tag, p, c] + 2 * share(p, c)) / (pairs[tag, p, 0] + pairs[tag, p, 1] + 2)) for p in (0, 1) for c in (0, 1))
            for tag in {t for t, _, _ in pairs}
        }
        self.root = [math.log((labels[y] + 1) / (sum(labels.values()) + 2)) for y in (0, 1)]

    def marginals(self, nodes: list[Node], seen: list[list[tuple[str, str]]]) -> list[float]:
        """P(content) of each element: messages to the root, then from it."""
        n = len(nodes)
        none = (0.0, 0.0)  # a value never seen says nothing
        belief = []
        for own in seen:
            a = b = 0.0
            for f in own:
                x = self.unary.get(f, none)
                a += x[0]
                b += x[1]
            belief.append([a, b])
        up = [none] * n
        ties = [self.pair.get(node.tag) or self.pair[""] for node in nodes]
        for k in range(n - 1, 0, -1):
            a, b = belief[k]
            t00, t01, t10, t11 = ties[k]
            up[k] = m = (_add(t00 + a, t01 + b), _add(t10 + a, t11 + b))
            p = belief[nodes[k].parent]
            p[0] += m[0]
            p[1] += m[1]
        belief[0][0] += self.root[0]
        belief[0][1] += self.root[1]
        for k in range(1, n):  # a parent's belief is whole before its children's
            p, m, b = belief[nodes[k].parent], up[k], belief[k]
            x, y = p[0] - m[0], p[1] - m[1]
            z = _add(x, y)
            x, y = x - z, y - z
            t00, t01, t10, t11 = ties[k]
            b[0] += _add(x + t00, y + t10)
            b[1] += _add(x + t01, y + t11)
        return [1 / (1 + math.exp(min(700.0, a - b))) for a, b in belief]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


# ---- labelled pages -------------------------------------------------------------------

#: Names and tags of page parts.
BOILER = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toolbar", "topbar", "links", "pagination", "pager", "toc", "skip"],
    "header": ["header", "masthead", "banner", "logo", "branding", "site", "top"],
    "footer": ["footer", "copyright", "colophon", "legal", "bottom", "imprint"],
    "aside": ["sidebar", "aside", "related", "widget", "trending", "popular", "recommended", "teaser", "rail", "tags", "author", "bio"],
    "ad": ["ad", "ads", "advert", "advertisement", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "banner"],
    "notice": ["cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "overlay", "alert", "paywall", "subscribe"],
    "form": ["form", "search", "newsletter", "signup", "login", "subscribe", "contact"],
    "comments": ["comments", "comment", "reply", "replies", "discussion", "disqus", "respond", "reader", "thread"],
    "share": ["share", "sharing", "social", "buttons", "follow"],
}
CONTENT = ["article", "content", "post", "entry", "story", "main", "body", "text", "page", "wrapper", "container"]
TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "ad": ["div", "aside", "ins"],
        "notice": ["div", "section"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeiou") + rng.choice("bcdfghlmnprst") for _ in range(rng.randint(1, 4))) for _ in range(n))


def _sentences(rng: random.Random, n: int) -> str:
    return " ".join(_words(rng, rng.randint(3, 18)).capitalize() + rng.choice("...?!") for _ in range(n))


def _named(rng: random.Random, tag: str, names: list[str], y: int, inner: str, share: float = 0.8) -> str:
    name = f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"' if rng.random() < share else ""
    return f'<{tag}{name} data-y="{y}">{inner}</{tag}>'


def _boiler(rng: random.Random, kind: str) -> str:
    link = lambda n: f'<a href="/x">{_words(rng, n)}</a>'
    if kind in ("nav", "share"):
        items = "".join(f"<li>{link(rng.randint(1, 2))}</li>" for _ in range(rng.randint(2, 8)))
        inner = items if rng.random() < 0.2 else f"<ul>{items}</ul>"
    elif kind == "header":
        inner = rng.choice([link(2), f"<h1>{_words(rng, 2)}</h1>", f"<h2>{link(2)}</h2>"]) + (f"<p>{_words(rng, rng.randint(2, 6))}</p>" if rng.random() < 0.5 else "") + (_boiler(rng, "nav") if rng.random() < 0.4 else "")
    elif kind == "footer":
        inner = rng.choice(["&copy; ", "", "<p>"]) + _sentences(rng, rng.randint(1, 3)) + (link(2) if rng.random() < 0.5 else "")
    elif kind == "aside":
        inner = f"<h3>{_words(rng, 2)}</h3>" + "".join(rng.choice([f"<li>{link(3)}</li>", f"<p>{_sentences(rng, 1)}</p>"]) for _ in range(rng.randint(1, 5)))
    elif kind == "comments":
        inner = "".join(rng.choice([f"<p>{_sentences(rng, rng.randint(1, 4))}</p>", f'<div class="comment">{_words(rng, 2)}: {_sentences(rng, 2)}</div>', f"<li><b>{_words(rng, 1)}</b> {_sentences(rng, 2)}</li>"]) for _ in range(rng.randint(1, 5)))
    elif kind == "form":
        inner = f"<label>{_words(rng, 2)}</label><input name=q><button>{_words(rng, 1)}</button>" + (f"<p>{_sentences(rng, 1)}</p>" if rng.random() < 0.3 else "")
    else:
        inner = rng.choice(["", "<p>"]) + _sentences(rng, rng.randint(1, 3)) + (f"<button>{_words(rng, 1)}</button>" if rng.random() < 0.3 else "")
    tag = rng.choice(TAGS[kind])
    plain = tag in ("div", "section", "ul", "ol", "ins")
    return _named(rng, tag, BOILER[kind], 0, inner, 1.0 if plain else 0.4)


def _article(rng: random.Random) -> str:
    parts = [f"<h1>{_words(rng, rng.randint(2, 10))}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 20])):
        r = rng.random()
        body = _sentences(rng, rng.choice([1, 1, 2, 4, 8, 20])) if rng.random() < 0.85 else _words(rng, rng.choice([1, 3, 20, 150]))
        if rng.random() < 0.3:
            body = rng.choice([f"<b>{body}", f"<em>{body}</em>", f'{body} <a href="/y">{_words(rng, 2)}</a> {_sentences(rng, 2)}', body + "<br>"])
        if r < 0.72:
            parts.append(f"<p>{body}" + ("</p>" if rng.random() < 0.8 else ""))
        elif r < 0.78:
            parts.append(f"<h2>{_words(rng, 3)}</h2><p>{body}</p>")
        elif r < 0.84:
            parts.append("<ul>" + "".join(f"<li>{_sentences(rng, 1)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif r < 0.91:  # what an article lists may be links
            parts.append("<ul>" + "".join(f'<li><a href="/z">{_words(rng, rng.randint(1, 3))}</a></li>' for _ in range(rng.randint(2, 4))) + "</ul>")
        elif r < 0.94:
            parts.append(f"<blockquote><p>{body}</p></blockquote>")
        elif r < 0.97:
            parts.append("<table>" + "".join(f"<tr><td>{_words(rng, 2)}</td><td>{_words(rng, 2)}</td></tr>" for _ in range(3)) + "</table>")
        else:
            parts.append(f"<pre>{body}</pre>")
        if rng.random() < 0.08:
            parts.append(_boiler(rng, rng.choice(["ad", "share", "aside", "form", "notice"])))
    if rng.random() < 0.08:  # a line said over and over
        parts += [f"<p>{_sentences(rng, 1) if rng.random() < 0.5 else _words(rng, 1)}</p>"] * rng.randint(10, 80)
    if rng.random() < 0.15:
        parts.append(_boiler(rng, "comments"))
    tag = rng.choice(["article", "article", "article", "main", "div", "section", ""])
    if not tag:  # straight in the page's body
        return re.sub(r"<(p|h1|h2|ul|blockquote|table|pre)>", r'<\1 data-y="1">', "".join(parts))
    return _named(rng, tag, CONTENT, 1, "".join(parts), 1.0 if tag in ("div", "section") else 0.4)


SECTIONS = re.compile(r"<(/?)(?:article|nav|header|footer|aside|main|section)\b")


def labelled_pages(n: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> list[str]:
    """Pages whose elements say in data-y from where on they are content (1) or not (0).

    A third has no sectioning tags, so that those alone tell nothing; some articles lie in
    nested divs without names, and some pages are an article and nothing else.
    """
    rng, out = random.Random(seed), []
    for _ in range(n):
        article = _article(rng)
        if rng.random() < 0.1:
            out.append(f'<div data-y="1">{article}</div>' if rng.random() < 0.5 else re.sub(r"<(p|h1|h2|ul|blockquote|table|pre)>", r'<\1 data-y="1">', article))
            continue
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            article = f'<div data-y="1">{article}</div>'
        before = [_boiler(rng, k) for k in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.5]
        after = [_boiler(rng, k) for k in ("share", "comments", "aside", "ad", "form", "footer", "notice") if rng.random() < 0.5]
        inner = "".join([*before, article, *after])
        if rng.random() < 0.3:
            inner = _named(rng, "div", CONTENT, 0, inner)
        page = f'<!DOCTYPE html><html data-y="0"><head></head><body>{inner}</body></html>'
        out.append(SECTIONS.sub(r"<\1div", page) if rng.random() < 0.33 else page)
    return out


@lru_cache(maxsize=1)
def model() -> TreeModel:
    pages = []
    for page in labelled_pages():
        nodes, pieces = parse(page)
        y = []
        for node in nodes:
            own = attributes(node).get("data-y")
            y.append(int(own) if own is not None else y[node.parent] if node.parent >= 0 else 0)
        pages.append((nodes, observe(nodes, pieces), y))
    return TreeModel(pages)


def extract(page: str | None, fitted: TreeModel | None = None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    nodes, pieces = parse(page)
    if len(nodes) == 1:
        keep = [1.0]
    else:
        keep = (fitted or model()).marginals(nodes, observe(nodes, pieces))
    blocks, block = [], []
    for k, text in [*pieces, (0, None)]:
        if text is None:
            joined = " ".join("".join(block).split())
            if joined:
                blocks.append(joined)
            block = []
        elif keep[k] >= 0.5:
            block.append(text)
    return "\n".join(blocks)


def extract_text(pages: DataFrame, html: str = "html", column: str = "text") -> DataFrame:
    """pages with the main text in place of the html."""
    from pyspark.sql import types as T

    kept = [f for f in pages.schema.fields if f.name not in (html, column)]
    rows = pages.select(html, *(f.name for f in kept))
    sent = pages.sparkSession.sparkContext.broadcast(model())  # of the size of its features, which the layouts bound

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([extract(p, sent.value) for p in b.column(0).to_pylist()], pa.string()), *b.columns[1:]], names=[column, *(f.name for f in kept)])

    return rows.transform(mapped, run, T.StructType([T.StructField(column, T.StringType()), *kept]))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
