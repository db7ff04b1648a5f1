"""A forgiving HTML reader: elements with parents, and the text runs between tags.

One pass: what a failed search has shown not to come is never searched for again, and open
elements are found through stacks by name, so broken pages cost no more than whole ones.
"""

from __future__ import annotations

import html
import re

OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[A-Za-z])")
NAME = re.compile(r"[^\s/>]+")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
#: A start tag closes an open element of these names first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: ... but not beyond these.
SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "nav", "div", "aside", "main"}


MARKED = SCOPE.union(*CLOSES.values())


class Node:
    __slots__ = ("tag", "attributes", "parent", "order")

    def __init__(self, tag: str, attributes: str, parent: int, order: int):
        self.tag, self.attributes, self.parent, self.order = tag, attributes, parent, order


class Page:
    """Finds in a text, each of which remembers when nothing more comes."""

    def __init__(self, text: str):
        self.text, self.last, self.quotes = text, {}, True

    def find(self, what: str, at: int) -> int:
        if what not in self.last:
            self.last[what] = self.text.rfind(what)
        return self.text.find(what, at) if self.last[what] >= at else -1

    def tag_end(self, at: int) -> int:
        """Of a tag whose name ends at a place: the place of its ">", quoted ones left out; -1 for none."""
        first = self.find(">", at)
        if first < 0:
            return -1
        while self.quotes and (m := STOP.search(self.text, at)):
            if m[0] == ">":
                return m.start()
            quoted = self.text[at : m.start()].rstrip()[-1:] == "="
            close = self.find(m[0], m.end()) if quoted else m.start()
            if close < 0:  # a quote that nothing closes is none
                after = self.find(">", m.end())
                if after >= 0:
                    return after
                break
            at = close + 1
        self.quotes = False  # quotes that take all the ends are none from here on
        return first


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(elements in page order, parents first; pieces in page order): a piece is (element, text),
    text None where a block begins or ends. Node 0 is the page itself."""
    nodes, pieces, open_ = [Node("#page", "", -1, 0)], [], [0]
    named: dict[str, list[int]] = {}  # places in open_ by name
    blocks: list[int] = []  # ... of all that are not inline
    marks: list[int] = []  # ... of those that CLOSES or SCOPE name
    here, at, end = Page(page), 0, len(page)
    raw_ends: dict[str, re.Pattern | None] = {}

    def text(piece: str) -> None:
        if piece:
            pieces.append((open_[-1], html.unescape(piece) if "&" in piece else piece))

    def close(k: int) -> None:
        for n in open_[k:]:
            if nodes[n].tag not in INLINE:
                pieces.append((nodes[n].parent, None))
            named[nodes[n].tag].pop()
        del open_[k:]
        for places in (blocks, marks):
            while places and places[-1] >= k:
                places.pop()

    while at < end:
        m = OPEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at, kind = m.end(), m[0]
        if kind == "<!--":
            stop = here.find("-->", at)
            at = stop + 3 if stop >= 0 else end
            continue
        if kind == "<![CDATA[" and (stop := here.find("]]>", at)) >= 0:
            text(page[at:stop])
            at = stop + 3
            continue
        if kind[1] in "!?":
            stop = here.find(">", at)
            at = stop + 1 if stop >= 0 else end
            continue
        name = NAME.match(page, at - 1)
        stop = here.tag_end(name.end())
        if stop < 0:  # no tag: the sign is text
            text(kind)
            continue
        tag, rest, at = name[0].lower(), page[name.end() : stop], stop + 1
        if kind[1] == "/":  # an end tag closes the nearest open element of its name
            if named.get(tag):
                close(named[tag][-1])
            continue
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif tag not in INLINE:
                pieces.append((open_[-1], None))
            continue
        if tag in RAW:
            if not rest.rstrip().endswith("/"):
                ends = raw_ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*>", re.I))
                found = ends.search(page, at) if ends else None
                if not found:
                    raw_ends[tag] = None
                at = found.end() if found else end if tag in ("script", "style") else at
            continue
        if tag not in INLINE and blocks and nodes[open_[blocks[-1]]].tag == "p":  # a block ends an open paragraph
            close(blocks[-1])
        closed = CLOSES.get(tag, ())
        for k in reversed(marks) if closed else ():
            other = nodes[open_[k]].tag
            if other in closed:
                close(k)
                break
            if other in SCOPE:
                break
        if tag not in INLINE:
            pieces.append((open_[-1], None))
            blocks.append(len(open_))
        if tag in MARKED:
            marks.append(len(open_))
        named.setdefault(tag, []).append(len(open_))
        nodes.append(Node(tag, rest, open_[-1], len(nodes)))
        open_.append(len(nodes) - 1)
    close(1)
    return nodes, pieces


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(node.attributes)}
