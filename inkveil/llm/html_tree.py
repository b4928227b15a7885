"""A tolerant HTML parser: a page becomes a tree of elements with text blocks as leaves, in time linear in the page."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>=]")
_SPACE = re.compile(r"\s*")
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
OPAQUE = frozenset("script style noscript template head title iframe object svg annotation annotation-xml canvas audio video select datalist textarea".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Formatting, and formulas, whose text belongs to the block around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr button input meter output progress "
    "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mstyle munder mover munderover mtable mtr mtd mpadded mphantom menclose merror mfenced".split()
)
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_SAME = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)), "option": (("option",), ("select",))}
#: What a closing tag doesn't reach beyond, unless it is one of the second.
_BARRIER, _BEYOND = ("td", "th", "table"), frozenset("table tr tbody thead tfoot body html".split())


class Node:
    """An element, or a text block (``tag`` is ``#text``)."""

    __slots__ = ("tag", "names", "parent", "text", "linked", "children")

    def __init__(self, tag: str, names: str, parent: int):
        self.tag, self.names, self.parent, self.text, self.linked, self.children = tag, names, parent, "", 0, 0


def _names(attrs: str) -> str:
    """The values of the attributes that say what an element is for."""
    out = []
    for m in _ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id", "role", "itemprop", "aria-label", "hidden", "style"):
            out.append(m[1].lower() if m[1].lower() == "hidden" else (m[2] or m[3] or m[4] or ""))
    return " ".join(out).lower()


class _Source:
    """The page's text, cut into tags. What isn't there beyond some place is remembered, so nothing is searched for twice."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in "\"'>"}
        self.gone: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        """``html.find``; after it has failed once it fails at once further on."""
        if at >= self.gone.get(what, len(self.html) + 1):
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.gone[what] = at
        return found

    def tag_end(self, at: int) -> int:
        """The place after the ``>`` that ends a tag, or -1. Quotes hold only values of attributes, after ``=``; a quote
        that nothing closes holds none."""
        html = self.html
        while True:
            if at > self.last[">"]:
                return -1
            m = _STOP.search(html, at)
            if m[0] == ">":
                return m.end()
            at = _SPACE.match(html, m.end()).end()
            quote = html[at : at + 1]
            if quote in ('"', "'"):
                if self.last[quote] == at:
                    return self.find(">", at) + 1 or -1
                at = html.index(quote, at + 1) + 1


class _Frame:
    """An open block element: its place in the tree, and how often each inline element is open in it."""

    __slots__ = ("tag", "node", "inline")

    def __init__(self, tag: str, node: int):
        self.tag, self.node, self.inline = tag, node, Counter()


def parse(html: str) -> list[Node]:
    """The nodes in page order, parents before children; node 0 is the root. Inline elements are no nodes: their text
    belongs to the block around them, and how much of it lies in links is counted. A block that other blocks interrupt
    gives a text leaf for each piece. White space is one space, ends are trimmed, references are decoded. A tag or
    comment that the page's end cuts short is left out; ``<`` before anything else is text."""
    nodes = [Node("#root", "", -1)]
    stack = [_Frame("#root", 0)]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
    source, n = _Source(html), len(html)
    held: list[str] = []
    opaque, links, linked, at = 0, 0, 0, 0
    innermost = lambda tags: max((places[t][-1] for t in tags if places[t]), default=0)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                leaf = Node("#text", "", stack[-1].node)
                leaf.text, leaf.linked = text, min(linked, len(text))
                nodes[stack[-1].node].children += 1
                nodes.append(leaf)
        linked = 0

    def close(depth: int) -> None:
        nonlocal opaque, links
        flush()
        for frame in stack[depth:]:
            opaque -= frame.tag in OPAQUE
            links -= frame.inline["a"]
            places[frame.tag].pop()
        del stack[depth:]

    def take(text: str) -> None:
        nonlocal linked
        if not opaque:
            held.append(text)
            if links:
                linked += len(text.strip())

    while at < n:
        begin = source.find("<", at)
        if begin < 0:
            take(html[at:])
            break
        if begin > at:
            take(html[at:begin])
        mark = html[begin + 1 : begin + 2]
        if mark == "!" or mark == "?":
            if html.startswith("<!--", begin):
                end, size = source.find("-->", begin + 4), 3
            elif html.startswith("<![CDATA[", begin):
                end, size = source.find("]]>", begin + 9), 3
            else:
                end, size = source.find(">", begin), 1
            at = end + size if end >= 0 else n
            continue
        if mark == "/":
            name = _NAME.match(html, _SPACE.match(html, begin + 2).end())
            if not name:
                take("<")
                at = begin + 1
                continue
            end = source.find(">", name.end())
            if end < 0:
                break
            at, tag = end + 1, name[0].lower()
            if tag == "br":
                take(" ")
            elif tag in INLINE:  # formatting closes within its block; blocks inside it stay
                inline = stack[-1].inline
                if inline[tag]:
                    inline[tag] -= 1
                    links -= tag == "a"
            elif tag == "p" and not places["p"]:
                flush()
            elif places[tag] and (tag in _BEYOND or tag in _BARRIER or places[tag][-1] > innermost(_BARRIER)):
                close(places[tag][-1])
            continue
        name = _NAME.match(html, begin + 1)
        if not name:
            take("<")
            at = begin + 1
            continue
        end = source.tag_end(name.end())
        if end < 0:
            break
        attrs, at, tag = html[name.end() : end - 1], end, name[0].lower()
        if tag in ("html", "body"):
            flush()
            if places["head"]:
                close(places["head"][0])
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                take(" ")
            continue
        if tag in INLINE:
            if not opaque and not attrs.rstrip().endswith("/"):
                stack[-1].inline[tag] += 1
                links += tag == "a"
            continue
        if tag in _CLOSES_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in _SAME:
            same, stop = _SAME[tag]
            if innermost(same) > innermost(stop):
                close(innermost(same))
        flush()
        if attrs.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        # Open formatting carries on inside, but a new block starts with none of it on its path.
        parent = stack[-1].node
        nodes[parent].children += 1
        nodes.append(Node(tag, _names(attrs), parent))
        places[tag].append(len(stack))
        stack.append(_Frame(tag, len(nodes) - 1))
        opaque += tag in OPAQUE
        if tag in RAW:
            close(len(stack) - 1)
            shut = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            end = source.find(">", shut.end()) if shut else -1
            at = end + 1 if end >= 0 else n
    close(1)
    flush()
    return nodes
