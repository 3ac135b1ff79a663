"""A small HTML tree builder: enough of the parsing rules for extraction, in one pass over the text."""

from __future__ import annotations

import html
import re
from collections import Counter

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
MAX_DEPTH = 200  # deeper elements become neighbours of those at this depth, so that no page nests without bound; their text stays
#: An open element on the left is ended by the start of one on the right, up to the nearest of its bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
CLOSES |= {x: ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}) for x in ("tbody", "thead", "tfoot")}
P_ENDS = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option", "optgroup", "frameset"}
P_BOUNDS = frozenset("table td th caption button object html".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    __slots__ = ("children", "marks", "tag")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks, self.children = tag, marks, []

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.marks}" if self.marks else self.tag


def marks_of(attributes: str) -> str:
    """Class, id and role in lower case; digits are left out, as they number pages and not parts."""
    if "=" not in attributes:
        return ""
    found = [re.sub(r"\d+", "", html.unescape(a or b or c).lower()) for _, a, b, c in _MARK.findall(attributes)]
    return " ".join(x for m in found for x in m.split())


def parse(source: str) -> Node:
    """The tree under a root node; texts are str children with their references decoded."""
    root = Node("#root")
    stack, at, n = [root], 0, len(source)
    opened: Counter = Counter()  # tags on the stack, so that it is searched only for what it holds

    def end(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].children.append(html.unescape(source[at:lt]) if "&" in source[at:lt] else source[at:lt])
            at = lt
            continue
        m = _TAG.match(source, at) or _LOOSE.match(source, at)
        if m is None:  # a lone "<" is text
            stack[-1].children.append("<")
            at += 1
            continue
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag] > 0:
                end(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            continue
        if tag in P_ENDS and opened["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    end(k)
                    break
                if stack[k].tag in P_BOUNDS:
                    break
        if tag in CLOSES and any(opened[x] > 0 for x in CLOSES[tag][0]):
            ends, bounds = CLOSES[tag]
            last = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in ends:
                    last = k
            if last is not None:
                end(last)
        node = Node(tag, marks_of(m[3]))
        stack[min(len(stack) - 1, MAX_DEPTH)].children.append(node)
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            if tag in ("textarea", "title"):
                node.children.append(html.unescape(source[at : over.start() if over else n]))
            at = over.end() if over else n
            continue
        stack.append(node)
        opened[tag] += 1
    return root
