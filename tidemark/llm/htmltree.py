"""A small HTML tree: elements with their text runs in page order, for whole pages."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*?)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Kinds of elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "html head body article section nav aside header footer main address div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd "
    "blockquote pre figure figcaption table caption thead tbody tfoot tr td th form fieldset legend details summary dialog "
    "center hr menu search".split()
)
#: Inline elements that are nodes of their own even without a name.
NODES = frozenset(("a", "button", "label", "select", "option", "svg"))
CLOSES_P = BLOCK - {"html", "head", "body", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "legend", "summary", "figcaption"}
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}
SCOPE = frozenset("td th table caption article section main aside nav header footer div body html".split())


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    parent: int
    depth: int
    own: int = 0  # characters of text directly inside, inline elements without names included


@dataclass
class Tree:
    nodes: list[Node]
    runs: list[tuple[int, int, str, bool]]  # (block number, node, decoded text, within a link), in page order


def parse(page: str) -> Tree:
    """Blocks and named inline elements become nodes; other inline text belongs to the node around
    it. A block number stands for a run of inline content that no block interrupts."""
    nodes = [Node("#page", {}, -1, 0)]
    stack: list[tuple[str, int]] = [("#page", 0)]  # tag and node it belongs to
    runs: list[tuple[int, int, str, bool]] = []
    block, at, n, links = 0, 0, len(page), 0

    def text(raw: str) -> None:
        if raw:
            t = html.unescape(raw) if "&" in raw else raw
            node = stack[-1][1]
            nodes[node].own += len(t)
            runs.append((block, node, t, links > 0))

    def cut(depth: int) -> None:
        """Close the elements above ``depth``; a closed block ends its run of content."""
        nonlocal block, links
        links -= sum(t == "a" for t, _ in stack[depth:])
        if any(t in BLOCK for t, _ in stack[depth:]):
            block += 1
        del stack[depth:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    cut(i)
                    break
                if stack[i][0] in SCOPE and tag not in BLOCK:
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    cut(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        if tag in IMPLIED:
            closes, inside = IMPLIED[tag]
            lowest = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closes:
                    lowest = i
                elif stack[i][0] in inside:
                    break
            if lowest:
                cut(lowest)
        rest = m["rest"] or ""
        attrs = {a.lower(): html.unescape(b or c or d or "") for a, b, c, d in _ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
        if tag in BLOCK:
            block += 1
        node = stack[-1][1]
        if tag in BLOCK or tag in RAW or attrs.keys() & {"class", "id", "role", "style", "hidden", "aria-hidden"} or tag in NODES:
            if tag not in VOID:
                nodes.append(Node(tag, attrs, node, len(stack)))
                node = len(nodes) - 1
        if tag in VOID:
            if tag == "br":
                runs.append((block, node, "\n", False))
            continue
        if tag in RAW:  # what is inside isn't markup and isn't shown
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if not rest.endswith("/") or tag in BLOCK:
            stack.append((tag, node))
            links += tag == "a"
    return Tree(nodes, runs)
