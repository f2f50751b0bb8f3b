"""A small tolerant reader of HTML: enough of a tree to hash subtrees and to tell blocks apart."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">]|["'])*?)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: elements that begin and end a block of text
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select
summary table tbody td tfoot th thead tr ul caption""".split())
#: a start tag of the key ends an open element of the values, if no element of the third group lies between
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead", "tfoot"),
           "tfoot": ("tr", "td", "th", "tbody", "thead"), "body": ("head",)}
_FENCE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"),
          "th": ("table", "tr"), "option": ("select", "datalist"), "tbody": ("table",), "tfoot": ("table",), "body": ("html",)}
_ENDS_P = BLOCK - {"option", "optgroup", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_P_FENCE = frozenset("td th table button object html body caption li div article section blockquote dd".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def __iter__(self) -> Iterator[Node | str]:
        return iter(self.children)


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")) if value else "")
    return out


def parse(text: str) -> Node:
    """The tree of a page: unclosed and stray tags are repaired, comments left out, references in text decoded.

    The time is in proportion to the length, also for pages that are broken or deeply nested.
    """
    root = Node("#page", {})
    stack, at, n = [root], 0, len(text)
    opened: dict[str, list[int]] = {}  # by tag: where in the stack its open elements are
    inline: list[dict[str, int]] = [{}]  # for every open block, the inline elements open directly in it

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop().tag
            opened[gone].pop()
            if gone in BLOCK:
                inline.pop()
            else:
                inline[-1][gone] -= 1

    def innermost(tags) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def depth_of(tags, fence) -> int | None:
        depth = innermost(tags)
        return depth if depth and depth > innermost(fence) else None

    while at < n:
        start = text.find("<", at)
        if start < 0:
            stack[-1].children.append(html.unescape(text[at:]))
            break
        found = _TOKEN.match(text, start)
        if found is None:  # a "<" that begins no tag is text
            end = text.find("<", start + 1)
            end = n if end < 0 else end
            stack[-1].children.append(html.unescape(text[at:end]))
            at = end
            continue
        if start > at:
            stack[-1].children.append(html.unescape(text[at:start]))
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "p" and not opened.get("p"):
                continue
            # an inline end tag doesn't end the blocks opened meanwhile
            if opened.get(tag) and (tag in BLOCK or inline[-1].get(tag)):
                pop_to(opened[tag][-1])
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            continue
        if tag in _ENDS_P and (depth := depth_of(("p",), _P_FENCE)) is not None:
            pop_to(depth)
        if tag in _CLOSES:
            while (depth := depth_of(_CLOSES[tag], _FENCE[tag])) is not None:
                pop_to(depth)
        node = Node(tag, _attrs(found[3]) if found[3].strip(" \t\n\r\f/") else {})
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
            end = close.start() if close else n
            node.children.append(text[at:end])
            at = text.find(">", end) + 1 if close else n
            at = at or n
        elif tag not in VOID and not (found[3].endswith("/") and tag in ("path", "rect", "circle", "use", "g", "svg")):
            opened.setdefault(tag, []).append(len(stack))
            stack.append(node)
            if tag in BLOCK:
                inline.append({})
            else:
                inline[-1][tag] = inline[-1].get(tag, 0) + 1
    return root


def walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Every element twice, without recursion: (element, False) on entering, (element, True) on leaving."""
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        yield node, leaving
        if not leaving:
            todo.append((node, True))
            todo.extend((c, False) for c in reversed(node.children) if isinstance(c, Node))


def squeeze(text: str) -> str:
    return " ".join(text.split())


def subtree_hashes(root: Node) -> dict[int, tuple[int, int]]:
    """By the element's ``id()``: (64-bit hash of tag, class, id and all that is below; characters of text below)."""
    out: dict[int, tuple[int, int]] = {}
    for node, leaving in walk(root):
        if not leaving:
            continue
        h = hashlib.blake2b(f"{node.tag}\0{squeeze(node.attrs.get('class', ''))}\0{node.attrs.get('id', '')}".encode(
            "utf-8", "surrogatepass"), digest_size=8)
        chars = 0
        for c in node.children:
            if isinstance(c, Node):
                own, size = out[id(c)]
                h.update(own.to_bytes(8, "little", signed=True))
                chars += size
            elif (t := squeeze(c)):
                h.update(b"\1" + t.encode("utf-8", "surrogatepass"))
                chars += len(t)
        out[id(node)] = int.from_bytes(h.digest(), "little", signed=True), chars
    return out
