"""Reading one page or feed into plain strings. What the strings mean is decided later, in
column expressions; nothing here knows about dates, links or publishers."""

from __future__ import annotations

import re
from contextlib import contextmanager
from html.parser import HTMLParser
from xml.parsers import expat

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# An opening tag that ends an open element of these kinds, and the kinds that shield it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, {"table", "td", "th"}),
}
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr main menu nav ol p pre section summary table ul li dt dd".split()
)
_CELLS = frozenset(["td", "th", "caption", "table"])
_TABLE_PARTS = frozenset(["table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"])
_SHIELDS_PARAGRAPH = frozenset("table td th caption button object html".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def elements(self):
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self):
        """Descendant elements in document order."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements()[::-1])

    def text(self) -> str:
        """Text nodes below this element, joined by and collapsed to single spaces."""
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                stack.extend(node.children[::-1])
        return " ".join(" ".join(parts).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.glue = False

    def _close(self, kinds, shields):
        node, last = self.at, None
        while node.parent is not None and node.tag not in shields:
            if node.tag in kinds:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag, attrs):
        self.glue = False
        if tag in _ENDS_PARAGRAPH:
            self._close({"p"}, _SHIELDS_PARAGRAPH)
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag == "tr" and self.at.tag == "table":
            self._open("tbody", {})
        if tag in ("td", "th") and self.at.tag in ("table", "tbody", "thead", "tfoot"):
            self.handle_starttag("tr", [])
        self._open(tag, {k: v or "" for k, v in reversed(attrs)})
        if tag in _VOID:
            self.at = self.at.parent

    def _open(self, tag, attrs):
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.glue = False
        node = self.at
        while node is not None and node.tag != tag:
            if node.tag in _CELLS and tag not in _TABLE_PARTS:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_comment(self, data):
        self.glue = False

    def handle_data(self, data):
        children = self.at.children
        if self.glue and children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)
        self.glue = True


def parse_html(text: str) -> Node:
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root


@contextmanager
def parsed_html(text: str):
    """``parse_html`` for as long as its tree is needed. Nodes and their parents refer to each
    other; undone, a tree goes at once and not with some later collection."""
    root = parse_html(text)
    try:
        yield root
    finally:
        stack = [root]
        while stack:
            node = stack.pop()
            stack.extend(node.elements())
            node.parent, node.children = None, []


def html_text(text: str) -> str:
    """Text of an HTML fragment."""
    if "<" not in text and "&" not in text:
        return " ".join(text.split())
    with parsed_html(text) as root:
        return root.text()


_STEP = re.compile(
    r"""\s*(?P<child>>)?\s*(?P<compound>(?:[\w-]+|[.\#][\w-]+|\[[^\]]+\]|:[\w-]+(?:\(\d+\))?)+)"""
)
_SIMPLE = re.compile(
    r"""(?P<tag>^[\w-]+)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|:(?P<pseudo>[\w-]+)(?:\((?P<n>\d+)\))?"""
    r"""|\[(?P<attr>[\w-]+)(?:(?P<op>[*]?=)'(?P<value>[^']*)')?\]"""
)


_compiled: dict[str, list] = {}


def compile_selector(css: str) -> list:
    """Selector list -> alternatives of (child-of-previous?, [simple tests]) steps. Kept per
    worker: profiles hold a few dozen selectors."""
    if css in _compiled:
        return _compiled[css]
    alternatives = []
    for one in css.split(","):
        steps, end = [], 0
        one = one.strip()
        while end < len(one):
            found = _STEP.match(one, end)
            if found is None:
                raise ValueError(f"unsupported selector: {css}")
            tests = [m.groupdict() for m in _SIMPLE.finditer(found["compound"])]
            steps.append((found["child"] is not None, tests))
            end = found.end()
        alternatives.append(steps)
    _compiled[css] = alternatives
    return alternatives


def _passes(node: Node, test: dict) -> bool:
    if test["tag"]:
        return node.tag == test["tag"]
    if test["cls"]:
        return test["cls"] in node.attrs.get("class", "").split()
    if test["id"]:
        return node.attrs.get("id") == test["id"]
    if test["attr"]:
        value = node.attrs.get(test["attr"])
        if value is None or test["op"] is None:
            return value is not None
        return value == test["value"] if test["op"] == "=" else bool(test["value"]) and test["value"] in value
    siblings = node.parent.elements()
    if test["pseudo"] == "last-child":
        return siblings[-1] is node
    place = int(test["n"]) if test["pseudo"] == "nth-child" else 1
    return len(siblings) >= place and siblings[place - 1] is node


def _matches(node: Node | None, steps: list) -> bool:
    if node is None or node.parent is None or not all(_passes(node, t) for t in steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    if steps[-1][0]:
        return _matches(node.parent, steps[:-1])
    above = node.parent
    while above is not None:
        if _matches(above, steps[:-1]):
            return True
        above = above.parent
    return False


def select(scope: Node, css: str):
    """Descendants of ``scope`` that match, in document order."""
    alternatives = compile_selector(css)
    return (n for n in scope.walk() if any(_matches(n, steps) for steps in alternatives))


def select_first(scope: Node, css: str | None) -> Node | None:
    return next(select(scope, css), None) if css else None


# Feed elements that carry HTML.
_MARKUP_FIELDS = frozenset(["description", "summary", "content", "encoded"])


def feed_fields(text: str) -> list[list[tuple[str, str]]]:
    """Per top-level item or entry, its (name, text) leaves in document order, names in
    lower case without prefix; ``link@href`` stands for a link attribute. Raises ValueError
    for text that is no well-formed XML."""
    items: list[list[tuple[str, str]]] = []
    current: list[tuple[str, str]] = []
    depth = 0
    open_leaf: list[str] | None = None
    leaf_name = ""

    def local(name):
        return name.rsplit(":", 1)[-1].lower()

    def start(name, attrs):
        nonlocal depth, open_leaf, leaf_name, current
        name = local(name)
        if name in ("item", "entry"):
            if depth == 0:
                current = []
            depth += 1
            open_leaf = None
        elif depth == 1:
            if name == "link":
                href = next((v for k, v in attrs.items() if local(k) == "href"), None)
                if href is not None:
                    current.append(("link@href", href))
            leaf_name, open_leaf = name, []

    def end(name):
        nonlocal depth, open_leaf
        if local(name) in ("item", "entry"):
            depth = max(0, depth - 1)
            if depth == 0:
                items.append(current)
        elif depth == 1 and open_leaf is not None:
            value = "".join(open_leaf).strip()
            if value:
                current.append((leaf_name, value))
        open_leaf = None

    def data(chunk):
        if depth == 1 and open_leaf is not None:
            open_leaf.append(chunk)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(text.lstrip("﻿").lstrip(), True)
    except expat.ExpatError as error:
        # A document that just stops between two tags keeps the items read so far.
        if error.code != expat.errors.codes[expat.errors.XML_ERROR_NO_ELEMENTS]:
            raise ValueError(str(error)) from error
    return items


def flatten_feed(text: str) -> list[list[dict[str, str]]]:
    """``feed_fields`` as rows; fields that carry HTML are reduced to their text."""
    return [
        [{"name": name, "value": value, "plain": html_text(value) if name in _MARKUP_FIELDS else None}
         for name, value in fields]
        for fields in feed_fields(text)
    ]
