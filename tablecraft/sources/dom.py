"""A small element tree over ``html.parser`` for table extraction from one page."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BREAKS = {"br", "p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section"}
HIDDEN = {"script", "style", "noscript", "template"}
# An opening tag ends the open element of the listed kinds, up to the given container.
IMPLIED_END = {
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "li": ({"li"}, {"ul", "ol"}),
    "p": ({"p"}, {"div", "td", "li", "section", "body"}),
}


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    @property
    def children(self) -> list["Node"]:
        return [k for k in self.kids if isinstance(k, Node)]

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator["Node"]:
        """Elements below this one in document order."""
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def all(self, test: Callable[["Node"], bool]) -> list["Node"]:
        return [n for n in self.walk() if test(n)]

    def tagged(self, *names: str) -> list["Node"]:
        return self.all(lambda n: n.tag in names)

    def ancestors(self) -> Iterator["Node"]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def closest(self, test: Callable[["Node"], bool]) -> "Node | None":
        return next((n for n in [self, *self.ancestors()] if test(n)), None)

    def text(self) -> str:
        """Visible text: blanks folded, line breaks at block elements."""
        parts: list[str] = []
        stack: list = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(re.sub(r"\s+", " ", item))
            elif item.tag not in HIDDEN:
                if item is not self and item.tag in BREAKS:
                    parts.append("\n")
                    stack.append("\n" if item.tag != "br" else "")
                stack.extend(reversed(item.kids))
        lines = (re.sub(r" +", " ", line).strip() for line in "".join(parts).split("\n"))
        return "\n".join(line for line in lines if line)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in IMPLIED_END:
            ends, limits = IMPLIED_END[tag]
            node, last = self.open, None
            while node.parent is not None and node.tag not in limits:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None:
                self.open = last.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.kids.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open = self.open.parent

    def handle_endtag(self, tag):
        node = self.open
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.kids.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
