"""A tolerant HTML tree on the standard library's event parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

#: Elements without content, and those that a sibling of the same kind closes.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
SELF_CLOSING = {"li": {"li"}, "p": {"p"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
HIDDEN = frozenset(("script", "style", "noscript", "template"))


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self, skip: frozenset[str] = frozenset()) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in skip:
                stack.extend(reversed(item.children))

    def text(self, separator: str = "", skip: frozenset[str] = frozenset()) -> str:
        return separator.join(self.strings(skip))

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.at.tag in SELF_CLOSING.get(tag, ()):
            self.at = self.at.parent or self.root
        first: dict[str, str] = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        node = Node(tag, first, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent or self.root

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root:
            if node.tag == tag:
                self.at = node.parent or self.root
                return
            node = node.parent or self.root

    def handle_data(self, data: str) -> None:
        if data:
            self.at.children.append(data)


class Document:
    """A parsed page: its elements in order, by tag when asked."""

    def __init__(self, html: str) -> None:
        builder = _Builder()
        builder.feed(html)
        builder.close()
        self.root = builder.root
        self.nodes = list(self.root.walk())
        self.by_tag: dict[str, list[Node]] = {}
        self.by_attribute: dict[str, list[Node]] = {}
        for n in self.nodes:
            self.by_tag.setdefault(n.tag, []).append(n)
            for name in n.attrs:
                self.by_attribute.setdefault(name, []).append(n)

    def all(self, *tags: str, attr: str | None = None) -> list[Node]:
        if not tags:
            return self.nodes if attr is None else self.by_attribute.get(attr, [])
        found = self.by_tag.get(tags[0], []) if len(tags) == 1 else [n for n in self.nodes if n.tag in tags]
        return found if attr is None else [n for n in found if attr in n.attrs]

    def title(self) -> Node | None:
        """The title of the head (also where the head's tag is left out)."""
        for n in self.nodes:
            if n.tag == "body":
                return None
            if n.tag == "title" and n.parent is not None and n.parent.tag in ("head", "html", "#document"):
                return n
        return None

    def visible_text(self, separator: str = " ", extra: tuple[str, ...] = ()) -> str:
        return self.root.text(separator, HIDDEN | frozenset(extra))

    def json_ld(self) -> Iterator[str]:
        for n in self.all("script"):
            if n.get("type") == "application/ld+json":
                yield n.text()
