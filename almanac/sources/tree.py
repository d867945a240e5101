"""A small HTML tree on the standard parser, with the few queries that extraction needs."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag on the left closes open ones on the right, up to the nearest table or list.
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "p": {"p"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
FENCES = {"table", "ul", "ol", "dl", "html"}


class Node:
    """An element; texts stand among its children as strings."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    @property
    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                yield x
                todo.extend(reversed(x.children))

    def texts(self) -> Iterator[str]:
        """All texts below, in document order."""
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            else:
                todo.extend(reversed(x.children))

    @property
    def text(self) -> str:
        return "".join(self.texts())

    @property
    def clean(self) -> str:
        """The text with its white space collapsed."""
        return " ".join(self.text.split())

    @property
    def own(self) -> list[str]:
        """Texts directly inside."""
        return [x for x in self.children if isinstance(x, str)]

    def fits(self, one: str) -> bool:
        """Matches 'tag.class.class', 'tag#id' or '.class', tag optional."""
        head, *classes = one.split(".")
        tag, _, ident = head.partition("#")
        return (not tag or self.tag == tag) and (not ident or self.attrs.get("id") == ident) and (not classes or set(classes) <= self.classes)

    def all(self, path: str) -> list[Node]:
        """Elements at the end of a descending path; '>' before a step asks for a direct child."""
        found, direct = [self], False
        for step in path.split():
            if step == ">":
                direct = True
                continue
            nxt: dict[int, Node] = {}
            for node in found:
                for x in (c for c in node.children if isinstance(c, Node)) if direct else node.walk():
                    if x.fits(step):
                        nxt.setdefault(id(x), x)
            found, direct = list(nxt.values()), False
        return found

    def first(self, path: str) -> Node | None:
        found = self.all(path)
        return found[0] if found else None

    def text_at(self, path: str) -> str:
        """First text, stripped, of the first element at a path that has one; empty without."""
        for node in self.all(path):
            for t in node.texts():
                if t.strip():
                    return t.strip()
        return ""

    def attr_at(self, path: str, name: str) -> str:
        for node in self.all(path):
            if name in node.attrs:
                return node.attrs[name].strip()
        return ""


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        shut = CLOSES.get(tag)
        if shut:
            node, cut = self.at, None
            while node.parent and node.tag not in FENCES:
                if node.tag in shut:
                    cut = node
                node = node.parent
            if cut is not None and cut.parent is not None:
                self.at = cut.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent and node.tag != tag:
            if node.tag in FENCES and tag not in FENCES:
                return
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
