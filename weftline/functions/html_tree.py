"""A tree of a page for path expressions: no element ends another, so whatever isn't closed holds what follows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from weftline.functions.html_events import EMPTY, END, START, events


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo.extend(reversed(node.children))
        return "".join(out)


def parse(page: str) -> Node:
    """Null-safe and total. Elements without content hold what follows, too, until one around them ends; self-closing tags are left out."""
    root = Node("")
    path, places = [root], defaultdict(list)
    for kind, name, attrs in events(page or ""):
        if kind == START:
            node = Node(name, {k: v or "" for k, v in attrs.items()}, path[-1])
            path[-1].children.append(node)
            places[name].append(len(path))
            path.append(node)
        elif kind == END:
            if places[name]:
                depth = places[name][-1]
                while len(path) > depth:
                    places[path.pop().tag].pop()
        elif kind != EMPTY:
            path[-1].children.append(name)
    return root
