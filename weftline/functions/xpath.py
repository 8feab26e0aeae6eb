"""A small XPath dialect over the lenient tree: ``/ // . @a text()`` and predicates with or, and, nested steps, contains(@class,'x'), @a='x', @a, last().

As the dialect has it, ``text()`` is all text below whatever its axis, ``contains`` looks for a part of the class, and
a predicate ``.//name`` holds where the element or one below has that name, whatever is asked of it in brackets.
"""

from __future__ import annotations

import re
from functools import lru_cache

from weftline.functions.html_tree import Node
from weftline.functions.text import collapse

_TOKEN = re.compile(r"\s*(//|/|\[|\]|\(|\)|=|,|@[\w-]+|'[^']*'|\"[^\"]*\"|\.//|\./|\.|text\(\)|last\(\)|position\(\)|contains|or\b|and\b|\*|[\w-]+)")


class _Parser:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise ValueError(f"XPath: {source[at:]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.k = 0

    def peek(self) -> str:
        return self.tokens[self.k] if self.k < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        token = self.peek()
        if want is not None and token != want:
            raise ValueError(f"XPath: {want!r} expected, not {token!r}")
        self.k += 1
        return token

    def path(self) -> tuple:
        """Steps (axis, test, predicates); axis is child, descendant, attribute or text."""
        steps, axis = [], "child"
        if self.peek() in (".//", "./", ".", "//", "/"):
            token = self.take()
            axis = "descendant" if token.endswith("//") else "child"
            if token == ".":
                if self.peek() not in ("/", "//"):
                    return ()
                axis = "descendant" if self.take() == "//" else "child"
        while True:
            token = self.take()
            if token.startswith("@"):
                steps.append(("attribute", token[1:].lower(), ()))
            elif token == "text()":
                steps.append(("text", "", ()))
            else:
                predicates = []
                while self.peek() == "[":
                    self.take()
                    predicates.append(self.either())
                    self.take("]")
                steps.append((axis, token.lower(), tuple(predicates)))
            if self.peek() not in ("/", "//"):
                return tuple(steps)
            axis = "descendant" if self.take() == "//" else "child"

    def either(self) -> tuple:
        parts = [self.both()]
        while self.peek() == "or":
            self.take()
            parts.append(self.both())
        return ("or", tuple(parts)) if len(parts) > 1 else parts[0]

    def both(self) -> tuple:
        parts = [self.one()]
        while self.peek() == "and":
            self.take()
            parts.append(self.one())
        return ("and", tuple(parts)) if len(parts) > 1 else parts[0]

    def one(self) -> tuple:
        token = self.peek()
        if token == "(":
            self.take()
            inner = self.either()
            self.take(")")
            return inner
        if token == "last()":
            self.take()
            return ("last",)
        if token == "position()":
            self.take()
            self.take("=")
            self.take("last()")
            return ("last",)
        if token == "contains":
            self.take()
            self.take("(")
            name = self.take()[1:].lower()
            self.take(",")
            value = self.take()[1:-1]
            self.take(")")
            return ("contains", name, value)
        if token.startswith("@"):
            name = self.take()[1:].lower()
            if self.peek() == "=":
                self.take()
                return ("equals", name, self.take()[1:-1])
            return ("has", name)
        if token == ".//":
            self.take()
            name = self.take().lower()
            while self.peek() == "[":  # the dialect reads no further
                self.take()
                self.either()
                self.take("]")
            return ("below", name)
        return ("path", self.path())


@lru_cache(maxsize=256)
def compile_path(source: str) -> tuple:
    return _Parser(source).path()


def _holds(p: tuple, node: Node, is_last: bool) -> bool:
    kind = p[0]
    if kind == "or":
        return any(_holds(q, node, is_last) for q in p[1])
    if kind == "and":
        return all(_holds(q, node, is_last) for q in p[1])
    if kind == "last":
        return is_last
    if kind == "contains":
        return p[2] in (node.attrs.get(p[1]) or "") if p[1] in node.attrs else False
    if kind == "equals":
        return node.attrs.get(p[1]) == p[2]
    if kind == "has":
        return p[1] in node.attrs
    if kind == "below":
        return node.tag == p[1] or any(n.tag == p[1] for n in node.walk())
    return bool(select(node, p[1]))


def select(node: Node, steps: tuple) -> list:
    """Nodes, or strings after an attribute or text step. Places are counted among what a step finds from one node."""
    here: list = [node]
    for axis, test, predicates in steps:
        if axis == "text":
            return [n.text() for n in here]
        if axis == "attribute":
            return [n.attrs.get(test) or "" for n in here]
        found, seen = [], set()
        for context in here:
            pool = context.walk() if axis == "descendant" else (c for c in context.children if isinstance(c, Node))
            pool = [n for n in pool if test == "*" or n.tag == test]
            for k, n in enumerate(pool):
                if id(n) not in seen and all(_holds(p, n, k == len(pool) - 1) for p in predicates):
                    seen.add(id(n))
                    found.append(n)
        here = found
    return here


def text_of(node: Node, source: str) -> str:
    """All values of a path one after another, blanks collapsed."""
    return collapse("".join(v if isinstance(v, str) else v.text() for v in select(node, compile_path(source))))
