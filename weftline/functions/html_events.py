"""The lenient reading of markup that all page functions share: a stream of tags and pieces of text.

Markup that isn't well formed is text: a tag without an end, a comment without an end, ``<`` before anything but a
name. One pass, in time proportional to the page's length, whatever the page holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

# Elements whose content is text, elements without content.
RAW_TEXT = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])

START, END, EMPTY, TEXT, ENTITY = range(5)
Attrs = dict[str, str | None]
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END_NAME = re.compile(r"[^\s>]+")
_BLANK = re.compile(r"[\s/]*")
_ATTR = re.compile(r"([^\s=/>]+)\s*(=?)\s*")
_BARE = re.compile(r"[^\s>]*")
_ENTITY = re.compile(r"&(?:([A-Za-z][A-Za-z0-9.-]*);|#([xX][0-9a-fA-F]+|[0-9]+);?|([A-Za-z][A-Za-z0-9.-]*)(?=[^A-Za-z0-9]|$))")
_CLOSERS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW_TEXT}


class _Page:
    """A page with what is known of its end, so that no search for a missing end is made twice."""

    def __init__(self, text: str):
        self.text, self.size = text, len(text)
        self.last_gt = text.rfind(">")
        self.last_comment = text.rfind("-->")
        #: places between attributes from which no end of a tag is reached
        self.dead: set[int] = set()
        #: raw text elements that no end tag follows any more
        self.unclosed: set[str] = set()

    def attributes(self, at: int) -> tuple[Attrs, int, bool] | None:
        """(attributes, place behind the tag, whether it ends in ``/>``), or None if the tag has no end."""
        text, seen, attrs = self.text, [], {}
        while at <= self.last_gt and at not in self.dead:
            seen.append(at)
            m = _BLANK.match(text, at)
            at = m.end()
            if text.startswith(">", at):
                return attrs, at + 1, m[0].endswith("/")
            m = _ATTR.match(text, at)
            if not m:
                break
            name, value, at = m[1].lower(), None, m.end()
            if not m[2]:
                at = m.end(1)
            elif text[at : at + 1] in ('"', "'") and at < self.size:
                close = text.find(text[at], at + 1)
                if close < 0:
                    break
                value, at = unescape(text[at + 1 : close]), close + 1
            else:
                m = _BARE.match(text, at)
                value, at = unescape(m[0]), m.end()
            attrs[name] = value
        self.dead.update(seen)
        return None

    def tag(self, at: int) -> tuple[int, str, Attrs, int] | None:
        """(kind, name, attributes, place behind) of what starts at a ``<``; the name is empty for comments and declarations."""
        text = self.text
        if text.startswith("<!--", at):
            close = text.find("-->", at + 4) if at + 4 <= self.last_comment else -1
            return (EMPTY, "", {}, close + 3) if close >= 0 else None
        mark = text[at + 1 : at + 2]
        if at > self.last_gt:
            return None
        if mark in ("!", "?") and mark:
            close = text.find(">", at + 2)
            return (EMPTY, "", {}, close + 1) if close >= 0 else None
        if mark == "/":
            m = _END_NAME.match(text, at + 2)
            close = text.find(">", m.end()) if m else -1
            return (END, m[0].lower(), {}, close + 1) if close >= 0 else None
        m = _NAME.match(text, at + 1)
        found = self.attributes(m.end()) if m else None
        return (EMPTY if found[2] else START, m[0].lower(), found[0], found[1]) if found else None

    def pieces(self, lo: int, hi: int) -> Iterator[tuple[int, str, Attrs]]:
        """Text between two places, references apart."""
        text, at = self.text, lo
        while at < hi:
            amp = text.find("&", at, hi)
            if amp < 0:
                yield TEXT, text[at:hi], {}
                return
            if amp > at:
                yield TEXT, text[at:amp], {}
            m = _ENTITY.match(text, amp)
            if m and m.end() <= hi:
                yield ENTITY, unescape(f"&{m[1] or m[3]};" if not m[2] else f"&#{m[2]};"), {}
                at = m.end()
            else:
                yield TEXT, "&", {}
                at = amp + 1

    def raw_end(self, tag: str, at: int) -> re.Match | None:
        if tag in self.unclosed:
            return None
        m = _CLOSERS[tag].search(self.text, at)
        if not m:
            self.unclosed.add(tag)
        return m


def events(page: str) -> Iterator[tuple[int, str, Attrs]]:
    """(kind, name or text, attributes): START, END and EMPTY (self-closing) tags, TEXT, and ENTITY (a decoded reference)."""
    source = _Page(page)
    at = said = 0
    while (at := page.find("<", at)) >= 0:
        found = source.tag(at)
        if found is None:
            at += 1
            continue
        yield from source.pieces(said, at)
        kind, name, attrs, at = found
        if kind == START and name in RAW_TEXT and (m := source.raw_end(name, at)):
            yield START, name, attrs
            yield from source.pieces(at, m.start())
            yield END, name, {}
            at = m.end()
        elif name:
            yield kind, name, attrs
        said = at
    yield from source.pieces(said, len(page))
