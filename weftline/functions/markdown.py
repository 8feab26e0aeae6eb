"""HTML to Markdown: hidden parts and chrome left out, the dominant article chosen, link-heavy headers reduced.

A writer follows the stream of tags with two stacks: the open elements, and the regions that collect what they hold
(a page or scope, a header, a link, a cell, a code block, a quotation). A region that ends is turned into one piece of
Markdown for the region below it. Both stacks are plain lists, so nesting of any depth is no recursion, and a page
takes time in proportion to its length.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from weftline.functions.html_events import EMPTY, END, ENTITY, START, TEXT, VOID, events
from weftline.functions.text import CUT, SPACE, collapse, looks_like_html_document_text, looks_like_html_text, noscript_of

# Elements that are skipped, block elements, marks of emphasis, what ends what and up to where.
SKIP = frozenset(["script", "style", "head", "noscript", "svg", "math", "nav", "footer", "template", "dialog", "button", "select", "datalist"])
BLOCK = frozenset(["p", "div", "section", "article", "main", "aside", "figure", "figcaption", "details", "summary", "dl", "dt", "dd"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
EMPHASIS = {"strong": "**", "b": "**", "em": "*", "i": "*"}
ENDS_P = frozenset(["address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"])
ENDED_BY = {"p": ENDS_P, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"}}
BARRIERS = {"li": ["ul", "ol", "menu"], "dt": ["dl"], "dd": ["dl"], "tr": ["table"], "td": ["table"], "th": ["table"], "option": ["select", "datalist"], "optgroup": ["select", "datalist"]}
# Limits of headers and scopes, boilerplate sentences, keys of metadata.
LINK_SHARE, HEADER_TEXT, HEADER_RENDERED, HEADER_NESTING = 0.93, 150, 800, 8
SCOPE_PROSE, LISTING, DOMINANCE = 200, 3, 3
BOILERPLATE = [
    "skip to content",
    "skip to main content",
    "there was an error while loading",
    "please reload this page",
    "you can't perform that action at this time",
    "you signed in with another tab or window",
    "you signed out in another tab or window",
    "you switched accounts on another tab or window",
    "reload to refresh your session",
    "you must be signed in to change notification settings",
    "uh oh!",
    "{{ message }}",
    "this website uses cookies",
    "we use cookies",
    "accept all cookies",
    "manage cookie preferences",
]
BOILERPLATE_LINE = 300
META = {"author": "author", "article:author": "author", "dc.creator": "author", "article:published_time": "date", "date": "date", "dc.date": "date", "datepublished": "date", "og:site_name": "site", "application-name": "site", "description": "description", "og:description": "description"}
META_CHARS = 300
NO_TITLE_IN = frozenset(["math", "noscript", "svg", "template"])

_ENDS = {tag: [name for name, by in ENDED_BY.items() if tag in by] for tag in {t for by in ENDED_BY.values() for t in by}}
_PHRASES = {collapse(p).lower().rstrip(".!:") for p in BOILERPLATE}
_BLANKS = re.compile(SPACE)
_TICKS = re.compile("`+")
_START = re.compile(r"\s*[-+]?[0-9]+(?:\.0*)?\s*")


def style_hides(style: str) -> bool:
    for declaration in style.lower().split(";"):
        name, colon, value = declaration.partition(":")
        if colon and (name.strip(), value.split("!")[0].strip()) in (("display", "none"), ("visibility", "hidden")):
            return True
    return False


def hidden(attrs: dict[str, str | None]) -> bool:
    return "hidden" in attrs or (attrs.get("aria-hidden") or "").strip().lower() == "true" or style_hides(attrs.get("style") or "")


def aria_heading(attrs: dict[str, str | None]) -> bool:
    return "heading" in (attrs.get("role") or "").lower().split()


def visible_chars(text: str) -> int:
    """Characters of lines that aren't blank, destinations of links left out."""
    return sum(len(line) - _hidden_chars(line) for line in text.split("\n") if line.strip())


def _hidden_chars(line: str) -> int:
    """Characters of ``](destination)`` behind a ``[``, parentheses balanced and backslashed ones skipped."""
    if "](" not in line:
        return 0
    closes, opened = _balanced(line), False
    gone = at = 0
    while at < len(line):
        c = line[at]
        if c == "\\":
            at += 2
            continue
        opened |= c == "["
        if opened and c == "]" and (end := closes.get(at + 1)):
            gone += end - at
            at, opened = end, False
        else:
            at += 1
    return gone


def _balanced(line: str) -> dict[int, int]:
    """Place behind the closing one of each opening parenthesis that is closed."""
    out, opens, at = {}, [], 0
    while at < len(line):
        c = line[at]
        if c == "\\":
            at += 2
            continue
        if c == "(":
            opens.append(at)
        elif c == ")" and opens:
            out[opens.pop()] = at + 1
        at += 1
    return out


class _Region:
    """What an element collects. ``kept``: of a header the headings, of a link the parts within headings, of a scope their text."""

    __slots__ = ("kind", "depth", "parts", "kept", "href", "text", "linked", "rendered", "kept_chars", "lists", "codes")

    def __init__(self, kind: str, depth: int = 0, lists: int = 0, codes: int = 0, href: str = ""):
        self.kind, self.depth, self.lists, self.codes, self.href = kind, depth, lists, codes, href
        self.parts: list[str] = []
        self.kept: list[str] = []
        self.text = self.linked = self.rendered = self.kept_chars = 0


class _Writer:
    def __init__(self, scope: str | None, strip_headers: bool):
        self.scope, self.strip_headers = scope, strip_headers
        self.open: list[tuple[str, bool, bool, _Region | None]] = []  # (tag, hides, is a heading, its region)
        self.places: dict[str, list[int]] = defaultdict(list)
        self.regions: list[_Region] = [_Region("page")]
        self.of: dict[str, list[_Region]] = defaultdict(list)  # the open regions of each kind
        self.skipped = self.hides = self.headings = self.codes = self.dropped = 0
        self.lists: list[list] = []  # [kind, number]
        self.row: list[str] = []
        self.row_depth = 0
        self.in_table = self.header_done = self.first_row = self.has_th = False
        self.segments: list[tuple[str, int, int]] = []  # (text, dropped characters, characters of headings)
        self.dropped_before = 0

    # Text.

    def active(self) -> bool:
        return not self.hides and (self.scope is None or bool(self.of["scope"]))

    def put(self, text: str, heading: bool | None = None) -> None:
        """A piece for the region on top; ``heading``: whether it is one (else by the open elements)."""
        top = self.regions[-1]
        top.parts.append(text)
        if top.kind == "header":
            top.rendered += len(text.strip())
        scope = self.of["scope"]
        if heading is None and self.headings and self.of["link"]:
            # What a heading says within a link is the link's until it ends, but for a header within the link.
            link = self.of["link"][-1]
            link.kept.append(text)
            heading, scope = bool(self.of["header"]) and self.of["header"][-1].depth > link.depth, []
        if self.headings if heading is None else heading:
            for region in self.of["header"][-1:]:
                region.kept.append(text)
                region.kept_chars += len(text.strip())
            for region in scope[-1:]:
                region.kept.append(text)

    def data(self, text: str, reference: bool) -> None:
        if self.skipped or not self.active():
            return
        code = self.of["pre"]
        if not (reference or code or self.codes):
            text = _BLANKS.sub(" ", text)
            if self.in_table and not self.of["cell"] and text == " ":
                return
        if self.of["header"] and not self.headings:
            header, n = self.of["header"][-1], len(text.strip())
            header.text += n
            if self.of["link"] and self.of["link"][-1].href:
                header.linked += n
        if code:
            code[-1].parts.append(text)
        else:
            self.put(text)

    # Regions.

    def enter(self, kind: str, href: str = "") -> _Region:
        region = _Region(kind, len(self.regions), len(self.lists), self.codes, href)
        self.regions.append(region)
        self.of[kind].append(region)
        return region

    def leave(self, region: _Region, own_tag: bool = False) -> None:
        """End ``region``, if it is open, and those above it."""
        if region.depth >= len(self.regions) or self.regions[region.depth] is not region:
            return
        while region.depth < len(self.regions):
            top = self.regions[-1]
            if top.kind in ("header", "scope"):
                while self.codes > top.codes:
                    self.codes -= 1
                    self.put("`")
                if self.row and self.row_depth > top.depth:
                    self.finish_row()
                del self.lists[top.lists :]
            self.regions.pop()
            self.of[top.kind].pop()
            getattr(self, f"_end_{top.kind}")(top, own_tag and top is region)

    def _end_link(self, region: _Region, own_tag: bool) -> None:
        text, said = collapse("".join(region.parts)), collapse("".join(region.kept))
        whole = bool(self.headings) or (bool(said) and said == text)
        if text:
            self.put(f"[{text}]({region.href})" if region.href else text, whole)
        if said and not whole:
            for header in self.of["header"][-1:]:
                header.kept.append(said + "\n\n")
                header.kept_chars += len(said)
                for scope in self.of["scope"][-1:]:
                    scope.kept.append(said)

    def _end_pre(self, region: _Region, own_tag: bool) -> None:
        body = "".join(region.parts)
        fence = "`" * max(3, 1 + max(map(len, _TICKS.findall(body)), default=0))
        self.put(f"\n\n{fence}\n{body}\n{fence}\n\n", False)

    def _end_quote(self, region: _Region, own_tag: bool) -> None:
        if text := quoted("".join(region.parts)):
            self.put(f"\n\n{text}\n\n", False)

    def _end_header(self, region: _Region, own_tag: bool) -> None:
        for outer in self.of["header"][-1:]:
            outer.text += region.text
            outer.linked += region.linked
            outer.kept += region.kept
            outer.kept_chars += region.kept_chars
        spare = region.rendered - region.kept_chars
        if own_tag and (region.text >= HEADER_TEXT or spare >= HEADER_RENDERED) and region.linked >= LINK_SHARE * region.text:
            self.dropped += max(0, spare)
            kept = "".join(region.kept)
            self.put(kept + "\n\n" if kept.strip() else kept, False)
        else:
            self.put("".join(region.parts), False)

    def _end_scope(self, region: _Region, own_tag: bool) -> None:
        self.segments.append(("".join(region.parts), self.dropped - self.dropped_before, visible_chars("".join(region.kept))))

    def _end_cell(self, region: _Region, own_tag: bool) -> None:
        self.row.append("".join(region.parts).strip().replace("\n", " ").replace("|", "\\|"))

    def finish_cell(self) -> None:
        for cell in self.of["cell"][-1:]:
            self.leave(cell)

    def finish_row(self) -> None:
        if not self.row:
            return
        line, marks = ("| " + " | ".join(cells) + " |\n" for cells in (self.row, ["---"] * len(self.row)))
        self.put(line, False)
        if not self.header_done and (self.has_th or self.first_row):
            self.put(marks, False)
            self.header_done = True
        self.first_row = self.has_th = False
        self.row = []

    # Elements.

    def cut(self, depth: int, own_tag: bool = False) -> None:
        """End all elements from ``depth`` on, the one there by its own tag or not."""
        while len(self.open) > depth:
            tag, hides, heading, region = self.open[-1]
            if region is not None:
                self.leave(region, own_tag and len(self.open) == depth + 1)
            self.open.pop()
            self.places[tag].pop()
            self.hides -= hides
            self.headings -= heading

    def end_implied(self, tag: str) -> None:
        barriers = BARRIERS.get(tag, ())
        while ended := max((self.places[name][-1] for name in _ENDS.get(tag, ()) if self.places[name]), default=-1) + 1:
            if any(self.places[b] and self.places[b][-1] >= ended for b in barriers):
                return
            self.cut(ended - 1)

    def start(self, tag: str, attrs: dict[str, str | None]) -> None:
        if self.skipped:
            self.skipped += tag in SKIP
            return
        self.end_implied(tag)
        if tag in SKIP:
            self.skipped = 1
            return
        hides = hidden(attrs)
        if tag in VOID:
            if not hides and self.active():
                self.put({"br": "\n", "hr": "\n\n---\n\n"}[tag]) if tag in ("br", "hr") else None
            return
        if tag == "a" and self.of["link"] and self.active():
            self.leave(self.of["link"][-1])
        heading = tag in HEADINGS or tag == "hgroup" or aria_heading(attrs)
        self.places[tag].append(len(self.open))
        self.hides += hides
        self.headings += heading
        region = None
        if tag == self.scope and not self.of["scope"] and not self.hides:
            region = self.enter("scope")
            self.dropped_before = self.dropped
        if self.active():
            region = self.begin(tag, attrs) or region
        self.open.append((tag, hides, heading, region))

    def begin(self, tag: str, attrs: dict[str, str | None]) -> _Region | None:
        """What a start tag writes, and the region it opens."""
        if tag in HEADINGS:
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "header":
            return self.enter("header") if self.strip_headers and len(self.of["header"]) < HEADER_NESTING else None
        elif tag == "a":
            return None if self.of["pre"] else self.enter("link", attrs.get("href") or "")
        elif tag in EMPHASIS:
            self.put(EMPHASIS[tag])
        elif tag in BLOCK:
            self.put("\n\n")
        elif tag == "blockquote":
            self.put("\n\n")
            return self.enter("quote")
        elif tag in ("ul", "ol"):
            start = attrs.get("start") or ""
            self.lists.append([tag, int(float(start)) - 1 if _START.fullmatch(start) else 0])
            self.put("\n")
        elif tag == "li":
            indent, mark = "  " * max(0, len(self.lists) - 1), "* "
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}. "
            self.put(f"\n{indent}{mark}")
        elif tag == "pre":
            return self.enter("pre")
        elif tag == "code" and not self.of["pre"]:
            self.codes += 1
            self.put("`")
        elif tag == "table":
            self.in_table, self.header_done, self.first_row = True, False, True
            self.put("\n\n")
        elif tag in ("tr", "td", "th"):
            self.finish_cell()
            if tag == "tr":
                self.finish_row()
            else:
                self.has_th |= tag == "th"
                if not self.row:
                    self.row_depth = len(self.regions)
                return self.enter("cell")
        return None

    def end(self, tag: str) -> None:
        if tag in SKIP:
            self.skipped = max(0, self.skipped - 1)
            return
        if self.skipped or tag in VOID:
            return
        active = self.active()
        if places := self.places[tag]:
            self.cut(places[-1], own_tag=True)
        if not active or not self.active():
            return
        if tag in HEADINGS or tag in BLOCK:
            self.put("\n\n")
        elif tag in EMPHASIS:
            self.put(EMPHASIS[tag])
        elif tag in ("ul", "ol"):
            if self.lists and self.lists[-1][0] == tag:
                self.lists.pop()
            self.put("\n")
        elif tag == "code" and self.codes and not self.of["pre"]:
            self.codes -= 1
            self.put("`")
        elif tag in ("td", "th"):
            self.finish_cell()
        elif tag in ("tr", "table"):
            self.finish_cell()
            self.finish_row()
            if tag == "table":
                self.in_table = False
                self.put("\n")

    def finish(self) -> _Writer:
        while len(self.regions) > 1:
            self.leave(self.regions[-1])
        self.finish_row()
        while self.codes:
            self.codes -= 1
            self.put("`")
        return self


Events = list[tuple[int, str, dict[str, str | None]]]


def read_events(page: str) -> Events:
    """A page's tags and text, read once for all that is made of them; line ends are unified."""
    return list(events(page.replace("\r\n", "\n").replace("\r", "\n") if "\r" in page else page))


def _written(read: Events, scope: str | None, strip_headers: bool) -> _Writer:
    writer = _Writer(scope, strip_headers)
    for kind, name, attrs in read:
        if kind == START:
            writer.start(name, attrs)
        elif kind == END:
            writer.end(name)
        elif kind == EMPTY:
            if name in VOID:
                writer.start(name, attrs)
        else:
            writer.data(name, kind == ENTITY)
    return writer.finish()


def quoted(text: str) -> str:
    """``> `` before each line."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", text, flags=re.M)).strip()
    return "\n".join("> " + line if line.strip() else ">" for line in text.split("\n")) if text else ""


def fences(lines: list[str]):
    """(line, whether it is in a fence or one of its ends); a fence ends with one as long as that it began with."""
    fence = 0
    for line in lines:
        mark = line.strip()
        ticks = len(mark) if len(mark) >= 3 and not mark.strip("`") else 0
        if ticks and (not fence or ticks >= fence):
            fence = 0 if fence else ticks
            yield line, True
        else:
            yield line, bool(fence)


def cleanup(text: str) -> str:
    """No blanks at line ends and at most one blank line, but for code."""
    out: list[str] = []
    blank = False
    for line, fenced in fences(text.split("\n")):
        is_end = fenced and not line.strip().strip("`") and len(line.strip()) >= 3
        if not fenced or is_end:
            line = line.rstrip(" \t")
        if not line and not fenced:
            if not blank:
                out.append("")
            blank = True
            continue
        blank = False
        out.append(line)
    return "\n".join(out).strip()


def is_boilerplate(line: str) -> bool:
    parts = [p.strip().rstrip(".!:") for p in re.split("[.!]", collapse(line).lower())]
    parts = [p for p in parts if p]
    return bool(parts) and all(p in _PHRASES for p in parts)


def boilerplate_of(text: str) -> list[str]:
    """The lines that ``strip_boilerplate`` takes out."""
    return [line for line, fenced in fences(text.split("\n")) if not fenced and len(line) <= BOILERPLATE_LINE and is_boilerplate(line)]


@F.arrow_udf(ArrayType(StringType()))
def boilerplate_lines(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else boilerplate_of(t) for t in text.to_pylist()], pa.list_(pa.string()))


def strip_boilerplate(markdown: str) -> str:
    kept = [line for line, fenced in fences(markdown.split("\n")) if fenced or len(line) > BOILERPLATE_LINE or not is_boilerplate(line)]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


@F.arrow_udf(StringType())
def stripped(text: pa.Array) -> pa.Array:
    """``strip_boilerplate`` of texts."""
    return pa.array([None if t is None else strip_boilerplate(t) for t in text.to_pylist()], pa.string())


def _main_scope(read: Events, tag: str) -> str | None:
    """The dominant ``tag`` element's text, unless there is none of size or three or more of like prose make a listing."""
    if not any(name == tag and kind == START for kind, name, _ in read):
        return None
    found = []
    for text, dropped, headings in _written(read, tag, True).segments:
        text = strip_boilerplate(cleanup(text))
        if (prose := visible_chars(text) - headings) >= SCOPE_PROSE:
            found.append((prose, len(text) + min(dropped, len(text)), text))
    if not found:
        return None
    prose = sorted((f[0] for f in found), reverse=True)
    if len(found) >= LISTING and prose[0] < DOMINANCE * max(1, prose[1]):
        return None
    best = max(found, key=lambda f: f[1])
    return best[2] if best[1] >= SCOPE_PROSE else None


def to_markdown(page: str | Events | None, main_content: bool = True) -> str:
    """A page (or what was read of it) as Markdown, by default its main content."""
    read = read_events(page or "") if isinstance(page, str | None) else page
    if not main_content:
        return cleanup("".join(_written(read, None, False).regions[0].parts))
    for tag in ("article", "main"):
        if (text := _main_scope(read, tag)) is not None:
            return text
    return strip_boilerplate(cleanup("".join(_written(read, None, True).regions[0].parts)))


def head_of(page: str | Events) -> dict[str, str]:
    """Title and metadata, in page order: the first ``title`` outside drawings, of each key the first with content, of each field the first key."""
    found = {"title": "", "author": "", "date": "", "site": "", "description": ""}
    parts: list[str] = []
    inside = done = False
    skipped = 0
    seen: set[str] = set()
    for kind, name, attrs in read_events(page) if isinstance(page, str) else page:
        if kind >= TEXT:
            if inside and not skipped:
                parts.append(name)
            continue
        if name == "meta" and kind != END:
            key = attrs["property"] if attrs.get("property") is not None else attrs.get("name")
            key, value = (key or "").lower(), collapse(attrs.get("content") or "")
            if key and value and key not in seen:
                seen.add(key)
                field = META.get(key)
                if field and not found[field]:
                    found[field] = value[:META_CHARS]
        if kind == START and name in NO_TITLE_IN:
            skipped += 1
        elif kind == END and name in NO_TITLE_IN:
            skipped = max(0, skipped - 1)
        elif skipped:
            continue
        elif kind == START:
            inside = name == "title" and not done
        elif kind == END and name == "title":
            inside, done = False, True
    return found | {"title": collapse("".join(parts))}


@F.arrow_udf(StringType())
def main_content(page: pa.Array) -> pa.Array:
    """The main content of pages as Markdown."""
    return pa.array([None if p is None else to_markdown(p) for p in page.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def whole_page(page: pa.Array) -> pa.Array:
    """All of pages as Markdown."""
    return pa.array([None if p is None else to_markdown(p, False) for p in page.to_pylist()], pa.string())


PREFIX = [("Title: ", "title"), ("Author: ", "author"), ("Date: ", "date"), ("Site: ", "site")]


def prefixed(page: str, read: Events | None = None, head: dict[str, str] | None = None) -> str:
    """Markdown under lines of metadata; the notice of a cut page is kept."""
    read = read_events(page) if read is None else read
    head = head_of(read) if head is None else head
    lines = [name + head[field] for name, field in PREFIX if head[field]]
    text = "\n".join(lines) + "\n\n" + to_markdown(read) if lines else to_markdown(read)
    return text + "\n\n" + CUT if page.endswith(CUT) and not text.endswith(CUT) else text


def readme_text(body: str) -> str:
    """A README as it is, or as Markdown if it is a whole HTML document."""
    if looks_like_html_document_text(body) and (text := prefixed(body)).strip():
        return text
    return body


@F.arrow_udf(StringType())
def readme_body(body: pa.Array) -> pa.Array:
    return pa.array([None if b is None else readme_text(b) for b in body.to_pylist()], pa.string())


@F.arrow_udf(LongType())
def visible(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else visible_chars(t) for t in text.to_pylist()], pa.int64())


# Limits and markers of pages that need a browser.
THIN, SCRIPT_HTML, SCRIPT_SHARE, MANY_SCRIPTS, NOSCRIPT = 400, 8192, 0.5, 3, 40
SPA = re.compile(r"""(?:id\s*=\s*["']?(?:root|app|__next|__nuxt)["']?|data-reactroot|ng-version|__NEXT_DATA__|__NUXT__|__PRELOADED_STATE__)""", re.I)
_SCRIPT, _SCRIPTS = re.compile(r"<script\b", re.I), re.compile(r"<script\b[^>]*>[\s\S]*?</script>", re.I)


def hint_of(page: str, text: str, description: str) -> dict | None:
    """Why a page seems to need a browser (reason, evidence), if it does."""
    prose = visible_chars(text)
    if prose >= THIN:
        return None
    if not prose:
        return {"reason": "empty", "evidence": []}
    scripts = len(_SCRIPT.findall(page))
    weighed = [
        ("spa-markers", 2, lambda: SPA.search(page)),
        ("script-heavy", 2, lambda: len(page) >= SCRIPT_HTML and sum(map(len, _SCRIPTS.findall(page) if "</script>" in page.lower() else [])) >= len(page) * SCRIPT_SHARE),
        ("scripts", 1, lambda: scripts >= MANY_SCRIPTS),
        ("noscript", 1, lambda: len(noscript_of(page)) >= NOSCRIPT),
        ("description", 1, lambda: description),
    ]
    signs = [(name, weight) for name, weight, holds in weighed if holds()]
    return {"reason": "js-shell", "evidence": [name for name, _ in signs]} if sum(w for _, w in signs) >= 2 else None


HINT = StructType([StructField("reason", StringType()), StructField("evidence", ArrayType(StringType()))])
PAGE = StructType([StructField(name, StringType()) for name in ("title", "author", "date", "site", "description", "text")] + [StructField("hint", HINT)])
_ARROW_HINT = pa.struct([("reason", pa.string()), ("evidence", pa.list_(pa.string()))])
_ARROW_PAGE = pa.struct([(name, pa.string()) for name in PAGE.names[:-1]] + [("hint", _ARROW_HINT)])


def read_page(page: str) -> dict:
    read = read_events(page)
    head = head_of(read)
    text = prefixed(page, read, head)
    return {**head, "text": text, "hint": hint_of(page, text, head["description"])}


@F.arrow_udf(PAGE)
def page_struct(page: pa.Array) -> pa.Array:
    """Title, metadata, Markdown under the metadata's lines, and the hint; null for null."""
    return pa.array([None if p is None else read_page(p) for p in page.to_pylist()], _ARROW_PAGE)


@F.arrow_udf(HINT)
def render_hint(page: pa.Array, text: pa.Array) -> pa.Array:
    """The hint for a page and its text."""
    return pa.array([None if p is None else hint_of(p, t or "", head_of(p)["description"]) for p, t in zip(page.to_pylist(), text.to_pylist())], _ARROW_HINT)


def is_html(body: str, content_type: str) -> bool:
    return "html" in content_type or looks_like_html_text(body)


def body_text(body: str, content_type: str) -> str:
    """A body as readers see it."""
    return prefixed(body) if is_html(body, content_type) else body.strip()


@F.arrow_udf(StringType())
def render_body(body: pa.Array, content_type: pa.Array) -> pa.Array:
    return pa.array([None if b is None else body_text(b, c or "") for b, c in zip(body.to_pylist(), content_type.to_pylist())], pa.string())


# Lines of metadata above a rendered page.
METADATA_LINE = re.compile(r"^(?:Title|Author|Date|Site|URL|Rendered via): ")


def body_chars(text: str) -> int:
    """Visible characters without the lines of metadata."""
    return visible_chars("\n".join(line for line in text.split("\n") if not METADATA_LINE.match(line)))


def with_provenance(text: str, url: str, provenance: str) -> str:
    """Two more lines below those of metadata: the URL and where the text is from."""
    lines = text.split("\n")
    n = next((k for k, line in enumerate(lines) if not METADATA_LINE.match(line)), len(lines))
    head = [f"URL: {url}", provenance]
    return "\n".join(lines[:n] + head + lines[n:]) if n else "\n".join(head) + "\n\n" + text


def provenance(text: Column, url: Column, line: str) -> Column:
    """``with_provenance`` as a column: the metadata's lines are those at the start."""
    head = F.regexp_extract(text, r"^((?:(?:Title|Author|Date|Site|URL|Rendered via): [^\n]*(?:\n|$))*)", 1)
    rest = F.substring(text, F.char_length(head) + 1, F.char_length(text))
    own = F.concat(F.lit("URL: "), url, F.lit("\n" + line))
    return F.when(head == "", F.concat(own, F.lit("\n\n"), text)).otherwise(F.concat(F.rtrim(head, F.lit("\n")), F.lit("\n"), own, F.when(rest != "", F.concat(F.lit("\n"), rest)).otherwise(F.lit(""))))
