"""Main text of web pages from flat text blocks.

A scan cuts a page into blocks at block-level tags. A block is described by its number of words and its link
density, the same of the block before and the block after, and by what its open elements say of it: chrome (menus,
headers, footers, sidebars, notices, adverts, forms), a main part, reader comments, hidden, a heading. A decision
tree, grown on the small labelled pages of ``html_training``, keeps or drops it. Where a page marks its main part
that decides; where it marks nothing, words, links and neighbours do.

Names of classes and ids count by whole words only: ``share-price`` or ``side-note`` is no chrome.

Awkward rows: null and empty pages give an empty text and no characters; repeated rows and rows with null ids or
urls are kept as they come; an empty table gives an empty result; other columns are not read, so their names don't
matter. The scan is one pass without look-back, so very long and very deeply nested pages take time in proportion
to their length; they are read whole, nothing is cut off. A tag that the page's end cuts in two is no text, as in
browsers; character references are decoded after the markup is read, so ``&lt;b&gt;`` stays text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import prepare

SCHEMA = "page_id long, url string, text string, n_chars long"
# Element classes of HTML, and words that name parts of pages.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSHOWN = frozenset("noscript template svg object canvas audio video map select button option optgroup datalist progress meter output".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
CHROME = frozenset("nav footer aside form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "tbody", "thead", "tfoot"), "tfoot": ("tr", "tbody", "thead", "tfoot")}
WITHIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",)}
ROLES = {"navigation": "chrome", "banner": "chrome", "contentinfo": "chrome", "complementary": "chrome", "search": "chrome", "form": "chrome", "dialog": "chrome", "alertdialog": "chrome", "alert": "chrome", "menu": "chrome", "menubar": "chrome", "toolbar": "chrome", "main": "main", "article": "main"}
NAMES = dict.fromkeys("ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promotion recommendations recommended related search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser teasers toolbar topbar widget widgets".split(), "chrome")
NAMES |= dict.fromkeys("article body content entry main maincontent post story text".split(), "main")
NAMES |= dict.fromkeys("comment comments discussion disqus replies reply respond responses".split(), "comment")
GENERIC = frozenset("area bar block body box button buttons col column container content form frame group holder icons inner item items left link links list outer panel right row section slot thread top bottom unit wrap wrapper zone".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r">|=\s*[\"']")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
FEATURES = ["words", "links", "prev_words", "prev_links", "next_words", "next_links", "chrome", "inside", "page_has_main", "comment", "heading", "hidden"]


class _Frame:
    """An open element and what it and those around it say."""

    __slots__ = ("tag", "chrome", "inside", "comment", "hidden", "unshown", "link", "heading", "mark")

    def __init__(self, tag="", chrome=0, inside=0, comment=0, hidden=0, unshown=0, link=0, heading=0, mark=None):
        self.tag, self.chrome, self.inside, self.comment, self.hidden = tag, chrome, inside, comment, hidden
        self.unshown, self.link, self.heading, self.mark = unshown, link, heading, mark


def _is_word(token: str) -> bool:
    """Whether it counts as a word: bars and dots between links don't."""
    return token[0].isalnum() or any(map(str.isalnum, token))


def _kind(token: str) -> str | None:
    """What a class or id says: by its last word that isn't generic (``comment-list``: comment)."""
    words = [w.lower() for w in _WORD.findall(token)]
    while len(words) > 1 and (words[-1] in GENERIC or words[-1].isdigit()):
        words.pop()
    return NAMES.get(words[-1]) if words else None


@lru_cache(maxsize=20_000)
def _says(tag: str, source: str) -> tuple[int, int, int, int, str | None]:
    """(chrome: 2 by name, 1 by tag; main part; comments; hidden; training mark) of a start tag."""
    found: dict[str, str] = {}
    for k, a, b, c in _ATTR.findall(source):
        found.setdefault(k.lower(), unescape(a or b or c or ""))
    kinds = {_kind(t) for t in f"{found.get('class', '')} {found.get('id', '')}".split()} | {ROLES.get(found.get("role", "").strip().lower())}
    whole = tag in ("html", "body")
    chrome = 0 if whole else 2 if "chrome" in kinds and "main" not in kinds and tag not in MAIN else 1 if tag in CHROME or tag == "header" else 0
    inside = int(not whole and (tag in MAIN or ("main" in kinds and tag in ("div", "section", "td"))))
    hidden = int("hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(_HIDES.search(found.get("style", ""))))
    return chrome, inside, int("comment" in kinds and not whole), hidden, found.get("data-keep")


def _tag_end(page: str, at: int) -> int:
    """Behind the ``>`` that ends a tag's attributes, or -1."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        close = page.find(page[m.end() - 1], m.end())
        if close < 0:
            return page.find(">", m.end()) + 1 or -1
        at = close + 1
    return -1


def blocks(page: str) -> list[dict]:
    """Blocks in page order: text, and the features that don't come from neighbours; ``mark`` is the label that a training page gives."""
    out: list[dict] = []
    stack, at_of = [_Frame()], defaultdict(list)
    text: list[str] = []
    linked: list[str] = []
    at, n = 0, len(page)

    def close() -> None:
        if text:
            words = "".join(text).split()
            if words:
                top = stack[-1]
                n = sum(map(_is_word, words))
                share = sum(map(_is_word, "".join(linked).split())) / max(1, n) if linked else 0.0
                out.append({"text": " ".join(words), "words": n, "links": min(1.0, share), "chrome": int(top.chrome > 0), "inside": top.inside, "comment": top.comment, "hidden": top.hidden, "heading": top.heading, "mark": top.mark})
            text.clear()
            linked.clear()

    def say(part: str) -> None:
        top = stack[-1]
        if top.unshown:
            return
        if "&" in part:
            part = unescape(part)
        text.append(part)
        if linked or top.link:
            linked.append(part if top.link else " ")

    def cut(depth: int) -> None:
        while len(stack) > depth:
            at_of[stack.pop().tag].pop()

    def last(tags) -> int:
        return max((at_of[t][-1] for t in tags if at_of[t]), default=0)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        mark = page[lt + 1 : lt + 2]
        if mark in ("!", "?"):
            if page.startswith("<!--", lt):
                over = page.find("-->", lt + 4)
                at = over + 3 if over >= 0 else n
            else:
                over = page.find(">", lt)
                at = over + 1 if over >= 0 else n
            continue
        ends = mark == "/"
        m = _NAME.match(page, lt + 1 + ends)
        if not m:
            say("<")
            at = lt + 1
            continue
        over = _tag_end(page, m.end())
        if over < 0:
            break
        tag, source, at = m[0].lower(), page[m.end() : over - 1], over
        if ends:
            if tag == "br":
                say(" ")
                continue
            if tag not in INLINE:
                close()
            if at_of[tag]:
                cut(at_of[tag][-1])
            continue
        if tag in RAW:
            m = _CLOSE[tag].search(page, at)
            if not m:
                break
            over = page.find(">", m.end())
            at = over + 1 if over >= 0 else n
            say(" ")
            continue
        if at_of["head"] and tag not in HEAD and tag not in UNSHOWN:
            cut(at_of["head"][-1])
        if tag == "a" and at_of["a"]:
            cut(at_of["a"][-1])
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag not in INLINE:
                close()
            continue
        if tag in INLINE and tag != "a" and not source:
            continue
        if tag not in INLINE:
            close()
            if tag in CLOSES_P and at_of["p"] and at_of["p"][-1] > last(("td", "th", "button", "object")):
                cut(at_of["p"][-1])
            if tag in CLOSES:
                first = last(CLOSES[tag])
                if first and first > last(w for w in WITHIN[tag] if w != tag):
                    cut(first)
        if source.endswith("/") and tag in UNSHOWN:
            continue
        top = stack[-1]
        chrome, inside, comment, hidden, label = _says(tag, source.strip())
        if tag == "header" and chrome == 1 and top.inside:
            chrome = 0  # an article's own header
        if tag in INLINE and tag != "a" and not hidden:
            continue
        at_of[tag].append(len(stack))
        stack.append(
            _Frame(tag, max(top.chrome, chrome), max(top.inside, inside), max(top.comment, comment), max(top.hidden, hidden), max(top.unshown, int(tag in UNSHOWN or tag == "head" or (hidden and tag in INLINE))), max(top.link, int(tag == "a")), max(top.heading, int(tag in HEADINGS)), label or top.mark)
        )
    close()
    return out


def features(found: list[dict]) -> list[list[float]]:
    """One row of FEATURES a block; a missing neighbour has -1 words and links."""
    has_main = float(any(b["inside"] and not (b["chrome"] or b["comment"] or b["hidden"]) for b in found))
    none = {"words": -1, "links": -1.0}
    rows = []
    for k, b in enumerate(found):
        before, after = found[k - 1] if k else none, found[k + 1] if k + 1 < len(found) else none
        rows.append([float(x) for x in (b["words"], b["links"], before["words"], before["links"], after["words"], after["links"], b["chrome"], b["inside"], has_main, b["comment"], b["heading"], b["hidden"])])
    return rows


def grow(x: list[list[float]], y: list[int], depth: int = 12, least: int = 3):
    """A decision tree by Gini impurity: a leaf is 0 or 1, a node (feature, threshold, at most it, above it); no side has fewer than ``least`` rows."""
    ones = sum(y)
    if depth == 0 or ones in (0, len(y)):
        return int(2 * ones >= len(y))
    best = None
    for f in range(len(x[0])):
        order = sorted(zip((r[f] for r in x), y))
        left = 0
        for k in range(1, len(order)):
            left += order[k - 1][1]
            if order[k][0] > order[k - 1][0] and least <= k <= len(order) - least:
                gini = left * (k - left) / k + (ones - left) * (len(y) - k - ones + left) / (len(y) - k)
                if best is None or gini < best[0] - 1e-9:
                    best = (gini, f, (order[k][0] + order[k - 1][0]) / 2)
    if best is None:
        return int(2 * ones >= len(y))
    _, f, t = best
    sides = [[(r, v) for r, v in zip(x, y) if (r[f] > t) == above] for above in (False, True)]
    below, beyond = (grow([r for r, _ in s], [v for _, v in s], depth - 1, least) for s in sides)
    return below if below == beyond and isinstance(below, int) else (f, t, below, beyond)


def decide(tree, row: list[float]) -> int:
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = high if row[f] > t else low
    return tree


def show(tree, indent: str = "") -> str:
    """The tree as text."""
    if isinstance(tree, int):
        return f"{indent}{'keep' if tree else 'drop'}\n"
    f, t, low, high = tree
    return f"{indent}{FEATURES[f]} <= {t:g}\n{show(low, indent + '  ')}{indent}{FEATURES[f]} > {t:g}\n{show(high, indent + '  ')}"


def labelled(pages: list[str]) -> tuple[list[list[float]], list[int]]:
    """Features and labels of the blocks of marked pages."""
    x, y = [], []
    for page in pages:
        found = blocks(page)
        x += features(found)
        y += [int(b["mark"] == "y") for b in found]
    return x, y


@lru_cache(maxsize=1)
def trained():
    from weftline.llm.html_training import pages

    return grow(*labelled(pages()))


def main_text(page: str | None, tree=None) -> str:
    found = blocks(page or "")
    tree = trained() if tree is None else tree
    return "\n\n".join(b["text"] for b, row in zip(found, features(found)) if decide(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, ...) to page_id, url, text, n_chars."""
    prepare(pages)

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, SCHEMA)
