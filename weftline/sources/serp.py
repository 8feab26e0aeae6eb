"""Search-result pages to hits: a table of engines and one page-to-rows operator."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.html_tree import parse
from weftline.functions.text import normal_text
from weftline.functions.urls import normal_url
from weftline.functions.xpath import compile_path, select, text_of


@dataclass(frozen=True)
class Engine:
    """How an engine's pages are read: the path of an item and, from it, of title, href and body; hrefs that begin with ``ads`` are none."""

    provider: str
    items: str
    title: str
    href: str
    body: str
    ordinal: int
    render_only: bool = False
    ads: str = ""


# The engines' names, providers and selectors.
ENGINES = {
    "duckduckgo": Engine("bing", "//div[contains(@class, 'body')]", ".//h2//text()", "./a/@href", "./a//text()", 1, ads="https://duckduckgo.com/y.js?"),
    "yandex": Engine("yandex", "//li[contains(@class, 'serp-item')]", ".//h3//text()", ".//h3//a/@href", ".//div[contains(@class, 'text')]//text()", 2),
    "startpage": Engine("google", "//div[contains(@class, 'result')][./a]", ".//h2//text()", "./a/@href", ".//p//text()", 3),
    "yahoo": Engine("yahoo", "//li[.//h3[@class='title']]", ".//h3//text()", ".//a[.//h3]/@href", ".//div[contains(@class, 'compText')]//text()", 4, render_only=True),
    "brave": Engine("brave", "//div[contains(@class, 'result-wrapper')]", ".//div[contains(@class, 'title')]//text()", ".//a[div[contains(@class, 'title')]]/@href", ".//div[contains(@class, 'generic-snippet')]//text()", 5, render_only=True),
}
DEFAULT_ENGINES = ["duckduckgo", "startpage"]
HIT = "query string, engine string, rank int, title string, href string, body string"


def selected(names: list[str] | None = None, rendering: bool = False, engines: dict[str, Engine] = ENGINES) -> list[str]:
    """The engines asked for that are known (and can be read without rendering, unless that is on), in their order; the default ones if none is left."""
    wanted = {n.strip().lower() for n in names or DEFAULT_ENGINES}
    known = sorted(engines, key=lambda n: engines[n].ordinal)
    return [n for n in known if n in wanted and (rendering or not engines[n].render_only)] or [n for n in known if n in DEFAULT_ENGINES]


def extract_hits(page: str | None, engine: Engine | str) -> list[tuple[str, str, str]]:
    spec = ENGINES[engine] if isinstance(engine, str) else engine
    out = []
    for node in select(parse(page or ""), compile_path(spec.items)):
        row = (normal_text(text_of(node, spec.title)), normal_url(text_of(node, spec.href)), normal_text(text_of(node, spec.body)))
        if any(row) and not (spec.ads and row[1].startswith(spec.ads)):
            out.append(row)
    return out


def serp_hits(pages: DataFrame, engines: dict[str, Engine] = ENGINES) -> DataFrame:
    """``pages`` (query, engine, html) to hits; a page is parsed once, engines that ``engines`` doesn't hold have no hits."""

    def run(batches):
        for batch in batches:
            rows = []
            for query, engine, page in zip(*[c.to_pylist() for c in batch.columns]):
                rows += [(query, engine, k + 1, *hit) for k, hit in enumerate(extract_hits(page, engines[engine]) if engine in engines else [])]
            kinds = [pa.string(), pa.string(), pa.int32()] + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["query", "engine", "rank", "title", "href", "body"])

    return pages.select("query", "engine", "html").mapInArrow(run, HIT)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of the links of a page."""

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, page in zip(*[c.to_pylist() for c in batch.columns]):
                rows += [(page_id, k, href) for k, href in enumerate(select(parse(page or ""), compile_path("//a[@href]/@href")))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int32(), pa.string()))], names=["page_id", "pos", "href"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, pos int, href string")
