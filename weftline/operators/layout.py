"""Page layout as relational operators: lines, heading sizes, running lines, tables, link rectangles, and pages as Markdown.

Spans are rows (doc, page, ord, block, x0, y0, x1, y1, size, text, bold, italic, mono); lines have their rectangle,
their text and their spans as an array. What compares rows of a page or document is windows, joins and aggregates;
only what builds a line's or a page's text from its own spans is an Arrow function, on arrays as long as a page.
"""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

# White space and bullets of page text, glyphs of Arabic and Hebrew presentation forms.
WHITE = "[\x00-\x20\xa0\u2000-\u200a\u202f\u205f\u3000]"
BULLETS = frozenset([0x2A, 0x2D, 0x3E, 0x6F, 0xB6, 0xB7, *range(0x2010, 0x2016), 0x2020, 0x2021, 0x2022, 0x2212, 0x2219, 0xF0A7, 0xF0B7, 0xFFFD, *range(0x25A0, 0x2600)])
SHAPED = "[\ufb1d-\ufdff\ufe70-\ufefc]"
# Tolerances and limits.
LINE_GAP, BODY_SIZE, HEADING_LEVELS, EDGE, RUNNING_PAGES, RUNNING_SHARE, BUCKET, COLUMN_GAP = 3.0, 12, 6, 0.12, 2, 0.5, 5, 5
BAD_GLYPHS, BAD_SHARE, WHOLE_SHARE, WHOLE_LETTERS = 5, 0.0005, 0.75, 200

SPAN = StructType([StructField(n, DoubleType()) for n in ("x0", "y0", "x1", "y1", "size")] + [StructField("text", StringType())] + [StructField(n, BooleanType()) for n in ("bold", "italic", "mono")] + [StructField("block", LongType())])
_ARROW_SPAN = pa.struct([(n, pa.float64()) for n in ("x0", "y0", "x1", "y1", "size")] + [("text", pa.string())] + [(n, pa.bool_()) for n in ("bold", "italic", "mono")] + [("block", pa.int64())])


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def is_white(text: Column) -> Column:
    return text.rlike(f"^{WHITE}*$")


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))


def islands(rows: DataFrame, keys: list[str], order: list[str], gap: Column) -> DataFrame:
    """``island``: number of the run a row lies in; ``gap`` is true where a row starts a new one (may use lag over the keys)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_new", F.coalesce(gap.cast("int"), F.lit(1))).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sanitize(spans: list[dict]) -> list[dict]:
    """Spans from left to right; those of one style that (nearly) touch become one, from the right on; a repeated text stays single."""
    out: list[dict] = []
    for span in sorted(spans, key=lambda s: s["x0"])[::-1]:
        right = out[-1] if out else None
        if right and span["x1"] + 0.1 * right["size"] >= right["x0"] and all(span[k] == right[k] for k in ("bold", "italic", "mono")):
            text = span["text"] + (right["text"] if right["text"] != span["text"] else "")
            out[-1] = span | {"text": text} | {k: f(span[k], right[k]) for k, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))}
        else:
            out.append(dict(span))
    return out[::-1]


@F.arrow_udf(ArrayType(SPAN))
def _sanitized(spans: pa.Array) -> pa.Array:
    return pa.array([None if s is None else sanitize(s) for s in spans.to_pylist()], pa.list_(_ARROW_SPAN))


def merge_lines(spans: DataFrame, tolerance: float = LINE_GAP) -> DataFrame:
    """Lines (doc, page, line, x0, y0, x1, y1, text, spans): a span within ``tolerance`` of the top or bottom of the one before it, from the page's top down, joins its line. Blank and empty spans go."""
    w = Window.partitionBy("doc", "page").orderBy("y1", "ord")
    fine = spans.where(~is_white(F.col("text")) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    near = (F.abs(F.col("y1") - F.lag("y1").over(w)) <= tolerance) | (F.abs(F.col("y0") - F.lag("y0").over(w)) <= tolerance)
    found = islands(fine, ["doc", "page"], ["y1", "ord"], ~near)
    span = F.struct(F.struct("y1", "ord").alias("at"), F.struct(*SPAN.names).alias("s"))
    lines = found.groupBy("doc", "page", F.col("island").alias("line")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.transform(F.array_sort(F.collect_list(span)), lambda x: x["s"]).alias("spans"))
    lines = lines.withColumn("spans", _sanitized("spans"))
    return lines.withColumn("text", F.trim(F.array_join(F.transform("spans", lambda s: s["text"]), " ")))


def heading_levels(spans: DataFrame, keys: list[str], size: Column, weight: Column, least: int = BODY_SIZE, most: int = HEADING_LEVELS) -> DataFrame:
    """(keys, size, body, n, level): the body size carries most characters (ties to the larger, at least ``least``); up to six larger sizes are headings."""
    hist = spans.groupBy(*keys, half_up(size).alias("size")).agg(F.sum(weight).alias("n"))
    body = hist.groupBy(*keys).agg(F.greatest(F.max_by("size", F.struct("n", "size")), F.lit(least)).alias("body"))
    larger = hist.join(body, keys).where("size > body")
    order = Window.partitionBy(*keys).orderBy(F.desc("size"))
    return larger.withColumn("level", F.row_number().over(order)).where(F.col("level") <= most).select(*keys, "size", "body", "n", "level")


def document_headings(lines: DataFrame) -> DataFrame:
    """(doc, headings): of each document the level of each heading size, from the spans of its lines."""
    spans = lines.select("doc", F.explode("spans").alias("s")).where(~is_white(F.col("s.text")))
    levels = heading_levels(spans, ["doc"], F.col("s.size"), F.char_length(F.trim("s.text")))
    return levels.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct(F.col("size").cast("long"), F.col("level").cast("long")))).alias("headings"))  # six at most


def at_edge(y0: Column, y1: Column, height: Column) -> Column:
    return (y0 < height * EDGE) | (y1 > height * (1 - EDGE))


def running_counts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` (keys, page, text, bucket): pages on which a text stands at a place."""
    return lines.select(*keys, "page", "text", "bucket").distinct().groupBy(*keys, "text", "bucket").agg(F.count("*").alias("pages"))


def strip_running(lines: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lines`` without what stands at one place of the page's edge on max(2, half) of the pages, or is a page number where such numbers stand so often; and (doc, page, removed): letters taken out.

    ``pages`` (doc, page, height) counts pages without lines, too. Of a page only the first line at a place says whether a number stands there.
    """
    need = pages.groupBy("doc").agg(F.greatest(F.lit(RUNNING_PAGES), F.ceil(F.count("*") * RUNNING_SHARE)).alias("need"))
    placed = lines.join(pages.select("doc", "page", "height"), ["doc", "page"]).withColumn("bucket", half_up(F.col("y0") / BUCKET))
    edge = at_edge(F.col("y0"), F.col("y1"), F.col("height")) & (F.col("text") != "")
    number = F.col("text").rlike("^[0-9]{1,4}$")
    edges = placed.where(edge).withColumn("first", F.row_number().over(Window.partitionBy("doc", "page", "bucket").orderBy("line")) == 1)
    often = running_counts(edges, ["doc"]).join(need, "doc").where("pages >= need").select("doc", "text", "bucket", F.lit(True).alias("repeated"))
    numbers = edges.where(number & F.col("first")).groupBy("doc", "bucket").agg(F.count("*").alias("pages")).join(need, "doc").where("pages >= need").select("doc", "bucket", F.lit(True).alias("numbered"))
    judged = placed.join(often, ["doc", "text", "bucket"], "left").join(numbers, ["doc", "bucket"], "left")
    gone = edge & (F.coalesce("repeated", F.lit(False)) | (number & F.coalesce("numbered", F.lit(False))))
    judged = judged.withColumn("_gone", gone)
    return judged.where(~F.col("_gone")).select(*lines.columns), judged.where("_gone").groupBy("doc", "page").agg(F.sum(letters(F.col("text"))).alias("removed"))


def nearest_column(points: DataFrame, x: str, centres: list[float]) -> DataFrame:
    """``centre`` nearest to ``x``, ties to the first; the centres are parameters, so no join is needed."""
    found = F.array(*[F.struct(F.abs(F.col(x) - c).alias("d"), F.lit(k).alias("k"), F.lit(float(c)).alias("c")) for k, c in enumerate(centres)])
    return points.withColumn("centre", F.array_min(found)["c"])


def inside_first(points: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """For each point (keys, id, x, y) the first rectangle (keys, ord, x0, y0, x1, y1) that holds it."""
    within = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    met = points.join(rects, keys).where(within)
    return met.groupBy(*keys, "id").agg(F.min("ord").alias("ord"))


def inside_first_of(x: Column, y: Column, rects: list[tuple[float, float, float, float]]) -> Column:
    """Number (from 1) of the first of a few given rectangles that holds a point: parameters need no join."""
    return F.coalesce(*[F.when(x.between(x0, x1) & y.between(y0, y1), F.lit(k)) for k, (x0, y0, x1, y1) in enumerate(rects, 1)], F.lit(None).cast("int"))


def table_bands(lines: DataFrame, least: int = 2) -> DataFrame:
    """Runs of at least two consecutive lines (doc, page, line, spans: how many) with several spans."""
    several = F.col("spans") >= least
    w = Window.partitionBy("doc", "page").orderBy("line")
    runs = islands(lines.withColumn("_s", several), ["doc", "page"], ["line"], F.col("_s") != F.lag("_s").over(w))
    return runs.where("_s").groupBy("doc", "page", F.col("island").alias("band")).agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("lines")).where("lines >= 2")


# A page's text from its own lines.


def starts_with_bullet(text: str) -> bool:
    return bool(text) and ord(text[0]) in BULLETS and text[1:2] in ("", " ")


def linked(span: dict, links: list[dict]) -> str:
    """A span's text, as a link if its middle lies in a link's rectangle."""
    x, y, text = (span["x0"] + span["x1"]) / 2, (span["y0"] + span["y1"]) / 2, span["text"].strip()
    for link in links:
        if link["x0"] <= x <= link["x1"] and link["y0"] <= y <= link["y1"]:
            uri = "".join(f"%{ord(c):02x}" if c in "()\n" else c for c in link["uri"])
            return f"[{text}]({uri})"
    return text


def tables(lines: list[dict]) -> dict[int, str]:
    """Tables as Markdown by the number of their first line: runs of two or more lines that begin at several places, with two or more columns and two filled cells in each row."""
    runs, at = [], []
    for k, line in enumerate([*lines, {"spans": []}]):
        if len({int(s["x0"] / COLUMN_GAP + 0.5) for s in line["spans"]}) >= 2:
            at.append(k)
            continue
        runs += [at] if len(at) >= 2 else []
        at = []
    out = {}
    for run in runs:
        columns: list[float] = []
        for x in sorted(s["x0"] for k in run for s in lines[k]["spans"]):
            if not any(abs(c - x) <= COLUMN_GAP for c in columns):
                columns.append(x)
        rows = []
        for k in run:
            cells: list[list[str]] = [[] for _ in columns]
            for s in lines[k]["spans"]:
                cells[min(range(len(columns)), key=lambda c: (abs(s["x0"] - columns[c]), c))] += [s["text"].strip()] if s["text"].strip() else []
            rows.append([" ".join(c) for c in cells])
        if len(columns) >= 2 and all(sum(map(bool, r)) >= 2 for r in rows):
            head = [c.replace("\n", "<br>") or f"Col{k + 1}" for k, c in enumerate(rows[0])]
            out[run[0]] = "".join("|" + "|".join(r) + "|\n" for r in [head, ["---"] * len(columns), *rows[1:]]) + "\n"
    return out


def _styled(span: dict, links: list[dict]) -> str:
    marks = ("**" if span["bold"] else "") + ("_" if span["italic"] else "") + ("`" if span["mono"] else "")
    part = marks + linked(span, links) + marks + " "
    if not starts_with_bullet(part):
        return part
    part = ("- " + part[1:]).replace("  ", " ")
    wide = (span["x1"] - span["x0"]) / len(span["text"]) if span["x1"] > span["x0"] else span["size"] * 0.5
    return " " * int(span["x0"] / wide + 0.5) + part


def page_markdown(lines: list[dict], headings: dict[int, int], links: list[dict]) -> str:
    """A page's lines as Markdown: headings by size, code, lists, links, emphasis, and tables ahead of the lines they are made of."""
    out: list[str] = []
    before = block = heading = None
    code = False
    found = tables(lines)
    for k, line in enumerate(lines):
        spans, height = line["spans"], line["y1"] - line["y0"]
        if k in found:
            out.append("\n" + found[k])
        apart = before is not None and line["y1"] - before["y1"] > 1.5 * height
        out += ["\n"] if apart else []
        text = " ".join(s["text"] for s in spans).strip()
        bold, italic, mono = (all(s[style] for s in spans) for style in ("bold", "italic", "mono"))
        levels = [headings[n] for s in spans if (n := int(s["size"] // 1 + (s["size"] % 1 >= 0.5))) in headings]
        if levels:
            for on, mark in ((mono, "`"), (italic, "_"), (bold, "**")):
                text = mark + text + mark if on else text
            if heading == min(levels):  # a heading that goes on
                out = ["".join(out).rstrip("\n"), " " + text + "\n"]
            else:
                out.append("#" * min(levels) + " " + text + "\n")
            heading, before = min(levels), line
            continue
        heading = None
        if mono:
            out += [] if code else ["```\n"]
            out.append(" " * max(0, int(line["x0"] // (spans[0]["size"] * 0.5))) + text + "\n")
            code, before = True, line
            continue
        out += ["```\n"] if code else []
        code = False
        if spans[0]["block"] != block:
            out.append("\n")
            block = spans[0]["block"]
        if before is not None and (apart or spans[0]["text"].startswith("[") or starts_with_bullet(spans[0]["text"])):
            out.append("\n")
        out += [_styled(s, links) for s in spans] + ["\n"]
        before = line
    return "".join(out) + "\n" + ("```\n" if code else "") + "\n\n"


@F.arrow_udf(StringType())
def _page_text(lines: pa.Array, headings: pa.Array, links: pa.Array) -> pa.Array:
    return pa.array([page_markdown(a or [], {e["key"]: e["value"] for e in b or []}, c or []) for a, b, c in zip(lines.to_pylist(), headings.to_pylist(), links.to_pylist())], pa.string())


def corrupted(text: Column) -> Column:
    """Whether too many glyphs are presentation forms or replacements."""
    most = F.greatest(F.lit(BAD_GLYPHS), F.char_length(text) * BAD_SHARE)
    return (F.regexp_count(text, F.lit(SHAPED)) > most) | (F.regexp_count(text, F.lit("\ufffd")) > most)


def incomplete(text: Column, plain_letters: Column) -> Column:
    return (plain_letters >= WHOLE_LETTERS) & (letters(text) < WHOLE_SHARE * plain_letters)


def page_texts(spans: DataFrame, pages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(doc, page, text) of ``pages`` (doc, page, height, plain) and their ``spans`` and ``links`` (doc, page, ord, x0, y0, x1, y1, uri).

    Running lines go first, headings are judged over the document, and a page whose Markdown is corrupted or lacks letters gives its plain text.
    """
    lines, removed = strip_running(merge_lines(spans), pages)
    line = F.struct("line", "x0", "y0", "x1", "y1", "spans")
    held = lines.groupBy("doc", "page").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    rows = pages.join(held, ["doc", "page"], "left").join(document_headings(lines), "doc", "left").join(removed, ["doc", "page"], "left")
    if links is not None:
        rect = F.struct("ord", "x0", "y0", "x1", "y1", "uri")
        rows = rows.join(links.groupBy("doc", "page").agg(F.array_sort(F.collect_list(rect)).alias("links")), ["doc", "page"], "left")
    else:
        rows = rows.withColumn("links", F.array().cast("array<struct<ord:int,x0:double,y0:double,x1:double,y1:double,uri:string>>"))
    rows = rows.withColumn("markdown", _page_text("lines", F.map_entries("headings"), "links"))
    left = F.greatest(F.lit(0), letters(F.col("plain")) - F.coalesce("removed", F.lit(0)))
    bad = corrupted(F.col("markdown")) | incomplete(F.col("markdown"), left)
    return rows.select("doc", "page", F.when(bad, F.col("plain")).otherwise(F.col("markdown")).alias("text"))


def assemble(pages: DataFrame, most: int = 50) -> DataFrame:
    """One text a document of its pages (doc, page from 1, text) up to ``most``: a heading a page, and a notice if there are more."""
    shown = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    part = F.struct("page", F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), shown).alias("part"))
    rows = pages.groupBy("doc").agg(F.count_if(F.col("page") > most).alias("more"), F.array_sort(F.collect_list(F.when((F.col("page") <= most) & (shown != ""), part))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")
    empty = F.when(F.col("more") > 0, F.lit(f"(PDF contains no extractable text in the first {most} pages)")).otherwise(F.lit(""))
    return rows.select("doc", F.when(text == "", empty).otherwise(F.concat(text, F.when(F.col("more") > 0, F.lit(f"\n\n... (PDF extraction is capped at {most} pages)")).otherwise(F.lit("")))).alias("text"))


