"""Text of PDF files without a PDF library: content streams, inflated, their text operators read."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PAGES, INFLATED = 50, 64 << 20
# The wording for what can't be read.
UNREADABLE, CUT_UNREADABLE = "(PDF content could not be read as text)", "(PDF content could not be read as text; the download was truncated at the download limit)"
NO_TEXT = "(PDF contains no extractable text)"

_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_MARK = re.compile(r"%[^\n]*|[(\[<]|['\"]|BT|ET|T[dDm*]")
_HEX = re.compile(r"<([0-9A-Fa-f\s]*)>")
_ENDS = re.compile(r"\\.|[()]|\\$", re.S)
_ESCAPE = re.compile(r"\\(?:([0-7]{1,3})|(\r\n|[\r\n])|(.)|$)", re.S)
_NAMED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _string(text: str, at: int) -> tuple[str, int]:
    """The string whose ``(`` is at ``at``, and the place behind it; without its end, all that follows."""
    depth, begin = 1, at + 1
    for m in _ENDS.finditer(text, begin):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth:
            return _ESCAPE.sub(_meant, text[begin : m.start()]), m.end()
    return _ESCAPE.sub(_meant, text[begin:]), len(text)


def _meant(m: re.Match) -> str:
    if m[1]:
        return chr(int(m[1], 8))
    return "" if m[2] else _NAMED.get(m[3], m[3] or "")


def _array(text: str, at: int) -> tuple[str, int]:
    """The strings of the array whose ``[`` is at ``at``, and the place behind it."""
    parts, depth, at = [], 1, at + 1
    while depth:
        m = re.compile(r"[(\[\]]").search(text, at)
        if not m:
            return "".join(parts), len(text)
        if m[0] == "(":
            part, at = _string(text, m.start())
            parts.append(part)
        else:
            depth += 1 if m[0] == "[" else -1
            at = m.end()
    return "".join(parts), at


def stream_text(stream: bytes) -> str:
    """The strings that a content stream shows between BT and ET, with a new line at each move."""
    text, out, shows, at = stream.decode("latin-1"), [], False, 0
    while m := _MARK.search(text, at):
        mark, at, said = m[0], m.end(), ""
        if mark == "(":
            said, at = _string(text, m.start())
        elif mark == "[":
            said, at = _array(text, m.start())
        elif mark == "<":
            digits = _HEX.match(text, m.start())
            plain = re.sub(r"\s", "", digits[1]) if digits else "x"
            if digits and len(plain) % 2 == 0:
                said, at = bytes.fromhex(plain).decode("latin-1"), digits.end()
        elif mark in ("BT", "ET"):
            shows = mark == "BT"
        elif mark[0] != "%":
            said = "\n"
        if shows:
            out.append(said)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(out))).strip()


def streams(content: bytes | None) -> list[bytes] | None:
    """The streams of a file, inflated; None if it is encrypted or has none. Streams that can't be inflated go."""
    if not content or re.search(rb"/Encrypt\b", content):
        return None
    out = []
    for m in _STREAM.finditer(content):
        body = m[1]
        if b"/FlateDecode" in content[max(0, content.rfind(b"<<", 0, m.start())) : m.start()]:
            try:
                inflater = zlib.decompressobj()
                body = inflater.decompress(body, INFLATED)
                if inflater.unconsumed_tail or not inflater.eof:
                    continue
            except zlib.error:
                continue
        out.append(body)
    return out or None


def pdf_pages(content: bytes | None) -> list[tuple[int, str, str | None]]:
    """(page, text, error); a stream is a page, and the first 50 are read."""
    found = streams(content)
    return [(0, "", UNREADABLE)] if found is None else [(k, stream_text(s), None) for k, s in enumerate(found[:PAGES], 1)]


def pdf_text(content: bytes | None) -> str | None:
    """A file's text under a heading a page, with a notice beyond 50; None if it can't be read."""
    found = streams(content)
    if found is None:
        return None
    parts = [f"## Page {k}\n\n{text}" for k, s in enumerate(found[:PAGES], 1) if (text := stream_text(s))]
    more = len(found) > PAGES
    if not parts:
        return f"(PDF contains no extractable text in the first {PAGES} pages)" if more else ""
    return "\n\n".join(parts) + (f"\n\n... (PDF extraction is capped at {PAGES} pages)" if more else "")


@F.arrow_udf(StringType())
def pdf_body(content: pa.Array) -> pa.Array:
    return pa.array([None if c is None else pdf_text(c) for c in content.to_pylist()], pa.string())


def read_pdfs(files: DataFrame) -> DataFrame:
    """``files`` (path, content) to (path, page, text, error)."""

    def run(batches):
        for batch in batches:
            rows = [(path, *page) for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for page in pdf_pages(content)]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["path", "page", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page int, text string, error string")
