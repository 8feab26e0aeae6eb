"""Text predicates and projections as Column functions, and Arrow UDFs where code points must be walked."""

from __future__ import annotations

import html
import re
import unicodedata
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StringType, StructField, StructType

# White space of ECMAScript, and the subtypes of ``application`` that are no text.
SPACE_CHARS = "\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{SPACE_CHARS}]+"
BINARY_SUBTYPES = ["epub+zip", "gzip", "java-archive", "pdf", "vnd.apple.installer+xml", "wasm", "x-7z-compressed", "x-bzip2", "x-gzip", "x-rar-compressed", "x-tar", "x-xz", "zip", "zstd"]
# What binary files start with: PDF, ZIP, OLE, PNG, JPEG, GIF, gzip, bzip2, xz, zstd.
PDF_MAGIC = b"%PDF-"
MAGICS = [PDF_MAGIC, b"PK\x03\x04", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF87a", b"GIF89a", b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd"]
BINARY_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1a\x1c-\x1f\x7f-\x9f\ufffd]"
# Tags that a page may begin with.
HTML_TAGS = ["html", "head", "body", "title", "meta", "link", "script", "style", "article", "section", "main", "header", "footer", "nav", "aside", "figure", "form", "ul", "ol", "dl", "pre", "blockquote"]
HTML_START = rf"^<(?:!doctype\s+html|/?(?:{'|'.join(HTML_TAGS)})\b)"
HTML_DOCUMENT = r"^<(?:!doctype\s+html\b|/?(?:html|head|body)\b)"
# Wording of texts that are empty or cut.
NO_CONTENT = "(page returned no readable text)"
CUT = "... (page truncated at the download limit)"

_SPACES = re.compile(SPACE)
#: The same characters one by one.
SPACES = "".join(c for c in map(chr, (*range(0x3001), 0xFEFF)) if _SPACES.fullmatch(c))


def collapse(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def with_cut(text: Column, cut: Column) -> Column:
    """The notice behind a text whose download was cut."""
    return F.when(cut, F.concat(text, F.lit("\n\n" + CUT))).otherwise(text)


def truncate_text(text: Column, most: int | None) -> Column:
    """At most ``most`` characters, and how many there were; the notice of a cut download stays. An empty text says so."""
    empty = F.when(F.coalesce(text, F.lit("")) == "", F.lit(NO_CONTENT))
    if not most:
        return empty.otherwise(text)
    had = text.endswith(CUT)
    core = F.regexp_replace(F.when(had, F.left(text, F.char_length(text) - len(CUT))).otherwise(text), f"{SPACE}$", "")
    cut = F.concat(F.substring(core, 1, most), F.lit("\n\n... (truncated, "), F.char_length(text).cast("string"), F.lit(" chars total)"), F.when(had, F.lit("\n\n" + CUT)).otherwise(F.lit("")))
    return empty.when(F.char_length(text) > most, cut).otherwise(text)


def looks_binary(text: Column) -> Column:
    return F.regexp_count(text, F.lit(BINARY_CHARS)) > F.greatest(F.lit(16), F.floor(F.char_length(text) / 8))


def content_type(value: Column) -> Column:
    """The leading ``type/subtype`` in lower case, or an empty string."""
    return F.lower(F.regexp_extract(F.coalesce(value, F.lit("")), r"^[A-Za-z0-9_.+-]+/[A-Za-z0-9_.+-]+", 0))


def is_text_type(value: Column) -> Column:
    kind = content_type(value)
    return (kind == "") | kind.startswith("text/") | (kind.startswith("application/") & ~F.substring(kind, 13, 1 << 20).isin(BINARY_SUBTYPES))


def _head(body: Column) -> Column:
    """The first bytes in hex, without blanks around one byte-order mark."""
    return F.regexp_extract(F.hex(F.substring(body, 1, 1024)), "^(?:09|0A|0B|0C|0D|20)*+(?:(?:FFFE0000|0000FEFF|FFFE|FEFF|EFBBBF)(?:09|0A|0B|0C|0D|20)*+)?(.{0,32})", 1)


def has_pdf_magic(body: Column) -> Column:
    return _head(body).startswith(PDF_MAGIC.hex().upper())


def magic_of(body: Column) -> Column:
    """The magic number (hex) that bytes start with after blanks and a mark, or null."""
    return F.nullif(F.regexp_extract(_head(body), f"^({'|'.join(m.hex().upper() for m in MAGICS)})", 1), F.lit(""))


def ascii_share(body: Column) -> Column:
    """Share of bytes that are printable ASCII, tab, line feed, return or escape; 1 for no bytes."""
    text = F.decode(body, "ISO-8859-1")
    return F.when(F.octet_length(body) == 0, F.lit(1.0)).otherwise(F.regexp_count(text, F.lit(r"[\x20-\x7e\t\n\r\x1b]")) / F.char_length(text))


def single_byte_evidence(body: Column) -> Column:
    return ascii_share(body) >= 0.75


_AHEAD = r"(?s)\A(?:[ \t\n\r\f\x0b]|<!--.*?-->|<\?.*?\?>)++"


def _probe(text: Column) -> Column:
    return F.lower(F.substring(F.regexp_replace(text, _AHEAD, ""), 1, 256))


def looks_like_html(text: Column) -> Column:
    return _probe(text).rlike(HTML_START)


def looks_like_html_document(text: Column) -> Column:
    return _probe(text).rlike(HTML_DOCUMENT)


_SKIPPED = re.compile(r"[ \t\n\r\f\v]*(?:<!--|<\?|)")
_STARTS, _DOCUMENT = re.compile(HTML_START), re.compile(HTML_DOCUMENT)


def _first_markup(text: str) -> str:
    """256 characters in lower case from the first that is neither blank nor in a comment or instruction."""
    at = 0
    while True:
        m = _SKIPPED.match(text, at)
        opened = m[0].lstrip(" \t\n\r\f\v")
        end = {"<!--": "-->", "<?": "?>"}.get(opened)
        close = text.find(end, m.end()) if end else -1
        if close < 0:
            start = m.end() - len(opened)
            return text[start : start + 256].lower()
        at = close + len(end)


def looks_like_html_text(text: str) -> bool:
    return bool(_STARTS.search(_first_markup(text)))


def looks_like_html_document_text(text: str) -> bool:
    return bool(_DOCUMENT.search(_first_markup(text)))


def page_title(page: Column) -> Column:
    """The first ``title``, references undecoded: with built-in functions only."""
    return collapse_whitespace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def bom_codec(body: Column) -> Column:
    h = F.hex(F.substring(body, 1, 4))
    return (
        F.when(h.startswith("FFFE0000"), "utf-32le").when(h.startswith("0000FEFF"), "utf-32be").when(h.startswith("EFBBBF"), "utf-8").when(h.startswith("FFFE"), "utf-16le").when(h.startswith("FEFF"), "utf-16be")
    )


def header_charset(value: Column) -> Column:
    """The ``charset`` of a content type's header, as it stands."""
    return F.nullif(F.regexp_extract(value, r"(?i)charset=([^;\s]+)", 1), F.lit(""))


def meta_charset(body: Column) -> Column:
    """The codec that the first 1,024 bytes of a page declare, or null."""
    head = F.lower(F.decode(F.substring(body, 1, 1024), "ISO-8859-1"))
    named = F.regexp_extract(head, r"""<meta\b[^>]*\bcharset\s*=\s*["']?\s*([a-z0-9_.\-]+)""", 1)
    return F.when(named != "", normalize_charset(named))


# The codecs of charset labels.
CODECS = {
    "utf-8": "utf-8", "utf8": "utf-8", "utf-8-sig": "utf-8",
    "iso-8859-1": "iso8859-1", "iso8859-1": "iso8859-1", "latin1": "iso8859-1", "latin-1": "iso8859-1", "us-ascii": "iso8859-1", "ascii": "iso8859-1",
    "windows-1252": "cp1252", "cp1252": "cp1252", "x-cp1252": "cp1252",
    "utf-16": "utf-16le", "utf-16le": "utf-16le", "utf16le": "utf-16le", "ucs-2": "utf-16le", "ucs2": "utf-16le", "utf-16be": "utf-16be", "utf16be": "utf-16be",
    "utf-32": "utf-32le", "utf-32le": "utf-32le", "utf-32be": "utf-32be",
    "gbk": "gbk", "gb2312": "gbk", "gb-2312": "gbk", "cp936": "gbk", "x-gbk": "gbk", "gb18030": "gb18030", "big5": "big5", "big5-hkscs": "big5",
    "sjis": "shift_jis", "x-sjis": "shift_jis", "cp932": "shift_jis", "shift-jis": "shift_jis", "euc-jp": "euc-jp", "euc-kr": "euc-kr", "ksc5601": "euc-kr", "ks_c_5601-1987": "euc-kr", "ks_c_5601-1989": "euc-kr",
    "iso-2022-jp": "iso-2022-jp", "koi8-r": "koi8-r", "koi8-u": "koi8-u", "cp866": "cp866", "x-mac-cyrillic": "x-mac-cyrillic", "windows-874": "windows-874", "cp874": "windows-874", "tis-620": "tis-620",
}


def normalize_charset(label: Column) -> Column:
    """The codec of a label, or null for labels that none is known for."""
    name = F.lower(F.regexp_replace(collapse_whitespace(label), "[\"']", ""))
    known = F.create_map(*[F.lit(x) for pair in CODECS.items() for x in pair])
    numbered = name.rlike("^windows-125[0-8]$") | name.rlike("^iso-8859-([2-9]|1[0-6])$")
    return F.coalesce(F.try_element_at(known, name), F.when(numbered, name))


def codec_of(body: Column, value: Column) -> Column:
    """Byte-order mark, then header, then the tag of an HTML page, then UTF-8."""
    page = F.contains(content_type(value), F.lit("html")) | looks_like_html_document(F.decode(F.substring(body, 1, 256), "ISO-8859-1"))
    return F.coalesce(bom_codec(body), normalize_charset(header_charset(value)), F.when(page, meta_charset(body)), F.lit("utf-8"))


def _column(values, kind):
    return pa.array(values, kind)


@F.arrow_udf(StringType())
def decode_entities(text: pa.Array) -> pa.Array:
    return _column([None if t is None else html.unescape(t) for t in text.to_pylist()], pa.string())


_MARKUP = re.compile("<[^\n\r\u2028\u2029]*?>")


def normal_text(raw: str) -> str:
    """Without tags (in a line), entities decoded, NFC, without control and format characters, blanks collapsed."""
    text = unicodedata.normalize("NFC", html.unescape(_MARKUP.sub("", raw)))
    return collapse("".join(c for c in text if unicodedata.category(c) not in ("Cc", "Cf", "Co", "Cs", "Cn")))


@F.arrow_udf(StringType())
def normalize_text(text: pa.Array) -> pa.Array:
    return _column([None if t is None else normal_text(t) for t in text.to_pylist()], pa.string())


#: Python's codecs where they go by another name or differ from what browsers read.
_PYTHON = {"utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "shift_jis": "cp932", "euc-kr": "cp949", "gbk": "gb18030", "big5": "big5hkscs", "x-mac-cyrillic": "mac-cyrillic", "windows-874": "cp874", "iso8859-1": "latin-1"}
#: What browsers read for the bytes of windows-1252 that Python leaves undefined.
_C1 = {b: chr(b) for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _utf32(body: bytes, big: bool) -> str:
    """Code points of four bytes; null, surrogates and what lies beyond Unicode are U+FFFD; bytes left over go."""
    order = "big" if big else "little"
    points = [int.from_bytes(body[k : k + 4], order) for k in range(0, len(body) - 3, 4)]
    if points[:1] == [0xFEFF]:
        del points[0]
    return "".join("�" if v == 0 or v > 0x10FFFF or 0xD800 <= v <= 0xDFFF else chr(v) for v in points)


def decode_bytes(body: bytes | None, codec: str | None) -> str | None:
    """Never fails: bad bytes are U+FFFD, a leading mark goes, without a known codec each byte is a character."""
    if body is None:
        return None
    name = codec or "iso8859-1"
    if name in ("utf-32le", "utf-32be"):
        return _utf32(body, name == "utf-32be")
    if name == "cp1252":
        return "".join(_C1.get(b) or bytes([b]).decode("cp1252") for b in body) if any(b in _C1 for b in body) else body.decode("cp1252")
    if name == "tis-620":
        return "".join(chr(b) if b < 0x80 else "\xa0" if b == 0xA0 else chr(0xE01 + b - 0xA1) if 0xA1 <= b <= 0xFB else "�" for b in body)
    try:
        text = body.decode(_PYTHON.get(name, name), "replace")
    except (LookupError, ValueError):
        return body.decode("latin-1")
    return text[1:] if name.startswith("utf") and text.startswith("\ufeff") else text


@F.arrow_udf(StringType())
def decode_body(body: pa.Array, codec: pa.Array) -> pa.Array:
    return _column([decode_bytes(b, c) for b, c in zip(body.to_pylist(), codec.to_pylist())], pa.string())


INFLATED_CAP = 64 << 20
_STEP = 1 << 16


def _inflate(body: bytes, wbits: int, most: int) -> tuple[bytes | None, bool]:
    """What can be read up to the first error or ``most`` bytes, members of gzip in a row (null if nothing can), and whether something is missing."""
    out, rest, cut = bytearray(), body, False
    while rest and len(out) < most:
        stream, at = zlib.decompressobj(wbits), 0
        try:
            while at < len(rest) and not stream.eof and len(out) < most:
                out += stream.decompress(rest[at : at + _STEP], most - len(out))
                at += _STEP
                while stream.unconsumed_tail and len(out) < most:
                    out += stream.decompress(stream.unconsumed_tail, most - len(out))
        except zlib.error:
            cut = True
            break
        cut = not stream.eof
        rest = stream.unused_data + rest[at:] if stream.eof and wbits > 15 else b""
    return (bytes(out) if out or not body else None), cut


def inflate(body: bytes | None, encoding: str | None, most: int = INFLATED_CAP) -> tuple[bytes | None, bool]:
    """A body without its content coding (gzip, deflate with or without its header), null where the coding is unknown or nothing can be read; and whether it breaks off."""
    coding = (encoding or "").split(",")[0].strip().lower()
    if body is None or coding in ("", "identity"):
        return body, False
    if coding in ("gzip", "x-gzip"):
        return _inflate(body, 31, most)
    if coding == "deflate":
        found = _inflate(body, 15, most)
        return _inflate(body, -15, most) if found[0] is None else found
    return None, False


def decompress_bytes(body: bytes | None, encoding: str | None, most: int = INFLATED_CAP) -> bytes | None:
    return inflate(body, encoding, most)[0]


@F.arrow_udf(BinaryType())
def decompress(body: pa.Array, encoding: pa.Array) -> pa.Array:
    return _column([decompress_bytes(b, e) for b, e in zip(body.to_pylist(), encoding.to_pylist())], pa.binary())


INFLATED = StructType([StructField("body", BinaryType()), StructField("cut", BooleanType())])


@F.arrow_udf(INFLATED)
def inflated(body: pa.Array, encoding: pa.Array) -> pa.Array:
    """Struct (body, cut): a body without its content coding, or as it is where that can't be read; and whether it breaks off."""
    out = []
    for b, e in zip(body.to_pylist(), encoding.to_pylist()):
        found, cut = inflate(b, e)
        out.append({"body": b if found is None else found, "cut": cut and found is not None})
    return pa.array(out, pa.struct([("body", pa.binary()), ("cut", pa.bool_())]))


# The same tests on one body, for functions that hold its bytes anyway.

_TYPE, _CHARSET = re.compile(r"[A-Za-z0-9_.+-]+/[A-Za-z0-9_.+-]+"), re.compile(r"charset=([^;\s]+)", re.I)
_META = re.compile(rb"""<meta\b[^>]*\bcharset\s*=\s*["']?\s*([a-z0-9_.\-]+)""")
_START = re.compile(rb"[\t-\r ]*(?:(?:\xff\xfe\0\0|\0\0\xfe\xff|\xff\xfe|\xfe\xff|\xef\xbb\xbf)[\t-\r ]*)?")
_NUMBERED = re.compile(r"windows-125[0-8]|iso-8859-(?:[2-9]|1[0-6])")
_ODD = re.compile(BINARY_CHARS)
_MARKS = [(b"\xff\xfe\0\0", "utf-32le"), (b"\0\0\xfe\xff", "utf-32be"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"), (b"\xef\xbb\xbf", "utf-8")]
_ASCII_TEXT = bytes([*range(0x20, 0x7F), 9, 10, 13, 27])


def type_of(value: str | None) -> str:
    m = _TYPE.match(value or "")
    return m[0].lower() if m else ""


def is_text_kind(kind: str) -> bool:
    return not kind or kind.startswith("text/") or (kind.startswith("application/") and kind[12:] not in BINARY_SUBTYPES)


def magic_in(body: bytes) -> bytes | None:
    """The magic number that bytes start with after blanks and a mark."""
    head = body[:1024]
    start = _START.match(head).end()
    return next((m for m in MAGICS if head.startswith(m, start)), None)


def codec_named(label: str | None) -> str | None:
    name = re.sub("[\"']", "", (label or "").strip(SPACES)).lower()
    return CODECS.get(name) or (name if _NUMBERED.fullmatch(name) else None)


def declared_codec(value: str | None) -> str | None:
    m = _CHARSET.search(value or "")
    return codec_named(m[1]) if m else None


def codec_for(body: bytes, value: str | None) -> str:
    """``codec_of`` of one body."""
    for mark, codec in _MARKS:
        if body.startswith(mark):
            return codec
    if codec := declared_codec(value):
        return codec
    if "html" in type_of(value) or looks_like_html_document_text(body[:256].decode("latin-1")):
        m = _META.search(body[:1024].lower())
        if m and (codec := codec_named(m[1].decode())):
            return codec
    return "utf-8"


def is_odd(text: str) -> bool:
    """``looks_binary`` of one text."""
    return len(text) - len(_ODD.sub("", text)) > max(16, len(text) // 8)


def mostly_ascii(body: bytes) -> bool:
    return not body or 4 * (len(body) - len(body.translate(None, _ASCII_TEXT))) >= 3 * len(body)


_NOSCRIPT, _TAGS = re.compile(r"<noscript\b[^>]*>[\s\S]*?</noscript>", re.I), re.compile(r"<[^>]*>")


def noscript_of(page: str) -> str:
    """The text inside ``noscript`` elements, one after the other."""
    if "</noscript>" not in page.lower():
        return ""
    return collapse(html.unescape(" ".join(_TAGS.sub(" ", m) for m in _NOSCRIPT.findall(page))))


def noscript_text(page: Column) -> Column:
    """``noscript_of`` as a column."""
    found = F.regexp_extract_all(page, F.lit(r"(?is)<noscript\b[^>]*>.*?</noscript>"), F.lit(0))
    parts = F.transform(found, lambda m: F.regexp_replace(m, "<[^>]*>", " "))
    return collapse_whitespace(decode_entities(F.array_join(parts, " ")))
