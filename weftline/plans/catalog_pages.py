"""Queries over bytes, texts and pages, with their SQL. What the SQL expects is written out as literals."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import markdown as M
from weftline.functions import text as T
from weftline.functions.html_tree import parse
from weftline.functions.xpath import compile_path, select
from weftline.operators import layout
from weftline.plans import fetch, settings
from weftline.plans.registry import literal, query, table, turn, turn_sql
from weftline.sources import pdf_text
from weftline.streaming import windowed_counts

# Texts.


@query("select doc_id, trim(regexp_replace(text, '[\\t\\n\\x0b\\x0c\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g')) as text from documents")
def collapse_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_whitespace(F.col("text")).alias("text"))


_CUT = "... (page truncated at the download limit)"


@query(f"""select doc_id, case when coalesce(text, '') = '' and doc_id % 3 > 0 then '(page returned no readable text)' when n > 500 then rtrim(substr(regexp_replace(coalesce(text, ''), '\\s+$', ''), 1, 500)) || chr(10) || chr(10) || '... (truncated, ' || n || ' chars total)' || case doc_id % 3 when 0 then chr(10) || chr(10) || '{_CUT}' else '' end
 when doc_id % 3 = 0 then coalesce(text, '') || chr(10) || chr(10) || '{_CUT}' else text end as text from (select *, length(coalesce(text, '')) + case doc_id % 3 when 0 then {len(_CUT) + 2} else 0 end as n from documents)""".replace("rtrim(substr(", "(substr("))
def truncate_text(spark, sf_dir):
    """Texts of all lengths, every third with the notice of a cut download."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, T.with_cut(F.coalesce("text", F.lit("")), F.lit(True))).otherwise(F.col("text"))
    return docs.select("doc_id", T.truncate_text(text, 500).alias("text"))


@query("select doc_id, case when doc_id % 2 = 0 then length(coalesce(text, '')) + 40 else 0 end + case when doc_id % 2 = 0 then 0 else length(regexp_replace(text, '[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1a\\x1c-\\x1f\\x7f-\\x{9f}\\x{fffd}]', '', 'g')) end > case when doc_id % 2 = 0 then (length(coalesce(text, '')) * 2 + 80) // 2 else greatest(16, length(text) // 8) end as binary from documents where text is not null and doc_id % 2 = 1 union all select doc_id, k > greatest(16, (length(coalesce(text, '')) + k) // 8) as binary from (select *, 40 as k from documents where text is not null and doc_id % 2 = 0)")
def binary_ratio(spark, sf_dir):
    """Texts as they are, and with forty control characters behind them (some that count, none that doesn't)."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    odd = F.lit("\x0b\x0c\x80\x9f�\x00\x1f\x7f" * 5)
    return docs.select("doc_id", T.looks_binary(F.when(F.col("doc_id") % 2 == 0, F.concat("text", odd)).otherwise(F.col("text"))).alias("binary"))


_TYPES = ["text/html; charset=x", "application/pdf", "image/png", "", "application/json", "application/zip", "application/epub+zip", "application/vnd.apple.installer+xml", "application/octet-stream", "Application/X-Tar", "application/vnd.rar", "no type", "application/java-archive", "application/zstd"]
_TEXT = [True, False, False, True, True, False, False, False, True, False, True, True, False, False]


@query(f"select item_id, {turn_sql([t.split(';')[0].lower() if '/' in t else '' for t in _TYPES], 'item_id')} as kind, {turn_sql(_TEXT, 'item_id')} as is_text from benchmark")
def mime_gate(spark, sf_dir):
    value = turn(_TYPES, F.col("item_id"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.content_type(value).alias("kind"), T.is_text_type(value).alias("is_text"))


_BYTES = ["255044462D312E34", "504B030414", "D0CF11E0A1B11AE1", "89504E470D0A1A0A", "FFD8FFE0", "474946383761", "474946383961", "1F8B08", "425A6839", "FD377A585A00", "28B52FFD00", "526172211A07", "7F454C46", "4F676753", "2020EFBBBF0A25504446", "68656C6C6F", "474946383061"]
_BINARY = [True] * 11 + [False] * 6


@query(f"select item_id, {turn_sql(_BINARY, 'item_id')} as binary, {turn_sql([True] + [False] * 16, 'item_id')} as pdf from benchmark")
def byte_magic(spark, sf_dir):
    """What files begin with: all that count as binary, and others that don't (RAR, ELF, Ogg)."""
    body = F.unhex(turn(_BYTES, F.col("item_id")))
    return table(spark, sf_dir, "benchmark").select("item_id", T.magic_of(body).isNotNull().alias("binary"), T.has_pdf_magic(body).alias("pdf"))


@query("select doc_id, length(regexp_replace(text, '[^\\x20-\\x7e\\t\\n\\r\\x1b]', '', 'g')) * 4 >= 3 * strlen(text) as evidence from documents where text <> ''")
def single_byte_evidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", T.single_byte_evidence(F.encode("text", "utf-8")).alias("evidence"))


_STARTS = ["<!doctype html>x", "<!-- a --><?xml v?>\n <HTML>", "<aside>x", "<pre>x", "</html>", "<div>x", "<span>x", "<!-- open <html>", "# <html>", "<header>", "<table>", "<bodyx>", "\f<ul class=a>", "<p>x", "<blockquote>q"]
_HTML = [True, True, True, True, True, False, False, False, False, True, False, False, True, False, True]
_DOC = [True, True, False, False, True, False, False, False, False, False, False, False, False, False, False]


@query(f"select page_id, page_id % 2 = 0 or {turn_sql(_HTML, '(page_id // 2)')} as is_html, page_id % 2 = 0 or {turn_sql(_DOC, '(page_id // 2)')} as is_document from pages")
def html_sniff(spark, sf_dir):
    """Pages, and what does or doesn't begin like one."""
    n = F.col("page_id")
    body = F.when(n % 2 == 0, F.col("html")).otherwise(turn(_STARTS, F.floor(n / 2)))
    return table(spark, sf_dir, "pages").select("page_id", T.looks_like_html(body).alias("is_html"), T.looks_like_html_document(body).alias("is_document"))


_LABELS = ["UTF8", "latin1", " Windows-1252", "'GB2312'", "Shift-JIS", "ks_c_5601-1987", "windows-1251", "iso-8859-15", "cp874", "utf-16", "x-nope", "iso-8859-17"]


@query(f"select o_orderkey, {turn_sql(['utf-8', 'iso8859-1', 'cp1252', 'gbk', 'shift_jis', 'euc-kr', 'windows-1251', 'iso-8859-15', 'windows-874', 'utf-16le', None, None], 'o_orderkey')} as codec from orders")
def charset_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.normalize_charset(turn(_LABELS, F.col("o_orderkey"))).alias("codec"))


_HEADS = ["EFBBBF78", "FFFE7800", "FEFF0078", "FFFE000078000000", "0000FEFF00000078", "78", "3C6D65746120636861727365743D67626B3E", "3C68746D6C3E3C6D65746120636861727365743D224B4F49382D52223E", "78"]
_KINDS = ["text/html; charset=gbk", "text/html", "", "text/html", "", "text/plain; Charset=latin1;x", "text/html", "", "text/html; charset=nope"]


@query(f"select o_orderkey, {turn_sql(['utf-8', 'utf-16le', 'utf-16be', 'utf-32le', 'utf-32be', 'iso8859-1', 'gbk', 'koi8-r', 'utf-8'], 'o_orderkey')} as codec from orders")
def charset_precedence(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.codec_of(F.unhex(turn(_HEADS, n)), turn(_KINDS, n)).alias("codec"))


@query("select doc_id, text from documents where text is not null")
def charset_decode(spark, sf_dir):
    """Whole texts through five encodings, with their byte-order marks."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    n = F.col("doc_id") % 5
    body = F.when(n == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(n == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(n == 2, F.encode("text", "UTF-16BE")).when(n == 3, F.concat(F.unhex(F.lit("0000FEFF")), F.encode("text", "UTF-32"))).otherwise(F.encode("text", "UTF-8"))
    codec = F.coalesce(T.bom_codec(body), F.when(n == 2, F.lit("utf-16be")).otherwise(F.lit("utf-8")))
    return docs.select("doc_id", T.decode_body(body, codec).alias("text"))


_SINGLE = [("80E96F", "cp1252", "€éo"), ("81", "cp1252", "\x81"), ("A1E0", "tis-620", "กเ"), ("E9", "iso8859-1", "é"), ("D0D2", "koi8-r", "пр"), ("82A0", "shift_jis", "あ"), ("FF", "nope", "ÿ"), ("78FF", "utf-8", "x�"), ("00D80000FFFE0000", "utf-32le", "��"), ("C4E3", "gbk", "你")]


@query(f"select o_orderkey, {turn_sql([t for _, _, t in _SINGLE[:1] + _SINGLE[2:7] + _SINGLE[7:8] + _SINGLE[9:]], 'o_orderkey')} as text from orders")
def charset_cases(spark, sf_dir):
    own = _SINGLE[:1] + _SINGLE[2:7] + _SINGLE[7:8] + _SINGLE[9:]
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.decode_body(F.unhex(turn([h for h, _, _ in own], n)), turn([c for _, c, _ in own], n)).alias("text"))


_REFS = ["&amp;&lt;&#65;&#x42;", "&notit; &notin;", "&#128;&#x80;", "&nosuch; &amp", "&eacute&Eacute;", "AT&T", "&#0;|&#55296;|&#1114112;", "&CounterClockwiseContourIntegral;"]
_READ = ["&<AB", "¬it; ∉", "€€", "&nosuch; &", "éÉ", "AT&T", "�|�|�", "∳"]


@query(f"select page_id, case page_id % 2 when 0 then {turn_sql(_READ, '(page_id // 2)')} else replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '&am<', '&amp;am<', 'g'), '&amp<', '&amp;<', 'g'), '&(h|m|c|<)', '&\\1', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&amp;', '&') end as text from pages")
def entity_decode(spark, sf_dir):
    """Whole pages, and references of all kinds."""
    n = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", T.decode_entities(F.when(n % 2 == 0, turn(_REFS, F.floor(n / 2))).otherwise(F.col("html"))).alias("text"))


_RAW = ["<b>Hello</b>   &amp;   world", "line​break", "a<br\nb>c", "café", "a  b&nbsp;c", "x<>y"]


@query(f"select o_orderkey, {turn_sql(['Hello & world', 'linebreak', 'a<brb>c', 'café', 'a b c', 'xy'], 'o_orderkey')} as text from orders")
def normal_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.normalize_text(turn(_RAW, F.col("o_orderkey"))).alias("text"))


@query("select doc_id, coalesce(list_sum(list_transform(string_split(text, chr(10)), lambda x: case when trim(x) = '' then 0 else length(x) end)), 0)::bigint + 11 as n from documents where text is not null")
def visible_chars(spark, sf_dir):
    """Characters of texts, with a link whose destination doesn't count behind them."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", M.visible(F.concat("text", F.lit("\n\n[a link](http://x.y/(z)) \\(w"))).alias("n"))


# Markdown.

_PHRASES = ["skip to content", "skip to main content", "there was an error while loading", "please reload this page", "you can't perform that action at this time", "you signed in with another tab or window", "you signed out in another tab or window", "you switched accounts on another tab or window", "reload to refresh your session", "you must be signed in to change notification settings", "uh oh", "{{ message }}", "this website uses cookies", "we use cookies", "accept all cookies", "manage cookie preferences"]
_SPOKEN = ["Skip to content", "Uh oh!", "  You signed in with another tab or window. Reload to refresh your session.", "Sign in", "Read more", "We use cookies", "We use cookies to know you.", "Please  reload this page!", "Manage cookie preferences:", "{{ message }}", "All rights reserved"]
_WITH_LINE = f"(select doc_id, coalesce(text, '') || chr(10) || {turn_sql(_SPOKEN, 'doc_id')} as text from documents)"
_IS = f"len(parts) > 0 and len(list_filter(parts, lambda x: x not in ({', '.join(literal(p) for p in _PHRASES)}))) = 0"
_LINES = f"""l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from {_WITH_LINE}),
s as (select *, length(line) <= 300 and {_IS} as gone from (select doc_id, i, line, list_filter(list_transform(regexp_split_to_array(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '[.!]'), lambda x: regexp_replace(trim(x), '[.!:]+$', '')), lambda x: x <> '') as parts from l))"""


def _with_line(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), turn(_SPOKEN, F.col("doc_id"))).alias("text"))


@query(f"with {_LINES} select doc_id, line from s where gone")
def boilerplate_lines(spark, sf_dir):
    """Whole texts with a line of boilerplate, or one that looks like it, behind them."""
    return _with_line(spark, sf_dir).select("doc_id", F.explode(M.boilerplate_lines("text")).alias("line"))


@query(f"with {_LINES} select doc_id, trim(regexp_replace(string_agg(line, chr(10) order by i) filter (not gone), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) as text from s group by doc_id")
def boilerplate_strip(spark, sf_dir):
    return _with_line(spark, sf_dir).select("doc_id", M.stripped("text").alias("text"))


_DECODED = "replace(replace(regexp_replace(regexp_replace(regexp_replace({}, '&am<', '&amp;am;<', 'g'), '&amp<', '&amp;<', 'g'), '&(h|<)', '&amp;\\1', 'g'), '&quot;', '\"'), '&lt;', '<')"
_TITLE = "trim(replace(regexp_replace(" + _DECODED.format("regexp_extract(html, '(?s)<title>(.*?</)title>', 1)") + ", '</$', ''), '&amp;', '&'))"
_STEPS = [("<h1>", "\n\n# "), ("</h1>", "\n\n"), ("<p>", "\n\n"), ("</p>", "\n\n"), ("<b>", "**"), ("</b>", "**"), ("<br>", "\n")]


def _article_sql() -> str:
    out = _DECODED.format("regexp_extract(html, '(?s)<article>(.*</)article>', 1)")
    out = f"regexp_replace({out}, '</$', '')"
    for tag, mark in _STEPS:
        out = f"replace({out}, '{tag}', {literal(mark)})"
    return f"trim(regexp_replace(regexp_replace(replace({out}, '&amp;', '&'), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', {literal(chr(10) * 2)}, 'g'), ' ' || chr(10) || chr(9))"


def _plain_sql(tag: str, group: str) -> str:
    """What a simple element says."""
    return f"replace(regexp_replace({_DECODED.format(f"regexp_extract(html, '(?s){tag}({group}</)', 1)")}, '</$', ''), '&amp;', '&')"


#: An article with 200 characters of prose beside its heading is the page; else the page is all but menu and footer.
_PROSE = "list_sum(list_transform(string_split(art, chr(10)), lambda x: case when trim(x) = '' then 0 else length(x) end)) - length('# ' || h1)"
_READ = f"""read as (select *, 'Title: ' || title || chr(10) || chr(10) || case when {_PROSE} >= 200 then art else trim(ad || chr(10) || chr(10) || art, ' ' || chr(10)) end as text
from (select page_id, url, {_TITLE} as title, {_article_sql()} as art, {_plain_sql('<h1>', '.*?')} as h1, trim(regexp_replace({_plain_sql('<div class="ad">', '.*?')}, '\\s+', ' ', 'g')) as ad from pages))"""


@query(f"with {_READ} select page_id, title, text from read")
def page_markdown(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", M.page_struct.asNondeterministic()("html").alias("p"))
    return pages.select("page_id", "p.title", "p.text")


@query(f"select page_id, {_TITLE} as title from pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", M.page_struct.asNondeterministic()(F.regexp_replace("html", "(?s)<body>.*", ""))["title"].alias("title"))


@query("select page_id, 'first ' || page_id || ' & more' as description, 'A B' as author, '2026-01-' || page_id as date, 'S' as site from pages")
def page_meta(spark, sf_dir):
    """Metadata in page order: the first key of a field counts, ``property`` before ``name``, empty ones don't."""
    n = F.col("page_id").cast("string")
    head = F.concat(F.lit("<head><meta property='og:description' content='first "), n, F.lit(" &amp; more'><meta name=description content=second><meta name=author content=' '><meta NAME='Author' content=' A\n B '/><meta itemprop=author content=x><meta property='article:published_time' name=author content='2026-01-"), n, F.lit("'><meta name=date content=never><meta name='application-name' content=S>"))
    pages = table(spark, sf_dir, "pages").withColumn("p", M.page_struct.asNondeterministic()(F.concat(head, F.lit("</head><p>x</p>"))))
    return pages.select("page_id", "p.description", "p.author", "p.date", "p.site")


_SHELLS = ["<div id='root'></div><script></script>", "<p>few words</p>", "", "<div id=app></div>", "<script></script><script></script><script></script><noscript>You need to enable JavaScript to run this application, please.</noscript>", "<meta name=description content=d><script></script><SCRIPT></SCRIPT><script src=x></script>", "<div data-reactroot></div>", "<p id=rooted>few</p>", "<script>" + "x" * 9000 + "</script>"]
_WHY = ["js-shell", None, "empty", "js-shell", "js-shell", "js-shell", "js-shell", "js-shell", "js-shell"]
_SEEN = ["spa-markers", None, "", "spa-markers", "scripts,noscript", "scripts,description", "spa-markers", "spa-markers", "script-heavy"]


@query(f"select page_id, case page_id % 2 when 0 then {turn_sql(_WHY, '(page_id // 2)')} end as reason, case page_id % 2 when 0 then {turn_sql(_SEEN, '(page_id // 2)')} end as evidence from pages where page_id % 2 = 0 or length(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', '', 'g')) > 600")
def render_hint(spark, sf_dir):
    """Shells of applications with little text, and pages with enough of it."""
    n = F.col("page_id")
    plain = F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1), "<[^>]*>", "")
    pages = table(spark, sf_dir, "pages").where((n % 2 == 0) | (F.char_length(plain) > 600))
    shell = turn(_SHELLS, F.floor(n / 2))
    hint = M.render_hint(F.when(n % 2 == 0, shell).otherwise(F.col("html")), F.when(n % 2 == 0, F.when(shell == "", F.lit("")).otherwise(F.lit("Title: t\n\nfew"))).otherwise(plain))
    return pages.withColumn("h", hint).select("page_id", "h.reason", F.array_join("h.evidence", ",").alias("evidence"))


#: Small pages, and what becomes of them by the rules for each construct.
_CASES = [
    ("<p>seen</p><div hidden>no</div><p aria-hidden=TRUE>no</p><p style='color:red; display : none !important'>no</p><p style='visibility:hidden'>no</p><p aria-hidden=false>yes</p>", "seen\n\nyes"),
    ("<div><p hidden>no<p>one</p><p>two</p></div>", "one\n\ntwo"),
    ("<h2>Head <em>line</em></h2><p>a <b>b</b> <i>c</i> <a href='/x'>d  e</a> <a>f</a>", "## Head *line*\n\na **b** *c* [d e](/x) f"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>d<li>e</ol>", "* a\n* b\n\n  * c\n\n3. d\n4. e"),
    ("<pre>a  b\n\n\n&lt;c</pre><p>x <code>y</code>", "```\na  b\n\n\n<c\n```\n\nx `y`"),
    ("<pre>```\nz</pre>", "````\n```\nz\n````"),
    ("<blockquote><p>a<p>b<br>c</blockquote>d", "> a\n>\n> b\n> c\n\nd"),
    ("<table><tr><th>N</th><th>M</th></tr><tr><td>a|b<td>c<br>d</table>", "| N | M |\n| --- | --- |\n| a\\|b | c d |"),
    ("one<br/>two<hr>three<br hidden>four<div/>five", "one\ntwo\n\n---\n\nthreefourfive"),
    ("<nav>no</nav><footer>no</footer><script>1<2</script><button>no</button><svg><text>no</text></svg>yes<aside>and</aside>", "yes\n\nand"),
    ("<p>AT&amp;T &mdash; &#128; &notit;&amp<b>x</b> a < b", "AT&T — € ¬it;&**x** a < b"),
    ("<title>a < b</title><textarea>c</textarea><!-- d --><p>e<!f>g<?h?>i", "a < bc\n\negi"),
    ("<dl><dt>a<dd>b</dl><section>c</section><figure>d<figcaption>e</figcaption></figure>", "a\n\nb\n\nc\n\nd\n\ne"),
    ("<a href=x><h1>T</h1></a> tail", "[# T](x) tail"),
    ("", ""),
    ("<a href='1' href='2' title=\"a>b\">q</a><p title=it's>r", "[q](2)\n\nr"),
]


@query(f"select o_orderkey, {turn_sql([m for _, m in _CASES], 'o_orderkey')} as markdown from orders")
def markdown_cases(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", M.whole_page(turn([h for h, _ in _CASES], F.col("o_orderkey"))).alias("markdown"))


_LONG_TEXT = "long enough to be an article of its own, " * 8
_LINKS = "".join(f"<li><a href=/l{k}>Language {k}</a></li>" for k in range(60))
_SCOPES = [
    (f"<nav>no</nav><p>around</p><article><h1>T</h1><p>{_LONG_TEXT}</p></article>", f"# T\n\n{_LONG_TEXT.strip()}"),
    (f"<article><p>stub</p></article><main><p>{_LONG_TEXT}</p></main>", _LONG_TEXT.strip()),
    ("<p>Skip to content</p><article><p>short</p></article><p>Uh oh!</p><p>text</p>", "short\n\ntext"),
    (f"<main><header><h1>T</h1><ul>{_LINKS}</ul></header><p>{_LONG_TEXT}</p></main>", f"# T\n\n{_LONG_TEXT.strip()}"),
    (f"<article><header><h1>T</h1><p>By Jane</p></header><p>{_LONG_TEXT}</p></article>", f"# T\n\nBy Jane\n\n{_LONG_TEXT.strip()}"),
    ("".join(f"<article><p>{k} {_LONG_TEXT}</p></article>" for k in range(3)), "\n\n".join(f"{k} {_LONG_TEXT.strip()}" for k in range(3))),
    (f"<article><p>{_LONG_TEXT}</p></article><article><p>{_LONG_TEXT * 2}</p></article>", (_LONG_TEXT * 2).strip()),
    (f"<main><p>{_LONG_TEXT}", _LONG_TEXT.strip()),
]


@query(f"select o_orderkey, {turn_sql([m for _, m in _SCOPES], 'o_orderkey')} as markdown from orders")
def main_scope(spark, sf_dir):
    """The dominant article or main part, listings, stubs, and headers of links."""
    return table(spark, sf_dir, "orders").select("o_orderkey", M.main_content(turn([h for h, _ in _SCOPES], F.col("o_orderkey"))).alias("markdown"))


_SILENT = ["<NOSCRIPT class=x><p>a &amp;\n b</p></noscript>c<noscript>d</noscript>", "none", "<noscript>open", "<noscript><img src=x></noscript>"]


@query(f"select page_id, {turn_sql(['a & b d', '', '', ''], 'page_id')} as text from pages")
def noscript_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.noscript_text(F.concat(turn(_SILENT, F.col("page_id")), F.col("html"))).alias("text"))


_DEFLATED = zlib.compress(b"words of a body " * 20)
_GZIP = zlib.compressobj(wbits=31)
_GZIP = _GZIP.compress(b"words of a body " * 20) + _GZIP.flush()
_PACKED = [(_GZIP, "gzip"), (_GZIP, " X-GZIP"), (_DEFLATED, "deflate"), (_DEFLATED[2:-4], "Deflate"), (b"words of a body " * 20, ""), (_GZIP[:-9], "gzip")]


@query("select item_id, repeat('words of a body ', 20) as text from benchmark")
def body_inflate(spark, sf_dir):
    """Bodies by all codings, with and without headers; of one that breaks off, what could be read."""
    n = F.col("item_id")
    body = F.unhex(turn([b.hex() for b, _ in _PACKED], n))
    return table(spark, sf_dir, "benchmark").select("item_id", F.decode(T.decompress(body, turn([c for _, c in _PACKED], n)), "UTF-8").alias("text"))


@query("select page_id, case page_id % 2 when 0 then 'Title: t' || chr(10) || 'URL: ' || url || chr(10) || 'Rendered here.' || chr(10) || chr(10) || 'body' else 'URL: ' || url || chr(10) || 'Rendered here.' || chr(10) || chr(10) || 'body' end as text from pages")
def provenance(spark, sf_dir):
    text = F.when(F.col("page_id") % 2 == 0, F.lit("Title: t\n\nbody")).otherwise(F.lit("body"))
    return table(spark, sf_dir, "pages").select("page_id", M.provenance(text, F.col("url"), "Rendered here.").alias("text"))


@query("select page_id, regexp_extract(html, '(?s).*<li><a href=\"([^\"]*)\">', 1) as href, len(regexp_extract_all(html, '<li>')) as items from pages")
def xpath_last(spark, sf_dir):
    """The last item of a page's menu, and how many there are, by paths."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for page_id, page in zip(*[c.to_pylist() for c in batch.columns]):
                root = parse(page)
                found.append((page_id, *select(root, compile_path("//nav//li[position()=last()]/a/@href")), len(select(root, compile_path("//ul/li[a or .//b]")))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 3, (pa.int64(), pa.string(), pa.int64()))], names=["page_id", "href", "items"])

    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, href string, items long")


# Fetching.

_STATUS = [200, 301, 304, 404, 503, 308, 413, 299, 799]
_SAID = [None, None, "Failed to fetch URL: HTTP 304 Not Modified", "Failed to fetch URL: HTTP 404 Not Found", "Failed to fetch URL: HTTP 503 Service Unavailable", None, "Failed to fetch URL: HTTP 413 Payload Too Large", None, "Failed to fetch URL: HTTP 799"]


@query(f"select o_orderkey, case when {turn_sql(_STATUS, 'o_orderkey')} in (301, 308) and o_orderkey % 2 = 0 then 'Failed to fetch URL: the redirect is missing a Location header.' else {turn_sql(_SAID, 'o_orderkey')} end as outcome from orders")
def status_triage(spark, sf_dir):
    n = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (n % len(_STATUS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", fetch.triage(status, F.when(n % 2 == 1, F.lit("/x"))).alias("outcome"))


@query("select url, hop, attempt, status from (select *, row_number() over (partition by url, hop order by status >= 400, attempt, status) as n from (select l_orderkey as url, 1 as hop, l_linenumber as attempt, case when l_returnflag = 'R' then 403 when l_returnflag = 'A' then 500 else 200 end as status from lineitem)) where n = 1")
def attempt_selection(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", 403).when(F.col("l_returnflag") == "A", 500).otherwise(200)
    return fetch.winning_attempt(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("url"), F.lit(1).alias("hop"), F.col("l_linenumber").alias("attempt"), status.alias("status")))


@query("select o_orderkey as host, o_orderkey % 3 <> 1 as public, case o_orderkey % 3 when 0 then '8.8.8.8' when 1 then '8.8.4.4' else '2606:4700::1' end as ip, case o_orderkey % 3 when 1 then 'Blocked: refusing to fetch the non-public address ::1.' end as reason from orders")
def host_verdicts(spark, sf_dir):
    rows = [[("2606:4700::1", 6, 0), ("8.8.8.8", 4, 1), ("8.8.4.4", 4, 2)], [("::1", 6, 0), ("8.8.4.4", 4, 1), ("10.0.0.1", 4, 2)], [("2606:4700::1", 6, 0), ("2606:4700::2", 6, 1)]]
    lists = F.array(*[F.array(*[F.struct(F.lit(ip).alias("ip"), F.lit(f).alias("family"), F.lit(o).alias("ord")) for ip, f, o in r]) for r in rows])
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("host"), F.explode(F.element_at(lists, (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("a")).select("host", "a.*")
    return fetch.host_verdicts(found).select("host", "public", "ip", "reason")


@query("select page_id, case page_id % 4 when 0 then url || 'x/n e?a=1' when 1 then '/next' when 2 then null else 'https://o.example/' end as target from (select page_id, regexp_replace(url, '[^/]*$', '') as url from pages)".replace("url || 'x/n e?a=1'", "url || 'x/n%20e?a=1'").replace("'/next'", "regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/next'"))
def meta_refresh(spark, sf_dir):
    """Where pages send their readers: seen from their own URL, the first refresh that names one."""
    from weftline.functions.urls import resolve_url

    n = F.col("page_id")
    tag = turn(["<META http-equiv=Refresh content=\"0; URL='x/n e?a=1'\">", "<meta http-equiv=refresh content='5'><meta http-equiv='refresh' content='5;url=/next'><meta http-equiv=refresh content='0;url=/never'>", "<meta name=refresh content='0;url=/x'>", "<meta http-equiv=refresh content='0; url = https://o.example'>"], n)
    return table(spark, sf_dir, "pages").select("page_id", resolve_url(fetch.meta_refresh(F.concat(tag, F.col("html"))), F.col("url")).alias("target"))


@query("""select 'http://h.example/' || id as url, case when k = 9 then 'Failed to fetch URL: too many redirects.' when k = 8 then 'Blocked: the website access policy disallows bad.example.' when k = 7 then 'Failed to fetch URL: the redirect has an invalid Location.' when k = 6 then 'Failed to fetch URL: HTTP 410 Gone' end as error,
case when k < 4 then 'page ' || (id + (4 - id % 4) % 4) when k in (4, 5) then 'page x' end as text from (select o_orderkey as id, case o_orderkey % 20 when 16 then 4 when 17 then 9 when 18 then 8 when 19 then 7 when 12 then 6 else 0 end as k from orders where o_orderkey % 20 in (0, 12, 16, 17, 18, 19))""")
def follow_redirects(spark, sf_dir):
    """Captured answers: chains of redirects, one without an end, one to a blocked site, one to no URL, a refresh, a failure."""
    n = F.col("o_orderkey")
    at = F.concat(F.lit("http://h.example/"), n)
    kind = n % 20
    rows = table(spark, sf_dir, "orders").where(kind.isin(0, 12, 16, 17, 18, 19))
    answers = rows.select(
        at.alias("url"),
        F.when(kind.isin(17, 18, 19), 302).when(kind == 12, 410).otherwise(200).alias("status"),
        F.when(kind == 17, F.lit("?again")).when(kind == 18, F.lit("//sub.bad.example/")).when(kind == 19, F.lit("http://:x")).alias("location"),
        F.when(kind == 16, F.lit("text/html")).otherwise(F.lit("text/plain")).alias("content_type"),
        F.encode(F.when(kind == 16, F.lit("<meta http-equiv=refresh content='0;url=/x'>")).otherwise(F.concat(F.lit("page "), n)), "UTF-8").alias("body"),
    )
    loop = rows.where(kind == 17).select(F.concat(at, F.lit("?again")).alias("url"), F.lit(301).alias("status"), F.lit("?more").alias("location"), F.lit("").alias("content_type"), F.lit(b"").alias("body"))
    more = rows.where(kind == 17).select(F.concat(at, F.lit("?more")).alias("url"), F.lit(301).alias("status"), F.lit("?again").alias("location"), F.lit("").alias("content_type"), F.lit(b"").alias("body"))
    end = spark.createDataFrame([("http://h.example/x", 200, None, "text/plain", b"page x")], answers.schema)
    found = fetch.follow(rows.select(at.alias("url")), answers.unionByName(loop).unionByName(more).unionByName(end), blocked=["bad.example"])
    return found.select("url", F.regexp_replace("error", "sub\\.bad", "bad").alias("error"), "text")


@query("select item_id, repeat('word ', 20 + item_id % 10) || repeat('“', 30) as text, null::varchar as error from benchmark where item_id % 3 > 0 union all select item_id, null, '(binary content, ' || (5 * (20 + item_id % 10) + 30) || ' bytes; not readable as text)' from benchmark where item_id % 3 = 0")
def cp1252_rescue(spark, sf_dir):
    """Bytes of windows-1252 without a charset, with that of its neighbour, and with another, which is believed."""
    n = F.col("item_id")
    body = F.concat(F.encode(F.expr("repeat('word ', cast(20 + item_id % 10 as int))"), "UTF-8"), F.unhex(F.lit("93" * 30)))
    kind = turn(["text/plain; charset=utf-8", "text/plain", "text/plain; charset=latin1"], n)
    raw = table(spark, sf_dir, "benchmark").select("item_id", F.lit(200).alias("status"), kind.alias("content_type"), body.alias("body"))
    return fetch.read_bodies(raw).select("item_id", "text", "error")


_BODIES = [("text/plain", "255044462D312E34", "(PDF content could not be read as text)"), ("image/png", "78", "(non-text content: image/png, 1 bytes; not readable as text)"), ("text/html", "504B0304", "(binary content, 4 bytes; not readable as text)"), ("", "20706C61696E20", None), ("application/zip", "78", "(non-text content: application/zip, 1 bytes; not readable as text)"), ("text/plain", "00" * 40, "(binary content, 40 bytes; not readable as text)")]


@query(f"select o_orderkey, {turn_sql([e for *_, e in _BODIES], 'o_orderkey')} as error, case o_orderkey % 6 when 3 then 'plain' end as text from orders")
def body_triage(spark, sf_dir):
    n = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("https://a.org/"), n).alias("url"), F.lit(200).alias("status"), turn([k for k, *_ in _BODIES], n).alias("content_type"), F.unhex(turn([b for _, b, _ in _BODIES], n)).alias("body"))
    return fetch.read_pages(raw).select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("o_orderkey"), "error", "text")


@query("select n_nationkey, repeat('x', 524288) || chr(10) || chr(10) || '... (page truncated at the download limit)' as long, repeat('x', 524288) as exact from nation")
def byte_cap(spark, sf_dir):
    """A body at its limit is whole, one beyond it is cut and says so."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("more"), F.lit("text/plain").alias("content_type"))
    read = fetch.read_bodies(rows.withColumn("body", F.encode(F.expr("repeat('x', 524288 + more)"), "UTF-8")))
    return read.groupBy("n_nationkey").agg(F.max(F.when(F.col("more") == 1, F.col("text"))).alias("long"), F.max(F.when(F.col("more") == 0, F.col("text"))).alias("exact"))


@query(f"with {_READ} select url, text, null::varchar as error, null::varchar as hint from read")
def page_fetch(spark, sf_dir):
    raw = table(spark, sf_dir, "pages").select("url", F.lit(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), F.encode("html", "utf-8").alias("body"))
    return fetch.read_pages(raw).select("url", "text", "error", F.col("hint.reason").alias("hint"))


@query("""select page_id, case page_id % 4 when 0 then 'raw' when 1 then 'api' when 2 then 'readme' else 'page' end as source, case page_id % 4 when 0 then 'code' when 1 then 'README of https://github.com/o/r' || page_id || ' (fetched via the GitHub README API):' || chr(10) || chr(10) || '# R'
when 2 then 'README of https://github.com/o/r' || page_id || ' (fetched via the GitHub raw README URL):' || chr(10) || chr(10) || '# Raw' else null end as text, case page_id % 4 when 3 then 'Failed to fetch URL: HTTP 500 Internal Server Error' end as error from pages""")
def source_order(spark, sf_dir):
    """Pages of code hosts: raw content, the README by API or raw, the page itself; what fails or is empty gives way."""
    n = F.col("page_id")
    url = F.concat(F.lit("https://github.com/o/r"), n, F.when(n % 4 == 0, F.lit("/blob/main/a.py")).otherwise(F.lit("")))
    urls = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    tried = fetch.sources(urls).join(urls, "url")
    ok = ((n % 4 == 0) & (F.col("source") == "raw")) | ((n % 4 == 1) & (F.col("source") == "api")) | ((n % 4 == 2) & F.col("source").isin("api", "readme"))
    text = F.when(F.col("source") == "raw", F.lit(" code ")).when(F.col("source") == "readme", F.lit("# Raw")).when(n % 4 == 1, F.lit("# R")).otherwise(F.lit(" \n"))
    tried = tried.withColumn("error", F.when(~ok, F.lit("Failed to fetch URL: HTTP 500 Internal Server Error"))).withColumn("text", F.when(ok, text)).withColumn("kind", F.lit("text/plain"))
    return fetch.with_sources(tried).join(urls, "url").select("page_id", "source", "text", "error")


_NOW = 1_000 * 60_000
_DAY = "1970-01-01"


@query(f"""select page_id, case page_id % 4 when 0 then 'plain' when 1 then 'old ' || page_id || case when {_NOW} - page_id * 60000 < 3600000 then chr(10) || chr(10) || '*Served from cache — network fetch failed*' else chr(10) || chr(10) || '*STALE cache from ' || strftime(epoch_ms(page_id * 60000), '%Y-%m-%d') || ' — network fetch failed, serving cached copy*' end
when 2 then '*Fetched from Wayback Machine snapshot (2020-05-06) for https://a.org/' || page_id || ':*' || chr(10) || chr(10) || 'gone ' || page_id else 'Blocked: the URL is empty.' end as text, case page_id % 4 when 0 then 'fetch' when 1 then 'cache' when 2 then 'snapshot' else 'fetch' end as source from pages where page_id < 100000""")
def cache_and_snapshots(spark, sf_dir):
    """Failed fetches made up for: by the cache, fresh or stale, by a snapshot of what is gone; what is blocked stays blocked."""
    from weftline.functions.urls import cache_key

    n = F.col("page_id")
    url = F.concat(F.lit("https://a.org/"), n)
    pages = table(spark, sf_dir, "pages").where("page_id < 100000").select("page_id", url.alias("url"))
    error = F.when(n % 4 == 1, F.lit("Failed to fetch URL: timed out.")).when(n % 4 == 2, F.lit("Failed to fetch URL: HTTP 404 Not Found")).when(n % 4 == 3, F.lit("Blocked: the URL is empty."))
    outcomes = pages.select("page_id", "url", error.alias("error"), F.when(n % 4 == 0, F.lit("plain")).alias("text"))
    cached = pages.where(n % 4 != 2).select(cache_key(F.col("url")).alias("key"), F.concat(F.lit(" old "), n).alias("body"), F.lit("text/plain").alias("content_type"), (n * 60_000).alias("ts_ms"))
    answer = F.concat(F.lit('{"archived_snapshots": {"closest": {"available": true, "status": "200", "timestamp": "20200506070809", "url": "https://web.example/'), n, F.lit('"}}}'))
    available = pages.where(n % 4 == 2).select("url", answer.alias("body"))
    snapshots = pages.select(F.concat(F.lit("https://web.example/"), n).alias("url"), F.lit(None).cast("string").alias("error"), F.concat(F.lit("gone "), n, F.lit("\n")).alias("text"), F.lit("text/plain").alias("kind"))
    found = fetch.recover(outcomes, cached, _NOW, available, snapshots)
    return found.join(pages, "url").select("page_id", F.coalesce("text", "error").alias("text"), "source")


_SHOWN = ["Failed to fetch URL: HTTP 403 Forbidden", "few", "few", "few", "enough", "Failed to fetch URL: HTTP 403 Forbidden"]
_MADE = ["the page", "the whole page as rendered", "", "Just a moment...", "other", "Failed to render URL: x"]
_TAKEN = ["Direct fetch failed with HTTP 403; rendered locally with the local renderer instead.\n\nthe page", "Direct fetch returned little content; rendered locally with the local renderer instead.\n\nthe whole page as rendered", "few\n\n*(JavaScript-rendered page; content may be incomplete)*", "few\n\n*(JavaScript-rendered page; content may be incomplete)*", "enough", "Failed to fetch URL: HTTP 403 Forbidden"]


@query(f"select o_orderkey, {turn_sql(_TAKEN, 'o_orderkey')} as text from orders")
def render_choice(spark, sf_dir):
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", n.cast("string").alias("url"), F.when(n % 6 % 5 == 0, turn(_SHOWN, n)).alias("error"), F.when(n % 6 % 5 > 0, turn(_SHOWN, n)).alias("text"), F.when((n % 6).isin(1, 2, 3), F.lit("js-shell")).alias("hint"))
    made = rows.select("url", turn(_MADE, n).alias("text"))
    return fetch.escalate(rows, made).select("o_orderkey", F.coalesce("error", "text").alias("text"))


_SETTINGS = ['{"webFetch": {"maxChars": 0, "timeoutMs": 999, "transport": "off"}}', '{"webTools": {"maxChars": 10.7, "engines": ["a", "", 3]}, "webFetch": {"maxChars": 99}}', "[1]", '{"webSearch": {"maxResults": 99, "engineWeights": {"a": 1, "b": 0, "c": "x", "d": 2.5}}}', '{"smartFetchDefaultTimeoutMs": "5000", "webFetch": {"transport": "fast", "allowLocalFiles": false}}', "no json", '{"webTools": {"allowLocalFiles": "no", "timeoutMs": 2500}}']
_HELD = {"transport": ("off", 0), "max_chars": ("10", 1), "engines": ('["a"]', 1), "max_results": ("20", 3), "engine_weights": ('{"a":1.0,"d":2.5}', 3), "allow_local_files": ("false", 4), "timeout_ms": ("2500", 6)}


@query("select key, value, (select max(c_custkey) from customer where c_custkey % 7 = r) as precedence from (values " + ", ".join(f"({literal(k)}, {literal(v)}, {r})" for k, (v, r) in _HELD.items()) + ") s(key, value, r)")
def settings_layers(spark, sf_dir):
    """A layer a customer: the last valid value of each key, whatever it is called there."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("precedence"), turn(_SETTINGS, F.col("c_custkey")).alias("json"))
    return settings.layered(docs).select("key", "value", "precedence")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def windowed_event_counts(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


# Page layout.

_LINE = "l as (select lang, doc_id as page, i, line from (select lang, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null))"


def _spans(spark, sf_dir) -> DataFrame:
    """The lines of a language's documents as spans of pages: fifty a page's height, a running head and a page number."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select(F.col("lang").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    heads = docs.select(F.col("lang").alias("doc"), F.col("doc_id").alias("page"), F.explode(F.array(F.struct(F.lit(-1).alias("i"), F.concat(F.lit("Head of "), F.coalesce("lang", F.lit(""))).alias("text")), F.struct(F.lit(999_999).alias("i"), (F.col("doc_id") % 10_000).cast("string").alias("text")))).alias("x")).select("doc", "page", "x.*")
    y0 = F.when(F.col("i") == 999_999, F.lit(780.0)).otherwise((F.col("i") + 1) * 20.0)
    rows = lines.unionByName(heads).withColumn("y0", F.least(y0, F.when(F.col("i") == 999_999, F.lit(780.0)).otherwise(F.lit(600.0) + F.col("i") * 0.001)))
    return rows.select("doc", "page", "text", "i", "y0")


@query(f"""with {_LINE}, h as (select lang, doc_id as page, -1 as i, 'Head of ' || coalesce(lang, '') as line from documents where text is not null), a as (select *, round(least(i * 20.0, 600 + (i - 1) * 0.001) / 5 - 0.000001) as bucket from l union all select *, 0 from h),
e as (select * from a where i <= 4 and trim(line) <> ''), c as (select lang, line, bucket, count(distinct page) as k from e group by all), n as (select lang, count(distinct doc_id) as m from documents where text is not null group by lang)
select lang as doc, count(*) as kept from (select a.lang, a.page, a.i from a join n on n.lang is not distinct from a.lang left join c on c.lang is not distinct from a.lang and c.line = a.line and c.bucket = a.bucket and a.i <= 4 where not coalesce(k >= greatest(2, ceil(m / 2.0)), false)) group by lang""")
def running_lines_strip(spark, sf_dir):
    """Running heads, page numbers and lines that stand on half of a language's pages at one place of the edge go; how many lines are left."""
    spans = _spans(spark, sf_dir).where("i >= -1")
    lines = spans.select("doc", "page", F.col("i").alias("line"), "y0", (F.col("y0") + 10).alias("y1"), F.trim("text").alias("text"), "i")
    pages = lines.select("doc", "page").distinct().withColumn("height", F.lit(800.0))
    kept, _ = layout.strip_running(lines.where("i < 999999"), pages)
    return kept.groupBy("doc").agg(F.count("*").alias("kept"))


@query("select lang as doc, sum(length((doc_id % 10000)::varchar))::bigint as letters from documents where text is not null group by lang having count(*) >= 2")
def running_page_numbers(spark, sf_dir):
    """Numbers at one place of all pages are taken out, whatever they say."""
    spans = _spans(spark, sf_dir).where("i = 999999")
    lines = spans.select("doc", "page", F.col("i").alias("line"), "y0", (F.col("y0") + 10).alias("y1"), "text")
    _, removed = layout.strip_running(lines, lines.select("doc", "page").distinct().withColumn("height", F.lit(800.0)))
    return removed.groupBy("doc").agg(F.sum("removed").cast("long").alias("letters"))


@query(f"with {_LINE} select lang, line as text, least(i, 3) as bucket, count(distinct page) as pages from l group by all")
def running_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("lang", F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "text")).select("lang", "page", "text", F.least(F.col("i") + 1, F.lit(3)).alias("bucket"))
    return layout.running_counts(lines, ["lang"])


@query("""with h as (select l_linestatus, floor(l_quantity + 0.5)::bigint as size, sum(l_linenumber)::bigint as n from lineitem group by all), b as (select l_linestatus, greatest(arg_max(size, n * 1000 + size), 12) as body from h group by l_linestatus)
select l_linestatus, size, body, n, level from (select h.*, body, row_number() over (partition by h.l_linestatus order by size desc) as level from h join b using (l_linestatus) where size > body) where level <= 6""")
def heading_histogram(spark, sf_dir):
    return layout.heading_levels(table(spark, sf_dir, "lineitem"), ["l_linestatus"], F.col("l_quantity"), F.col("l_linenumber"))


_NUMBERED = "select l_orderkey as page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity)::int as k, l_partkey, l_quantity from lineitem"


def _numbered(spark, sf_dir) -> DataFrame:
    """The lines of an order by number, parts and quantity."""
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    return table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc"), F.col("l_orderkey").alias("page"), k.alias("k"), "l_partkey", "l_quantity")


@query(f"with s as ({_NUMBERED}), j as (select page, k // 3 as line, string_agg('p' || l_partkey, ' ' order by k) as text from s group by page, k // 3) select page, row_number() over (partition by page order by line) as line, text from j")
def line_merge(spark, sf_dir):
    """Spans of pages to lines: three a line, apart from one another."""
    k = F.col("k")
    y0 = F.floor(k / 3) * 20.0
    spans = _numbered(spark, sf_dir).select("doc", "page", k.alias("ord"), F.lit(0).cast("long").alias("block"), (k % 3 * 100.0).alias("x0"), (y0 + k % 3).alias("y0"), (k % 3 * 100.0 + 50).alias("x1"), (y0 + 12 + k % 3).alias("y1"), F.lit(12.0).alias("size"), F.concat(F.lit("p"), F.col("l_partkey")).alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("mono"))
    lines = layout.merge_lines(spans)
    return lines.select("page", F.row_number().over(Window.partitionBy("page").orderBy("line")).alias("line"), "text")


@query("""select user_id, island, count(*) as n, min(event_id) as first_event from (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from
(select user_id, event_id, ts, coalesce((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) > 3600000000)::int, 1) as new from events)) group by user_id, island""")
def islands(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").withColumn("us", us)
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) > 3_600_000_000
    return layout.islands(events, ["user_id"], ["ts", "event_id"], gap).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


_RECTS = [(0.0, 0.0, 20.0, 0.04), (10.0, 0.02, 30.0, 0.08), (25.0, 0.05, 50.0, 0.1)]


@query("""select l_orderkey, l_linenumber, arg_min(ord, ord) as ord from lineitem, (values (1, 0, 0.0, 20, 0.04), (2, 10, 0.02, 30, 0.08), (3, 25, 0.05, 50, 0.1)) r(ord, x0, y0, x1, y1)
where l_quantity between x0 and x1 and l_discount between y0 and y1 group by all""")
def rect_containment(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", layout.inside_first_of(F.col("l_quantity"), F.col("l_discount"), _RECTS).alias("ord"))
    return found.where("ord is not null").groupBy("l_orderkey", "l_linenumber").agg(F.min("ord").alias("ord"))


@query("""select l_orderkey, l_linenumber, min(ord) as ord from lineitem, (values (1, 0, 0.0, 20, 0.04), (2, 10, 0.02, 30, 0.08), (3, 25, 0.05, 50, 0.1)) r(ord, x0, y0, x1, y1) where l_quantity between x0 and x1 and l_discount between y0 and y1 and l_orderkey % 2 = ord % 2 group by all""")
def rect_join(spark, sf_dir):
    """Points and rectangles of one page: the pages are the orders, each with the rectangles of its parity."""
    points = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    rect = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), *[F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), r)]) for k, r in enumerate(_RECTS, 1)])).alias("r")
    rects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), rect).select("page", "r.*").where("page % 2 = ord % 2")
    return layout.inside_first(points, rects, ["page"]).select("id.l_orderkey", "id.l_linenumber", "ord")


@query("select p_partkey, case when abs(p_retailprice - 900.0) <= abs(p_retailprice - 1200.0) and abs(p_retailprice - 900.0) <= abs(p_retailprice - 1600.0) then 900.0 when abs(p_retailprice - 1200.0) <= abs(p_retailprice - 1600.0) then 1200.0 else 1600.0 end::double as centre from part")
def nearest_column(spark, sf_dir):
    return layout.nearest_column(table(spark, sf_dir, "part"), "p_retailprice", [900.0, 1200.0, 1600.0]).select("p_partkey", "centre")


@query(f"with n as ({_NUMBERED}), s as (select page, k, l_quantity >= 25 as m, k - row_number() over (partition by page, l_quantity >= 25 order by k) as g from n) select page, min(k) as first, max(k) as last, count(*) as lines from s where m group by page, g having count(*) >= 2")
def table_bands(spark, sf_dir):
    lines = _numbered(spark, sf_dir).select("doc", "page", F.col("k").alias("line"), F.when(F.col("l_quantity") >= 25, 2).otherwise(1).alias("spans"))
    return layout.table_bands(lines).select("page", "first", "last", "lines")


@query("""with o as (select o_orderkey from orders), t as (select o_orderkey, case o_orderkey % 4 when 0 then '# Title' || chr(10) || chr(10) || 'Plain **bold** _slanted_ ' when 1 then 'Intro ' || chr(10) || chr(10) || '- first ' || chr(10) || chr(10) || '- second' when 2 then '```' || chr(10) || '  code()' || chr(10) || '```' || chr(10) || chr(10) || '[here](http://x.y/%28z%29)' else '|A|B|' || chr(10) || '|---|---|' || chr(10) || '|1|2|' || chr(10) || chr(10) || chr(10) || 'A B ' || chr(10) || '1 2' end as text from o)
select o_orderkey, '## Page 1' || chr(10) || chr(10) || trim(text) as text from t""")
def pdf_markdown(spark, sf_dir):
    """Pages with a heading, emphasis, a list, code, a link and a table, written as Markdown and put together."""
    s = lambda ord, x, y, text, size=12.0, bold=False, italic=False, mono=False, block=0: F.struct(F.lit(ord).alias("ord"), F.lit(block).cast("long").alias("block"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(float(x + 40)).alias("x1"), F.lit(float(y + 12)).alias("y1"), F.lit(size).alias("size"), F.lit(text).alias("text"), F.lit(bold).alias("bold"), F.lit(italic).alias("italic"), F.lit(mono).alias("mono"))
    kinds = [
        [s(0, 0, 100, "Title", 24.0), s(1, 0, 114, "Plain"), s(2, 60, 114, "bold", bold=True), s(3, 120, 114, "slanted", italic=True), *[s(9 + k, 0, 0, "x", block=9) for k in range(0)]],
        [s(0, 0, 100, "Intro"), s(1, 0, 114, "- first", block=0), s(2, 0, 128, "- second", block=0)],
        [s(0, 12, 100, "code()", mono=True), s(1, 0, 114, "here", block=0)],
        [s(0, 0, 100, "A"), s(1, 100, 100, "B"), s(2, 0, 114, "1"), s(3, 100, 114, "2")],
    ]
    n = F.col("o_orderkey")
    key = table(spark, sf_dir, "orders").select("o_orderkey", n.cast("string").alias("doc"))
    rows = None
    for k, spans in enumerate(kinds):
        part = key.where(n % 4 == k).select("doc", F.lit(1).alias("page"), F.explode(F.array(*spans)).alias("s")).select("doc", "page", "s.*")
        rows = part if rows is None else rows.unionByName(part)
    pages = key.select("doc", F.lit(1).alias("page"), F.lit(800.0).alias("height"), F.lit("").alias("plain"))
    links = key.where(n % 4 == 2).select("doc", F.lit(1).alias("page"), F.lit(0).alias("ord"), F.lit(0.0).alias("x0"), F.lit(110.0).alias("y0"), F.lit(50.0).alias("x1"), F.lit(130.0).alias("y1"), F.lit("http://x.y/(z)").alias("uri"))
    text = layout.assemble(layout.page_texts(rows, pages, links))
    return text.select(F.col("doc").cast("long").alias("o_orderkey"), "text")


_LETTERS = "trim(regexp_replace(regexp_replace(text, '[^A-Za-z\\n]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), ' ' || chr(10))"
_BODY = f"regexp_replace({_LETTERS}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"select doc_id, '## Page 1' || chr(10) || chr(10) || {_BODY} as text from documents where {_LETTERS} <> '' union all select doc_id, '(PDF contains no extractable text)' from documents where text is null or {_LETTERS} = ''")
def pdf_text_pages(spark, sf_dir):
    """Whole texts, one line an operator, in a file's content stream, and read from it."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z\n]+", " "), " *\n *", "\n")
    shown = F.array_join(F.transform(F.split(F.trim(plain), "\n"), lambda x: F.concat(F.lit("("), x, F.lit(") Tj "))), "T* ")
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Length 9 >> stream\nBT "), shown, F.lit("ET\nendstream endobj"))
    docs = table(spark, sf_dir, "documents").select("doc_id", pdf_text.pdf_body(F.encode(body, "utf-8")).alias("text"))
    return docs.select("doc_id", F.when(F.col("text") == "", F.lit("(PDF contains no extractable text)")).otherwise(F.col("text")).alias("text"))


_OPS = ["BT (Hello \\(you\\)) Tj T* [(Wor) -300 (ld)] TJ <414243> Tj ET", "(out) BT (in) Tj ET (out)", "BT (a\\101\\n) ' (b (c) d) Tj ET", "BT % (no)\n(yes) Tj 0 0 Td (next) Tj ET"]
_GIVEN = ["Hello (you)\nWorldABC", "in", "aA\n\nb (c) d", "yes\nnext"]


@query(f"select o_orderkey, {turn_sql(['## Page 1' + chr(10) * 2 + t for t in _GIVEN], 'o_orderkey')} as text from orders")
def pdf_operators(spark, sf_dir):
    body = F.concat(F.lit("%PDF-1.4\n<< >> stream\n"), turn(_OPS, F.col("o_orderkey")), F.lit("\nendstream"))
    return table(spark, sf_dir, "orders").select("o_orderkey", pdf_text.pdf_body(F.encode(body, "ISO-8859-1")).alias("text"))


_GLYPHS = ["ﭐ" * 6, "�" * 5, "x" * 150, "x" * 149, ""]
_PLAIN_LETTERS = [0, 0, 200, 200, 199]


@query(f"select o_orderkey, {turn_sql([True, False, False, False, False], 'o_orderkey')} as corrupted, {turn_sql([False, False, False, True, False], 'o_orderkey')} as incomplete, {turn_sql([True, False, True, False, True], 'o_orderkey')} as white from orders")
def pdf_checks(spark, sf_dir):
    n = F.col("o_orderkey")
    text = turn(_GLYPHS, n)
    letters = F.element_at(F.array(*map(F.lit, _PLAIN_LETTERS)), (n % 5 + 1).cast("int"))
    white = layout.is_white(turn(["  \x01", "a ", "", "​", "　"], n))
    return table(spark, sf_dir, "orders").select("o_orderkey", layout.corrupted(text).alias("corrupted"), layout.incomplete(text, letters).alias("incomplete"), white.alias("white"))
