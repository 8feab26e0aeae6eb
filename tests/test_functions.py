"""Unit cases of URL, text, HTML, XPath, fusion, fetch and PDF operators."""

import zlib

import pytest
from pyspark.sql import functions as F

from weftline.functions import hosts as H
from weftline.functions import markdown as M
from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.functions import whatwg
from weftline.functions.html_tree import parse
from weftline.functions.xpath import compile_path, select, text_of
from weftline.operators import cache, evaluate, fusion, layout
from weftline.plans import catalog, fetch, search, settings
from weftline.sources import pdf_text, serp
from weftline.streaming import windowed_counts


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_urls(spark):
    given = ["https://x.com/a?utm_source=rss&utm_medium=feed&b=7", "https://x.com/p?utm_source=rss", "https://x.com/a#section", "https://X.com:443/a", "http://x.com:80", "https://x.com:8443/a", "not a url", "", "https://x.com/?Fbclid=1&q"]
    want = ["https://x.com/a?b=7", "https://x.com/p", "https://x.com/a", "https://x.com/a", "http://x.com/", "https://x.com:8443/a", "not a url", "", "https://x.com/?q="]
    once = column(spark, given, U.canonicalize)
    assert once == want and column(spark, once, U.canonicalize) == want
    assert column(spark, ["https://news.bbc.co.uk/x", "not a url", "http://www.a.b.org"], U.registrable_domain) == ["bbc.co.uk", "", "b.org"]
    assert column(spark, ["https://e.com/a%20b?q=1+2", "%zz"], U.normalize_url) == ["https://e.com/a+b?q=1+2", "%zz"]
    assert column(spark, ["example.com:8443/p", "example.com:99999", "mailto:a@b.c", "/login"], U.normalize_scheme) == ["https://example.com:8443/p", "example.com:99999", "mailto:a@b.c", "/login"]
    ips = ["8.8.8.8", "127.0.0.1", "10.1.2.3", "100.64.0.1", "172.31.0.1", "172.32.0.1", "224.0.0.1", "256.1.1.1", "01.2.3.4", "::1"]
    assert column(spark, ips, U.is_public_ipv4) == [True, False, False, False, False, True, False, False, False, False]
    verdicts = column(spark, ["", "http://a b", "ftp://a.org/", "http://u:p@a.org/", "http://a.org:70000/", "http://bad.a.org/", "http://ok.a.org/", "http://xa.org/", None, "a.org", " http://a.org\t"], lambda c: U.check_access(c, ["a.org"], ["bad.a.org"]))
    assert [v["reason"] for v in verdicts] == [U.EMPTY, U.BAD_CHARS, U.BAD_SCHEME, U.CREDENTIALS, U.BAD_HOST, U.BY_POLICY + "bad.a.org.", "", U.BY_POLICY + "xa.org.", U.EMPTY, U.BAD_HOST, ""]
    assert [v["allowed"] for v in verdicts] == [v["reason"] == "" for v in verdicts]
    every = ["https://x.com/a/../b c?q=a%20b&utm_source=z#f", "HTTPS://User:Pa@X.com:443/", "http://0x7f.1/", "http://[::FFFF:1.2.3.4]:80/", "http://\u00e9.com/\u00fc", "https://x.com?utm_a=1", "http://x.com/%7Eu/./a/%2e%2E/b", "https://x.com/a\\b?x='1'", "http://256.1.1.1/", "//x.com/a", "mailto:a@b", "http:x.com/y", "http://x.com/?", None, "https://a.x.com/p/q.html?page=2&ref=x#top"]
    form = ["https://x.com/b%20c?q=a+b", "https://User:Pa@x.com/", "http://127.0.0.1/", "http://[::ffff:102:304]/", "http://xn--9ca.com/%C3%BC", "https://x.com/", "http://x.com/%7Eu/b", "https://x.com/a/b?x=%271%27", "http://256.1.1.1/", "//x.com/a", "mailto:a@b", "http://x.com/y", "http://x.com/?", None, "https://a.x.com/p/q.html?page=2&ref=x"]
    assert column(spark, every, U.canonicalize) == form and [None if u is None else whatwg.canonical_href(u) for u in every] == form
    seen = [("/x", "https://a.com/b/c?q", "https://a.com/x"), ("../y", "https://a.com/b/c/d", "https://a.com/b/y"), ("?z", "https://a.com/b", "https://a.com/b?z"), ("//o.com", "https://a.com", "https://o.com/"), ("http:rel", "http://a.com/b/c", "http://a.com/b/rel"), ("#g", "https://a.com/b?q", "https://a.com/b?q#g"), ("", "https://a.com/b?q#f", "https://a.com/b?q"), ("x", "mailto:y", None)]
    assert [whatwg.resolve(t, b) for t, b, _ in seen] == [w for *_, w in seen]
    assert column(spark, ["http://a.org/"], lambda c: U.policy_allows(U.host(c), [f"d{i}.org" for i in range(101)], [])) == [False]
    assert column(spark, ["transformer"], lambda c: U.scope_query(c, ["arxiv.org"])) == ["transformer (site:arxiv.org)"]
    assert column(spark, ["q"], lambda c: U.scope_query(c, [f"d{i}.org" for i in range(20)]))[0].count("site:") == 8
    assert column(spark, ["https://github.com/o/r/blob/main/a.md"], U.github_raw) == ["https://raw.githubusercontent.com/o/r/main/a.md"]


def test_hosts(spark):
    given = ["EXAMPLE.com.", "münchen.de", "https://x.com", "x.com:443", "", None, "0x7f.0.0.1", "8.8.8.8.", "256.1.1.1", "001.002.003.004", "1.2.3", "2130706433", "[2001:DB8:0:0:0::1]", "[::1", "-a.org", "a" * 64 + ".org", "a_b.org"]
    want = ["example.com", "xn--mnchen-3ya.de", None, None, None, None, None, "8.8.8.8", None, None, None, None, "2001:db8::1", None, None, None, None]
    assert column(spark, given, H.normalize_domain) == want
    assert column(spark, ["1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7::", "0:1:0:2:0:3:0:4", "1::2::3", "1:2:3", "::ffff:1.2.3.4"], H.compress_ipv6) == ["1:0:0:2::3", "1:2:3:4:5:6:7:0", "0:1:0:2:0:3:0:4", None, None, None]
    public = ["8.8.8.8", "2606:4700:4700::1111", "2001:4860:4860::8888", "2001:1::3", "fe00::1"]
    private = ["127.0.0.1", "::", "::1", "::ffff:8.8.8.8", "0:0:0:0:0:ffff:7f00:1", "fe80::1%eth0", "fe80::1", "fc00::1", "fd12::1", "ff02::1", "2001:1::1", "2001:2::1", "2001:db8::1", "64:ff9b::1", "2002::1", "2001::1", "x", ""]
    assert column(spark, [*public, *private, None], H.is_public_ip) == [True] * len(public) + [False] * (len(private) + 1)
    assert column(spark, ["[::1]", "::1", "a"], H.strip_brackets) == ["::1", "::1", "a"]
    verdicts = column(spark, ["http://[2606:4700::1]:80/", "http://münchen.de/", "http://-a.org/"], lambda c: U.check_access(c))
    assert [(v["allowed"], v["host"]) for v in verdicts] == [(True, "2606:4700::1"), (True, "xn--mnchen-3ya.de"), (False, "")]


def test_one_body_as_columns_have_it(spark):
    bodies = [b"", b"  \xef\xbb\xbf\n%PDF-1", b"PK\x03\x04", b"\xff\xfex\0", b"\0\0\xfe\xff", b"<html><META charset='Shift-JIS'>", b"plain <meta charset=gbk>", b"\x93" * 30 + b"a" * 80, b"\x93" * 30 + b"a" * 90, bytes(range(256)) * 3, b"BZh", b"\x1b[0m" * 20]
    kinds = [None, "", "text/html; charset=koi8-r", "Application/PDF", "application/vnd.x+json", "image/png", "text/plain;charset='Latin1'", "junk", "application/zip", "text/x; charset=nope"]
    cases = [(k, b, c) for k, (b, c) in enumerate((b, c) for b in bodies for c in kinds)]
    b, c = F.col("b"), F.col("c")
    text = T.decode_body("b", F.lit("utf-8"))
    df = spark.createDataFrame(cases, "k int, b binary, c string").select("k", T.content_type(c), T.is_text_type(c), F.lower(T.magic_of(b)), T.codec_of(b, c), T.single_byte_evidence(b), T.looks_binary(text))
    got = {r[0]: tuple(r)[1:] for r in df.collect()}
    for k, body, value in cases:
        magic = T.magic_in(body)
        assert got[k] == (T.type_of(value), T.is_text_kind(T.type_of(value)), magic and magic.hex(), T.codec_for(body, value), T.mostly_ascii(body), T.is_odd(T.decode_bytes(body, "utf-8"))), (body, value)


def test_policies(spark):
    assert H.policy_domains(["A.com", "a.com.", "münchen.de"]) == ["a.com", "xn--mnchen-3ya.de"] and H.policy_domains(None) == []
    assert H.policy_domains(["https://a.com"]) is None and H.policy_domains([f"d{i}.org" for i in range(101)]) is None and H.policy_domains([7]) is None
    assert H.policy_prompt(None, []) == "" and [d in H.policy_prompt(["a.com"], ["b.com"]) for d in ("a.com", "b.com")] == [True, True]
    with pytest.raises(ValueError):
        H.policy_prompt(["a b.com/"], [])
    raw = spark.createDataFrame([(u, 200, "text/plain", b"some text") for u in ("http://www.münchen.de/", "http://a.org/", "http://a_b.org/")], "url string, status int, content_type string, body binary")
    errors = lambda *policy: [r["error"] for r in fetch.read_pages(raw, *policy).orderBy(F.desc("url")).collect()]
    assert errors() == [None, U.BAD_HOST, None]
    assert errors(["München.de"], []) == [None, U.BAD_HOST, U.BY_POLICY + "a.org."]
    assert errors([], ["http://x"]) == [U.BY_POLICY + "www.xn--mnchen-3ya.de.", U.BAD_HOST, U.BY_POLICY + "a.org."]


def test_bodies(spark):
    import gzip

    plain = b"some words of a page " * 9000
    packed, bare = gzip.compress(plain), zlib.compress(plain)
    assert [T.decompress_bytes(*a) for a in ((packed, "gzip"), (bare, "Deflate"), (bare[2:-4], "deflate"), (plain, None), (b"", "gzip"), (packed + gzip.compress(b"end"), "x-gzip"))] == [plain, plain, plain, plain, b"", plain + b"end"]
    assert T.decompress_bytes(packed, "br") is None and T.decompress_bytes(b"no gzip", "gzip") is None and T.decompress_bytes(None, "gzip") is None
    noise = gzip.compress(bytes(i * i % 251 for i in range(400_000)), 1)
    cut = T.decompress_bytes(noise[: len(noise) // 2], "gzip")
    assert cut and bytes(i * i % 251 for i in range(400_000)).startswith(cut)
    assert T.decompress_bytes(packed, "gzip", 1000) == plain[:1000]
    page = b"<html><head><title>T</title></head><body><p>" + b"words to read " * 30 + b"</p></body></html>"
    rows = [("http://a.org/1", 200, "text/html", gzip.compress(page), "gzip"), ("http://a.org/2", 200, "text/html", b"junk", "gzip"), ("http://a.org/3", 200, "text/html", page, None)]
    read = {r["url"][-1]: (r["error"], r["title"]) for r in fetch.read_pages(spark.createDataFrame(rows, "url string, status int, content_type string, body binary, content_encoding string")).collect()}
    assert read == {"1": (None, "T"), "2": (None, ""), "3": (None, "T")}
    broken = spark.createDataFrame([(200, "text/plain", noise[: len(noise) // 2], "gzip"), (200, "text/plain", gzip.compress(b"whole"), "gzip"), (200, "text/plain", gzip.compress(b"words " * 90)[:-4], "gzip")], "status int, content_type string, body binary, content_encoding string")
    found = [(r["error"] or r["text"])[-40:] for r in fetch.read_bodies(broken).collect()]
    assert found[0].endswith("bytes; not readable as text)") and found[1] == "whole" and found[2].endswith(T.CUT[-30:])
    assert column(spark, ["<NOSCRIPT x><p>a &amp;\n b</p></noscript>c<noscript>d</noscript>", "none", None], T.noscript_text) == ["a & b d", "", None]
    assert column(spark, [404, 799], fetch.status_message, "int") == ["Failed to fetch URL: HTTP 404 Not Found", "Failed to fetch URL: HTTP 799"]
    assert "from 1970-01-02 " in column(spark, [86_400_000], cache.stale_notice, "long")[0]
    found = spark.createDataFrame([("a", "2606:4700::1", 6, 0), ("a", "8.8.8.8", 4, 1), ("b", "8.8.8.8", 4, 0), ("b", "::1", 6, 1), ("c", "2606:4700::2", 6, 0)], "host string, ip string, family int, ord int")
    assert {r["host"]: (r["public"], r["ip"]) for r in fetch.host_verdicts(found).collect()} == {"a": (True, "8.8.8.8"), "b": (False, "8.8.8.8"), "c": (True, "2606:4700::2")}


def test_text(spark):
    assert [T.normal_text(x) for x in ("  <b>Hello</b>   &amp;   world  ", "café", "line​break", "a\0b\x1fc")] == ["Hello & world", "café", "linebreak", "abc"]
    assert column(spark, ["&notit; &notin; &ampx &#128; &#0; &nosuch;"], T.decode_entities) == ["¬it; ∉ &x € � &nosuch;"]
    assert column(spark, ["a \n b"], T.collapse_whitespace) == ["a b"]
    assert column(spark, ["", None, "abc def"], lambda c: T.truncate_text(c, 4)) == [T.NO_CONTENT, T.NO_CONTENT, "abc \n\n... (truncated, 7 chars total)"]
    assert column(spark, ["abcdef\n\n" + T.CUT], lambda c: T.truncate_text(c, 3)) == [f"abc\n\n... (truncated, {8 + len(T.CUT)} chars total)\n\n{T.CUT}"]
    assert column(spark, ["\0" * 125 + "a" * 875, "\0" * 130 + "a" * 870, "\x1b" * 500, "\x0b\x80" * 60], T.looks_binary) == [False, True, False, True]
    assert column(spark, ["text/html", "application/pdf", "image/svg+xml", None, "application/vnd.apple.installer+xml", "application/octet-stream", "junk"], T.is_text_type) == [True, False, False, True, False, True, True]
    assert column(spark, ["see [a](http://x(y)z) b\n\n c"], M.visible) == [10]
    assert T.decode_bytes(b"\xa1", "tis-620") == "ก" and T.decode_bytes(b"\xff", "nope") == "ÿ" and T.decode_bytes("é".encode("cp1252"), "iso8859-1") == "é" and T.decode_bytes(b"\x80\x81", "cp1252") == "€\x81"
    assert T.decode_bytes(b"\xff\xfe\0\0x\0\0\0\0\xd8\0\0\0\0\0\0zz", "utf-32le") == "x��" and T.decode_bytes("\ufeffx".encode("utf-8"), "utf-8") == "x"
    bodies = [b"\xef\xbb\xbfx", b"<html><meta charset=tis-620>", b"plain"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b binary")
    assert [r[0] for r in df.orderBy("i").select(T.codec_of(F.col("b"), F.lit("text/plain"))).collect()] == ["utf-8", "tis-620", "utf-8"]
    assert [r[0] for r in spark.createDataFrame([(b"  %PDF-1.4",), (b"text",), (b"BZh9",), (b"Rar!",)], "b binary").select(T.magic_of(F.col("b")).isNotNull()).collect()] == [True, False, True, False]
    starts = {"<!-- a --><?x?> <HTML>": (True, True), "<aside>": (True, False), "</html>": (True, True), "<div>": (False, False), "<!-- open <html>": (False, False), "<pre>": (True, False), "": (False, False), "\f<!doctype  html>": (True, True)}
    assert {t: (T.looks_like_html_text(t), T.looks_like_html_document_text(t)) for t in starts} == starts
    assert column(spark, list(starts), T.looks_like_html) == [h for h, _ in starts.values()] and column(spark, list(starts), T.looks_like_html_document) == [d for _, d in starts.values()]


def test_page_columns(spark):
    page = "<head><title>T &amp; U</title><meta name=author content=A><meta name=author content=B><meta property='article:published_time' content=2024><meta property='og:site_name' content=S></head><p>text"
    row = spark.createDataFrame([(page,), ("",)], "h string").select(M.page_struct("h").alias("p")).select("p.*").collect()
    assert row[0]["text"] == "Title: T & U\nAuthor: A\nDate: 2024\nSite: S\n\ntext" and row[1]["text"] == ""
    spa = "<title>t</title><div id='root'></div><script></script>"
    hints = spark.createDataFrame([(spa, "Title: t"), ("<p>", ""), ("<p>", "x " * 300), (None, None)], "h string, t string").select(M.render_hint(F.col("h"), F.col("t")).alias("h")).select("h.reason", "h.evidence").collect()
    assert [tuple(h) for h in hints] == [("js-shell", ["spa-markers"]), ("empty", []), (None, None), (None, None)]


def test_xpath_and_serp(spark):
    root = parse("<ul><li class=a>1</li><li class='a b'>2<br>x</li></ul><ul><li class=a>3</li></ul>")
    found = lambda path: [n if isinstance(n, str) else n.text() for n in select(root, compile_path(path))]
    assert found("//ul/li[contains(@class,'a') and position()=last()]") == ["2x", "3"] and found("//li[last()]") == ["3"]
    assert text_of(root, "//li[(@class='a' or contains(@class,'b')) and not-there]") == "" and text_of(root, "//li[@class='a']/@class") == "aa"
    assert found("//ul[.//li[@class='never']]/li[br]/text()") == ["2x"] and found("//ul[./li][@x]") == []
    assert parse("<a><img><b>x</a>").children[0].children[0].children[0].tag == "b"  # void elements hold what follows
    assert {e.items for e in serp.ENGINES.values()} >= {"//div[contains(@class, 'result')][./a]", "//li[.//h3[@class='title']]"}
    page = '<div class="result body"><h2><a href="https://in.example/">Example <b>Page</b></a></h2><a href="https://out.example/a b">A snippet</a></div><div class=body><h2>Ad</h2><a href="https://duckduckgo.com/y.js?x">ad</a></div>'
    assert serp.extract_hits(page, "duckduckgo") == [("Example Page", "https://out.example/a+b", "A snippet")]
    assert serp.extract_hits(page.replace("body", "result-wrapper").replace("<h2>", "<div class=title>").replace("</h2>", "</div>"), "brave")[1][0] == "Ad"
    own = serp.ENGINES | {"mine": serp.Engine("me", "//p", ".//b//text()", "./a/@href", "./a//text()", 9)}
    pages = spark.createDataFrame([("q", "duckduckgo", page), ("q", "other", page), ("q", "yahoo", None), ("q", "mine", "<p><b>t</b><a href=u>x</a></p>")], "query string, engine string, html string")
    rows = serp.serp_hits(pages, own).collect()
    assert [(r["engine"], r["rank"], r["title"]) for r in rows] == [("duckduckgo", 1, "Example Page"), ("mine", 1, "t")]
    assert serp.selected(["x"]) == ["duckduckgo", "startpage"] and serp.selected(["brave"], rendering=True) == ["brave"]


HIT = "query string, engine string, ord int, rank int, title string, href string, body string"


def test_fusion(spark):
    hits = spark.createDataFrame(
        [
            ("q", "a", 1, 1, "short", "https://e.com/x", "b"),
            ("q", "a", 1, 2, "other", "https://e.com/y", "b"),
            ("q", "a", 1, 3, "both", "https://f.com/z?utm_source=1", "b"),
            ("q", "a", 1, 4, "again", "https://f.com/z", "b"),
            ("q", "a", 1, 5, "Category:X - Wikimedia Commons", "https://w.org/c", "b"),
            ("q", "b", 2, 1, "both long", "https://f.com/z", "longer body"),
            ("q", "b", 2, 2, "", " ", ""),
        ],
        HIT,
    )
    top = fusion.fuse(hits, limit=10).orderBy("place").collect()
    assert [r["canon"] for r in top] == ["https://f.com/z", "https://e.com/x", "https://e.com/y"]
    assert top[0]["title"] == "both long" and [r["href"] for r in top] == [r["canon"] for r in top] and top[0]["score"] == pytest.approx(1 / 63 + 1 / 61, abs=1e-11)
    assert [r["canon"] for r in fusion.fuse(hits, per_domain=1).orderBy("place").collect()] == ["https://f.com/z", "https://e.com/x"]
    assert fusion.fuse(hits.repartition(7), limit=10).orderBy("place").collect() == top
    text = fusion.format_results(fusion.fuse(hits.withColumn("title", F.lit("x\nURL: evil")), limit=1)).first()["text"]
    assert text.count("\nURL: ") == 1 and text.endswith("\n\n---\n\n" + fusion.CLOSING)
    assert [fusion.clamp_results(n) for n in (None, float("nan"), 0, 3.9, 99, float("inf"))] == [5, 5, 1, 3, 20, 20] and [fusion.positive(n) for n in (2.9, 0.5, -1, True, "3", float("inf"))] == [2, None, None, None, None, None]


def test_search_over_captured_pages(spark):
    item = "<div class=body><h2>{0}</h2><a href='https://{1}/'>s</a></div>"
    pages = spark.createDataFrame([("q", "duckduckgo", item.format("A", "a.org") + item.format("B", "b.org")), ("q", "startpage", "<div class=result><a href='https://b.org/'><h2>B</h2></a><p>longer</p></div>"), ("q", "yandex", "<li class=serp-item><h3><a href='https://c.org/'>C</a></h3></li>")], "query string, engine string, html string")
    queries = spark.createDataFrame([("q",), ("none",)], "query string")
    got = {r["query"]: r["text"] for r in search.search(queries, search.captured(pages), blocked=["a.org"]).collect()}
    assert got == {"q": "Title: B\nURL: https://b.org/\nSnippet: longer\n\n---\n\n" + fusion.CLOSING, "none": fusion.NO_RESULTS}
    assert {r["text"] for r in search.search(queries, search.captured(pages), allowed=["http://bad"]).collect()} == {fusion.NONE_ALLOWED, fusion.NO_RESULTS}


def test_evaluate_and_cache(spark, tmp_path):
    runs = spark.createDataFrame([("e", v) for v in (1, 2, 3, 4)], "engine string, ms int")
    assert evaluate.upper_median(runs, "engine", "ms").first()["median"] == 3
    gold = spark.createDataFrame([("q", "a.org"), ("q", "b.org")], "query string, expected string")
    top = spark.createDataFrame([("e", "q", "a.org"), ("e", "q", "x.b.org"), ("e", "q", "c.org"), ("e", "q", "xa.org"), ("e", "r", "a.org")], "engine string, query string, domain string")
    assert evaluate.precision(top, gold, top, ["engine"]).first()["precision"] == 0.25
    runs = spark.createDataFrame([("q", "a", 7, "", 2, "t2", "h2", "b"), ("q", "a", 7, "", 1, "t1", "h1", "b"), ("q", "b", 9, "timed out", None, None, None, None)], "query string, engine string, ms long, error string, rank int, title string, href string, body string")
    evaluate.write_runs(runs, str(tmp_path / "runs"))
    again = evaluate.read_runs(spark, str(tmp_path / "runs")).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, runs.collect()), key=repr)
    entries = spark.createDataFrame([(f"old-{i:03d}", i, 1) for i in range(140)] + [("new", 10_000, 1)], "key string, ts_ms long, size long")
    kept = {r["key"] for r in cache.prune(entries, 10_001).collect()}
    assert len(kept) == 128 and "new" in kept and "old-000" not in kept and "old-139" in kept
    fresh = spark.range(1).select(cache.is_fresh(F.lit(0), cache.TTL_MS - 1), cache.is_fresh(F.lit(0), cache.TTL_MS)).first()
    assert tuple(fresh) == (True, False)


SPAN = "doc string, page int, ord int, block long, x0 double, y0 double, x1 double, y1 double, size double, text string, bold boolean, italic boolean, mono boolean"


def span(ord, x, y, text, page=1, size=12.0, width=40, bold=False, italic=False, mono=False, block=0):
    return ("d", page, ord, block, float(x), float(y), float(x + width), float(y + 12), size, text, bold, italic, mono)


def test_layout(spark):
    rows = [span(0, 0, 0, "a"), span(1, 60, 1, "b"), span(2, 100.5, 2, "c"), span(3, 0, 30, "T", size=24.0), span(4, 0, 60, " "), span(5, 0, 60, "w", width=0), span(6, 200, 32, "x", bold=True)]
    lines = layout.merge_lines(spark.createDataFrame(rows, SPAN)).orderBy("line").collect()
    assert [(r["text"], len(r["spans"])) for r in lines] == [("a bc", 2), ("T x", 2)]
    same = lambda *texts: [{"x0": 40.0 * k, "y0": 0.0, "x1": 40.0 * k + 40, "y1": 9.0, "size": 12.0, "text": t, "bold": False, "italic": False, "mono": False, "block": 0} for k, t in enumerate(texts)]
    assert [s["text"] for s in layout.sanitize(same("a", "b", "b"))] == ["ab"] and [s["text"] for s in layout.sanitize(same("a", "a"))] == ["a"]
    bands = spark.createDataFrame([("d", 1, i, n) for i, n in enumerate([1, 3, 3, 1, 2, 1])], "doc string, page int, line int, spans int")
    assert [(r["first"], r["last"]) for r in layout.table_bands(bands).collect()] == [(1, 2)]


def pages_of(spark, rows, n, plain=""):
    pages = spark.createDataFrame([("d", p, 800.0, plain) for p in range(1, n + 1)], "doc string, page int, height double, plain string")
    return layout.assemble(layout.page_texts(spark.createDataFrame(rows, SPAN), pages)).first()["text"]


def test_running_lines(spark):
    body = [span(1, 0, 400, f"Body {p}.", p) for p in (1, 2, 3, 4)]
    foot = [span(2, 0, 780, "Company report", p) for p in (1, 2, 3, 4)]
    text = pages_of(spark, body + foot + [span(3, 300, 760, str(p), p) for p in (1, 2, 3, 4)], 4)
    assert "Company" not in text and text.count("Body") == 4 and "\n1" not in text
    assert "Once" in pages_of(spark, body + [span(2, 0, 780, "Once", 1)], 4)  # on one page only
    assert "Company" in pages_of(spark, body[:1] + foot[:1], 1)  # one page has no running lines
    assert pages_of(spark, body + [span(2, 0, 300, "Middle", p) for p in (1, 2, 3, 4)], 4).count("Middle") == 4  # not at the edge
    number = pages_of(spark, body + [span(2, 0, 780, "Foot", p) for p in (1, 2, 3)] + [span(2, 0, 780, "42", 4)], 4)
    assert "42" in number and "Foot" not in number  # one number where others stand
    assert pages_of(spark, body[:1] + [span(2, 0, 780, "Twice", 1), span(3, 0, 781, "x", 1)], 3).count("Twice") == 1


def test_page_markdown(spark):
    rows = [span(0, 0, 100, "A Title", size=24.0, bold=True), span(1, 0, 114, "goes on", size=24.0, bold=True), span(2, 0, 140, "Plain text with"), span(3, 60, 140, "bold", bold=True), span(4, 0, 154, "• item"), span(5, 24, 168, "code()", mono=True), span(6, 0, 182, "after", block=1), span(7, 0, 220, "A"), span(8, 100, 220, "B"), span(9, 0, 234, "1"), span(10, 100, 234, "2")]
    text = pages_of(spark, rows, 1)
    assert text.startswith("## Page 1\n\n# **A Title** **goes on**\n") and "Plain text with **bold** \n" in text and "- item \n" in text and "```\n    code()\n```\n" in text and "|A|B|\n|---|---|\n|1|2|\n" in text
    many = pages_of(spark, [span(0, 0, 400, f"Page text {p}", p) for p in range(1, 53)], 52)
    assert many.endswith("... (PDF extraction is capped at 50 pages)") and "Page text 51" not in many
    plain = "plain letters " * 20
    assert pages_of(spark, [span(0, 0, 400, "few")], 1, plain).startswith("## Page 1\n\nplain letters")
    assert pages_of(spark, [span(0, 0, 400, "\ufffd" * 6)], 1, "whole") == "## Page 1\n\nwhole"


def test_fetch(spark, tmp_path):
    raw = [("https://a.org/", 200, "text/html", b"<html><head><title>T</title></head><p>hello"), ("https://a.org/404", 404, "text/html", b"x"), ("ftp://a.org/", 200, "text/html", b"x"), ("https://a.org/p", 200, "text/plain", b"%PDF-1"), ("https://a.org/i", 200, "image/png", b"x"), ("https://a.org/t", 200, "text/plain", b" plain ")]
    got = {r["url"]: r for r in fetch.read_pages(spark.createDataFrame(raw, "url string, status int, content_type string, body binary")).collect()}
    assert got["https://a.org/"]["text"] == "Title: T\n\nhello" and got["https://a.org/t"]["text"] == "plain"
    assert [got[u]["error"] for u in ("https://a.org/404", "https://a.org/p", "https://a.org/i")] == ["Failed to fetch URL: HTTP 404 Not Found", "(PDF content could not be read as text)", "(non-text content: image/png, 1 bytes; not readable as text)"]
    assert got["ftp://a.org/"]["error"] == U.BAD_SCHEME
    hosts = spark.createDataFrame([("h", "2001:db8::1", 6, 0), ("g", "8.8.4.4", 4, 1), ("g", "8.8.8.8", 4, 0), ("p", "10.0.0.1", 4, 0)], "host string, ip string, family int, ord int")
    assert {r["host"]: (r["public"], r["ip"]) for r in fetch.host_verdicts(hosts).collect()} == {"h": (False, "2001:db8::1"), "g": (True, "8.8.8.8"), "p": (False, "10.0.0.1")}
    tried = spark.createDataFrame([("u", 1, None, "HTTP 500"), ("u", 2, "ok", None)], "url string, attempt int, text string, error string")
    assert fetch.first_success(tried).first()["text"] == "ok"
    assert [fetch.refresh_of(p) for p in ("<meta http-equiv=refresh content='0; url=\"/x\"'>", "<meta http-equiv='REFRESH' content='5'>", "<p>refresh", "<script><meta http-equiv=refresh content='0;url=/x'></script>")] == ["/x", None, None, None]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.HTM").write_bytes(b"plain words")
    (tmp_path / "in" / "b.txt").write_bytes("é".encode("utf-16"))
    (tmp_path / "in" / "c.bin").write_bytes(bytes(100))
    files = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in fetch.scan_files(spark, str(tmp_path / "in")).collect()}
    assert files == {"a.HTM": "plain words", "b.txt": "é", "c.bin": "(binary content, 100 bytes; not readable as text)"}
    names = [str(tmp_path / n) for n in ("one.json", "none.json", "two.json")]
    (tmp_path / "one.json").write_text('{"webFetch": {"maxChars": 5}, "webSearch": {"engines": ["a"]}}')
    (tmp_path / "two.json").write_text('{"webTools": {"maxChars": -1, "timeoutMs": 2000}}')
    held = {r["key"]: r["value"] for r in settings.read_settings(spark, names).collect()}
    assert held["max_chars"] == "5" and held["timeout_ms"] == "2000" and held["engines"] == '["a"]' and held["transport"] == "tls-first"


def test_page_fetch_returns_whole_texts(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(5000))
    spark.createDataFrame([("https://a.org/", f"<!doctype html><html><head><title>T</title></head><article><p>{text}</article>")], "url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(text) > 20_000 and catalog.catalog_pages.page_fetch(spark, str(tmp_path)).first()["text"].endswith(text)
    raw = spark.createDataFrame([("https://a.org/", 200, "text/plain", text.encode())], "url string, status int, content_type string, body binary")
    assert fetch.read_pages(raw, most=10).first()["text"] == text[:10] + f"\n\n... (truncated, {len(text)} chars total)"


def test_boilerplate_lines():
    text = "Skip to content\ntext\n```\nwe use cookies\n```\nUh oh! Please reload this page.\nSign in\nWe use cookies. Read on."
    assert M.boilerplate_of(text) == ["Skip to content", "Uh oh! Please reload this page."]
    assert M.strip_boilerplate("a\n\nSkip to content\n\nb") == "a\n\nb"


def test_pdf(spark):
    stream = zlib.compress(b"BT (Hello \\(you\\)) Tj T* [(Wor) -300 (ld)] TJ <414243> Tj ET")
    pdf = b"%PDF-1.4 1 0 obj << /Length 1 /Filter /FlateDecode >> stream\n" + stream + b"\nendstream"
    files = spark.createDataFrame([("a", pdf), ("b", b"%PDF-1 /Encrypt stream\nx\nendstream"), ("c", None)], "path string, content binary")
    got = {r["path"]: (r["text"], r["error"]) for r in pdf_text.read_pdfs(files).collect()}
    assert got == {"a": ("Hello (you)\nWorldABC", None), "b": ("", pdf_text.UNREADABLE), "c": ("", pdf_text.UNREADABLE)}
    many = b"".join(b"<< >> stream\nBT (p%d) Tj ET\nendstream " % k for k in range(52))
    assert pdf_text.pdf_text(many).startswith("## Page 1\n\np0\n\n## Page 2") and pdf_text.pdf_text(many).endswith("capped at 50 pages)")
    assert pdf_text.pdf_text(b"stream\n\nendstream") == "" and pdf_text.stream_text(b"BT (a (b) \\053\\n) Tj ET (no) BT (open") == "a (b) +\nopen"


def test_stream(spark, tmp_path):
    spark.sql("select 1 as event_id, timestamp_ntz '2024-01-01 00:10:00' as ts, 'x' as event_type, 2.0D as value").write.parquet(str(tmp_path / "e"))
    static = spark.read.parquet(str(tmp_path / "e"))
    counted = windowed_counts(spark.readStream.schema(static.schema).parquet(str(tmp_path / "e")))
    query = counted.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counted").collect() == windowed_counts(static).collect()
