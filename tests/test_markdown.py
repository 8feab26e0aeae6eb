"""Pages to Markdown: what is hidden or chrome goes, scopes and headers are chosen, text is kept."""

import time

import pytest

from weftline.functions import markdown as M

LANGS = "".join(f'<li><a href="https://x{i}.example.org/wiki/K">Lang{i}</a></li>' for i in range(300))
BODY = f"<p>{'Article body. ' * 30}</p>"
whole = lambda page: M.to_markdown(page, False)
main = lambda page: M.to_markdown(f"<body>{page}</body>")

#: name: (page, what must be there, what must not)
PLAIN = {
    "hidden": ("<p>seen</p><div hidden><p>secret</p></div><p>after</p>", ["seen", "after"], ["secret"]),
    "aria-hidden": ('<p>keep</p><span aria-hidden="true">gone</span><span aria-hidden="false">here</span>', ["keep", "here"], ["gone"]),
    "display none": ('<p>seen</p><div style="color: red; display : none !important; margin:0">gone</div><a style="background:url(none.png)">link</a><div style="display:block">block</div>', ["seen", "link", "block"], ["gone"]),
    "visibility": ('<p>keep</p><span style="visibility:hidden">ghost</span>', ["keep"], ["ghost"]),
    "hidden false": ('<p>keep</p><div hidden="false">gone</div>', ["keep"], ["gone"]),
    "hidden p ends": ("<div><p hidden>secret<p>one</p><p>two</p></div><p>after</p>", ["one", "two", "after"], ["secret"]),
    "hidden p with an open child": ("<p hidden><span>secret<div>seen</div><p>more", ["seen", "more"], ["secret"]),
    "hidden li": ("<ul><li hidden>secret<li>A</li><li>B</li></ul>", ["A", "B"], ["secret"]),
    "hidden li and lists in it": ("<ul><li hidden>parent<ul><li>secret child<ul><li>deeper secret</li></ul></ul><li>sibling</ul>", ["sibling"], ["parent", "secret"]),
    "hidden cell and a table in it": ("<table><tr><td hidden>outer<table><tr><td>secret</td></tr></table></td><td>seen</td></tr></table>", ["seen"], ["secret"]),
    "hidden p before hr": ("<p hidden>secret<hr>kept", ["kept"], ["secret"]),
    "hidden p before nav": ("<p hidden>secret<nav>chrome</nav>SEEN", ["SEEN"], ["secret", "chrome"]),
    "hidden void": ('<p>a</p><hr aria-hidden="true"><p>b</p>', ["a", "b"], ["---"]),
    "hr": ("<p>a</p><hr/><p>b</p>", ["---"], []),
    "br": ("<p>one<br/>two<br />three<br hidden>four</p>", ["one\ntwo\nthreefour"], []),
    "self-closing": ("<div/><p>kept</p>", ["kept"], []),
    "scripts": ('<head><script>if ("u"<typeof x) y()</script></head><SCRIPT>1 < 2 && "u"<typeof x</SCRIPT><p>text after</p>', ["text after"], ["typeof"]),
    "raw text": ("<title>a < b &amp; c</title><textarea>x < y</textarea><p>body</p>", ["a < b & c", "x < y", "body"], []),
    "odd names": ("<p><strong>bold</strong> and <toString>plain</toString></p><ul><li>item<toString>tail</ul><p>after", ["**bold**", "plain", "tail", "after"], []),
    "entities": ("<p>AT&amp;T &mdash; 5 &lt; 6 &euro; &#128; &#x80 &#x41;</p>", ["AT&T — 5 < 6 € € € A"], []),
    "unscoped": ("<p>Skip to content</p><header><h1>Site</h1><a href='/x'>Nav</a></header><main><p>hello</p></main>", ["Skip to content", "[Nav](/x)", "hello"], []),
    "aside": ("<aside><strong>Warning:</strong> careful.</aside>", ["**Warning:** careful."], []),
    "ordered": ('<ol start="3"><li>c</li><li>d</li></ol>', ["3. c\n4. d"], []),
    "nested lists": ("<ul><li>a<ol><li>b</li></ol></li></ul>", ["* a\n\n  1. b"], []),
    "cell": ("<table><tr><td>a|b</td><td>c<br>d</td></tr></table>", ["| a\\|b | c d |"], []),
}
SCOPED = {
    "main": (f"<header><a href='/l'>Sign in</a></header><main><h1>Doc</h1><p>{'Body text. ' * 40}</p></main><footer>junk</footer>", ["Doc", "Body text."], ["Sign in", "junk"]),
    "tiny": ("<h1>Tiny</h1><p>Just a short page.</p>", ["Tiny", "Just a short page."], []),
    "stub": (f"<article><p>Stub</p></article><main><p>{'Real content. ' * 30}</p></main>", ["Real content."], ["Stub"]),
    "siblings": (f"<article><h1>Real</h1><p>{'Main article text. ' * 40}</p></article>" + f"<article><p>{'Teaser blurb. ' * 5}</p></article>" * 5, ["Main article text."], ["Teaser"]),
    "furniture": (f"<article><p>Skip to content</p><p>You signed in with another tab or window. Reload to refresh your session.</p><p>Real body. {'Genuine text. ' * 20}</p></article>", ["Real body."], ["Skip to", "Reload"]),
    "prose that begins alike": (f"<article><p>We use cookies to know you.</p><p>{'More of it here. ' * 20}</p></article>", ["We use cookies to know you."], []),
    "fence": (f"<article><p>{'Prose. ' * 40}</p><pre>skip to content</pre></article>", ["skip to content"], []),
    "wide fence": (f"<article><pre>```\nskip to content\n\nreal line   \nmore</pre><p>{'Body text here. ' * 20}</p></article>", ["skip to content\n\nreal line   "], []),
    "open article": (f"<nav>Skip</nav><div>chrome here</div><article><h1>G</h1><p>{'Real body text. ' * 20}</p>", ["Real body text."], ["chrome"]),
    "listing": ("<main>" + "".join(f"<article><h2>Story {i}</h2><p>{'A summary sentence. ' * 20}</p></article>" for i in range(5)) + "</main>", [f"Story {i}" for i in range(5)], []),
    "dominant": (f"<article><p>{'Main story body. ' * 70}</p></article>" + f"<article><p>{'Teaser for an item. ' * 11}</p></article>" * 4, ["Main story"], ["Teaser"]),
    "language list": (f"<main><header><h1>Cat</h1><div><ul>{LANGS}</ul></div></header><p>{'A small mammal. ' * 30}</p></main>", ["# Cat", "small mammal"], ["Lang0"]),
    "short article": (f"<main><header><h1>Stub</h1><ul>{LANGS}</ul></header><p>{'Short body. ' * 25}</p></main>", ["# Stub", "Short body."], ["Lang0"]),
    "byline": (f"<article><header><h1>Why</h1><p>By Jane Doe</p><time>2026-07-12</time></header>{BODY}</article>", ["# Why", "By Jane Doe", "2026-07-12"], []),
    "small header": (f"<article><header><h1>T</h1><a href='/s'>Subscribe now</a></header>{BODY}</article>", ["Subscribe now"], []),
    "unclosed header": (f"<main><header><h1>T</h1><p>{'Article body text. ' * 40}</p></main>", ["Article body text.", "T"], []),
    "no landmark": (f"<header><h1>Site</h1><ul>{LANGS}</ul></header><p>{'Page prose. ' * 30}</p>", ["# Site", "Page prose."], ["Lang0"]),
    "header ended by an ancestor": (f"<div><header><h1>Site</h1><ul>{LANGS}</ul></div><p>{'Real prose. ' * 30}</p>", ["# Site", "Lang0", "Real prose."], []),
    "open link": (f"<main><header><h1>Title</h1><a href='/'>Home<p>{'Article body text. ' * 40}</p>", ["# Title", "Article body text."], []),
    "open link and a card": (f"<article><header><h1>R</h1><a href='/'>Home<p>{'REAL ' * 60}</p></article><article><p>{'CARD ' * 30}</p></article>", ["REAL"], ["CARD"]),
    "heading in a quotation": (f"<main><header><blockquote><h1>Page Title</h1></blockquote><ul>{LANGS}</ul></header>{BODY}</main>", ["Page Title", "Article body."], ["Lang0"]),
    "long links": ("<main><header>" + "".join(f'<a href="https://e.com/p?{"q" * 1000}={i}">L{i}</a>' for i in range(30)) + f"</header>{BODY}</main>", ["Article body."], ["L0"]),
    "linked heading and byline": (f"<article><header><h1><a href='/p'>{'A Very Long Headline ' * 15}</a></h1><p>By Jane</p></header>{BODY}</article>", ["By Jane", "Very Long"], []),
    "anchor without href": (f"<article><header><h1>T</h1><a name='i'>{'Prose as plain text. ' * 12}</a><p>Byline</p></header>{BODY}</article>", ["Prose as plain", "Byline"], []),
    "furniture-only card": ("<main>" + f"<p>{'The real body. ' * 50}</p>" + "<article><header>" + "".join(f'<a href="/l{i}">Language {i}</a>' for i in range(120)) + "</header><p>Short teaser.</p></article></main>", ["The real body."], ["Language 7"]),
    "long heading link": (f"<article><header><h1><a href='/p?{'q' * 900}'>Title</a></h1><a href='/j'>Jane</a></header>{BODY}</article>", ["Title", "Jane"], []),
    "furniture-only main": (f"<main><header><ul>{LANGS}</ul></header></main><p>{'Real prose here. ' * 30}</p>", ["Real prose here."], []),
    "stub with a long heading": (f"<article><header><h1>{'A Long Title That Exceeds Fifty Characters Here Too'}</h1><ul>{LANGS}</ul></header></article><article><p>{'Genuine text. ' * 30}</p></article>", ["Genuine text."], ["Long Title"]),
    "open link in a closed header": (f"<main><header><h1>T</h1><a href='/n'>{'Navigation label. ' * 20}</header>{BODY}</main>", ["Article body."], ["Navigation label."]),
    "link around a header": ("<main><a href='/n'><header>" + "".join(f"<span>Nav label {i}</span>" for i in range(40)) + f"</header></a>{BODY}</main>", ["Article body."], ["Nav label 0"]),
    "empty blocks": (f"<article><header><h1>{'A Fairly Long Heading Here' * 2}</h1>{'<div></div>' * 500}<a href='/x'>L</a></header></article><article><p>{'Genuine text. ' * 30}</p></article>", ["Genuine text."], []),
    "quoted heading": (f"<article><blockquote><header><h1>{'A Long Title That Exceeds Fifty Characters Here Too'}</h1><ul>{LANGS}</ul></header></blockquote></article><article><p>{'Genuine text. ' * 30}</p></article>", ["Genuine text."], []),
    "linked heading counted once": (f"<article><header><h1><a href='/p'>{'Headline word ' * 60}</a></h1><a href='/j'>Jane</a></header>{BODY}</article>", ["Jane"], []),
    "code counts": ("<article><header><h1>T</h1><ul>" + LANGS + "</ul></header><pre>" + "\n".join(f"# comment line {i}" for i in range(16)) + f"</pre></article><article><p>{'Sibling teaser here. ' * 12}</p></article>", ["comment line 1"], ["Sibling"]),
    "dropped furniture": ("<article><header>" + "".join(f'<a href="/l{i}">Lang{i}</a>' for i in range(1000)) + f"</header><p>{'Teaser words here. ' * 20}</p></article><article><p>{'The genuine body text goes here. ' * 60}</p></article>", ["The genuine body"], ["Teaser"]),
    "bracket and parenthesis": (f"<article><p>{'Real prose that is read. ' * 6}]({'y' * 100}) Tail prose to finish the paragraph off.</p></article><article><p>{'Sibling words. ' * 14}</p></article>", ["Real prose"], ["Sibling"]),
    "unbalanced destination": (f"<article><p><a href='/docs/(draft'>Doc</a> {'Article prose goes on here. ' * 9}</p></article><article><p>{'Sibling text. ' * 15}</p></article>", ["Article prose"], ["Sibling"]),
    "aria heading": (f"<article><header><div role='heading'>{'Card Title Words ' * 14}</div><ul>{LANGS}</ul></header></article><article><p>{'The real text. ' * 30}</p></article>", ["The real text."], ["Card Title"]),
    "heading and links in one anchor": ("<main><header><a href='/h'><h1>Title</h1>" + " ".join(f"NavWord{i:04}" for i in range(1200)) + f"</a><ul>{LANGS}</ul></header>{BODY}</main>", ["Title", "Article body."], ["NavWord0000"]),
    "destinations": ("<article><header>" + "".join(f'<a href="/l{i}">Lang{i}</a>' for i in range(120)) + f"</header><p><a href='/card(foo)?{'utm=x&' * 60}'>Read</a></p></article><article><p>{'The genuine text. ' * 30}</p></article>", ["The genuine text."], ["/card(foo)?"]),
    "open pre": (f"<main><header><h1>T</h1><ul>{LANGS}</ul><pre>{'NAVJUNK ' * 3}</header>{BODY}</pre></main>", ["Article body."], ["NAVJUNK"]),
    "quoted list in a header": (f"<main><header><h1>T</h1><blockquote><ul>{LANGS}</ul></header>{BODY}</main>", ["Article body."], ["Lang0"]),
    "list in a cell of a header": (f"<main><header><h1>T</h1><table><tr><td><ul>{LANGS}</ul></header>{BODY}</main>", ["Article body."], ["Lang0"]),
    "header in a quotation": (f"<main><blockquote><header><h1>T</h1><ul>{LANGS}</ul></header></blockquote>{BODY}</main>", ["Article body."], ["Lang0"]),
    "pre in a cell": (f"<main><header><h1>T</h1><table><tr><td><pre>CODE</header>{BODY}</main>", ["Article body."], ["CODE|"]),
    "hash lines": (f"<article><header><h1>T</h1><ul>{LANGS}</ul></header>" + "".join(f"<p>#include &lt;header_{i:02}.h&gt;</p>" for i in range(14)) + f"</article><article><p>{'Sibling teaser here. ' * 12}</p></article>", ["#include"], ["Sibling"]),
}
for k, (markup, kept) in enumerate([("<h1>Page Title</h1>", "Page Title"), ("<table><tr><td><h1>Page Title</h1></td></tr></table>", "Page Title"), ("<div role='heading'>Page Title</div>", "Page Title"), ("<a role='heading' href='/t'>Page Title</a>", "Page Title"), ("<a href='/p'><h1>Page Title</h1></a>", "Page Title"), ("<hgroup><h1>Title</h1><p>Subtitle here</p></hgroup>", "Subtitle here"), ("<div role='future heading'>Page Title</div>", "Page Title")]):
    SCOPED[f"heading kept {k}"] = (f"<main><header>{markup}<ul>{LANGS}</ul></header>{BODY}</main>", [kept, "Article body."], ["Lang0"])


@pytest.mark.parametrize("name", PLAIN)
def test_plain(name):
    page, there, gone = PLAIN[name]
    out = whole(page)
    assert all(x in out for x in there) and not any(x in out for x in gone), out


@pytest.mark.parametrize("name", SCOPED)
def test_scoped(name):
    page, there, gone = SCOPED[name]
    out = main(page)
    assert all(x in out for x in there) and not any(x in out for x in gone), out[:500]


def test_exact():
    assert whole("<p>&amp<b>x</b></p>") == "&**x**" and whole("<p>&notit;<b>y</b></p>") == "¬it;**y**"
    assert whole("<table><tr><th>Name</th><th>Count</th></tr><tr><td>a</td><td>1</td></tr></table>") == "| Name | Count |\n| --- | --- |\n| a | 1 |"
    assert "```\nline1\n\n\nline2\n```" in whole("<pre>line1\n\n\nline2</pre>") and "````\n```\n````" in whole("<pre>```</pre>")
    assert "# Readme" in whole("# Readme\n\n```html\n<div>not a page</div>\n```")
    out = main(f"<main><header><h1><a href='/post'>Title</a></h1><ul>{LANGS}</ul></header>{BODY}</main>")
    assert out.count("Title") == 1 and "# [Title](/post)" in out
    assert main(f"<main><a href='/x'><header><h1>T</h1></header></a>{BODY}</main>").count("[# T](/x)") == 1
    assert main(f"<main><header><div role='heading'><blockquote>Unique</blockquote></div><ul>{LANGS}</ul></header>{BODY}</main>").count("Unique") == 1
    out = main(f"<main><header><h1>Title</h1><ul>{LANGS}</ul></header>Article body text here.</main>")
    assert out.startswith("# Title") and "# TitleArticle" not in out
    out = M.to_markdown("<body><main><header><h1>Title</h1><blockquote>Quote")
    assert out.index("Title") < out.index("Quote")
    assert M.to_markdown("<body><main><a href='/x'>before<header><h1>Title").startswith("[before")
    assert M.to_markdown("<body><main><table><tr><td><header><h1>Title").startswith("|")
    nested = "<table><tr><td><header><table><tr><td>x</td></tr></table></header></td></tr></table>"
    assert main(nested) == whole(f"<body>{nested}</body>")
    item = next(x for x in main(f"<main><header><h1>T</h1><ul>{LANGS}</header><ul><li>Body item</li></ul></main>").split("\n") if "Body item" in x)
    assert item.startswith("*")
    for page in (f"<main><article><p><code><code>x</code></code></p><p>{'Body text. ' * 30}</p></article></main>", f"<main><code>head<header><h1>T</h1></header>tail</code>{BODY}</main>", f"<main><header><h1>T</h1><code>nav<ul>{LANGS}</ul></header>{BODY}</code></main>"):
        assert main(page).count("`") % 2 == 0
    assert "``x``" in main(f"<main><article><p><code><code>x</code></code></p><p>{'Body text. ' * 30}</p></article></main>")
    out = main(f"<main><header><h1>T</h1><a href='/a'>Jane{' ' * 300}Doe</a><time>July</time></header>{BODY}</main>")
    assert "Jane Doe" in out and "July" in out
    assert M.to_markdown(f"<body><main><header><h1>T</h1><p>{'&alpha;' * 400}</p>").count("α") == 400
    links = "".join(f'<a href="/very/long/section/path/number/{i:03}/index">L{i:03}</a>' for i in range(14))
    assert len({"L000" in main(f"<main><header><h1>T</h1>{w}</header>{BODY}</main>") for w in (links, f"<blockquote>{links}</blockquote>", f"<table><tr><td>{links}</td></tr></table>")}) == 1


def test_visible_chars():
    assert M.visible_chars("[a](b(c)d) e") == 4 and M.visible_chars("a](b)") == 5 and M.visible_chars("  \n\n[x](y") == 5 and M.visible_chars(r"\[a](b) \\") == 10


def test_head_in_page_order():
    page = "<svg><title>no</title></svg><title> A &amp;\n B </title><title>x</title><meta property='og:description' content='first'><meta name='description' content='second'><meta name='author' content=' '><meta name=AUTHOR content='x&amp;y'><meta property='dc.creator' content='z'><meta itemprop='datePublished' content='no'><meta name='date' content='2026'>"
    assert M.head_of(page) == {"title": "A & B", "author": "x&y", "date": "2026", "site": "", "description": "first"}


def test_readme_and_provenance():
    assert M.readme_text("# A\n\ntext") == "# A\n\ntext" and M.readme_text("<html><head><title>T</title></head><body><p>b</p></body></html>") == "Title: T\n\nb"
    assert M.with_provenance("Title: T\n\nbody", "http://x", "By y") == "Title: T\nURL: http://x\nBy y\n\nbody" and M.with_provenance("body", "http://x", "By y") == "URL: http://x\nBy y\n\nbody"
    assert M.body_chars("Title: T\nURL: u\n\nab [c](d)") == 5
    cut = "... (page truncated at the download limit)"
    assert M.prefixed(f"<p>x</p>\n\n{cut}").count(cut) == 1
    assert M.prefixed(f"<main><p>{'words ' * 60}</p></main>\n\n{cut}").endswith(f"words\n\n{cut}")


def test_deep_nesting_through_the_column(spark):
    page = "<body><main>" + "<header><h1>T</h1>" * 4000 + "</header>" * 4000 + "<p>body</p></main></body>"
    rows = spark.createDataFrame([(page,), ("<div>" * 20_000 + "deep",), (None,), ("",)], "html string").select(M.page_struct("html").alias("p")).collect()
    assert rows[0]["p"]["text"].endswith("body") and rows[1]["p"]["text"] == "deep" and rows[2]["p"] is None and rows[3]["p"]["text"] == ""


@pytest.mark.parametrize("build", [lambda n: "<header><h1>T</h1>" * n + "</header>" * n, lambda n: "<a " * n, lambda n: "<p title='" * n + ">", lambda n: "<li><a href=x>" * n, lambda n: "<!--" * n, lambda n: "&amp;" * n, lambda n: "<table><tr><td>" * n, lambda n: "[](" * n, lambda n: "<title>" * n, lambda n: "<b><code>" * n])
def test_time_is_linear(build):
    took = []
    for n in (4000, 16_000):
        began = time.perf_counter()
        M.to_markdown(f"<body><main>{build(n)}<p>body</p></main></body>")
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.3
