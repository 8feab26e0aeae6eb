"""The small labelled pages that the block classifier is grown on: ``data-keep`` labels what an element holds.

Bodies of articles and what stands around them are written once each, with and without containers that say what
they are, and put together into pages: so that an article may begin or end a page, be one block, hold short or
linked blocks, and so that menus, footers, comments and notices may have no name at all.
"""

from __future__ import annotations

from itertools import cycle

_LONG = "The council said on Monday that work on the old bridge will start in spring and should be over before the first frost, if the weather holds and money comes in time."
_MORE = "Nobody in the valley had expected the vote to go this way, least of all the mayor, who had spoken for the tunnel all winter and who now has to find another way to pay for the road."
_MID = "Most people have waited for this for many years, she said after the meeting."
_SOME = "The plan is on show until May."
_SHORT = "It rained."


def _p(text: str) -> str:
    return f'<p data-keep="y">{text}</p>'


def _links(*texts: str, tag: str = "li") -> str:
    return "".join(f"<{tag}><a href='/x'>{t}</a></{tag}>" for t in texts)


def _bodies() -> list[str]:
    h = '<h1 data-keep="y">Bridge works to begin</h1>'
    sub = '<h2 data-keep="y">What comes next</h2>'
    link = _p("<a href='/plan'>See the whole plan here</a>")
    rich = _p("See <a href='/o'>the old plan</a> now and then.")
    items = '<ul data-keep="y"><li>One lane is open</li><li>Two lanes are shut for the time being</li><li>Buses stop at the mill</li></ul>'
    return [
        h + _p(_LONG) + _p(_SHORT) + _p(_MORE) + _p(_MID),
        h + _p(_MORE) + _p(_LONG) + _p(_SHORT),
        _p(_LONG + " " + _MORE),
        h + _p(_LONG) + link + _p(_MORE) + rich + _p(_LONG),
        h + _p(_MID) + _p(_LONG) + sub + _p(_MORE) + items + _p(_LONG) + _p(_SOME),
        h + _p(_LONG + " " + _LONG + " " + _MORE),
        sub + _p(_MORE + " <a href='/m'>The minutes of the meeting</a> say more.") + _p(_MID) + _p(_LONG + " <a href='/s'>Source</a>") + _p(_MORE),
        h + _p(_SOME) + _p(_MORE) + _p(_LONG) + items + _p(_MORE) + sub + _p(_LONG) + _p(_MID),
    ]


def _before() -> list[str]:
    drop = ' data-keep="n"'
    menu = _links("Home", "News", "Sport and games", "Letters to us")
    return [
        "",
        f"<nav{drop}><ul>{menu}</ul></nav>",
        f"<div{drop}><ul>{menu}</ul></div>",
        f"<div{drop}>The Valley Paper</div><div{drop}>{_links('Home', 'News', 'Weather', tag='p')}</div>",
        f"<header{drop}><p>The Valley Paper</p><p>{_SOME}</p><p>{_LONG}</p></header>",
        f"<div class='cookie-notice'{drop}><p>{_MID}</p><p>{_LONG}</p></div><nav{drop}>{menu}</nav>",
        f"<div class='ad'{drop}>Buy one, get one free at the corner shop this week only.</div>",
        f"<div{drop}><a href='/'>Home</a> <a href='/n'>News</a> <a href='/l'>Letters</a></div>",
    ]


def _after() -> list[str]:
    drop = ' data-keep="n"'
    talk = f"<p>{_MORE}</p><p>{_SHORT}</p><p>{_MID}</p>"
    return [
        "",
        f"<footer{drop}><p>Copyright The Valley Paper. No part of it may be used again without a word from us first.</p><p><a href='/i'>Imprint</a></p></footer>",
        f"<div{drop}><ul>{_links('Older', 'Newer', 'About us', 'Imprint')}</ul></div>",
        f"<section class='comments'{drop}><h2>Comments</h2>{talk}</section>",
        f"<aside{drop}><h3>Also read</h3><p>{_MID}</p><p><a href='/x'>{_MID}</a></p><p>{_LONG}</p></aside>",
        f"<form{drop}><p>Get our letter</p><p>Write your address here and we send you a letter each week without any cost at all.</p></form>",
        "",
        f"<div class='sidebar'{drop}><p>{_MORE}</p><p>{_SOME}</p></div><footer{drop}><p>{_MID}</p></footer>",
        f"<div{drop}><p><a href='/a'>A new mayor for the valley</a></p><p><a href='/b'>Snow closes the pass again</a></p></div>",
        f"<div hidden{drop}><p>{_LONG}</p></div><p style='display:none'{drop}>{_MID}</p>",
    ]


def pages() -> list[str]:
    """Each body in each container, with parts before and after it taken in turn."""
    before, after, out = cycle(_before()), cycle(_after()), []
    holders = ["<article>{}</article>", "<main>{}</main>", "{}", "<div>{}</div>", "<div class='post-content'>{}</div>", "{}"]
    for turn in range(3):
        for holder in holders:
            for body in _bodies():
                out.append(next(before) + holder.format(body) + next(after))
            next(after)
        next(before)
    # Pages that are nothing but an article, marked or not, or a part of one.
    parts = [_p(_LONG), _p(_MID), _p(_SHORT), _p(_SOME) + _p(_LONG), _p(_LONG) + _p(_SHORT), _p(_MORE) + _p(_MID) + _p(_LONG), _p("See <a href='/o'>the old plan</a> now and then."), _p(_SHORT) + _p(_SOME), _p("<b>Now.</b>")]
    out += [holder.format(body) for holder in ("{}", "<div>{}</div>", "<article>{}</article>") for body in parts + _bodies()]
    drop = ' data-keep="n"'
    # In a marked main part links are text, too.
    kept = f'<h2 data-keep="y">Sources</h2><ul data-keep="y">{_links("The plan", "The minutes of the last meeting in the town hall", "Letters")}</ul>'
    for tag, body in zip(cycle(("article", "main")), _bodies()):
        out.append(f"<{tag}>{body}{kept}</{tag}>")
        out.append(f"<{tag}>{_p('<a href=/p>A first look in pictures</a>')}{body}{kept}{_p(_SHORT)}</{tag}><div{drop}><ul>{_links('Older', 'Newer')}</ul></div>")
        out.append(f"<div{drop}><ul>{_links('Home', 'News')}</ul></div><{tag}>{kept}{body}{_p('<a href=/p>More of it</a>')}</{tag}><div{drop}><p><a href='/a'>A new mayor for the valley</a></p></div>")
    # What stands inside a main part without belonging to the text, and text around one.
    inner = [
        f"<nav{drop}><p>{_MID}</p>{_links('One', 'Two')}</nav>", f"<aside{drop}><p>{_LONG}</p><p>{_SOME}</p></aside>", f"<form{drop}><p>{_MID}</p></form>", f"<div class='advert'{drop}><p>{_MORE}</p></div>",
        f"<section class='comments'{drop}><p>{_LONG}</p><p>{_SHORT}</p></section>", f"<footer{drop}><p>{_MID}</p></footer>", f"<div hidden{drop}><p>{_MORE}</p></div>", f"<div class='share-buttons'{drop}><p>{_SOME}</p></div>",
    ]
    outer = [f"<div{drop}><p>{_LONG}</p><p>{_SHORT}</p></div>", f"<div{drop}><p>{_MORE}</p></div>", f"<p{drop}>{_MID}</p>", f"<div{drop}><h2>{_SOME}</h2><p>{_LONG}</p></div>"]
    for k, body in enumerate(_bodies() * 2):
        tag = ("article", "main")[k % 2]
        out.append(f"<{tag}><header><p data-keep='y'>{_SOME}</p></header>{body}{inner[k % len(inner)]}{_p(_MID)}{inner[(k + 3) % len(inner)]}</{tag}>{outer[k % len(outer)]}")
        out.append(f"{outer[(k + 1) % len(outer)]}<{tag}>{inner[(k + 5) % len(inner)]}{body}</{tag}>")
    firsts = ['<h1 data-keep="y">Bridge</h1>', f'<h1 data-keep="y">{_MID}</h1>', _p(_SHORT), _p(_LONG), _p(_MORE + " " + _LONG)]
    seconds = [_p("<a href='/p'>A first look in pictures</a>"), kept, _p(_SHORT), _p(_LONG), '<h2 data-keep="y">Next</h2>', _p("<a href='/p'>More</a>"), ""]
    for k, (first, second) in enumerate((a, b) for a in firsts for b in seconds):
        tag = ("article", "main")[k % 2]
        out.append(f"{outer[k % len(outer)] if k % 3 == 0 else ''}<{tag}>{first}{second}{_p(_MID) if k % 4 else ''}</{tag}>{outer[(k + 2) % len(outer)] if k % 3 == 1 else ''}")
        if "href" not in second:
            out.append(f"<div>{first}{second}{_p(_MORE)}</div>")
    return out
