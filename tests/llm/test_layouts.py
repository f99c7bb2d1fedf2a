"""Planted layouts of pages, block for block: what must stay and what must go."""

from __future__ import annotations

import pytest

from quantloom.llm.html_text import main_text

A = "The river rose for three days, and the town, which lies in a bend, was cut off from the road to the coast."
B = "Boats carried bread, water and post, until the bridge, built in 1911, could be used again by light carts."
C = "Nobody was hurt, the mayor said, and the school, closed for a week, opens again on Monday at eight o'clock."
LONG = "Buy now, save more, and tell your friends, because this offer, made for readers like you, ends on Sunday, at noon, without fail."
STORY = f"<h1>The flood</h1><p>{A}</p><p>{B}</p><p>{C}</p>"
TEXT = "\n\n".join(["The flood", A, B, C])
REMARK = "<p>I disagree with this, strongly, since the bridge, as I recall, was built much later, and by other people.</p>"

GOES = {
    "blog theme comments": f'<div id="comments"><h2>2 thoughts</h2><ol class="comment-list"><li><article class="comment-body">{REMARK}</article></li><li><article class="comment-body">{REMARK}</article></li></ol></div>',
    "bare articles as comments": f'<div id="comments"><article>{REMARK}</article><article>{REMARK}</article></div>',
    "section of comments": f'<section id="comments"><h2>Comments</h2><div>{REMARK}</div></section>',
    "comment articles alone": f'<article class="comment">{REMARK}</article>',
    "comment class": f'<section class="comments-area"><div class="comment">{REMARK}</div></section>',
    "ad slot": f'<div class="ad-slot"><p>{LONG}</p><p>{LONG}</p></div>',
    "promo box": f'<div class="promo-box"><p>{LONG}</p><p>{LONG}</p></div>',
    "ad paragraph": f'<p class="ad">{LONG} {LONG}</p>',
    "advert paragraph": f'<p class="advert">{LONG} {LONG}</p>',
    "notice paragraph": f'<p class="notice">{LONG} {LONG}</p>',
    "sponsored": f'<div class="sponsored-content"><h3>Offer</h3><p>{LONG}</p></div>',
    "newsletter section": f'<section id="newsletter"><h2>Newsletter</h2><p>{LONG}</p></section>',
    "cookie banner": f'<div class="cookie-banner"><p>{LONG}</p></div>',
    "google ad": f'<ins class="adsbygoogle"></ins><div id="google_ads"><p>{LONG}</p></div>',
    "signup form": f'<form action="/s"><label>Mail</label><p>{LONG}</p><input name="m"><button>Go</button></form>',
    "sidebar with articles": f'<div class="sidebar"><article class="teaser"><p>{LONG}</p></article></div>',
    "aside": f"<aside><p>{LONG}</p></aside>",
    "menu": '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">News</a></li></ul></nav>',
    "footer": f"<footer><p>{LONG}</p></footer>",
    "script": "<script>var a = '<p>no, no, no</p>';</script><style>p{}</style>",
}


@pytest.mark.parametrize("name", sorted(GOES))
@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", '<div class="wrap"><div class="post">{}</div></div>'])
def test_what_is_no_article_goes_from_within_and_beside(name, shell):
    part = GOES[name]
    for body in (shell.format(STORY + part), shell.format(STORY) + part, part + shell.format(STORY), shell.format(STORY.replace(f"<p>{B}", part + f"<p>{B}"))):
        assert main_text(f"<html><body>{body}</body></html>") == TEXT


STAYS = {
    "form page": f'<form id="aspnetForm"><input type="hidden" value="x"><div id="content">{STORY}</div><button>Go</button></form>',
    "form page with article": f'<form><article>{STORY}</article></form><p>Short.</p>',
    "form page beside a line": f'<div>Tuesday, 4 March</div><form method="post"><div>{STORY}</div><select><option>a</option></select></form>',
    "modal page": f'<div class="modal"><article>{STORY}</article></div>',
    "no sidebar": f'<main><div class="content no-sidebar">{STORY}</div></main>',
    "has ads": f'<div class="page has-ads"><div class="entry">{STORY}</div></div>',
    "title ids": f'<article><h1 id="notices">The flood</h1><p id="ads">{A}</p><section id="cookies"><p>{B}</p></section><section id="menu"><p>{C}</p></section></article>',
    "all in a notice": f'<div class="notice">{STORY}</div>',
    "table layout": f"<table><tr><td>{STORY}</td></tr></table>",
    "comment on": f'<article><div class="comments-on-the-method">{STORY}</div></article>',
}


@pytest.mark.parametrize("name", sorted(STAYS))
def test_what_is_article_stays(name):
    assert main_text(f"<html><body>{STAYS[name]}</body></html>") == TEXT
