"""Pages written by hand, of makes that the labelled pages do not have."""

from __future__ import annotations

from collections import Counter

import pytest

from subtide.llm import html

A = "It was a long day, and the people of the town had much to say about it."
B = "The mayor, who had slept badly, said that the bridge would open in spring."
C = "Nobody believed her at first, but the work went on through the whole winter."
TEXT = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
WANT = "\n".join((A, B, C))

#: name, page, main text
PAGES = [
    ("article named by a compound", f'<article class="login-guide">{TEXT}</article>', WANT),
    ("main without comments", f'<main class="story comment-free">{TEXT}</main>', WANT),
    ("share of voice", f'<article id="share-of-voice">{TEXT}</article>', WANT),
    ("alert fatigue in an entry", f'<div class="entry"><div class="alert-fatigue">{TEXT}</div></div>', WANT),
    ("hidden gems beside a menu", f'<div id="hidden-gems">{TEXT}</div><div class="nav">x y</div>', WANT),
    ("menu without a name", f'<div><a href="/">Home</a> <a href="/n">News of today</a> <a href="/s">Sport</a></div><div>{TEXT}</div>', WANT),
    ("list menu without a name", f'<ul><li><a href="/">Home</a><li><a href="/n">News</a><li><a href="/s">Sport and games</a></ul>{TEXT}', WANT),
    ("footer without a name", f"<div>{TEXT}</div><div>© 2024 The Town Paper. Printed every day.</div>", WANT),
    ("rights in words", f"<div>{TEXT}</div><div><span>The Town Paper</span> All rights reserved</div>", WANT),
    ("cookie note without a name", f"<div><p>We keep small files on your machine.</p><button>Accept</button></div><div>{TEXT}</div>", WANT),
    ("sign-up box without a name", f"<div>{TEXT}</div><div>Get our letter every week <input name=mail></div>", WANT),
    ("list of links in an article", f"<article>{TEXT}<ul><li><a href=a>First source</a><li><a href=b>Second source</a><li><a href=c>Third source</a></ul></article>", f"{WANT}\nFirst source\nSecond source\nThird source"),
    ("article with buttons", f"<article><p>{A}</p><p>{B}</p><p>{C}</p></article><div class='btn-row'><button>Like</button></div>", WANT),
    ("comments by head", f'<div>{TEXT}</div><div class="post-comments"><p>What a fine day it was for me too, and for all of us.</p></div>', WANT),
    ("comments by layout words", f'<div class="content">{TEXT}</div><section class="comments-area"><p>What a fine day it was for me too, and for all of us.</p></section>', WANT),
    ("named frame", f'<div class="site-header">Town Paper</div><div class="main-nav">Home News</div><div class="td-post-content">{TEXT}</div><div class="sidebar-left">More of it</div><div class="site-footer">Contact</div>', WANT),
    ("advert in the middle", f'<article><p>{A}</p><div class="ad-slot">Buy a car today and never walk again, they say.</div><p>{B}</p><p>{C}</p></article>', WANT),
    ("page around a form", f"<form action=x><nav>Home</nav><article>{TEXT}</article></form>", WANT),
    ("table layout", f"<table><tr><td><a href=a>One thing</a> <a href=b>Two things</a> <a href=c>Three things</a></td><td>{TEXT}</td></tr></table>", WANT),
    ("prose with links", f'<div><p>It was a <a href=a>long day</a>, and the people of the town had much to say about it.</p><p>{B}</p><p>{C}</p></div>', WANT),
    ("quotation and list", f"<div class=prose><p>{A}</p><blockquote>{B}</blockquote><ul><li>{C}</li><li>Short one</li></ul></div>", f"{WANT}\nShort one"),
    ("has a sidebar", f'<div class="layout has-sidebar"><div>{TEXT}</div><aside>Other things of interest</aside></div>', WANT),
]


@pytest.fixture(scope="module")
def weights(spark):
    return html.train(html.labelled_pages(spark))


@pytest.mark.parametrize(("page", "want"), [p[1:] for p in PAGES], ids=[p[0] for p in PAGES])
def test_page(weights, page, want):
    whole = f"<html><head><title>T</title></head><body>{page}</body></html>"
    assert html.extract(whole, weights) == want


def test_precision_and_recall(weights):
    """Comment blocks of foreign names and prose are the known gap: they stay in the text."""
    foreign = f'<div>{TEXT}</div><div class="kommentare"><p>Was für ein schöner Tag das auch für mich war, und für uns alle.</p></div>'
    hit = found = true = 0
    for page, want in [*(p[1:] for p in PAGES), (foreign, WANT)]:
        got, due = Counter(html.extract(f"<body>{page}</body>", weights).split()), Counter(want.split())
        hit, found, true = hit + sum((got & due).values()), found + sum(got.values()), true + sum(due.values())
    assert hit == true and hit / found > 0.98


def test_heads_of_names(weights):
    assert weights.named("post-comment", True) == ("comment",) and weights.named("comment-list", True) == ("comment",) and weights.named("login-guide", True) == ()
    assert weights.named("login-guide", False) == ("~before",) and weights.named("has-sidebar", False) == () and weights.named("entry-content", True) == ("entry",)
    assert weights.named("zz-yy", False) == ()
