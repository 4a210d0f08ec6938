import html
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm.html_text import extract, main_text

P1 = "The first paragraph of the story is long enough, with commas, to be told from menus and lists."
P2 = "A second paragraph follows, it is &quot;quoted&quot; &amp; closed, and goes on for a good while."
T2 = 'A second paragraph follows, it is "quoted" & closed, and goes on for a good while.'
SIDE = "<aside class='sidebar'><h2>More</h2><ul><li><a href='/a'>One link</a></li><li><a href='/b'>Two, link</a></li></ul></aside>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just words", "just words"),
        (f"<nav><a href='/'>Home</a></nav><article><h1>Head</h1><p>{P1}</p><p>{P2}</p></article><footer>&copy; x</footer>", f"Head\n{P1}\n{T2}"),
        (f"<article><h1>Head</h1><p><b>{P1}<br><p>{P2}</p></article><footer>end</footer>", f"Head\n{P1}\n{T2}"),
        (f"<header><h1>Site</h1></header><div id=wrap><div class='content'><p>{P1}</p><p>{P2}</p></div>{SIDE}</div>", f"{P1}\n{T2}"),
        (f"<main><article><header><h1>Title</h1></header><p>{P1}</p><div class='ad-box ad'>Buy now, cheap, good.</div><p>{P2}</p></article><section id='comments'><p>{P1} A reader, me, writes, a lot.</p></section></main>", f"Title\n{P1}\n{T2}"),
        (f"<div class='cookie-notice'>We use cookies, many, many.</div><div><p>{P1}</p><form><p>Sign up, please, now.</p><input></form><p>{P2}</p></div>", f"{P1}\n{T2}"),
        (f"<article><p>{P1}</p><script>var t='</p><p>no</p>';</script><style>p{{}}</style><!-- <p>not</p> --><p>A&nbsp;b\n  c <i>d</i>e</p></article>", f"{P1}\nA b c de"),
        (f"<article><p>{P1}</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><pre>a\n b</pre></article>", f"{P1}\none\ntwo\nx\ny\na b"),
        (f"<p>{P1}<p>{P2}", f"{P1}\n{T2}"),
        (f"<article><div><div><p>{P1}</p></div></div><div><p>Short end.</p></div></article>", f"{P1}\nShort end."),
        (f"<DIV><P>{P1}</P></DIV></div></b></article>", P1),
        ("<p>a < b && c > d &#233;&#xe9;&eacute; &unknown; &lt;p&gt;</p>", "a < b && c > d ééé &unknown; <p>"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "<div>", "</div>", "<b", ">", "<!--", "-->", "<script>", "</script>", "<ul><li>", "&amp", "&#0;", "text, more", "</article>", "<article>", "<table><td>", "'", '"', "<br/>", "é", "<![CDATA["]), max_size=60))
def test_any_soup_gives_text(parts):
    assert isinstance(main_text("".join(parts)), str)


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + f"<p>{P1}</p>") == P1
    body = "".join(f"<p>{P1} {i}</p>" for i in range(3000))
    assert main_text(f"<article>{body}</article>").count("\n") == 2999


def by_pattern(page):
    """The article of a standard page by its known layout, without a parser."""
    inside = page[page.index("<article>") : page.index("</article>")]
    parts = (re.sub("<[^>]*>", "", b.replace("<br>", " ")) for b in re.split("</?(?:p|h1)>", inside))
    return "\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))


def test_standard_pages_keep_the_article_only(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = extract(pages)
    assert got.count() == pages.count()
    for r in got.join(pages, "page_id").select(got.text, "html", "n_chars").collect():
        inside = r.html[r.html.index("<article>") : r.html.index("</article>")]
        assert r.n_chars == len(r.text) > 0
        assert main_text(inside) == r.text == by_pattern(r.html)


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(1, "u", None, 0), (1, "u", None, 0), (None, None, f"<p>{P1}</p>", 1), (3, "v", "".join(rng.choices("<>p/ab ", k=5000)), 2)]
    assert extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).count() == 4
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


GOLD = [
    (f"<div><span>{P1}</span></div>", P1),
    (f"<div><b>{P1}</b></div><div><a href='/x'>More</a></div>", P1),
    (f"<body><font size=2>{P1}<br>{P2}</font></body>", f"{P1} {T2}"),
    (f"<form id=aspnetForm><div><p>{P1}</p><p>{P2}</p></div><input type=submit value=Go></form>", f"{P1}\n{T2}"),
    (f"<div class='page-header social'><p>{P1}</p><p>{P2}</p></div>", f"{P1}\n{T2}"),
    (f"<div class='post tags'><div><span>{P1}</span></div><div><span>{P2}</span></div></div>", f"{P1}\n{T2}"),
    (f"<body><h1>Title</h1><article><p>{P1}</p><p>{P2}</p></article><h1>Other site</h1></body>", f"Title\n{P1}\n{T2}"),
    (f"<main><h1>Title</h1><div><article><p>{P1}</p></article></div></main>", f"Title\n{P1}"),
    (f"<div><p>{P1}</p><div><span>{P2} And longer still, in a sibling.</span></div></div>", f"{P1}\n{T2} And longer still, in a sibling."),
    (f"<p title=it's>{P1}</p><p>It's {P2}</p>", f"{P1}\nIt's {T2}"),
    (f"<p title='a > b' data-x=\"c > d\">{P1}</p>", P1),
    (f"<article><p>{P1}</p></article><a href='/cut off", P1),
    (f"<table><tr><td><font>{P1}</font><td><a href='/'>Home</a></table>", P1),
    (f"<p>Formula <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> here. {P1}</p>", f"Formula x=2 here. {P1}"),
    (f"<p>Press <label>Start</label> and <button>OK</button>, then wait a while.</p><p>{P1}</p><label>Name</label><button>Send</button>", f"Press Start and OK, then wait a while.\n{P1}"),
    (f"<p>{P1}</p><p><button>Subscribe</button></p><p>Or <button>Subscribe to everything now</button></p>", f"{P1}\nOr"),
    (f"<div><p>{P1}</p><p>{P2}</p></div><div class=rail><h3>More</h3><p>Subscribe to us today, please.</p></div>", f"{P1}\n{T2}"),
    (f"<table><tr><td><a href=a>A</a> <a href=b>B</a></td><td><p>{P1}</p><p>{P2}</p></td><td><a href=c>C</a></td></tr></table>", f"{P1}\n{T2}"),
    (f"<article><p>{P1}</p><table><tr><td><a href=a>Ada</a><td>1<tr><td><a href=b>Bo</a><td>2</table></article>", f"{P1}\nAda\n1\nBo\n2"),
    (f"<div><h1>Title</h1><p>{P1}</p><ol><li>first<li>second</ol><p>{P2}</p></div><div><a href=a>Other</a> <a href=b>Stories</a></div>", f"Title\n{P1}\nfirst\nsecond\n{T2}"),
    (f"<body><p><a href=/>Home</a> | <a href=/n>News</a></p><div><h1>Title</h1><p>{P1}</p><p>{P2}</p></div></body>", f"Title\n{P1}\n{T2}"),
    (f"<article><p>{P1}</p><dl><dt>Term</dt><dd>Its meaning.</dd></dl><details><summary>Sum</summary><p>{P2}</p></details></article>", f"{P1}\nTerm\nIts meaning.\nSum\n{T2}"),
    (f"<main><p>H<sub>2</sub>O and x<sup>2</sup>. {P1}</p><figure><img src=a><figcaption>A caption.</figcaption></figure></main>", f"H2O and x2. {P1}\nA caption."),
    (f"<article><p>{P1}</p><p style='display:none'>Hidden words.</p><p hidden>More of them.</p><p aria-hidden=true>And more.</p></article>", P1),
    (f"<article><p>{P1}</p><noscript><p>Turn scripts on.</p></noscript><template><p>Not yet.</p></template><p>{P2}</p></article>", f"{P1}\n{T2}"),
    (f"<article><p>{P1}</p><div class='newsletter-box'><p>Get our news, weekly.</p></div><div id=share-bar><a href=x>X</a></div><p>{P2}</p></article>", f"{P1}\n{T2}"),
    (f"<article><p>{P1}</p><blockquote><p>Quoted, <cite>by one</cite>.</p></blockquote><hr><p>{P2}</p></article>", f"{P1}\nQuoted, by one.\n{T2}"),
    (f"<article><p>{P1} <code>a &lt; b</code> <kbd>Ctrl</kbd></p><pre><code>x = 1\ny = 2</code></pre></article>", f"{P1} a < b Ctrl\nx = 1 y = 2"),
    (f"<article><p>{P1}</p><ul class=tags><li><a href=t>tag</a></ul><section class=comments><p>First! {P2}</p></section></article>", P1),
    (f"<article><p>&#128512; &hellip; &zzz; {P1}</p></article>", f"\U0001f600 … &zzz; {P1}"),
    (f"<center><table><tr><td><p>{P1}</p><p>{P2}</p></table></center><p><a href=/>Back</a>", f"{P1}\n{T2}"),
    (f"<article><section><h2>One</h2><span>{P1}</span></section><section><h2>Two</h2><em>{P2}</em></section></article><div role=complementary><p>{P1}</p></div>", f"One\n{P1}\nTwo\n{T2}"),
]


@pytest.mark.parametrize(("page", "text"), GOLD)
def test_pages_written_by_hand(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "unit",
    ["<a ", "<div>", "<b><div>", "<span><tr><td>x", "<center><tr><td>", "<a t='x>y' ", "<a =\"", "<ul><li>x", "<div><header>x</header>", "<!--", "<p>x, y</p>", "&amp", "<div><i>", "<script>", "<h1>x"],
)
def test_time_grows_with_the_length(unit):
    def seconds(n):
        page = unit * n + "'" + P1
        began = time.process_time()
        main_text(page)
        return time.process_time() - began

    seconds(1000)
    assert seconds(80_000) < 12 * max(0.05, seconds(16_000))


@pytest.mark.parametrize(
    "opening",
    ["<div class='content with-sidebar'>", "<div class='has-header'>", "<div class='widget-area'>", "<div id=sidebar>", "<form action='/'>", "<form><div role=form class='widget'>"],
)
def test_what_holds_most_of_the_text_stays(opening):
    assert main_text(f"<nav><a href='/'>Home</a></nav>{opening}<p>{P1}</p><p>{P2}</p></div></form><div class=sidebar-left><p>Other things, to see.</p></div>") == f"{P1}\n{T2}"


def test_words_inside_an_article():
    page = f"<article><div class='article-header'><h1>Title</h1></div><h2 id='social-effects'>Effects</h2><p id=notice>{P1}</p><div class='site-header'>Site</div><p class=ad>Buy.</p><p>{P2}</p></article>"
    assert main_text(page) == f"Title\nEffects\n{P1}\n{T2}"


def test_replies_longer_than_the_article_go():
    assert main_text(f"<article><p>{P1}</p></article><section id=comments><p>{P2} {P2}</p><p>{P1} {P2}</p></section>") == P1


def test_short_siblings_of_the_best_container_stay():
    """Title, headings, lists, tables and short sections beside the winner, and text outside of any; links and boilerplate go."""
    long = "".join(f"<p>{P1} {i}</p>" for i in range(10))
    page = f"<div><h1>Title</h1>Loose, <a href='/x'>linked</a> text.<div>{long}</div><h2>Head</h2><ul><li>one<li>two</ul><div class=share><p>Share this.</p></div><table><tr><td>x<td>y</table><blockquote>Said.</blockquote><pre>a b</pre><div><p>Short end.</p></div><ul><li><a href='/a'>Link</a></ul></div>"
    lines = ["Title", "Loose, linked text.", *(f"{P1} {i}" for i in range(10)), "Head", "one", "two", "x", "y", "Said.", "a b", "Short end."]
    assert main_text(f"<body><nav><a href='/'>Home</a></nav>{page}<footer>end</footer></body>") == "\n".join(lines)
    assert main_text(f"<div><h1>Title</h1><div><div>{long}</div></div><p>End.</p></div>").split("\n")[0::11] == ["Title", "End."]
