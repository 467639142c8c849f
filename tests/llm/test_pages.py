"""Extraction of main text on pages that the tree was not trained on, on hostile pages, and on the pages table."""

from __future__ import annotations

import html
import os
import re
import time

import pytest

from graphset.llm import html_extract as hx
from graphset.llm.common import table

#: Blocks begin with M (main text) or X (all else); layouts and names differ from those of the labelled table.
HELD_OUT = [
    """<html><body><div id=page><div class="site-nav"><a>X:Front</a> <a>X:Letters</a></div><div class="story-body"><h1>M:The bridge at the mill</h1><p class="lead">M:The bridge was built by hand, and it took the village three summers to finish it.</p><p>M:It holds.</p><p>M:Carts still cross it every day, though the <a href=x>new road</a> has taken most of the load away from it.</p></div>
    <div class="related-links"><h4>X:Related</h4><ul><li><a>X:The mill burns</a></li></ul></div><div class="site-footer">X:Printed by the mill press, all rights kept.</div></div></body></html>""",
    """<body><header><a>X:Logo</a><form><input><p>X:Search this site.</p></form></header><main><article><h2>M:Planting beans</h2><p>M:Beans want warm soil, so wait until the last frost is two weeks gone before you plant them.</p><ol><li>M:Soak the beans overnight.</li><li>M:Plant them two fingers deep.</li></ol><p>M:Water well.</p></article><section id="comments"><h3>X:What readers say</h3><div><p>X:Mine came up in a week, thank you for the good advice on the soaking.</p></div></section></main><footer><p>X:A paper of the garden club, published since long ago and still going.</p></footer></body>""",
    """<body><div class=promo><p>X:Subscribe now and save half of the price for a whole year, cancel at any time.</p></div><div id=content><h1>M:Rain</h1><p>M:It rained for nine days, and on the tenth the river came over the wall and into the lower street.</p><p>M:Nobody was hurt.</p><div class="share-bar"><a>X:Send</a><a>X:Print</a></div></div><aside><p>X:The weather desk is open every day for your calls and letters.</p></aside></body>""",
    """<body><nav><ul><li><a>X:One</a></li><li><a>X:Two</a></li></ul></nav><article><header><h1>M:A short walk</h1></header><p>M:Start at the church and follow the wall to the east until you come to the stile.</p><blockquote>M:Walk slowly, and look up.</blockquote><p>M:Cross the field and keep the hedge on your left until the lane comes into view again.</p><div class="newsletter-signup"><p>X:Walks in your inbox each Friday, free of charge and easy to stop.</p></div></article><div class="cookie-consent"><p>X:This site uses cookies, and by staying you agree to that.</p><button>X:Fine</button></div></body>""",
    """<body><table><tr><td><a>X:Home</a></td><td><a>X:Archive</a></td></tr></table><p>M:The old pages had no boxes, and all of their text stood in one long column from the top to the bottom.</p><p>M:One read them from the first line to the last, for there was nothing on them to press or to follow.</p><p>M:That was all.</p><div><a>X:Back</a> | <a>X:Next</a></div></body>""",
]


def test_held_out_pages(spark):
    tree = hx.train_tree(spark)
    judged = [(text.startswith("M"), hx.is_main(tree, f)) for page in HELD_OUT for text, f in hx.blocks(page)]
    assert sum(a == b for a, b in judged) >= 0.92 * len(judged), [t for page in HELD_OUT for t, f in hx.blocks(page) if hx.is_main(tree, f) != t.startswith("M")]


def texts(page):
    return [t for t, _ in hx.blocks(page)]


def test_what_does_not_end_a_block():
    assert texts("<p>one <script>var x='</p>'</script>two<style>p{}</style>, <svg><g/></svg>three</p>") == ["one two, three"]
    assert texts("a < b and c > d<p title='x > y'>e</p>") == ["a < b and c > d", "e"]
    assert texts('<p title="open>text</p><p>y</p>') == ["text", "y"]
    assert texts("&#99999999999999999; &#0000000065;&eacute;&nbsp;&amp;") == ["� Aé &"]


def test_named_paragraphs_and_open_links(spark):
    tree = hx.train_tree(spark)
    page = "<article><h1>Head</h1><p class='text-share'>A paragraph of the text with some more words in it than one.</p><a href=x>Link<p>A plain paragraph after a link that nobody closed, of a fair length too.</p></article>"
    assert "A paragraph of the text" in hx.main_text(page, tree) and "A plain paragraph after" in hx.main_text(page, tree)


@pytest.mark.parametrize("page", ['<a "' * 250_000, '<a b="' * 160_000, "<" * 1_000_000, "<div>" * 200_000, "<p><div>" * 60_000 + "</p>" * 60_000, "<p><article>" + "<div>" * 60_000 + "</p>" * 60_000, ")." * 500_000, "&#" + "9" * 1_000_000, "<p " + 'class="x' * 100_000 + ">", '<a b="' + ">" * 900_000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    hx.blocks(page)
    assert time.perf_counter() - began < 6


def test_rows(spark):
    rows = [(1, "u", HELD_OUT[0]), (1, "u", HELD_OUT[0]), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "long text " * 100_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, id int")
    got = hx.extract_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got) and max(r.n_chars for r in got) >= 999_999
    assert [r.text for r in got if r.page_id is None] == [""] and hx.extract_text(pages.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_pages_table_keeps_the_article_alone(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    found = {r.page_id: r.text.split("\n\n") for r in hx.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        plain = {" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.findall(r"<p>((?:(?!<p>|<div).)*?)</p>", inner, re.S)} - {""}
        assert plain <= set(found[r.page_id])
        nav = {" ".join(html.unescape(x).split()) for x in re.findall(r"<li><a[^>]*>(.*?)</a></li>", r.html.replace(inner, ""))}
        assert not nav & set(found[r.page_id])


ARTICLE = "<h1>The long road</h1><p>The road goes from the sea to the hills, and nobody has walked all of it in one go so far.</p><p>It is long.</p><p>Those who live along it say that it was there before the towns, and that the towns came for its sake.</p>"
WHOLE = "The long road\n\nThe road goes from the sea to the hills, and nobody has walked all of it in one go so far.\n\nIt is long.\n\nThose who live along it say that it was there before the towns, and that the towns came for its sake."
NAV, FOOT = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News of the day</a></li></ul></nav>", "<footer><p>Printed by the road press. All rights are kept by it.</p></footer>"
SIDE = "<div class=sidebar><h4>Weather</h4><p>Sun in the morning and rain in the afternoon, as on most days here.</p></div>"
LAYOUTS = {
    "class of a frame": f'<body>{NAV}<div class="content-with-sidebar"><article>{ARTICLE}</article></div>{FOOT}</body>',
    "state of the page": f'<body>{NAV}<div id="page" class="site has-sidebar"><div class="content">{ARTICLE}</div>{SIDE}</div>{FOOT}</body>',
    "word of an aside at the start": f'<body>{NAV}<div class="search-results-analysis">{ARTICLE}</div>{FOOT}</body>',
    "header of the article": f'<body>{NAV}<article><header class="entry-header"><h1>The long road</h1></header>{ARTICLE.split("</h1>")[1]}</article>{FOOT}</body>',
    "word of an aside at the end": f'<body>{NAV}<article>{ARTICLE.split("<p>It is")[0]}<div class="story-more"><p>It is{ARTICLE.split("<p>It is")[1]}</div></article>{FOOT}</body>',
    "aside name around the article": f'<body><div class="sidebar">{NAV}<main><article>{ARTICLE}</article></main></div>{FOOT}</body>',
    "open button": f"<body>{NAV}<div><button>Menu</div><article>{ARTICLE}</article>{FOOT}</body>",
    "open svg in the title": f"<body>{NAV}<article>{ARTICLE.replace('</h1>', '<svg></h1>')}</article>{FOOT}</body>",
    "open select and buttons": f"<body>{NAV}<form><select><option>One<option>Two</form><div><button>Go<button>Stop</button></div><article>{ARTICLE}</article>{FOOT}</body>",
    "blog": f'<body><header class="site-header"><p>The blog of roads, for all who walk.</p></header>{NAV}<main id="main"><article class="post"><div class="entry-content">{ARTICLE}</div><div class="share-buttons"><a>Share</a></div></article><section id="comments" class="comments-area"><h2>Two thoughts</h2><ol class="comment-list"><li class="comment"><p>I have walked it twice and it is longer than they say it is, by far.</p></li></ol></section></main>{SIDE}{FOOT}</body>',
    "news": f'<body><div class="ad-slot"><p>Boots for half the price, this week only, in all our shops.</p></div>{NAV}<div class="page-wrapper"><div class="story-body">{ARTICLE}</div><div class="related-articles"><h3>More stories</h3><ul><li><a>The short road</a></li></ul></div></div><div class="cookie-consent-banner"><p>We use cookies, and by going on you agree to all of them.</p></div>{FOOT}</body>',
    "camel case": f'<body>{NAV}<div id="mainContent">{ARTICLE}</div><div id="relatedLinks"><p>Other roads that you may like to walk on a day off.</p></div>{FOOT}</body>',
    "sections": f'<body>{NAV}<section class="hero-banner"><p>Walk more this year, with our new maps.</p></section><section class="article-section"><div class="text-block">{ARTICLE}</div></section><section class="newsletter-signup"><p>A walk in your inbox each Friday, free of charge.</p></section>{FOOT}</body>',
    "tables": f"<body><table><tr><td><a>Home</a></td><td><a>Maps</a></td></tr></table><table><tr><td>{ARTICLE}</td></tr></table><p><a>Back</a> <a>Next</a></p></body>",
    "no comments": f'<body class="no-comments">{NAV}<div class="post comments-closed">{ARTICLE}</div>{FOOT}</body>',
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_common_layouts_keep_every_paragraph(trained, name):
    assert hx.main_text(LAYOUTS[name], trained) == WHOLE


@pytest.fixture(scope="module")
def trained(spark):
    return hx.train_tree(spark)


@pytest.mark.parametrize("page", ["<button>" * 150_000, "<p><svg>" * 150_000, "<select><button>x" * 100_000, '<div class="ad">' * 100_000, "<button>" * 100_000 + "</button>", '<div class="ad"><article>' * 60_000])
def test_open_elements_take_linear_time(page):
    began = time.perf_counter()
    hx.blocks(page)
    assert time.perf_counter() - began < 6
