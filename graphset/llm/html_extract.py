"""Main text of web pages: flat text blocks, classified by a decision tree over the blocks and their neighbours.

A page becomes the flat list of its text blocks in page order.  Each block has its word count and link density, those of
the blocks before and after it, and what encloses it (kinds of elements, telling names in class, id and role).  A decision
tree, trained on the small labelled table below, tells main text from the rest.  Pages are parsed and judged inside Spark's
tasks; only the tree is sent there.

Names count as whole words of a class, id or role, not as parts of one (``has-sidebar`` names no box), and not on a frame that
holds most of the page with its article.

Defined cases: a null or empty page, or one without main text, gives an empty text of 0 characters; elements, links and
quotes may be left open, or elements nested wrongly; an unended comment, script or style swallows what follows, and any other
element that shows no text (button, svg, select and the like) ends with its block if it is left open; pages are read whole, in time in proportion to their length; rows alike are extracted each on its own; every input row gives one output
row, an empty table none, and null ids and urls stay null.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements that only mark up text inside a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select textarea head title button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements around what is not the article, and around the article.
ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
INSIDE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_LEVEL = HEADINGS | frozenset("p li dt dd blockquote pre figcaption".split())
#: Signs that end a sentence, and those that may stand behind them.
STOPS, CLOSERS = frozenset(".!?…:;"), "\"'”’)]"
#: Words of names (class, id or role) of boxes that hold no part of the article, when the name ends with them.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe signup login "
    "sidebar widget widgets related recommend recommended recommendations share sharing social nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead topbar toolbar pagination pager tags copyright legal disclaimer contentinfo complementary hidden".split()
)
#: Those that say so as the first word too, those that only do so as the whole name or behind a word for the site.
ASIDE_STARTS = frozenset("ad ads advert cookie cookies gdpr newsletter related recommended social share sponsored promo".split())
ASIDE_ALONE, SITE_WORDS = frozenset("header search side more".split()), frozenset("site top global main".split())
#: Words of what readers write, anywhere in a name.
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words behind which a name goes on about the box it names, and words that make a name a state of the page or its layout.
FURNITURE = frozenset("list lists links link bar box boxes block blocks area section container wrapper wrap inner outer panel item items row group slot unit form button buttons icon icons title message policy".split())
STATES = frozenset("has with without no not is js hide show open closed enabled disabled active layout page theme".split())
INSIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|body|text)(?:$|[\s_-])")
#: A named box that holds the page's main element or all of its articles, and more than this share of its words, is a frame.
FRAME_SHARE = 0.5

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
_OPEN_QUOTE = re.compile(r"=\s*([\"'])")
_NAMES = re.compile(r"(?:\s|^)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PART = re.compile(r"[-_]+")
#: A tag at which a block of text begins or ends.
_BLOCK_TAG = re.compile(r"</?(?:address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|tr|ul)[\s/>]", re.I)
_HIDDEN = re.compile(r"(?:\s|^)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
#: A character reference of more digits than any character has.
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")

#: Elements whose content is no markup, up to their own end tag or the end of the page.
RAW = frozenset("script style".split())
#: Elements that are never inside their like: another one ends the one before.
SINGLE = frozenset("button select textarea title".split())

FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "aside", "aside_name", "inside", "heading", "item", "stop")


def box_kind(names: str) -> str:
    """'comments', 'aside' or '', as the whole names of an element say."""
    kind = ""
    for name in names.split():
        parts = [p for p in _PART.split(_HUMP.sub("-", name).lower()) if p]
        if not parts or STATES & {*parts}:
            continue
        if COMMENT_WORDS & {*parts}:
            return "comments"
        head = list(parts)
        while len(head) > 1 and head[-1] in FURNITURE:
            head.pop()
        alone = head[-1] in ASIDE_ALONE and (len(head) == 1 or head[-2] in SITE_WORDS)
        if head[-1] in ASIDE_WORDS or head[0] in ASIDE_STARTS or alone:
            kind = "aside"
    return kind


def decoded(text: str) -> str:
    """Character references decoded, white space as one space."""
    if "&" in text:
        text = html.unescape(_LONG_REFERENCE.sub("\ufffd", _ZEROS.sub(r"&#\1", text)))
    return " ".join(text.split())


def end_of_tag(page: str, at: int, last: int) -> int:
    """Where the tag that opens before ``at`` ends, or -1: at its first > that no quoted value holds.

    A quote that is not closed before the next < is taken as left open, so no more than the text up to there is looked at.
    """
    begin = at
    while at <= last:
        end = page.find(">", at)
        quote = None
        pos = begin
        while (m := _OPEN_QUOTE.search(page, pos, end)) is not None:
            close = page.find(m.group(1), m.end(), end)
            if close < 0:
                quote = m
                break
            pos = close + 1
        if quote is None:
            return end
        after = page.find("<", end)
        close = page.find(quote.group(1), end, after if after >= 0 else len(page))
        if close < 0:
            return end
        begin = at = close + 1
    return -1


class Nesting:
    """The open elements of a page: (name, aside, not shown or by readers, inside, innermost named box); closing one takes time
    for what it closes only."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, bool, int]] = []
        self.at: dict[str, list[int]] = {}
        self.walls: list[int] = []

    def push(self, item: tuple[str, bool, bool, bool, int]) -> None:
        self.at.setdefault(item[0], []).append(len(self.stack))
        if item[0] in ("article", "main", "body"):
            self.walls.append(len(self.stack))
        self.stack.append(item)

    def pop(self) -> None:
        name = self.stack.pop()[0]
        self.at[name].pop()
        if name in ("article", "main", "body"):
            self.walls.pop()

    def close(self, name: str) -> None:
        places = self.at.get(name)
        if not places or (name in ("p", "li", "span") and self.walls and self.walls[-1] > places[-1]):
            return
        for _ in range(len(self.stack) - places[-1]):
            self.pop()


class Boxes:
    """Boxes that a name calls no part of the article, each in the one around it, with the words, articles and main elements
    that they hold."""

    def __init__(self):
        self.around = [-1]
        self.held = [[0, 0, 0]]

    def open(self, around: int) -> int:
        self.around.append(around)
        self.held.append([0, 0, 0])
        return len(self.around) - 1

    def left_out(self) -> list[bool]:
        """Of each box, whether it or one around it does what its name says: frames do not.  Box 0 is the page."""
        for i in range(len(self.around) - 1, 0, -1):
            for k, n in enumerate(self.held[i]):
                self.held[self.around[i]][k] += n
        words, articles, _ = self.held[0]
        out = [False]
        for i in range(1, len(self.around)):
            own, inner, mains = self.held[i]
            frame = own > FRAME_SHARE * words and (mains > 0 or 0 < articles == inner)
            out.append(out[self.around[i]] or not frame)
        return out


class Ahead:
    """The next match of each pattern from a place on, for places that only go forward: every part of a page is searched once."""

    def __init__(self, page: str):
        self.page = page
        self.found: dict[str, re.Match | None] = {}

    def next(self, pattern: str, at: int) -> re.Match | None:
        m = self.found.get(pattern, False)
        if m is False or (m is not None and m.start() < at):
            m = self.found[pattern] = re.compile(pattern, re.I).search(self.page, at)
        return m


def after_silent(page: str, ahead: Ahead, name: str, at: int) -> int:
    """Where the text goes on behind an element that opened before ``at`` and shows none; one left open ends with its block."""
    if name == "head":
        stop = ahead.next(r"</head\s*>|<body[\s>]", at)
        return len(page) if stop is None else stop.start() if stop.group(0)[1] != "/" else stop.end()
    stop = ahead.next(rf"</{re.escape(name)}\s*>", at)
    if name in RAW:
        return len(page) if stop is None else stop.end()
    again = ahead.next(rf"<{re.escape(name)}[\s/>]", at) if stop is not None and name in SINGLE else None
    if stop is None or (again is not None and again.start() < stop.start()):
        block = _BLOCK_TAG.search(page, at, len(page) if again is None else again.start())
        return block.start() if block is not None else len(page) if again is None else again.start()
    return stop.end()


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """(text, features) of the text blocks of a page."""
    found: list[tuple[str, int, int, bool, bool, bool, bool, bool, int]] = []
    nest, boxes, ahead = Nesting(), Boxes(), Ahead(page)
    stack = nest.stack
    text: list[str] = []
    linked = [0, 0]  # open links, words in links
    tag = ""

    def flush() -> None:
        if text:
            whole = decoded("".join(text))
            if whole:
                _, aside, name, inside, box = stack[-1] if stack else ("", False, False, False, 0)
                heading = any(s[0] in HEADINGS for s in stack[-3:]) or tag in HEADINGS
                item = any(s[0] in ("li", "dt", "dd", "td", "th", "option") for s in stack[-4:])
                words = whole.count(" ") + 1
                boxes.held[box][0] += words
                found.append((whole, words, min(linked[1], words), aside, name, inside, heading, item, box))
            text.clear()
        linked[1] = 0

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            if linked[0]:
                linked[1] += len(piece.split())

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        start = page.find("<", at)
        if start < 0 or start > last:
            add(page[at:])
            break
        if page.startswith("<!--", start):
            add(page[at:start])
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        m = _NAME.match(page, start + 1)
        if m is None:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                add(page[at:start])
                at = page.find(">", start) + 1
            else:  # a mere sign
                add(page[at : start + 1])
                at = start + 1
            continue
        add(page[at:start])
        end = end_of_tag(page, m.end(), last)
        if end < 0:
            end = page.find(">", m.end())
        at = end + 1
        closing, name, attributes = m.group(1), m.group(2).lower(), page[m.end() : end]
        if name == "br":
            text.append(" ")
            continue
        if name == "a":
            linked[0] = 0 if closing else 1
            continue
        if name in INLINE:
            continue
        if name in SILENT and not closing:
            # inside a line of text these do not end it
            if name in ("head", "title"):
                flush()
            elif name not in ("script", "style", "noscript", "template"):
                text.append(" ")
            if attributes.rstrip().endswith("/") and name not in ("script", "style"):
                continue
            at = after_silent(page, ahead, name, at)
            continue
        if name in SILENT:
            continue
        had_link_text = linked[1] > 0
        flush()
        tag = "" if closing else name
        if closing:
            linked[0] = 0
            nest.close(name)
        elif name not in VOID:
            if name in TEXT_LEVEL and had_link_text:
                linked[0] = 0  # a link left open ends with its line
            if name in ("p", *HEADINGS, "li", "dt", "dd") and stack and stack[-1][0] == ("li" if name == "li" else "p"):
                nest.pop()
            _, aside, named, inside, box = stack[-1] if stack else ("", False, False, False, 0)
            names = " ".join("".join(x) for x in _NAMES.findall(attributes)) if attributes else ""
            outer = name == "header" and not inside
            kind = box_kind(names) if names and name not in ("html", "body") else ""
            inside_name = bool(names) and not kind and INSIDE_NAMES.search(names.lower()) is not None
            if kind == "aside" and (name in INSIDE or name in TEXT_LEVEL and INSIDE_NAMES.search(names.lower()) is not None):
                kind = ""  # the article, or a paragraph of the text, whatever else its name says
            hidden = bool(attributes) and _HIDDEN.search(attributes) is not None
            readers = kind == "comments" and (name != "article" or bool(nest.at.get("article")) or named)
            if kind == "aside":
                box = boxes.open(box)
            elif name in INSIDE and not readers and not named:
                boxes.held[box][1 if name == "article" else 2] += 1
            nest.push((name, aside or name in ASIDE or outer, named or hidden or readers, inside or name in INSIDE or inside_name, box))
    flush()
    out, left_out = [], boxes.left_out()
    for i, (whole, words, links, aside, named, inside, heading, item, box) in enumerate(found):
        prev, post = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        f = [words, links / words, prev[1] if prev else 0, prev[2] / prev[1] if prev else 0, post[1] if post else 0, post[2] / post[1] if post else 0, aside, named or left_out[box], inside, heading, item, whole.rstrip(CLOSERS)[-1:] in STOPS]
        out.append((whole, [float(x) for x in f]))
    return out


#: The labelled table: pages whose blocks begin with M (main text) or X (all else) in their first word.
LABELLED = [
    """<body><header><h1>X:Daily Paper</h1><p>X:News you can trust since long ago, every day of the week.</p></header><nav><ul><li><a href=/>X:Home</a></li><li><a href=/w>X:World news</a></li><li><a>X:Sport</a></li></ul></nav>
    <article><h1>M:Harbour opens again</h1><p>M:The old harbour opened again on Monday after two years of work on its walls and gates.</p><p>M:It rained.</p><p>M:Fishermen came <a>back</a> with their boats in the early morning, and hundreds of people stood along the quay to greet them.</p>
    <h2>M:What comes next</h2><ul><li>M:A market hall.</li><li>M:Two piers for the ferries to the islands.</li></ul><p>M:Done.</p></article><aside><h3>X:Most read</h3><ul><li><a>X:Ten tips for a better garden this spring</a></li><li><a>X:Why the river runs low</a></li></ul><p>X:Our weekly pick of the best stories, chosen by the editors for you to read at leisure.</p></aside>
    <footer>X:Copyright Daily Paper. All rights reserved. <a>X:Imprint</a></footer></body>""",
    """<body><div class=topbar><a>X:Sign in</a> <a>X:Register</a></div><div id=main><h1>M:Bread from rye</h1><div class=ad>X:Buy our flour now, it is the best flour in town and it is cheap.</div><p>M:Mix the flour with warm water and leave the dough alone for a whole day in a warm place.</p><p>M:Bake.</p>
    <p>M:Let the loaf rest before you cut it, for it will crumble while it is hot.</p></div><div class="cookie-notice">X:We use cookies to make this site work better for you. By using it you agree to our terms of use.</div><div id=comments><h3>X:Comments</h3><div class=comment><p>X:I tried this and it turned out very well, thank you so much for the recipe and the pictures.</p></div><div class=comment><p>X:Nice.</p></div></div>
    <form><p>X:Write a comment and tell us what you think about this recipe.</p></form></body>""",
    """<body><div><a>X:Start</a> | <a>X:News</a> | <a>X:Contact</a></div><div><p>M:A plain page without any telling names can still hold a long paragraph of main text, which is easy to tell by its words and by its lack of links.</p><p>M:A second long paragraph follows the first one and goes on about the same thing for a while, as such paragraphs do.</p><p>M:Short one.</p>
    <p>M:And a third paragraph of some length closes the page, for now at least, with a few more words than needed.</p></div><div><a>X:Previous</a> <a>X:Next</a></div><p>X:(c) 2020</p></body>""",
    """<body><nav><a>X:A</a><a>X:B</a></nav><div class=ad>X:A short ad.</div><article><h1>M:Title</h1><p>M:One.</p><p>M:Two words.</p><p>M:A longer paragraph with quite a few words that go on for a line or so.</p></article><footer>X:The footer holds a sentence. And one more sentence of the usual kind, which is rather long for a footer.</footer></body>""",
    """<body><main><h2>M:Notes on tides</h2><p>M:Tides follow the moon, and <a>the sun</a> helps or hinders them.</p><table><tr><td>M:High</td><td>M:Twice a day</td></tr></table><blockquote>M:Time and tide wait for no man.</blockquote><pre>M:t = 12.4 h</pre><div class=share><a>X:Share</a> <a>X:Tweet</a></div><div class=related><p>X:You may also like these stories about the sea and the people who live from it.</p><ul><li><a>X:Waves</a></li></ul></div></main>
    <div class=sidebar><p>X:About the author of this site, who has lived by the sea for thirty years and writes about it.</p></div><section class=newsletter><p>X:Get our letter every week, free of charge, right to your inbox.</p></section></body>""",
    """<body><ul><li><a>X:Products</a></li><li><a>X:Prices and plans</a></li><li><a>X:Help</a></li></ul><h1>M:How to mend a net</h1><p>M:Lay the net flat on the ground and look for the torn meshes one after another, beginning at the edge.</p><p>M:Take twine of the same strength as the old one, and a needle of wood.</p><h3>M:Knots</h3><p>M:The sheet bend holds best, and it is quick to tie when the hands are cold and wet.</p><p><a>X:Read more about knots</a></p><p><a>X:Back to top</a></p></body>""",
    """<body><header class=site-header><p>X:The quarterly of the society, in its ninetieth year, for members and friends.</p></header><article class=post><header><h1>M:On maps</h1><p>M:By a reader</p></header><p>M:Maps lie, but they lie usefully.</p><p>M:No map shows all, and the choice of what it shows is what makes it a map at all rather than a picture of the land.</p></article><div class=popup>X:Wait! Subscribe before you go and never miss an issue again.</div><div role=contentinfo>X:Published by the society. Printed on paper.</div></body>""",
    """<body><article><nav><a>X:Part one</a> <a>X:Part two</a></nav><h1>M:Inside</h1><p>M:Words of the article, a fair number of them, so that it counts as one.</p><form><p>X:Sign up for our letter.</p><label>X:Your mail</label></form><p>M:Fine.</p><aside><p>X:A word from the makers of this paper, who need your help to go on with it this year.</p></aside>
    <p>M:And then a few more words.</p><footer><p>X:Filed under stories, by the desk, in the year of the long rain.</p></footer></article></body>""",
    """<body><div class=header><p>X:The site of all sites, with all you want.</p></div><div class=menu><a>X:One</a> <a>X:Two</a></div><div class=notice>X:This site will be down on Sunday for repairs, please come back on Monday.</div><div class=content><h1>M:Small news</h1><p>M:It snowed.</p><p>M:The roads are closed, and the <a>buses</a> stay in their sheds until the ploughs are through.</p><p>M:No school.</p>
    <div class=advert><p>X:New tyres at half the price, only this week and only here.</p></div><p>M:Stay at home.</p></div><div class=sidebar><h3>X:Weather</h3><p>X:Cold. Very cold at night.</p></div><div id=footer><p>X:Made by people who like snow. Write to us if you like it as well.</p></div></body>""",
    """<body><article><h1>M:Talk</h1><p>M:Here is what was said on that evening in the hall, in full and in the order in which it was said.</p><p>M:Good.</p><section class=comments><h2>X:Readers write</h2><p>X:I was there and it was just like that, thank you for writing it all down for those who were not.</p><p>X:Me too.</p><form><p>X:Write.</p></form></section></article><aside><p>X:Seen elsewhere.</p></aside></body>""",
    """<body><div class=site-nav><ul><li><a>X:Home</a></li></ul></div><div class=entry-content><p>M:Yes.</p><p>M:No, not like that at all.</p><ul><li>M:First.</li><li>M:Second, which is <a>linked</a> in part.</li></ul></div><div class=footer>X:A long line at the foot of the page that says who runs it, where they live, and what they think of the law.</div></body>""",
    """<body><div class=banner>X:Big sale today.</div><main><p>M:A.</p><p>M:Bee.</p><dl><dt>M:Term</dt><dd>M:Meaning of the term.</dd></dl><p><a>M:Source</a></p></main><div class=comment-list><div class=comment><p>X:First! And a great piece of writing too, if I may say so here.</p></div></div><div hidden><p>X:Not shown to any reader of the page, for now.</p></div></body>""",
    """<body><nav><p>X:Where to go from here, dear reader.</p></nav><aside><p>X:Old words.</p></aside><h1>M:Bare page</h1><p>M:Some pages have no boxes at all, and their paragraphs stand in the body one after another, as in the old days.</p><p>M:That is fine too, for there is not much else on such a page that one could take for its text.</p><footer><p>X:Bye.</p></footer></body>""",
    """<body><article><h1>M:No foot</h1><p>M:This page ends with its article, and nothing comes behind it.</p><p>M:The end.</p></article></body>""",
    """<body><div><a>X:Up</a></div><p>M:A bare page may end with its text too, with neither a footer nor a line of links behind the last of its words.</p><p>M:Its last paragraph is text like the rest, and it should stay where it is.</p></body>""",
    """<body><div class=post><p>M:Nothing here but a post.</p></div></body>""",
    """<body><article><h1>M:Links inside</h1><p>M:A line of text before the link.</p><p><a>M:The whole report</a></p><p>M:The last paragraph may follow a line that is a link from end to end, and it is text all the same.</p></article></body>""",
    """<body><main><p>M:Some text.</p><p><a>M:A linked line</a> <a>M:and one more</a></p><p>M:The end of it, in a few words.</p></main></body>""",
    """<body><p>M:A page without boxes, on which a long first paragraph tells what the rest of it is going to be about.</p><p><a>X:More of this</a></p><p>X:(c) me</p></body>""",
    """<p>M:A page may be one long paragraph and nothing else at all, with no box around it, no menu before it, no line behind it and no mark at its end""",
    """<body><div class="site has-sidebar"><header class=site-header><p>X:The post of the valley, each week.</p></header><div class="content-with-sidebar"><article class=post><header class=entry-header><h1>M:The mill turns</h1></header><div class=entry-content><p>M:The mill at the weir turns again, and flour comes from it for the first time in years.</p><p>M:Good flour.</p></div><footer class=entry-footer><p>X:Filed under mills and rivers of the valley.</p></footer></article></div><div class=sidebar><p>X:The valley has three mills and one of them is for sale this year.</p></div></div></body>""",
    """<body><div class=related-posts><h3>X:Read on</h3><article><h4><a>X:The weir breaks</a></h4><p>X:How the weir broke in the night of the great flood.</p></article></div><div class=article-body><p>M:Long before the mill there was a ford, and carts went through the river there at low water in the summer.</p><p>M:It is gone.</p></div></body>""",
    """<body><div>M:Another page is a long stretch of words in a plain box, which nobody has taken the trouble to name or to frame with anything""",
]


def train_tree(spark: SparkSession, labelled: list[str] = LABELLED, depth: int = 8) -> tuple:
    """The decision tree as nested (feature, threshold, left, right) with 0 or 1 at the leaves."""
    rows = [(1.0 if text.startswith("M") else 0.0, f) for page in labelled for text, f in blocks(page)]
    table = spark.createDataFrame(rows, "label double, f array<double>").coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, seed=1).fit(table.select("label", array_to_vector("f").alias("features")))

    def walk(node) -> tuple | int:
        if node.subtreeDepth() == 0:
            return int(node.prediction())
        split = node.split()
        return split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild())

    return walk(model._java_obj.rootNode())


def is_main(tree, features: list[float]) -> bool:
    while not isinstance(tree, int):
        feature, threshold, left, right = tree
        tree = left if features[feature] <= threshold else right
    return tree == 1


def main_text(page: str | None, tree) -> str:
    return "\n\n".join(text for text, f in blocks(page or "") if is_main(tree, f))


def extract_text(pages: DataFrame, tree=None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for each row of ``pages``."""
    tree = train_tree(pages.sparkSession) if tree is None else tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [main_text(page, tree) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    done = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "id long, url string, text string, n_chars long")
    return done.withColumnsRenamed({"id": id_col, "url": url_col})
