"""Main text of HTML pages: the maximum-scoring run of tokens, with weights learned from labelled pages.

1. A page becomes a row of tags and text pieces, each with its open elements. Contents of scripts, styles, controls and
   the like are no tokens.
2. Cues of a piece are its open elements' functions (nav, aside, form, ...), the words of their class, id and role, and
   whether it stands outside the page's article. Elements that hold the article, or nearly all prose of a page, are
   wrappers and give no cue. A logistic regression on labelled pages gives every cue a weight, of either sign, and so
   each word a score; every tag costs what labelled pages say of its kind.
3. Pieces whose words score negative are frame: a stretch of them collapses to one dear tag. In what is left, words are
   positive and tags negative; a linear scan finds the contiguous run with the largest sum, and all its words, block
   by block, are the text.

Labelled pages are put together from ``ARTICLES`` and ``FRAMES``, snippets of pages written for this module, whose label
is which list they stand in. Frames stand before, inside and after articles, so a cue is learned for both places; class
words that no article has also stand alone, so that each is learned.

Cases: null or empty html, or a page without words that score positive, gives an empty text; unclosed elements,
comments and tags end with the page; close tags of elements that are not open are passed over; of runs with equal sums
the first is taken; repeated rows give repeated results; time and memory grow in proportion to a page, however deep;
``extract`` keeps the rows' columns and adds ``text`` and ``n_chars`` (which replace columns of these names).
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)(.*)", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# fixed values: kinds of HTML element
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CUT = frozenset("script style template noscript iframe svg math object canvas audio video head title textarea select option button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FUNCTIONS = frozenset("nav header footer aside form dialog menu label fieldset".split())
BESIDE = frozenset("nav footer aside menu dialog".split())
GENERIC = frozenset("div section form center table tbody tr td span font fieldset".split())
#: An open element that one of the same name ends.
_ENDED = frozenset("p li dt dd tr td th".split())

#: Labelled snippets: the main text of a page; other snippets are put at each {}.
ARTICLES = (
    '<article><h1>A long walk</h1><p>We left the town at dawn and walked along the river for hours.</p>{}<p><b>Later</b> it rained.<br>Nobody minded, since <a href="/p">the path</a> was soft.</p></article>',
    '<main><h1>Bread at home</h1><p>Flour, water, salt and time are all that a loaf needs.</p><ul><li>Mix them well in the evening.</li><li>Bake in a hot oven next morning.</li></ul>{}<p>Let it cool before you cut it.</p></main>',
    '<div class="post content"><h2>Fixing a bicycle</h2><p>Turn it over so that it stands on its saddle and bars.</p><blockquote>A clean chain is a quiet chain.</blockquote>{}<p>Then take off the wheel, and look for the hole.</p></div>',
    '<p>This plain page has no article element at all, only paragraphs that follow each other.</p>{}<p>They are long enough to be told from the menu above and from what comes below.</p><h2>A heading</h2><p>And some more words of the same kind, with <a>a link</a> among them.</p>',
    '<article class="story"><header class="header"><h1>The old mill</h1></header><p>Its wheel has stood still for a hundred years and more.</p><table><tr><td>Height</td><td>nine metres</td></tr></table>{}<figure><figcaption>The mill in winter</figcaption></figure><p>Children still play there.</p></article>',
    '<div class="entry text"><h1>Trams</h1><p>The first line opened with horses, and later came wires.</p><ol><li>Buy a ticket from the driver.</li><li>Stamp it at once.</li></ol>{}<pre>line one  north\nline two  south</pre></div>',
    '<main id="main" role="main"><article class="article body"><header class="entry header banner"><h1>Sheep</h1></header><div class="entry content">There are more of them than of us, and they know it.<div>They stand in the road and look at cars.</div></div>{}<p>They were here before the road.</p></article></main>',
    '<article id="post"><div class="body text"><p>Rain.</p><p>It fell on roofs and roads alike, and the gutters sang with it all night long.</p></div>{}<ul><li><a>A list of links</a></li><li><a>that belong to the story</a></li></ul><p>It stopped.</p></article>',
    '<div id="content" class="main article"><h1>Of bees</h1><div>A hive hums in two keys, one for the day and one for the night.</div>{}<h3>Queens</h3><dl><dt>Age</dt><dd>three years or four</dd></dl></div>',
    '<article class="post type entry"><h1>A <em>small</em> harbour</h1><section class="section"><h2>Boats</h2><p>Nine of them.</p></section>{}<section><h2>Gulls</h2><p>Nobody has ever counted these, and nobody will.</p></section></article>',
)
#: Labelled snippets: what stands around the main text.
FRAMES = (
    '<nav><ul><li><a href="/a">Home</a></li><li><a>News</a></li><li><a>About us</a></li></ul></nav>',
    '<nav class="navbar navigation" role="navigation"><a>Start</a> <span>Shop now</span></nav>',
    '<div id="menu" class="nav menu"><a>One</a><a>Two</a><span>Three words more</span></div>',
    '<div class="menu nav"><ul><li><a>All pages</a></li></ul></div><menu><li>Open the list</li></menu>',
    '<ul class="breadcrumb breadcrumbs"><li><a>Top</a></li><li>Cities and towns</li></ul>',
    '<div class="skip toolbar topbar"><a>Up</a> Go to the start of this page</div>',
    '<div class="pagination pager"><a>1</a><a>2</a> of ten pages</div>',
    '<div class="navigation">Previous story and next story</div>',
    '<footer>Copyright the walkers and their club of this valley</footer>',
    '<footer class="footer" role="contentinfo"><p>Terms and privacy of the daily paper</p></footer>',
    '<div id="footer" class="footer contentinfo">Contact and imprint of the site</div>',
    '<div class="legal copyright disclaimer">No part may be copied or sold again</div>',
    '<aside><p>Visit our partner for cheap flights and rooms near you.</p></aside>',
    '<aside class="sidebar" role="complementary"><h3>Most read</h3><ul><li><a>First thing</a></li></ul></aside>',
    '<div id="sidebar" class="sidebar complementary"><p>Weather tomorrow will be dry with some wind.</p></div>',
    '<div class="widget"><h3>Archive</h3><p>Every month since the year of the flood</p></div>',
    '<div class="ad">Buy one get one free today only</div>',
    '<div class="ads adv advert"><p>Cheap shoes for every foot in town</p></div>',
    '<div class="advertisement banner"><p>The best phone of the year is here</p></div>',
    '<div class="ad content">This lotion will change your skin</div><div id="ad">within a week</div>',
    '<section class="sponsored sponsor content"><p>Our friends the bakers have a word for you.</p></section>',
    '<div class="promo promotion banner">Sale ends at midnight so hurry up</div>',
    '<div class="cookie notice"><p>We use cookies to make this site better for you.</p></div>',
    '<div class="cookies consent banner" role="dialog">You may say yes or no to each of them</div>',
    '<div class="alert notice" role="alert">Our shop is closed on Monday because of works.</div>',
    '<dialog><p>Wait, before you go, read our other stories too.</p></dialog>',
    '<div class="popup modal dialog"><p>Stay with us for a little while</p></div>',
    '<form class="search"><label>Find</label> in this site <input></form>',
    '<form class="login signup register"><fieldset>Name and password please</fieldset></form>',
    '<form><p>Write your question here and we will answer soon</p><label>Your name</label></form>',
    '<div class="search form">Look for words in all our pages</div>',
    '<div class="login signup">Sign in or become one of us</div>',
    '<div class="newsletter subscribe"><p>Subscribe to our letter and never miss a ride.</p></div>',
    '<section id="newsletter">News of the week in your post box</section>',
    '<section class="comments" id="comments"><h3>What readers said</h3><p>I tried this and liked it a lot, thank you.</p><p>Mine was flat.</p></section>',
    '<div class="comment"><p>My grandfather worked there when he was young.</p></div>',
    '<div class="comment body content"><p>Where is that place, does anybody know?</p></div>',
    '<ol class="comments"><li class="comment"><article class="comment body"><p>So true, and so well said.</p></article></li></ol>',
    '<div class="replies discussion disqus"><p>Which line goes to the harbour now?</p></div>',
    '<div id="respond" class="reply respond form"><p>Leave a reply under your own name</p></div>',
    '<div class="related"><h4>See also</h4><a>Pumps for everyone</a><p>and more about pumps</p></div>',
    '<div class="related recommended teaser"><p>Ten best bells for your bicycle</p></div>',
    '<section class="teaser recommended content"><article class="teaser"><p>Snow is on its way to us</p></article></section>',
    '<div class="share social sharing"><a>Like</a><span>Send this to a friend</span></div>',
    '<div class="social">Follow us on every network</div>',
)
#: The same, where it may only stand outside an article: there, such words are part of it.
MASTS = (
    '<header><a>Daily paper</a> since the year of the comet</header>',
    '<header role="banner" class="header"><h2>Site of names</h2></header>',
    '<div class="masthead header banner">The weekly letter of the valley</div>',
    '<div id="header"><p>All that is fit to read in the hills</p></div>',
    '<div>Words without a class that stand by themselves</div>',
    '<p>Some words that stand around it on every page.</p>',
    '<div class="text">A box of words of no use to a reader</div>',
    '<ul><li>An entry of some list</li></ul>',
)
_IN, _OUT = "<!--in-->", "<!--out-->"


def single_words() -> list[str]:
    """Every frame with one class word at a time, for the words that no article has."""
    taken = {w for a in ARTICLES for m in _ATTRIBUTE.finditer(a) for w in _NAME.findall(m[1])}
    return [re.sub(r'class="[^"]*"', f'class="{w}"', f, count=1) for f in FRAMES if (m := re.match(r'<(?:div|section|ul)[^>]*?class="([^"]*)"', f)) for w in m[1].split() if w not in taken]


def labelled_pages() -> Iterator[str]:
    """Pages whose main text stands between marks: every frame before, inside and after every article, with others
    around."""
    alone = single_words()
    for i, article in enumerate(ARTICLES):
        for j, frame in enumerate(alone):
            if (i + j) % 2:
                yield f"{frame}{_IN}{article.format(_OUT + frame + _IN)}{_OUT}{frame}"
        own = "<article" in article or "<main" in article
        for j, frame in enumerate(FRAMES):
            before, after = FRAMES[(3 * j + i + 1) % len(FRAMES)], FRAMES[(7 * j + i + 5) % len(FRAMES)]
            mast = MASTS[(i + j) % (8 if own else 4)]
            inside = article.format(_OUT + frame + _IN)
            yield f"<html><body>{mast}{before}{_IN}{inside}{_OUT}{frame}{after}</body></html>"
            yield f"<body>{frame}{mast}{_IN}{article.format('')}{_OUT}{after}{mast if own else ''}"


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """('open' | 'close' | 'text' | 'mark', name, rest) of a page; contents of raw elements are left out."""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        token, at = m[0], m.end()
        if token[0] != "<" or len(token) == 1:
            yield "text", "", token
        elif token[1] in "!?":
            if token in (_IN, _OUT):
                yield "mark", token, ""
        elif token[-1] == ">":
            name, rest = _TAG.match(token).groups()
            name = name.lower()
            if token[1] == "/":
                yield "close", name, ""
                continue
            yield "open", name, rest
            if name in RAW and not rest.rstrip(">").endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = close.start() if close else end


_NONE: frozenset[str] = frozenset()


class Page:
    """Tokens of a page, (text or tag name, element it stands in, words, label), and its elements, parents first.

    A tag token has -1 words."""

    def __init__(self, page: str):
        self.names, self.parents, self.words = [""], [0], [_NONE]
        self.tokens: list[tuple[str, int, int, bool]] = []
        cut, stack, opened, labelled = [False], [0], Counter(), False
        names = self.names

        def pop() -> None:
            opened[names[stack.pop()]] -= 1

        for kind, name, rest in scan(page):
            at = stack[-1]
            if kind == "text":
                if not cut[at]:
                    self.tokens.append((rest, at, len(rest.split()), labelled))
            elif kind == "open":
                while opened["head"] and (name == "body" or name in BLOCK):
                    pop()  # a head that was not closed
                if names[stack[-1]] == "p" and name in BLOCK or names[stack[-1]] == name and name in _ENDED:
                    pop()
                at = stack[-1]
                if not cut[at] and name not in CUT:
                    self.tokens.append((name, at, -1, labelled))
                if name in VOID or rest.rstrip(">").endswith("/") and name in CUT:
                    continue
                stack.append(len(names))
                opened[name] += 1
                names.append(name)
                self.parents.append(at)
                self.words.append(frozenset(w.lower() for m in _ATTRIBUTE.finditer(rest) for w in _NAME.findall(m[1] or m[2] or m[3] or "")) if "=" in rest else _NONE)
                cut.append(cut[at] or name in CUT)
            elif kind == "close":
                if opened[name]:
                    while names[stack[-1]] != name:
                        pop()
                    gone = stack[-1]
                    pop()
                    if not cut[gone]:
                        self.tokens.append((name, stack[-1], -1, labelled))
            else:
                labelled = name == _IN

    def cues(self, weight: dict[str, float]) -> list[frozenset[str]]:
        """The cues of every element; words that have no weight are left out where there are weights."""
        names, parents, n = self.names, self.parents, len(self.names)
        block, linked, beside = [0] * n, [False] * n, [False] * n
        for e in range(1, n):
            p = parents[e]
            block[e] = e if names[e] in BLOCK else block[p]
            linked[e] = linked[p] or names[e] == "a"
            beside[e] = beside[p] or names[e] in BESIDE
        prose, titles, mains_in, own, own_linked = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        for _, e, words, _ in self.tokens:
            if words > 0:
                own[block[e]] += words
                if linked[e]:
                    own_linked[block[e]] += words
                elif not beside[e]:
                    prose[e] += words
        for e in range(n - 1, 0, -1):
            titles[e] += names[e] == "h1"
            prose[parents[e]] += prose[e]
            titles[parents[e]] += titles[e]

        def is_main(e: int) -> bool:
            if names[e] not in ("article", "main") and not (names[e] in GENERIC and "main" in self.words[e] and "role" in weight):
                return False
            return titles[e] > 0 or 2 * prose[e] >= prose[0] or sum(weight.get(w, 0.0) for w in self.words[e]) >= 0

        mains = [e for e in range(1, n) if prose[e] and is_main(e)]
        central = max(mains, key=lambda e: (prose[e], -e), default=0)
        for e in mains:
            mains_in[e] = 1
        for e in range(n - 1, 0, -1):
            mains_in[parents[e]] += mains_in[e]
        wrapper = [False] * n
        if central:
            e = central
            while e:
                wrapper[e] = True
                e = parents[e]
        for e in range(1, n):
            if names[e] in ("html", "body"):
                wrapper[e] = True
            elif central and wrapper[parents[e]] and (names[e] not in FUNCTIONS or names[e] == "form"):
                wrapper[e] |= 10 * prose[e] >= 9 * prose[central] and mains_in[e] >= mains_in[central] - 1 or names[e] == "article" and (titles[e] > 0 or 2 * prose[e] >= prose[central])
            elif names[e] in GENERIC and prose[e]:
                wrapper[e] |= 10 * prose[e] >= 9 * prose[0] or titles[e] > 0 and 2 * prose[e] >= prose[0]
        inside, found, own_main = [False] * n, [_NONE] * n, set(mains)
        outside = frozenset(["outside main"]) if central else _NONE
        for e in range(n):
            p = parents[e]
            inside[e] = e > 0 and inside[p] or e in own_main
            if e == 0:
                found[e] = outside
                continue
            now = found[p]
            if e in own_main:
                now = now - outside | {"main"}
            if not wrapper[e]:
                where = "main " if inside[e] else ""
                more = {where + w for w in self.words[e]}
                if names[e] in FUNCTIONS:
                    more.add(f"{where}<{names[e]}>")
                if weight:
                    more = {w for w in more if w in weight}
                now = now | more if more else now
            found[e] = now
        links = {True: frozenset(["main <a>"]), False: frozenset(["<a>"])}
        return [c | links[inside[e]] if own[block[e]] and own[block[e]] == own_linked[block[e]] and names[block[e]] not in HEADINGS else c for e, c in enumerate(found)]


class Weights(NamedTuple):
    cue: dict[str, float]
    word: float
    tag: dict[str, float]
    frame: float  # of a stretch of frame


@lru_cache(maxsize=1)
def learned() -> Weights:
    """Logistic regression of words on cues (the weights of tags are how seldom they stand in the main text)."""
    rows, tag_in, tag_all = Counter(), Counter(), Counter()
    for text in labelled_pages():
        page = Page(text)
        cues = page.cues({})
        for what, e, words, label in page.tokens:
            if words > 0:
                rows[cues[e], label] += words
            elif words < 0:
                tag_all[what] += 1
                tag_in[what] += label
    names = sorted(set().union(*(r[0] for r in rows)))
    place = {c: i for i, c in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, (seen, _) in enumerate(rows):
        x[i, [place[c] for c in seen]] = 1
    y, n = np.array([label for _, label in rows], float), np.array(list(rows.values()), float)
    n /= n.sum()
    ridge = np.append(np.full(len(names), 1e-5), 0.0)
    w = np.zeros(len(names) + 1)
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ ((n * (p * (1 - p) + 1e-9))[:, None] * x) + np.diag(ridge + 1e-12), x.T @ (n * (y - p)) - ridge * w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    tags = {t: -0.02 - 0.3 * (1 - (tag_in[t] + 1) / (n_ + 2)) for t, n_ in tag_all.items()}
    return Weights(dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]), tags, -0.3)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run with the largest positive sum, the first of equal ones; (0, 0) without any."""
    best = total = 0.0
    first = begin = end = 0
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, first, end = total, begin, i + 1
    return first, end


def scored_tokens(page: str, weights: Weights) -> list[tuple[str, float, bool, bool]]:
    """(text or tag name, score, is text, ends a block): frame is collapsed, so that text is positive and tags negative."""
    parsed = Page(page)
    of_element = [weights.word + sum(weights.cue.get(c, 0.0) for c in sorted(cues)) for cues in parsed.cues(weights.cue)]
    out: list[tuple[str, float, bool, bool]] = []
    in_frame = False
    for what, e, words, _ in parsed.tokens:
        keep = of_element[e] > 0
        if words >= 0:
            if keep:
                in_frame = in_frame and not words
                out.append((what, of_element[e] * words, True, False))
            elif words and not in_frame:
                in_frame = True
                out.append(("", weights.frame, False, False))
        else:
            out.append((what, weights.tag.get(what, -0.1) if keep else 0.0, False, what in BLOCK))
    return out


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """The main text of a page, blocks joined by one line feed."""
    if not page:
        return ""
    tokens = scored_tokens(page, weights or learned())
    first, end = best_run([t[1] for t in tokens])
    blocks: list[str] = []
    own: list[str] = []
    for what, _, is_text, edge in [*tokens[first:end], ("", 0.0, False, True)]:
        if is_text:
            own.append(entities.unescape(what) if "&" in what else what)
        elif edge:
            if own:
                blocks.append(" ".join("".join(own).split()))
            own = []
        elif what == "br":
            own.append(" ")
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text and n_chars."""
    weights = learned()

    @F.pandas_udf("string")
    def run(page: pd.Series) -> pd.Series:
        return page.map(lambda x: main_text(x, weights), na_action=None).astype(object)

    return pages.withColumn("text", run(F.coalesce(F.col(column), F.lit("")))).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_best_region_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    bounded_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
