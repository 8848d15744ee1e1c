"""Main text of pages: the scan against brute force, wrappers, frames inside articles, depth, and odd rows."""

import random
import re
import time

import pyarrow.parquet as pq
import pytest

from fathomry.llm import main_text as M

ARTICLE = "<article><h1>T</h1><p>One two three four five.</p><p>Six seven.</p></article>"
WHOLE = "T\nOne two three four five.\nSix seven."


def test_scan_finds_what_brute_force_finds():
    draw = random.Random(7)
    for n in (0, 1, 2, 3, 8, 30):
        for _ in range(60):
            scores = [float(draw.randint(-4, 4)) for _ in range(n)]
            best, first, end = 0.0, 0, 0
            for i in range(n):
                for j in range(i + 1, n + 1):
                    if sum(scores[i:j]) > best:
                        best, first, end = sum(scores[i:j]), i, j
            a, b = M.best_run(scores)
            assert sum(scores[a:b]) == best and (b > a) == (best > 0)
            if best:  # no run with that sum ends earlier
                assert b == min(j for j in range(n + 1) for i in range(j) if sum(scores[i:j]) == best)


def test_text_is_the_words_of_the_best_run():
    for row in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()[:40]:
        tokens = M.scored_tokens(row["html"], M.learned())
        scores = [t[1] for t in tokens]
        sums = [0.0]
        for s in scores:
            sums.append(sums[-1] + s)
        best, low, span = 0.0, 0, (0, 0)
        for j in range(1, len(sums)):
            if sums[j] - sums[low] > best + 1e-12:
                best, span = sums[j] - sums[low], (low, j)
            if sums[j] < sums[low]:
                low = j
        import html

        words = html.unescape(" ".join(t[0] if t[2] else " " for t in tokens[span[0] : span[1]] if t[2] or t[3] or t[0] == "br")).split()
        assert M.main_text(row["html"]).split() == words


def test_articles_of_the_table_are_found():
    import html

    for row in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        inner = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
        assert M.main_text(row["html"]) == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


@pytest.mark.parametrize(
    "page",
    [
        f'<form id="aspnetForm">{ARTICLE}</form>',
        f'<body class="has-sidebar search-page">{ARTICLE}',
        f'<body class="has-sidebar"><div class="page with-sidebar">{ARTICLE}</div><aside>Most read today</aside>',
        f"<main class='no-sidebar'>{ARTICLE.replace('<article>', '<article class=tag-newsletter>')}<section class='comments'><p>{'so true ' * 90}</p></section></main>",
        ARTICLE.replace("<article>", '<body class="has-sidebar"><div>').replace("</article>", "</div>"),
        ARTICLE.replace("<article>", '<div class="has-sidebar"><nav><a>Home</a></nav><div class="content">').replace("</article>", "</div></div>"),
        f"<head><title>x</title><body>{ARTICLE}",
        ARTICLE.replace("<p>Six", '<div class="ad-slot">Buy</div><aside>Side</aside><form><label>Mail</label><button>Go</button></form><p>Six'),
        f'<header class="site-header"><h2>Daily</h2></header><div class="cookie-banner">We use cookies</div>{ARTICLE}<div id="disqus">Mine was flat</div>',
    ],
)
def test_wrappers_do_not_empty_the_text(page):
    assert M.main_text(page) == WHOLE


def test_frame_inside_and_references():
    page = '<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a>x</a></nav><div class="cookie-notice">We use cookies</div><article><h1>T</h1><div class="ad">Buy this thing now and many others today</div><p>One &lt;b&gt;\n &amp; two.</p><form><label>Mail</label></form><aside class="sidebar">Side</aside><p>Two</p><section id="comments"><p>Great</p></section></article><footer>f</footer>'
    assert M.main_text(page) == "T\nOne <b> & two.\nTwo"
    cases = {None: "", "": "", "   ": "", "<p>x <b>y": "x y", "just text": "just text", "<script>if (a<b) {}</script>": "", "<nav><a>a</a></nav><footer>c d</footer>": "", "<p>a&<b>amp;</b>c</p>": "a&amp;c", "</p></b><p>x": "x", "<!-- open": "", "<p>a<!--": "a"}
    for page, text in cases.items():
        assert M.main_text(page) == text, page


def test_labelled_pages_are_learned():
    plain = lambda x: re.sub(r"<[^>]*>|\s", "", x)
    pages = list(M.labelled_pages())
    wrong = sum(plain("".join(re.findall(r"<!--in-->(.*?)<!--out-->", p, re.S))) != plain(M.main_text(p).replace("<", " ")) for p in pages)
    assert wrong == 0


@pytest.mark.parametrize("page", ["<div>" * 10_000 + "<p>deep</p>" + "</div>" * 10_000, "</b>" * 10_000 + "<div>" * 10_000 + "</i></b>" * 10_000 + "<p>deep</p>", "<b>" * 10_000 + "<p>deep</i></u></p>" * 5_000, '<div class="comment ad">' * 10_000 + "<p>deep"])
def test_depth_costs_no_more_than_length(page):
    M.learned()
    began = time.process_time()
    M.main_text(page)
    assert time.process_time() - began < 1.0


def test_very_long_page():
    page = ARTICLE.replace("Six", "word " * 1_000_000 + "Six")
    assert len(M.main_text(page)) == len(WHOLE) + 5_000_000


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, other string, text string"
    pages = spark.createDataFrame([(1, "u", "<p>a  b</p>", "old", "z"), (1, "u", "<p>a  b</p>", "old", "z"), (None, None, None, None, None)], schema)
    got = M.extract(pages).select("page_id", "other", "text", "n_chars").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "old", "a b", 3), (1, "old", "a b", 3), (None, None, "", 0)]
    assert M.extract(pages.filter("page_id > 9")).count() == 0
