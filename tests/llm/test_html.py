"""Main text of pages: the distribution decides, tags and names only help."""

from __future__ import annotations

import random
import re

import pytest

from assetlode.llm import op4_html

TEXT = "long text " * 30
BODY = TEXT.strip()


def test_article_is_a_hint():
    # text outside the mark that passes the same tests is kept, a short article beside it is not
    assert op4_html.blocks(f"<article><p>{BODY}</p></article><div><p>{BODY}</p></div>") == [BODY, BODY]
    assert op4_html.blocks(f"<article><p>Short teaser.</p></article><div><p>{BODY}</p></div>") == [BODY]
    assert op4_html.blocks(f"<main><div><p>{BODY}</p></div><article><p>Teaser</p></article></main>") == [BODY, "Teaser"]
    # the tags change nothing on a page whose regions dropped elements part
    page = f"<nav><a>x</a></nav><article><h1>T</h1><p>{BODY}</p><p>end</p></article><footer>f</footer>"
    assert op4_html.blocks(page) == op4_html.blocks(page.replace("article", "div")) == ["T", BODY, "end"]


def test_keeps_article_text():
    # what follows an advert inside the article stays, however short
    page = f"<body><nav>n</nav><div id=wrap><p>{BODY}</p><aside>advert</aside><p>The end.</p></div></body>"
    assert op4_html.blocks(page) == [BODY, "The end."]
    # one class word doesn't drop the element that holds the page's text
    assert op4_html.blocks(f"<p>Intro.</p><div class='widget share'><p>{BODY}</p><div class=ad>Buy</div></div>") == ["Intro.", BODY]
    # but long comments don't replace an article, and an advert isn't one
    assert op4_html.blocks(f"<div><p>{BODY}</p></div><div class=comments><p>{TEXT * 4}</p></div>") == [BODY]
    assert op4_html.blocks("<div class=ad>Buy this now, it is cheap.</div><div><p>Short one.</p></div>") == ["Short one."]
    # words in names drop containers only, and only whole names
    page = f"<article><p>{BODY}</p><p class='related'>The related work.</p><div class='social-history'>Social history.</div><p>end</p></article>"
    assert op4_html.blocks(page) == [BODY, "The related work.", "Social history.", "end"]


def test_unmarked_advert_stands_apart():
    page = f"<body><div>Buy this now.</div><div><h1>T</h1><p>{BODY}</p><div><p>Inner part.</p></div><p>end</p></div><div>Read more here.</div></body>"
    assert op4_html.blocks(page) == ["T", BODY, "Inner part.", "end"]


@pytest.mark.parametrize("name", ["object", "svg", "canvas", "audio", "video", "noscript", "aside", "nav", "form", "header", "section class=ad"])
def test_unclosed_elements_lose_nothing(name):
    assert op4_html.blocks(f"<div><p>{BODY}</p><{name}><p>rest</p></div>") == [BODY, "rest"]
    assert op4_html.blocks(f"<div><script>var a = 1; <p>{BODY}</p></div>") == [BODY]


def by_rule(weights, surge):
    """Lines of all runs: every window is looked at, no cursor."""
    n, w = len(weights), op4_html.WINDOW
    alive = [any(weights[i : i + w]) for i in range(n)]
    out = set()
    for i in range(n):
        if weights[i] and sum(weights[i : i + w]) > surge:
            back = i
            while back and weights[back - 1]:
                back -= 1
            on = i
            while on < n and alive[on]:
                on += 1
            out |= set(range(back, on))
    return out


def test_runs_equal_a_scan_of_all_windows():
    rng = random.Random(3)
    for _ in range(4000):
        weights = [rng.choice([0, 0, 0, 5, 20, 60, 200]) for _ in range(rng.randint(0, 30))]
        surge = rng.choice([-1, 10, 86, 150])
        found = op4_html.runs(weights, surge)
        assert {i for a, b in found for i in range(a, b)} == by_rule(weights, surge)


def test_distribution_alone_finds_the_article(monkeypatch):
    """Without article tags and without words in names, on the test pages."""
    pq = pytest.importorskip("pyarrow.parquet")
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    wanted = [op4_html.extract("<article>" + re.search(r"<article>(.*?)</article>", h, re.S)[1] + "</article>") for h in pages]
    assert [op4_html.extract(h) for h in pages] == wanted
    monkeypatch.setattr(op4_html, "MARKS", frozenset())
    plain = [op4_html.extract(h.replace("<article", "<div").replace("</article", "</div")) for h in pages]
    assert sum(a == b for a, b in zip(plain, wanted, strict=True)) >= 0.95 * len(pages)


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "u", f"<p>{BODY}</p>", "t", 5)] * 2 + [(1, "u", None, "t", 5), (2, None, "<p>" * 20_000 + "x", "t", 5)]
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in op4_html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect() if r.page_id == 1)
    assert got == [(1, "u", "", 0), (1, "u", BODY, len(BODY)), (1, "u", BODY, len(BODY))]
    assert op4_html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
