"""Attributes of pages: read by name, whatever stands in other ones; and the decoding against enumeration."""

import itertools
import random

import numpy as np
import pytest

from stepweave.llm import html_text

PROSE = "The first part of a story, told at length and with many words. It goes on for a while, then it ends."


@pytest.fixture(scope="module")
def model(spark):
    return html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def texts(spark, model, pages):
    rows = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html_text.extracted(rows, model).orderBy("page_id").collect()]


def test_attributes_that_hold_other_ones(spark, model):
    lines = [
        ("<p>See <a href='/x?id=nav&class=ad&id=sidebar'>this page here</a> for more.</p>", "See this page here for more."),
        ("<p data-id='sidebar' data-class='ad banner'>Second words of the story, with a comma.</p>", "Second words of the story, with a comma."),
        ("<p title=don't>Third words here, isn't it.</p>", "Third words here, isn't it."),
        ("<p title='a > b' data-x=\"<footer class='ad'>\">Fourth words, at last.</p>", "Fourth words, at last."),
        ("<p title=\"x\"class=\"text\"id=a>Fifth words, as well.</p>", "Fifth words, as well."),
        ("<p data-role=navigation aria-label=\"class=comment\" onclick='id=\"ad\"'>Sixth words, so far.</p>", "Sixth words, so far."),
        ("<p = =class a= b>Seventh words, for now.</p>", "Seventh words, for now."),
        ("<img alt='a > b' src=x/><p>Eighth words, once more.</p>", "Eighth words, once more."),
    ]
    for start, end in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>")):
        pages = [f"<html><body><nav class='menu'><a href='/'>Home</a></nav>{start}<p>{PROSE}</p>{h}<p>{PROSE}</p>{end}<footer class='footer'><p>Rights</p></footer></body></html>" for h, _ in lines]
        assert texts(spark, model, pages) == [f"{PROSE}\n{want}\n{PROSE}" for _, want in lines]


def test_labels_come_from_made_pages_alone(spark, model):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for label in ("0", "1", "x"):
        marked = [h.replace("<footer", f'<footer data-y="{label}"').replace("<article", f"<article data-y='{label}'").replace("<p", f"<p DATA-Y={label}") for h in pages]
        assert texts(spark, model, marked) == texts(spark, model, pages)
    name = html_text.free_mark("<p data-y=1 Data-YY>")
    assert name == "data-yyy" and all(f"{name}=" in v for v in html_text.variants(f"<p data-y=1 Data-YY></p><article><p>{PROSE}</p></article>", random.Random(1))[1:6])


def test_other_attributes_change_nothing(spark, model):
    rng = random.Random(2)
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(60).collect()]
    said = ["data-id='sidebar'", 'data-class="ad banner"', "title=don't", "style='class=ad'", "aria-label=\"id=nav > role=menu\"", "href=/x?class=comment&id=ad", "hidden", "x-role = 'navigation'", "onclick='a > b'"]

    def dressed(page):
        p, out, at = html_text._TOKEN, [], 0
        for m in p.finditer(page):
            if m[2] and not m[1]:
                out += [page[at : m.end(2)], " " + " ".join(rng.sample(said, rng.randint(0, 4)))]
                at = m.end(2)
        return "".join([*out, page[at:]])

    assert texts(spark, model, [dressed(h) for h in pages]) == texts(spark, model, pages)


def test_decoding_is_the_best_of_all_consistent_choices():
    rng = np.random.default_rng(3)
    for _ in range(200):
        page = html_text.Page("")
        for _ in range(int(rng.integers(1, 9))):
            at = page._add("div", int(rng.integers(0, len(page.tag))), 0, 0, -1)
            page.own[at] = int(rng.integers(0, 90))
        n = len(page.tag)
        logit = rng.normal(size=n)
        worth = logit * (1 + np.log1p(page.own))
        total = lambda kept: sum(w if k else -w for w, k in zip(worth, kept))
        best = max(total((True, *c)) for c in itertools.product((True, False), repeat=n - 1) if all(not k or u <= 0 or c[u - 1] for k, u in zip(c, page.parent[1:])))
        got = page.keep(logit)
        assert got[0] and all(not got[v] or got[page.parent[v]] for v in range(1, n))
        assert abs(total(got) - best) < 1e-9


def test_broken_markup_takes_time_in_proportion():
    import time

    began = time.perf_counter()
    for bad in ("<a b='x>' " * 60_000, "<a " * 200_000, '<p title="' * 100_000, "<" * 300_000, "<a b=" * 100_000 + ">"):
        html_text.Page(bad)
    assert time.perf_counter() - began < 20
