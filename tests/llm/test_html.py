"""Main text of pages: the labelled table and its tree, page shapes, odd markup, long pages and odd columns."""

from __future__ import annotations

import time

import numpy as np
import pytest

from strata.llm import html_extract as H
from strata.plans.session import ship

LONG = "The council met on Tuesday evening to discuss the plans for the new bridge, which engineers expect to take three years to build."


@pytest.fixture(scope="module")
def tree():
    return H.fit_tree(*H.training_rows())


def test_the_labelled_table_and_held_out_pages(tree):
    x, y = H.training_rows()
    assert len(y) > 700 and 0.3 < y.mean() < 0.8
    unnamed = [m for m, _ in H.labelled_pages() if "article" not in m and "<main" not in m and "content" not in m]
    assert len(unnamed) >= len(H.labelled_pages()) // 2
    assert H.used_features(tree) & H.NEIGHBOURS
    held_x, held_y = H.training_rows(10, 99)
    found = (H.classify(tree, held_x) == held_y).mean()
    blind = held_x.copy()
    blind[:, sorted(H.NEIGHBOURS)] = 0
    print(found, (H.classify(tree, blind) == held_y).mean())
    assert found > 0.95 and (H.classify(tree, blind) == held_y).mean() < found


def test_pages_that_name_nothing(tree):
    page = f"<body><div><div><a href=/>Home</a></div><div><a href=/n>News</a></div></div><div><h1>Bridge plans</h1><p>{LONG}</p><p>No.</p><p>{LONG}</p><p>{LONG} <a href=/m>More</a></p></div><div>Contact</div><div>Terms of use</div><div><a href=/1>One</a> <a href=/2>Two</a></div>"
    assert H.main_text(page, tree) == f"Bridge plans\n{LONG}\nNo.\n{LONG}\n{LONG} More"


@pytest.mark.parametrize("wrap", ["<article class='overflow-hidden'>{}</article>", "<div class='layout has-sidebar'><article>{}</article></div>", "<article><header class='entry-header'>{}</header></article>", "<article title=it's>{}</article>", "<article data-x='a>b'>{}</article>"])
def test_articles_are_kept(tree, wrap):
    story = f"<h1>Bridge plans</h1><p>{LONG}</p>"
    assert H.main_text("<body>" + wrap.format(story), tree) == f"Bridge plans\n{LONG}"


@pytest.mark.parametrize("page", ['<a "' * 40_000, "<a '>" * 40_000, "<div>" * 40_000 + "</span>" * 40_000, "<p>" * 80_000, "<!--" * 40_000, "<script" * 40_000, "<a b=\"" * 40_000, "<" * 200_000, "<td><div>" * 30_000 + "</td>" * 30_000, "<a =" + " " * 200_000])
def test_long_odd_pages_take_linear_time(tree, page):
    start = time.process_time()
    H.main_text(page, tree)
    assert time.process_time() - start < 3


def test_rows_columns_and_empty_tables(spark):
    ship(spark)
    rows = [(1, f"<article><p>{LONG}&nbsp; x</article>", "old"), (1, f"<article><p>{LONG}&nbsp; x</article>", "old"), (None, None, None), (2, "", "t"), (3, "<article><p>" + "word " * 300_000, None)]
    pages = spark.createDataFrame(rows, "id long, html string, text string").selectExpr("id as `page.id`", "html", "text", "1 as row", "2 as none")
    out = H.extract_text(pages)
    assert out.columns == ["page.id", "row", "none", "text"]
    got = sorted(((r["page.id"] or 0), r.row, len(r.text)) for r in out.collect())
    assert got == [(0, 1, 0), (1, 1, len(LONG) + 2), (1, 1, len(LONG) + 2), (2, 1, 0), (3, 1, 1_499_999)]
    assert H.extract_text(pages.limit(0)).count() == 0
    only = (np.array([[1.0] * 10, [0.0] * 10]), np.array([0, 0]))
    assert {r.text for r in H.extract_text(pages, training=only).collect()} == {""}
