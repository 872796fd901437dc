"""Pages that are broken on purpose: text is kept, and time grows with the length only."""

from __future__ import annotations

import time

import pytest

from tidemark.llm import html_text
from tidemark.llm.html_blocks import blocks


def texts(page):
    return [b.text for b in blocks(page)]


def test_quotes():
    assert html_text.main_text("<article><p title=it's>one two three.</p><p>four isn't five.</p></article>") == "one two three.\n\nfour isn't five."
    assert texts("<p class='a\"b'>x</p><p title=\"it's >\">y</p>") == ["x", "y"]
    assert texts('<p title="never closed>x</p><p>y</p>') == ["x", "y"]
    assert texts("<p 'a'=\"b>c\" d = e/f>x</p><p =x>y</p><p a=>z</p>") == ["x", "y", "z"]
    assert texts('<div data-class="menu" class=post>x</div>') == ["x"]
    assert html_text.main_text('<article><p data-class="menu">Kept as it is.</p></article>') == "Kept as it is."


def test_broken_tags():
    assert texts("a < b <i> <3 & </ bogus> </> d") == ["a < b <3 & d"]
    assert texts("<p>x<p>y<div class='") == ["x", "y"]
    assert texts("<div><p>x</span></p></section>y</div></p>z") == ["x", "y", "z"]
    assert texts("<!doctype html><p>x<!-- y -->z<?php 1 ?></p><!x") == ["xz"]
    assert texts("<li>a<li>b<ul><li>c</ul><td>d<tr>e") == ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize(
    "unit,tail",
    [('<a "', ""), ("<a b='", ""), ('<a b="', ""), ("<!x", ""), ("<a ", ""), ("<b>x", ""), ("<div>", "</p>" * 100_000), ("<div>x</p></p>", ""), ("</b x='", ""), ("<a href=\"'", ""), ("<p a=' b=\"", "'>x"), ("<script>", ""), ("x &amp", "")],
)
def test_hostile_pages(unit, tail):
    page = unit * (1_000_000 // len(unit)) + tail
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 10


LONG = "This sentence of the article says what it has to say at some length."
#: Pages without names that tell content apart, and the blocks of their article.
LABELLED = [
    (f"<div><a href=/>Home</a> <a href=/n>News</a></div><div><p>{LONG}</p><p>Yes</p><p>{LONG}</p></div>", [LONG, "Yes", LONG]),
    (f"<table><tr><td><a href=/a>one</a><td><a href=/b>two</a></table><div><h2>Why</h2><p>{LONG}</p><p>no</p><p>{LONG}</p><div>ok</div></div>", ["Why", LONG, "no", LONG, "ok"]),
    (f"<div><ul><li><a href=/1>First</a><li>or<li><a href=/2>Second</a></ul></div><div><p>{LONG}</p><p>Because</p></div>", [LONG, "Because"]),
]


@pytest.mark.parametrize("page,want", LABELLED)
def test_cut_decides_without_markup(page, want):
    """Short blocks go with their neighbours: the cut is right where the cost of a block alone is not."""
    found = blocks(page)
    alone = [b.text for b in found if html_text.cost(b, False) > 0]
    assert html_text.main_text(page).split("\n\n") == want and alone != want
