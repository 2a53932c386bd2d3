"""That the clusters of ratios decide what is taken, on pages with and without telling marks."""

from __future__ import annotations

import random
import re

import brute
import numpy as np
import pytest
from oracle import DATA

from quarrion.llm import html_extraction as H


def whole(ratios, chars, nodes, names, parent):
    """What chosen would be if the clusters decided nothing."""
    return (ratios > 0).tolist()


def stripped(html: str) -> str:
    """A page whose menu, footer and adverts are blocks without names, and whose article isn't marked."""
    html = re.sub("</?article>", "", html)
    html = re.sub("<(/?)(?:nav|footer|aside)\\b[^>]*>", r"<\1div>", html)
    return re.sub('<div class="[^"]*">', "<div>", html)


def test_clusters_decide_on_a_table_of_pages(spark, monkeypatch):
    """Nothing of an article is lost without marks, most of the rest is left out; taking all lines gives none of the pages right."""
    rows = [r.html for r in spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/pages.parquet").select("html").collect()]
    want = [brute.op9(h).split("\n\n") for h in rows]
    got = [H.main_text(stripped(h)).split("\n\n") for h in rows]
    assert all(set(w) <= set(g) for w, g in zip(want, got, strict=True))
    monkeypatch.setattr(H, "chosen", whole)
    every = [H.main_text(stripped(h)).split("\n\n") for h in rows]
    assert not any(e == w for e, w in zip(every, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) > 0.6 * len(rows)
    assert 2 * sum(len(g) - len(w) for g, w in zip(got, want, strict=True)) < sum(len(e) - len(w) for e, w in zip(every, want, strict=True))


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def shaped(seed: int) -> tuple[str, list[str]]:
    """An unmarked page of one of several shapes, and the lines of its article."""
    rng = random.Random(seed)
    bit = lambda: f"<div>{words(rng, rng.randint(1, 3))}</div>"
    paragraphs = [words(rng, rng.randint(30, 90)) for _ in range(rng.randint(3, 9))]
    head = words(rng, 4)
    bodies = {
        0: "".join(f"<p>{p}</p>" for p in paragraphs),
        1: f"<div id=x>{''.join(f'<div>{p}</div>' for p in paragraphs)}</div>",
        2: f"<table><tr><td>{'</td></tr><tr><td>'.join(paragraphs)}</td></tr></table>",
        3: f"<section><p>{'</p>' + bit() + '<p>'.join(paragraphs)}</p></section>",
        4: f"<div><blockquote>{'</blockquote><blockquote>'.join(paragraphs)}</blockquote></div>",
    }
    menu = "".join(bit() for _ in range(rng.randint(1, 5)))
    body = bodies[seed % 5]
    if seed % 5 == 3:
        body = "<section>" + bit().join(f"<p>{p}</p>" for p in paragraphs) + "</section>"
    links = "".join(f"<li><a href=/{i}>{words(rng, 1)}</a></li>" for i in range(5))
    page = f"<html><body>{menu}<ul>{links}</ul><h1>{head}</h1>{body}{bit()}<div>{words(rng, 2)} <a>x</a></div></body></html>"
    return page, [head, *paragraphs]


@pytest.mark.parametrize("shape", range(5))
def test_pages_of_other_shapes(monkeypatch, shape):
    """Menus, adverts between paragraphs and footers without names are left out of articles of several builds."""
    pages = [shaped(seed) for seed in range(shape, 200, 5)]
    for page, want in pages:
        got = H.main_text(page).split("\n\n")
        assert [g for g in got if g in want] == want or got == want[1:], page
        assert got in (want, want[1:]), page
    monkeypatch.setattr(H, "chosen", whole)
    assert not any(H.main_text(page).split("\n\n") == want for page, want in pages)


def test_names_that_begin_or_end_with_a_telling_word():
    for name in ("user-comments", "ad-300x250", "newsletter-cta", "top_ads", "comments-area", "cookie-banner"):
        page = f"<article><p>First paragraph.</p><div class='{name}'><p>Away.</p></div><p>Last paragraph.</p></article>"
        assert H.main_text(page) == "First paragraph.\n\nLast paragraph.", name
    for name in ("adventure", "commentary", "promoter", "share-price", "salad-dressing"):
        page = f"<article><p>First paragraph.</p><section class='{name}'><p>Stays here.</p></section><p>Last paragraph.</p></article>"
        assert H.main_text(page) == "First paragraph.\n\nStays here.\n\nLast paragraph.", name


def test_a_paragraph_that_is_one_link_stays():
    long_ = "words of the main text " * 12
    page = f"<body><div><a>Home</a> <a>News</a></div><p>{long_}</p><p><a href='/x'>One linked paragraph of the text</a></p><p>{long_}</p></body>"
    assert H.main_text(page).split("\n\n") == [long_.strip(), "One linked paragraph of the text", long_.strip()]


def test_growth_ends_after_a_gap():
    """Short blocks inside the article's element are passed over, up to GAP in a row; a paragraph behind more of them isn't reached."""
    long_ = "words of the main text " * 12
    for n in range(1, 9):
        page = f"<body><div id=a><p>{long_}</p><p>{long_}</p>{'<div>bit</div>' * n}<p>End.</p></div></body>"
        got = H.main_text(page).split("\n\n")
        assert got == [long_.strip()] * 2 + ["End."] * (n <= H.GAP)


def test_cut_ratios():
    ratios, chars = np.array([0.0, 10, 300, 20000, 300]), np.array([50, 10, 300, 20000, 300])
    assert H.cut_ratios(ratios, chars).tolist() == [0, 10, 300, 20000, 300]
    ratios, chars = np.array([0.0] + [300] * 40 + [20000]), np.array([9] + [300] * 40 + [20000])
    assert H.cut_ratios(ratios, chars).max() == 300
