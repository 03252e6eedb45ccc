"""What class names and ids leave out of main text, and what they don't."""

import pytest

from kymo.llm import html_text

from .test_topk_warc_html import WEIGHTS, page

ARTICLE = "<article><p>some words of text</p></article>"


@pytest.mark.parametrize("html", [
    f'<html class="header-fixed"><body class="has-sidebar">{ARTICLE}</body></html>',
    f'<html class="menu"><body id="sidebar" class="ad">{ARTICLE}</body></html>',
    f'<body><div id="page" class="menu-closed">{ARTICLE}</div></body>',
    f'<body><div class="left-side"><div class="overlay">{ARTICLE}</div></div></body>',
    f'<form action="x"><div class="side">{ARTICLE}</div></form>',
    f'<div class="sidebar"><p>menu</p></div><div class="widget"><div class="ad">buy</div>{ARTICLE}</div>',
    f'<table><tr><td class="promo">{ARTICLE}</td></tr></table>',
])
def test_wrappers_of_the_article_stay(html):
    assert html_text.main_text(html, WEIGHTS) == "some words of text"


@pytest.mark.parametrize("part", [
    '<section id="side-effects"><p>two</p></section>', '<h2 id="related-work">two</h2>', '<p id="share-capital">two</p>',
    '<h2 class="alert">two</h2>', '<p><span class="comment">two</span></p>', "<math><mi>two</mi></math>", '<p id="comments">two</p>',
])
def test_parts_of_the_article_stay(part):
    assert html_text.main_text(page(f"<article><p>one</p>{part}<p>three</p></article>"), WEIGHTS).split() == ["one", "two", "three"]


@pytest.mark.parametrize("name", ["ad", "ad-box", "sideBar", "side-bar", "comment-list", "share-buttons", "main-nav", "text cookie_notice", "ad1"])
def test_named_wrappers_go(name):
    assert html_text.main_text(page(f'<article><p>one</p><div class="{name}"><p>two</p></div><p>three</p></article>'), WEIGHTS).split() == ["one", "three"]
