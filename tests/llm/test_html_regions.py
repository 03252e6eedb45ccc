"""Regions of pages: what the scan finds where a page doesn't say what its content is, and what is kept where it does."""

import random
import time

import pytest

from kymo.llm import html_text

from .test_topk_warc_html import FOOT, NAV, WEIGHTS, page


def whole(html):
    """What would come out without the scan: the text of all tokens that aren't left out."""
    found = html_text.tokens(html)
    return " ".join(" ".join(t.text for t in found if not t.tag and not t.out).split())


MENU = "".join(f'<div><a href="/{i}">Part {i}</a> | <a href="/x{i}">More of {i}</a></div>' for i in range(8))
STORY = "<h1>A title</h1><p>It begins with some words about the thing.</p><p>Then <a href='/y'>one link</a> and many other words that go on.</p><div>It ends in a block of its own, with words.</div>"
TEXT = "A title\nIt begins with some words about the thing.\nThen one link and many other words that go on.\nIt ends in a block of its own, with words."


@pytest.mark.parametrize("html", [
    page(f"<div>{MENU}</div><div>{STORY}</div><div>{MENU}</div>"),
    page(f"<table><tr><td>{MENU}</td><td>{STORY}</td><td>{MENU}</td></tr></table>"),
    f"<body>{MENU}<div><div><div>{STORY}</div></div></div>{MENU}",
])
def test_menus_without_names(html):
    """Nothing here is left out by name; only scores part content from menus."""
    assert html_text.marked(html_text.tokens(html)) is None
    assert html_text.main_text(html, WEIGHTS) == TEXT
    assert whole(html) != " ".join(TEXT.split())


def test_random_pages_without_labels():
    rng = random.Random(4)
    for _ in range(60):
        words = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8))) for _ in range(n))
        blocks = [words(rng.randrange(8, 60)) for _ in range(rng.randrange(1, 12))]
        tags = [rng.choice(["p", "div", "section", "blockquote", "h2"]) for _ in blocks]
        body = "".join(f"<{t}>{b}</{t}>" for t, b in zip(tags, blocks))
        menu = lambda: "<ul>" + "".join(f"<li><a href='/'>{words(rng.randrange(1, 4))}</a></li>" for _ in range(rng.randrange(2, 9))) + "</ul>"
        html = page(f"{rng.choice(['', NAV])}<div>{menu()}</div><div class='x'>{body}</div><div>{menu()}</div>{rng.choice(['', FOOT])}")
        assert html_text.main_text(html, WEIGHTS) == "\n".join(blocks)


@pytest.mark.parametrize("html,text", [
    ("<main><h1>Title</h1><article><p>one two</p></article></main>", "Title\none two"),
    ("<main><article><p>one two</p></article><article><p>three words and more</p></article></main>", "one two\nthree words and more"),
    ("<article><p>first</p></article><p>between</p><article><p>second</p></article>", "first\nsecond"),
    (f"<main><div>{MENU}</div><article><p>one</p></article><div>{MENU}</div><article><p>two three</p></article><div>{MENU}</div></main>", None),
    ('<body class="single no-sidebar"><article><p>text</p></article></body>', "text"),
    ('<div class="layout has-sidebar"><article><p>text</p></article><div class="sidebar">no</div></div>', "text"),
    ("<main><p>only main</p><div>with more</div></main><p>not this, however long it goes on, as it stands beside it all</p>", "only main\nwith more"),
    ("<main></main><div><p>an empty main says nothing</p></div>", "an empty main says nothing"),
    ("<main><article> </article><p>an empty article says nothing</p></main>", "an empty article says nothing"),
    ("<article><p>a list</p>" + "<ul>" + "<li><a href='/'>x</a></li>" * 300 + "</ul><p>end</p></article>", "a list\n" + "x\n" * 300 + "end"),
    ("<article><p>a table</p><table>" + "<tr><td></td><td></td><td>1</td></tr>" * 200 + "</table><p>end</p></article>", "a table\n" + "1\n" * 200 + "end"),
    ("<article><p>press <button>Go</button> now</p><p>a<script>b</script>c</p></article>", "press now\nac"),
    ("<article><h1>One</h1><div class='ad'>" + "<p>buy this</p>" * 200 + "</div><p>two</p></article>", "One\ntwo"),
])
def test_labelled_pages(html, text):
    got = html_text.main_text(page(html), WEIGHTS)
    if text is None:
        assert got.startswith("one\n") and got.endswith("\ntwo three")
    else:
        assert got == text


def test_weights_differ():
    """Weights follow the counts: none is cut to a common bound but the lowest."""
    assert len(set(WEIGHTS.tags.values()) - {html_text.MOST_TAG}) >= 2
    assert WEIGHTS.words["in:p"] > 0.99 > 0.1 > WEIGHTS.words["in:a"] and "in:div" not in WEIGHTS.words
    assert WEIGHTS.tags["a"] == html_text.MOST_TAG < WEIGHTS.tags["p"] < 0


def test_renamed_articles():
    """Without its label a page of the same make gives the same text, by what was learned."""
    html = page(f'{NAV}<div class="ad">Buy now this thing</div><article><h1>Head</h1><p>Some words of text.</p><p>More of it</p></article>{FOOT}')
    assert html_text.main_text(html.replace("article", "div"), WEIGHTS) == html_text.main_text(html, WEIGHTS) == "Head\nSome words of text.\nMore of it"


@pytest.mark.parametrize("html", [
    "<div>" * 60_000 + "<p>deep words</p>" + "</span>" * 60_000,
    "<div>" * 60_000 + "<p>deep words</p>" + "</div>" * 60_000,
    "".join(f"<x{i} hidden>" for i in range(30_000)) + "<p>deep words</p>",
    "<article>" * 30_000 + "<p>deep words</p>",
])
def test_deep_nesting(html):
    began = time.perf_counter()
    assert html_text.main_text(html, WEIGHTS) == "deep words"
    assert time.perf_counter() - began < 5
