"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of tokens: words score positive, tags negative, and one linear scan finds the contiguous region
with the largest sum. Weights come from labelled pages, those with ``<main>`` or ``<article>``, whose inside is the content:
a word scores the share of words in its kind of place (a link, or the block that it stands in) that are content; a tag scores
the logarithm of the share of its kind that are, at least ``MOST_TAG``. Shares start from ``PRIOR`` of ``PRIOR_COUNT``
observations, which is what places and tags without evidence have. At most ``MAX_LABELLED`` pages of at most
``MAX_LABELLED_BYTES`` are counted, the first by a hash of their key; executors count, the driver gets sums by kind.

Where a page itself says what its content is, tokens are scored by that: inside its articles, or inside a main that holds
none, words score whole and tags next to nothing (they are content by their page's own label); beside them nothing scores
and nothing is taken; what a main holds around its articles, such as their title, is scored by learned weights, though
what lies between two articles never parts them. Pages without such elements are scored by learned weights alone.

Elements that aren't text of an article wherever they stand (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments, hidden parts) are known by tag, role, class or id, and left out of the region's text. In
content they score nothing, so an advert doesn't tear its article apart; elsewhere they cost their own tags. A class or id
counts only on wrappers of blocks and where the whole name says so; html, body and what holds the page's only article
or main are never left out.

Results: null, empty and tagless pages: no html gives the empty text, plain text is its own content. Character
references are decoded, white space within a block becomes one space, blocks are joined by one line feed. Of regions
with equal sums the first stays; a page of nothing but links has none. Pages are handled whole, in time proportional to
their length, however deep elements are nested.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import lowest, map_rows, tune

MAX_LABELLED, MAX_LABELLED_BYTES = 400, 1 << 20
#: Score of a word of content, least score of a tag, and what a region must score.
WORD, MOST_TAG, LEAST_REGION = 1.0, -2.0, 0.25
#: Share of content that is assumed of every kind of token, as if seen so often; and of tags in what a page calls its content.
PRIOR, PRIOR_COUNT, OWN_TAG = 0.9, 5, -0.001

# Element names.
RAW = frozenset("script style iframe textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OPEN_ENDED = frozenset("p li dt dd option tr td th thead tbody tfoot colgroup html body head".split())
LEFT_OUT = frozenset("nav header footer aside form button head dialog menu fieldset label input noscript template svg canvas object video audio select".split())
LABELLED = frozenset(("article", "main"))
INERT = frozenset("noscript template svg canvas object video audio select".split())
INLINE_LEFT_OUT = INERT | INLINE | frozenset(("button", "label", "input"))
# Class names, ids and roles of what isn't an article's text.
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments commentlist respond reply replies "
    "disqus widget widgets toolbar pagination pager skip disclaimer alert".split())
#: What a name may hold beside one of these: ad-box, comment-list, main-nav.
NEUTRAL_PARTS = frozenset("area bar block bottom box buttons container icons inner left links list main panel posts primary right secondary site slot top unit wrap wrapper x".split())
#: Elements that a name can leave out: wrappers of blocks by class or id, paragraphs and list items by class.
NAMED = {t: ("class", "id") for t in "div section ul ol dl table details figure center iframe td".split()} | {"p": ("class",), "li": ("class",)}
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

# Attributes up to the end of a tag; a quote opens a value only after an equals sign, and what is never closed goes on to
# the end of the page. Possessive: a page is read once, however broken it is.
_ATTRIBUTES = r"""(?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(sorted(RAW))})(?=[\s/>]){_ATTRIBUTES}(?:>|\Z)(?:.*?</(?P=raw)(?=[\s/>])[^>]*>|.*\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_CUT = re.compile(r"[^a-z]+")


def is_left_out_name(name: str) -> bool:
    """Whether a class name or id says as a whole that its element isn't text of an article: sidebar, but not has-sidebar."""
    parts = set(filter(None, _CUT.split(name)))
    if name in LEFT_OUT_NAMES or "".join(_CUT.split(name)) in LEFT_OUT_NAMES:
        return True
    return parts <= LEFT_OUT_NAMES | NEUTRAL_PARTS and not parts.isdisjoint(LEFT_OUT_NAMES - {"side"})


def is_left_out(tag: str, attrs: str) -> bool:
    """Whether an element isn't text of an article, by its tag and attributes."""
    if tag in LEFT_OUT:
        return True
    if tag in ("html", "body"):
        return False
    if tag in LABELLED or not attrs or attrs == "/":
        return "hidden" in attrs.lower().split()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.strip() in LEFT_OUT_ROLES:
            return True
        if name in NAMED.get(tag, ()) and any(map(is_left_out_name, value.split())):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class Element(NamedTuple):
    """A tag of a page: ``tag`` is None for comments, scripts and the like."""

    tag: str | None
    end: bool
    attrs: str
    at: int
    after: int


def elements(page: str) -> list[Element]:
    """Every tag, in page order."""
    return [Element(m["tag"] and m["tag"].lower(), bool(m["end"]), m["attrs"] or "", m.start(), m.end()) for m in _TOKEN.finditer(page)]


class OpenTags:
    """Names of the elements that are open. Each is pushed and popped once, so closing never searches."""

    def __init__(self):
        self.names: list[str] = []
        self.count: dict[str, int] = {}

    def push(self, tag: str) -> None:
        self.names.append(tag)
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.names.pop()
        self.count[tag] -= 1
        return tag

    def has(self, tag: str) -> bool:
        return self.count.get(tag, 0) > 0

    def close(self, tag: str) -> bool:
        """Close the innermost ``tag`` and what is open in it; False where none is open."""
        if not self.has(tag):
            return False
        while self.pop() != tag:
            pass
        return True


def holders(found: list[Element]) -> frozenset[int]:
    """Where the elements begin that the page's only <article>, or its only <main>, stands in."""
    opened, places = OpenTags(), []
    first: dict[str, list[int]] = {}
    many = set()
    for e in found:
        if e.tag is None:
            continue
        if e.end:
            if opened.close(e.tag):
                del places[len(opened.names) :]
            continue
        if opened.names and opened.names[-1] == "p" and e.tag not in INLINE:
            opened.pop()
            places.pop()
        if e.tag in LABELLED:
            if e.tag in first:
                many.add(e.tag)
            else:
                first[e.tag] = list(places)
        if e.tag not in VOID and (not e.attrs.endswith("/") or e.tag in INLINE | OPEN_ENDED):
            opened.push(e.tag)
            places.append(e.at)
    return frozenset(at for tag, starts in first.items() if tag not in many for at in starts)


class Token(NamedTuple):
    """A piece of text (``tag`` is ""), a tag, or a gap where a block was left out ("/").

    ``kind`` names what weights are learned for: a text's place, a tag's name; "" inside what a class, id or role leaves out,
    which says nothing about tags.
    """

    tag: str
    text: str
    kind: str
    out: bool
    main: bool
    article: bool


def tokens(page: str) -> list[Token]:
    """The tokens of a page; those of left out elements are marked ``out``."""
    found = elements(page)
    last_end = {e.tag: e.at for e in found if e.end}
    out: list[Token] = []
    opened = OpenTags()
    skip, by_tag = -1, True  # depth of the outermost element being left out, and whether its tag alone says so
    block = ""  # the block that text stands in
    holding: frozenset[int] | None = None  # found when first asked for

    def add(tag: str, text: str = "", kind: str = "") -> None:
        out.append(Token(tag, text, kind if by_tag else "", skip >= 0, opened.has("main"), opened.has("article")))

    def leave_out(e: Element) -> bool:
        nonlocal holding
        if not is_left_out(e.tag, e.attrs):
            return False
        if e.tag not in INERT and holding is None:
            holding = holders(found)
        return e.tag in INERT or e.at not in holding

    def gap(tag: str) -> None:
        if tag not in INLINE_LEFT_OUT:
            out.append(Token("/", "", tag if tag in LEFT_OUT else "", False, opened.has("main"), opened.has("article")))

    at = 0
    for e in [*found, Element(None, False, "", len(page), len(page))]:
        if e.at > at:
            add("", page[at : e.at], "in:a" if opened.has("a") else f"in:{block}")
        at, tag = e.after, e.tag
        if tag is None:
            continue
        if tag not in INLINE:
            block = "" if e.end else tag
        if e.end:
            name = opened.names[skip] if skip >= 0 else ""
            if opened.close(tag) and skip >= len(opened.names):
                skip, by_tag = -1, True
                gap(name)
            else:
                add(tag, kind=tag)
            continue
        if skip >= 0 and skip == len(opened.names) - 1:
            name = opened.names[skip]
            if name == "p" and tag not in INLINE or name in OPEN_ENDED and name == tag:
                opened.pop()  # the next block ends one whose end tag may be left away
                skip, by_tag = -1, True
                gap(name)
        if tag in VOID or e.attrs.endswith("/") and tag not in INLINE | OPEN_ENDED:
            add(tag, kind=tag)
            continue
        left_out = skip < 0 and leave_out(e)
        if tag in OPEN_ENDED and not left_out:
            add(tag, kind=tag)
        elif left_out and tag not in OPEN_ENDED and last_end.get(tag, -1) < at:  # never closed: only its tag can be left out
            gap(tag)
        elif left_out:
            skip, by_tag = len(opened.names), tag in LEFT_OUT
            add(tag, kind=tag)
            opened.push(tag)
        else:
            add(tag, kind=tag)
            opened.push(tag)
    return out


def marked(found: list[Token]) -> tuple[list[bool], list[bool]] | None:
    """(content, near) for each token by the page's own <main> or <article>; None for pages that say nothing.

    Articles in a main are content and the rest of the main is near; a main without articles is content, as are articles on
    pages without a main. An element without a word says nothing.
    """
    says = [not t.out and not t.tag and not t.text.isspace() for t in found]
    mains = any(s and t.main for s, t in zip(says, found))
    if mains and any(s and t.main and t.article for s, t in zip(says, found)):
        return [t.main and t.article for t in found], [t.main and not t.article for t in found]
    if mains:
        return [t.main for t in found], [False] * len(found)
    if any(s and t.article for s, t in zip(says, found)):
        return [t.article for t in found], [False] * len(found)
    return None


def share(inside: int, outside: int) -> float:
    """Share of content among so many tokens of a kind."""
    return (inside + PRIOR * PRIOR_COUNT) / (inside + outside + PRIOR_COUNT)


@dataclass
class Weights:
    """Scores of words by place and of tags by name."""

    word: float = WORD
    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def of(self, token: Token) -> float:
        """The score of a token of a page that doesn't say what its content is."""
        if not token.tag:
            return self.word * len(token.text.split()) * self.words.get(token.kind, PRIOR)
        each = self.tags.get(token.kind, math.log(PRIOR))
        return 0.0 if token.out else 2 * each if token.tag == "/" else each


def token_counts(page: str) -> dict[tuple[str, bool], int]:
    """How many tokens of each kind a labelled page has in its content (True) and elsewhere; none for other pages."""
    found = tokens(page)
    zones = marked(found)
    out: dict[tuple[str, bool], int] = {}
    for t, content, near in zip(found, *zones) if zones else ():
        n = 1 if t.tag else len(t.text.split())
        if n and t.kind and t.kind not in LABELLED and t.tag != "/" and (t.out or not near):
            of = (t.kind, content and not t.out)
            out[of] = out.get(of, 0) + n
    return out


def weights_of(counts: dict[tuple[str, bool], int]) -> Weights:
    """Weights from counts of labelled pages; the defaults where there are none."""
    shares = {k: share(counts.get((k, True), 0), counts.get((k, False), 0)) for k in sorted({kind for kind, _ in counts})}
    return Weights(
        WORD, {k: v for k, v in shares.items() if k.startswith("in:")},
        {k: max(MOST_TAG, math.log(v)) for k, v in shares.items() if not k.startswith("in:")})


def weights_from(pages: list[str]) -> Weights:
    """Weights from labelled pages; the defaults where none is labelled."""
    counts: dict[tuple[str, bool], int] = {}
    for page in pages:
        for of, n in token_counts(page).items():
            counts[of] = counts.get(of, 0) + n
    return weights_of(counts)


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last index of the contiguous region with the largest sum (the first such; (0, -1) if none is positive)."""
    best, region, total, start = 0.0, (0, -1), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i)
    return region


def scored(found: list[Token], weights: Weights) -> tuple[list[float], list[bool]]:
    """(score, whether its text may be taken) of each token."""
    zones = marked(found)
    if zones is None:
        return [0.0 if t.out else weights.of(t) for t in found], [not t.out for t in found]
    content, near = zones
    first, last = content.index(True), len(content) - content[::-1].index(True)
    scores = []
    for i, (t, inside, around) in enumerate(zip(found, content, near)):
        if t.out or not (inside or around) or t.tag == "/" and inside:
            scores.append(0.0)
        elif inside:
            scores.append(OWN_TAG if t.tag else weights.word * len(t.text.split()))
        else:
            scores.append(max(0.0, weights.of(t)) if first < i < last else weights.of(t))
    return scores, [not t.out and (c or n) for t, c, n in zip(found, content, near)]


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best region of a page."""
    found = tokens(page or "")
    scores, taken = scored(found, weights)
    first, last = best_region(scores)
    if sum(scores[first : last + 1]) < LEAST_REGION:
        return ""
    blocks, run = [], []
    for token, keep in zip(found[first : last + 1], taken[first : last + 1]):
        if not token.tag:
            if keep:
                run.append(html_lib.unescape(token.text))
        elif token.tag == "br":
            run.append(" ")
        elif token.tag not in INLINE and not token.out:
            blocks.append(run)
            run = []
    lines = (" ".join("".join(r).split()) for r in [*blocks, run])
    return "\n".join(x for x in lines if x)


def learn_weights(df: DataFrame, key: str = "page_id", html: str = "html", max_pages: int = MAX_LABELLED, max_bytes: int = MAX_LABELLED_BYTES, seed: int = 3) -> Weights:
    """Weights from at most ``max_pages`` pages of ``df`` with a labelled element and at most ``max_bytes``, the first by a hash of their key."""
    tune(df.sparkSession)
    labelled = df.filter(F.col(html).rlike("(?i)<(article|main)[\\s>]") & (F.octet_length(html) <= max_bytes))
    order = F.xxhash64(F.col(key).cast("string"), F.lit(seed), F.xxhash64(html))
    chosen = lowest(labelled.select(key, html), order, max_pages)

    def per_batch(columns: dict) -> dict:
        out: dict[tuple[str, bool], int] = {}
        for page in columns["html"]:
            for of, n in token_counts(page.as_py()).items():
                out[of] = out.get(of, 0) + n
        return {"kind": [k for k, _ in out], "content": [c for _, c in out], "n": list(out.values())}

    counted = map_rows(chosen.select(F.col(html).alias("html")), per_batch, "kind string, content boolean, n long").groupBy("kind", "content").agg(F.sum("n").alias("n"))
    return weights_of({(r["kind"], r["content"]): r["n"] for r in counted.collect()})


def extract(df: DataFrame, weights: Weights, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row."""
    tune(df.sparkSession)

    def per_batch(columns: dict) -> dict:
        texts = [main_text(h.as_py(), weights) for h in columns["html"]]
        return {"key": columns["key"], "url": columns["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    rows = df.select(df[key].alias("key"), df[url].alias("url"), df[html].alias("html"))
    return map_rows(rows, per_batch, f"key {dict(df.dtypes)[key]}, url string, text string, n_chars long").withColumnRenamed("key", key)
