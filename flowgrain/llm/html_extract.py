"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Tags, roles and whole class names only mark evidence: that a block lies in
a menu, header, footer, sidebar, form, notice, advert or reader comment, or in an article. The first pass labels a block good, bad
or undecided from its density of stop words, its length and its link density, with milder limits inside a marked
article; marked boilerplate is bad, and so is what lies outside the article of a page that has one. The second pass
gives undecided blocks the label of the nearest decided neighbours: inside an article of that article's
blocks, its edges counting as good, elsewhere of the page's, whose edges count as bad. Text is decoded once, white space in a block
becomes one space, and good blocks are joined in page order by one space.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import python_batches

# Frequent function words of the four languages of the pages.
STOP_WORDS = frozenset(
    """the of and a to in is that it was for on are as with be at by this from or an not have his they which
    de la le et les des en un du une que est pour qui dans par sur au avec pas ce il se plus ne
    der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er
    el que y los del se las por con no su para es al lo como más o pero sus este ya entre una""".split()
)
BOILERPLATE_TAGS = frozenset("nav header footer aside form button select option textarea dialog menu figcaption label fieldset".split())
HIDDEN_TAGS = frozenset("script style noscript template svg iframe object head title math canvas audio video".split())
CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol dl table tbody thead tr td th figure blockquote dialog menu fieldset button select textarea figcaption label".split())
BLOCK_TAGS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address hr option legend caption summary details center".split())
VOID_TAGS = frozenset("br hr img input meta link area base col embed source track wbr".split())
BOILERPLATE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu
    menus breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended cookie cookies consent
    notice notices alert popup modal overlay newsletter subscribe signup login share sharing social comment comments
    commentlist respond replies disqus pagination pager toolbar copyright legal disclaimer search form""".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog toolbar".split())
ARTICLE_NAMES = frozenset("article post entry story articlebody".split())
# Words beside the names above that say nothing of their own: only with them is a compound name one of those above.
LAYOUT_NAMES = frozenset("site page main top bottom left right bar box block wrapper wrap container inner outer list item items section area panel slot unit links link icons icon buttons button global primary secondary fixed sticky the".split())
BODY_NAMES = frozenset("content body text main full".split())

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|"
    r"<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_EDGE = re.compile(r"^\W+|\W+$")


@dataclass
class Block:
    text: str
    link_chars: int
    bad_region: bool
    in_article: bool
    heading: bool


def _marks(name: str) -> tuple[bool, bool]:
    """Whether a class or id names boilerplate, and whether it names an article: all its parts must speak for it.

    ``cookie-banner`` and ``siteFooter`` are boilerplate, ``share-price`` and ``search-engine`` are not.
    """
    parts = {x for x in re.split(r"[^a-z]+", _CAMEL.sub("-", name).lower()) if x}
    bad = bool(parts & BOILERPLATE_NAMES) and parts <= BOILERPLATE_NAMES | LAYOUT_NAMES
    return bad, bool(parts & ARTICLE_NAMES) and parts <= ARTICLE_NAMES | BODY_NAMES


def _evidence(rest: str) -> tuple[bool, bool, str, bool]:
    """(a name of boilerplate, a name of an article, role, hidden) of a tag's attributes."""
    bad = good = hidden = False
    role = ""
    for key, a, b, c in _ATTRIBUTE.findall(rest):
        value, key = a or b or c, key.lower()
        if key in ("class", "id"):
            for name in value.split():
                own = _marks(name)
                bad, good = bad or own[0], good or own[1]
        elif key == "role":
            role = value.lower()
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.lower().replace(" ", "")):
            hidden = True
    return bad, good, role, hidden


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; text of scripts, styles and the head is left out."""
    out: list[Block] = []
    # Open elements: name, and whether it or one around it is boilerplate or an article; and how many there are of each name.
    stack: list[tuple[str, bool, bool]] = []
    depth: Counter[str] = Counter()
    pieces: list[str] = []
    link_pieces: list[str] = []
    link_depth, heading, at = 0, False, 0

    def flush() -> None:
        nonlocal pieces, link_pieces
        text = " ".join("".join(pieces).split())
        if text:
            _, bad, article = stack[-1] if stack else ("", False, False)
            out.append(Block(text, len(" ".join("".join(link_pieces).split())), bad, article, heading))
        pieces, link_pieces = [], []

    def pop() -> str:
        name = stack.pop()[0]
        depth[name] -= 1
        return name

    def add(raw: str) -> None:
        text = html_module.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if link_depth:
            link_pieces.append(text)

    skip_to = None
    for m in _PART.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        closing, rest = bool(m["close"] or m["close2"]), m["rest"] or ""
        if name in HIDDEN_TAGS and not closing:
            if rest.endswith("/"):
                continue
            skip_to = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
            # A head that is never closed ends where the body begins.
            if skip_to is None and name == "head":
                skip_to = re.compile(r"(?=<body\b)", re.I).search(page, at)
            at = skip_to.end() if skip_to else len(page)
            if name in BLOCK_TAGS or name in ("head", "title"):
                flush()
            continue
        if name == "a":
            link_depth = max(0, link_depth - 1) if closing else link_depth + 1
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in BLOCK_TAGS:
            continue
        flush()
        link_depth = 0
        if re.fullmatch("h[1-6]", name):
            heading = not closing
        elif name in CONTAINERS or name == "p":
            heading = False
        if name in CONTAINERS or (not closing and name in ("p", "li")):
            if closing:
                while depth[name] and pop() != name:
                    pass
            elif not rest.endswith("/") and name not in VOID_TAGS:
                named_bad, named_good, role, hidden = _evidence(rest) if rest.strip() else (False, False, "", False)
                if name in ("p", "li"):
                    while stack and stack[-1][0] == name:
                        pop()
                _, bad_around, article_around = stack[-1] if stack else ("", False, False)
                bad = name in BOILERPLATE_TAGS or named_bad or role in BOILERPLATE_ROLES or hidden
                # A header inside an article holds the article's own heading.
                if name == "header" and article_around and not named_bad:
                    bad = False
                good = name in ("article", "main") or role in ("article", "main") or (name in ("div", "section") and named_good)
                if name in ("html", "body") or good and not named_bad:
                    bad = False
                stack.append((name, bad or bad_around, good or article_around))
                depth[name] += 1
        elif closing and name in ("p", "li"):
            if stack and stack[-1][0] == name:
                pop()
    if at < len(page):
        add(page[at:])
    flush()
    return out


GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"


@dataclass(frozen=True)
class Limits:
    """Lengths in characters, densities as shares; the second link density is for blocks inside an article."""

    link: float = 0.33
    link_inside: float = 0.8
    short: int = 70
    long: int = 200
    stop_low: float = 0.12
    stop_high: float = 0.24


def stop_density(text: str) -> float:
    words = [w for w in (_EDGE.sub("", x).lower() for x in text.split()) if w]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(blocks: list[Block], limits: Limits = Limits()) -> list[str]:
    """A label for each block: good, bad, or undecided (near good, or short)."""
    structured = any(b.in_article and not b.bad_region for b in blocks)
    dense = [b.link_chars >= limits.link_inside * len(b.text) for b in blocks]
    labels = []
    for i, b in enumerate(blocks):
        if b.bad_region or (structured and not b.in_article):
            labels.append(BAD)
        elif b.in_article and dense[i]:
            # A link alone may be the article's own; links one after the other are a list of them.
            labels.append(BAD if any(0 <= j < len(blocks) and dense[j] and blocks[j].in_article for j in (i - 1, i + 1)) else SHORT)
        elif not b.in_article and b.link_chars > limits.link * len(b.text):
            labels.append(BAD)
        elif len(b.text) < limits.short or b.heading:
            labels.append(BAD if b.link_chars and not b.heading and not b.in_article else SHORT)
        else:
            stop = stop_density(b.text)
            if stop >= (limits.stop_low if b.in_article else limits.stop_high):
                labels.append(GOOD if len(b.text) > limits.long else NEAR)
            else:
                labels.append(NEAR if stop >= limits.stop_low else SHORT if b.in_article else BAD)
    return labels


def second_pass(labels: list[str], edge: str = BAD) -> list[str]:
    """Undecided blocks take the label of the nearest decided block on either side; ``edge`` stands beyond the ends.

    Where the two sides differ, a near-good block is good, a short one goes with the nearer side, on a tie with
    what follows it (a heading belongs to its text).
    """
    n = len(labels)
    before, after = [(edge, 0)] * n, [(edge, 0)] * n
    for found, places in ((before, range(n)), (after, range(n - 1, -1, -1))):
        seen, gap = edge, 0
        for i in places:
            gap += 1
            found[i] = (seen, gap)
            if labels[i] in (GOOD, BAD):
                seen, gap = labels[i], 0
    out = []
    for x, (left, dl), (right, dr) in zip(labels, before, after, strict=True):
        if x in (GOOD, BAD):
            out.append(x)
        elif left == right:
            out.append(left)
        elif x == NEAR:
            out.append(GOOD)
        else:
            out.append(left if dl < dr else right)
    return out


def labelled(blocks: list[Block], limits: Limits = Limits()) -> list[str]:
    """Good or bad for each block, by both passes; boilerplate within an article is no neighbour of its blocks."""
    first = first_pass(blocks, limits)
    out = list(first)
    inside = [i for i, b in enumerate(blocks) if b.in_article and not b.bad_region]
    outside = [i for i, b in enumerate(blocks) if not b.in_article]
    for places, edge in ((inside, GOOD), (outside, BAD)):
        for i, x in zip(places, second_pass([first[i] for i in places], edge), strict=True):
            out[i] = x
    return out


def main_text(page: str | None, limits: Limits = Limits()) -> str:
    """The main text of one page; null or empty pages have the empty text."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return " ".join(b.text for b, x in zip(blocks, labelled(blocks, limits), strict=True) if x == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; each page is handled alone, in time linear in its length.

    Null and empty pages have the empty text; repeated rows repeat; an empty table gives no rows; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return python_batches(pages).select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
