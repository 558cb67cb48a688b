"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text (runs between block-level tags), each with its path of
tags from the root to the leaf.  Per distinct path the text length and the punctuation are summed
and divided by the number of blocks; both ratios are smoothed along the page, multiplied, and
paths over the threshold are content paths.  Every block with a content path is in the result, and
so is what stands around them in the innermost element that holds them all (or the marked article
it lies in): short headings and lists.

Elements that are not article text by their own mark-up (scripts, forms, navigation, comment
sections, adverts, hidden parts, told by tag, role, class or id) never count.  Blocks that mostly
consist of links are left out only where they have no content path and stand in no marked article
(``article`` or ``main``).

Null, empty and text-free pages give an empty text.  Pages are answered row by row; broken
mark-up (tags never closed, stray end tags, a page cut off inside a tag) is read as browsers do.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|canvas|noframes|xmp"
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend
    li main menu nav ol option p pre search section select summary table tbody td tfoot th thead
    tr ul""".split()
)
ENDED_BY = {
    "p": BLOCK,
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "head": frozenset({"body"}),
}
SCOPES = frozenset("table ul ol dl select div section article main aside nav body form".split())
NOT_TEXT = frozenset(
    """nav header footer aside form button select menu dialog search fieldset label datalist head
    audio video map""".split()
)
NOT_TEXT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
# Words of class and id names.  One of the first marks what is no text wherever it stands in a name.
NOT_TEXT_WORDS = frozenset(
    """ad ads adbox advert adverts advertisement advertising sponsored promo promoted nav navbar
    navigation menu submenu breadcrumb breadcrumbs sidebar masthead topbar cookie cookies gdpr popup
    modal overlay newsletter subscribe comment comments commentlist disqus recommended
    recommendations teaser teasers widgets toolbar pagination pager outbrain taboola paywall""".split()
)
# These are also words an article's own parts are named by; they count as a whole name, or beside
# nothing but words for a place on the page.
DOUBTFUL_WORDS = frozenset(
    """sponsor promotion banner rail footer header consent notice notices alert subscription signup
    login reply replies respond discussion social share sharing related widget skip copyright""".split()
)
PLACES = frozenset(
    """site page main top bottom left right inner outer global primary secondary box block list item
    items wrapper wrap container section area bar slot unit zone region panel group holder module col
    column row button buttons link links icons form thread count article articles post posts stories""".split()
)
KEEPS_ITS_TEXT = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
MARKED = frozenset({"article", "main"})

PIECES = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*)>"
    r"|<[!?/][^>]*>"
    r"|<[!?/a-z][^>]*\Z",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([a-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？;·“”»«]")


@dataclass
class Element:
    name: str
    label: str
    parent: "Element | None"
    depth: int
    skip: bool
    link: bool
    owner: int = 0  # number of the element whose doubtful name takes this one out


@dataclass
class Block:
    element: Element
    text: str
    linked: int
    path: str = field(default="")


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(source)}


def is_not_text(name: str, attrs: dict[str, str]) -> bool:
    if name in NOT_TEXT:
        return True
    if not attrs or name in KEEPS_ITS_TEXT:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", attrs.get("style", ""), re.IGNORECASE):
        return True
    return attrs.get("role", "").lower() in NOT_TEXT_ROLES


@lru_cache(maxsize=10_000)
def named_no_text(name: str) -> int:
    """Whether one class or id name speaks against its element: 2 it does, 1 in doubt, 0 no."""
    words = [w.lower() for w in WORD.findall(name)]
    if any(w in NOT_TEXT_WORDS for w in words):
        return 2
    doubtful = [w for w in words if w in DOUBTFUL_WORDS]
    # "article-header" and "post-reply" head or answer an article; an article's place alone is not the page's.
    rest = [w for w in words if w not in DOUBTFUL_WORDS]
    return int(bool(doubtful) and all(w in PLACES for w in rest) and not ({"article", "post"} & set(rest)))


def classed_no_text(name: str, attrs: dict[str, str]) -> int:
    if not attrs or name in KEEPS_ITS_TEXT:
        return 0
    return max(named_no_text(n) for n in f"{attrs.get('class', '')} {attrs.get('id', '')} -".split())


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with the element they stand in.

    What class names speak against is left out.  Where a doubtful name would take out more text than
    all that is kept, it says something else, and its element stays.
    """
    blocks, removed = parsed_blocks(page, 0)
    most = max(removed, key=removed.get, default=0)
    if most and removed[most] > sum(len(b.text) for b in blocks):
        return parsed_blocks(page, most)[0]
    return blocks


def parsed_blocks(page: str, spared: int) -> tuple[list[Block], dict[int, int]]:
    """The blocks, and the characters of text removed by each element with a doubtful name; such
    elements are numbered from 1, and number ``spared`` stays."""
    root = Element("#", "#", None, 0, False, False)
    at, here, run, linked, out = 0, root, [], 0, []
    removed: dict[int, int] = defaultdict(int)
    number = 0

    def flush():
        nonlocal run, linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text and not block_parent(here).skip and not here.skip:
                out.append(Block(block_parent(here), text, min(linked, len(text))))
        run, linked = [], 0

    def block_parent(element):
        while element.name not in BLOCK and element.parent is not None:
            element = element.parent
        return element

    def leave(name, scope=frozenset()):
        """Close the innermost open ``name``, unless an element of ``scope`` is met first."""
        nonlocal here
        seek = here
        while seek.parent is not None and seek.name != name:
            if seek.name in scope:
                return
            seek = seek.parent
        if seek.parent is not None:
            here = seek.parent

    def text_piece(source):
        nonlocal linked
        if source:
            if not here.skip:
                run.append(source)
                if here.link:
                    linked += len(" ".join(source.split()))
            elif here.owner:
                removed[here.owner] += len(source.strip())

    for m in PIECES.finditer(page):
        text_piece(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in VOID:
            if name == "hr":
                flush()
            elif run:
                run.append(" ")
            continue
        if name in BLOCK:
            flush()
        if m["end"]:
            leave(name, SCOPES - {name} if name in ENDED_BY else frozenset())
            continue
        if name in BLOCK:
            for open_name, enders in ENDED_BY.items():
                if name in enders:
                    leave(open_name, SCOPES - {open_name})
        attrs = attributes(m["attrs"]) if m["attrs"].strip(" /\n\t") else {}
        label = name
        if attrs.get("class") and name not in ("p", "a", "span"):
            label += "." + ".".join(sorted(attrs["class"].split()))
        skip, owner = here.skip or is_not_text(name, attrs), here.owner
        against = 0 if skip else classed_no_text(name, attrs)
        if against == 2:
            skip = True
        elif against == 1:
            number += 1
            if number != spared:
                skip, owner = True, number
        here = Element(name, label, here, here.depth + 1, skip, here.link or name == "a", owner)
        if name not in BLOCK and here.skip and not here.parent.skip:
            run.append(" ")
    text_piece(page[at:])
    flush()
    for b in out:
        labels, e = [], b.element
        while e is not None:
            labels.append(e.label)
            e = e.parent
        b.path = "/".join(reversed(labels))
    return out, removed


@dataclass(frozen=True)
class PathRules:
    smoothing: tuple[float, ...] = (0.25, 0.5, 0.25)
    threshold: float = 0.5  # times the mean fused ratio, weighted by text
    most_linked: float = 0.6  # outside content paths and marked articles


def smoothed(values: np.ndarray, kernel: tuple[float, ...]) -> np.ndarray:
    half = len(kernel) // 2
    return np.convolve(np.pad(values, half, mode="edge"), kernel, mode="valid")


def content_paths(blocks: list[Block], rules: PathRules) -> set[str]:
    """Paths whose smoothed, fused ratio of text and punctuation is over the threshold."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        count[b.path] += 1
        length[b.path] += len(b.text) - b.linked
        marks[b.path] += len(PUNCTUATION.findall(b.text))
    text_ratio = np.array([length[b.path] / count[b.path] for b in blocks])
    mark_ratio = np.array([(1 + marks[b.path]) / count[b.path] for b in blocks])
    fused = np.log1p(smoothed(text_ratio, rules.smoothing)) * np.log1p(smoothed(mark_ratio, rules.smoothing))
    by_path: dict[str, list[float]] = defaultdict(list)
    for b, f in zip(blocks, fused):
        by_path[b.path].append(float(f))
    score = {p: sum(v) / len(v) for p, v in by_path.items()}
    total = sum(length.values())
    if not total:
        return set()
    least = rules.threshold * sum(score[p] * length[p] for p in score) / total
    return {p for p in score if score[p] >= least and length[p] > 0}


def article_of(blocks: list[Block], paths: set[str]) -> Element | None:
    """The innermost element that holds every block with a content path."""
    best: Element | None = None
    for b in blocks:
        if b.path in paths:
            best = b.element if best is None else common(best, b.element)
    # A single long paragraph is not the article: step out of leaves, and into the marked article.
    while best is not None and best.parent is not None:
        if best.name in (*MARKED, "body"):
            return best
        outer = best.parent
        while outer is not None and outer.name not in MARKED:
            outer = outer.parent
        if outer is not None:
            return outer
        if best.name in ("p", "li", "td", "tr", "tbody", "blockquote", "pre", "ul", "ol", "dd", "dl"):
            best = best.parent
            continue
        return best
    return best


def common(a: Element, b: Element) -> Element:
    """The innermost element that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def in_marked_article(element: Element | None) -> bool:
    while element is not None:
        if element.name in MARKED:
            return True
        element = element.parent
    return False


def inside(element: Element | None, root: Element) -> bool:
    while element is not None:
        if element is root:
            return True
        element = element.parent
    return False


def main_text(page: str | None, rules: PathRules = PathRules()) -> str:
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    paths = content_paths(blocks, rules)
    root = article_of(blocks, paths)
    if root is None:
        return ""

    def belongs(b: Block) -> bool:
        if b.path in paths:
            return True
        unlinked = b.linked <= rules.most_linked * len(b.text)
        return inside(b.element, root) and (unlinked or in_marked_article(b.element))

    kept = [b.text for b in blocks if belongs(b)]
    return "\n\n".join(kept)


def extract(pages: DataFrame, html_column: str = "html", rules: PathRules = PathRules()) -> DataFrame:
    """``pages`` with ``text``, the main text of each page's whole HTML; no shuffle."""

    @F.pandas_udf(T.StringType())
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, rules) for p in batch], dtype=object)

    return pages.withColumn("text", extracted(F.col(html_column)))
