"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags. Each block is described by its words and link
density, those of the blocks before and after it, and by its place, which is what the page declares
of it: in an ``article`` or ``main``; outside of the one that the page has; in navigation, footers,
asides, forms, adverts, notices or readers' comments; or nothing. A tree grown from the small
labelled table below decides every block. The labels are those of blocks of which nothing is
declared, as pages without ``article`` have them; where a place is declared, the same blocks have
its label, for a one-word paragraph of an article and an advert of prose differ in nothing else. What
can never be text (scripts, styles, the head, form controls' contents) makes no blocks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpalith.llm.common import like, slices

#: Elements by their use.
CHROME = frozenset("nav header footer aside form menu dialog button select fieldset".split())
UNSEEN = frozenset("script style noscript template iframe svg head title textarea object canvas audio video".split())
MAIN = frozenset("article main".split())
HOLDERS = frozenset("div section ul ol dl table details figure center body".split())
BLOCKS = CHROME | MAIN | HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre hr address figcaption summary html option legend label".split())
#: Names (class, id or role) of what isn't the article; of what readers wrote; and of what may be either.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation menu sidebar breadcrumb breadcrumbs masthead footer "
    "cookie cookies consent notice notices alert popup modal newsletter subscribe signup share sharing social pagination pager copyright contentinfo complementary".split()
)
READERS = frozenset("comment comments disqus respond replies".split())
UNSURE = frozenset("header related recommended widget toolbar search login form discussion reply".split())
#: Parts that leave a name's meaning as it is.
NEUTRAL = frozenset("left right top bottom site page main box wrapper wrap container content list item items block area section bar inner outer body text link links small large".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")

#: What a page declares of a block: it is furniture, it is outside of the page's article, nothing (or only a name that hints), it is in the article.
FURNISHED, OUTSIDE, UNSAID, INSIDE = range(4)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place")
#: Labelled blocks of which nothing is declared: the features in order but for the place, then 1 for text of the article.
LABELLED = (
    (12, 0.0, 1, 1.0, 60, 0.0, 1), (7, 0.0, 8, 0.0, 45, 0.0, 1), (35, 0.0, 9, 0.0, 60, 0.0, 1), (120, 0.05, 80, 0.0, 3, 0.5, 1), (60, 0.0, 35, 0.0, 0, 0.0, 1), (45, 0.1, 20, 0.0, 30, 0.0, 1),
    (1, 0.0, 40, 0.0, 25, 0.0, 1), (2, 0.0, 30, 0.0, 18, 0.0, 1), (5, 0.0, 60, 0.0, 45, 0.0, 1), (9, 0.0, 35, 0.0, 50, 0.0, 1), (15, 0.0, 15, 0.0, 20, 0.0, 1), (4, 0.0, 6, 0.0, 5, 0.0, 1),
    (6, 1.0, 45, 0.0, 50, 0.0, 1), (30, 0.2, 4, 1.0, 35, 0.0, 1), (40, 0.0, 60, 0.0, 12, 0.0, 1), (90, 0.1, 9, 0.0, 0, 0.0, 1), (25, 0.3, 30, 0.0, 40, 0.1, 1), (3, 0.0, 70, 0.0, 80, 0.0, 1),
    (54, 0.0, 0, 0.0, 9, 0.0, 1), (8, 0.0, 0, 0.0, 70, 0.0, 1), (22, 0.0, 2, 1.0, 12, 0.0, 1), (11, 0.0, 28, 0.0, 9, 0.0, 1), (80, 0.0, 2, 1.0, 2, 1.0, 1), (33, 0.1, 0, 0.0, 0, 0.0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 1),
    (6, 0.0, 2, 0.0, 3, 0.0, 1), (3, 0.0, 6, 0.0, 1, 0.0, 1), (5, 0.0, 4, 0.0, 3, 0.0, 1), (4, 0.0, 12, 0.0, 2, 0.0, 1), (2, 0.0, 2, 0.0, 1, 0.0, 1), (13, 0.0, 40, 0.0, 2, 1.0, 1), (20, 0.0, 15, 0.0, 3, 1.0, 1), (1, 0.0, 25, 0.0, 3, 0.0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0), (3, 1.0, 0, 0.0, 4, 1.0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0), (6, 1.0, 4, 1.0, 50, 0.0, 0), (2, 1.0, 2, 1.0, 9, 0.0, 0), (8, 0.9, 40, 0.0, 3, 1.0, 0),
    (3, 1.0, 30, 0.0, 2, 1.0, 0), (5, 0.8, 9, 1.0, 1, 1.0, 0), (12, 0.7, 6, 0.8, 9, 0.9, 0), (6, 1.0, 70, 0.0, 4, 1.0, 0), (4, 1.0, 5, 1.0, 0, 0.0, 0), (9, 0.8, 3, 1.0, 0, 0.0, 0), (2, 1.0, 90, 0.0, 2, 1.0, 0), (3, 1.0, 48, 0.0, 3, 1.0, 0), (25, 0.8, 3, 1.0, 4, 1.0, 0),
    (7, 0.0, 60, 0.0, 0, 0.0, 0), (4, 0.0, 45, 0.0, 0, 0.0, 0), (10, 0.2, 80, 0.0, 0, 0.0, 0), (5, 0.4, 4, 1.0, 0, 0.0, 0), (6, 0.0, 3, 1.0, 0, 0.0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0), (4, 0.0, 1, 1.0, 3, 1.0, 0),
)


def _named(attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element's names mark furniture, readers' comments, or either."""
    kinds = [False] * 3
    for m in _NAMED.findall(attributes):
        for name in "".join(m).lower().split():
            parts = set(_PART.findall(name)) - NEUTRAL
            for i, words in enumerate((FURNITURE, READERS, FURNITURE | READERS | UNSURE)):
                kinds[i] |= bool(parts) and parts <= words
    return kinds[0], kinds[1], kinds[2]


def blocks_of(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words, linked words, place) of each flat block in page order.

    Character references are decoded after cutting, so they never make tags; white space inside a
    block becomes one space. As in browsers, comments, scripts and styles that are never closed end
    with the page; other elements that are never closed end where their block does. A name or
    element that holds the whole article says nothing about it.
    """
    out: list[tuple[str, int, int, int, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # element; 3 for furniture, 2 for a header, 1 for a name that hints; main
    buffer: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        words = "".join(buffer).split()
        if words:
            main = max((i for i, x in enumerate(stack) if x[2]), default=-1)
            kinds = [x[1] for x in stack[main + 1 :]]
            furniture = any(x[1] == 3 and x[0] in CHROME for x in stack) or 3 in kinds or 2 in kinds and main < 0
            place = FURNISHED if furniture else UNSAID if 1 in kinds or main < 0 else INSIDE
            out.append((" ".join(words), len(words), min(linked, len(words)), place, main >= 0))
        buffer.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            buffer.append(raw)
            if in_link:
                linked += len(raw.split())

    while at < len(page):
        tag = _TAG.search(page, at)
        if not tag:
            take(page[at:])
            break
        take(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if name == "a":
                in_link = False
            elif name in BLOCKS:
                flush()
                held = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
                if held >= 0:
                    del stack[held:]
            continue
        attributes = tag[3]
        if name in UNSEEN:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page) if name in ("script", "style") else at
            if name in ("head", "title"):
                flush()
        elif name == "a":
            in_link = True
        elif name == "br":
            buffer.append(" ")
        elif name in BLOCKS:
            flush()
            bare, readers, unsure = _named(attributes) if attributes and name not in ("body", "html") else (False, False, False)
            whole = name in MAIN and not readers
            kind = 0 if whole else 3 if readers or bare or name in CHROME - {"header"} else 2 if name == "header" else int(unsure)
            if (name in MAIN or name in HOLDERS or kind) and not attributes.endswith("/"):
                if name == "p":  # a paragraph ends where the next begins
                    stack[:] = [x for x in stack if x[0] != "p"]
                stack.append((name, kind, whole))
            elif name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
    flush()
    has_main = any(b[4] for b in out)
    return [(*b[:3], OUTSIDE if has_main and not b[4] and b[3] != FURNISHED else b[3]) for b in out]


def described(blocks: list[tuple[str, int, int, int]]) -> np.ndarray:
    """The features of a page's blocks; a missing neighbour counts as an empty one."""
    words = np.array([0, *(b[1] for b in blocks), 0], float)
    density = np.array([0, *(b[2] for b in blocks), 0], float) / np.maximum(words, 1)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], [b[3] for b in blocks]])


def grow(x: np.ndarray, y: np.ndarray) -> tuple:
    """A tree by Gini impurity: (feature, bound, low, high), or (label,) at a leaf."""
    best = None
    if y.min() != y.max():
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= cut
                cost = sum(part.mean() * (1 - part.mean()) * len(part) for part in (y[low], y[~low]))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(cut), low)
    if best is None:
        return (int(round(y.mean())),)
    _, f, cut, low = best
    return (f, cut, grow(x[low], y[low]), grow(x[~low], y[~low]))


@lru_cache(maxsize=1)
def tree() -> tuple:
    """The tree of the labelled table, in all places."""
    rows = np.array(LABELLED, float)
    x, y = rows[:, :-1], rows[:, -1]
    labels = {FURNISHED: 0 * y, OUTSIDE: 0 * y, UNSAID: y, INSIDE: 0 * y + 1}
    return grow(np.vstack([np.column_stack([x, np.full(len(x), place)]) for place in labels]), np.concatenate(list(labels.values())))


def decide(x: np.ndarray, node: tuple) -> np.ndarray:
    """Labels of rows by a tree."""
    if len(node) == 1:
        return np.full(len(x), node[0] == 1)
    low = x[:, node[0]] <= node[1]
    out = np.empty(len(x), bool)
    out[low], out[~low] = decide(x[low], node[2]), decide(x[~low], node[3])
    return out


def main_text(page: str) -> str:
    """The article's blocks joined by newlines; empty if there are none."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    kept = decide(described(blocks), tree())
    return "\n".join(b[0] for b, keep in zip(blocks, kept, strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row, repeated ones too; null and empty pages have an empty text. Other columns don't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in slices(batch, "html", 8 << 20):
                made = [main_text(data.decode("utf-8", "replace")) for data in held]
                part = batch.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = like(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    return picked.mapInArrow(run, f"page_id {picked.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
