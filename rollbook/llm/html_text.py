"""HTML extraction: flat text blocks, judged by word count and link density of each and its
neighbours, and by where they stand.

A page is cut into blocks at block-level tags. A decision tree, fitted when first used to the small
labelled table EXAMPLES, says which blocks are main text. Tags need not be closed or well formed:
a closing tag closes everything opened since its opening one, and one that closes nothing is
ignored. Comments and elements without running text (scripts, styles, forms' fields) are left out.
A comment, script or other element of raw text that is never closed ends the page; a drawing, button
or player that is never closed ends at the next block tag, so that the text after it stays. A link
may span blocks; it ends with the block that it began in.

Null and empty pages have the empty text, an empty table an empty result. Repeated rows are extracted
each. Columns of the input are kept; one of the name of the result is replaced.
"""

from __future__ import annotations

import html
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is no running text (raw text, drawings and fields, players with
# a replacement), tags that end a block, and containers.
HIDDEN = "script|style|noscript|template|title|textarea|iframe"
DRAWN = "select|button|svg|math"
PLAYED = "object|canvas|audio|video"
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
CONTAINERS = set(
    "article aside blockquote body details dialog div dl fieldset figure footer form header html main nav ol section "
    "table td tr ul".split())
SIDE_TAGS = set("nav footer aside form dialog fieldset".split())
# Parts of class, id and role that mark what is not the article.
SIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary contentinfo consent cookie cookies dialog disqus disclaimer footer form gdpr hidden login masthead "
    "menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription syndication tags toc toolbar topbar widget widgets alert".split())

_REST = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*"


def _until(name: str, stops: str) -> str:
    """From an opening tag to its closing one; up to the next block tag if one of `stops` opens first."""
    block = r"</?(?:" + "|".join(sorted(BLOCKS)) + r")\b"
    return (rf"(?:(?:[^<]|<(?!(?:{stops})\b|/{name}\s*>))*+</{name}\s*>|(?:[^<]|<(?!{block[1:]}))*+)")


_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<hidden>" + HIDDEN + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=hidden)\s*>|\Z)"
    rf"|<(?P<drawn>{DRAWN})\b{_REST}(?:(?<=/)>|>"
    + _until("(?P=drawn)", "(?P=drawn)|p|h[1-6]|article|section|main|header|footer|nav|body|li|tr") + ")"
    rf"|<(?P<played>{PLAYED})\b{_REST}(?:(?<=/)>|>" + _until("(?P=played)", "(?P=played)") + ")"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

#: What the tree sees of a block.
MEASURES = ["words", "link density", "words before", "link density before", "words after", "link density after",
            "side", "place"]
INSIDE, OUTSIDE, NOWHERE = 0, 1, 2  # in the article; beside one; on a page that marks none

#: Labelled blocks, in the order of MEASURES, with 1 for main text.
EXAMPLES = [
    # In a marked article: text of any length, whatever its neighbours.
    (120, 0.0, 40, 0.0, 80, 0.0, 0, INSIDE, 1), (60, 0.05, 0, 0.0, 90, 0.0, 0, INSIDE, 1),
    (1, 0.0, 50, 0.0, 60, 0.0, 0, INSIDE, 1), (2, 0.0, 1, 0.0, 1, 0.0, 0, INSIDE, 1),
    (8, 0.0, 0, 0.0, 30, 0.0, 0, INSIDE, 1), (5, 0.0, 6, 1.0, 44, 0.0, 0, INSIDE, 1),
    (35, 0.1, 12, 0.0, 9, 0.0, 0, INSIDE, 1), (14, 0.25, 33, 0.0, 21, 0.1, 0, INSIDE, 1),
    (3, 0.0, 3, 0.0, 10, 0.2, 0, INSIDE, 1), (200, 0.0, 7, 0.0, 7, 0.0, 0, INSIDE, 1),
    (6, 0.5, 60, 0.0, 70, 0.0, 0, INSIDE, 1), (22, 0.4, 90, 0.0, 5, 0.0, 0, INSIDE, 1),
    # In a marked article: text that a menu, a list of links or a footer of links follows or surrounds.
    (40, 0.0, 5, 1.0, 1, 1.0, 0, INSIDE, 1), (20, 0.0, 60, 0.0, 3, 1.0, 0, INSIDE, 1),
    (12, 0.0, 2, 1.0, 2, 1.0, 0, INSIDE, 1), (150, 0.02, 33, 0.0, 4, 0.9, 0, INSIDE, 1),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, INSIDE, 1), (1, 0.0, 9, 0.0, 2, 1.0, 0, INSIDE, 1),
    (9, 0.3, 2, 1.0, 4, 1.0, 0, INSIDE, 1), (25, 0.25, 80, 0.0, 1, 1.0, 0, INSIDE, 1),
    # In a marked article: lists of links.
    (3, 1.0, 4, 1.0, 2, 1.0, 0, INSIDE, 0), (6, 1.0, 3, 1.0, 5, 1.0, 0, INSIDE, 0),
    (2, 1.0, 60, 0.0, 3, 1.0, 0, INSIDE, 0), (9, 0.9, 2, 1.0, 4, 1.0, 0, INSIDE, 0),
    (1, 1.0, 1, 1.0, 0, 0.0, 0, INSIDE, 0), (4, 1.0, 5, 1.0, 7, 0.0, 0, INSIDE, 0),
    # In side elements: menus, adverts, notices, forms, comments.
    (1, 1.0, 0, 0.0, 1, 1.0, 1, OUTSIDE, 0), (7, 0.0, 1, 1.0, 12, 0.0, 1, OUTSIDE, 0),
    (45, 0.0, 80, 0.0, 30, 0.0, 1, INSIDE, 0), (30, 0.1, 22, 0.0, 18, 0.0, 1, INSIDE, 0),
    (12, 0.0, 140, 0.0, 0, 0.0, 1, OUTSIDE, 0), (25, 0.0, 3, 1.0, 60, 0.0, 1, OUTSIDE, 0),
    (90, 0.0, 40, 0.0, 70, 0.0, 1, NOWHERE, 0), (15, 0.3, 90, 0.0, 2, 1.0, 1, NOWHERE, 0),
    (3, 0.0, 100, 0.0, 50, 0.0, 1, INSIDE, 0), (150, 0.0, 60, 0.0, 0, 0.0, 1, INSIDE, 0),
    (2, 0.0, 5, 0.0, 9, 0.0, 1, NOWHERE, 0), (60, 0.0, 10, 0.0, 33, 0.0, 1, OUTSIDE, 0),
    # Beside a marked article.
    (40, 0.0, 20, 0.0, 60, 0.0, 0, OUTSIDE, 0), (6, 0.0, 2, 1.0, 70, 0.0, 0, OUTSIDE, 0),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, OUTSIDE, 0), (80, 0.0, 120, 0.0, 8, 0.0, 0, OUTSIDE, 0),
    (10, 0.2, 50, 0.0, 4, 0.5, 0, OUTSIDE, 0), (130, 0.0, 0, 0.0, 0, 0.0, 0, OUTSIDE, 0),
    # On a page that marks no article: long blocks with few links, and short ones among them.
    (90, 0.0, 60, 0.0, 75, 0.0, 0, NOWHERE, 1), (40, 0.1, 3, 1.0, 55, 0.0, 0, NOWHERE, 1),
    (18, 0.0, 0, 0.0, 0, 0.0, 0, NOWHERE, 1), (25, 0.0, 70, 0.0, 4, 0.0, 0, NOWHERE, 1),
    (4, 0.0, 60, 0.0, 45, 0.0, 0, NOWHERE, 1), (7, 0.0, 5, 0.2, 80, 0.0, 0, NOWHERE, 1),
    (2, 0.0, 33, 0.0, 50, 0.0, 0, NOWHERE, 1), (9, 0.0, 28, 0.0, 18, 0.0, 0, NOWHERE, 1),
    (16, 0.2, 20, 0.0, 22, 0.1, 0, NOWHERE, 1), (5, 0.0, 2, 1.0, 31, 0.0, 0, NOWHERE, 1),
    (4, 0.0, 70, 0.0, 3, 0.0, 0, NOWHERE, 1), (3, 0.0, 40, 0.0, 2, 0.0, 0, NOWHERE, 1),
    (70, 0.0, 40, 0.0, 1, 1.0, 0, NOWHERE, 1), (30, 0.0, 3, 1.0, 2, 1.0, 0, NOWHERE, 1),
    (18, 0.05, 55, 0.0, 4, 1.0, 0, NOWHERE, 1), (110, 0.1, 2, 1.0, 3, 1.0, 0, NOWHERE, 1),
    (14, 0.0, 25, 0.0, 3, 1.0, 0, NOWHERE, 1), (45, 0.0, 6, 0.9, 5, 0.8, 0, NOWHERE, 1),
    # ... and its menus, bylines and lists of links.
    (1, 1.0, 1, 1.0, 1, 1.0, 0, NOWHERE, 0), (3, 1.0, 2, 1.0, 60, 0.0, 0, NOWHERE, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, NOWHERE, 0), (20, 0.8, 60, 0.0, 10, 0.9, 0, NOWHERE, 0),
    (6, 0.0, 4, 0.0, 3, 0.5, 0, NOWHERE, 0), (2, 0.0, 3, 0.0, 4, 0.0, 0, NOWHERE, 0),
    (30, 0.7, 5, 1.0, 12, 0.9, 0, NOWHERE, 0), (5, 1.0, 80, 0.0, 70, 0.0, 0, NOWHERE, 0),
    (5, 0.0, 6, 0.0, 6, 0.0, 0, NOWHERE, 0), (8, 0.0, 3, 0.4, 2, 1.0, 0, NOWHERE, 0),
]


def _grow(x: np.ndarray, y: np.ndarray):
    """A tree of (measure, border, below, above), or a share of main text; splits lower the Gini sum most."""
    share = y.mean()
    best = (share * (1 - share) * len(y) - 1e-9, None)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for border in (values[1:] + values[:-1]) / 2:
            low = x[:, k] < border
            a, b = y[low], y[~low]
            left = a.mean() * (1 - a.mean()) * len(a) + b.mean() * (1 - b.mean()) * len(b)
            if left < best[0]:
                best = (left, (k, border, low))
    if best[1] is None:
        return float(share)
    k, border, low = best[1]
    return k, float(border), _grow(x[low], y[low]), _grow(x[~low], y[~low])


@cache
def tree():
    table = np.array(EXAMPLES, float)
    return _grow(table[:, :-1], table[:, -1])


def is_main(measures: tuple) -> bool:
    node = tree()
    while not isinstance(node, float):
        node = node[2] if measures[node[0]] < node[1] else node[3]
    return node > 0.5


def blocks(page: str) -> list[tuple[str, int, float, int, int]]:
    """(text, words, link density, side, place) of every block with text, in page order."""
    out: list[list] = []
    stack: list[tuple[str, bool, bool]] = []  # element, side or within one, article or within one
    parts: list[str] = []
    linked: list[str] = []
    in_link = marked = False
    leaf = link_leaf = None  # the block within the container, and the one the link began in
    link_depth = 0
    at = 0

    def end_block() -> None:
        nonlocal parts, linked, in_link
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = text.count(" ") + 1
            links = len(html.unescape(" ".join(linked)).split())
            side, inside = stack[-1][1:] if stack else (False, False)
            out.append([text, words, min(1.0, links / words), int(side), INSIDE if inside else OUTSIDE])
        parts, linked = [], []

    def take(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)

    for m in _TAG.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if name == "a":
            in_link = not m["close"]
            link_leaf, link_depth = leaf, len(stack)
        if name not in BLOCKS:
            continue
        end_block()
        if name not in CONTAINERS:
            if name not in ("br", "hr"):
                in_link = in_link and name != link_leaf
                leaf = None if m["close"] else name
            continue
        leaf = None
        if m["close"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
            in_link = in_link and len(stack) >= link_depth
            continue
        side, inside = stack[-1][1:] if stack else (False, False)
        names = {p for found in _NAMED.findall(m["rest"] or "") for p in re.split(r"[^a-z]+", "".join(found).lower())}
        article = name in ("article", "main") or "main" in names and name != "body"
        side = (side or name in SIDE_TAGS or name == "header" and not inside
                or bool(names & SIDE_NAMES) and name not in ("body", "html")
                or bool(m["rest"]) and bool(_UNSEEN.search(m["rest"])))
        article = article and not side
        marked = marked or article
        stack.append((name, side, inside or article))
    take(page[at:])
    end_block()
    return [(t, w, d, s, p if marked else NOWHERE) for t, w, d, s, p in out]


def main_text(page: str) -> str:
    found = blocks(page)
    kept = []
    for i, (text, words, density, side, place) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        if is_main((words, density, *before, *after, side, place)):
            kept.append(text)
    return "\n".join(kept)


def extracted(pages: DataFrame, html_column: str = "html", *, text_column: str = "text") -> DataFrame:
    """`pages` with the main text of each."""
    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py() or "") for p in column], pa.string())

    return pages.withColumn(text_column, of(F.col(html_column)))
