"""Operator 8, HTML extraction: flat text blocks and a decision tree.

A page is read once into flat text blocks, one per run of text between block-level tags. A block is described by its
word count and link density, those of its neighbours, its place (in an article or main element, on a page without one,
outside of the page's one, in an element that is a menu, header, footer, sidebar or form by name) and whether a class
or id around it is a word like "ad" or "comments" as a whole. A decision tree, trained on the labelled table below, tells
main text from the rest; ``TRAINING`` is small and fixed, so the fit costs nothing.

Defined results: null, empty and text-free pages give the empty text. Unclosed tags, stray end tags and unclosed
quotes, comments or scripts never fail: what cannot be read as a tag is text, an unclosed comment, script or style
ends with the page. Repeated pages get equal results each.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Fixed lists of elements.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td"
    " tfoot th thead title tr ul".split())
RAW = frozenset("script style template iframe svg textarea select button title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
ASIDE = frozenset("nav footer aside form menu dialog head button select".split())
#: Classes and ids, as whole words, of parts that a page sets apart.
NAMED = frozenset(
    "ad ads advert adverts advertisement sponsored sidebar cookie-banner cookie-notice cookies notice popup newsletter comments comment"
    " comment-list reader-comments menu navbar breadcrumbs footer".split())
#: Where a block stands.
IN_SIDE, OUTSIDE, NO_MAIN, IN_MAIN = range(4)

#: Labelled blocks: words, link density, words and density of the block before and after, place, in a named part (0/1);
#: label 1 is main text.
TRAINING = (
    # menus and breadcrumbs
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (2, 1.0, 1, 1.0, 12, 0.0, 0, 0, 0), (3, 1.0, 2, 1.0, 2, 1.0, 2, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 2, 0, 0), (6, 0.9, 1, 1.0, 3, 1.0, 2, 0, 0), (12, 0.8, 10, 0.9, 9, 0.9, 2, 0, 0), (30, 0.9, 3, 1.0, 20, 0.7, 0, 0, 0),
    (6, 1.0, 80, 0.0, 6, 1.0, 2, 0, 0), (12, 0.9, 60, 0.0, 5, 1.0, 2, 0, 0), (4, 1.0, 50, 0.0, 3, 1.0, 2, 0, 0), (28, 0.8, 40, 0.0, 10, 0.9, 2, 0, 0),
    (2, 1.0, 80, 0.0, 1, 1.0, 0, 0, 0), (25, 0.6, 4, 1.0, 5, 1.0, 2, 0, 0), (8, 0.5, 2, 1.0, 2, 1.0, 2, 0, 0), (18, 0.45, 1, 1.0, 1, 1.0, 2, 0, 0),
    # menus and links without a hint, before or behind paragraphs
    (3, 1.0, 0, 0.0, 40, 0.0, 2, 0, 0), (3, 1.0, 0, 0.0, 13, 0.0, 2, 0, 0), (1, 1.0, 1, 1.0, 60, 0.0, 2, 0, 0), (2, 1.0, 2, 1.0, 25, 0.0, 2, 0, 0),
    (8, 0.9, 4, 1.0, 70, 0.0, 2, 0, 0), (5, 1.0, 0, 0.0, 110, 0.0, 2, 0, 0), (12, 0.8, 3, 1.0, 35, 0.0, 2, 0, 0), (2, 1.0, 4, 0.0, 0, 0.0, 2, 0, 0),
    (2, 1.0, 5, 0.0, 3, 1.0, 2, 0, 0), (4, 1.0, 35, 0.0, 50, 0.0, 2, 0, 0), (7, 0.7, 0, 0.0, 20, 0.0, 2, 0, 0), (2, 1.0, 90, 0.0, 40, 0.0, 2, 0, 0),
    # adverts, notices, sidebars, forms
    (8, 0.0, 1, 1.0, 12, 0.0, 2, 1, 0), (15, 0.0, 2, 1.0, 9, 0.0, 2, 1, 0), (40, 0.0, 8, 0.0, 60, 0.0, 2, 1, 0), (9, 0.2, 80, 0.0, 70, 0.0, 3, 1, 0),
    (25, 0.1, 120, 0.0, 90, 0.0, 3, 1, 0), (60, 0.0, 1, 1.0, 40, 0.0, 2, 1, 0), (5, 0.0, 3, 0.0, 2, 0.0, 2, 1, 0), (120, 0.05, 30, 0.0, 80, 0.0, 2, 1, 0),
    (3, 0.0, 1, 0.0, 1, 0.0, 2, 1, 0), (12, 0.0, 40, 0.0, 30, 0.0, 3, 1, 0), (20, 0.0, 1, 1.0, 2, 1.0, 2, 1, 0), (1, 0.0, 0, 0.0, 0, 0.0, 2, 1, 0),
    # footers and reader comments
    (11, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), (7, 0.3, 45, 0.0, 0, 0.0, 0, 0, 0), (55, 0.0, 90, 0.0, 70, 0.0, 0, 0, 0), (90, 0.0, 55, 0.0, 2, 0.0, 0, 0, 0),
    (4, 0.0, 90, 0.0, 55, 0.0, 0, 0, 0), (6, 0.0, 5, 0.0, 0, 0.0, 2, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 2, 0, 0), (9, 0.0, 4, 1.0, 3, 0.0, 2, 0, 0),
    (3, 0.0, 0, 0.0, 4, 0.5, 2, 0, 0), (5, 0.4, 40, 0.0, 0, 0.0, 2, 0, 0), (7, 0.0, 2, 1.0, 6, 0.0, 2, 0, 0),
    # blocks beside the page's article: adverts, notices, teasers, comments
    (8, 0.0, 1, 1.0, 12, 0.0, 1, 0, 0), (11, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0), (40, 0.0, 80, 0.0, 20, 0.0, 1, 0, 0), (3, 1.0, 2, 1.0, 90, 0.0, 1, 0, 0),
    (90, 0.0, 120, 0.0, 70, 0.0, 1, 0, 0), (5, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0), (20, 0.4, 40, 0.0, 12, 0.6, 1, 0, 0), (1, 0.0, 0, 0.0, 30, 0.0, 1, 0, 0),
    # adverts without a name between a menu and a headline
    (8, 0.0, 1, 1.0, 10, 0.0, 2, 0, 0), (11, 0.0, 2, 1.0, 12, 0.0, 2, 0, 0), (9, 0.0, 1, 1.0, 7, 0.0, 2, 0, 0), (12, 0.0, 1, 1.0, 6, 0.0, 2, 0, 0),
    # headlines and paragraphs of an article element
    (6, 0.0, 8, 0.0, 60, 0.0, 3, 0, 1), (1, 0.0, 6, 0.0, 80, 0.0, 3, 0, 1), (12, 0.0, 9, 0.0, 1, 0.0, 3, 0, 1), (80, 0.0, 12, 0.0, 40, 0.0, 3, 0, 1),
    (2, 0.0, 90, 0.0, 110, 0.0, 3, 0, 1), (1, 0.0, 1, 0.0, 1, 0.0, 3, 0, 1), (45, 0.3, 50, 0.1, 60, 0.0, 3, 0, 1), (5, 1.0, 60, 0.0, 80, 0.0, 3, 0, 1),
    (20, 0.5, 30, 0.2, 11, 0.0, 3, 0, 1), (150, 0.0, 90, 0.0, 11, 0.0, 3, 0, 1), (3, 0.0, 150, 0.0, 9, 0.2, 3, 0, 1), (8, 0.0, 0, 0.0, 0, 0.0, 3, 0, 1),
    (1, 1.0, 40, 0.0, 60, 0.0, 3, 0, 1), (2, 0.5, 1, 1.0, 3, 1.0, 3, 0, 1),
    # short paragraphs and last lines of pages without such an element
    (13, 0.0, 5, 0.0, 4, 0.0, 2, 0, 1), (13, 0.0, 0, 0.0, 4, 0.0, 2, 0, 1), (4, 0.0, 13, 0.0, 2, 1.0, 2, 0, 1), (5, 0.0, 30, 0.0, 2, 1.0, 2, 0, 1),
    (6, 0.0, 14, 0.0, 3, 1.0, 2, 0, 1), (15, 0.0, 3, 1.0, 6, 0.0, 2, 0, 1), (7, 0.0, 45, 0.0, 2, 1.0, 2, 0, 1), (12, 0.1, 20, 0.0, 9, 0.0, 2, 0, 1),
    (5, 0.0, 2, 1.0, 13, 0.0, 2, 0, 1), (4, 0.0, 3, 1.0, 30, 0.0, 2, 0, 1), (3, 0.0, 60, 0.0, 4, 1.0, 2, 0, 1), (14, 0.0, 12, 0.0, 13, 0.0, 2, 0, 1),
    # paragraphs of pages without such an element
    (60, 0.0, 8, 0.0, 75, 0.0, 2, 0, 1), (90, 0.05, 60, 0.0, 40, 0.1, 2, 0, 1), (35, 0.1, 5, 0.0, 80, 0.0, 2, 0, 1), (22, 0.0, 50, 0.0, 45, 0.0, 2, 0, 1),
    (120, 0.0, 3, 1.0, 2, 1.0, 2, 0, 1), (18, 0.0, 25, 0.0, 30, 0.0, 2, 0, 1), (6, 0.0, 2, 1.0, 70, 0.0, 2, 0, 1), (9, 0.0, 6, 0.0, 65, 0.0, 2, 0, 1),
    (8, 0.0, 60, 0.0, 75, 0.0, 2, 0, 1), (4, 0.0, 80, 0.0, 50, 0.0, 2, 0, 1), (40, 0.2, 30, 0.0, 2, 1.0, 2, 0, 1), (26, 0.0, 1, 1.0, 1, 1.0, 2, 0, 1),
)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "named")


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | float:
    """A CART: (feature, threshold, left, right) or the share of label 1; splits by the Gini index, ties to the first."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (2 * share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in ((values[1:] + values[:-1]) / 2).tolist():
            left = x[:, f] <= t
            cost = sum(2 * p * (1 - p) * len(part) for part in (y[left], y[~left]) for p in [part.mean()])
            if cost < best[0]:
                best = (cost, f, t)
    _, f, t = best
    if f < 0:
        return share
    left = x[:, f] <= t
    return f, t, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def train(rows=TRAINING) -> tuple | float:
    """The decision tree of a labelled table."""
    data = np.array(rows, float)
    return grow(data[:, :-1], data[:, -1])


def classify(tree, block) -> bool:
    while isinstance(tree, tuple):
        f, t, low, high = tree
        tree = low if block[f] <= t else high
    return tree > 0.5


def hint_of(name: str, attributes: str) -> str:
    """``main``, ``side``, ``header`` or nothing from an element's name, ``named`` from its class or id."""
    if name in MAIN:
        return "main"
    if name in ASIDE:
        return "side"
    if name == "header":
        return "header"
    for m in ATTRIBUTE.finditer(attributes):
        if not NAMED.isdisjoint((m.group(1) or m.group(2) or m.group(3) or "").lower().split()):
            return "named"
    return ""


class Tags:
    """Finds the tags of a page from left to right; every character is looked at a bounded number of times.

    A tag ends at the first > outside of quotes. Where the end cannot be found from some quote on, no later search
    that meets this quote tries again.
    """

    def __init__(self, page: str):
        self.page, self.special, self.hopeless, self.ends = page, -1, set(), {}

    def next_special(self, at: int) -> int:
        """Place of the next >, " or ' from a place on; the page's length if there is none."""
        if not (self.special >= at and self.asked <= at):
            m = SPECIAL.search(self.page, at)
            self.special, self.asked = (m.start() if m else len(self.page)), at
        return self.special

    def end_of_tag(self, at: int) -> int:
        """Place behind the > of a tag; -1 if it has none."""
        page, path = self.page, []
        while True:
            k = self.next_special(at)
            if k < len(page) and page[k] == ">":
                return k + 1
            close = -1 if k == len(page) or k in self.hopeless else page.find(page[k], k + 1)
            path.append(k)
            if close < 0:
                self.hopeless.update(path)
                return -1
            at = close + 1

    def find(self, what: str, at: int) -> int:
        """``str.find`` that remembers where there is nothing left to find."""
        if self.ends.get(what, len(self.page)) <= at:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.ends[what] = at
        return found

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the next tag; comments and declarations have no name."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, False, "", ""
            if page.startswith(("<!", "<?"), at):
                end = self.find(">", at)
                if end >= 0:
                    return at, end + 1, False, "", ""
            elif m := NAME.match(page, at):
                end = self.end_of_tag(m.end())
                if end >= 0:
                    return at, end, bool(m.group(1)), m.group(2).lower(), page[m.end():end - 1]
            at += 1
        return None


class Blocks:
    """The text blocks of a page as (text, words, link words, place, named)."""

    def __init__(self, page: str):
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.parts: list[str] = []
        self.links: list[str] = []
        self.open: list[tuple[str, str]] = []
        self.in_link = False
        at, end, tags, unended = 0, len(page), Tags(page), set()
        while at < end:
            tag = tags.next(at)
            if not tag:
                self.text(page[at:])
                break
            start, behind, closing, name, attributes = tag
            self.text(page[at:start])
            at = behind
            if not name:
                continue
            if closing:
                self.close(name)
            elif name in RAW and not attributes.endswith("/"):
                ended = None if name in unended else re.compile(f"</{name}", re.I | re.A).search(page, at)
                self.flush() if name in BLOCK else None
                if ended:
                    past = page.find(">", ended.start())
                    at = end if past < 0 else past + 1
                elif name in ("script", "style", "textarea", "title", "iframe"):
                    break
                else:
                    unended.add(name)
            else:
                self.start(name, attributes)
        self.flush()
        if not any(b[3] == IN_MAIN for b in self.blocks):
            self.blocks = [(*b[:3], NO_MAIN if b[3] == OUTSIDE else b[3], b[4]) for b in self.blocks]

    def text(self, raw: str) -> None:
        if raw:
            raw = html.unescape(raw)
            self.parts.append(raw)
            if self.in_link:
                self.links.append(raw)

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text(" ")
        if name == "a":
            self.in_link = True
        if name in BLOCK:
            self.flush()
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and self.open and self.open[-1][0] == name:
                self.open.pop()
        if name not in VOID and not attributes.endswith("/"):
            hint = hint_of(name, attributes)
            if hint == "header":
                hint = "" if any(h == "main" for _, h in self.open) else "side"
            if name in BLOCK or hint:
                self.open.append((name, hint))

    def close(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if name in BLOCK:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                if any(h for _, h in self.open[i:]):
                    self.flush()
                del self.open[i:]
                break

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            place, named = OUTSIDE, False
            for _, h in self.open:
                if h == "main":
                    place = IN_MAIN
                elif h == "side":
                    place = IN_SIDE
                named = named or h == "named"
            self.blocks.append((text, text.count(" ") + 1, len(" ".join(self.links).split()), place, named))
        self.parts, self.links = [], []


def main_text(page: str | None, tree) -> str:
    """The blocks of a page that the tree takes for main text, joined by line feeds."""
    if not page:
        return ""
    blocks = Blocks(page).blocks
    density = [min(1.0, b[2] / b[1]) for b in blocks]
    kept = []
    for i, (text, n, _, place, named) in enumerate(blocks):
        before = (blocks[i - 1][1], density[i - 1]) if i else (0, 0.0)
        after = (blocks[i + 1][1], density[i + 1]) if i + 1 < len(blocks) else (0, 0.0)
        if classify(tree, (n, density[i], *before, *after, float(place), float(named))):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    tree = train()

    def run(batches):
        for b in batches:
            texts = [main_text(t.as_py(), tree) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in p.schema.fields}
    return p.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
