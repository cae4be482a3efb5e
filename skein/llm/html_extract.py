"""Main-text extraction from web pages by classified text blocks.

A page is cut into flat blocks of text at its block-level tags.  Each block has its word
count and link density and those of its neighbours; as words alone cannot tell a cookie
notice from a short paragraph, it also has its standing (inside the page's main
container, outside it or in a container that says it is furniture) and whether it is a
heading.  A decision tree, trained below on a small table of labelled blocks in page
order, keeps or drops each block.
"""

from __future__ import annotations

import html
import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches

#: Names of elements, by what they hold.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER_TAGS = frozenset("article aside body details dialog div dl fieldset figure footer form head header main menu nav ol section table td ul".split())
#: Their content is no markup, and runs to the end of the page where they are not closed.
RAW_TAGS = frozenset("script style".split())
#: Their content is no text of the page; where they are not closed they are passed over.
SKIPPED_TAGS = frozenset("audio button canvas embed iframe math noscript object select svg template textarea title video".split())
FURNITURE_TAGS = frozenset("aside dialog footer form header menu nav".split())
MAIN_TAGS = frozenset("article main".split())
SPACE_TAGS = frozenset("br wbr img input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that containers are named by.
STRONG_NAMES = frozenset("ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies consent gdpr popup modal newsletter comment comments commentlist replies respond disqus".split())
WEAK_NAMES = frozenset("banner rail widget widgets foot header topbar privacy notice notices notification alert overlay subscribe subscription signup signin login register share sharing social follow related recommended recommendations recirculation reply discussion form search pagination pager copyright legal disclaimer skip toolbar paywall tags trending popular".split())
LISTING_NAMES = frozenset("area articles bar block box button buttons container content items links list news panel posts section stories story widget wrap wrapper".split())
NEGATIONS = frozenset("has no non not with without".split())
MAIN_NAMES = frozenset("article story content post entry body text main".split())
#: Of these, an own header or tags are part of the text.
STORY_NAMES = frozenset("article story post entry".split())
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/>]|$))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_TAG_STOP = re.compile(r">|=\s*([\"'])")

FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "standing", "heading")
TEXT_FEATURES = 6
#: The labelled table: pages as blocks in order.  A block is + (main text) or - (not), h for a heading, its words, / and how many of them
#: are linked, and a: inside the page's main container, o: outside it, f: in furniture; without a letter the page has no main container.
LABELLED = (
    # pages that name no container
    "-1/1 -1/1 -2/2 -1/1 -2 +h8 +60 +45 +30/3 +55 +12 +70 -4/4 -5/5 -3/3",
    "-3/3 -2/2 -1/1 +h6 +25 +8 +90/5 +40 +6 -1/1 -2/2 -1/1 -5",
    "-1/1 -1/1 -1/1 -1/1 -1/1 -3 +h11 +5 +120 +65 +80/10 -2 -8/8 -9/9 -7/7 -6",
    "-2/2 -2/2 +h5 +14 +22 +18 +35 +11 +28 -h2 -7/7 -6/6 -8/8 -4",
    "-12/11 -10/10 -14/14 +h9 +33/2 +47 +52/6 +20 -h3 -11/11 -13/13 -12/12 -9/9",
    "-1/1 -3/3 +80/8 +95 +60/2 +77 +33 -2/2 -1/1 -2/2",
    "+h7 +45 +50 +60 +20/2 +30 +25",
    "-4 -1/1 -1/1 -1/1 +h10 +38 +2 +41 +1 +66 +3 +50 -1/1 -1/1 -4 -3/3",
    "-6/6 -5/5 -7/7 -25/20 -30/26 -22/20 -18/18 -h2 -9/9 -8/8 -6/6",
    "-2/2 -3 -2/2 -4 -3/3 -5 -2/2 -3 -1/1",
    "-1/1 -2/2 -1/1 +h4 +16 +19 +h3 +27 +31/2 +h5 +44 +15/1 -3/3 -4/4 -2",
    "-1/1 -1/1 +150/4 +200/9 +180 -1/1 -1/1",
    "-5/4 -6/5 -4/4 +h6 +29 +13 +9 +17 +24 +7 -2/2 -3/2 -1/1 -8",
    "+h3 +4 +6 +5 +9",
    "-2/2 -2/2 -2/2 -2/2 +h12 +75/3 +58/5 +81/2 +39 +64/6 -1/1 -1/1 -1/1 -1/1 -3 -11",
    "-1/1 -2/2 +40 +h5 +50 +h4 +60 +35/3 -h2 -2/2 -2/2 -3/3",
    "-8/8 -7/7 -9/9 -40/38 -35/30 -50/46 -6/6 -5/5",
    "-3 -1/1 -1/1 +h9 +10 +48 +26 +53/12 +31 +5 -5/5 -1/1 -2/2",
    "-1/1 -1/1 -1/1 +h7 +55 +20/7 +62 +18/8 +49 -4/4 -6/6 -5/5 -2/2",
    "-2/2 +h8 +36 +42 -3/3 +57 +28 -2/2 +33 -1/1 -1/1 -2",
    # pages with a main container
    "-1/1o -1/1o -1/1o -2/2o -7o +h9a +60a +45a +3a +70/4a +12a -9f",
    "-2/2o -1/1o -5o +h12a +1a +30a +2a +40a +3/3a +25a +3a -1/1f -2/2f -6f",
    "-3/3f -1/1f -2/2f +h6a +80/5a +7a +20a +5a -3/3o -4/4o -4/4o -8o",
    "-1/1f -1/1f +h1a +3a +3a -4/4f -3/3f -2/2f",
    "-30f -1/1f -1/1f -9o +h5a +16a +h4a +33/5a +2a +44a +1a -25o -40f -35f -22f",
    "-2f -1/1o -1/1o +5a +3a +4a -7f -2/2f",
    "-1/1o -1/1a +h8a +4a +65a +50/6a +h3a +24a -3/3a -4/4a -5/5a -2/2o",
    "-2o -2/2o +h10o +52a +61a +29/4a +8a -h2o -7/7o -6/6o -30o -5o",
    "-12f -1/1f -3f +h7a +28a -20f +31a -15f +45a +6a -55f -60f -48f -70f",
    "-1/1f -2/2f +9a +11a +7a +3a +5a +4a -9/9f -4f",
    "-4o -18o -1/1o +h6a +90a +100/10a +85a +2a -50o -45o -60o -6f",
    "-3/3o -3/3o +h9a +2/2a +47a +12/12a +36a +10a -1/1o -12o",
    "-1/1f -1/1f -1/1f +h4a +1a +1a +2a +1a +2a -5f",
    "-2/2o -22o +h11a +6a +19a +27a +13/6a +38a -2a -3/3a -5/5a -6/6a -4o",
    "-1/1f -8f +h5a +8a +1a +10a +2a +5a +1a +6a +2a +4a +1a +5a +3a +2a +7a +1a -15f",
    "-2/2o +h9a +5a +5a +1a +1a +12a +4a +2a +2a +5a -3f",
    "-1/1f -2f +6a +5a +4a +3a +2a +1a +1a +2a +3a +4a +5a +6a -4o -2/2f",
    "-5f +h3a +200a +1a +150a +5a +1a +30a +2a +90a +4a +1a +5a -6f",
    "-1/1f -2/2f +h2a +33a +12a",
    "-1/1o -1/1o +h3a +50a +2a",
    "-1/1f -1/1f +2a +60a +20a",
    "-2/2f +h1a +8a +3a",
    "-1/1f -1/1f +1a +30a +16a",
    "-1/1 -1/1 +h2 +40 +33 +21 -1/1",
    "-2/2 -4/4 +h3 +28 +15 +44",
    "-1/1 -1/1 -3/3 +h1 +66 +31 -2/2",
    "-1/1f -1/1f +50a",
    "-2/2o -1/1f +5a",
    "-3/3f +120/4a",
    "-1/1f -1/1f +2a",
    "-1/1 -2/2 +90",
    "-3/3 -1/1 +40/3",
    "-1/1 -1/1 +140",
    "-1/1f -1/1f +h7a +40a +3a",
    "-2/2o -1/1o +h4a +2a",
    "-1/1f -4f +h8/8a +50a +9a +1a",
    "-1/1f -3/3f +h6/6a +22a +30a +4a",
    "-1/1o -1/1o +30a +6a",
    "-2f -2/2f +h5/5a +70a +8/2a +2a",
    "-1/1f +h9a +5a",
    "-1/1f -3/3f +1a",
    "-1/1f -1/1f +h6a +25a +18a +7a",
    "-1/1f -2/2o +3a +8a",
    "-1/1 -1/1 +h6 +30 +5 +1 +22 +4 +2 +41 +5 +2 +33 +1 +18 -2/2 -3/3",
)
#: Depth of the tree, and the blocks that a leaf is made of at least.
DEPTH, LEAF = 9, 3
_SPEC = re.compile(r"([+-])(h?)(\d+)(?:/(\d+))?([aof]?)")


class Tree:
    """Binary decision tree by Gini impurity; thresholds lie half-way between the values they part."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = DEPTH):
        self.label = bool(labels.mean() >= 0.5)
        self.feature = -1
        if not depth or labels.min() == labels.max():
            return
        own = len(labels) * labels.mean() * (1 - labels.mean())
        best = None
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for at in (values[1:] + values[:-1]) / 2:
                left = rows[:, f] < at
                if min(left.sum(), (~left).sum()) < LEAF:
                    continue
                impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (labels[left], labels[~left]))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, at)
        if best is None:
            return
        impurity, self.feature, self.at = best
        self.gain = own - impurity
        left = rows[:, self.feature] < self.at
        self.left, self.right = Tree(rows[left], labels[left], depth - 1), Tree(rows[~left], labels[~left], depth - 1)

    def keeps(self, row: tuple) -> bool:
        node = self
        while node.feature >= 0:
            node = node.left if row[node.feature] < node.at else node.right
        return node.label

    def importance(self) -> np.ndarray:
        """Impurity that each feature takes away, all told."""
        out = np.zeros(len(FEATURES))
        if self.feature >= 0:
            out[self.feature] += self.gain
            out += self.left.importance() + self.right.importance()
        return out


def labelled_rows(table: tuple = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """(features, 1 for main text) of the labelled blocks."""
    rows, labels = [], []
    for page in table:
        blocks = [_SPEC.fullmatch(b).groups() for b in page.split()]
        shapes = [(int(n), int(linked or 0) / int(n), {"a": 1, "": 0}.get(where, -1), h == "h") for _, h, n, linked, where in blocks]
        rows += features(shapes)
        labels += [sign == "+" for sign, *_ in blocks]
    return np.array(rows, float), np.array(labels, float)


def trained_tree(table: tuple = LABELLED) -> Tree:
    return Tree(*labelled_rows(table))


def features(shapes: list[tuple[int, float, int, bool]]) -> list[tuple]:
    """Rows in the order of FEATURES from (words, link density, standing, heading) of the blocks of a page."""
    padded = [(0, 0.0), *[s[:2] for s in shapes], (0, 0.0)]
    return [(s[0], s[1], *padded[i], *padded[i + 2], s[2], float(s[3])) for i, s in enumerate(shapes)]


def _is_furniture(token: str, in_main: bool) -> bool:
    """Whether a class or id names furniture: by its first or last word, so that `top-trending-story` does not."""
    parts = [w.lower() for w in _NAME.findall(token)]
    if not parts:
        return False
    first, last = parts[0], parts[-1]
    negated = any(w in NEGATIONS for w in parts[:-1])
    if last in STRONG_NAMES:
        return not negated
    if first in STRONG_NAMES:
        return last not in STORY_NAMES or first in ("sponsored", "promo", "comment", "comments", "sidebar")
    if last in ("header", "tags") and (in_main or first in STORY_NAMES):
        return False
    return (last in WEAK_NAMES and not negated) or (first in WEAK_NAMES and last in LISTING_NAMES and last not in MAIN_NAMES)


def _kind(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """(main, furniture) of a block-level element by its name and attributes."""
    main, furniture = tag in MAIN_TAGS, tag in FURNITURE_TAGS
    if tag == "header" and in_main:
        furniture = False  # an article's own header holds its title
    if tag in ("html", "body") or not attributes:
        return main, furniture
    container = tag in CONTAINER_TAGS and tag not in MAIN_TAGS
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for token in value.split():
                if not container:
                    # a paragraph, a heading or an article is furniture only by a name that says nothing else
                    furniture |= token.lower() in STRONG_NAMES
                elif _is_furniture(token, in_main):
                    furniture = True
                else:
                    main |= any(w.lower() in MAIN_NAMES for w in _NAME.findall(token))
        elif name == "role":
            furniture |= value.lower() in FURNITURE_ROLES
            main |= value.lower() in ("main", "article")
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            furniture = True
    return main and not furniture, furniture


class Scanner:
    """Texts and tags of a page, in time linear in its length whatever is left unclosed."""

    def __init__(self, page: str):
        self.page = page
        self._failed: set[int] = set()
        self._gone: dict[str, int] = {}
        self._closes: dict[str, dict[int, int]] = {}

    def closes(self, tag: str) -> dict[int, int]:
        """Where the elements of this name that are closed begin -> where their closing tag begins."""
        if tag not in self._closes:
            stack: list[int] = []
            found = self._closes[tag] = {}
            for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])", self.page, re.I):
                if not m[1]:
                    stack.append(m.start())
                elif stack:
                    found[stack.pop()] = m.start()
        return self._closes[tag]

    def _tag_end(self, at: int) -> int:
        """Where the `>` of a tag is, -1 if its quotes or it itself are not closed."""
        page, seen, start = self.page, [], at
        while True:
            m = _TAG_STOP.search(page, start)
            if m is None or m.start() in self._failed:
                break
            seen.append(m.start())
            if m[1] is None:
                return m.start()
            close = -1 if m.end() >= self._gone.get(m[1], len(page)) else page.find(m[1], m.end())
            if close < 0:
                self._gone[m[1]] = min(m.end(), self._gone.get(m[1], len(page)))
                break
            start = close + 1
        self._failed.update(seen)
        return -1

    def tokens(self) -> Iterator[tuple[str | None, bool, str, int]]:
        """(tag or None, closing, attributes or text, place)."""
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            open_ = page.find("<", at)
            if open_ != at:
                yield None, False, page[at : open_ if open_ >= 0 else end], at
                if open_ < 0:
                    return
                at = open_
            if page.startswith("<!--", at):
                close = at + 4 if page.startswith(">", at + 4) else page.find("-->", at + 4)
                if close < 0:
                    return
                at = close + (1 if page[close] == ">" else 3)
                continue
            if page.startswith(("<!", "<?"), at):
                close = page.find(">", at)
                if close < 0:
                    return
                at = close + 1
                continue
            m = _TAG_NAME.match(page, at + 1)
            if m is None:
                if page.startswith("</", at):  # a bogus comment
                    close = page.find(">", at)
                    if close < 0:
                        return
                    at = close + 1
                else:
                    yield None, False, "<", at
                    at += 1
                continue
            stop = self._tag_end(m.end())
            if stop < 0:
                stop = page.find(">", m.end())
                if stop < 0:
                    return  # the page ends inside a tag
            tag, closing, attributes = m[1].lower(), page[at + 1] == "/", page[m.end() : stop]
            place, at = at, stop + 1
            if not closing and tag in RAW_TAGS:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                if close is None:
                    return
                at = close.start()
                yield tag, False, attributes, place
                continue
            if not closing and tag in SKIPPED_TAGS:
                close = -1 if attributes.endswith("/") else self.closes(tag).get(place, -1)
                at = max(at, close)
            yield tag, closing, attributes, place


def blocks_of(page: str) -> list[tuple[str, float, bool, bool, bool]]:
    """(text, link density, main, furniture, heading) of the flat blocks of a page, in order."""
    out: list[tuple[str, float, bool, bool, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, bool]] = []
    main = furniture = by_form = own_furniture = heading = False
    link_end = -1
    scanner = Scanner(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, min(1.0, linked / (text.count(" ") + 1)), main, furniture or own_furniture, heading))
            parts.clear()
        linked = 0

    for tag, closing, rest, place in scanner.tokens():
        if tag is None:
            parts.append(rest)
            if place < link_end:
                linked += len(html.unescape(rest).split())
        elif tag == "a":
            if not closing and "href" in rest.lower():
                link_end = max(link_end, scanner.closes("a").get(place, -1))
        elif tag in SPACE_TAGS:
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            own_furniture = False
            heading = tag in HEADINGS and not closing
            if tag in CONTAINER_TAGS and closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        _, main, furniture, by_form = stack[i]
                        del stack[i:]
                        break
            elif tag in CONTAINER_TAGS:
                stack.append((tag, main, furniture, by_form))
                is_main, is_furniture = _kind(tag, rest, main)
                if tag in MAIN_TAGS and by_form and not is_furniture:
                    main = furniture = by_form = False  # a form around the whole page
                by_form = (by_form or (tag == "form" and not furniture)) and not (is_furniture and tag != "form")
                main, furniture = main or is_main, furniture or is_furniture
            elif rest and not closing:
                own_furniture = _kind(tag, rest, main)[1]
    flush()
    return out


def main_text(page: str | None, tree: Tree) -> str:
    blocks = blocks_of(page) if page else []
    words = [b[0].count(" ") + 1 for b in blocks]
    inside = outside = 0.0
    for n, (_, links, main, furniture, _) in zip(words, blocks, strict=True):
        if not furniture:
            inside, outside = inside + n * (1 - links) * main, outside + n * (1 - links) * (not main)
    other = -1 if inside and inside >= outside else 0
    shapes = [(n, links, -1 if furniture else 1 if main else other, heading) for n, (_, links, main, furniture, heading) in zip(words, blocks, strict=True)]
    return "\n".join(b[0] for b, row in zip(blocks, features(shapes), strict=True) if tree.keeps(row))


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; a null or blank page has an empty text.

    Unclosed and stray tags are taken as they come; repeated rows each give a row.
    """
    bound_batches(pages.sparkSession)
    shipped = pages.sparkSession.sparkContext.broadcast(cloudpickle.dumps(trained_tree()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = pickle.loads(shipped.value)
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kind = dict(slim.dtypes)["page_id"]
    return slim.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
