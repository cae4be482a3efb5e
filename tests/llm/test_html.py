"""HTML extraction: blocks against the standard library's parser, the tree, hostile markup and edge cases."""

import random
import time
from html.parser import HTMLParser

import numpy as np
from skein.llm import html_extract as H
from skein.llm import queries as Q

from .. import oracle

LONG = "A paragraph of the story that goes on for long enough to be told from a menu"
TREE = H.trained_tree()


class Blocks(HTMLParser):
    """Brute-force splitter of well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.skip = [], [], 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in H.RAW_TAGS | H.SKIPPED_TAGS:
            self.skip += 1
        elif tag in H.BLOCK_TAGS and not self.skip:
            self.flush()
        elif tag in H.SPACE_TAGS and not self.skip:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in H.RAW_TAGS | H.SKIPPED_TAGS:
            self.skip -= 1
        elif tag in H.BLOCK_TAGS and not self.skip:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def random_page(rng, depth=4):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(["word", "two words", "a &amp; b", "&eacute;&#233;&nbsp;x", "1 < 2 ", " \n ", "x<br>y", "<b>bo</b>ld", "<!-- <p>no --> z", "<a href='/x?a=1&gt;2'>link</a>", "<a name=q>anchor</a>", "<script>var a='</p>' < 3;</script>", "<style>p{}</style>"])
    tag = rng.choice(["div", "p", "section", "article", "ul", "li", "h2", "table", "td", "span", "i", "nav", "aside", "select", "button", "svg"])
    attributes = rng.choice(["", " class=x", ' title="a > b"', " id='it\"s'", ' data-x="<p>"', " hidden"])
    return f"<{tag}{attributes}>" + "".join(random_page(rng, depth - 1) for _ in range(rng.randrange(4))) + f"</{tag}>"


def test_blocks_equal_those_of_the_standard_parser():
    rng = random.Random(3)
    for _ in range(400):
        page = "<html><body>" + "".join(random_page(rng) for _ in range(3)) + "</body></html>"
        brute = Blocks()
        brute.feed(page)
        brute.close()
        brute.flush()
        assert [b[0] for b in H.blocks_of(page)] == brute.out, page


def test_tree_decides_by_words_and_links():
    rows, labels = H.labelled_rows()
    assert len(rows) >= 500
    assert np.mean([TREE.keeps(tuple(r)) == bool(y) for r, y in zip(rows, labels, strict=True)]) > 0.98
    gain = TREE.importance()
    assert TREE.feature < H.TEXT_FEATURES and gain[: H.TEXT_FEATURES].sum() > 0.6 * gain.sum()
    # the same page without a single telling name
    menu = "".join(f"<div><a href=/{i}>Item {i}</a></div>" for i in range(6))
    page = f"<body>{menu}<div>{LONG}.</div><div>Short one here too.</div><div>{LONG} <a href=x>linked</a>.</div>{menu}</body>"
    assert H.main_text(page, TREE) == f"{LONG}.\nShort one here too.\n{LONG} linked."


def test_every_block_of_a_main_container_that_is_no_link_is_kept():
    around = [(0, 0.0), (1, 0.0), (3, 0.0), (9, 0.0), (40, 0.0), (300, 0.0), (1, 1.0), (3, 1.0)]
    for n in (1, 2, 3, 4, 5, 7, 12, 30, 90, 400):
        for before in around:
            for after in around:
                for heading in (0.0, 1.0):
                    assert TREE.keeps((n, 0.0, *before, *after, 1, heading)), (n, before, after)


def article(body, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var x = '<p>no</p>';</script></head><body>{before}<article>{body}</article>{after}</body></html>"


MENU = "<nav><a href=/>Home</a> <a href=/b>About us</a></nav>"
PAGES = [
    (article("<h1>Head</h1><p>First short paragraph.</p><p>Last short paragraph.</p>", after=MENU), "Head\nFirst short paragraph.\nLast short paragraph."),
    (article("<h1>Head</h1><p>One.</p><p>End.</p>", before=MENU), "Head\nOne.\nEnd."),
    (article(f"<p>{LONG}</p>", before=MENU), LONG),
    (f"<body>{MENU}<div class=top-trending-story><h1>Head</h1><p class=text-form-a>{LONG}</p><p>{LONG}.</p></div></body>", f"Head\n{LONG}\n{LONG}."),
    *[(article(f"<{t}>Label<p>{LONG}</p><p>End.</p>", before=MENU), f"Label\n{LONG}\nEnd.") for t in ("button", "select", "title", "textarea", "svg")],
    (article(f"<p>{LONG} <button>Share</button><select><option>1</select>.</p>"), f"{LONG} ."),
    (article(f"<p>{LONG}</p><aside><p>{LONG} x</p></aside><section class='reader-comments'><p>{LONG} y</p></section><p>End of it.</p>"), f"{LONG}\nEnd of it."),
    (article(f"<p>{LONG}</p>", before=f"<div class='cookie-notice'>{LONG} z</div>", after=f"<div class=adbox>{LONG}</div><footer><p>{LONG}</p></footer>"), LONG),
    (article(f"<p>{LONG}</p>", before="<div class='ad'>Buy it now.</div>", after="<footer>&copy; us &middot; all of it.</footer>"), LONG),
    (f"<form id=page>{MENU}<main><h1>In a form</h1><p>{LONG}</p></main></form>", f"In a form\n{LONG}"),
    (f"<div class='layout has-sidebar'><div id=content><h2>Title</h2><p>{LONG}</p><p>{LONG}!</p></div><div class=sidebar><p>{LONG}</p></div></div>", f"Title\n{LONG}\n{LONG}!"),
    (article(f"<p class=x title='unclosed>{LONG}</p><p>{LONG}</p>"), f"{LONG}\n{LONG}"),
]


def test_pages():
    for page, text in PAGES:
        assert H.main_text(page, TREE) == text, page


def test_hostile_pages_take_linear_time():
    for unit in ("<a href='", "<a href='>", "<button>", '<a b=">" ', "<a href=x>", "<!--", "<p class=\"x'>", "<script>", "</p", "<a =  '", "<svg><svg>", "&amp", "<div>", "</div>"):
        began = time.process_time()
        H.main_text(unit * (1_000_000 // len(unit)), TREE)
        assert time.process_time() - began < 5, unit


def test_repeated_rows_and_clashing_columns(spark):
    page = article(f"<p>{LONG}</p>")
    rows = spark.createDataFrame([(1, "u", page, "x", 2), (1, "u", page, "x", 2), (None, None, None, None, None), (2, "v", article(f"<p>{LONG}</p>" * 20_000), "", 0)], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in H.extract(rows).collect()), key=lambda r: (r[0] is None, r))
    assert got[:2] == [(1, "u", LONG, len(LONG))] * 2 and got[3] == (None, None, "", 0)
    assert got[2][2] == "\n".join([LONG] * 20_000)


def test_query_on_the_pages_table(spark):
    """The articles of the synthetic pages, cut out by their tags."""
    oracle.connect()
    pages = spark.read.parquet(f"{oracle.DATA}/pages.parquet").collect()
    want = {}
    for r in pages:
        body = (r.html or "").partition("<article>")[2].partition("</article>")[0]
        brute = Blocks()
        brute.feed(body)
        brute.close()
        brute.flush()
        want[r.page_id] = "\n".join(brute.out)
    got = {r.page_id: r.text for r in Q.queries()["op9_html_extraction"](spark, oracle.DATA).collect()}
    assert got == want
