"""Search, URL filters, HTML and mixing against brute force, with edge cases; and the pipeline."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import html_extract, mixing, topk, url_filter
from skein.llm import queries as Q


def brute_top(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, w in good:
        if q % 50 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(w, c, strict=False)), i) for i, c in good if i != q)
            out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


def search(spark, rows):
    out = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_WEIGHTS", 17)
    monkeypatch.setattr(topk, "STRIP", 2)
    monkeypatch.setattr(topk, "BATCH", 40)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.where(rng.random(8) < 0.4, 0, rng.normal(size=8))]) for i in range(300)]
    rows[10] = (10, None)
    rows[20] = (20, [1.0, None, 2.0])
    rows[30] = (30, [float("nan")] * 8)
    rows[60:70] = [(i, rows[5][1]) for i in range(60, 70)]
    rows[50] = (50, [])
    assert search(spark, rows) == brute_top(rows)


def test_top_k_edges(spark):
    assert search(spark, []) == {}
    assert search(spark, [(0, [1.0])]) == {}
    assert search(spark, [(0, [1.0]), (1, [2.0]), (1, [2.0]), (None, [3.0])]) == {0: [(1, 256 * 512)]}
    huge = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0])]
    assert search(spark, huge) == {0: [(1, (1 << 63) - 1), (2, -(1 << 63))]}


def test_url_rules(spark):
    cases = {
        "https://X.Example.com/en/1?a=/b": ("x.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.net/es/2#x": ("a.net", "/es/2", "net/es/", "block"),
        "http://a.com": ("a.com", "", None, "allow"),
        "http://a.com/": ("a.com", "/", "com/", "allow"),
        "xcom://notcom/": ("notcom", "/", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b://c": ("b:", "//c", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "p") for i, u in enumerate(cases)], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels).collect()}
    assert got == dict(enumerate(cases.values()))


def test_reputation_shrinks_and_blocks(spark):
    rows = [(f"spam{i}.evil.org", 20.0, 20.0) for i in range(3)] + [("new.evil.org", 0.0, 1.0)] + [(f"h{i}.good.org", 1.0, 50.0) for i in range(5)]
    got = {r.host: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, bad double, n double")).collect()}
    assert got["spam0.evil.org"].lower_bound > 0.5 > got["h0.good.org"].lower_bound
    assert got["spam0.evil.org"].overall == pytest.approx(66 / 313)
    assert 0 < got["new.evil.org"].posterior < got["spam0.evil.org"].posterior
    assert got["new.evil.org"].posterior > got["h0.good.org"].posterior


def test_hosts_worse_than_the_whole_are_blocked(spark):
    rows = [(i, f"http://{'bad.example.org' if i % 3 == 0 else f'h{i % 7}.org'}/{i}") for i in range(120)] + [(900, "http://unknown.test/")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0 and i % 2)) for i in range(120)], "doc_id bigint, toxic int")
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = {r.host: r.verdict for r in url_filter.filter_urls(pages, labels, rules=()).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"bad.example.org"}
    assert {r.verdict for r in url_filter.filter_urls(pages, labels, rules=(), limit=0.9).collect()} == {"allow"}


def test_reputation_ignores_null_labels_and_repeats(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (2, "http://b.org/")], "page_id bigint, url string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id bigint, toxic int")
    assert [r.verdict for r in url_filter.filter_urls(pages, labels).collect()] == ["allow"] * 3
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var x = '<p>no</p>';</script></head><body>{body}</body></html>"


LONG = "A paragraph of the story that goes on for long enough to be told from a menu"
PAGES = [
    (page(f"<nav><a href=/>Home</a></nav><article><h1>Head &amp; line</h1><p>{LONG}.</p><p>Short\n  one.</p></article><footer>&copy; x</footer>"), f"Head & line\n{LONG}.\nShort one."),
    (page(f"<div class='cookie-banner'>{LONG}</div><main><p>{LONG} <b>bold</b> and <a href=x>linked</a>.</p><div class=ad>{LONG}</div><p>End.</p></main>"), f"{LONG} bold and linked.\nEnd."),
    (page(f"<article><p>{LONG}.<p>Unclosed &eacute;&#233;<br>text</article><section id=comments><p>{LONG}</p></section>"), f"{LONG}.\nUnclosed éé text"),
    (page(f"<header><h1>Site</h1></header><div class=content><h2>Title</h2><p>{LONG}.</p><form><p>{LONG}</p></form><aside><p>{LONG}</p></aside></div>"), f"Title\n{LONG}."),
    (page(f"<article><header class='entry-header'><h1>Own header</h1></header><p>{LONG}.</p><ul><li>One</li><li>Two</li></ul></article>"), f"Own header\n{LONG}.\nOne\nTwo"),
    (None, ""),
    ("", ""),
    ("<p", ""),
    (page("<nav>" + "<a href=/>Menu item</a> " * 9 + "</nav>"), ""),
]


def test_main_text(spark):
    rows = spark.createDataFrame([(i, "u", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id bigint, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(rows).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert html_extract.extract(rows.limit(0)).count() == 0


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, full, goal = {}, set(), 1.5 * sum(sizes.values())
    while True:
        rest = goal - sum(2 * sizes[s] for s in full)
        share = sum(w[s] for s in sizes if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * w[s] / share for s in sizes}
        over = {s for s in sizes if target[s] > 2 * sizes[s]}
        if not over - full:
            return target
        full |= over


def test_mixing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(700):
        source = [None, "b", "a", "ä", "hot"][min(4, int(rng.integers(0, 9)))]
        rows.append((i, None if i % 50 == 0 else "w " * int(rng.integers(0, 12)), source, 5))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size bigint")
    out = mixing.mix(docs, fan_in=16).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target, taken = brute_targets(sizes), {}
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 12 for s in sizes)  # the longest document
    again = mixing.mix(docs.repartition(7), fan_in=16).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in out}


def test_each_document_keeps_its_probability(spark):
    sizes = [1, 2, 3, 5, 8, 13, 40, 90, 90, 400, 7, 7]
    n = 240
    docs = spark.createDataFrame([(100 * s + j, "w " * size, f"s{s:03}") for s in range(n) for j, size in enumerate(sizes)], "doc_id bigint, text string, source string")
    for fan_in in (256, 4):  # one block a source, and a tree
        out = mixing.mix(docs, fan_in=fan_in).collect()
        copies, rate = np.zeros((n, len(sizes))), {}
        for r in out:
            copies[r.doc_id // 100, r.doc_id % 100] = r.copies
            rate[r.doc_id // 100] = r.target / r.source_size
        for w in {round(x, 9) for x in rate.values()}:
            own = [s for s in range(n) if round(rate[s], 9) == w]
            f = w - math.floor(w)
            error = np.abs(copies[own].mean(axis=0) - w)
            assert (error <= 4.5 * math.sqrt(f * (1 - f) / len(own)) + 1e-9).all(), (fan_in, w, error)


def test_targets_of_sources_of_many_levels(spark):
    rows = [(i, "w " * (1 << min(i, 17) // 2 if i else 1), f"s{i:02}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    target = brute_targets({s: len(t.split()) for _, t, s in rows})
    assert {r.source: r.target for r in mixing.mix(docs).collect()} == pytest.approx(target)


def test_mixed_corpus_holds_each_document_as_often_as_taken(spark):
    rows = [(i, "w " * (1 + i % 9) if i % 11 else None, f"s{i % 4}" if i % 4 else None, i, "own") for i in range(200)]
    rows += [(5, rows[5][1], "s1", 5, "again"), (5, "another text", "s1", 5, "own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, _ID string")
    taken = {}
    for r in mixing.mix(docs).collect():
        if r.copies:
            taken[r.doc_id, r.size] = taken.get((r.doc_id, r.size), 0) + r.copies
    out = mixing.mixed_corpus(docs).collect()
    assert mixing.mixed_corpus(docs).columns == [*docs.columns, "size_", "source_size", "target", "copy", "place"]
    got, texts = {}, {(r[0], len((r[1] or "").split())): r[1] for r in rows}
    for r in out:
        got.setdefault((r.doc_id, r.size_), []).append(r.copy)
        assert r.text == texts[r.doc_id, r.size_]
    assert {k: len(v) for k, v in got.items()} == taken
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())
    assert len({r.place for r in out}) == len(out)
    assert mixing.mixed_corpus(docs.limit(0)).count() == 0


def test_mixing_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(empty).count() == 0
    rows = spark.createDataFrame([(1, None, None), (1, "", "a"), (None, " ", "a")], "doc_id bigint, text string, source string")
    assert [(r.size, r.taken, r.target) for r in mixing.mix(rows).collect()] == [(0, 0, 0.0)] * 3
    twice = spark.createDataFrame([(1, "a b c", "s")] * 3, "doc_id bigint, text string, source string")
    assert {r.source_size for r in mixing.mix(twice).collect()} == {9} and mixing.mix(twice).count() == 3


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    from .test_text_operators import prose

    bench = prose(900, 30)
    shared = prose(901, 40)
    rows = [(i, prose(i, 60) + (" " + shared if i in (3, 4) else ""), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(50, rows[0][1], "en", "s0", 0), (51, prose(700, 30) + " " + bench, "en", "s1", 0), (52, "12345 !!", "en", "s2", 0), (53, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, str(tmp_path))
        current.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id for r in current.collect()}
        assert name == "mixing" or current.columns == docs.columns
    everyone = {r[0] for r in rows}
    assert everyone - seen["language_id"] == {52, 53}
    assert seen["language_id"] - seen["near_dedup"] == {50}
    assert seen["near_dedup"] == seen["suffix_dedup"]
    assert seen["suffix_dedup"] - seen["decontamination"] == {51}
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "suffix_dedup")).collect()}
    assert shared[5:-5] in texts[3] and shared[5:-5] not in texts[4] and texts[7] == rows[7][1]
    assert seen["mixing"] <= seen["decontamination"] and seen["mixing"]
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    assert mixed.columns == [*docs.columns, "size", "source_size", "target", "copy", "place"]
    final = mixed.collect()
    assert {r.doc_id for r in final} == seen["mixing"]
    clean = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "decontamination")).collect()}
    assert all(r.text == clean[r.doc_id] and r.size == len(r.text.split()) for r in final)


def test_every_operator_has_its_query():
    names = Q.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
