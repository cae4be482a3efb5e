"""Text operators of the training-data pipeline against brute force, with edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import decontaminate, induced_sort, license_scan, lm_score, neardup, suffix_dedup

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, score string"


def corpus(spark, rows):
    """Documents with a clashing extra column."""
    return spark.createDataFrame([(i, t, None, "s", "x") for i, t in rows], SCHEMA)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "é", "ß"]
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))


@pytest.mark.parametrize("alphabet", [1, 2, 4])
def test_suffix_arrays_and_prefixes(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (0, 1, 2, 7, 60, 200):
        t = np.tile(rng.integers(0, alphabet, n).astype(np.uint8), 2)
        raw, sa = t.tobytes(), induced_sort.suffix_array(t, 256)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        p = induced_sort.permuted_common_prefixes(t, sa, 30)
        for k in range(1, len(raw)):
            i, j, same = sa[k], sa[k - 1], 0
            while same < 30 and max(i, j) + same < len(raw) and raw[i + same] == raw[j + same]:
                same += 1
            assert p[i] == same


def brute_spans(rows):
    seen, out = {}, {}
    for place in sorted((d, t or "") for d, t in rows):
        raw = place[1].encode()
        for s in range(len(raw) - 99):
            seen.setdefault(raw[s : s + 100], (place[0], s))
            seen[raw[s : s + 100]] = min(seen[raw[s : s + 100]], (place[0], s))
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if seen[raw[s : s + 100]] < (d, s):
                gone[s : s + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[d] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark):
    a, b = prose(1, 120), prose(2, 90)
    rows = [(5, a), (1, a[40:300] + b), (9, b + a[:250] + b), (3, ""), (4, None), (7, "x" * 350), (8, "ab" * 130), (2, a[10:109]), (11, "é" * 120), (12, "yé" + "é" * 99), (6, a)]
    report = suffix_dedup.dedup_report(corpus(spark, rows)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in report}
    assert got == brute_spans(rows)


def test_suffix_dedup_of_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    monkeypatch.setattr(suffix_dedup, "FLUSH", 50)
    long = prose(3, 900)
    rows = [(1, long), (2, "start " + long[500:3000] + " end"), (3, long[100:260])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.dedup_report(corpus(spark, rows)).collect()}
    assert got == brute_spans(rows)


def test_suffix_dedup_repeated_and_null_ids(spark):
    a = prose(4, 60)
    rows = [(1, a), (1, a), (None, a), (2, "short")]
    got = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.dedup_report(corpus(spark, rows)).collect()), key=str)
    n = len(a.encode())
    assert got == [(1, 0), (1, 0), (2, 0), (None, n)]
    assert suffix_dedup.dedup_report(corpus(spark, [])).count() == 0
    kept = suffix_dedup.remove_repeats(corpus(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "score"] and {r.text for r in kept.where("doc_id IS NULL").collect()} == {""}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent=80):
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 8)
    rng = np.random.default_rng(k)
    rows = [(100, ""), (101, None), (102, "one"), (103, "One"), (104, "one two"), (105, " \t\n")]
    for family in range(4):
        words = prose(50 + family, 80).split()
        for copy in range(14):
            own = list(words)
            for _ in range(copy // 3):
                own[rng.integers(0, len(own))] = f"w{rng.integers(0, 9)}"
            rows.append((family * 14 + copy, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(corpus(spark, rows), k=k).collect()}
    assert got == brute_components(rows, k)


def test_near_duplicates_edges(spark):
    rows = [(2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (7, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(corpus(spark, rows), k=2).collect()), key=str)
    assert got == sorted([(2, 1, False), (1, 1, True), (1, 1, True), (None, None, True), (7, 7, True)], key=str)
    kept = neardup.keep_one(corpus(spark, rows), k=2)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 7, None] and kept.columns == ["doc_id", "text", "lang", "source", "score"]
    assert neardup.near_duplicates(corpus(spark, [])).count() == 0 and neardup.keep_one(corpus(spark, [])).count() == 0


def test_texts_that_share_an_id_are_told_apart(spark):
    x, y, z = prose(1, 30), prose(2, 30), prose(3, 30)
    rows = [(1, x), (2, x), (2, y), (3, z), (3, prose(4, 30)), (4, z + " more"), (5, ""), (5, "")]
    docs = corpus(spark, rows).withColumnRenamed("lang", "k0").withColumnRenamed("source", "_k0").withColumn("_gone", F.lit(1))
    kept = neardup.keep_one(docs, k=2)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, x), (2, y), (3, z), (3, prose(4, 30)), (5, ""), (5, "")])
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, k=2).collect()}
    assert {(i, c) for i, _, c in got} == {(1, 1), (2, 1), (2, 2), (3, 3), (4, 3), (5, 5)}


def test_torn_families_are_checked_across_blocks(spark, monkeypatch):
    """Chains: neighbours are alike, ends are not, so no single member links its family."""
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 4)
    rows = []
    for chain in range(3):
        words = prose(500 + chain, 100).split()
        for i in range(20):
            words[(7 * i) % 100 : (7 * i) % 100 + 4] = [f"n{chain}x{i}x{j}" for j in range(4)]
            rows.append((100 * chain + i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(corpus(spark, rows), k=2).collect()}
    assert got == brute_components(rows, 2)


def brute_hits(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for name, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[i : i + size]), set()).update([str(name)] if name is not None else [])
    out = {}
    for d, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_decontamination_equals_brute_force(spark, monkeypatch):
    items = [(1, prose(7, 40)), (2, prose(8, 25)), (3, "Two words"), (4, ""), (5, None), (None, prose(9, 30)), (6, prose(7, 40)), (7, "x x x x x x x x x x x x")]
    rows = [(1, prose(10, 30) + " " + prose(7, 40) + " end"), (2, prose(8, 25).upper()), (3, "say TWO, words!"), (4, None), (5, ""), (6, "x " * 40), (7, " ".join(prose(7, 40).split()[5:14])), (8, prose(7, 40).replace(" ", "-")), (9, prose(9, 30)), (10, f"{prose(9, 30)} {prose(8, 25)}"), (1, prose(7, 40)), (None, prose(8, 25)), (11, prose(7, 40)), (11, "clean")]
    rows = [r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i]}]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for bits, most in ((26, 1 << 20), (7, 0)):  # a filter that lets everything pass; a join by shuffle
        monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
        report = decontaminate.decontamination_report(corpus(spark, rows), benchmark).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in report} == brute_hits(rows, items)
        assert all(sum(s.last_word - s.first_word + 1 for s in r.spans) == r.n_hit for r in report)
        clean = decontaminate.drop_contaminated(corpus(spark, rows), benchmark)
        assert clean.columns == corpus(spark, rows).columns
        assert decontaminate.drop_contaminated(corpus(spark, rows).withColumnRenamed("lang", "d1").withColumnRenamed("source", "_d2"), benchmark).columns == ["doc_id", "text", "d1", "_d2", "score"]
        assert {r.doc_id for r in clean.collect()} == {d for d, (_, n, _) in brute_hits(rows, items).items() if not n}
    again = decontaminate.decontamination_report(corpus(spark, [(1, prose(7, 40)), (1, prose(7, 40)), (1, "clean"), (2, "word " * 500_000 + prose(8, 25))]), benchmark).collect()
    assert sorted((r.doc_id, r.n_hit) for r in again) == [(1, 0), (1, 40), (1, 40), (2, 25)]
    assert decontaminate.decontamination_report(corpus(spark, rows), benchmark.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.decontamination_report(corpus(spark, []), benchmark).count() == 0


def test_winnowing_meets_every_window():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 50, 400).astype(np.uint64)
    at = decontaminate.winnow(f, 6)
    assert all(at[i] == i + int(np.argmin(f[i : i + 6])) for i in range(len(at)))


def test_word_baseline_and_counts(spark):
    rows = [(i, prose(i % 17, 30)) for i in range(60)] + [(60, None), (61, ""), (62, "The THE the\x0bthe"), (7, prose(7, 30)), (63, "unseen-word-ß"), (64, "é" * 3000)]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\0end"]) for d, t in rows]
    count = Counter(w for d, ws in words if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    out = lm_score.score(corpus(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 7 != 2).collect()
    assert len(out) == len(rows)
    for d, ws in words:
        r = next(r for r in out if r.doc_id == d)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0
    assert lm_score.score(corpus(spark, []), F.lit(True)).count() == 0


def test_trie_probabilities_sum_to_one(spark):
    texts = [prose(i, 40).encode() for i in range(20)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    keys, scored, _ = lm_score._framed(data, off, 0, len(texts))
    counts = Counter(keys[scored].tolist())
    frame = spark.createDataFrame([(0, int(k), c) for k, c in counts.items()], "kind int, key bigint, n bigint")
    trie = lm_score._trie(frame, int(scored.sum()), 1 << 20)
    rng = np.random.default_rng(1)
    for key in [*rng.choice(keys[scored], 10), *rng.integers(0, 1 << 48, 5).astype(np.uint64)]:
        every = (key >> np.uint64(8)) << np.uint64(8) | np.arange(256, dtype=np.uint64)
        assert (10.0 ** trie.costs(every)).sum() == pytest.approx(1.0, abs=1e-9)
    pruned = lm_score._trie(frame, int(scored.sum()), 50)
    assert sum(len(g.hash) for g in pruned.grams) <= 6 * 50


def test_held_out_text_of_the_corpus_scores_above_noise(spark):
    rows = [(i, prose(i, 80)) for i in range(120)]
    out = lm_score.score(corpus(spark, [*rows, (1000, "qzx vkj " * 40)]), F.col("doc_id") < 100).collect()
    per_byte = {r.doc_id: r.score / len((dict(rows).get(r.doc_id) or "qzx vkj " * 40)) for r in out}
    assert min(per_byte[i] for i in range(100, 120)) > per_byte[1000] + 0.3


def test_license_rules(spark):
    rows = [(1, "Intro.\nReleased under the MIT License."), (2, "All rights reserved."), (3, "no licence here"), (4, None), (5, ""), (6, "Licensed under the Apache License, Version 2.0. All rights reserved."), (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of it.\nBe nice.\nThe above copyright notice and this permission notice shall be included in all copies.")]
    got = {r.doc_id: (r.license, r.n_sentences) for r in license_scan.scan(corpus(spark, rows)).collect()}
    assert got == {1: ("MIT", 1), 2: ("All-Rights-Reserved", 1), 3: (None, 0), 4: (None, 0), 5: (None, 0), 6: ("Apache-2.0", 2), 7: ("MIT", 2)}
    assert license_scan.scan(corpus(spark, [])).count() == 0
