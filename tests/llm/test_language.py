"""Language models against Kneser-Ney sums over dictionaries; predictions, rejection and edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import langid
from skein.llm import queries as Q

from .. import oracle
from .test_text_operators import corpus, prose

DE = [prose(i, 30).replace("th", "sch") for i in range(40)]
EN = [prose(100 + i, 30) for i in range(40)]


def brute_symbols(text, number):
    """0 at the front and for each run of other characters."""
    out = [0]
    for c in text:
        s = number.get(ord(c.lower()), 1) if c.isalpha() else 0
        if s or out[-1]:
            out.append(s)
    return out


class BruteModel:
    """P(c | abc) = max(n - D, 0) / N + D * types / N * P(c | bc); lower orders count distinct contexts."""

    def __init__(self, sequence, size):
        padded = [0] * (langid.ORDER - 1) + sequence
        grams = Counter(tuple(padded[i : i + langid.ORDER]) for i in range(len(sequence)))
        self.size, self.counts = size, [grams]
        for _ in range(langid.ORDER - 1):
            self.counts.append(Counter(g[1:] for g in self.counts[-1]))
        self.follow = []
        for counts in self.counts:
            follow = defaultdict(lambda: [0, 0])
            for g, n in counts.items():
                follow[g[:-1]][0] += n
                follow[g[:-1]][1] += 1
            self.follow.append(follow)

    def p(self, gram, level=0):
        if level == langid.ORDER:
            return 1 / (self.size + 1)
        lower = self.p(gram[1:], level + 1)
        total, types = self.follow[level].get(gram[:-1], (0, 0))
        if not total:
            return lower
        return max(self.counts[level][gram] - langid.DISCOUNT, 0) / total + langid.DISCOUNT * types / total * lower


def test_entropies_equal_brute_force():
    models = langid.Models({"de": DE[:9], "en": EN[:9]})
    number = {int(c): int(s) for c, s in enumerate(models.symbols.table) if s > 1}
    brute = [BruteModel([s for t in own for s in brute_symbols(t, number)] + [0], models.size) for own in (DE[:9], EN[:9])]
    texts = [DE[20], EN[20], "Ωx 12 th", "a", "über; Sch"]
    h, letters, n = models.entropies_of(texts)
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]
    s, starts, _ = models.symbols.encode(*_joined(texts))
    for i in range(len(texts)):
        own = s[starts[i] : starts[i + 1]].tolist()
        before = [0] * 3 + s[: starts[i]].tolist()
        for j in range(2):
            cost = 0.0
            for k in range(1, len(own)):
                gram = tuple((before + own[: k + 1])[-4:])
                cost -= math.log(brute[j].p(gram))
            assert h[i, j] * n[i] == pytest.approx(cost, rel=1e-4), (i, j)


def _joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_probabilities_sum_to_one():
    models = langid.Models({"de": DE, "en": EN})
    s, total = np.array([0, 3, 4, 5], np.uint16), np.zeros(2)
    for symbol in range(models.size + 1):
        total += np.exp(models.log_probabilities(np.append(s, np.uint16(symbol)))[-1])
    assert total == pytest.approx([1, 1], abs=1e-3)


def test_predictions_and_rejection(spark):
    models = langid.Models({"de": DE, "en": EN})
    models.calibrate({"de": DE, "en": EN})
    rows = [(1, prose(300, 50).replace("th", "sch")), (2, prose(301, 50)), (3, None), (4, "12 34 !!"), (5, ""), (6, "Ωμέγα και άλφα και βήτα " * 20), (7, "𝒳 " * 3)]
    got = {r.doc_id: r for r in langid.identify(corpus(spark, rows), [models]).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["de", "en", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[6].rejected and not got[1].rejected and not got[2].rejected
    kept = {r.doc_id for r in langid.drop_rejected(corpus(spark, rows), [models]).collect()}
    assert {1, 2} <= kept and 6 not in kept
    assert langid.identify(corpus(spark, []), [models]).count() == 0
    assert langid.fit(corpus(spark, rows)) == [] and langid.identify(corpus(spark, rows), []).where("lang_pred <> 'und'").count() == 0
    assert langid.drop_rejected(corpus(spark, rows), []).count() == 0
    assert langid.identify(corpus(spark, [(1, "abc"), (1, "abc"), (None, "abc")]), [models]).count() == 3


def test_every_label_is_learned_in_sets(spark):
    marks = {f"l{i:02}": chr(0x3B1 + i) for i in range(9)}
    rows = spark.createDataFrame([(100 * i + j, prose(j, 30).replace("e", c), k) for i, (k, c) in enumerate(marks.items()) for j in range(6)], "doc_id bigint, text string, lang string")
    sets = langid.fit(rows, languages=2)
    assert [m.languages for m in sets] == [["l00", "l01"], ["l02", "l03"], ["l04", "l05"], ["l06", "l07"], ["l08"]]
    whole = langid.fit(rows)
    fresh = spark.createDataFrame([(100 * i + j, prose(50 + j, 30).replace("e", c), k) for i, (k, c) in enumerate(marks.items()) for j in range(6)], "doc_id bigint, text string, lang string")
    got, want = ({r.doc_id: r for r in langid.identify(fresh, m).collect()} for m in (sets, whole))
    assert {d: r.lang_pred for d, r in got.items()} == {r.doc_id: r.lang for r in fresh.collect()}
    assert all(r.entropy == pytest.approx(want[d].entropy, rel=1e-5) for d, r in got.items())


def test_fit_takes_distinct_texts_of_the_training_rows(spark):
    rows = spark.createDataFrame([(i, prose(i, 30), "xx" if i % 2 else None) for i in range(30)] + [(1, prose(1, 30), "xx")] * 50, "doc_id bigint, text string, lang string")
    assert langid.fit(rows, train=F.col("doc_id") % 2 == 0) == []
    assert [m.languages for m in langid.fit(rows, fit_docs=3)] == [["xx"]]


def test_long_texts_are_scored_in_pieces(spark, monkeypatch):
    models = langid.Models({"de": DE, "en": EN})
    models.calibrate({"de": DE, "en": EN})
    text = " ".join(prose(400 + i, 40) for i in range(40))
    whole = models.entropies_of([text])[0][0]
    monkeypatch.setattr(langid, "PIECE", 500)
    (lo, h, letters, n), *rest = langid._entropies(models, *_joined([text]))
    assert not rest and lo == 0 and letters[0] == sum(c.isalpha() for c in text)
    assert h[0] == pytest.approx(whole, rel=0.01)


def test_held_out_accuracy_and_unlearned_languages(spark):
    oracle.connect()
    docs = spark.read.parquet(f"{oracle.DATA.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", "lang")
    got = Q.queries()["op5_language_id"](spark, oracle.DATA.replace("sf0.001", "sf0.01")).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got) and sum(r.rejected for r in got) < 0.01 * len(got)
    models = langid.fit(docs.where("lang <> 'es'"))
    other = langid.identify(docs.where("lang = 'es' and length(text) > 200"), models).collect()
    assert sum(r.rejected for r in other) > 0.95 * len(other)
