"""The registered queries that SQL cannot express, on the smallest tables, against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import lm_score
from skein.llm import queries as Q

from .. import oracle
from .test_other_operators import brute_targets
from .test_text_operators import LOWER, brute_spans, corpus, prose


def documents(spark):
    oracle.connect()
    return spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect()


class BrutePPM:
    """Nested dictionaries of contexts; nodes seen twice are kept, what was seen once stays in the totals."""

    def __init__(self, texts):
        grams = Counter(key for t in texts for key in self.keys(t))
        levels = [{g: (n, n) for g, n in grams.items()}]
        for _ in range(lm_score.ORDER):
            shorter = defaultdict(lambda: [0, 0])
            for g, (raw, _n) in levels[-1].items():
                shorter[g[1:]][0] += raw
                shorter[g[1:]][1] += 1
            levels.append({g: tuple(x) for g, x in shorter.items()})
        self.nodes, self.totals, self.share = {}, {}, {}
        for k, level in zip(range(lm_score.ORDER, -1, -1), levels, strict=True):
            once, twice = (sum(n == m for _, n in level.values()) for m in (1, 2))
            self.share[k] = min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
            self.nodes[k], self.totals[k] = defaultdict(dict), Counter()
            for g, (raw, n) in level.items():
                self.totals[k][g[:-1]] += n
                if raw >= 2:
                    self.nodes[k][g[:-1]][g[-1]] = n

    @staticmethod
    def keys(text):
        framed = [lm_score.START] * lm_score.ORDER + list(text.translate(LOWER).encode()) + [lm_score.END]
        return [tuple(framed[i : i + lm_score.ORDER + 1]) for i in range(len(framed) - lm_score.ORDER)]

    def escape(self, k, context):
        own = self.nodes[k][context]
        return self.share[k] * len(own) + max(self.totals[k][context] - sum(own.values()), 0)

    def cost(self, key):
        out, excluded = 0.0, None
        for k in range(lm_score.ORDER, -1, -1):
            context, symbol = key[lm_score.ORDER - k : -1], key[-1]
            own = self.nodes[k].get(context)
            if not own:
                continue
            left, escape = self.totals[k][context], self.escape(k, context)
            if excluded is not None:
                left -= sum(own[s] for s in excluded)
                escape -= self.share[k] * len(excluded)
            if symbol in own:
                return out + math.log10((own[symbol] - self.share[k]) / max(left, 1e-9))
            if excluded is None:
                out += math.log10(escape / left) if escape > 0 else 0.0
            elif escape > 1e-9:
                out += min(math.log10(escape / max(left, 1e-9)), 0.0)
            excluded = set(own)
        return out - math.log10(max(1.0, 256.0 - len(self.nodes[0][()])))

    def score(self, text):
        return sum(map(self.cost, self.keys(text or "")))


def test_scores_equal_a_brute_force_ppm(spark):
    rows = [(i, prose(i % 30, 25) + f" {i % 7}") for i in range(90)] + [(200, None), (201, "qzx Ωé"), (202, ""), (203, prose(500, 40))]
    brute = BrutePPM([t for d, t in rows if d < 80])
    got = {r.doc_id: r.score for r in lm_score.score(corpus(spark, rows), F.col("doc_id") < 80).collect()}
    assert all(got[d] == pytest.approx(brute.score(t), rel=1e-9) for d, t in rows)


def test_scoring_query(spark):
    docs = documents(spark)
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER)), "\0end"] for r in docs}
    count = Counter(w for d, ws in tokens.items() if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    model = BrutePPM([r.text or "" for r in docs if not held(r.doc_id)])
    texts = {r.doc_id: r.text for r in docs}
    got = Q.queries()["op1_lm_scoring"](spark, oracle.DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    for r in sorted(got, key=lambda r: r.doc_id)[::9]:
        assert r.score == pytest.approx(model.score(texts[r.doc_id]), rel=1e-8)


def test_suffix_dedup_query(spark):
    want = brute_spans([(r.doc_id, r.text) for r in documents(spark)])
    got = Q.queries()["op2_suffix_array_dedup"](spark, oracle.DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_mixing_query(spark):
    docs = documents(spark)
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    sizes, largest, taken = Counter(), Counter(), Counter()
    for d, s in source.items():
        sizes[s] += size[d]
        largest[s] = max(largest[s], size[d])
    target = brute_targets(dict(sizes))
    got = Q.queries()["op10_mixing"](spark, oracle.DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source[r.doc_id]]) and r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
