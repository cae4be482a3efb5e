
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import lm_score, topk

from .test_text_operators import prose


def in_one_batch(spark, rows):
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)
    return [(r.vec_id, r.score) for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]


def test_top_k_when_every_row_is_repeated(spark):
    rows = [(i, [float(10 - i), 1.0]) for i in range(10) for _ in range(2)]
    rows += [(i, [-100.0, -100.0]) for i in (3, 5)]  # an id counts with its best score
    assert in_one_batch(spark, rows) == [(i, 256 * 256 * (10 * (10 - i) + 1)) for i in range(1, 6)]


def test_top_k_behind_copies_in_a_batch_without_query(spark, monkeypatch):
    monkeypatch.setattr(topk, "BATCH", 12)
    rows = [(1, [9.0])] * 5 + [(i, [float(9 - i)]) for i in range(2, 9)] + [(50, [1.0])] + [(i, [-1.0]) for i in range(60, 75)]
    assert [i for i, _ in in_one_batch(spark, rows)] == [1, 2, 3, 4, 5]


def test_score_codes_in_the_whole_trie_whatever_is_broadcast(spark):
    rows = [(i, prose(i % 50, 40) + f" {i % 7}") for i in range(120)] + [(200, None), (201, "qzx"), (3, prose(3, 40) + " 3")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = [(t or "").encode() for _, t in rows]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    keys, scored, first = lm_score._framed(data, off, 0, len(texts))
    keys = keys[scored]
    learned = np.repeat([d < 100 for d, _ in rows], np.diff(first))
    own, n = np.unique(keys[learned], return_counts=True)
    frame = spark.createDataFrame([(0, int(k), int(c)) for k, c in zip(own, n, strict=True)], "kind int, key bigint, n bigint")
    brute = np.add.reduceat(lm_score._trie(frame, 1, 1).costs(keys), first[:-1])
    for nodes in (50, 1 << 20):
        got = {r.doc_id: r.score for r in lm_score.score(docs, F.col("doc_id") < 100, nodes=nodes).collect()}
        assert [got[d] for d, _ in rows] == pytest.approx(list(brute), rel=1e-9)
