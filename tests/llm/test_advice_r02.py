"""Findings of FINDINGS_r02 and of its TESTS report: memory of language-model scoring, grants in other words."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import _bytes as B
from skein.llm import license_scan, lm_score, queries

from .test_text_operators import corpus, prose


class Batches:
    """Stands for the training rows: keeps the function that counts them."""

    def select(self, *_):
        return self

    groupBy = agg = select

    def mapInArrow(self, count, _):
        self.count = count
        return self


def test_counting_six_byte_keys_holds_few_of_them(spark):
    rng = np.random.default_rng(5)
    letters = rng.integers(97, 123, (10, 1 << 20), np.uint8)  # nearly all of ten million keys differ
    letters[:, ::7] = 32
    texts = [pa.record_batch([pa.array([part.tobytes().decode() for part in np.split(row, 64)])], ["text"]) for row in letters]
    rows = Batches()
    lm_score._counts(rows, np.empty(0, B.U64))
    keys, counts, total, widest = [], [], 0, 0
    tracemalloc.start()
    try:
        for out in rows.count(iter(texts)):
            kind, key, n = (c.to_numpy() for c in out.columns)
            widest = max(widest, len(kind))
            total += int(n[kind == lm_score._BYTES].sum())
            keys.append(key[kind == lm_score._GRAM][::16].copy())
            counts.append(int(n[kind == lm_score._GRAM].sum()))
        peak = tracemalloc.get_traced_memory()[1] - sum(k.nbytes for k in keys)
    finally:
        tracemalloc.stop()
    assert sum(counts) == total == 10 * (1 << 20) + 640
    assert peak < 150e6 and widest <= 1 << 16


def test_words_and_keys_are_summed_in_pieces(spark, monkeypatch):
    docs = corpus(spark, [(i, prose(i % 50, 40) + f" {i % 7}") for i in range(200)] + [(300, None), (301, "qzx qzx")])

    def scored():
        return {r.doc_id: r for r in lm_score.score(docs, F.col("doc_id") % 3 != 0).collect()}

    whole = scored()
    monkeypatch.setattr(lm_score, "FLUSH", 64)
    monkeypatch.setattr(lm_score, "WAITING", 100)
    pieces = scored()
    assert pieces.keys() == whole.keys()
    for d, r in whole.items():
        assert (pieces[d].n_tokens, pieces[d].n_known, pieces[d].train_tokens) == (r.n_tokens, r.n_known, r.train_tokens)
        assert pieces[d].base_score == pytest.approx(r.base_score, rel=1e-9) and pieces[d].score == pytest.approx(r.score, rel=1e-9)


def test_grants_in_other_words(spark):
    grant, notice = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of", "The above copyright notice and this permission notice shall be included in all copies"
    texts = [f"{grant} these data,\nto use them.\n\n{notice} of the data.", f"{grant} it\nReleased under the ISC License\nprose\n", f"{grant} it.", f"He said: {notice[:-7]}.", f"{notice}{' word' * 100_000}."]
    got = {r.doc_id: (r.license, r.sentence_ids) for r in license_scan.scan(corpus(spark, list(enumerate(texts)))).collect()}
    assert got == {0: ("MIT", "MIT_GRANT MIT_NOTICE"), 1: ("ISC", "MIT_GRANT ISC"), 2: (None, "MIT_GRANT"), 3: (None, ""), 4: (None, "")}


def test_the_license_query_keeps_to_its_sql(spark, tmp_path):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of it. Licensed under the MIT License."
    corpus(spark, [(1, text)]).write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.sentence_ids, r.license) for r in queries.op7_license_scans(spark, str(tmp_path)).collect()] == [("MIT", "MIT")]
