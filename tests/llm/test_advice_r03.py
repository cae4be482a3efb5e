"""Findings of the third round on the training-data operators."""

import random

from skein import session
from skein.llm import neardup
from skein.operators import clusters


def test_near_duplicates_broadcast_nothing(spark, monkeypatch, tmp_path):
    """small inputs show it, as Spark would broadcast every one of these tables."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=40) for _ in range(30)]
    spark.createDataFrame([(i, " ".join([*base[i % 30][: 40 - i // 30], f"x{i}"])) for i in range(90)], "doc_id bigint, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))  # a source that Spark knows the size of
    plans = []

    def seen(df, **kind):
        plans.append(df._jdf.queryExecution().toString())
        return session.cut(df, **kind)

    monkeypatch.setattr(neardup, "cut", seen)
    monkeypatch.setattr(clusters, "cut", seen)
    found = neardup.near_duplicates(docs, k=1)
    plans.append(found._jdf.queryExecution().toString())
    kept = neardup.keep_one(docs, k=1)
    plans.append(kept._jdf.queryExecution().toString())
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]
    assert found.count() == 90 and kept.count() < 90


def test_texts_are_read_by_as_many_tasks_as_the_heap_holds(spark):
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    rows = spark.range(0, 1000, 1, 9)
    assert session.few_readers(rows, heap // 2).rdd.getNumPartitions() == 2
    assert session.few_readers(rows, heap).count() == 1000
    assert session.few_readers(rows, 1 << 20).rdd.getNumPartitions() == 9
