"""What the second round's findings were about: bytes of pairs, quadratic joins and word edges."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import stories as S


def written(spark, run):
    """Bytes of shuffle and spill files that a run leaves with the block manager."""

    def total():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()))

    before = total()
    out = run()
    return out, total() - before


def headlines(n):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    return [(i, " ".join(rng.sample(words, 10))) for i in range(n)]


def test_title_similarity_shuffles_packed_rows(spark):
    titles = headlines(4000)
    frame = spark.createDataFrame(titles, "ord int, title string")
    found, size = written(spark, lambda: S.lexical_pairs(frame, level=0.4).collect())
    assert size < 40 * sum(len(t) for _, t in titles)
    assert found and all(r.i < r.j and r.sim >= 0.4 for r in found)


def test_title_similarity_over_several_squares(spark, monkeypatch):
    frame = spark.createDataFrame(headlines(60) + [(100 + i, t + " end") for i, t in headlines(60)], "ord int, title string")
    whole = {(r.i, r.j): r.sim for r in S.lexical_pairs(frame).collect()}
    monkeypatch.setattr(S, "BLOCK_ELEMENTS", 2000)
    blocks = {(r.i, r.j): r.sim for r in S.lexical_pairs(frame).collect()}
    assert len(whole) >= 60 and blocks.keys() == whole.keys() and all(blocks[k] == pytest.approx(whole[k]) for k in whole)


def test_sequence_ratio_leaves_out_what_cannot_reach(spark):
    frame = spark.createDataFrame([("abcdefgh", "abcdefgi"), ("abc", "abcdefghijkl"), ("abcdefgh", "stuvwxyz"), ("abcdefgh", "hgfedcba")], "a string, b string")
    got = [r[0] for r in frame.select(T.sequence_ratio(F.col("a"), F.col("b"), 0.8)).collect()]
    assert got[:3] == [0.875, None, None] and got[3] < 0.8


def test_notes_meet_in_blocks_and_lose_none(spark, monkeypatch):
    from skein.operators import joins as J

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.sample(words, 9)), i % 2) for i in range(3000)]
    frame = spark.createDataFrame(rows, "ord bigint, title string, side int")
    articles, notes = (frame.where(f"side = {k}").withColumn("excerpt", F.col("title")) for k in (0, 1))

    def alike(a, b):
        shared = set(a.split()) & set(b.split())
        return len(shared) >= 3 and max(map(len, shared)) >= 8

    want = {(a, n, place) for a, x, s in rows if s == 0 for place, n in enumerate([n for n, y, t in rows if t == 1 and alike(x, y)][:2], 1)}
    found, size = written(spark, lambda: J.attach_notes(articles, notes).collect())
    assert {(r.ord, r.note, r.place) for r in found} == want
    assert size < 3_000_000
    # the same where few notes are asked first
    monkeypatch.setattr(J, "FIRST_NOTES", 300)
    assert {(r.ord, r.note, r.place) for r in J.attach_notes(articles, notes).collect()} == want


def test_merge_rule_shuffles_no_pairs(spark, tmp_path):
    from skein.plans import catalogue

    rng = random.Random(4)
    words = ["the", "and", "with", "und", "that", "les"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.sample(words, 8)) + ". Rest.", "src2", "en", 60) for i in range(3000)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    found, size = written(spark, lambda: catalogue.QUERIES["pair_should_merge"](spark, str(tmp_path)).count())
    near = sum(abs(a % 30 - b % 30) <= 2 for a in range(3000) for b in range(a))
    assert found == near and size < 850_000


def test_told_before_pairs_only_what_shares_enough(spark):
    from datetime import date

    from skein.operators import editorial as E

    schema = "ord int, day date, family string, stage string, entities array<string>, status int"
    rng = random.Random(8)
    facts = lambda d: (date(2024, 1, d), rng.choice(["deal", "policy", "funding", "macro_x"]), rng.choice(["", "seed", "late"]), rng.choices("abcdefgh", k=rng.randint(0, 4)), rng.randrange(4))
    rows, memory = [(i, *facts(10)) for i in range(150)], [(i, *facts(rng.randint(1, 9))) for i in range(150)]

    def same(x, y):
        if x[2] != y[2] or not 1 <= (x[1] - y[1]).days <= 7:
            return False
        if x[2].startswith("macro_"):
            return True
        if x[2] == "funding" and x[3] and y[3] and x[3] != y[3]:
            return False
        p, q = set(x[4]), set(y[4])
        n, fewer = len(p & q), min(len(p), len(q))
        if x[2] == "policy" and "h" in p & q:
            return True
        return fewer > 0 and n > 0 and (p == q or fewer == 1 or (n >= 2 and n / fewer >= 0.5))

    want = {x[0]: max(told) for x in rows if (told := [y[5] for y in memory if same(x, y)])}
    got = E.told_before(spark.createDataFrame(rows, schema), spark.createDataFrame(memory, schema), anchors=("h",))
    assert {r.ord: r.told for r in got.collect()} == want
    # one entity of all rows pairs none of them
    wide = lambda side, day: spark.range(4000).select(F.col("id").cast("int").alias("ord"), F.lit(date(2024, 1, day)).alias("day"), F.lit("deal").alias("family"), F.lit("").alias("stage"), F.array(F.lit("all"), F.concat(F.lit(side), F.col("id").cast("string"))).alias("entities"), F.lit(1).alias("status"))
    told = E.told_before(wide("x", 10), wide("y", 9))
    assert told.count() == 0


def test_title_rules_ignore_case_of_all_letters(spark):
    from skein.operators import classifier as K

    rules = (K.TitleRule("blog", "(?i)^Ö", unless="(?i)É"),)
    rows = spark.createDataFrame([("ölig",), ("Ölig",), ("ölig é",), ("olig",)], "title string")
    got = rows.select(K.title_reason(F.col("title"), F.lit(""), F.lit(False), rules)).collect()
    assert [r[0] for r in got] == ["blog", "blog", None, None]


def test_sendable_is_above_fifty(spark, tmp_path):
    from datetime import datetime

    from skein.plans import catalogue

    events = [(i, datetime(2024, 1, 1), 1, "view", v, '{"k": 1}') for i, v in enumerate([49.99, 50.0, 50.01])]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.ord: r.sendable for r in catalogue.QUERIES["gate_and_rescue"](spark, str(tmp_path)).collect()}
    assert got == {0: False, 1: False, 2: True}


HEAD = "Èleou ouêen an envi de en ouçier vièon en en"


def listed(spark, folder):
    docs = [(i, t, "src1", "fr", len(t)) for i, t in [(1, HEAD + ". Rest"), (31, HEAD + ". Other"), (2, "Leou en an envi")]]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_listing_targets_bound_words_as_the_sql(spark, tmp_path):
    from skein.plans import catalogue

    got = {r.ord: r.target for r in catalogue.QUERIES["listing_targets"](spark, listed(spark, tmp_path)).collect()}
    assert got == {1: "en", 31: "en", 2: "en"}
    # the operator's own edge is that of all letters
    row = spark.createDataFrame([(HEAD, "èleou_ouêen")], "t string, k string")
    assert row.select(S.listing_target(F.col("t"), F.col("k"), "(?i)an", (), (), "an")).first()[0] is None


def test_listing_collapse_takes_those_targets(spark, tmp_path):
    from skein.plans import catalogue

    got = {r.ord: r.dedup_reason for r in catalogue.QUERIES["listing_collapse"](spark, listed(spark, tmp_path)).collect()}
    assert sorted(got.values(), key=str).count("same_target_cluster") >= 1


def test_stories_shuffle_no_pairs_of_a_series(spark):
    from datetime import date

    facts = "ord int, title string, day date, source string, feed string, types array<string>, stage string, families array<string>, tokens array<string>, rates array<string>, actors array<string>, actions array<string>, reaction boolean"
    titles = headlines(1200)
    rows = [(i, t, date(2024, 1, 1 + i % 3), "a", "f", [], "", [], sorted(t.split()), [], [], [], False) for i, t in titles]
    found, size = written(spark, lambda: S.story_clusters(spark.createDataFrame(rows, facts)).collect())
    assert len(found) == 1200 and size < 4_000_000, size


def test_slim_cuts_make_few_files(spark):
    """However many partitions the session deals out: each file costs an executor two processes."""
    from skein.llm import neardup
    from skein.operators import clusters as C
    from skein.session import SLIM_FILES

    dealt = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in dealt}
    most = SLIM_FILES * spark.sparkContext.defaultParallelism
    assert most < 97
    try:
        for k, v in dealt.items():
            spark.conf.set(k, v)
        labels = C.component_labels(spark.createDataFrame([(i, i + 3) for i in range(300)], "i bigint, j bigint"))
        assert labels.rdd.getNumPartitions() <= most
        assert {(r.node, r.component) for r in labels.collect()} == {(i, i % 3) for i in range(303)}
        text = " ".join(f"w{i}" for i in range(60))
        docs = spark.createDataFrame([(i, f"{text} x{i}" if i < 40 else f"own words of number {i}") for i in range(50)], "doc_id bigint, text string")
        assert {r.doc_id for r in neardup.keep_one(docs).collect()} == {0, *range(40, 50)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["listing_targets", "listing_collapse"])
def test_listings_of_odd_letters_and_spaces_are_the_sql_s(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from skein.plans import catalogue

    rng = random.Random(11)
    words = ["an", "in", "and", "ſteel", "steel", "font", "price", "acme", "in\x0ban", "a\x0bn", "in an", " ", "　", "İn", "ſ"]
    docs = [(i, rng.choice(["", " ", "\t"]) + " ".join(rng.choice(words) for _ in range(rng.randrange(7))) + rng.choice(["", " . More"]), "src1", "en", rng.randrange(9)) for i in range(600)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    ours = catalogue.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.sql(f"SELECT {', '.join(ours.columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert sorted(map(tuple, ours.collect()), key=str) == sorted(theirs, key=str)
