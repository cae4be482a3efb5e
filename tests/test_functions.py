"""Column functions on table-driven cases."""

import pytest
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import text as T
from skein.functions import values as V


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://a.com/x?utm_source=n&id=3#top", "https://a.com/x?id=3"),
        ("https://a.com/x?ref=1&fbclid=2", "https://a.com/x"),
        ("https://a.com/x?keep=&b=1", "https://a.com/x?keep=&b=1"),
        ("no address", "no address"),
        ("//host/path", "//host/path"),
        (None, None),
    ],
)
def test_normalize_url(spark, url, expected):
    row = spark.createDataFrame([(url,)], "url string")
    assert row.select(T.normalize_url(F.col("url"))).first()[0] == expected
    again = row.select(T.normalize_url(T.normalize_url(F.col("url")))).first()[0]
    assert again == expected


@pytest.mark.parametrize(
    ("left", "right", "same"),
    [
        ("Central bank raises rates again", "Central bank raises rates once more", True),
        ("Central bank raises rates again", "Small town opens new museum", False),
        ("", "", False),
        ("ab", "ab", False),
        ("삼성전자 반도체 투자 확대", "삼성전자, 반도체 투자를 확대", True),
        ("one two three four", "one two nine eight", True),
        ("alpha bravo delta", "alpha tango omega", False),
    ],
)
def test_same_issue_is_symmetric(spark, left, right, same):
    row = spark.createDataFrame([(left, right)], "a string, b string")
    assert row.select(T.same_issue(F.col("a"), F.col("b"))).first()[0] is same
    assert row.select(T.same_issue(F.col("b"), F.col("a"))).first()[0] is same


def test_headlines(spark):
    rows = spark.createDataFrame([("rising ocean temperatures this year",), ("Five words make a headline",), ("Too short",), ("삼성전자, SK하이닉스 인수 추진",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.looks_like_headline(F.col("t"))).collect()] == [False, True, False, True, False]


def test_public_url(spark):
    cases = {"https://a.com/n?id=4&x=1": "https://a.com/n?id=4", "http://a.com/n": "", "https://u:p@a.com/": "", "https://click.a.com/x": "", None: ""}
    rows = spark.createDataFrame([(u,) for u in cases], "u string")
    assert [r[0] for r in rows.select(T.public_url(F.col("u"))).collect()] == list(cases.values())


def test_canonical_key_and_entities(spark):
    row = spark.createDataFrame([("Flow-Control Holdings buyout",)], "k string")
    key = T.canonical_key(F.col("k"), (("buyout", "acquisition"),), {"control": ("ctl", "flow")}, {"holdings": "hldg"})
    assert row.select(key).first()[0] == "acquisition_ctl_flow_hldg"
    found = set(row.select(T.key_entities(F.col("k"))).first()[0])
    assert {"fch", "chb", "fchb", "flow"} <= found


def test_particles_leave_two_characters(spark):
    row = spark.createDataFrame([("정부는 은행을 지원 에는",)], "t string")
    assert set(row.select(T.headline_tokens(F.col("t"), ("는", "을", "에는"))).first()[0]) == {"정부", "은행", "지원", "에는"}


def test_sparkline_rounds_half_even(spark):
    row = spark.createDataFrame([([0.0, 0.5, 1.0],), ([2.0, 2.0],), ([],)], "v array<double>")
    assert [r[0] for r in row.select(T.sparkline(F.col("v"))).collect()] == ["▁▅█", "▄▄", ""]


def test_evidence_and_qualifiers(spark):
    row = spark.createDataFrame([("signed a  binding deal", "The firm signed a binding deal today")], "q string, f string")
    assert row.select(T.quoted_evidence(F.col("q"), [F.col("f")])).first()[0] is True
    assert row.select(T.quoted_evidence(F.lit("deal"), [F.col("f")])).first()[0] is False
    assert row.select(T.preserves_qualifiers(F.lit("may buy"), F.lit("buys"), ((r"\bmay\b", "possibly"),))).first()[0] is False


def test_guarded_title_is_idempotent(spark):
    row = spark.createDataFrame([("Deal", "reported")], "t string, s string")
    first = T.guarded_title(F.col("t"), F.col("s"), {"reported": "[reported]"})
    assert row.select(first).first()[0] == "[reported] Deal"
    assert row.select(T.guarded_title(first, F.col("s"), {"reported": "[reported]"})).first()[0] == "[reported] Deal"


@pytest.mark.parametrize(("raw", "day"), [("Jan 3rd, 2024", "2024-01-03"), ("2024.02.29", "2024-02-29"), ("3 March 2024", "2024-03-03"), ("soon", None)])
def test_web_dates(spark, raw, day):
    row = spark.createDataFrame([(raw,)], "d string")
    assert row.select(D.web_date(F.col("d")).cast("string")).first()[0] == day


def test_weekly_window_and_labels(spark):
    row = spark.createDataFrame([("2024-01-14",), ("2024-01-15",)], "d string").select(F.col("d").cast("date").alias("d"))
    first, last = D.weekly_window(F.col("d"))
    assert [(str(r[0]), str(r[1])) for r in row.select(first, last).collect()] == [("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14")]
    assert one(spark, D.iso_week_label(F.lit("2024-12-30").cast("date"))) == "2025-W01"


def test_rfc_and_iso_times(spark):
    rows = spark.createDataFrame([("Mon, 15 Jan 2024 10:00:00 +0900",), ("2024-01-15T01:00:00Z",), ("x",)], "t string")
    assert [str(r[0]) for r in rows.select(D.published_utc(F.col("t")).cast("string")).collect()] == ["2024-01-15 01:00:00", "2024-01-15 01:00:00", "None"]


def test_replay_clause_and_period(spark):
    assert one(spark, D.replay_clause(F.lit("fed when:3d"), F.lit("2024-01-10").cast("date"))) == "fed after:2024-01-07 before:2024-01-11"
    assert one(spark, D.single_period(F.lit("US payrolls for March 2024"))) == "2024-march"
    assert one(spark, D.single_period(F.lit("March or April 2024"))) is None


def test_changes_and_distribution(spark):
    assert one(spark, V.change(F.lit(4.0), F.lit(4.25), F.lit("basis_points"))) == pytest.approx(25)
    assert one(spark, V.change(F.lit(0.0), F.lit(4.25), F.lit("percent"))) is None
    good = F.create_map(F.lit("a"), F.lit(0.7), F.lit("b"), F.lit(0.3))
    assert one(spark, V.valid_distribution(good, F.lit("a"))) is True
    assert one(spark, V.valid_distribution(good, F.lit("b"))) is False
    assert one(spark, V.valid_distribution(good, F.lit("c"))) is False


def test_json_body_and_importance(spark):
    assert one(spark, V.json_body(F.lit('```json\n{"a": {"b": 1}}\n```'))) == '{"a": {"b": 1}}'
    assert one(spark, V.json_body(F.lit("none"))) is None
    rows = spark.createDataFrame([("2",), ("2.5",), ("true",), (None,)], "v string")
    assert [r[0] for r in rows.select(V.importance(F.col("v"))).collect()] == [2, 0, 0, 0]


def test_cosine_of_zero_vector(spark):
    assert one(spark, V.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_search_url():
    assert T.search_url("https://s.example/q", ["central bank", "site:a.com"], 2).endswith("%22central+bank%22+OR+site%3Aa.com+when%3A2d")
