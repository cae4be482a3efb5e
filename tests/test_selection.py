"""The selection and the last desk as one call each."""

from datetime import date

from pyspark.sql import functions as F

from skein.operators import quotas as Q
from skein.plans import selection

QUOTAS = {"impact": Q.Quota(3, source_cap=1), "macro": Q.Quota(4, region_cap=2), "deals": Q.Quota(2)}


def news(spark):
    rows = [(i, ["impact", "macro", "deals", "odd"][i % 4], ["global", "korea"][(i // 4) % 2], f"s{i % 5}", float(40 - i), ["t0"] if i % 3 else ["t1"], i == 1, i != 5, i % 2 == 0, 1) for i in range(40)]
    return spark.createDataFrame(rows, "ord int, category string, region string, source string, score double, themes array<string>, excluded boolean, geography boolean, confirmed boolean, strength int")


def test_rules_select_when_the_judge_fails(spark):
    rows = news(spark)
    for judge in (None, lambda pool: None):
        out = selection.select_news(rows, QUOTAS, [F.desc("score")], judge=judge, themed="impact").collect()
        assert {r.reason for r in out} == {"rule_fallback"}
        by = {c: sorted(r.ord for r in out if r.category == c) for c in QUOTAS}
        # the unknown category joins the last; 1 is excluded and 5 has the wrong geography
        assert by["deals"] == [2, 3] and by["macro"] == [9, 13, 17, 21] and len(by["impact"]) == 3


def test_a_judge_sees_bounded_pools(spark):
    seen = []

    def judge(pool):
        found = pool.collect()
        seen.extend(found)
        order = sorted((r.ord for r in found), reverse=True)
        return spark.createDataFrame([(1, "selected", 0, p, o) for p, o in enumerate(order)], "run int, list string, list_ord int, place int, ord int")

    out = selection.select_news(news(spark), QUOTAS, [F.desc("score")], judge=judge, themed="impact").collect()
    assert all(sum(r.category == c for r in seen) <= 12 for c in QUOTAS) and not {1, 5} & {r.ord for r in seen}
    counts = {c: sum(r.category == c for r in out) for c in QUOTAS}
    assert counts == {"impact": 3, "macro": 4, "deals": 2} and max(r.llm_score for r in out) == 1000.0


def test_final_agenda(spark):
    schema = "ord int, title string, event_key string, entities array<string>, events array<string>, day date, category string, region string, importance int, importance_reason string, subtype string, official boolean, relevance double, editor_score double, major_deal boolean, target string, stage string, excluded boolean, reviewed boolean, publisher string, signals array<string>, score double, topic string"
    base = dict(title="t", event_key="", entities=[], events=[], day=date(2024, 1, 1), category="deals", region="global", importance=1, importance_reason="", subtype="", official=False, relevance=1.0, editor_score=6.0, major_deal=False, target=None, stage=None, excluded=False, reviewed=True, publisher="p", signals=[], score=1.0, topic=None)
    rows = [
        dict(base, ord=0, event_key="a_b", relevance=5.0), dict(base, ord=1, event_key="a_b", category="ai", major_deal=True, importance=2, editor_score=7.0),
        dict(base, ord=2, excluded=True), dict(base, ord=3, editor_score=1.0), dict(base, ord=4, target="acme", stage="filed"), dict(base, ord=5, target="acme", stage="filed", category="ai"),
        dict(base, ord=6, category="reports", target="acme", stage="filed"), dict(base, ord=7, topic="x", publisher="p1"), dict(base, ord=8, category="impact", topic="x", publisher="p2"),
    ]
    names = [c.split()[0] for c in schema.split(", ")]
    frame = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)
    coverage = frame.unionByName(spark.createDataFrame([tuple(dict(base, ord=20, topic="x", publisher="p3")[c] for c in names)], schema))
    out = selection.final_agenda(frame, coverage, least=5.0, priority={"ai": 2, "deals": 1}, representative=[F.desc("relevance")], exempt="reports", impact="impact", topic_keys=["topic"]).collect()
    got = {r.ord: r for r in out}
    assert set(got) == {0, 4, 6, 7, 8}
    assert (got[0].category, got[0].major_deal, got[0].importance, got[0].editor_score) == ("ai", True, 2, 7.0)
    # two publishers tell topic x: promoted, but not in the impact category
    assert (got[7].editor_score, got[7].importance) == (7.0, 2) and got[8].editor_score == 6.0 and got[4].editor_score == 6.0


def test_remote_evidence(spark):
    rows = spark.createDataFrame([(i, f"Acme buys tower number{i}", "u0" if i < 2 else f"u{i}") for i in range(15)], "ord int, title string, url string")

    def transport(url):
        if url == "u3":
            raise OSError("down")
        return b"<head><meta property='x'><title>Acme buys tower today</title></head>" if url != "u4" else b"<title>Else entirely</title>"

    got = {r.ord: (r.matches, r.error) for r in selection.remote_evidence(rows, transport).collect()}
    assert set(got) == set(range(12)) and got[0] == got[1] == (True, None) and got[3] == (False, "OSError: down") and got[4] == (False, None)
