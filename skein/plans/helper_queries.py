"""Queries of column functions and small operators that no larger query shows by itself."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import values as V
from ..operators import classifier as K
from ..operators import clusters as C
from ..operators import editorial as E
from ..operators import joins as J
from ..operators import rules as R
from ..operators import series as M
from ..operators import state as H
from ..sources import market, searches
from . import evaluate, judge, monitor
from .registry import ART, EVENT, URL, articles, event_rows, query, table
from .story_queries import HEAD, headlines
from .text_queries import _UNESCAPE

_SQ = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_CLEAN = _SQ.format(_UNESCAPE.format("regexp_replace({0}, '<[^>]+>', ' ', 'g')"))


@query(rf"""WITH {HEAD}, s AS (SELECT ord, '[Mail] Re: FW: <b>' || head || '</b>' AS subject, head || CASE WHEN ord % 3 = 0 THEN ' - Outlet ' || CAST(ord % 7 AS VARCHAR) ELSE '' END AS t, 'https://www.' || source || '.com (x)' AS src FROM hd)
SELECT ord, {_SQ.format(r"regexp_replace(regexp_replace(" + _CLEAN.format("subject") + r", '\[[^\]]*\]', '', 'g'), '(?i)^\s*(?:(?:fw|fwd|re)\s*:\s*)+', '')")} AS subject, CASE WHEN regexp_matches(t, '^(.*) - (.{{1,40}})$') THEN regexp_extract(t, '^(.*) - (.{{1,40}})$', 1) ELSE t END AS title,
CASE WHEN regexp_matches(t, '^(.*) - (.{{1,40}})$') THEN regexp_extract(t, '^(.*) - (.{{1,40}})$', 2) END AS outlet, CASE WHEN src = 'https://www.src1.com (x)' THEN 'One' ELSE replace(regexp_replace(regexp_replace(src, '\s*\([^)]*\)', '', 'g'), '^https?://(?:www\.)?', ''), '.', '.' || chr(8203)) END AS name FROM s""")
def title_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail subjects, outlet suffixes and source names."""
    rows = headlines(spark, sf_dir)
    subject = F.concat(F.lit("[Mail] Re: FW: <b>"), "title", F.lit("</b>"))
    titled = F.concat("title", F.when(F.col("ord") % 3 == 0, F.concat(F.lit(" - Outlet "), (F.col("ord") % 7).cast("string"))).otherwise(""))
    title, outlet = T.split_outlet(titled)
    name = T.clean_source_name(F.concat(F.lit("https://www."), "source", F.lit(".com (x)")), {"src1.com": "One"})
    return rows.select("ord", T.clean_subject(subject).alias("subject"), title.alias("title"), outlet.alias("outlet"), name.alias("name"))


@query(rf"""WITH b AS (SELECT page_id, list_transform(regexp_split_to_array(html, '(?i)</?(?:p|div|h[1-6]|td|tr|table|br|li)[^>]*>'), lambda x: {_CLEAN.format('x')}) AS b, html FROM pages) SELECT page_id, coalesce(list_filter(b, lambda x: length(x) >= 15)[1], {_CLEAN.format('html')}) AS headline FROM b""")
def anchor_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.anchor_headline(F.col("html")).alias("headline"))


@query(r"""WITH k AS (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name), '[a-z0-9가-힣]+'), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '\d') AND t NOT IN ('part', 'red')) AS w, lower(trim(p_name)) AS n FROM part)
SELECT p_partkey, array_to_string(w, ' ') AS tokens, n || '|' || 't' AS signature FROM k""")
def key_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of event keys, and topic signatures."""
    sig = T.topic_signature(F.col("p_name"), F.lit(" T "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.key_tokens(F.col("p_name"), ("part", "red")), " ").alias("tokens"), F.concat_ws("|", sig["event_key"], sig["topic_key"]).alias("signature"))


@query(rf"""WITH {HEAD}, q AS (SELECT ord, head, substr(head, 3, 12) || CASE WHEN ord % 4 = 0 THEN ' zzz' ELSE '' END AS quote FROM hd), s AS (SELECT *, {_SQ.format('quote')} AS q, {_SQ.format('head')} AS f FROM q)
SELECT ord, length(q) BETWEEN 8 AND 160 AND contains(f, q) AS quoted, CASE WHEN ord % 3 = 0 AND NOT starts_with(head, '[reported]') THEN '[reported] ' || head ELSE head END AS guarded,
CASE WHEN ord % 5 = 0 THEN 'editor' WHEN regexp_matches(head, 'the') THEN 'policy' WHEN regexp_matches(head, 'und') THEN 'investment' ELSE 'industry' END AS label FROM s""")
def claim_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted evidence, titles under the label of their claim, impact labels."""
    o, t = F.col("ord"), F.col("title")
    quote = F.concat(F.substring(t, 3, 12), F.when(o % 4 == 0, " zzz").otherwise(""))
    claim = F.when(o % 3 == 0, "reported").otherwise("none")
    kind = F.when(o % 5 == 0, " editor ").otherwise(" ")
    return headlines(spark, sf_dir).select("ord", T.quoted_evidence(quote, [t]).alias("quoted"), T.guarded_title(t, claim, {"reported": "[reported]"}).alias("guarded"), R.impact_label(kind, t, "the", "und").alias("label"))


@query(f"""WITH {ART} SELECT ord, CAST(day AS VARCHAR) AS web, CAST(day AS VARCHAR) AS from_url, day + INTERVAL 10 HOUR AS published, CASE WHEN ord % 2 = 0 THEN CAST(day AS VARCHAR) END AS unknown_stays, abs(date_diff('day', day, DATE '2024-01-15')) AS gap,
'news after:' || CAST(CAST(day - 2 AS DATE) AS VARCHAR) || ' before:' || CAST(CAST(day + 1 AS DATE) AS VARCHAR) AS clause, CAST(year(day) AS VARCHAR) || '-' || lower(monthname(day)) AS period, CAST(CAST(day + INTERVAL 1 DAY AS DATE) AS VARCHAR) AS local_day FROM art""")
def date_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of texts, urls and feeds, windows, search clauses and periods."""
    d, o = F.col("day"), F.col("ord")
    shown = F.when(o % 3 == 0, F.date_format(d, "MMMM d, yyyy")).when(o % 3 == 1, F.date_format(d, "yyyy.MM.dd")).otherwise(F.concat(F.date_format(d, "d"), F.lit("th "), F.date_format(d, "MMM yyyy")))
    rfc = F.when(o % 2 == 0, F.concat(F.lit("Mon, "), F.date_format(d, "d MMM yyyy"), F.lit(" 12:00:00 +0200"))).otherwise(F.concat(d.cast("string"), F.lit("T10:00:00Z")))
    url = F.concat(F.lit("https://a.com/"), F.date_format(d, "yyyyMMdd"), F.lit("/x"))
    known = F.when(o % 2 == 0, d)
    return articles(spark, sf_dir).select("ord", D.web_date(shown).cast("string").alias("web"), D.url_date(url).cast("string").alias("from_url"), D.published_utc(rfc).cast("timestamp_ntz").alias("published"), F.when(D.within_window(known, d), known).cast("string").alias("unknown_stays"), D.gap_days(d, F.lit("2024-01-15").cast("date")).cast("bigint").alias("gap"), D.replay_clause(F.lit("news when:2d"), d).alias("clause"), D.single_period(F.concat(F.lit("in "), F.date_format(d, "MMMM yyyy"), F.lit(" and again in "), F.date_format(d, "MMMM"))).alias("period"), D.local_day((d + F.expr("INTERVAL 20 HOURS")).cast("timestamp")).cast("string").alias("local_day"))


@query(f"""WITH {EVENT} SELECT ord, round(least(greatest(value, 10), 90), 4) AS held, event_type || ',b' AS uniq, CAST(k AS VARCHAR) AS ids, k % 3 = 0 AS truth FROM ev""")
def value_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded numbers, ordered distinct values, ids of replies, truth of words."""
    k = F.col("k").cast("string")
    kinds = F.array(F.concat(F.lit(" "), "event_type"), F.lit("b"), F.lit(""), F.col("event_type"))
    said = F.when(F.col("k") % 3 == 0, " Yes").otherwise("maybe")
    return event_rows(spark, sf_dir).select("ord", F.round(V.bounded(F.col("value"), 10, 90), 4).alias("held"), F.array_join(V.ordered_unique(kinds), ",").alias("uniq"), F.array_join(V.digit_ids(F.array(F.concat(F.lit("id-"), k), F.lit("none"))), ",").alias("ids"), V.truthy(said).alias("truth"))


_GATED = f"{EVENT}, g AS (SELECT ord, k % 4 = 0 AS excluded, k % 3 = 0 AS newsletter, CASE k % 4 WHEN 0 THEN CASE WHEN k % 8 = 0 THEN 'noise' ELSE 'hard' END END AS reason, CASE k % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'reject' END AS verdict, value FROM ev), d AS (SELECT *, excluded AND newsletter AND coalesce(reason = 'noise', FALSE) AS deferred FROM g)"


@query(f"""WITH {_GATED} SELECT ord, deferred, CASE WHEN excluded AND NOT deferred THEN 'gate' WHEN deferred AND NOT coalesce(verdict = 'keep', FALSE) THEN CASE WHEN verdict = 'reject' THEN 'editor' ELSE 'newsletter_review_unavailable' END WHEN NOT deferred AND coalesce(verdict = 'reject', FALSE) THEN 'editor' END AS rejected_by,
coalesce(verdict, '') = 'keep' AND NOT excluded AND ord % 7 <> 0 AS agenda, NOT excluded AND value > 50 AS sendable FROM d""")
def gate_and_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusion before the judge, deferral of newsletters, and who is rescued; agenda and sending guards."""
    k = F.col("k")
    rows = event_rows(spark, sf_dir).select("ord", (k % 4 == 0).alias("excluded"), (k % 3 == 0).alias("newsletter"), F.when(k % 8 == 0, "noise").when(k % 4 == 0, "hard").alias("exclusion_reason"), F.when(k % 5 == 0, "keep").when(k % 5 == 1, "reject").alias("editor_verdict"), "value")
    asked, gone = R.gate(rows, ("noise",), True)
    kept, lost = R.rescue(asked.withColumn("still_excluded", F.lit(False)))
    every = gone.withColumn("rejected_by", F.lit("gate")).unionByName(kept.withColumn("rejected_by", F.lit(None).cast("string")).drop("still_excluded")).unionByName(lost.drop("still_excluded"))
    agenda = R.agenda_eligible(F.lit("t"), F.when(F.col("ord") % 7 == 0, "barred").otherwise("open"), F.col("excluded"), F.col("editor_verdict"), ("barred",))
    # sent from the least score on; the query wants more than 50
    return every.select("ord", "deferred", "rejected_by", agenda.alias("agenda"), R.sendable(F.col("excluded"), F.lit(True), F.col("value"), math.nextafter(50.0, math.inf)).alias("sendable_or_equal")).withColumn("sendable", F.col("sendable_or_equal")).drop("sendable_or_equal")


@query(f"""WITH {HEAD} SELECT ord, ord % 6 = 0 AS selected, CAST(floor((row_number() OVER (ORDER BY ord) - 1) / 80) AS BIGINT) AS batch, CASE WHEN ord % 4 = 0 AND length(substr(head, 1, 9)) >= 8 THEN CASE WHEN ord % 8 = 0 THEN 'keep' ELSE 'reject' END ELSE 'unreviewed' END AS editor_verdict FROM hd""")
def second_look_and_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge batches of 80, grounded second looks at boundary rows, and the flag of selected ids."""
    rows = headlines(spark, sf_dir).select("ord", "title", "description", F.lit("unreviewed").alias("editor_verdict"))
    verdicts = rows.where("ord % 4 = 0").select("ord", (F.col("ord") % 8 == 0).alias("keep"), F.substring("title", 1, 9).alias("quote"))
    looked = R.grounded_second_look(R.judge_batches(rows), verdicts)
    return R.selected_flags(looked, rows.where("ord % 6 = 0")).select("ord", "selected", "batch", "editor_verdict")


@query(f"""WITH {EVENT}, r AS (SELECT DISTINCT user_id, k % 3 AS m FROM ev WHERE user_id < 50) SELECT user_id, CASE WHEN m = 0 THEN 'granted' WHEN m = 1 THEN 'reported' ELSE 'unchecked' END AS claim_status, CASE WHEN m = 2 THEN 'adverse' WHEN m = 0 THEN 'confirmed' ELSE 'unstated' END AS basis FROM r""")
def evidence_and_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims after a check of evidence, and the basis that a text states."""
    rows = event_rows(spark, sf_dir).where("user_id < 50").select("user_id", (F.col("k") % 3).alias("m")).distinct()
    out = R.apply_evidence(rows, F.lit("unchecked"), F.col("m") < 2, F.col("m") == 0)
    text = F.when(F.col("m") == 2, "bad news").when(F.col("m") == 0, "has said so").otherwise("")
    return out.select("user_id", "claim_status", E.claim_basis(text, (("adverse", "bad"), ("confirmed", "said"))).alias("basis"))


@query(f"""WITH {EVENT}, l AS (SELECT row_number() OVER (ORDER BY ord) AS line, k % 40 AS a, ord % 9 = 0 AS leader FROM ev WHERE ord < 60), k AS (SELECT a, min(line) AS line, arg_min(leader, line) AS leader FROM l WHERE a < 30 GROUP BY a)
SELECT a AS ord, line, leader FROM k ORDER BY leader DESC, line LIMIT 3""")
def grounded_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines of existing articles, once each, the leader first."""
    rows = event_rows(spark, sf_dir).where("ord < 60")
    lines = rows.select(F.row_number().over(_by("ord")).cast("bigint").alias("line"), (F.col("k") % 40).alias("ord"), (F.col("ord") % 9 == 0).alias("leader"))
    return E.grounded_lines(lines, spark.range(30).select(F.col("id").alias("ord"))).select("ord", "line", "leader")


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


@query(f"""WITH {EVENT}, r AS (SELECT CAST(user_id AS VARCHAR) AS run_id, CASE WHEN max(k) % 5 = 0 THEN 'failure' ELSE 'success' END AS conclusion, CASE max(k) % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'ok' END AS delivery FROM ev GROUP BY user_id), s AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id FROM ev WHERE event_type = 'purchase' AND k % 2 = 0)
SELECT run_id, 'workflow_failed' AS code FROM r WHERE conclusion <> 'success' UNION ALL SELECT run_id, 'delivery_failed' FROM r WHERE delivery = 'failed' UNION ALL SELECT run_id, 'delivery_unverified' FROM r WHERE delivery <> 'skipped' AND run_id NOT IN (SELECT run_id FROM s)""")
def delivery_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    k = F.max("k")
    reports = rows.groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.when(k % 5 == 0, "failure").otherwise("success").alias("conclusion"), F.when(k % 3 == 0, "failed").when(k % 3 == 1, "skipped").otherwise("ok").alias("delivery"), F.lit("daily").alias("kind"))
    sent = rows.where("event_type = 'purchase' AND k % 2 = 0").select(F.col("user_id").cast("string").alias("run_id"))
    return monitor.delivery_findings(reports, sent).select("run_id", "code")


@query(f"WITH {EVENT}, w AS (SELECT event_type AS code, count(*) AS n, count(DISTINCT day) AS days FROM ev WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' AND value > 90 GROUP BY event_type) SELECT code, n, days, days >= 3 AS repeated FROM w")
def weekly_issue_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = event_rows(spark, sf_dir).where("value > 90").select("day", F.col("event_type").alias("code"))
    return monitor.weekly_review(issues, F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date"))


@query(f"WITH {EVENT} SELECT event_type AS model, count(*) AS calls, count(*) FILTER (WHERE k % 10 = 0) AS failures, CAST(sum(CASE WHEN k % 10 = 0 THEN 0 ELSE k END) AS BIGINT) AS input_tokens, CAST(sum(k % 3) AS BIGINT) AS output_tokens FROM ev GROUP BY event_type")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return searches.usage(event_rows(spark, sf_dir).select(F.col("event_type").alias("model"), F.when(k % 10 == 0, "late").alias("error"), F.when(k % 10 != 0, k).alias("input_tokens"), (k % 3).alias("output_tokens")))


@query(f"WITH {EVENT}, s AS (SELECT 'u' || CAST(user_id AS VARCHAR) || '@x.com' AS sender, event_type AS subject, ord FROM ev) SELECT ord, CASE WHEN sender = 'u3@x.com' THEN 1 WHEN contains(subject, 'pur') THEN 2 END AS policy_ord FROM s")
def sender_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).select("ord", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x.com")).alias("sender"), F.col("event_type").alias("subject"))
    policies = spark.createDataFrame([(1, "u3@x.com", "none.com", "zzz"), (2, "q@x.com", "x.com", "pur")], "policy_ord int, address string, domain string, alias string")
    return J.sender_policy(rows, policies).select("ord", "policy_ord")


@query(f"WITH {EVENT}, p AS (SELECT 'day' || CAST(k % 9 AS VARCHAR) AS key, day, k % 4 AS page, ord AS pos, value FROM ev) SELECT key, CAST(day AS VARCHAR) AS day, arg_min(value, (page, pos)) AS value FROM p GROUP BY key, day")
def first_value_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a series' pages the first value of a day counts."""
    k = F.col("k")
    points = event_rows(spark, sf_dir).select(F.concat(F.lit("day"), (k % 9).cast("string")).alias("key"), "day", (k % 4).alias("page"), F.col("ord").alias("pos"), "value")
    return market.first_per_day(points).select("key", F.col("day").cast("string").alias("day"), "value")


@query(f"WITH {EVENT}, r AS (SELECT ord, strftime(day, '%Y%m%d') AS d, value FROM ev) SELECT 'x' AS key, CAST(CAST(strptime(d, '%Y%m%d') AS DATE) AS VARCHAR) AS day, round(value, 3) AS value FROM r")
def literal_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of replies written as lists of literals, and of CSV lines (both halves of the table)."""
    rows = event_rows(spark, sf_dir).select("ord", F.date_format("day", "yyyyMMdd").alias("d"), "day", F.round("value", 3).cast("string").alias("v"))
    text = F.concat(F.lit("[['d','o','h','l','c'], [\""), "d", F.lit("\", 1, 2, 3, "), "v", F.lit(", 9]]"))
    literal = market.literal_points(rows.where("ord % 2 = 0").select(text.alias("value")), F.lit("x"))
    lines = market.csv_points(rows.where("ord % 2 = 1").select(F.concat_ws(",", F.col("day").cast("string"), "v").alias("value")), F.lit("x"))
    return literal.unionByName(lines).select("key", F.col("day").cast("string").alias("day"), F.round("value", 3).alias("value"))


@query(f"""WITH {HEAD}, k AS (SELECT ord, substr(sha256('m' || chr(0) || head), 1, 32) AS cache_key FROM hd) SELECT ord, cache_key, CASE WHEN ord % 3 = 0 THEN 'yes' END AS reply, CASE WHEN ord % 3 <> 0 THEN 'replay_miss' END AS error FROM k JOIN hd USING (ord) WHERE head IN (SELECT head FROM hd GROUP BY head HAVING count(*) = 1)""")
def replay_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a judge by model and prompt; in replay a miss is an error."""
    rows = headlines(spark, sf_dir).select("ord", F.col("title").alias("prompt"))
    once = rows.groupBy("prompt").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).where("n = 1").select("ord", "prompt")
    cache = once.where("ord % 3 = 0").select(judge.cache_key("m", F.col("prompt")).alias("key"), F.lit("yes").alias("reply"))
    answered, missing = judge.cached(once, cache, "m")
    none = F.lit(None).cast("string")
    return answered.select("ord", "cache_key", "reply", none.alias("error")).unionByName(missing.select("ord", "cache_key", none.alias("reply"), "error"))


@query(f"""WITH {HEAD}, t AS (SELECT ord, CASE WHEN regexp_matches(head, '[ü]') OR NOT regexp_matches(head, '[A-Za-z]') THEN head WHEN ord % 2 = 0 THEN 'ü ' || head ELSE head END AS title, CASE WHEN regexp_matches(head, '[ü]') OR NOT regexp_matches(head, '[A-Za-z]') THEN NULL ELSE head END AS title_orig FROM hd) SELECT * FROM t""")
def title_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations taken where they are in the other script, the original kept beside them."""
    rows = headlines(spark, sf_dir).select("ord", "title")
    replies = rows.select("ord", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("ü "), "title")).otherwise("plain").alias("title"))
    return R.translated(rows, replies, (), script="ü").select("ord", "title", "title_orig")


@query(f"""WITH {URL}, h AS (SELECT page_id, url, regexp_replace(lower(authority), '^www\\.', '') AS host FROM u) SELECT page_id, CASE WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'korea' WHEN regexp_extract(url, '[?&](?:hl|lang)=([a-z]+)', 1) = 'ko' THEN 'korea' ELSE 'global' END AS region FROM h""")
def source_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame([("example.org", "korea")], "domain string, region string")
    return R.source_region(table(spark, sf_dir, "pages").select("page_id", "url"), registry).select("page_id", "region")


@query(f"""WITH {EVENT}, e AS (SELECT *, user_id % 20 AS f FROM ev WHERE user_id < 200) SELECT a.ord AS i, b.ord AS j, NOT ((a.event_type <> b.event_type AND a.k % 2 = 0 AND b.k % 2 = 0) OR (a.k % 3 > 0 AND b.k % 3 > 0 AND a.k % 3 <> b.k % 3)) AS compatible, abs(date_diff('day', a.day, b.day)) <= 1 AND a.event_type = b.event_type AND (a.k % 5 = 0 OR b.k % 5 = 0) AS reaction
FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND a.ord < b.ord""")
def event_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vetoes of event types and funding stages, and reactions to a policy, on pairs of a user and day."""
    k = F.col("k")
    none = F.array().cast("array<string>")
    rows = event_rows(spark, sf_dir).where("user_id < 200").select("ord", "user_id", "day", F.when(k % 2 == 0, F.array("event_type")).otherwise(none).alias("types"), F.when(k % 3 > 0, (k % 3).cast("string")).otherwise("").alias("stage"), F.array("event_type").alias("actors"), (k % 5 == 0).alias("reaction"))
    side = lambda n, p: rows.select("user_id", "day", F.col("ord").alias(n), *[F.col(c).alias(f"{p}_{c}") for c in ("types", "stage", "actors", "reaction")])
    both = side("i", "a").join(side("j", "b"), ["user_id", "day"]).where("i < j")
    of = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    return both.select("i", "j", C.events_compatible(of("types"), of("stage")).alias("compatible"), C.policy_reaction(F.lit(0), of("actors"), of("actors"), of("reaction"), (none, none)).alias("reaction"))


@query(f"WITH {HEAD} SELECT ord, CASE WHEN regexp_matches(head, '(?i)^the') THEN 'foreign' ELSE 'own' END AS kind, CASE WHEN ord % 3 = 0 AND regexp_matches(head, '(?i)que') THEN TRUE ELSE FALSE END OR regexp_matches(head, 'und') AS outside FROM hd")
def theme_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether themes outside one field, or a pattern, speak for an article."""
    t = F.col("title")
    themes = F.when((F.col("ord") % 3 == 0) & t.rlike("(?i)que"), F.array(F.lit("care"))).otherwise(F.array(F.lit("climate")))
    return headlines(spark, sf_dir).select("ord", F.when(t.rlike("(?i)^the"), "foreign").otherwise("own").alias("kind"), K.theme_outside(themes, t, ("care", "school"), "und").alias("outside"))


@query(f"WITH {EVENT} SELECT CAST(min(CASE WHEN CAST(day AS VARCHAR) = '2024-01-05' THEN 1 ELSE 2 END) = 1 AS BOOLEAN) AS has_day, count(DISTINCT day) AS days FROM ev")
def delivered_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an edition of a day was delivered, and on how many days any was."""
    rows = event_rows(spark, sf_dir).select("day")
    found = H.already_delivered([rows.where("false"), rows], "day", F.lit("2024-01-05").cast("date"))
    return rows.agg(F.lit(found).alias("has_day"), F.count_distinct("day").alias("days"))


@query(f"WITH {EVENT}, l AS (SELECT CASE WHEN k % 4 = 0 THEN 'reject' ELSE 'keep' END AS label, value > 30 AS kept, event_type AS cat, CASE WHEN k % 2 = 0 THEN event_type ELSE 'other' END AS expected FROM ev) SELECT count(*) FILTER (WHERE label = 'reject' AND NOT kept) AS caught_rejects, count(*) FILTER (WHERE label = 'reject') AS rejects, count(*) FILTER (WHERE label = 'keep' AND kept) AS kept_keeps, count(*) FILTER (WHERE label = 'keep') AS keeps, count(*) FILTER (WHERE label = 'keep' AND kept AND cat = expected) AS right_category FROM l")
def eval_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = event_rows(spark, sf_dir).select(F.when(k % 4 == 0, "reject").otherwise("keep").alias("label"), (F.col("value") > 30).alias("kept"), F.col("event_type").alias("cat"), F.when(k % 2 == 0, F.col("event_type")).otherwise("other").alias("expected_category"))
    return evaluate.evaluate(rows, F.col("kept"), F.col("cat"))


@query(f"WITH {EVENT}, s AS (SELECT 'k' || CAST(k % 6 AS VARCHAR) AS key, day, value FROM ev WHERE day < DATE '2024-01-15'), l AS (SELECT key, max(day) AS latest_day FROM s GROUP BY key) SELECT count(latest_day) AS available, 8 AS total, count(DISTINCT latest_day) > 1 AS mixed_days FROM l")
def indicator_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).where("day < DATE '2024-01-15'").groupBy(F.concat(F.lit("k"), (F.col("k") % 6).cast("string")).alias("key")).agg(F.max("day").alias("latest_day"))
    return M.series_health(rows, [f"k{i}" for i in range(8)])
