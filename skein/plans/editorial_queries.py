"""Queries of the editorial operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import clusters as C
from ..operators import editorial as E
from ..operators import joins as J
from ..operators import rules as R
from ..operators import state as H
from ..sources import pages as P
from ..sources import render
from .registry import ART, EVENT, URL, articles, event_rows, query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stories: the type is the family (purchases are macro), user and key the entities."""
    k = F.col("k")
    family = F.when(F.col("event_type") == "purchase", "macro_rates").when(F.col("event_type") == "view", "funding").otherwise("policy")
    entities = F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("k"), (k % 10).cast("string")))
    return event_rows(spark, sf_dir).select("ord", "day", family.alias("family"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("series_"), (k % 3).cast("string"))).alias("stage"), entities.alias("entities"), (k % 4).cast("int").alias("status"))


@query(f"""WITH {EVENT}, e AS (SELECT ord, day, CASE WHEN event_type = 'purchase' THEN 'macro_rates' WHEN event_type = 'view' THEN 'funding' ELSE 'policy' END AS family,
CASE WHEN k % 3 = 0 THEN '' ELSE 'series_' || CAST(k % 3 AS VARCHAR) END AS stage, user_id AS u, k % 10 AS t, CAST(k % 4 AS INTEGER) AS status FROM ev),
r AS (SELECT * FROM e WHERE day = DATE '2024-01-25'), m AS (SELECT * FROM e WHERE day < DATE '2024-01-25'),
p AS (SELECT r.ord, m.status FROM r JOIN m ON r.family = m.family AND m.day BETWEEN r.day - 7 AND r.day - 1 AND (r.family = 'macro_rates' OR (r.u = m.u AND r.t = m.t AND NOT (r.family = 'funding' AND r.stage <> '' AND m.stage <> '' AND r.stage <> m.stage))))
SELECT ord, max(status) AS told FROM p GROUP BY ord""")
def cross_day_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    day = F.lit("2024-01-25").cast("date")
    return E.told_before(rows.where(F.col("day") == day), rows.where(F.col("day") < day))


@query("""WITH RECURSIVE n AS (SELECT vec_id AS ord, 'cat' || CAST(vec_id % 3 AS VARCHAR) AS category, 'p' || CAST(vec_id % 11 AS VARCHAR) AS publisher, CASE WHEN vec_id % 3 = 0 THEN vec_id % 41 END AS a, CASE WHEN vec_id % 7 = 0 THEN vec_id % 13 END AS b, CAST(label % 4 AS INTEGER) AS importance, CAST(vec_id % 17 AS DOUBLE) AS score FROM embeddings),
e AS (SELECT x.ord AS i, y.ord AS j FROM n x JOIN n y ON x.a = y.a UNION SELECT x.ord, y.ord FROM n x JOIN n y ON x.b = y.b), r AS (SELECT ord AS i, ord AS j FROM n UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i), c AS (SELECT i AS ord, min(j) AS component FROM r GROUP BY i),
p AS (SELECT n.*, component FROM n JOIN c USING (ord)), f AS (SELECT component, least(count(DISTINCT publisher), 5) AS publishers, least(count(*), 5) AS members, max(importance) AS ti, max(score) AS ts FROM p GROUP BY component),
m AS (SELECT component, category, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, min(ord)) AS r FROM p GROUP BY component, category),
d AS (SELECT f.*, category AS main_category, row_number() OVER (PARTITION BY category ORDER BY publishers DESC, members DESC, ti DESC, ts DESC, component) AS round FROM f JOIN m USING (component) WHERE r = 1),
b AS (SELECT component, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY r) AS representatives FROM (SELECT component, ord, row_number() OVER (PARTITION BY component ORDER BY importance DESC, score DESC, ord) AS r FROM p) WHERE r <= 3 GROUP BY component)
SELECT component, publishers, members, main_category, representatives, CAST(row_number() OVER (ORDER BY round, main_category, component) AS INTEGER) AS place FROM d JOIN b USING (component) QUALIFY place <= 16""")
def agenda_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ord")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), "label").select("ord", F.concat(F.lit("cat"), (n % 3).cast("string")).alias("category"), F.concat(F.lit("p"), (n % 11).cast("string")).alias("publisher"), F.when(n % 3 == 0, n % 41).alias("a"), F.when(n % 7 == 0, n % 13).alias("b"), (F.col("label") % 4).cast("int").alias("importance"), (n % 17).cast("double").alias("score"), F.array(F.lit("s")).alias("signals"))
    return E.topic_cards(rows, ["a", "b"]).select("component", "publishers", "members", "main_category", F.array_join(F.transform("representatives", lambda r: r.cast("string")), ",").alias("representatives"), "place")


_HITS = {"local": "(le|les|des)", "foreign": "(the|and)"}
_M = r"regexp_matches(lower({0}), '(^|[^\p{{L}}\p{{N}}_]){1}([^\p{{L}}\p{{N}}_]|$)')"


@query(f"""WITH {ART}, s AS (SELECT ord, region, {_M.format('title', _HITS['local'])} AS tl, {_M.format('title', _HITS['foreign'])} AS tf, {_M.format('text', _HITS['local'])} AS l, {_M.format('text', _HITS['foreign'])} AS f FROM art),
r AS (SELECT *, CASE WHEN tf AND NOT tl THEN 'foreign_title' WHEN l AND NOT f THEN 'local_content' WHEN f AND NOT l THEN 'foreign_content' ELSE 'configured' END AS reason FROM s)
SELECT ord, reason, CASE WHEN reason = 'local_content' THEN 'korea' WHEN reason = 'configured' THEN region ELSE 'global' END AS region FROM r""")
def content_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda w: rf"(?U)\b{w}\b"
    region, reason = E.content_region(F.col("region"), F.lower("title"), F.lower("text"), word(_HITS["local"]), word(_HITS["foreign"]))
    return articles(spark, sf_dir).select("ord", reason.alias("reason"), region.alias("region"))


@query(f"""WITH {ART}, v AS (SELECT doc_id AS ord, quality = 1 AS keep, CAST(quality * 8 + toxic AS DOUBLE) AS score FROM labels)
SELECT art.ord, CASE WHEN keep IS NULL THEN 'unreviewed' WHEN keep THEN 'keep' ELSE 'reject' END AS verdict, CASE WHEN source = 'src1' OR keep IS NULL THEN category ELSE 'judged' END AS category, CASE WHEN region = 'korea' AND score > 5 THEN 5.0 ELSE score END AS editor_score, CASE WHEN keep IS NULL THEN '' ELSE 'key_' || CAST(art.ord AS VARCHAR) END AS event_key FROM art LEFT JOIN v USING (ord)""")
def verdict_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    verdicts = labels.select(F.col("doc_id").alias("ord"), (F.col("quality") == 1).alias("keep"), F.lit("judged").alias("category"), (F.col("quality") * 8 + F.col("toxic")).cast("double").alias("score"), F.concat(F.lit("Key "), F.col("doc_id").cast("string"), F.lit("!")).alias("event_key"))
    # least() skips nulls in Spark: an unreviewed row has no score
    out = R.apply_verdicts(articles(spark, sf_dir), verdicts, locked=F.col("source") == "src1", unverified=(F.col("region") == "korea") & F.col("v_score").isNotNull())
    return out.select("ord", F.col("editor_verdict").alias("verdict"), "category", "editor_score", F.col("editor_event_key").alias("event_key"))


@query("SELECT doc_id AS ord, CAST(CASE WHEN toxic = 1 OR quality = 1 THEN greatest(doc_id % 4, least(doc_id % 4 + 1, 2)) ELSE doc_id % 4 END AS INTEGER) AS importance, least(10.0, CAST(doc_id % 11 AS DOUBLE) + CASE WHEN toxic = 1 THEN 1.0 WHEN quality = 1 THEN 0.5 ELSE 0 END) AS score FROM labels")
def agenda_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = F.when(F.col("toxic") == 1, "strong").when(F.col("quality") == 1, "topic").otherwise("none")
    n = F.col("doc_id")
    importance, score = R.promotions((n % 4).cast("int"), (n % 11).cast("double"), strength)
    return table(spark, sf_dir, "labels").select(n.alias("ord"), importance.cast("int").alias("importance"), score.alias("score"))


@query(f"WITH {EVENT} SELECT ord, CASE WHEN value / 100 >= 0.7 THEN 'flag' WHEN value / 100 > 1 - 0.7 THEN 'uncertain' ELSE 'clear' END AS flag FROM ev")
def noise_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).select("ord", R.noise_flags(F.col("value") / 100).alias("flag"))


@query(f"WITH {EVENT}, b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ord) AS r FROM ev WHERE value BETWEEN 40 AND 60) SELECT ord, event_type FROM b WHERE r <= 8 ORDER BY value DESC, ord LIMIT 20")
def boundary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.boundary_candidates(event_rows(spark, sf_dir), "event_type", "value", 40, 60, 8, 20).select("ord", "event_type")


@query(f"WITH {EVENT} SELECT ord, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS category_ord FROM ev")
def category_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bucketed(event_rows(spark, sf_dir), {"purchase": 0, "view": 1, "other": 2}, "event_type").select("ord", "category_ord")


@query("""WITH e AS (SELECT conv_id AS run, list(text ORDER BY turn) AS a FROM conversations GROUP BY conv_id), i AS (SELECT conv_id AS run, turn + 1 AS idx, turn FROM conversations)
SELECT run, turn, CASE WHEN idx < len(a) THEN a[idx + 1] END AS found FROM i JOIN e USING (run)""")
def positional_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's issue points at the next turn by position; past the end it finds none."""
    rows = table(spark, sf_dir, "conversations")
    editions = rows.groupBy(F.col("conv_id").alias("run_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("articles"))
    issues = rows.select(F.col("conv_id").alias("run_id"), (F.col("turn") + 1).cast("int").alias("article"), "turn")
    return J.by_position(issues, editions).select(F.col("run_id").alias("run"), "turn", "found")


@query(f"""WITH {EVENT}, g AS (SELECT user_id, day, list(DISTINCT k % 7) AS sel, list(DISTINCT k % 5 + 2) AS om FROM ev GROUP BY ALL), b AS (SELECT *, list_concat(sel, om) AS ids FROM g)
SELECT user_id, CAST(day AS VARCHAR) AS day, concat_ws(',', CASE WHEN len(list_distinct(ids)) <> len(ids) THEN 'repeated_id' END, CASE WHEN len(list_filter(ids, lambda x: x > 6)) > 0 THEN 'unknown_id' END, CASE WHEN len(list_filter([0, 1, 2, 3, 4, 5, 6], lambda x: NOT list_contains(ids, x))) > 0 THEN 'not_covered' END) AS errors FROM b""")
def reply_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    groups = event_rows(spark, sf_dir).groupBy("user_id", "day").agg(F.collect_set(k % 7).alias("sel"), F.collect_set(k % 5 + 2).alias("om"))
    every = F.array(*[F.lit(i).cast("bigint") for i in range(7)])
    return groups.select("user_id", F.col("day").cast("string").alias("day"), F.array_join(E.reply_errors(F.col("sel"), F.col("om"), every), ",").alias("errors"))


@query(f"""WITH {URL}, h AS (SELECT page_id, path, regexp_replace(lower(authority), '^www\\.', '') AS host FROM u) SELECT page_id, lower(host) LIKE '%spam%' AND (host = 'example.com' OR host LIKE '%.example.com' OR host = 'example.org' OR host LIKE '%.example.org') AS needs FROM h""")
def remote_evidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", R.needs_evidence(F.lower(T.host_of(F.col("url"))), F.col("url"), ("example.com", "example.org"), "spam").alias("needs"))


@query("SELECT s_suppkey, s_name, r_name AS region, CASE WHEN r_name IS NULL THEN 'source' ELSE 'nation' END AS found_by FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region by nation key, as a source registry is asked by feed and then by source."""
    nations = table(spark, sf_dir, "nation").join(J.small(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("name"), F.col("r_name").alias("region"))
    rows = table(spark, sf_dir, "supplier").withColumn("feed", F.col("s_nationkey").cast("string")).withColumn("source", F.col("s_name"))
    out = J.registry_lookup(rows, nations, ["feed", "source"], "name", ["region"])
    return out.select("s_suppkey", "s_name", "region", F.when(F.col("region").isNull(), "source").otherwise("nation").alias("found_by"))


@query()
def html_semantic_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.list_page_items(table(spark, sf_dir, "pages"))


@query(f"""WITH {EVENT}, u AS (SELECT DISTINCT user_id FROM ev WHERE day < DATE '2024-01-10' AND value > 98) SELECT ord FROM ev WHERE day >= DATE '2024-01-10' AND user_id NOT IN (SELECT user_id FROM u)""")
def seen_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    cut = F.lit("2024-01-10").cast("date")
    seen = rows.where((F.col("day") < cut) & (F.col("value") > 98)).select(F.col("user_id").alias("value"))
    return J.unseen(rows.where(F.col("day") >= cut), seen, ["user_id"]).select("ord")


@query("SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS size, CASE WHEN contains(lower(text), 'may') AND NOT contains(lower(text), 'might') THEN FALSE ELSE TRUE END AS preserved FROM conversations")
def qualifier_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("size"), T.preserves_qualifiers(text, text, (("may", "might"),)).alias("preserved"))


@query(f"WITH {ART}, d AS (SELECT category, '*' || category || '*' AS digest FROM art GROUP BY category) SELECT row_number() OVER (ORDER BY category) - 1 AS pos, 'section' AS type, digest AS text FROM d")
def block_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = articles(spark, sf_dir).select("category").distinct().withColumn("digest", F.concat(F.lit("*"), F.col("category"), F.lit("*")))
    blocks = render.blocks(digests).select(F.posexplode(F.from_json("blocks", "array<struct<type:string,text:struct<type:string,text:string>>>")).alias("pos", "b"))
    return blocks.select(F.col("pos").cast("bigint").alias("pos"), "b.type", F.col("b.text.text").alias("text"))


@query(f"""WITH {EVENT}, l AS (SELECT user_id AS key, max(ts) AS sent_at FROM ev WHERE day < DATE '2024-01-25' AND event_type = 'purchase' GROUP BY user_id), f AS (SELECT DISTINCT user_id AS key FROM ev WHERE day = DATE '2024-01-28')
SELECT f.key FROM f LEFT JOIN l USING (key) WHERE sent_at IS NULL OR TIMESTAMP '2024-01-29 00:00:00' >= sent_at + INTERVAL 7 DAY""")
def ledger_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    ledger = rows.where("day < DATE '2024-01-25' AND event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("sent_at"))
    findings = rows.where("day = DATE '2024-01-28'").select(F.col("user_id").alias("key"))
    return H.ledger_due(findings, ledger, "key", F.lit("2024-01-29 00:00:00").cast("timestamp")).select("key")


@query(f"WITH {ART} SELECT a.ord AS i, b.ord AS j FROM art a JOIN art b ON a.ord < b.ord AND a.source = b.source AND a.category = b.category AND abs(date_diff('day', a.day, b.day)) <= 2")
def topic_series_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one source and topic within two days: the day is part of the join's key."""
    rows = articles(spark, sf_dir).select("ord", "source", "category", "day")
    a, b = (rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns]) for p in "ab")
    around = b.withColumn("_day", F.explode(F.sequence(F.date_sub("b_day", 2), F.date_add("b_day", 2))))
    met = a.join(around, (F.col("a_source") == F.col("b_source")) & (F.col("a_category") == F.col("b_category")) & (F.col("a_day") == F.col("_day")) & (F.col("a_ord") < F.col("b_ord")))
    near = C.topic_series((F.col("a_category"), F.col("b_category")), (F.col("a_source"), F.col("b_source")), D.gap_days(F.col("a_day"), F.col("b_day")))
    return met.where(near).select(F.col("a_ord").alias("i"), F.col("b_ord").alias("j"))
