"""Queries of clusters, joins, memory, quotas, series, monitoring and the composed editions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters as C
from ..operators import joins as J
from ..operators import rules as R
from ..operators import select as S
from ..operators import series as M
from ..operators import state as H
from ..sources import archive as A
from ..sources import render
from .registry import ART, EVENT, articles, event_rows, query, table

_TITLE_KEY = "lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))"
_GROUPS = f"""WITH {ART}, g AS (SELECT *, {_TITLE_KEY} AS norm_title, min(ord) OVER (PARTITION BY {_TITLE_KEY}) AS leader FROM art),
e AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY size DESC, day DESC, ord) = 1 AS is_representative FROM g)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = C.title_groups(articles(spark, sf_dir))
    return C.elect(grouped, ["leader"], [F.desc("size"), F.desc("day")])


@query(_GROUPS + " SELECT ord, leader FROM e")
def exact_title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("ord", "leader")


@query(_GROUPS + " SELECT leader, ord AS representative FROM e WHERE is_representative")
def representative_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).where("is_representative").select("leader", F.col("ord").alias("representative"))


@query(_GROUPS + """, f AS (SELECT leader, source, min(CASE WHEN is_representative THEN 0 ELSE 1 END) AS a, arg_min(ord, (CASE WHEN is_representative THEN 0 ELSE 1 END, ord)) AS o FROM e GROUP BY leader, source),
s AS (SELECT leader, string_agg(source, ',' ORDER BY a, o) AS sources FROM f GROUP BY leader)
SELECT leader, count(*) AS duplicate_count, min(CASE WHEN is_representative THEN ord END) AS representative, any_value(sources) AS sources FROM e JOIN s USING (leader) GROUP BY leader""")
def merge_group_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = C.merge_groups(_groups(spark, sf_dir), "leader", ["source"])
    return merged.select("leader", "duplicate_count", "representative", F.array_join("sources", ",").alias("sources"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("ord", F.explode(T.headline_tokens(F.col("title"))).alias("token"))


_TOKENS = f"WITH {ART}, t AS (SELECT DISTINCT ord, unnest(regexp_extract_all(lower(title), '[a-z0-9가-힣]+')) AS token FROM art), tt AS (SELECT * FROM t WHERE length(token) >= 2)"


@query(_TOKENS + ", r AS (SELECT ord, token FROM tt WHERE token IN (SELECT token FROM tt GROUP BY token HAVING count(*) BETWEEN 2 AND 6)) SELECT a.ord AS i, b.ord AS j, count(*) AS shared FROM r a JOIN r b ON a.token = b.token AND a.ord < b.ord GROUP BY ALL")
def rare_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_pairs(_tokens(spark, sf_dir))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), "embedding", "label")


_PAIRS = "p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"


@query(f"WITH {_PAIRS} SELECT i, j, round(sim, 6) AS sim FROM p WHERE sim >= 0.42")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.vector_pairs(_vectors(spark, sf_dir), 0.42).select("i", "j", F.round("sim", 6).alias("sim"))


@query()
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return C.leader_clusters(rows, C.vector_pairs(rows, 0.30))


@query()
def near_dup_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("ord", F.concat(F.lit("k"), (F.col("ord") % 97).cast("string")).alias("event_key"), F.col("label").cast("double").alias("score"), "embedding")
    keyed = rows.withColumn("event_key", F.when(F.col("ord") % 3 == 0, F.col("event_key")))
    return C.near_duplicate_filter(keyed, C.vector_pairs(rows, 0.30))


@query()
def sequential_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return C.sequential_groups(rows, C.vector_pairs(rows, 0.36))


@query("""WITH RECURSIVE n AS (SELECT vec_id AS ord, CASE WHEN vec_id % 4 = 0 THEN vec_id % 31 END AS a, CASE WHEN vec_id % 5 = 0 THEN vec_id % 17 END AS b FROM embeddings),
e AS (SELECT x.ord AS i, y.ord AS j FROM n x JOIN n y ON x.a = y.a UNION SELECT x.ord, y.ord FROM n x JOIN n y ON x.b = y.b), r AS (SELECT ord AS i, ord AS j FROM n UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i)
SELECT i AS ord, min(j) AS component FROM r GROUP BY i""")
def topic_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ord")
    rows = _vectors(spark, sf_dir).select("ord", F.when(n % 4 == 0, n % 31).alias("a"), F.when(n % 5 == 0, n % 17).alias("b"))
    return C.topic_components(rows, "ord", ["a", "b"])


@query("SELECT a.vec_id AS ord, round(max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS best FROM embeddings a, embeddings b WHERE a.label < 5 AND b.label >= 5 GROUP BY a.vec_id HAVING max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) >= 0.3")
def cosine_store_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return J.vector_memory(rows.where("label < 5"), rows.where("label >= 5"), 0.3).select("ord", F.round("best", 6).alias("best"))


@query("SELECT vec_id FROM embeddings QUALIFY row_number() OVER (ORDER BY vec_id >= 400 DESC, CASE WHEN vec_id < 400 THEN vec_id ELSE 0 END DESC, vec_id DESC) <= 200")
def store_cap_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest of a store of vectors 0 to 399 and the new ones after them."""
    rows = table(spark, sf_dir, "embeddings")
    return H.capped(rows.where("vec_id < 400").select("vec_id", F.col("vec_id").alias("seq")), rows.where("vec_id >= 400").select("vec_id"), "vec_id", "seq", 200)


@query("WITH o AS (SELECT url, min(page_id) AS seq FROM pages WHERE page_id < 100 GROUP BY url), n AS (SELECT DISTINCT url FROM pages WHERE page_id >= 100 AND url NOT IN (SELECT url FROM o)), x AS (SELECT 0 AS age, seq, url FROM o UNION ALL SELECT 1, 0, url FROM n) SELECT url FROM x QUALIFY row_number() OVER (ORDER BY age DESC, seq DESC, url DESC) <= 150")
def seen_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    old = rows.where("page_id < 100").groupBy("url").agg(F.min("page_id").alias("seq"))
    return H.capped(old, rows.where("page_id >= 100"), "url", "seq", 150)


@query("""WITH w AS (SELECT conv_id * 1000 + turn AS ord, role, text, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]+|[가-힣]{2,}'), lambda w: length(w) >= 5)) AS t FROM conversations),
a AS (SELECT ord AS a, unnest(t) AS term FROM w WHERE role = 'user'), n AS (SELECT ord AS n, unnest(t) AS term FROM w WHERE role <> 'user'),
m AS (SELECT a, n FROM a JOIN n USING (term) GROUP BY a, n HAVING count(*) >= 3 AND max(length(term)) >= 8), p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n) AS place FROM m)
SELECT a AS ord, n AS note, CAST(place AS INTEGER) AS place, left(text, 300) AS excerpt FROM p JOIN w ON w.ord = n WHERE place <= 2""")
def note_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "role", F.col("text").alias("title"), F.col("text").alias("excerpt"))
    return J.attach_notes(rows.where("role = 'user'"), rows.where("role <> 'user'"))


@query(f"WITH {ART}, d AS (SELECT source, {_TITLE_KEY} AS title, min(ord) AS first FROM art GROUP BY ALL) SELECT title, count(*) AS n_records, string_agg(source, ',' ORDER BY first) AS sources FROM d GROUP BY title")
def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (source, title) records of each story, first come first."""
    rows = articles(spark, sf_dir).select("ord", "source", F.lower(F.trim(F.regexp_replace("title", r"\s+", " "))).alias("title"))
    once = rows.groupBy("title", "source").agg(F.min("ord").alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda r: r["source"])
    return once.groupBy("title").agg(F.count("*").alias("n_records"), F.array_join(ordered, ",").alias("sources"))


@query(f"WITH {EVENT} SELECT k, CAST(min(day) AS VARCHAR) AS first_seen, CAST(max(day) AS VARCHAR) AS last_seen, count(*) AS stories, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS categories, max(value) AS score, bool_or(value > 90) AS major FROM ev GROUP BY k")
def weekly_event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).groupBy("k").agg(F.min("day").cast("string").alias("first_seen"), F.max("day").cast("string").alias("last_seen"), F.count("*").alias("stories"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("categories"), F.max("value").alias("score"), F.bool_or(F.col("value") > 90).alias("major"))


@query(f"""WITH {EVENT}, s AS (SELECT *, k % 4 AS stage FROM ev), w AS (SELECT *, max(day) OVER (PARTITION BY user_id) AS newest, count(DISTINCT stage) OVER (PARTITION BY user_id) AS stages FROM s),
l AS (SELECT user_id, min(stage) AS latest, count(DISTINCT stage) AS n_latest FROM w WHERE day = newest GROUP BY user_id),
r AS (SELECT w.*, latest, n_latest, row_number() OVER (PARTITION BY w.user_id, stage ORDER BY value DESC, ord) AS rn FROM w JOIN l USING (user_id))
SELECT ord, CASE WHEN stages > 1 AND n_latest = 1 AND stage <> latest THEN 'superseded_status' WHEN rn > 1 THEN 'same_target_cluster' END AS dedup_reason FROM r""")
def ipo_stage_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).withColumn("stage", F.col("k") % 4)
    return C.collapse_stages(rows, "user_id", "stage", "day", [F.desc("value")]).select("ord", "dedup_reason")


@query(f"WITH {EVENT}, f AS (SELECT *, CASE WHEN k % 2 = 0 THEN event_type || ':' || CAST(day AS VARCHAR) END AS family FROM ev) SELECT ord, family, CASE WHEN family IS NULL THEN value ELSE max(value) OVER (PARTITION BY family) END AS event_value FROM f QUALIFY family IS NULL OR row_number() OVER (PARTITION BY family ORDER BY k DESC, ord) = 1")
def macro_family_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).withColumn("family", F.when(F.col("k") % 2 == 0, F.concat_ws(":", "event_type", F.col("day").cast("string"))))
    return C.collapse_family(rows, "family", [F.desc("k")], ["value"]).select("ord", "family", "event_value")


@query(f"""WITH {EVENT}, r AS (SELECT ord, user_id, day, CAST(k % 4 AS INTEGER) AS status FROM ev WHERE day >= DATE '2024-01-20'), m AS (SELECT user_id, day, max(CAST(k % 4 AS INTEGER)) AS s FROM ev WHERE day < DATE '2024-01-20' GROUP BY ALL),
t AS (SELECT r.ord, r.status, max(m.s) AS told FROM r LEFT JOIN m ON r.user_id = m.user_id AND m.day BETWEEN r.day - 7 AND r.day - 1 GROUP BY ALL) SELECT ord, coalesce(told, -1) AS told, told IS NULL OR (status >= 2 AND status > told) AS kept FROM t""")
def recent_event_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir).select("ord", "user_id", "day", (F.col("k") % 4).cast("int").alias("status"))
    cut = F.lit("2024-01-20").cast("date")
    return J.recent_events(rows.where(F.col("day") >= cut), rows.where(F.col("day") < cut), "user_id", "day", 7, "status").select("ord", F.coalesce("told", F.lit(-1)).alias("told"), "kept")


@query(f"WITH {EVENT}, w AS (SELECT *, min(ord) OVER (PARTITION BY user_id, event_type) AS first_seen, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ord DESC) AS r FROM ev) SELECT user_id, event_type, ord, first_seen, value FROM w WHERE r = 1")
def archive_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latest_wins(event_rows(spark, sf_dir), ["user_id", "event_type"], "ord").select("user_id", "event_type", "ord", "first_seen", "value")


@query(f"WITH {EVENT} SELECT ord FROM ev WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'")
def archive_week_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import dates as D

    first, last = D.weekly_window(F.lit("2024-01-17").cast("date"))
    return event_rows(spark, sf_dir).where(F.col("day").between(first, last)).select("ord")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations")
def legacy_lines_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations")
    return H.fill_forward(lines, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("text")), "heading").select("conv_id", "turn", "heading")


@query(f"WITH {ART} SELECT category, region, ord, CAST(row_number() OVER (PARTITION BY category, region ORDER BY size DESC, ord) AS INTEGER) AS rank FROM art QUALIFY rank <= 3")
def topk_region_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_per_group(articles(spark, sf_dir), ["category", "region"], [F.desc("size")], 3).select("category", "region", "ord", "rank")


@query(f"WITH {ART}, s AS (SELECT *, row_number() OVER (PARTITION BY category, source ORDER BY size DESC, ord) AS sr FROM art) SELECT category, ord, CAST(row_number() OVER (PARTITION BY category ORDER BY sr > 2, size DESC, ord) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def soft_source_cap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.soft_cap(articles(spark, sf_dir), ["category"], "source", [F.desc("size")], 2, 10).select("category", "ord", "rank")


@query(f"WITH {ART}, s AS (SELECT *, row_number() OVER (PARTITION BY category, source ORDER BY size DESC, ord) AS sr FROM art), c AS (SELECT * FROM s WHERE sr <= 2) SELECT category, ord, CAST(row_number() OVER (PARTITION BY category ORDER BY size DESC, ord) AS INTEGER) AS rank FROM c QUALIFY rank <= 10")
def hard_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hard_cap(articles(spark, sf_dir), ["category"], "source", [F.desc("size")], 2, 10).select("category", "ord", "rank")


@query("""WITH p AS (SELECT *, CAST(contains(p_name, '1') AS INTEGER) AS f FROM part), n AS (SELECT *, sum(f) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM p),
k AS (SELECT * FROM n WHERE f = 0 OR c <= 2) SELECT p_brand, p_partkey AS ord, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM k QUALIFY rank <= 5""")
def token_cap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("ord", F.col("p_partkey"))
    return S.flag_cap(rows, ["p_brand"], F.contains("p_name", F.lit("1")), [F.desc("p_retailprice")], 2, 5).select("p_brand", "ord", "rank")


@query(f"""WITH {ART}, r AS (SELECT *, source = 'src7' AS wanted, row_number() OVER (PARTITION BY category ORDER BY size DESC, ord) AS rank FROM art),
x AS (SELECT *, max(CASE WHEN rank <= 5 AND wanted THEN 1 ELSE 0 END) OVER w AS has, max(CASE WHEN rank <= 5 THEN rank END) OVER w AS weakest, min(CASE WHEN rank > 5 AND wanted THEN rank END) OVER w AS best FROM r WINDOW w AS (PARTITION BY category)),
y AS (SELECT *, max(CASE WHEN rank = weakest THEN size END) OVER w AS low, max(CASE WHEN rank = best THEN size END) OVER w AS alt FROM x WINDOW w AS (PARTITION BY category)),
z AS (SELECT *, has = 0 AND best IS NOT NULL AND alt >= low - 20000 AS swap FROM y)
SELECT category, ord, coalesce(swap AND rank = best, FALSE) AS swapped_in FROM z WHERE CASE WHEN swap THEN (rank <= 5 AND rank <> weakest) OR rank = best ELSE rank <= 5 END""")
def swap_weakest_for_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.swap_in(articles(spark, sf_dir), ["category"], F.col("source") == "src7", "size", [F.desc("size")], 5, 20000.0).select("category", "ord", "swapped_in")


@query(f"""WITH {ART}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY size DESC, ord) AS c, row_number() OVER (PARTITION BY region ORDER BY size DESC, ord) AS g FROM art),
s AS (SELECT *, CASE WHEN source = 'src3' AND c <= 12 THEN 0 WHEN c = 1 OR g = 1 THEN 1 ELSE 2 END AS guard FROM r), p AS (SELECT *, row_number() OVER (ORDER BY guard, size DESC, ord) AS place FROM s)
SELECT ord, guard, CAST(place AS INTEGER) AS place FROM p WHERE place <= 21 OR guard = 0""")
def protected_global_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.ranked(articles(spark, sf_dir), ["category"], [F.desc("size")], "c")
    always = (F.col("source") == "src3") & (F.col("c") <= 12)
    return S.protected_cap_scaled(rows, "category", "region", always, [F.desc("size")], 21).select("ord", "guard", "place")


@query(f"WITH {ART}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY size DESC, ord) AS round FROM art) SELECT ord, category, CAST(row_number() OVER (ORDER BY round, category, ord) AS INTEGER) AS place FROM r QUALIFY place <= 16")
def cluster_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.round_robin(articles(spark, sf_dir), "category", [F.desc("size")], 16).select("ord", "category", "place")


@query()
def round_robin_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).withColumn("theme", F.col("ord") % 7)
    return S.theme_pool(rows, ["category"], "theme", "source", "size")


@query()
def soft_subtype_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), "p_brand", F.col("p_type").alias("kind"), (F.col("p_size") % 4).alias("importance"), (F.col("p_retailprice") / 100).alias("score"))
    return S.soft_diversity(rows, ["p_brand"], "kind", "importance", "score")


_POINTS = "pt AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("value"))


@query(f"""WITH {_POINTS}, c AS (SELECT key, arg_max(value, day) FILTER (day < DATE '1996-06-03') AS previous, arg_max(value, day) FILTER (day BETWEEN DATE '1996-06-03' AND DATE '1996-06-09') AS latest FROM pt GROUP BY key)
SELECT key, round(previous, 4) AS previous, round(latest, 4) AS latest, round((latest / previous - 1) * 100, 4) AS change FROM c""")
def series_weekly_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = (F.lit(d).cast("date") for d in ("1996-06-03", "1996-06-09"))
    out = M.weekly_change(_points(spark, sf_dir), start, end, F.lit("percent"))
    return out.select("key", *[F.round(c, 4).alias(c) for c in ("previous", "latest", "change")])


@query(f"""WITH {_POINTS}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day DESC) AS r FROM pt WHERE day <= DATE '1996-06-09'), w AS (SELECT key, day, value, min(value) OVER (PARTITION BY key) AS lo, max(value) OVER (PARTITION BY key) AS hi FROM l WHERE r <= 5)
SELECT key, string_agg(substr('▁▂▃▄▅▆▇█', CAST(coalesce(round_even((value - lo) / nullif(hi - lo, 0) * 7, 0), 3) AS INTEGER) + 1, 1), '' ORDER BY day) AS sparkline FROM w GROUP BY key""")
def series_sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.last_points(_points(spark, sf_dir), F.lit("1996-06-09").cast("date")).select("key", "sparkline")


@query("SELECT o_orderpriority AS key, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1")
def series_conflict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("value"))
    return M.conflicts(rows).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {_POINTS}, c AS (SELECT key, max(day) AS latest_day FROM pt WHERE day <= DATE '1996-06-09' GROUP BY key) SELECT count(latest_day) AS available, 5 AS total, count(DISTINCT latest_day) > 1 AS mixed_days FROM c")
def series_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.lit("1996-06-09").cast("date")
    latest = _points(spark, sf_dir).where(F.col("day") <= end).groupBy("key").agg(F.max("day").alias("latest_day"))
    return M.series_health(latest, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))


@query(f"""WITH {EVENT}, c AS (SELECT day, event_type || '-' || (k % 5) AS key, count(*) AS n FROM ev GROUP BY ALL), t AS (SELECT DATE '2024-01-24' AS d),
b AS (SELECT DISTINCT day FROM c, t WHERE day < d AND (isodow(day) < 6) = (isodow(d) < 6) ORDER BY day DESC LIMIT 14), ks AS (SELECT DISTINCT key FROM c JOIN b USING (day)),
x AS (SELECT key, median(coalesce(n, 0)) AS normal FROM ks CROSS JOIN b LEFT JOIN c USING (key, day) GROUP BY key)
SELECT x.key, CAST(normal AS DOUBLE) AS normal, coalesce(n, 0) AS today FROM x LEFT JOIN (SELECT key, n FROM c, t WHERE day = d) y USING (key) WHERE normal >= 2 AND coalesce(n, 0) < normal * 0.9""")
def median_drop_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = event_rows(spark, sf_dir).groupBy("day", F.concat_ws("-", "event_type", (F.col("k") % 5).cast("string")).alias("key")).agg(F.count("*").alias("n"))
    return M.drops(counts, F.lit("2024-01-24").cast("date"), least_normal=2, ratio=0.9)


@query(f"WITH {EVENT} SELECT event_type AS code, count(*) AS n, count(DISTINCT day) AS days FROM ev WHERE k % 3 = 0 GROUP BY event_type HAVING count(DISTINCT day) >= 3")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = R.quality_issues(event_rows(spark, sf_dir), (("thin", F.col("k") % 3 == 0),))
    rows = event_rows(spark, sf_dir).join(issues, "ord")
    return rows.groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"), F.count_distinct("day").alias("days")).where("days >= 3")


@query(f"""WITH {EVENT}, e AS (SELECT user_id, day, string_agg(CAST(k % 3 AS VARCHAR), ',' ORDER BY k % 3) AS urls FROM ev GROUP BY ALL) SELECT CAST(day AS VARCHAR) AS day, urls, count(*) AS editions FROM e GROUP BY ALL HAVING count(*) > 1""")
def duplicate_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    editions = event_rows(spark, sf_dir).groupBy("user_id", "day").agg(F.array_join(F.array_sort(F.collect_list(F.col("k") % 3)), ",").alias("urls"))
    return editions.groupBy(F.col("day").cast("string").alias("day"), "urls").agg(F.count("*").alias("editions")).where("editions > 1")


@query(f"""WITH RECURSIVE {EVENT}, a AS (SELECT DISTINCT user_id, ts FROM ev), s AS (SELECT user_id, min(ts) AS ts FROM a GROUP BY user_id UNION ALL
SELECT s.user_id, (SELECT min(a.ts) FROM a WHERE a.user_id = s.user_id AND a.ts >= s.ts + INTERVAL 7 DAY) AS ts FROM s WHERE ts IS NOT NULL) SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS sent_us FROM s WHERE ts IS NOT NULL""")
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.cooled_down(event_rows(spark, sf_dir).select("user_id", "ts"), ["user_id"], "ts").select("user_id", F.unix_micros("ts").alias("sent_us"))


@query(f"WITH {EVENT}, d AS (SELECT DISTINCT day FROM ev WHERE value > 250 AND event_type = 'purchase') SELECT CAST(CAST(g AS DATE) AS VARCHAR) AS expected FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) t(g) WHERE CAST(g AS DATE) NOT IN (SELECT day FROM d)")
def watchdog_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = event_rows(spark, sf_dir).where("value > 250 AND event_type = 'purchase'")
    first, last = (F.lit(d).cast("date") for d in ("2024-01-01", "2024-01-30"))
    return M.missing_days(sent, "day", first, last).select(F.col("expected").cast("string").alias("expected"))


@query("SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS caught_rejects, count(*) FILTER (quality = 0) AS rejects, count(*) FILTER (quality = 1 AND toxic = 0) AS kept_keeps, count(*) FILTER (quality = 1) AS keeps FROM labels JOIN documents USING (doc_id)")
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return M.confusion(rows, F.col("quality") == 1, F.col("toxic") == 0)


@query("SELECT role, count(*) AS decisions, count(*) FILTER (length(text) > 100) AS reviewed, count(*) FILTER (turn = 0) AS sent FROM conversations GROUP BY role")
def newsletter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("decisions"), F.count_if(F.length("text") > 100).alias("reviewed"), F.count_if(F.col("turn") == 0).alias("sent"))


@query(f"WITH {EVENT} SELECT 'source' AS kind, CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT 'category', event_type, count(*) FROM ev GROUP BY ALL")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.counts_by(event_rows(spark, sf_dir), (("source", F.col("user_id")), ("category", F.col("event_type"))))


@query(f"""WITH {ART}, r AS (SELECT *, row_number() OVER (PARTITION BY category, region ORDER BY size DESC, ord) AS rank FROM art), k AS (SELECT * FROM r WHERE rank <= 3),
l AS (SELECT category, region, '*' || region || '*' || chr(10) || string_agg('• ' || replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '｜') || ' (' || source || ', ' || strftime(day, '%y.%m.%d') || ')', chr(10) ORDER BY rank) AS part FROM k GROUP BY category, region)
SELECT category, string_agg(part, chr(10) ORDER BY region) AS digest FROM l GROUP BY category""")
def digest_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = S.top_per_group(articles(spark, sf_dir), ["category", "region"], [F.desc("size")], 3)
    return render.digest(best)


@query(f"WITH {EVENT} SELECT ord FROM ev WHERE day = DATE '2024-01-20' AND k >= 50 UNION ALL SELECT ord FROM ev WHERE day <> DATE '2024-01-20' AND day >= DATE '2024-01-06'")
def review_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    edition = F.lit("2024-01-20").cast("date")
    return H.retained(rows, rows.where((F.col("day") == edition) & (F.col("k") >= 50)), "day", edition, F.date_sub(edition, 14)).select("ord")


@query("""WITH RECURSIVE l AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT conv_id, turn, i, n AS used, 1 AS message FROM l WHERE i = 1 UNION ALL SELECT l.conv_id, l.turn, l.i, CASE WHEN p.used + 1 + l.n > 400 THEN l.n ELSE p.used + 1 + l.n END, CASE WHEN p.used + 1 + l.n > 400 THEN p.message + 1 ELSE p.message END FROM p JOIN l ON l.conv_id = p.conv_id AND l.i = p.i + 1)
SELECT conv_id, turn, message FROM p""")
def line_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return render.pack_lines(lines, "conv_id", "turn", "size", 400).select("conv_id", "turn", "message")


@query(f"WITH {EVENT}, g AS (SELECT *, CAST(k AS VARCHAR) AS kk FROM ev WHERE ord % 50 <> 0) SELECT 'url:https://a.example/' || kk AS identity, arg_max(event_type, ord) AS category, CAST(arg_max(day, ord) AS VARCHAR) AS edition_date, max(ord) AS seq, min(ord) AS first_seen FROM g GROUP BY kk")
def archive_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as archive records and read by the tolerant reader, last write wins."""
    rows = event_rows(spark, sf_dir)
    record = F.to_json(F.struct(F.lit(3).alias("version"), F.col("day").cast("string").alias("edition_date"), F.array(F.struct(F.concat(F.lit("https://a.example/"), (F.col("k")).cast("string")).alias("url"), F.col("event_type").alias("category"), F.col("value").alias("editor_score"))).alias("articles")))
    lines = rows.select(F.col("ord").alias("seq"), F.when(F.col("ord") % 50 == 0, "{broken").otherwise(record).alias("value"))
    return A.read_lines(lines).select("identity", "category", "edition_date", F.col("seq.line").alias("seq"), F.col("first_seen.line").alias("first_seen"))


@query(f"WITH {ART}, g AS (SELECT *, min(ord) OVER (PARTITION BY {_TITLE_KEY}) AS leader FROM art), e AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY leader ORDER BY size DESC, day DESC, ord) = 1) SELECT category, region, ord, title, CAST(row_number() OVER (PARTITION BY category, region ORDER BY size DESC, ord) AS INTEGER) AS rank FROM e QUALIFY rank <= 3")
def daily_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: one representative a story, then the best three of each category and region."""
    from . import daily

    return daily.select_digest(articles(spark, sf_dir)).select("category", "region", "ord", "title", "rank")


