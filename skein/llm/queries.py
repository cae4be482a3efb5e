"""Registered queries of the operators in this package, on their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, langid, license_scan, lm_score, mixing, neardup, suffix_dedup, topk, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(modulus: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), train=_crc(7) != 2)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = suffix_dedup.dedup_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("posterior", 6).alias("posterior"), F.round("lower_bound", 6).alias("lower_bound"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = langid.fit(docs, train=_crc(4) != 2)
    found = langid.identify(docs, models)
    return found.select("doc_id", (_crc(4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), sentences=license_scan.SENTENCES)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def queries() -> dict[str, Query]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_exact_top_k": op3_exact_top_k,
        "op4_url_filters": op4_url_filters,
        "op5_language_id": op5_language_id,
        "op6_decontamination": op6_decontamination,
        "op7_license_scans": op7_license_scans,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_html_extraction": op9_html_extraction,
        "op10_mixing": op10_mixing,
    }


#: Words of the decontamination query: A-Z lower-cased, then runs of this class.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, len AS n, array_to_string(w[i:i + len - 1], ' ') AS g
       FROM (SELECT item, w, least(10, len(w)) AS len, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT dw.doc_id, dw.n, dw.i, bw.item FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

def _strength(level: str, members: str, group: str) -> str:
    """Sums, mean and prior strength of a level over its members."""
    by = f"GROUP BY {group}" if group else ""
    keys = f"{group}, " if group else ""
    return f"""{level}0 AS (SELECT {keys}sum(bad) AS b, sum(n) AS n, count(*) AS k, sum(bad * bad / n) AS bb, sum(n * n) AS nn FROM {members} {by}),
{level}1 AS (SELECT *, b / n AS mean, (bb - b * (b / n) - (k - 1) * (b / n) * (1 - b / n)) / nullif(n - nn / n, 0) AS var FROM {level}0),
{level} AS (SELECT *, least(greatest(coalesce(mean * (1 - mean) / (CASE WHEN var > 0 THEN var END) - 1, {url_filter.MOST_STRENGTH}), {url_filter.LEAST_STRENGTH}), {url_filter.MOST_STRENGTH}) AS strength FROM {level}1)"""


def _url_sql() -> str:
    ordered = sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [(what, at + prefix, f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{prefix}')") for what, at, prefix in ordered]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for _, r, c in fits)
    ruled = " ".join(f"WHEN {c} THEN '{w}'" for w, _, c in fits)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT doc_id, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.') AS domain, string_split(host, '.')[-1] AS suffix,
          CAST(sum(bad) AS DOUBLE) AS bad, CAST(count(*) AS DOUBLE) AS n FROM s JOIN m ON page_id = doc_id WHERE host <> '' GROUP BY host),
domains AS (SELECT suffix, domain, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY ALL), suffixes AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY ALL),
{_strength("a", "suffixes", "")}, {_strength("x", "domains", "suffix")}, {_strength("d", "hosts", "domain")},
xm AS (SELECT x.suffix, x.strength, (x.b + a.strength * ((a.b + 1) / (a.n + 2))) / (x.n + a.strength) AS mean FROM x, a),
dm AS (SELECT d.domain, d.strength, (d.b + xm.strength * xm.mean) / (d.n + xm.strength) AS mean FROM d JOIN domains USING (domain) JOIN xm USING (suffix)),
p AS (SELECT host, hosts.bad + strength * mean AS a, hosts.n - hosts.bad + strength * (1 - mean) AS b FROM hosts JOIN dm USING (domain)),
q AS (SELECT host, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM hosts) AS overall, a / (a + b) AS posterior, greatest(0.0, a / (a + b) - {url_filter.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS lower_bound FROM p)
SELECT page_id, s.host, path, CASE {rule.replace('host', 's.host')} END AS rule, coalesce(CASE {ruled.replace('host', 's.host')} END, CASE WHEN lower_bound > overall THEN 'block' ELSE 'allow' END) AS verdict, round(posterior, 6) AS posterior, round(lower_bound, 6) AS lower_bound
FROM s LEFT JOIN q ON s.host = q.host
"""


OP8_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _license_sql() -> str:
    line = _LOWER.format("coalesce(text, '')")
    for pattern, by in license_scan.STEPS:
        line = f"regexp_replace({line}, '{pattern}', '{by}', 'g')"
    cases = " ".join(f"WHEN regexp_full_match(n, '{pattern}') THEN '{name}'" for name, pattern in license_scan.SENTENCES)
    rules = " ".join(f"WHEN regexp_matches(s, '{pattern}') THEN '{name}'" for name, pattern in license_scan.RULES)
    return f"""
WITH s AS (SELECT doc_id, list_transform(regexp_extract_all('< ' || trim({line}) || ' >', '{license_scan.finder(license_scan.SENTENCES)}', 1), lambda x: replace(x, ' ) (', '')) AS n FROM documents),
i AS (SELECT doc_id, list_transform(n, lambda n: CASE {cases} END) AS ids FROM s),
t AS (SELECT doc_id, array_to_string(ids, ' ') AS sentence_ids, len(ids) AS n_sentences, ' ' || array_to_string(ids, ' ') || ' ' AS s FROM i)
SELECT doc_id, sentence_ids, n_sentences, CASE {rules} END AS license FROM t
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": _url_sql(), "op3_exact_top_k": OP3_SQL, "op8_minhash_near_dedup": OP8_SQL, "op6_decontamination": OP6_SQL, "op7_license_scans": _license_sql()}
