"""Queries of the scalar functions, filters and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions import values as V
from ..operators import classifier as K
from ..operators import joins as J
from ..operators import rules as R
from .registry import ART, EVENT, HOST, URL, articles, event_rows, query, table

#: Fixture lexicons: words of the synthetic prose stand for a newsroom's vocabulary.
LEXICON = {"deal": ("tion", "ndth", "thing"), "policy": ("with", "that", "from"), "market": ("der", "die", "und"), "research": ("les", "des", "est")}
GROUPS = {"early": ("heed", "onre"), "late": ("erst", "wh"), "abroad": ("que", "pour")}
STOPWORDS = ("the", "and", "of", "der", "die", "les", "des")
PARTICLES = ("ing", "ed", "er")
RELEVANCE = R.Relevance(blacklist=("toxic", "thsh"), opinion_url=("/opinion/",), opinion_words=("onst",), hard=("ndre", "hahe"), soft=("licensed", "reserved"), rescue=("mit",), interest=("with", "from"), events=("avec", "und"), curated=("src1", "src2"))
STATUSES = (("confirmed", r"(?U)\bthe\b"), ("considering", r"(?U)\bund\b"), ("outlook", r"(?U)\ble\b"))
_WORDS = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 3))"


def _sql_word(column: str, word: str) -> str:
    """Whole-word match by Unicode letters: RE2's own \\b knows ASCII only."""
    return rf"regexp_matches({column}, '(^|[^\p{{L}}\p{{N}}_]){word}([^\p{{L}}\p{{N}}_]|$)')"


def _sql_hit(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(_sql_word(column, w) for w in words) + ")" if words else "FALSE"


@query(f"""WITH {URL}, q AS (SELECT *, list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT (lower(split_part(p, '=', 1)) LIKE 'utm\\_%' ESCAPE '\\')
AND lower(split_part(p, '=', 1)) NOT IN ('fbclid','gclid','mc_cid','mc_eid','ref','referrer')) AS kept FROM u)
SELECT page_id, CASE WHEN scheme = '' OR authority = '' THEN url ELSE lower(scheme) || '://' || authority || path || CASE WHEN len(kept) > 0
THEN '?' || array_to_string(list_transform(kept, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') ELSE '' END END AS normal FROM q""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_url(F.col("url")).alias("normal"))


@query(rf"""WITH {URL} SELECT page_id, lower(url) SIMILAR TO 'https?://.*' AND authority <> '' AND path NOT IN ('', '/') AND NOT regexp_matches(lower(path), '\.(png|jpg|jpeg|gif|webp|svg)$')
AND NOT contains(lower(url), 'spam') AS usable FROM u""")
def url_usable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.usable_article_url(F.col("url"), ("spam",)).alias("usable"))


@query(f"""WITH {URL} SELECT page_id, CASE WHEN scheme = 'https' AND authority <> '' AND NOT contains(authority, '@') AND NOT (contains(lower(authority), 'hubspotlinks') OR contains(lower(authority), 'safelinks')
OR contains(lower(authority), 'click.') OR contains(lower(authority), 'email.')) THEN 'https://' || authority || path || CASE WHEN regexp_matches(query, '(^|&)id=') THEN '?' || regexp_extract(query, '(id=[^&]*)', 1) ELSE '' END ELSE '' END AS public FROM u""")
def url_public_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.public_url(F.col("url")).alias("public"))


@query(rf"""WITH {URL} SELECT page_id, CASE WHEN scheme = 'https' AND ({HOST} = 'example.com' OR {HOST} LIKE '%.example.com') AND path NOT IN ('', '/')
AND NOT regexp_matches(lower(path), '^/(login|signin|signup|subscribe|account)(/|$)') THEN 'https://' || authority || path END AS attributed FROM u""")
def url_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.attributed_url(F.col("url"), ("example.com",)).alias("attributed"))


_UNESCAPE = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(f"SELECT page_id, left(trim({_UNESCAPE.format("regexp_replace(html, '<[^>]+>', '', 'g')")}), 500) AS clean FROM pages")
def html_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.clean_html(F.col("html")).alias("clean"))


_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_CLEAN = _SQUEEZE.format(_UNESCAPE.format("regexp_replace({0}, '<[^>]+>', ' ', 'g')"))


@query(f"SELECT page_id, nullif({_CLEAN.format("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")}, '') AS title, nullif({_CLEAN.format("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")}, '') AS headline, CAST(NULL AS VARCHAR) AS og_title FROM pages")
def html_title_and_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", T.tag_text(html, "title").alias("title"), T.tag_text(html, "h1").alias("headline"), T.meta_content(html, "og:title").alias("og_title"))


@query(rf"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>')) AS tag, generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>'), 1) - 1 AS pos FROM pages),
b AS (SELECT page_id, pos, regexp_extract(tag, '(?is)href="([^"]*)"', 1) AS href, {_CLEAN.format("tag")} AS text FROM a)
SELECT page_id, CAST(min(pos) AS INTEGER) AS pos, href, arg_min(text, pos) AS text, arg_min(length(lower(text)) < 8 OR lower(text) IN ('more','read more'), pos) AS boilerplate FROM b GROUP BY page_id, href""")
def html_links_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page in order; the first of equal addresses wins."""
    pages = table(spark, sf_dir, "pages")
    tags = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), F.lit(1))).alias("pos", "tag"))
    links = tags.select("page_id", "pos", F.regexp_extract("tag", r'(?is)href="([^"]*)"', 1).alias("href"), T.clean_text(F.col("tag")).alias("text"))
    first = links.groupBy("page_id", "href").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))
    return first.select("page_id", "pos", "href", "text", T.boilerplate_anchor(F.col("text"), ("more", "read more"), ()).alias("boilerplate"))


@query(rf"""WITH {URL}, h AS (SELECT page_id, {HOST} AS host FROM u),
reg AS (SELECT * FROM (VALUES ('example.com', 'pub-com'), ('example.org', 'pub-org'), ('blog.ththan.example.net', 'pub-blog')) t(domain, publisher)),
m AS (SELECT h.page_id, publisher, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS r FROM h JOIN reg ON host = domain OR ends_with(host, '.' || domain))
SELECT h.page_id, h.host, m.publisher FROM h LEFT JOIN m ON h.page_id = m.page_id AND r = 1""")
def publisher_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select("page_id", T.host_of(F.col("url")).alias("host"))
    registry = spark.createDataFrame([("example.com", "pub-com"), ("example.org", "pub-org"), ("blog.ththan.example.net", "pub-blog")], "domain string, publisher string")
    return J.suffix_match(hosts, registry).select("page_id", "host", "publisher")


_OVERLAP = f"""WITH {ART}, a AS (SELECT ord, {_WORDS.format('title')} AS w FROM art), b AS (SELECT item_id, {_WORDS.format("trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g'))")} AS w FROM benchmark),
x AS (SELECT ord AS a, len(w) AS na, unnest(w) AS t FROM a), y AS (SELECT item_id AS b, len(w) AS nb, unnest(w) AS t FROM b),
p AS (SELECT a, b, count(*) / least(any_value(na), any_value(nb)) AS overlap FROM x JOIN y USING (t) GROUP BY a, b HAVING count(*) / least(any_value(na), any_value(nb)) >= 0.5)"""


def _seen_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.trim(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r"\s+", " "))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), first.alias("title"))


@query(_OVERLAP + " SELECT a, b, round(overlap, 6) AS overlap FROM p")
def title_overlap_coefficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.title_overlaps(articles(spark, sf_dir), _seen_titles(spark, sf_dir)).select("a", "b", F.round("overlap", 6).alias("overlap"))


@query(_OVERLAP + " SELECT ord, title FROM art WHERE ord NOT IN (SELECT a FROM p)")
def seen_title_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.unseen_titles(articles(spark, sf_dir), _seen_titles(spark, sf_dir)).select("ord", "title")


@query(f"WITH {ART} SELECT ord, CASE WHEN len(regexp_extract_all(title, '\\p{{L}}')) = 0 THEN 0.0 ELSE round(len(regexp_extract_all(title, '[À-ÿ]')) / len(regexp_extract_all(title, '\\p{{L}}')), 6) END AS ratio FROM art")
def title_hangul_like_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("ord", F.round(T.letter_ratio(F.col("title"), "À-ÿ"), 6).alias("ratio"))


@query(f"""WITH {ART}, t AS (SELECT ord, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS t FROM art)
SELECT ord, CASE WHEN t = '' THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substr(t, i, 3)))), ' ') END AS grams FROM t""")
def title_char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("ord", F.array_join(F.array_sort(T.char_ngrams(F.col("title"))), " ").alias("grams"))


_RAW = r"regexp_extract_all(lower({0}), '[a-z0-9가-힣]+')"


@query(f"""WITH {ART}, r AS (SELECT ord, {_RAW.format('title')} AS w FROM art), s AS (SELECT ord, list_filter(list_transform(w, lambda w: CASE WHEN length(w) >= 5 AND ends_with(w, 'ing') THEN left(w, length(w) - 3)
WHEN length(w) >= 4 AND ends_with(w, 'ed') THEN left(w, length(w) - 2) WHEN length(w) >= 4 AND ends_with(w, 'er') THEN left(w, length(w) - 2) ELSE w END), lambda w: length(w) >= 2 AND w NOT IN ('the','and','of','der','die','les','des')) AS w FROM r)
SELECT ord, array_to_string(list_sort(list_distinct(w)), ' ') AS tokens FROM s""")
def headline_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("ord", F.array_join(F.array_sort(T.headline_tokens(F.col("title"), PARTICLES, STOPWORDS)), " ").alias("tokens"))


@query(f"""WITH {ART}, r AS (SELECT ord, list_transform(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9+.-]{{2,}}|[가-힣]{{2,}}'), lambda w: regexp_replace(w, '^[.-]+|[.-]+$', '', 'g')) AS w FROM art)
SELECT ord, array_to_string(list_sort(list_distinct(list_filter(w, lambda w: length(w) >= 3 AND w NOT IN ('the','and','of','der','die','les','des')))), ' ') AS tokens FROM r""")
def candidate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("ord", F.array_join(F.array_sort(T.candidate_tokens(F.col("title"), STOPWORDS)), " ").alias("tokens"))


@query(f"""WITH r AS (SELECT p_partkey, {_RAW.format("regexp_replace(lower(p_name), 'part ', 'item ', 'g')")} AS w FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(flatten(list_transform(w, lambda t: CASE WHEN t = 'item' THEN ['item', 'good'] WHEN t = 'red' THEN ['crimson'] ELSE [t] END)))), '_') AS key FROM r""")
def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = T.canonical_key(F.col("p_name"), (("part ", "item "),), {"item": ("item", "good")}, {"red": "crimson"})
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("key"))


@query(f"""WITH {ART}, r AS (SELECT ord, list_filter({_RAW.format('title')}, lambda t: length(t) >= 2 AND NOT regexp_matches(t, '\\d')) AS w FROM art),
a AS (SELECT ord, list_concat(w, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: left(w[i], 1) || left(w[i + 1], 1) || left(w[i + 2], 1)) ELSE [] END,
CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: left(w[i], 1) || left(w[i + 1], 1) || left(w[i + 2], 1) || left(w[i + 3], 1)) ELSE [] END) AS e FROM r)
SELECT ord, array_to_string(list_sort(list_distinct(e)), ' ') AS entities FROM a""")
def key_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("ord", F.array_join(F.array_sort(T.key_entities(F.col("title"))), " ").alias("entities"))


@query(f"""WITH {ART}, t AS (SELECT ord, lower(text) AS t FROM art) SELECT ord, array_to_string(list_filter([{', '.join(f"CASE WHEN {_sql_hit('t', words)} THEN '{g}' END" for g, words in GROUPS.items())}], lambda x: x IS NOT NULL), ',') AS groups FROM t""")
def lexicon_hits_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("ord", F.array_join(R.matched_groups(F.col("text"), GROUPS), ",").alias("groups"))


def _case_first(kind: str, column: str, words: tuple[str, ...]) -> str:
    prefix = f"{kind}:" if kind else ""
    return "CASE " + " ".join(f"WHEN {_sql_word(column, w)} THEN '{prefix}{w}'" for w in words) + " END"


@query(f"WITH {ART}, t AS (SELECT ord, lower(text) AS t FROM art) SELECT ord, {_case_first('', 't', ('ndre', 'hahe', 'with', 'und'))} AS first FROM t")
def first_hit_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("ord", T.first_hit(F.col("text"), ("ndre", "hahe", "with", "und")).alias("first"))


@query(f"""WITH {ART}, t AS (SELECT ord, source, lower(text) AS t FROM art), f AS (SELECT *, coalesce({_case_first('blacklist', 't', tuple(RELEVANCE.blacklist))}, {_case_first('opinion', 't', tuple(RELEVANCE.opinion_words))},
{_case_first('hard', 't', tuple(RELEVANCE.hard))}, CASE WHEN NOT {_sql_hit('t', tuple(RELEVANCE.rescue))} THEN {_case_first('soft', 't', tuple(RELEVANCE.soft))} END) AS failing FROM t)
SELECT ord, coalesce(failing, CASE WHEN NOT (source IN ('src1', 'src2') OR {_sql_hit('t', tuple(RELEVANCE.interest))} OR {_sql_hit('t', tuple(RELEVANCE.events))}) THEN 'no_relevant_signal' END) AS filter_reason FROM f""")
def relevance_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir)
    return rows.select("ord", R.relevance_reason(F.col("title"), F.col("text"), F.lit(""), F.col("source"), RELEVANCE).alias("filter_reason"))


@query(f"WITH {ART} SELECT ord, CASE WHEN {_sql_word('lower(title)', 'the')} THEN 'confirmed' WHEN {_sql_word('lower(title)', 'und')} THEN 'considering' WHEN {_sql_word('lower(title)', 'le')} THEN 'outlook' WHEN {_sql_word('lower(text)', 'the')} THEN 'confirmed' WHEN {_sql_word('lower(text)', 'und')} THEN 'considering' WHEN {_sql_word('lower(text)', 'le')} THEN 'outlook' ELSE 'unknown' END AS status FROM art")
def ordered_status_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("ord", K.event_state(F.lower("title"), F.lower("text"), STATUSES, ())[0].alias("status"))


def _score_sql() -> str:
    hits = {c: " + ".join(f"CAST({_sql_word('t', w)} AS INTEGER)" for w in words) for c, words in LEXICON.items()}
    best = "greatest(" + ", ".join(f"n_{c}" for c in LEXICON) + ")"
    pick = " ".join(f"WHEN n_{c} = best THEN '{c}'" for c in LEXICON)
    groups = " + ".join(f"CAST({_sql_hit('t', words)} AS INTEGER)" for words in GROUPS.values())
    status = f"CASE WHEN {_sql_word('tt', 'the')} THEN 1.5 WHEN {_sql_word('tt', 'und')} THEN 0.5 WHEN {_sql_word('tt', 'le')} THEN 0.25 WHEN {_sql_word('t', 'the')} THEN 1.5 WHEN {_sql_word('t', 'und')} THEN 0.5 WHEN {_sql_word('t', 'le')} THEN 0.25 ELSE 0 END"
    return f"""WITH {ART}, t AS (SELECT ord, lower(text) AS t, lower(title) AS tt FROM art), h AS (SELECT *, {', '.join(f'{sql} AS n_{c}' for c, sql in hits.items())} FROM t), b AS (SELECT *, {best} AS best FROM h)
SELECT ord, CASE WHEN best = 0 THEN 'general' {pick} END AS category, CAST(greatest(best + 2.5 * CAST({_sql_word('t', 'mit')} AS INTEGER) - CASE WHEN {_sql_word('t', 'onst')} THEN 1.5 ELSE 0 END + 2 * ({groups}) + {status}, 0) AS DOUBLE) AS relevance FROM b"""


@query(_score_sql())
def classify_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxonomy = R.Taxonomy(LEXICON, GROUPS, ("mit",), STATUSES, K.STATUS_WEIGHTS, (("onst", 1.5),))
    return R.classify(articles(spark, sf_dir), "title", "text", taxonomy).select("ord", "category", "relevance")


@query(f"""WITH {EVENT} SELECT ord, CAST(CASE WHEN event_type = 'purchase' THEN 2.0 ELSE 0 END + CASE WHEN value > 50 THEN 1.2 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 0.8 ELSE 0 END - CASE WHEN k % 7 = 0 THEN 4.0 ELSE 0 END AS DOUBLE) AS score,
concat_ws(',', CASE WHEN event_type = 'purchase' THEN 'deal' END, CASE WHEN value > 50 THEN 'major' END, CASE WHEN k % 3 = 0 THEN 'confirmed' END, CASE WHEN k % 7 = 0 THEN 'roundup' END) AS reasons FROM ev""")
def weekly_score_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    score, reasons = R.additive_score((("deal", F.col("event_type") == "purchase", 2.0), ("major", F.col("value") > 50, 1.2), ("confirmed", k % 3 == 0, 0.8), ("roundup", k % 7 == 0, -4.0)))
    return event_rows(spark, sf_dir).select("ord", score.alias("score"), F.array_join(reasons, ",").alias("reasons"))


@query(f"WITH {ART} SELECT ord, NOT {_sql_word('lower(title)', 'of')} AND ({_sql_hit('lower(text)', ('ndth', 'thing'))} OR regexp_matches(lower(text), 'licens') OR ({_sql_word('lower(text)', 'der')} AND {_sql_word('lower(text)', 'sch')})) AS eligible FROM art")
def eligibility_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower("text")
    return articles(spark, sf_dir).select("ord", R.deal_eligible(F.lower("title"), text, r"(?U)\bof\b", T.hits(text, ("ndth", "thing")), "licens", r"(?U)\bder\b", r"(?U)\bsch\b").alias("eligible"))


@query(f"WITH {ART} SELECT ord, CASE WHEN regexp_matches(lower(title), '^the\\b') THEN 'personnel' WHEN regexp_matches(title, '!!') THEN 'product' WHEN regexp_matches(title, '\\|') AND source = 'src1' THEN 'reference' WHEN length(title) < 12 THEN NULL ELSE NULL END AS reason FROM art")
def title_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (("personnel", r"(?i)^the\b"), ("product", "!!"), ("reference", r"\|"))
    return articles(spark, sf_dir).select("ord", R.title_exclusion(F.col("title"), rules, F.col("source") == "src1", ("reference",)).alias("reason"))


@query(f"""WITH {ART}, t AS (SELECT ord, {_SQUEEZE.format('title')} AS t FROM art) SELECT ord, t <> '' AND NOT regexp_matches(regexp_extract(t, '^[^\\p{{L}}]*(\\p{{L}})', 1), '^[a-z]$') AND (len(string_split(t, ' ')) >= 5 OR length(t) >= 30) AS headline FROM t""")
def headline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("ord", T.looks_like_headline(F.col("title")).alias("headline"))


@query(f"""WITH {EVENT} SELECT ord, json_extract_string(props, '$.k') AS raw_k, CASE WHEN k BETWEEN 1 AND 3 THEN CAST(k AS INTEGER) ELSE 0 END AS importance FROM ev JOIN events ON ord = event_id""")
def json_reply_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Props wrapped in a fenced reply, found again, parsed and validated."""
    reply = F.concat(F.lit("```json\nanswer: "), F.col("props"), F.lit("\n``` end"))
    parsed = F.from_json(V.json_body(reply), "k string")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), parsed["k"].alias("raw_k"), V.importance(parsed["k"]).alias("importance"))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS p FROM embeddings)
SELECT vec_id, list_max(p) <= 1 AND abs(list_sum(p) - 1) <= len(p) * 0.1 AND p[1] = list_max(p) AS valid FROM p""")
def probability_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all components as a distribution in which the first is chosen."""
    p = F.map_from_arrays(F.sequence(F.lit(1), F.size("embedding")), F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", V.valid_distribution(p, F.lit(1), slack=0.1).alias("valid"))


@query(f"""WITH {ART} SELECT ord, strftime(day, '%y.%m.%d') AS label, CAST(isoyear(day) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0') AS week, CAST(CAST(day + CAST(5 - isodow(day) AS INTEGER) AS DATE) AS VARCHAR) AS friday,
CAST(CAST(day - CAST(isodow(day) AS INTEGER) AS DATE) AS VARCHAR) AS last_sunday FROM art""")
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("day")
    return articles(spark, sf_dir).select("ord", D.short_label(day).alias("label"), D.iso_week_label(day).alias("week"), D.market_reference_day(day).cast("string").alias("friday"), D.weekly_window(day)[1].cast("string").alias("last_sunday"))


@query(f"WITH {ART} SELECT ord FROM art WHERE day BETWEEN DATE '2024-01-12' AND DATE '2024-01-16'")
def article_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).where(D.within_window(F.col("day"), F.lit("2024-01-15").cast("date"))).select("ord")


@query(f"""WITH {URL} SELECT page_id, CASE WHEN url IS NOT NULL AND url <> '' THEN 'url:' || (SELECT CASE WHEN scheme = '' OR authority = '' THEN url ELSE lower(scheme) || '://' || authority || path ||
CASE WHEN regexp_matches(query, '(^|&)page=') THEN '?' || regexp_extract(query, '(page=[^&]*)', 1) ELSE '' END END) END AS identity FROM u""")
def identity_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.article_identity(F.col("url"), F.lit(""), F.lit("")).alias("identity"))
