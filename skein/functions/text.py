"""String, URL and HTML functions.

Regular expressions that must see Unicode letters carry (?U): Java's \\w is ASCII
otherwise.  Null and empty text are the same value throughout.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that track a reader.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "referrer")
PUBLIC_KEYS = ("idxno", "id", "article_id")
TRACKER_HOSTS = ("hubspotlinks", "safelinks", "click.", "email.")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg")
HANGUL = "가-힣"
CJK = "가-힣぀-ヿ一-鿿"


def nz(c: Column | str) -> Column:
    """Trimmed text, null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def text_of(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def bind(value: Column, body) -> Column:
    """body(value) with value computed once: lambdas would repeat the expression for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def escape_regex(word: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c == " ") and c.isascii() else c for c in word)


# URLs


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, authority, path, query and fragment by the general URL pattern; empty where absent."""
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    names = ("scheme", "authority", "path", "query", "fragment")
    return {n: F.coalesce(F.regexp_extract(url, pattern, i + 1), F.lit("")) for i, n in enumerate(names)}


def _kept_query(query: Column, keep) -> Column:
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & keep(F.lower(F.substring_index(p, "=", 1))))
    return F.array_join(F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")


def normalize_url(url: Column) -> Column:
    """The URL without tracking keys and fragment; text without scheme and host is unchanged."""
    part = url_parts(url)
    query = _kept_query(part["query"], lambda k: ~(k.startswith("utm_") | k.isin(*TRACKING_KEYS)))
    whole = F.concat(F.lower(part["scheme"]), F.lit("://"), part["authority"], part["path"], F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when((part["scheme"] == "") | (part["authority"] == ""), url).otherwise(whole)


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and leading www."""
    authority = url_parts(url)["authority"]
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def usable_article_url(url: Column, skip_markers: Sequence[str] = ()) -> Column:
    """True for http(s) addresses of a page: with host and path, no image, no skip marker."""
    clean = F.regexp_replace(F.trim(text_of(url)), r"^[<>\"']+|[<>\"']+$", "")
    low = F.lower(clean)
    part = url_parts(clean)
    ok = low.rlike(r"^https?://") & (part["authority"] != "") & ~part["path"].isin("", "/")
    for suffix in IMAGE_SUFFIXES:
        ok = ok & ~F.lower(part["path"]).endswith(suffix)
    for marker in skip_markers:
        ok = ok & ~F.contains(low, F.lit(marker))
    return ok


def public_url(url: Column) -> Column:
    """A link that is safe to show: https, no user, no tracker host, three query keys kept; else empty."""
    part = url_parts(text_of(url))
    ok = (part["scheme"] == "https") & (part["authority"] != "") & ~F.contains(part["authority"], F.lit("@"))
    for host in TRACKER_HOSTS:
        ok = ok & ~F.contains(F.lower(part["authority"]), F.lit(host))
    query = _kept_query(part["query"], lambda k: k.isin(*PUBLIC_KEYS))
    whole = F.concat(F.lit("https://"), part["authority"], part["path"], F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(ok, whole).otherwise("")


def attributed_url(url: Column, domains: Sequence[str]) -> Column:
    """https link on an allowed domain, no login or subscription page, query dropped; else null."""
    part = url_parts(text_of(url))
    host = host_of(url)
    allowed = F.lit(False)
    for d in domains:
        allowed = allowed | (host == d) | host.endswith("." + d)
    blocked = F.lower(part["path"]).rlike(r"^/(?:login|signin|signup|subscribe|account)(?:/|$)")
    return F.when((part["scheme"] == "https") & allowed & ~blocked & ~part["path"].isin("", "/"), F.concat(F.lit("https://"), part["authority"], part["path"]))


def domain_suffixes(host: Column) -> Column:
    """All suffixes of a host that hold a dot, longest first: keys for an equi-join on domains."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))


def search_url(base: str, clauses: Sequence[str], days: int | None = None) -> str:
    """A search address whose query ORs quoted clauses and bounds the age."""
    from urllib.parse import quote_plus

    query = " OR ".join(f'"{c}"' if " " in c and not c.startswith("site:") else c for c in clauses)
    return f"{base}?q={quote_plus(query + (f' when:{days}d' if days else ''))}"


# HTML and headlines


def unescape_basic(c: Column) -> Column:
    """The five named entities and the blank; decoding happens once, ampersands last."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def clean_html(html: Column, limit: int = 500) -> Column:
    """Text without tags and basic entities, trimmed, at most `limit` characters."""
    return F.left(F.trim(unescape_basic(F.regexp_replace(text_of(html), "<[^>]+>", ""))), F.lit(limit))


def clean_text(html: Column) -> Column:
    return squeeze(unescape_basic(F.regexp_replace(text_of(html), "<[^>]+>", " ")))


def clean_subject(subject: Column) -> Column:
    """Subject without bracketed marks and reply or forward prefixes."""
    return squeeze(F.regexp_replace(F.regexp_replace(clean_text(subject), r"\[[^\]]*\]", ""), r"(?i)^\s*(?:(?:fw|fwd|re)\s*:\s*)+", ""))


def split_outlet(title: Column) -> tuple[Column, Column]:
    """(title, outlet): a last ` - ` suffix of 1 to 40 characters is the outlet."""
    pattern = r"^(.*) - (.{1,40})$"
    has = title.rlike(pattern)
    return F.when(has, F.regexp_extract(title, pattern, 1)).otherwise(title), F.when(has, F.regexp_extract(title, pattern, 2))


def boilerplate_anchor(text: Column, exact: Sequence[str], fragments: Sequence[str], least: int = 8) -> Column:
    low = F.lower(squeeze(text_of(text)))
    out = (F.length(low) < least) | low.isin(*exact)
    for fragment in fragments:
        out = out | F.contains(low, F.lit(fragment))
    return out


def looks_like_headline(text: Column, least: int = 30, least_cjk: int = 12, words: int = 5) -> Column:
    """Five words, or enough characters; never a fragment that starts in lower case."""
    t = squeeze(text_of(text))
    first = F.regexp_extract(t, r"(?U)^[^\p{L}]*(\p{L})", 1)
    enough = F.when(t.rlike(f"[{CJK}]"), F.length(t) >= least_cjk).otherwise(F.length(t) >= least)
    return (t != "") & ~first.rlike("^[a-z]$") & ((F.size(F.split(t, " ")) >= words) | enough)


def anchor_headline(html: Column, least: int = 15) -> Column:
    """First block of an anchor's markup with `least` characters, else all of it."""
    blocks = F.transform(F.split(text_of(html), r"(?i)</?(?:p|div|h[1-6]|td|tr|table|br|li)[^>]*>"), clean_text)
    long = F.filter(blocks, lambda b: F.length(b) >= least)
    return F.when(F.size(long) > 0, F.get(long, F.lit(0))).otherwise(clean_text(html))


def meta_content(html: Column, name: str) -> Column:
    """Content of a <meta property|name="...">, either order of attributes; null if absent."""
    key = escape_regex(name)
    first = F.regexp_extract(html, rf'(?is)<meta[^>]+(?:property|name)="{key}"[^>]+content="([^"]*)"', 1)
    second = F.regexp_extract(html, rf'(?is)<meta[^>]+content="([^"]*)"[^>]+(?:property|name)="{key}"', 1)
    return nz(unescape_basic(F.when(first != "", first).otherwise(second)))


def tag_text(html: Column, tag: str) -> Column:
    return nz(clean_text(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)))


def clean_source_name(source: Column, aliases: Mapping[str, str]) -> Column:
    """Display name: alias, else without bracketed parts and scheme; dots cannot turn into links."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text_of(source), r"\s*\([^)]*\)", ""), r"(?i)^https?://(?:www\.)?", ""))
    named = F.lit(None).cast("string")
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        named = table[plain]
    return F.coalesce(named, F.replace(plain, F.lit("."), F.lit(".​")))


# Tokens and similarity


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of letters and digits, lower-cased; a shorter text is its own gram."""

    def grams(t: Column) -> Column:
        all_grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, n))
        return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_distinct(all_grams))

    return bind(F.regexp_replace(F.lower(text_of(text)), r"(?U)[^\w]", ""), grams)


def word_tokens(text: Column, least: int = 3) -> Column:
    t = F.regexp_replace(F.lower(text_of(text)), r"(?U)[^\w\s]", " ")
    return F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) >= least))


def letter_ratio(text: Column, letters: str = HANGUL) -> Column:
    """Share of the given letters among all letters."""
    n = F.regexp_count(text_of(text), F.lit(r"\p{L}"))
    return F.when(n == 0, 0.0).otherwise(F.regexp_count(text_of(text), F.lit(f"[{letters}]")) / n)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """|A and B| / min(|A|, |B|); 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def same_issue(a: Column, b: Column, hangul_share: float = 0.3, gram_level: float = 0.35, word_level: float = 0.50) -> Column:
    """Two titles tell one story: character grams for Hangul titles, words for others."""
    hangul = (letter_ratio(a) > hangul_share) | (letter_ratio(b) > hangul_share)
    return F.when(hangul, overlap_coefficient(char_ngrams(a), char_ngrams(b)) >= gram_level).otherwise(overlap_coefficient(word_tokens(a), word_tokens(b)) >= word_level)


def sequence_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratcliff-Obershelp ratio; an Arrow UDF, as no built-in expression computes it.  Null where length or letters keep it under `least`."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            m = difflib.SequenceMatcher(None, p or "", q or "")
            out.append(m.ratio() if not least or (m.real_quick_ratio() >= least and m.quick_ratio() >= least) else None)
        return pd.Series(out, dtype=float)

    return ratio(a, b)


def candidate_tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Tokens that may block a pair: Latin of three characters and more, Hangul of two and more."""
    raw = F.regexp_extract_all(F.lower(text_of(text)), F.lit(rf"([a-z0-9][a-z0-9+.\-]{{2,}}|[{HANGUL}]{{2,}})"), F.lit(1))
    bare = F.transform(raw, lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: ((F.length(w) >= 3) | w.rlike(f"^[{HANGUL}]")) & ~w.isin(*stopwords) if stopwords else (F.length(w) >= 3) | w.rlike(f"^[{HANGUL}]")))


def headline_tokens(title: Column, particles: Sequence[str] = (), stopwords: Sequence[str] = (), least: int = 2) -> Column:
    """Title words without the first particle that fits and leaves two characters, minus stopwords."""
    raw = F.regexp_extract_all(F.lower(text_of(title)), F.lit(rf"([a-z0-9{HANGUL}]+)"), F.lit(1))

    def stem(w: Column) -> Column:
        out = None
        for p in particles:
            fits = (F.length(w) >= len(p) + 2) & w.endswith(p)
            cut = F.left(w, F.length(w) - F.lit(len(p)))
            out = F.when(fits, cut) if out is None else out.when(fits, cut)
        return w if out is None else out.otherwise(w)

    tokens = F.transform(raw, stem)
    keep = F.filter(tokens, lambda w: (F.length(w) >= least) & ~w.isin(*stopwords) if stopwords else F.length(w) >= least)
    return F.array_distinct(keep)


def canonical_key(key: Column, phrases: Sequence[tuple[str, str]] = (), expansions: Mapping[str, Sequence[str]] | None = None, aliases: Mapping[str, str] | None = None) -> Column:
    """Event key in canonical form: phrases replaced, tokens expanded or renamed, sorted, distinct."""
    k = F.lower(text_of(key))
    for pattern, into in phrases:
        k = F.regexp_replace(k, pattern, into)
    tokens = F.regexp_extract_all(k, F.lit(rf"([a-z0-9{HANGUL}]+)"), F.lit(1))
    table = {t: list(w) for t, w in (expansions or {}).items()} | {t: [w] for t, w in (aliases or {}).items() if t not in (expansions or {})}

    def rename(t: Column) -> Column:
        out = None
        for token, words in table.items():
            value = F.array(*[F.lit(w) for w in words])
            out = F.when(t == token, value) if out is None else out.when(t == token, value)
        return F.array(t) if out is None else out.otherwise(F.array(t))

    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, rename)))), "_")


def key_tokens(key: Column, generic: Sequence[str] = (), least: int = 2) -> Column:
    """Tokens of an event key that name something: no digits, not generic, in order."""
    raw = F.regexp_extract_all(F.lower(text_of(key)), F.lit(rf"([a-z0-9{HANGUL}]+)"), F.lit(1))
    ok = lambda t: (F.length(t) >= least) & ~t.rlike(r"\d")
    return F.filter(raw, (lambda t: ok(t) & ~t.isin(*generic)) if generic else ok)


def key_entities(key: Column, generic: Sequence[str] = ()) -> Column:
    """Key tokens with the acronyms of every three or four of them in a row."""

    def acronyms(tokens: Column, size: int) -> Column:
        n = F.size(tokens)
        starts = F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))
        made = F.transform(starts, lambda i: F.array_join(F.transform(F.slice(tokens, i, size), lambda t: F.left(t, F.lit(1))), ""))
        return F.when(n >= size, made).otherwise(F.array().cast("array<string>"))

    return bind(key_tokens(key, generic), lambda tokens: F.array_distinct(F.concat(tokens, acronyms(tokens, 3), acronyms(tokens, 4))))


def long_terms(text: Column, stopwords: Sequence[str] = (), least: int = 5) -> Column:
    raw = F.regexp_extract_all(F.lower(text_of(text)), F.lit(rf"([a-z][a-z0-9]+|[{HANGUL}]{{2,}})"), F.lit(1))
    return F.array_distinct(F.filter(raw, lambda w: (F.length(w) >= least) & ~w.isin(*stopwords) if stopwords else F.length(w) >= least))


def article_identity(url: Column, title: Column, source: Column) -> Column:
    """`url:` with the normal address, else title and source."""
    u = nz(url)
    return F.when(u.isNotNull(), F.concat(F.lit("url:"), normalize_url(u))).otherwise(F.concat(F.lit("title:"), F.lower(squeeze(text_of(title))), F.lit("|source:"), F.lower(squeeze(text_of(source)))))


# Lexicons


def keyword_hit(text: Column, keyword: str) -> Column:
    """Keywords with a Latin letter match as whole words, others anywhere; text is lower-cased first."""
    low = F.lower(text_of(text))
    if re.search("[a-z]", keyword.lower()):
        return low.rlike(rf"(?U)\b{escape_regex(keyword.lower())}\b")
    return F.contains(low, F.lit(keyword.lower()))


def hits(text: Column, keywords: Iterable[str]) -> Column:
    """Keywords that occur, in lexicon order."""
    found = [F.when(keyword_hit(text, k), F.lit(k)) for k in keywords]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def first_hit(text: Column, keywords: Iterable[str]) -> Column:
    found = [F.when(keyword_hit(text, k), F.lit(k)) for k in keywords]
    return F.coalesce(*found, F.lit(None).cast("string")) if found else F.lit(None).cast("string")


def plain_word(keyword: str) -> bool:
    """Whether a keyword is one Latin word, so that it occurs where the word does."""
    return re.fullmatch(r"[a-z0-9_]*[a-z][a-z0-9_]*", keyword.lower()) is not None


def word_set(low: Column) -> Column:
    """Distinct words of a lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?U)(\w+)"), F.lit(1)))


def worded(text: Column) -> Column:
    """(low, words) of a text: what several lexicons are held against, extracted once where it is bound."""
    low = F.lower(text_of(text))
    return F.struct(low.alias("low"), word_set(low).alias("words"))


def first_in(found: Column, keywords: Iterable[str]) -> Column:
    """As `first_hit`, on the `worded` text: runs of plain words are met by one intersection."""
    out, run = [], []

    def close() -> None:
        if run:
            out.append(F.get(F.array_intersect(F.array(*[F.lit(k) for k in run]), found["words"]), F.lit(0)))
            run.clear()

    for k in keywords:
        if plain_word(k) and k == k.lower():
            run.append(k)
        else:
            close()
            out.append(F.when(keyword_hit(found["low"], k), F.lit(k)))
    close()
    return F.coalesce(*out, F.lit(None).cast("string"))


def first_match(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first pattern that occurs, null if none."""
    out = None
    for label, pattern in rules:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return F.lit(None).cast("string") if out is None else out


def all_matches(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in rules]))


# Rendering


def sparkline(values: Column, bars: str = "▁▂▃▄▅▆▇█") -> Column:
    """One bar a value, half-even rounding; equal values are all the middle bar."""
    chars = F.array(*[F.lit(b) for b in bars])

    def draw(span: Column) -> Column:
        scaled = lambda v: F.bround((v - span["low"]) / F.nullif(span["high"] - span["low"], F.lit(0.0)) * (len(bars) - 1), 0)
        bar = lambda v: F.element_at(chars, F.coalesce(scaled(v), F.lit(len(bars) // 2 - 1)).cast("int") + 1)
        return F.array_join(F.transform(values, bar), "")

    return F.when(F.size(values) > 0, bind(F.struct(F.array_min(values).alias("low"), F.array_max(values).alias("high")), draw)).otherwise("")


def quoted_evidence(quote: Column, fields: Sequence[Column], least: int = 8, most: int = 160) -> Column:
    """The quote, white space apart, is part of one of the fields and of fair length."""
    q = squeeze(text_of(quote))
    inside = F.lit(False)
    for field in fields:
        inside = inside | F.contains(squeeze(text_of(field)), q)
    return F.length(q).between(least, most) & inside


def preserves_qualifiers(source: Column, target: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Each qualifier of the source has its mark in the target."""
    out = F.lit(True)
    for in_source, in_target in pairs:
        out = out & (~source.rlike(in_source) | target.rlike(in_target))
    return out


def escape_markup(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return F.replace(c, F.lit("|"), F.lit("｜"))


def link_markup(url: Column, title: Column) -> Column:
    safe = public_url(url)
    return F.when(safe != "", F.concat(F.lit("<"), safe, F.lit("|"), escape_markup(title), F.lit(">"))).otherwise(escape_markup(title))


def guarded_title(title: Column, claim: Column, labels: Mapping[str, str]) -> Column:
    """Title with the label of its claim status in front, once."""
    out = title
    for status, label in labels.items():
        out = F.when((claim == status) & ~title.startswith(label), F.concat(F.lit(label + " "), title)).otherwise(out)
    return out


def topic_signature(event_key: Column, topic_key: Column) -> Column:
    return F.struct(F.lower(F.trim(text_of(event_key))).alias("event_key"), F.lower(F.trim(text_of(topic_key))).alias("topic_key"))
