"""URL filters: fixed rules first, then empirical-Bayes host reputation; Spark SQL only.

Labelled pages give each host good and bad outcomes.  The share of bad pages of a
level (suffix, registered domain, host) is shrunk towards the level above through a
beta-binomial prior whose strength comes from the spread between its members, and a
host is blocked when a lower bound of its posterior passes the limit: by default the
share of all labelled pages (smoothed by one page of each kind), so that a host credibly worse than the whole is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of the query: (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The bound lies Z standard deviations below the posterior mean (80 % of a normal lie above it).
Z = 0.842
#: Bounds of the prior's strength in pseudo-pages.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; of rules of equal length the first in order."""
    text, verdict = None, None
    for what, at, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        text = F.when(fits, at + prefix) if text is None else text.when(fits, at + prefix)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def domain_of(host: Column, suffix_labels: int = 1) -> tuple[Column, Column]:
    """(registered domain, suffix): the last labels of the host."""
    return F.substring_index(host, ".", -(suffix_labels + 1)), F.substring_index(host, ".", -suffix_labels)


def _strength(over: str, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Strength of the prior of each group in `keys`, by moments over its members."""
    groups = stats.groupBy(*keys) if keys else stats.groupBy()
    sums = groups.agg(F.sum("bad").alias("_b"), F.sum("n").alias("_n"), F.count("*").alias("_k"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("_bb"), F.sum(F.col("n") * F.col("n")).alias("_nn"))
    mean = F.col("_b") / F.col("_n")
    between = F.col("_bb") - F.col("_b") * mean
    spread = F.col("_n") - F.col("_nn") / F.col("_n")
    variance = (between - (F.col("_k") - 1) * mean * (1 - mean)) / F.nullif(spread, F.lit(0.0))
    strength = mean * (1 - mean) / F.when(variance > 0, variance) - 1
    bounded = F.least(F.greatest(F.coalesce(strength, F.lit(MOST_STRENGTH)), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))
    return sums.select(*keys, F.col("_b").alias(f"{over}_bad"), F.col("_n").alias(f"{over}_n"), bounded.alias(f"{over}_strength"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, bad, n) of labelled pages -> each host's posterior share of bad pages with its lower bound."""
    domain, suffix = domain_of(F.col("host"))
    hosts = outcomes.withColumn("domain", domain).withColumn("suffix", suffix)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    of_all = _strength("all", suffixes, [])
    of_suffix = _strength("suffix", domains, ["suffix"])
    of_domain = _strength("domain", hosts.select("suffix", "domain", "bad", "n"), ["suffix", "domain"])
    all_mean = (F.col("all_bad") + 1) / (F.col("all_n") + 2)
    # the overall row is one aggregate of one row: its size is proven
    prior = of_suffix.crossJoin(F.broadcast(of_all)).withColumn("suffix_mean", (F.col("suffix_bad") + F.col("all_strength") * all_mean) / (F.col("suffix_n") + F.col("all_strength")))
    prior = of_domain.join(prior.select("suffix", "suffix_mean", "suffix_strength", all_mean.alias("overall")), "suffix").withColumn("domain_mean", (F.col("domain_bad") + F.col("suffix_strength") * F.col("suffix_mean")) / (F.col("domain_n") + F.col("suffix_strength")))
    a = F.col("bad") + F.col("domain_strength") * F.col("domain_mean")
    b = F.col("n") - F.col("bad") + F.col("domain_strength") * (1 - F.col("domain_mean"))
    mean = a / (a + b)
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(prior.select("domain", "suffix", "domain_strength", "domain_mean", "overall"), ["domain", "suffix"]).select("host", "n", "bad", mean.alias("posterior"), F.greatest(F.lit(0.0), mean - Z * deviation).alias("lower_bound"), "overall")


def filter_urls(pages: DataFrame, labels: DataFrame, *, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", bad: Column | None = None, rules: Sequence[tuple[str, str, str]] = RULES, limit: float | None = None) -> DataFrame:
    """Host, path, rule and verdict of every page.

    `labels` holds outcomes of pages by id; `bad` says which are bad (default: toxic).
    A host is blocked if its lower bound is above `limit` (default: the bad share of all
    labelled pages).
    A page whose host has no labelled page is allowed; null labels and outcomes are no
    evidence; a null url has an empty host and path; repeated rows each give a row.
    """
    bad = F.col("toxic") == 1 if bad is None else bad
    host, path = host_and_path(F.col("url"))
    seen = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("rule", rule).withColumn("ruled", ruled)
    marks = labels.select(F.col(label_id).alias("id"), bad.cast("int").alias("is_bad")).where("id is not null and is_bad is not null").groupBy("id").agg(F.max("is_bad").alias("is_bad"))
    # hosts first meet their outcomes one row a host and partition: a hot host is summed before it moves
    outcomes = seen.where("host <> ''").join(marks, F.col("page_id") == F.col("id")).groupBy("host").agg(F.sum("is_bad").cast("double").alias("bad"), F.count("*").cast("double").alias("n"))
    known = reputation(outcomes).select(F.col("host").alias("known_host"), "posterior", "lower_bound", "overall")
    judged = seen.join(known, F.col("host") == F.col("known_host"), "left").drop("known_host")
    above = F.col("lower_bound") > (F.col("overall") if limit is None else F.lit(float(limit)))
    verdict = F.coalesce("ruled", F.when(above, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "posterior", "lower_bound")
