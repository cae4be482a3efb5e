"""Logical joins: registries, anti-joins against memory, blocked similarity, suffix and as-of matches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from .stories import SQUARE, products, squares

#: Terms of a block of articles or notes, and notes that all articles ask before the others.
NOTE_ELEMENTS, FIRST_NOTES = 1_500_000, 8192
#: Rows of a small side that may be broadcast after they have been counted.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows; else joins shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def registry_lookup(rows: DataFrame, registry: DataFrame, keys: Sequence[str], name: str, columns: Sequence[str]) -> DataFrame:
    """Columns of the registry by the first key of a row that is in it."""
    side = small(registry.select(F.col(name).alias("_n"), *[F.col(c).alias(f"_{c}") for c in columns]))
    out = rows
    for i, k in enumerate(keys):
        out = out.join(side.select(F.col("_n").alias(f"_n{i}"), *[F.col(f"_{c}").alias(f"_{c}{i}") for c in columns]), F.col(k) == F.col(f"_n{i}"), "left")
    for c in columns:
        picked = F.coalesce(*[F.when(F.col(f"_n{i}").isNotNull(), F.col(f"_{c}{i}")) for i in range(len(keys))])
        out = out.withColumn(c, picked)
    return out.drop(*[f"_n{i}" for i in range(len(keys))], *[f"_{c}{i}" for c in columns for i in range(len(keys))])


def unseen(rows: DataFrame, seen: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Rows none of whose keys is in `seen`: one anti-join a key."""
    out = rows
    for k in keys:
        out = out.join(seen.select(F.col(value).alias("_seen")).distinct(), F.col(k) == F.col("_seen"), "left_anti")
    return out


def overlapping(a: DataFrame, b: DataFrame, level: float) -> DataFrame:
    """(a, b, overlap) of rows (a, e) and (b, e) of distinct elements whose overlap coefficient reaches `level`.

    A pair shares at least level * n elements of its smaller side, of n, so one of that
    side's rarest n - ceil(level * n) + 1 is among them: these alone meet the whole other
    side, and common elements stay out of the join.
    """
    df = a.select(F.explode("e").alias("w")).unionByName(b.select(F.explode("e").alias("w"))).groupBy("w").agg(F.count("*").alias("df"))

    def rare(rows: DataFrame, id: str) -> DataFrame:
        weighed = rows.select(id, F.size("e").alias("n"), F.explode("e").alias("w")).join(df, "w")
        order = F.row_number().over(Window.partitionBy(id).orderBy("df", "w"))
        return weighed.withColumn("_r", order).where(F.col("_r") <= F.col("n") - F.ceil(F.col("n") * F.lit(level) - 1e-9) + 1).select(id, "w")

    whole = lambda rows, id: rows.select(id, F.explode("e").alias("w"))
    pairs = rare(a, "a").join(whole(b, "b"), "w").select("a", "b").unionByName(whole(a, "a").join(rare(b, "b"), "w").select("a", "b")).distinct()
    met = pairs.join(a.select("a", F.col("e").alias("x")), "a").join(b.select("b", F.col("e").alias("y")), "b")
    overlap = F.size(F.array_intersect("x", "y")) / F.least(F.size("x"), F.size("y"))
    return met.select("a", "b", overlap.alias("overlap")).where(F.col("overlap") >= level)


def title_overlaps(rows: DataFrame, seen: DataFrame, title: str = "title", seen_title: str = "title", id: str = "ord", level: float = 0.5) -> DataFrame:
    """(id, seen id, overlap) of titles whose words reach the overlap coefficient."""
    a = rows.select(F.col(id).alias("a"), T.word_tokens(F.col(title)).alias("e"))
    b = seen.select(F.col(id).alias("b"), T.word_tokens(F.col(seen_title)).alias("e"))
    return overlapping(a, b, level)


def unseen_titles(rows: DataFrame, seen: DataFrame, title: str = "title", seen_title: str = "title", id: str = "ord", level: float = 0.5) -> DataFrame:
    told = title_overlaps(rows, seen, title, seen_title, id, level).select(F.col("a").alias(id)).distinct()
    return rows.join(told, id, "left_anti")


def unseen_issues(rows: DataFrame, seen: DataFrame, *, title: str = "title", id: str = "ord", last: int | None = 800, share: float = 0.3, gram_level: float = 0.35, word_level: float = 0.5, letters: str = T.HANGUL) -> DataFrame:
    """Rows whose issue none of the `last` seen titles (ord: age) tells.

    Where either title has more than `share` of `letters`, character grams decide, else
    words; pairs meet through an inverted index of either.
    """
    recent = seen if last is None else seen.orderBy(F.desc("ord")).limit(last)
    heavy = lambda c: T.letter_ratio(F.col(c), letters) > share
    a = rows.select(F.col(id).alias("a"), F.col(title).alias("x"), heavy(title).alias("hx"))
    b = recent.select(F.col("ord").alias("b"), F.col(title).alias("y"), heavy(title).alias("hy"))
    told = None
    for elements, level, script in ((T.char_ngrams, gram_level, True), (T.word_tokens, word_level, False)):
        # pairs of two light titles are words' own; any pair with a heavy one is the grams'
        alike = overlapping(a.select("a", elements(F.col("x")).alias("e")), b.select("b", elements(F.col("y")).alias("e")), level)
        both = alike.join(a.select("a", "hx"), "a").join(b.select("b", "hy"), "b")
        own = both.where((F.col("hx") | F.col("hy")) if script else ~(F.col("hx") | F.col("hy"))).select("a")
        told = own if told is None else told.unionByName(own)
    return rows.join(told.distinct(), F.col(id) == F.col("a"), "left_anti")


def recent_events(rows: DataFrame, memory: DataFrame, family: str, day: str, days: int = 7, status: str | None = None) -> DataFrame:
    """Split of rows by a memory of `days`: told (null: new) is the best status sent for the family.

    A row passes if its family is new in the window or its status, 2 or more, is above all
    that were sent.  The memory is first reduced to one row a (family, day).
    """
    past = memory.groupBy(F.col(family).alias("_f"), F.col(day).alias("_d")).agg(F.max(status or F.lit(0)).alias("_s"))
    # by (family, day), so rows that repeat stay as many as they are
    asked = rows.select(F.col(family).alias("_f"), F.col(day).alias("_day")).distinct()
    met = asked.join(past, "_f").where(F.col("_d").between(F.date_sub("_day", days), F.date_sub("_day", 1))).groupBy("_f", "_day").agg(F.max("_s").alias("told"))
    told = rows.join(met, (F.col(family) == F.col("_f")) & (F.col(day) == F.col("_day")), "left").drop("_f", "_day")
    new_status = F.lit(False) if status is None else (F.col(status) >= 2) & (F.col(status) > F.col("told"))
    return told.withColumn("kept", F.col("told").isNull() | new_status)


def vector_memory(rows: DataFrame, store: DataFrame, level: float, id: str = "ord", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(id, best) of rows alike any stored vector: every row against every stored one, block by block in one shuffle."""
    def dealt(df: DataFrame, side: int, own: str, other: str, n_own: int, n_other: int) -> DataFrame:
        placed = df.select(F.col(id).alias("i"), F.col(vector).cast("array<double>").alias("v"), F.lit(side).alias("side"), F.pmod(F.xxhash64(id), F.lit(n_own)).cast("int").alias(own))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    n_rows, n_store = (max(1, -(-df.count() // block)) for df in (rows, store))
    both = dealt(rows, 0, "x", "y", n_rows, n_store).unionByName(dealt(store, 1, "y", "x", n_store, n_rows))

    def best(part: pd.DataFrame) -> pd.DataFrame:
        def unit(frame: pd.DataFrame) -> np.ndarray:
            m = np.stack(frame["v"].to_numpy())
            size = np.linalg.norm(m, axis=1)
            return m / np.where(size == 0, 1.0, size)[:, None]

        mine, stored = part[part["side"] == 0], part[part["side"] == 1]
        if not len(mine) or not len(stored):
            return pd.DataFrame({"i": [], "best": []}).astype({"i": "int64", "best": "float64"})
        m, found = unit(stored).T, []
        for lo in range(0, len(mine), 512):
            found.append((unit(mine.iloc[lo : lo + 512]) @ m).max(axis=1))
        sim = np.concatenate(found)
        return pd.DataFrame({"i": mine["i"].to_numpy()[sim >= level], "best": sim[sim >= level]})

    found = both.groupBy("x", "y").applyInPandas(best, "i bigint, best double")
    return found.groupBy(F.col("i").alias(id)).agg(F.max("best").alias("best"))


def attach_notes(articles: DataFrame, notes: DataFrame, title: str = "title", note_title: str = "title", excerpt: str = "excerpt", day: str | None = None, capital: str | None = None, most: int = 2, stopwords: Sequence[str] = ()) -> DataFrame:
    """(ord, note, place, excerpt): at most `most` notes an article, three long terms in common
    (one of eight letters), or one of seven with capital words on both sides; at most three days apart.

    Blocks of articles meet blocks of notes, so that no pair is shuffled but the first `most`
    of an article in a block.  The first notes are asked before the others: articles that
    have all theirs by then need no more.
    """

    def side(df: DataFrame, c: str) -> DataFrame:
        # a term's hash, with its length in the last two bits: 1 for seven letters, 2 for more
        hashed = lambda w: F.shiftleft(F.shiftright(F.xxhash64(w), 2), 2) + F.when(F.length(w) >= 8, 2).when(F.length(w) == 7, 1).otherwise(0)
        named = F.lit(False) if capital is None else F.coalesce(F.col(c).rlike(capital), F.lit(False))
        on = F.unix_date(day).cast("double") if day else F.lit(None).cast("double")
        out = df.select(F.col("ord").alias("i"), F.transform(T.long_terms(F.col(c), stopwords), hashed).alias("t"), on.alias("d"), named.alias("c"))
        return cut(out.where(F.size("t") >= (3 if capital is None else 1)))

    def terms(t: np.ndarray) -> tuple:
        return t, np.ones(len(t))

    def weighed(t: np.ndarray) -> tuple:
        # one sum holds three counts: all terms, those of eight letters and more, those of seven
        return t, np.array([1, 1 + (1 << 34), 1 + (1 << 17)], dtype=float)[t & 3]

    def match(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(parts), ignore_index=True)
        a, n = part[part["side"] == 0], part[part["side"] == 1].sort_values("i", kind="stable")
        if not len(a) or not len(n):
            return
        ids, (days_a, days_n), (named_a, named_n) = (a["i"].to_numpy(), n["i"].to_numpy()), (a["d"].to_numpy(float), n["d"].to_numpy(float)), (a["c"].to_numpy(bool), n["c"].to_numpy(bool))
        theirs = squares(list(n["t"]), weighed)
        for u, square in enumerate(squares(list(a["t"]), terms)):
            mine = slice(u * SQUARE, u * SQUARE + square[0])
            had = np.zeros(square[0], int)
            for v, other in enumerate(theirs):
                if had.min() >= most:
                    break
                its = slice(v * SQUARE, v * SQUARE + other[0])
                counts = products(square, other).astype(np.int64)
                k, longest = counts & 131071, (counts >> 17) & 131071
                same = (k >= 3) & (longest > 0)
                if capital is not None:
                    same |= (k == 1) & (counts > 1) & named_a[mine][:, None] & named_n[its][None, :]
                if day:
                    same &= ~(np.abs(days_a[mine][:, None] - days_n[its][None, :]) > 3)
                same &= had[:, None] + np.cumsum(same, axis=1, dtype=np.int32) <= most
                had += same.sum(axis=1)
                p, q = np.nonzero(same)
                yield pd.DataFrame({"a": ids[0][mine][p], "n": ids[1][its][q]})

    def blocks(df: DataFrame, least: int) -> int:
        return max(least, -(-(df.agg(F.sum(F.size("t"))).first()[0] or 0) // NOTE_ELEMENTS))

    def first_notes(some: DataFrame, others: DataFrame) -> DataFrame:
        n_some, n_others = blocks(some, 1), blocks(others, 8)
        deal = lambda df, side, own, n, other, m: df.withColumns({"side": F.lit(side), own: F.pmod(F.xxhash64("i"), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
        dealt = deal(some.withColumn("i", F.col("i").cast(kind)), 0, "x", n_some, "y", n_others).unionByName(deal(others.withColumn("i", F.col("i").cast(kind)), 1, "y", n_others, "x", n_some))
        return dealt.groupBy("x", "y").applyInPandas(match, f"a {kind}, n {kind}")

    place = F.row_number().over(Window.partitionBy("a").orderBy("n"))
    best = lambda found: found.withColumn("place", place).where(F.col("place") <= most)
    kind = "bigint"
    a, b = side(articles, title), side(notes, note_title)
    n = b.count()
    if n > FIRST_NOTES:
        early = b.approxQuantile("i", [FIRST_NOTES / n], 0.001)[0]
        found = cut(best(first_notes(a, b.where(F.col("i") <= early))))
        done = found.where(F.col("place") == most).select(F.col("a").alias("i"))
        found = found.drop("place").unionByName(first_notes(cut(a.join(done, "i", "left_anti")), b.where(F.col("i") > early)))
    else:
        found = first_notes(a, b)
    chosen = best(found).select(F.col("a").alias("_a"), "n", "place")
    text = notes.select(F.col("ord").alias("n"), F.left(F.col(excerpt), F.lit(300)).alias("excerpt"))
    owner = dict(articles.dtypes)["ord"], dict(notes.dtypes)["ord"]
    return chosen.join(text, "n").select(F.col("_a").cast(owner[0]).alias("ord"), F.col("n").cast(owner[1]).alias("note"), "place", "excerpt")


def suffix_match(rows: DataFrame, registry: DataFrame, host: str = "host", domain: str = "domain", value: str = "publisher") -> DataFrame:
    """Longest registered domain that the host is or ends in: suffixes are exploded into an equi-join."""
    tails = rows.select(F.col(host), F.posexplode(T.domain_suffixes(F.col(host))).alias("_place", "_suffix")).distinct()
    met = tails.join(small(registry.select(F.col(domain).alias("_suffix"), F.col(value).alias("_value"))), "_suffix")
    best = met.groupBy(host).agg(F.min_by("_value", "_place").alias(value))
    return rows.join(best, host, "left")


def sender_policy(rows: DataFrame, policies: DataFrame, address: str = "sender", subject: str = "subject") -> DataFrame:
    """Policy of a mail: exact address, else domain with an alias in the subject; the first policy wins."""
    asked = rows.select(F.col(address).alias("_address"), F.col(subject).alias("_subject")).distinct()
    by_address = asked.join(small(policies.select(F.col("policy_ord").alias("o1"), F.col("address").alias("_a"))), F.lower("_address") == F.col("_a"), "left")
    # an equi-join on the domain; the alias is a residual condition
    host = F.lower(F.substring_index("_address", "@", -1))
    side = policies.select(F.col("policy_ord").alias("o2"), F.col("domain").alias("_d"), F.col("alias").alias("_alias"))
    by_domain = by_address.join(small(side), (host == F.col("_d")) & F.contains(F.lower("_subject"), F.lower("_alias")), "left")
    found = by_domain.groupBy("_address", "_subject").agg(F.coalesce(F.min("o1"), F.min("o2")).alias("policy_ord"))
    # rows that repeat stay as many as they are
    return rows.join(found, F.col(address).eqNullSafe(F.col("_address")) & F.col(subject).eqNullSafe(F.col("_subject")), "left").drop("_address", "_subject")


def week_close(points: DataFrame, key: str, day: str, value: str, start: Column, end: Column) -> DataFrame:
    """As-of closes per key: last value before the week, and last within it."""
    before, inside = F.col(day) < start, F.col(day).between(start, end)
    return points.groupBy(key).agg(
        F.max_by(value, F.when(before, F.col(day))).alias("previous"),
        F.max(F.when(before, F.col(day))).alias("previous_day"),
        F.max_by(value, F.when(inside, F.col(day))).alias("latest"),
        F.max(F.when(inside, F.col(day))).alias("latest_day"),
    )


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before its time, by one sort of both sides."""
    both = left.select(key, at, F.lit(None).cast(dict(right.dtypes)[value]).alias(value), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row")).unionByName(right.select(key, at, value, F.lit(0).alias("_left")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last(value, ignorenulls=True).over(w)).where("_left = 1").select("_row.*", F.col("_last").alias(value))


def range_join(points: DataFrame, ranges: DataFrame, at: Column, start: Column, end: Column, width: float) -> DataFrame:
    """points within ranges: an equi-join on buckets of `width`, then the exact condition."""
    bucket = lambda c: F.floor(c / width)
    p = points.withColumn("_bucket", bucket(at))
    r = ranges.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return p.join(r, "_bucket").where((at >= start) & (at <= end)).drop("_bucket")


def by_position(issues: DataFrame, editions: DataFrame, run: str = "run_id", index: str = "article") -> DataFrame:
    """Issue with the article at its index in the run's edition; an index out of bounds finds none."""
    placed = editions.select(F.col(run), F.posexplode("articles").alias(index, "found"))
    return issues.join(placed, [run, index], "left")


