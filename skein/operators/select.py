"""Ranking under quotas.  Every order ends with `ord`, so ties keep their input order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order, F.col("ord"))))


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return ranked(rows, group, order).where(F.col("rank") <= k)


def hard_cap(rows: DataFrame, group: Sequence[str], source: str, order: Sequence[Column], cap: int, k: int) -> DataFrame:
    """At most `cap` rows a source, then the k best."""
    capped = ranked(rows, [*group, source], order, "source_rank").where(F.col("source_rank") <= cap)
    return top_per_group(capped, group, order, k)


def soft_cap(rows: DataFrame, group: Sequence[str], source: str, order: Sequence[Column], cap: int, k: int) -> DataFrame:
    """Rows within a source's cap come first; places left over go to the deferred ones."""
    seen = ranked(rows, [*group, source], order, "source_rank")
    return ranked(seen, group, [(F.col("source_rank") > cap).asc(), *order]).where(F.col("rank") <= k)


def flag_cap(rows: DataFrame, group: Sequence[str], flag: Column, order: Sequence[Column], cap: int, k: int) -> DataFrame:
    """Top k in which at most `cap` rows carry the flag: later ones are passed over."""
    w = Window.partitionBy(*group).orderBy(*order, F.col("ord"))
    counted = rows.withColumn("_flag", flag.cast("int")).withColumn("_n", F.sum("_flag").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return top_per_group(counted.where((F.col("_flag") == 0) | (F.col("_n") <= cap)).drop("_flag", "_n"), group, order, k)


def swap_in(rows: DataFrame, group: Sequence[str], wanted: Column, score: str, order: Sequence[Column], k: int, tolerance: float = 1.0) -> DataFrame:
    """Top k; if none is wanted, the best wanted row takes the last place when its score is near enough."""
    out = ranked(rows.withColumn("_wanted", wanted), group, order)
    own = Window.partitionBy(*group)
    has = F.max(((F.col("rank") <= k) & F.col("_wanted")).cast("int")).over(own) == 1
    weakest = F.max(F.when(F.col("rank") <= k, F.col("rank"))).over(own)
    best = F.min(F.when((F.col("rank") > k) & F.col("_wanted"), F.col("rank"))).over(own)
    out = out.withColumn("_has", has).withColumn("_weakest", weakest).withColumn("_best", best)
    at = lambda place: F.max(F.when(F.col("rank") == F.col(place), F.col(score))).over(own)
    out = out.withColumn("_low", at("_weakest")).withColumn("_alt", at("_best"))
    swap = ~F.col("_has") & F.col("_best").isNotNull() & (F.col("_alt") >= F.col("_low") - tolerance)
    take = F.when(swap, ((F.col("rank") <= k) & (F.col("rank") != F.col("_weakest"))) | (F.col("rank") == F.col("_best"))).otherwise(F.col("rank") <= k)
    return out.withColumn("swapped_in", F.coalesce(swap & (F.col("rank") == F.col("_best")), F.lit(False))).where(take).drop("_wanted", "_has", "_weakest", "_best", "_low", "_alt")


def protected_cap(rows: DataFrame, category: str, region: str, always: Column, order: Sequence[Column], cap: int) -> DataFrame:
    """At most `cap` rows: those of `always` are kept in any case, then the best of each category
    and region, then the rest by order."""
    out = ranked(ranked(rows, [category], order, "_in_category"), [region], order, "_in_region")
    guard = F.when(always, 0).when((F.col("_in_category") == 1) | (F.col("_in_region") == 1), 1).otherwise(2)
    out = out.withColumn("guard", guard).withColumn("place", F.row_number().over(Window.orderBy("guard", *order, F.col("ord"))))
    return out.where((F.col("place") <= cap) | (F.col("guard") == 0)).drop("_in_category", "_in_region")


def protected_cap_scaled(rows: DataFrame, category: str, region: str, always: Column, order: Sequence[Column], cap: int) -> DataFrame:
    """protected_cap for inputs beyond a shortlist: only rows that can be in the result meet in one task.

    The `cap` best by order of each category hold the `cap` best of all, so the global
    order is taken over at most cap rows a category, the guarded rows and the always rows.
    """
    out = ranked(ranked(rows, [category], order, "_in_category"), [region], order, "_in_region")
    short = out.where(always | (F.col("_in_category") <= cap) | (F.col("_in_region") == 1)).drop("_in_category", "_in_region")
    return protected_cap(short, category, region, always, order, cap)


def round_robin(rows: DataFrame, group: str, order: Sequence[Column], k: int, per_group: int | None = None) -> DataFrame:
    """First the best of each group, then the second of each, and so on, up to k."""
    dealt = ranked(rows, [group], order, "round")
    if per_group is not None:
        dealt = dealt.where(F.col("round") <= per_group)
    # no group gives more than k rows
    dealt = dealt.where(F.col("round") <= k)
    return dealt.withColumn("place", F.row_number().over(Window.orderBy("round", F.col(group).asc_nulls_last(), F.col("ord")))).where(F.col("place") <= k)


def theme_pool(rows: DataFrame, group: Sequence[str], theme: str, source: str, score: str, per_theme: int = 3, source_cap: int = 2, k: int = 12, prefer: Column | None = None) -> DataFrame:
    """Round robin over themes, then filled in order, with a running cap a source.

    The i-th row of each theme is offered in turn, i up to `per_theme`, and passed over
    where it has been chosen or its source is full; then all rows are offered by `prefer`
    and score.  `theme` is a name or an array of names.  Choices depend on those before,
    so a group is walked in one task, over no more rows than can be offered: `per_theme` a
    theme, and of the rest those a walk of k choices can reach (a row is passed over only
    for its source, of which no more than source_cap + k rows are held, and at most k
    sources are full).
    """
    import pandas as pd

    first = F.lit(0) if prefer is None else F.when(prefer, 0).otherwise(1)
    own = rows.withColumn("_first", first).withColumn("_themes", F.col(theme) if dict(rows.dtypes)[theme].startswith("array") else F.when(F.col(theme).isNotNull(), F.array(theme)))
    order = [F.col("_first"), F.desc(score)]
    offered = ranked(own.select(*group, "ord", "_first", score, F.explode("_themes").alias("_theme")), [*group, "_theme"], order, "_t").where(F.col("_t") <= per_theme)
    turns = offered.groupBy(*group, "ord").agg(F.collect_list(F.struct("_t", "_theme")).alias("_turns"))
    reach = ranked(ranked(own, [*group, source], order, "_s").where(F.col("_s") <= source_cap + k), group, order, "_r").where(F.col("_r") <= k + k * (source_cap + k))
    by = lambda other: (F.col("r.ord") == F.col(f"{other}.ord"))
    met = own.alias("r").join(turns.select("ord", "_turns").alias("t"), by("t"), "left").join(reach.select("ord", F.lit(True).alias("_reach")).alias("f"), by("f"), "left")
    short = met.where("_turns IS NOT NULL OR _reach").select(*[f"r.{g}" for g in group], "r.ord", F.col(f"r.{source}").alias("_source"), "r._first", F.col(f"r.{score}").alias("_score"), "_turns")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_first", "_score", "ord"], ascending=[True, False, True])
        named = list(part.itertuples(index=False, name=None))
        columns = {c: i for i, c in enumerate(part.columns)}
        at = lambda row, c: row[columns[c]]
        turns = sorted((t["_t"], t["_theme"], n) for n, row in enumerate(named) if at(row, "_turns") is not None for t in at(row, "_turns"))
        chosen, used = [], {}
        for n in [*(t[2] for t in turns), *range(len(named))]:
            s = at(named[n], "_source")
            if len(chosen) < k and n not in chosen and used.get(s, 0) < source_cap:
                chosen.append(n)
                used[s] = used.get(s, 0) + 1
        out = part.iloc[chosen][[*group, "ord"]].copy()
        out["place"] = range(1, len(chosen) + 1)
        return out

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), f"ord {kinds['ord']}", "place int"])
    return short.groupBy(*group).applyInPandas(walk, schema)


def soft_diversity(rows: DataFrame, group: Sequence[str], kind: str, importance: str, score: str, k: int = 3, tolerance: float = 1.0) -> DataFrame:
    """k rows a group by importance and score; inside an importance band an unseen kind is preferred
    when its score is within `tolerance` of the best.

    Each choice depends on those before.  Only the k best of each (importance, kind) can
    be chosen, so that many rows of a group meet in a task.
    """
    import pandas as pd

    short = ranked(rows, [*group, importance, kind], [F.desc(score)], "_r").where(F.col("_r") <= k)

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        pool = part.sort_values([importance, score, "ord"], ascending=[False, False, True]).to_dict("records")
        chosen, seen = [], set()
        plain = not any(r[importance] for r in pool)
        while pool and len(chosen) < k:
            band = [r for r in pool if r[importance] == pool[0][importance]]
            pick = band[0]
            if chosen and not plain:
                fresh = [r for r in band if r[kind] and r[kind] not in seen and r[score] >= pick[score] - tolerance]
                pick = fresh[0] if fresh else pick
            pool.remove(pick)
            chosen.append(pick)
            seen.add(pick[kind])
        return pd.DataFrame([{**{g: r[g] for g in group}, "ord": r["ord"], "place": n + 1} for n, r in enumerate(chosen)])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), f"ord {kinds['ord']}", "place int"])
    return short.groupBy(*group).applyInPandas(walk, schema)
