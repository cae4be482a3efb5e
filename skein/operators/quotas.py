"""Selections under several quotas at once: rule ranks, fallback, finalised picks, regions and overflow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import ranked


@dataclass(frozen=True)
class Quota:
    """Places of a category: in all, a region, a source; and the flag whose rows may go on to `overflow_cap`."""

    cap: int
    region_cap: int | None = None
    source_cap: int | None = None
    overflow: str | None = None
    overflow_cap: int = 0
    needs_signal: bool = False


_NO_CAP = 1 << 30


def _of(quotas: Mapping[str, Quota], field: str, none: object, category: str) -> Column:
    pairs = [F.lit(x) for name, q in quotas.items() for x in (name, none if getattr(q, field) is None else getattr(q, field))]
    return F.create_map(*pairs)[F.col(category)]


def decision_strength(editorial: Column, deals: Column, flagged: Column, status: Column, live: Sequence[str] = ("adverse_confirmed", "in_progress", "reported_unconfirmed")) -> Column:
    """Distinct signals, 2 for a flagged row, 1 for an event that is still moving."""
    return F.size(F.array_distinct(editorial)) + F.size(F.array_distinct(deals)) + F.when(flagged, 2).otherwise(0) + F.when(status.isin(*live), 1).otherwise(0)


def title_value(title: Column, prized: Sequence[str], technical: Sequence[str]) -> Column:
    """One for each prized pattern, three less for a technical one."""
    value = F.lit(0)
    for p in prized:
        value = value + title.rlike(p).cast("int")
    poor = F.lit(False)
    for p in technical:
        poor = poor | title.rlike(p)
    return value - F.when(poor, 3).otherwise(0)


def rule_order(value: str = "title_value", strength: str = "strength", signal: str = "signal", relevance: str = "relevance", region: str = "region", first: str = "global") -> list[Column]:
    """The five-part rule key: title value, decision strength, signal sum, relevance, preferred region."""
    return [F.desc(value), F.desc(strength), F.desc(signal), F.desc(relevance), (F.col(region) == first).desc()]


def selection_score(judged: Column, relevance: Column, preferred: Column, bonus: float, adjustment: Column) -> Column:
    """The judge's score, else relevance with a bonus for a preferred region; the adjustment in any case."""
    own = F.coalesce(relevance, F.lit(0.0)) + F.when(preferred, bonus).otherwise(0.0)
    return F.coalesce(judged, own) + F.coalesce(adjustment, F.lit(0.0))


def eligible(excluded: Column, geography: Column) -> Column:
    return ~F.coalesce(excluded, F.lit(False)) & F.coalesce(geography, F.lit(True))


def region_pool(rows: DataFrame, category: str, region: str, order: Sequence[Column], caps: Mapping[str, int], pool: int = 12) -> DataFrame:
    """Candidates of a judge: `pool` a category; of a category split by region, max(cap, pool / 2) of each region."""
    split = F.create_map(*[F.lit(x) for c, n in caps.items() for x in (c, max(n, pool // 2))])[F.col(category)] if caps else F.lit(None).cast("int")
    both = ranked(ranked(rows, [category], order, "_in_category"), [category, region], order, "_in_region")
    return both.where(F.when(split.isNull(), F.col("_in_category") <= pool).otherwise(F.col("_in_region") <= split)).drop("_in_category", "_in_region")


def rule_fallback(rows: DataFrame, quotas: Mapping[str, Quota], order: Sequence[Column], *, category: str = "category", region: str = "region", source: str = "source", strength: str = "strength", first: str = "global") -> DataFrame:
    """The selection without a judge: (rows, place, overflowed).

    A category with a source cap takes the preferred region first; one with a region cap
    takes that many of each region, the preferred first; then rows with the overflow flag
    fill up to its cap.  A category that needs a signal passes over rows of no strength.
    Unknown categories select nothing.
    """
    get = lambda field, none: _of(quotas, field, none, category)
    known = rows.withColumn("_cap", get("cap", 0)).where(F.col("_cap").isNotNull())
    known = known.where(~get("needs_signal", False) | (F.col(strength) > 0))
    known = known.withColumn("_rcap", get("region_cap", _NO_CAP)).withColumn("_scap", get("source_cap", _NO_CAP)).withColumn("_ocap", get("overflow_cap", 0))
    flags = {q.overflow for q in quotas.values() if q.overflow}
    flag = F.lit(False)
    for name in flags:
        flag = F.when(get("overflow", "") == name, F.coalesce(F.col(name), F.lit(False))).otherwise(flag)
    by_region = F.when((F.col("_scap") < _NO_CAP) | (F.col("_rcap") < _NO_CAP), F.when(F.col(region) == first, 0).otherwise(1)).otherwise(0)
    known = known.withColumn("_flag", flag).withColumn("_region_first", by_region)
    own = [F.col("_region_first"), *order]
    placed = ranked(ranked(known, [category, region], order, "_in_region"), [category, source], own, "_in_source")
    fits = (F.col("_in_region") <= F.col("_rcap")) & (F.col("_in_source") <= F.col("_scap"))
    placed = ranked(placed.withColumn("_fits", fits), [category, "_fits"], own, "_rank")
    # with region caps every region has its own places; else the category's cap holds
    base = F.col("_fits") & ((F.col("_rcap") < _NO_CAP) | (F.col("_rank") <= F.col("_cap")))
    placed = placed.withColumn("_base", base)
    group, of_source = Window.partitionBy(category), Window.partitionBy(category, source)
    placed = placed.withColumn("_n", F.count_if("_base").over(group)).withColumn("_s", F.count_if("_base").over(of_source))
    late = ~F.col("_base") & F.col("_flag")
    placed = ranked(ranked(placed.withColumn("_late", late), [category, source, "_late"], own, "_late_source").withColumn("_may", F.col("_late") & (F.col("_s") + F.col("_late_source") <= F.col("_scap"))), [category, "_may"], own, "_late_rank")
    over = F.col("_may") & (F.col("_n") + F.col("_late_rank") <= F.col("_ocap"))
    chosen = placed.withColumn("overflowed", over).where(F.col("_base") | over)
    chosen = ranked(chosen, [category], [F.col("overflowed"), *own], "place")
    return chosen.select(*rows.columns, "place", "overflowed")


def finalise_picks(picks: DataFrame, rows: DataFrame, quotas: Mapping[str, Quota], *, run: str = "run", confirmed: str = "confirmed", promoted: Sequence[str] = ("major_deal",), list_caps: Mapping[str, int] | None = None, list_categories: Mapping[str, str] | None = None) -> DataFrame:
    """(run, ord, category, reason, llm_score) of a judge's picks (run, list, list_ord, place, ord) that quotas allow.

    Lists are taken in order, picks in theirs; a row is taken once.  Promoted lists take
    confirmed rows only and pass region caps; a list with a cap or category of its own
    holds to them.  A judge picks from bounded pools, so the picks of a run and category
    are few: they are walked in one task, as each depends on those before.
    """
    import pandas as pd

    list_caps, list_categories = dict(list_caps or {}), dict(list_categories or {})
    limits = {c: (q.cap, q.region_cap, q.source_cap) for c, q in quotas.items()}
    known = F.when(F.col("category").isin(*quotas), F.col("category")).otherwise(list(quotas)[-1])
    facts = rows.where("eligible").select("ord", known.alias("category"), "region", "source", F.col(confirmed).alias("sure"))
    joined = picks.select("ord", F.col(run).alias("run"), "list", "list_ord", "place").join(facts, "ord")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        taken, regions, sources, out = set(), {}, {}, []
        for r in part.sort_values(["list_ord", "place"]).itertuples():
            cap, region_cap, source_cap = limits[r.category]
            held = r.list in promoted
            full = len(taken) >= list_caps.get(r.list, cap)
            full = full or (source_cap is not None and sources.get(r.source, 0) >= source_cap)
            full = full or (region_cap is not None and not held and regions.get(r.region, 0) >= region_cap)
            if full or r.ord in taken or (held and not r.sure) or list_categories.get(r.list, r.category) != r.category:
                continue
            taken.add(r.ord)
            regions[r.region], sources[r.source] = regions.get(r.region, 0) + 1, sources.get(r.source, 0) + 1
            out.append((r.run, r.ord, r.category, r.list, r.list_ord, r.place))
        return pd.DataFrame(out, columns=["run", "ord", "category", "reason", "list_ord", "place"])

    kinds = dict(joined.dtypes)
    walked = joined.groupBy("run", "category").applyInPandas(walk, f"run {kinds['run']}, ord {kinds['ord']}, category string, reason string, list_ord {kinds['list_ord']}, place {kinds['place']}")
    order = F.row_number().over(Window.partitionBy("run").orderBy("list_ord", "place", "ord"))
    return walked.withColumn("llm_score", (F.lit(1001) - order).cast("double")).select(F.col("run").alias(run), "ord", "category", "reason", "llm_score")


def region_fill(rows: DataFrame, category: str, region: str, order: Sequence[Column], caps: Mapping[str, int], region_caps: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Weekly places of a category: each region's own, then rows without a region in what is left."""
    pairs = [F.lit(x) for c, own in region_caps.items() for r, n in own.items() for x in (f"{c}\x00{r}", n)]
    regional = F.create_map(*pairs)[F.concat(F.col(category), F.lit("\x00"), F.coalesce(region, F.lit("")))] if pairs else F.lit(None).cast("int")
    split = F.col(category).isin(*region_caps) if region_caps else F.lit(False)
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col(category)]
    placed = ranked(ranked(rows.withColumn("_cap", F.coalesce(cap, F.lit(0))), [category], order, "_in_category"), [category, region], order, "_in_region")
    none = F.coalesce(F.col(region), F.lit("")) == ""
    in_region = F.coalesce(split & ~none & (F.col("_in_region") <= regional), F.lit(False))
    placed = placed.withColumn("_regional", in_region).withColumn("_n", F.count_if("_regional").over(Window.partitionBy(category)))
    filled = ranked(placed.withColumn("_none", none), [category, "_none"], order, "_fill")
    keep = F.when(split, F.col("_regional") | (F.col("_none") & (F.col("_n") + F.col("_fill") <= F.col("_cap")))).otherwise(F.col("_in_category") <= F.col("_cap"))
    return ranked(filled.where(keep), [category], order, "place").select(*rows.columns, "place")


def overflow(rows: DataFrame, selected: Column, flag: Column, category: str, order: Sequence[Column], cap: int) -> DataFrame:
    """Selected rows, and flagged ones after them until a category has `cap`."""
    marked = rows.withColumn("_sel", F.coalesce(selected, F.lit(False))).withColumn("_n", F.count_if("_sel").over(Window.partitionBy(category)))
    marked = marked.withColumn("_late", ~F.col("_sel") & F.coalesce(flag, F.lit(False)))
    dealt = ranked(marked, [category, "_late"], order, "_r")
    return dealt.where(F.col("_sel") | (F.col("_late") & (F.col("_n") + F.col("_r") <= cap))).withColumn("overflowed", F.col("_late")).select(*rows.columns, "overflowed")


def repeats(rows: DataFrame, key: str, name: str = "repeated") -> DataFrame:
    """Flag all but the first row of each non-empty key."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    return rows.withColumn(name, F.when(F.coalesce(F.col(key), F.lit("")) == "", False).otherwise(first > 1))
