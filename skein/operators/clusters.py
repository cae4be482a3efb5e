"""Pairs, leader clusters, components and elections.

Order is meaning: every input carries an `ord` that says which row came first, and
greedy grouping is reproduced as the first maximal independent set in that order, found
by rounds of joins instead of a sequential scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Similarity levels and day gaps of the merge rule.
MERGE_LEVEL, SELECTION_LEVEL, REACTION_LEVEL, TOPIC_LEVEL = 0.72, 0.60, 0.57, 0.42
LEXICAL_LEVEL, RARE_LEAST, RARE_MOST = 0.30, 2, 6
HEADLINE_SHARED, HEADLINE_SHARE = 4, 0.65


def leader_clusters(nodes: DataFrame, edges: DataFrame, id: str = "ord") -> DataFrame:
    """(id, leader): in id order an unclaimed node leads and claims its unclaimed neighbours.

    `edges` holds (i, j), i < j.  A round makes leaders of all undecided nodes with no
    undecided smaller neighbour and rules out their larger neighbours; once all are
    decided, a node that does not lead belongs to its smallest neighbour that does.
    """
    edges = cut(edges.select("i", "j").distinct())
    open_ = nodes.select(F.col(id).alias("n")).distinct()
    # nodes without edges lead at once
    touched = edges.select(F.col("i").alias("n")).unionByName(edges.select(F.col("j").alias("n"))).distinct()
    leaders = cut(open_.join(touched, "n", "left_anti"))
    open_ = cut(open_.join(touched, "n", "left_semi"))
    while open_.limit(1).count():
        live = edges.join(open_.withColumnRenamed("n", "i"), "i").join(open_.withColumnRenamed("n", "j"), "j")
        leads = cut(open_.join(live.select(F.col("j").alias("n")), "n", "left_anti"))
        claimed = live.join(leads.withColumnRenamed("n", "i"), "i", "left_semi").select(F.col("j").alias("n"))
        leaders = leaders.unionByName(leads)
        open_ = cut(open_.join(leads.unionByName(claimed), "n", "left_anti"))
    leaders = cut(leaders)
    members = edges.join(leaders.withColumnRenamed("n", "i"), "i", "left_semi").join(leaders.withColumnRenamed("n", "j"), "j", "left_anti")
    claims = members.groupBy(F.col("j").alias(id)).agg(F.min("i").alias("leader"))
    return leaders.select(F.col("n").alias(id), F.col("n").alias("leader")).unionByName(claims)


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, component): least node reachable, by minimum labels with pointer jumping.

    Labels grow with the graph, so they are merged, never sent whole to each task.
    """
    both = cut(edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).where("i <> j").distinct(), slim=True)
    labels = cut(both.groupBy(F.col("i").alias("node")).agg(F.min("j").alias("m")).select("node", F.least("node", "m").alias("component")), slim=True)
    while True:
        near = both.join(labels.withColumnRenamed("node", "j").hint("merge"), "j").groupBy(F.col("i").alias("node")).agg(F.min("component").alias("near"))
        root = labels.select(F.col("node").alias("near2"), F.col("component").alias("root"))
        step = labels.join(near.hint("merge"), "node", "left").withColumn("near2", F.least("component", F.coalesce("near", "component")))
        after = cut(step.join(root.hint("merge"), "near2", "left").select("node", F.col("component").alias("old"), F.least("near2", F.coalesce("root", "near2")).alias("component")), slim=True)
        labels = after.drop("old")
        if not after.where("old <> component").limit(1).count():
            return labels


def topic_components(rows: DataFrame, id: str, keys: Sequence[str]) -> DataFrame:
    """Rows that share any key, directly or through others: the graph of rows and keys."""
    tagged = None
    for k in keys:
        part = rows.where(F.col(k).isNotNull()).select(F.col(id), F.concat(F.lit(k + ":"), F.col(k).cast("string")).alias("key"))
        tagged = part if tagged is None else tagged.unionByName(part)
    # a key's rows form a star around its least row: as many edges as rows
    hub = tagged.groupBy("key").agg(F.min(id).alias("i"))
    edges = tagged.join(hub, "key").select("i", F.col(id).alias("j"))
    found = component_labels(edges).withColumnRenamed("node", id)
    return rows.select(id).distinct().join(found, id, "left").select(id, F.coalesce("component", F.col(id)).alias("component"))


def token_pairs(tokens: DataFrame, id: str = "ord", token: str = "token", least: int = RARE_LEAST, most: int = RARE_MOST) -> DataFrame:
    """(i, j, shared): pairs that share tokens of document frequency least..most."""
    df = tokens.groupBy(token).agg(F.count("*").alias("df")).where(F.col("df").between(least, most))
    rare = tokens.join(df, token).select(F.col(id).alias("i"), token)
    other = rare.select(F.col("i").alias("j"), token)
    return rare.join(other, token).where("i < j").groupBy("i", "j").agg(F.count("*").alias("shared"))


def tfidf_weights(grams: DataFrame, id: str = "ord", gram: str = "gram", least_df: int = 2, most_features: int | None = 30_000) -> DataFrame:
    """(id, gram, w): tf * (ln((1 + n) / (1 + df)) + 1), rows of length 1.

    `grams` has one row an occurrence.  The vocabulary is the `most_features` commonest
    grams of document frequency `least_df` or more.
    """
    n = grams.select(F.col(id)).distinct().count()
    tf = grams.groupBy(id, gram).agg(F.count("*").alias("tf"))
    terms = tf.groupBy(gram).agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= least_df)
    if most_features is not None:
        terms = terms.orderBy(F.desc("total"), gram).limit(most_features)
    weighed = tf.join(terms, gram).withColumn("w", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    length = weighed.groupBy(id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return weighed.join(length, id).select(id, gram, (F.col("w") / F.col("length")).alias("w"))


def tfidf_pairs(weights: DataFrame, level: float = LEXICAL_LEVEL, id: str = "ord", gram: str = "gram") -> DataFrame:
    """(i, j, sim): pairs whose cosine reaches `level`, by a join on shared grams."""
    a = weights.select(F.col(id).alias("i"), gram, F.col("w").alias("a"))
    b = weights.select(F.col(id).alias("j"), gram, F.col("w").alias("b"))
    return a.join(b, gram).where("i < j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("sim")).where(F.col("sim") >= level)


def vector_pairs(vectors: DataFrame, level: float, id: str = "ord", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """(i, j, sim), i < j, of cosine `level` or more: every pair, block by block.

    Rows are dealt into blocks of bounded size; a task multiplies two blocks with numpy
    and gives back only the pairs that pass.
    """
    import numpy as np
    import pandas as pd

    n = max(1, -(-vectors.count() // block))
    own = vectors.select(F.col(id).alias("i"), F.col(vector).cast("array<double>").alias("v")).withColumn("b", F.pmod(F.xxhash64("i"), F.lit(n)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = own.withColumn("o", other).select(F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "i", "v")

    def multiply(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(rows["v"].to_numpy())
        size = np.linalg.norm(m, axis=1)
        m = m / np.where(size == 0, 1.0, size)[:, None]
        ids, blocks = rows["i"].to_numpy(), rows["b"].to_numpy()
        out = []
        for lo in range(0, len(m), 512):
            sim = m[lo : lo + 512] @ m.T
            a, b = np.nonzero(sim >= level)
            keep = ids[lo + a] < ids[b]
            if rows["x"].iloc[0] != rows["y"].iloc[0]:
                keep &= blocks[lo + a] != blocks[b]
            out.append(pd.DataFrame({"i": ids[lo + a][keep], "j": ids[b][keep], "sim": sim[a, b][keep]}))
        return pd.concat(out)

    return dealt.groupBy("x", "y").applyInPandas(multiply, "i bigint, j bigint, sim double")


# Rules on pairs; the columns of the two sides are given as functions of a prefix


def events_compatible(types: tuple[Column, Column], stages: tuple[Column, Column], ipo_conflict: Column | None = None) -> Column:
    """No veto: event types not disjoint, funding stages not different, no conflict."""
    disjoint = (F.size(types[0]) > 0) & (F.size(types[1]) > 0) & ~F.arrays_overlap(types[0], types[1])
    differ = (F.coalesce(stages[0], F.lit("")) != "") & (F.coalesce(stages[1], F.lit("")) != "") & (stages[0] != stages[1])
    out = ~(disjoint | differ)
    return out if ipo_conflict is None else out & ~ipo_conflict


def same_headline(tokens: tuple[Column, Column], gap: Column | None = None, rates: tuple[Column, Column] | None = None, compatible: Column | None = None) -> Column:
    """Near in time, and four and 65% of the fewer tokens in common."""
    shared = F.size(F.array_intersect(*tokens))
    fewer = F.least(F.size(tokens[0]), F.size(tokens[1]))
    out = (shared >= HEADLINE_SHARED) & (fewer >= HEADLINE_SHARED) & (shared / fewer >= HEADLINE_SHARE)
    if gap is not None:
        out = out & F.coalesce(gap <= 1, F.lit(True))
    if rates is not None:
        out = out & ~((F.size(rates[0]) > 0) & (F.size(rates[1]) > 0) & ~F.arrays_overlap(*rates))
    return out if compatible is None else out & compatible


def policy_reaction(gap: Column, actors: tuple[Column, Column], actions: tuple[Column, Column], reaction: tuple[Column, Column], rates: tuple[Column, Column]) -> Column:
    """Known gap of a day, a shared actor and action, a reaction on either side, rates not disjoint."""
    disjoint = (F.size(rates[0]) > 0) & (F.size(rates[1]) > 0) & ~F.arrays_overlap(*rates)
    return F.coalesce(gap <= 1, F.lit(False)) & F.arrays_overlap(*actors) & F.arrays_overlap(*actions) & (reaction[0] | reaction[1]) & ~disjoint


def topic_series(topics: tuple[Column, Column], sources: tuple[Column, Column], gap: Column) -> Column:
    """One discovery topic of one source within two days."""
    return (topics[0] == topics[1]) & (sources[0] == sources[1]) & F.coalesce(gap <= 2, F.lit(False))


def should_merge(sim: Column, compatible: Column, headline: Column, family_veto: Column, reaction: Column, topic: Column) -> Column:
    """The cascade: veto, headline, family veto, then levels with weaker levels for stronger ties."""
    return F.when(~compatible, False).when(headline, True).when(family_veto, False).otherwise((sim >= MERGE_LEVEL) | ((sim >= REACTION_LEVEL) & reaction) | ((sim >= TOPIC_LEVEL) & topic))


def same_event_key(keys: tuple[Column, Column], gap: Column, entities: tuple[Column, Column], events: tuple[Column, Column], compatible: Column) -> Column:
    """Equal canonical keys, or near and compatible with equal entities and half the event words."""
    fewer = F.least(F.size(events[0]), F.size(events[1]))
    close = F.coalesce(gap <= 1, F.lit(True)) & compatible & (F.size(entities[0]) > 0) & (F.array_sort(entities[0]) == F.array_sort(entities[1])) & (fewer > 0) & (F.size(F.array_intersect(*events)) / fewer >= 0.5)
    return (keys[0] != "") & (keys[1] != "") & ((keys[0] == keys[1]) | close)


# Elections and merges


def elect(rows: DataFrame, group: Sequence[str], order: Sequence[Column], flag: str = "is_representative") -> DataFrame:
    """Flag the first row of each group by `order`, the input order last."""
    w = Window.partitionBy(*group).orderBy(*order, F.col("ord"))
    return rows.withColumn(flag, F.row_number().over(w) == 1)


def title_groups(rows: DataFrame, title: str = "title") -> DataFrame:
    """Each row's group: the first row with the same title, white space and case apart."""
    key = F.lower(F.trim(F.regexp_replace(F.col(title), r"\s+", " ")))
    keyed = rows.withColumn("norm_title", key)
    return keyed.withColumn("leader", F.min("ord").over(Window.partitionBy("norm_title")))


def merge_groups(rows: DataFrame, group: str, collect: Sequence[str]) -> DataFrame:
    """One row a group: its representative, with ordered distinct values of the other columns and a count.

    `rows` has is_representative and ord; the representative's values come first.
    """
    first = F.when(F.col("is_representative"), 0).otherwise(1)
    lists = [F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(first.alias("a"), F.col("ord").alias("o"), F.col(c).cast("string").alias("v")))), lambda x: x["v"])).alias(f"{c}s") for c in collect]
    merged = rows.groupBy(group).agg(F.count("*").alias("duplicate_count"), F.min(F.when(F.col("is_representative"), F.col("ord"))).alias("representative"), *lists)
    return merged


def collapse_stages(rows: DataFrame, target: str, stage: str, day: str, priority: Sequence[Column]) -> DataFrame:
    """Per target one row a stage; an older stage goes once all rows are dated and the newest day has one stage.

    Adds dedup_reason (null: kept).  Rows without target are kept.
    """
    by_target = Window.partitionBy(target)
    dated = rows.withColumn("_dated", F.count_if(F.col(day).isNull()).over(by_target) == 0).withColumn("_newest", F.max(day).over(by_target))
    dated = dated.withColumn("_stages", F.size(F.collect_set(stage).over(by_target))).withColumn("_latest", F.collect_set(F.when(F.col(day) == F.col("_newest"), F.col(stage))).over(by_target))
    superseded = (F.col("_stages") > 1) & F.col("_dated") & (F.size("_latest") == 1) & (F.col(stage) != F.get(F.col("_latest"), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(target, stage).orderBy(*priority, F.col("ord")))
    reason = F.when(F.col(target).isNull(), F.lit(None).cast("string")).when(superseded, "superseded_status").when(rank > 1, "same_target_cluster")
    return dated.withColumn("dedup_reason", reason).drop("_dated", "_newest", "_stages", "_latest")


def collapse_family(rows: DataFrame, family: str, order: Sequence[Column], keep_max: Sequence[str]) -> DataFrame:
    """One row a family by `order`, carrying the family's largest scores; rows without family stay."""
    own = Window.partitionBy(family)
    out = rows
    for c in keep_max:
        out = out.withColumn(f"event_{c}", F.when(F.col(family).isNotNull(), F.max(c).over(own)).otherwise(F.col(c)))
    rank = F.row_number().over(own.orderBy(*order, F.col("ord")))
    return out.withColumn("_rank", F.when(F.col(family).isNull(), 1).otherwise(rank)).where("_rank = 1").drop("_rank")


def near_duplicate_filter(rows: DataFrame, pairs: DataFrame, key: str = "event_key", representative: Sequence[str] = ("score",)) -> DataFrame:
    """(slot, kept): in order, a row is dropped if alike a kept one; a row with a kept row's key
    takes its slot if it represents better.

    Slots depend on all rows before, so candidate components are found first and each is
    walked in order by itself; a component is the unit of work.
    """
    import pandas as pd

    keyed = rows.select("ord", F.col(key).alias("k"), F.struct(*representative).alias("rep"))
    hub = keyed.where("k is not null and k <> ''").groupBy("k").agg(F.min("ord").alias("i"))
    by_key = keyed.join(hub, "k").select("i", F.col("ord").alias("j"))
    linked = component_labels(pairs.select("i", "j").unionByName(by_key)).withColumnRenamed("node", "ord")
    edges = pairs.groupBy(F.col("j").alias("ord")).agg(F.collect_set("i").alias("before"))
    walk = keyed.join(linked, "ord", "left").withColumn("component", F.coalesce("component", "ord")).join(edges, "ord", "left")

    def step(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        slot_of: dict[str, int] = {}
        keys, reps, slots = {}, {}, []
        for row in part.sort_values("ord").itertuples():
            k = row.k or ""
            keys[row.ord], reps[row.ord] = k, tuple(row.rep.values()) if isinstance(row.rep, dict) else tuple(row.rep)
            if k and k in slot_of:
                at = slot_of[k]
                if reps[row.ord] > reps[kept[at]]:
                    kept[at] = row.ord
                continue
            before = set(row.before) if row.before is not None else set()
            if any(p in before and not (k and keys[p]) for p in kept):
                continue
            kept.append(row.ord)
            slots.append(row.ord)
            if k:
                slot_of[k] = len(kept) - 1
        return pd.DataFrame({"slot": slots, "kept": kept})

    return walk.groupBy("component").applyInPandas(step, "slot bigint, kept bigint")


def sequential_groups(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord, leader): a row joins the first group that has any member alike; groups never merge.

    The order of rows decides, so each candidate component is walked by itself.
    """
    import pandas as pd

    linked = component_labels(pairs).withColumnRenamed("node", "ord")
    before = pairs.groupBy(F.col("j").alias("ord")).agg(F.collect_set("i").alias("before"))
    walk = rows.select("ord").distinct().join(linked, "ord", "left").withColumn("component", F.coalesce("component", "ord")).join(before, "ord", "left")

    def step(part: pd.DataFrame) -> pd.DataFrame:
        groups: list[list[int]] = []
        for row in part.sort_values("ord").itertuples():
            alike = set(row.before) if row.before is not None else set()
            home = next((g for g in groups if alike.intersection(g)), None)
            if home is None:
                groups.append([row.ord])
            else:
                home.append(row.ord)
        return pd.DataFrame([(m, g[0]) for g in groups for m in g], columns=["ord", "leader"])

    return walk.groupBy("component").applyInPandas(step, "ord bigint, leader bigint")
