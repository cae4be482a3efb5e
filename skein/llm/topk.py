"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integer weights per dimension (term).  Queries are sparse rows in blocks
of a bounded number of weights; every block goes to all candidates, a strip of queries
at a time.  Within a batch of candidates each term has a posting list of the candidates
with a weight there; the queries that hold the term scatter weight times weight into a
dense array of scores.  A partition selection keeps the best of each batch, and the
batches' bests are merged.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the queries of one block (a broadcast of 32 MB), and queries and candidates scored at once.
BLOCK_WEIGHTS, STRIP, BATCH = 1 << 22, 2048, 2048
SCALE = 256.0
_RESULT = "query_id bigint, vec_id bigint, score bigint"
_LONG = (1 << 63) - 1


def weights_of(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows that take part, their weights floor(SCALE * x) as exact numbers).

    A row that is null or empty, or holds a null or a number that is not finite, takes no part.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    length = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(length)])
    with np.errstate(over="ignore", invalid="ignore"):
        w = np.floor(SCALE * flat)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat) | ~np.isfinite(w))])
    rows = np.flatnonzero((length > 0) & (bad[start[1:]] == bad[start[:-1]]))
    return rows, [w[start[i] : start[i + 1]] for i in rows]


def postings(weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms' first posting, rows, weights) in term order; rows ascend within a term."""
    length = np.array([len(w) for w in weights], np.int64)
    flat = np.concatenate(weights) if weights else np.empty(0)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    row = np.repeat(np.arange(len(weights)), length)
    some = flat != 0
    term, row, flat = term[some], row[some], flat[some]
    order = np.argsort(term, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=int(length.max(initial=0))))])
    return first, row[order], flat[order]


def accumulate(queries: list[np.ndarray], candidates: list[np.ndarray]) -> np.ndarray:
    """Scores (queries x candidates), term at a time; whole numbers, as doubles where those are exact."""
    q_first, q_row, q_weight = postings(queries)
    c_first, c_row, c_weight = postings(candidates)
    terms = min(len(q_first), len(c_first)) - 1
    most = np.abs(q_weight).max(initial=0) * np.abs(c_weight).max(initial=0) * max(terms, 1)
    exact = most < 2**53
    kind = np.float64 if exact else object
    if not exact:
        q_weight, c_weight = (np.array([int(x) for x in w], object) for w in (q_weight, c_weight))
    out = np.zeros((len(queries), len(candidates)), kind)
    for t in range(terms):
        qs, cs = slice(q_first[t], q_first[t + 1]), slice(c_first[t], c_first[t + 1])
        rows, columns = q_row[qs], c_row[cs]
        if not len(rows) or not len(columns):
            continue
        product = np.multiply.outer(q_weight[qs], c_weight[cs])
        if len(rows) == len(queries) and len(columns) == len(candidates):
            out += product
        else:
            out[np.ix_(rows, columns)] += product
    return out


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties to the smaller column; sorted so."""
    n = scores.shape[1]
    if scores.dtype == object or n <= 4 * k or np.abs(scores).max(initial=0) >= 2**52 / n:
        order = np.argsort(-scores, axis=1, kind="stable")
        return order[:, :k]
    # score and column in one exact number: ties cannot happen
    rank = scores * n + np.arange(n - 1, -1, -1)
    part = np.argpartition(-rank, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(rank, part, axis=1), axis=1)
    return np.take_along_axis(part, order, axis=1)


def top_k(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query by inner product.

    Candidates are all rows but those with the query's own id; vectors of unequal length
    meet on the terms they share.  Rows that cannot take part (null id too) are left
    out; of rows that repeat an id, queries take the first by vector and candidates
    count once with their best score.  Scores beyond a long are held at its bounds.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector")).where("vec_id is not null")
    asked = slim.where(is_query)
    weights = asked.agg(F.sum(F.greatest(F.size("vector"), F.lit(1)).cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-weights // BLOCK_WEIGHTS))
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        table = own.toArrow()  # about BLOCK_WEIGHTS numbers
        if not table.num_rows:
            continue
        rows, weights = weights_of(table["vector"])
        if not len(rows):
            continue
        ids = table["vec_id"].to_numpy()[rows]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], weights[i].tolist()))
        once = [i for n, i in enumerate(order) if not n or ids[order[n - 1]] != ids[i]]
        length = np.array([len(weights[i]) for i in once], np.int64)
        shipped = spark.sparkContext.broadcast(pickle.dumps((ids[once], length, np.concatenate([weights[i] for i in once]))))

        def search(batches: Iterable[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            all_ids, length, flat = pickle.loads(shipped.value)
            all_queries = np.split(flat, np.cumsum(length)[:-1])
            strips = [(all_ids[a : a + STRIP], all_queries[a : a + STRIP]) for a in range(0, len(all_ids), STRIP)]
            best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for batch in batches:
                rows, weights = weights_of(batch.column(1))
                ids = batch.column(0).to_numpy()[rows]
                order = np.argsort(ids, kind="stable")
                for lo in range(0, len(order), BATCH):
                    part = order[lo : lo + BATCH]
                    candidates = [weights[i] for i in part]
                    names, first = np.unique(ids[part], return_index=True)
                    for query_ids, queries in strips:
                        scores = accumulate(queries, candidates)
                        # one column an id, of its highest score: copies take no places
                        if len(names) < len(part):
                            scores = np.maximum.reduceat(scores, first, axis=1)
                        # one more than k: the query's own row may be among them
                        own = np.isin(names, query_ids).any()
                        column = best_of(scores, min(k + int(own), len(names)))
                        query = np.repeat(np.arange(len(queries)), column.shape[1])
                        vec = names[column.ravel()]
                        keep = vec != query_ids[query]
                        value = np.take_along_axis(scores, column, axis=1).ravel()[keep]
                        best.append((query_ids[query[keep]], vec[keep], value))
                if sum(len(b[0]) for b in best) > 1 << 20:
                    best = [_merged(best, k)]
            if best:
                query, vec, value = _merged(best, k)
                bounded = np.array([max(-_LONG - 1, min(_LONG, int(v))) for v in value], np.int64) if value.dtype == object else value.astype(np.int64)
                yield pa.record_batch([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(bounded, pa.int64())], ["query_id", "vec_id", "score"])

        part = slim.mapInArrow(search, _RESULT)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct candidates of each query among parts."""
    query, vec = (np.concatenate([p[i] for p in parts]) for i in range(2))
    value = np.concatenate([p[2].astype(object) if any(q[2].dtype == object for q in parts) else p[2] for p in parts])
    if value.dtype == object:
        order = np.array(sorted(range(len(query)), key=lambda i: (query[i], -value[i], vec[i])), np.int64)
    else:
        order = np.lexsort((vec, -value, query))
    query, vec, value = query[order], vec[order], value[order]
    # a repeated id counts once: later repetitions of (query, vec) go
    _, first = np.unique(np.stack([query, vec]), axis=1, return_index=True)
    once = np.sort(first)
    query, vec, value = query[once], vec[once], value[once]
    start = np.append(True, query[1:] != query[:-1]) if len(query) else np.empty(0, bool)
    place = np.arange(len(query)) - np.flatnonzero(start)[np.cumsum(start) - 1]
    top = place < k
    return query[top], vec[top], value[top]
