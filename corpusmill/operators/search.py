"""Hybrid search: dense cosine and sparse dot product, each cut to its best, fused by reciprocal rank.

Ties go to the smaller id. Ranks are taken after the cut, over as many rows as the
limit; nothing larger meets in one task. Cosines are rounded to nine decimals, so that
ties do not hang on the order of a sum.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine


def numbers(values: Iterable[float], kind: str = "double") -> Column:
    """A constant array, as one literal: an array of a thousand literals is slow to plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def dense_topk(rows: DataFrame, query: list[float], k: int = 10, vector: str = "dense", key: str = "point_id") -> DataFrame:
    """key, score: the ``k`` rows of highest cosine similarity. Rows with a null or zero vector have none."""
    q = numbers(map(float, query))
    scored = rows.select(key, F.round(cosine(F.col(vector), q), 9).alias("score"))
    return scored.orderBy(F.desc_nulls_last("score"), key).limit(k).where("score IS NOT NULL")  # a filter before would compute scores twice


def sparse_scores(rows: DataFrame, query: dict[int, float], vector: str = "sparse", key: str = "point_id") -> DataFrame:
    """key, score: the dot product of every row that shares an index with the query. No shuffle."""
    if not query:
        return rows.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    weights = F.map_from_arrays(numbers(map(int, query), "int"), numbers(map(float, query.values())))
    pairs = F.arrays_zip(F.col(vector)["indices"].alias("indices"), F.col(vector)["values"].alias("values"))
    shared = F.filter(pairs, lambda p: F.map_contains_key(weights, p["indices"]))
    score = F.aggregate(shared, F.lit(0.0), lambda s, p: s + F.try_element_at(weights, p["indices"]) * p["values"].cast("double"))
    return rows.where(F.size(shared) > 0).select(key, score.alias("score"))


def sparse_topk(rows: DataFrame, query: dict[int, float], k: int = 10, vector: str = "sparse", key: str = "point_id") -> DataFrame:
    return sparse_scores(rows, query, vector, key).orderBy(F.desc("score"), key).limit(k)


def postings(rows: DataFrame, vector: str = "sparse", key: str = "point_id") -> DataFrame:
    """key, index, weight: a row for each entry of the sparse vectors, to be stored and joined by index."""
    pairs = F.arrays_zip(F.col(vector)["indices"].alias("index"), F.col(vector)["values"].alias("weight"))
    return rows.select(key, F.inline(pairs))


def ranked(best: DataFrame, key: str = "point_id") -> DataFrame:
    """``best`` (limit rows) with its rank."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fuse(arms: list[DataFrame], k: int = 60, limit: int = 10, key: str = "point_id") -> DataFrame:
    """key, score: the sum of 1 / (k + rank) over the arms, cut to ``limit``."""
    both = None
    for arm in arms:
        part = ranked(arm, key).select(key, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(key).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), key).limit(limit)


def hybrid(rows: DataFrame, dense: list[float], sparse: dict[int, float], limit: int = 10, k: int = 60, where: Column | None = None, key: str = "point_id") -> tuple[DataFrame, DataFrame]:
    """Results, best first, with the columns of ``rows``; and one row of hit counts.

    ``rows`` is the visible view, or a verification view; the filter holds for both
    arms. An empty view gives no results and zeros.
    """
    seen = rows if where is None else rows.where(where)
    arms = [dense_topk(seen, dense, limit, key=key), sparse_topk(seen, sparse, limit, key=key)]
    fused = fuse(arms, k, limit, key)
    found = seen.join(F.broadcast(fused), key).orderBy(F.desc("score"), key)  # limit rows
    return found, hit_counts(*arms, found)


def hybrid_batch(rows: DataFrame, queries: DataFrame, limit: int = 10, k: int = 60, key: str = "point_id", least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """As :func:`hybrid` for all queries (query, dense, sparse) together: query, key, score, rank; and
    query, dense_hits, sparse_hits of those that have any.

    The dense arm gives the nearest rows however far, unless their cosine must be above ``least``.
    """
    dense = dense_topk_batch(rows, queries.select("query", F.col("dense").alias("vector")), limit, key=key)
    dense = dense if least is None else dense.where(F.col("score") > least)
    return fuse_batch(dense, sparse_topk_batch(rows, queries, limit, key=key), limit, k, key)


def fuse_batch(dense: DataFrame, sparse: DataFrame, limit: int = 10, k: int = 60, key: str = "point_id") -> tuple[DataFrame, DataFrame]:
    """Both arms (query, key, rank) of all queries, fused: query, key, score, rank; and query, dense_hits, sparse_hits."""
    both = dense.select("query", key, F.col("rank").alias("~d")).join(sparse.select("query", key, F.col("rank").alias("~s")), ["query", key], "full")
    part = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)  # 2 * limit rows a query
    fused = both.select("query", key, (part("~d") + part("~s")).alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    counts = both.groupBy("query").agg(F.count("~d").alias("dense_hits"), F.count("~s").alias("sparse_hits"))
    return fused, counts


def hit_counts(dense: DataFrame, sparse: DataFrame, found: DataFrame) -> DataFrame:
    citationable = (F.length("text") > 0) & (F.length("document_path") > 0)
    n = found.agg(F.count("*").alias("candidate_count"), F.count_if(citationable).alias("citationable_count"))
    return dense.agg(F.count("*").alias("dense_hits")).crossJoin(sparse.agg(F.count("*").alias("sparse_hits"))).crossJoin(n)  # one row each


def passes_gate(candidates: int = 1, dense: int = 1, sparse: int = 1, citationable: int = 1) -> Column:
    """Whether a row of hit counts is enough to answer from."""
    return (F.col("candidate_count") >= candidates) & ((F.col("dense_hits") >= dense) | (F.col("sparse_hits") >= sparse)) & (F.col("citationable_count") >= citationable)


def unit(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of length one; a vector of zeros becomes NaN."""
    column = column.combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.full_like(m, np.nan), where=size > 0)


#: Bytes of the vectors that meet in one task.
PART_BYTES = 32 << 20


def grid(left: DataFrame, right: DataFrame, keys: list[str], k: int) -> DataFrame:
    """query, key, score: rows (keys, key, vector) and queries (keys, query, vector) that have the same ``keys``
    meet as one matrix product, and each keeps a query's best ``k`` (where queries have a ``theta``, of those that reach it). Ties go to the smaller key."""
    types = dict(left.dtypes)["key"], dict(right.dtypes)["query"]

    def best(members: pa.Table, wanted: pa.Table) -> pa.Table:
        if not members.num_rows or not wanted.num_rows:
            return pa.table({"query": wanted.column("query").slice(0, 0), "key": members.column("key").slice(0, 0), "score": pa.array([], pa.float64())})
        members = members.sort_by("key")  # so that ties go to the smaller key
        vectors = unit(members.column("vector"))
        least = wanted.column("theta").to_numpy().astype(float) if "theta" in wanted.column_names else np.full(wanted.num_rows, np.nan)
        least, found = np.nan_to_num(least, nan=-np.inf), []
        for at in range(0, wanted.num_rows, 256):
            some = np.round(unit(wanted.column("vector").slice(at, 256)) @ vectors.T, 9) + 0.0
            np.nan_to_num(some, copy=False, nan=-np.inf)
            low = least[at : at + 256]
            if some.shape[1] > k:
                low = np.maximum(low, np.partition(some, -k, axis=1)[:, -k])
            who, hit = np.nonzero((some >= low[:, None]) & np.isfinite(some))
            score = some[who, hit]
            order = np.lexsort((hit, -score, who))
            who, hit, score = who[order], hit[order], score[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)  # among the hits of a query
            found.append((at + who[place < k], hit[place < k], score[place < k]))
        who, hit, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query": wanted.column("query").take(pa.array(who)), "key": members.column("key").take(pa.array(hit)), "score": pa.array(score)})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"query {types[1]}, key {types[0]}, score double")


def dense_topk_batch(rows: DataFrame, queries: DataFrame, k: int = 10, vector: str = "dense", key: str = "point_id", block: int = 4096, part_bytes: int = PART_BYTES) -> DataFrame:
    """query, key, score, rank: the best ``k`` rows of every query (query, vector), by cosine similarity.

    A grid, for rows without an index (:mod:`.cells` has one): rows are dealt into parts of
    about ``part_bytes`` and queries into blocks of about ``block``, and each part meets each
    block as one matrix product. A part keeps its own best ``k`` for a query before
    anything more is shuffled. Rows and queries with a null or zero vector have no result.
    """
    slim = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    entries = slim.agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0
    parts = max(1, -(-entries * 8 // part_bytes))
    asked = queries.where(F.col("vector").isNotNull()).select("query", "vector")
    blocks = max(1, -(-asked.count() // block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = slim.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).withColumn("block", each(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("part", each(parts))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return grid(left, right, ["part", "block"], k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("key", key)


def sparse_topk_batch(rows: DataFrame, queries: DataFrame, k: int = 10, vector: str = "sparse", key: str = "point_id") -> DataFrame:
    """query, key, rank, score: as above for sparse queries (query, sparse), by a join on the index.

    Only indices that queries have are kept before the join; scores are summed before they are ranked.
    """
    asked = postings(queries, "sparse", "query").select("query", F.col("index").alias("~i"), F.col("weight").alias("~w"))
    pairs = postings(rows, vector, key).join(asked, F.col("index") == F.col("~i"))
    scored = pairs.groupBy("query", key).agg(F.sum(F.col("weight").cast("double") * F.col("~w").cast("double")).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
