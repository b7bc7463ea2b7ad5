"""A pivot index for cosine search: vectors lie in cells around pivots, and bounds on angles skip cells, exactly.

Pivots are fitted on a bounded sample (spherical k-means, at most ``SAMPLE`` vectors, on the
driver). Every vector goes to the cell of the pivot at the least angle; a cell knows its
least and greatest angle to its pivot. The angle on a sphere obeys the triangle
inequality, so all members of a cell are at least ``max(a - far, near - a)`` away from a
query at angle ``a`` from the pivot. A query first meets its nearest cells until they hold
``SEEDS`` times k rows (a view may show few of them); their k-th best cosine is a threshold, and of the
other cells only those are met whose bound reaches it, and only rows that reach it leave them. What is fitted on the sample decides how much is skipped, never
what is found.

Rows are read where they lie, some at a time, so that copies of one vector may fill a
cell of any size. Queries come in blocks of bounded bytes, each of which goes to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stash

SAMPLE, PIVOTS, ROUNDS, PART_BYTES = 8192, 1024, 4, 32 << 20
SEEDS = 10
#: Bytes of the queries that go to all tasks at once, and rows that meet them together.
BLOCK_BYTES, CHUNK = 128 << 20, 2048
#: Angles are off by less than this, scores by less than that.
ANGLE, SCORE = 1e-6, 2e-9


@dataclass(frozen=True)
class Cells:
    """``rows``: cell, key, vector and carried columns. ``pivots``: a row each; n, parts, near, far: by cell."""

    rows: DataFrame
    key: str
    pivots: np.ndarray
    n: np.ndarray
    parts: np.ndarray
    near: np.ndarray
    far: np.ndarray


def directions(column: pa.Array) -> np.ndarray:
    """Vectors of length one, in double precision; zero vectors are NaN."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.full_like(m, np.nan), where=size > 0)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def fit_pivots(sample: np.ndarray, many: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``many`` unit vectors near the vectors of ``sample``."""
    pivots = np.unique(sample, axis=0)
    pivots = pivots[np.random.default_rng(0).permutation(len(pivots))[:many]]
    for _ in range(rounds):
        own = np.argmax(sample @ pivots.T, axis=1)
        order = np.argsort(own, kind="stable")
        held, start = np.unique(own[order], return_index=True)
        sums = np.zeros_like(pivots)
        sums[held] = np.add.reduceat(sample[order], start)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), pivots)
    return pivots


def slim_rows(rows: DataFrame, vector: str, key: str, carry: tuple[str, ...]) -> DataFrame:
    """key, vector and carried columns, of rows whose vector is neither null nor zero: nothing is like those."""
    slim = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"), *carry)
    return slim.where(F.exists("vector", lambda c: c != 0))


def centres_of(slim: DataFrame, pivots: int | None = None, part_bytes: int = PART_BYTES) -> np.ndarray:
    """Pivots for rows (key, vector), fitted on a bounded sample; none without rows."""
    size = slim.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not size.n:
        return np.zeros((0, 1))
    many = pivots or int(min(PIVOTS, max(1, size.n * size.d * 4 // part_bytes, np.sqrt(size.n) / 2)))
    picked = slim.where(F.pmod(F.xxhash64("key"), F.lit(max(1, size.n))) < SAMPLE)  # about SAMPLE rows; sorting would carry as many vectors out of each task
    sample = picked.select("vector").limit(2 * SAMPLE).toArrow().column(0).combine_chunks()  # bounded
    if not len(sample):
        sample = slim.select("vector").limit(1).toArrow().column(0).combine_chunks()
    return fit_pivots(directions(sample), many)


def dealt(slim: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with their cell, the nearest pivot's number, and angle to it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            near = directions(some.column("vector")) @ centres.T
            cell = np.argmax(near, axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(angle), *some.columns], ["cell", "angle", *some.schema.names])

    return slim.mapInArrow(deal, f"cell int, angle double, {', '.join(f'`{c}` {t}' for c, t in slim.dtypes)}")


def cell_stats(rows: DataFrame) -> DataFrame:
    """cell, n, near, far: a row for each cell."""
    return rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"))


def cells_of(rows: DataFrame, key: str, centres: np.ndarray, stats: DataFrame, part_bytes: int = PART_BYTES) -> Cells:
    """Of dealt rows and their stats (more than one row a cell where they were dealt in several writes)."""
    told = {r.cell: r for r in stats.groupBy("cell").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far")).collect()}  # a row a pivot
    by = lambda f, empty: np.array([f(told[c]) if c in told else empty for c in range(len(centres))])
    n = by(lambda r: r.n, 0)
    parts = np.maximum(1, -(-n * centres.shape[1] * 8 // part_bytes)).astype(int)
    return Cells(rows, key, centres, n, parts, by(lambda r: r.near, 0.0), by(lambda r: r.far, 0.0))


def laid_out(rows: DataFrame) -> DataFrame:
    """Dealt rows, near ones together, ready to be written."""
    return rows.repartitionByRange("cell", "key").sortWithinPartitions("cell", "key")


def build_cells(rows: DataFrame, vector: str = "dense", key: str = "point_id", carry: tuple[str, ...] = (), pivots: int | None = None, part_bytes: int = PART_BYTES) -> Cells:
    """Deal rows (key, vector) into cells, in the shared folder."""
    slim = slim_rows(rows, vector, key, carry)
    centres = centres_of(slim, pivots, part_bytes)
    if not len(centres):
        return cells_of(slim.select(F.lit(0).alias("cell"), "*"), key, centres, slim.select(F.lit(0).alias("cell"), F.lit(0).alias("n"), F.lit(0.0).alias("near"), F.lit(0.0).alias("far")))
    kept = stash(dealt(slim, centres).sortWithinPartitions("cell"), "cells")  # a query skips runs of rows by their cell
    return cells_of(kept.drop("angle"), key, centres, cell_stats(kept), part_bytes)


def visits(cells: Cells, queries: DataFrame, k: int, first: bool) -> DataFrame:
    """query, cell, theta: the nearest cells that together hold ``SEEDS`` times k rows (theta: null); or the others that may hold one that reaches ``theta``."""
    kind, pivots, n, near, far = dict(queries.dtypes)["query"], cells.pivots, cells.n, cells.near, cells.far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for at in range(0, some.num_rows, 256):
                part = some.slice(at, 256)
                q = directions(part.column("vector"))
                if not len(pivots):
                    continue
                a = angles(np.nan_to_num(q), pivots)
                order = np.argsort(a, axis=1, kind="stable")
                enough = np.cumsum(n[order], axis=1) - n[order] < SEEDS * k  # the cells before hold fewer
                mine = np.zeros_like(enough)
                np.put_along_axis(mine, order, enough, axis=1)
                theta = pa.nulls(part.num_rows, pa.float64()) if first else part.column("theta")
                if not first:
                    reached = theta.to_numpy(zero_copy_only=False)[:, None]
                    least = np.maximum(0.0, np.maximum(a - far, near - a) - ANGLE)
                    mine = ~mine & (np.cos(np.minimum(least, np.pi)) + SCORE >= np.nan_to_num(reached.astype(float), nan=-2.0))
                mine &= (n > 0) & np.isfinite(q).all(axis=1)[:, None]
                who, cell = np.nonzero(mine)
                who = pa.array(who)
                yield pa.RecordBatch.from_arrays([part.column("query").take(who), pa.array(cell, pa.int32()), theta.take(who)], ["query", "cell", "theta"])

    return queries.mapInArrow(run, f"query {kind}, cell int, theta double")


@dataclass(frozen=True)
class Met:
    """``best``: query, key, score, rank. ``visits``: query, cell, of all cells that were met."""

    best: DataFrame
    visits: DataFrame


@dataclass(frozen=True)
class Block:
    """Some queries: names; directions, or places and values of the entries that are not zero, where these are few; whether each meets each cell; the least score that each asks for (NaN: any)."""

    names: pa.Array
    vectors: np.ndarray | list[tuple[np.ndarray, np.ndarray]]
    met: np.ndarray
    least: np.ndarray


def block_of(rows: pa.Table, cells: int) -> Block:
    """Of query, vector, cells (a list) and least."""
    rows = rows.combine_chunks()
    names, vectors, listed = (rows.column(c).combine_chunks() for c in ("query", "vector", "cells"))
    met = np.zeros((len(names), cells), bool)
    met[pc.list_parent_indices(listed).to_numpy(), listed.flatten().to_numpy()] = True
    far = directions(vectors)
    least = rows.column("least").to_numpy().astype(float)
    if np.count_nonzero(far) * 16 > far.size:
        return Block(names, far, met, least)
    return Block(names, [(at, v[at]) for v in far for at in [np.flatnonzero(v)]], met, least)


class Best:
    """The best ``k`` rows of each query of a block among those that it was shown; ties go to the smaller key."""

    def __init__(self, block: Block, k: int, limit: int = 1 << 19) -> None:
        self.k, self.limit = k, max(limit, 2 * k * len(block.names))
        self.least = np.nan_to_num(block.least, nan=-np.inf)  # grows to the score of the k-th
        self.held: list[pa.Table] = []
        self.size = 0

    def add(self, who: np.ndarray, key: pa.Array, score: np.ndarray) -> None:
        self.held.append(pa.table({"who": pa.array(who, pa.int32()), "key": key, "score": score}))
        self.size += len(who)
        if self.size > self.limit:
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.held:
            return None
        rows = pa.concat_tables(self.held).sort_by([("who", "ascending"), ("score", "descending"), ("key", "ascending")])
        who = rows.column("who").to_numpy()
        place = np.arange(len(who)) - np.searchsorted(who, who)
        last = place == self.k - 1
        self.least[who[last]] = np.maximum(self.least[who[last]], rows.column("score").to_numpy()[last])
        self.held = [rows.filter(pa.array(place < self.k))]
        self.size = self.held[0].num_rows
        return self.held[0]


def reached(score: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded value of each row's best ``k`` entries that reach ``least``; ties go to the left."""
    hits = score >= (least - SCORE)[:, None]
    many = np.flatnonzero(np.count_nonzero(hits, axis=1) > 4 * k)
    if len(many):
        some = score[many]
        hits[many] &= some >= np.partition(some, -k, axis=1)[:, [-k]] - SCORE
    n, hit = np.nonzero(hits)
    value = np.round(score[n, hit], 9) + 0.0
    good = value >= least[n]
    n, hit, value = n[good], hit[good], value[good]
    order = np.lexsort((hit, -value, n))
    order = order[np.arange(len(n)) - np.searchsorted(n, n) < k]  # rows stay in order
    return n[order], hit[order], value[order]


def scan(rows: DataFrame, held: Broadcast[Block], k: int, kind: str) -> DataFrame:
    """query, key, score: for each query of a block the best ``k`` rows of each task, among rows (cell, key, vector) of the cells that it meets, and perhaps of others.

    Rows are read where they lie, and only what is found is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        best, few = Best(block, k), isinstance(block.vectors, list)
        room = np.empty(max((len(at) for at, _ in block.vectors), default=0) * CHUNK if few else 0)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                some = batch.slice(start, CHUNK)
                who = np.flatnonzero(block.met[:, np.unique(some.column("cell").to_numpy())].any(axis=1))
                if not len(who):
                    continue
                some = some.take(pc.sort_indices(some.column("key")))  # so that ties go to the smaller key
                vectors = np.ascontiguousarray(directions(some.column("vector")).T)
                for i in range(0, len(who), 256):
                    part = who[i : i + 256]
                    if few:
                        score = np.empty((len(part), some.num_rows))
                        for to, q in zip(score, part, strict=True):
                            at, values = block.vectors[q]
                            mine = room[: len(at) * some.num_rows].reshape(len(at), -1)
                            np.dot(values, np.take(vectors, at, axis=0, out=mine, mode="clip"), out=to)
                    else:
                        score = block.vectors[part] @ vectors
                    n, hit, value = reached(score, best.least[part], k)
                    if len(n):
                        best.add(part[n], some.column("key").take(pa.array(hit)), value)
        found = best.cut()
        if found is not None:
            names = block.names.take(found.column("who").combine_chunks())
            yield from pa.table({"query": names, "key": found.column("key"), "score": found.column("score")}).combine_chunks().to_batches()

    return rows.select("cell", "key", "vector").mapInArrow(run, f"query {kind}, key {dict(rows.dtypes)['key']}, score double")


def dense_topk_cells(cells: Cells, queries: DataFrame, k: int = 10, view: Callable[[DataFrame], DataFrame] | None = None, floor: DataFrame | None = None, block: int | None = None, least: float | None = None) -> Met:
    """The best ``k`` rows of every query (query, vector), as scoring all rows would give them. ``view`` filters rows by carried
    columns. ``floor`` (query, floor): rows that score less are not asked for, which skips more; nor are rows that do not score more than ``least``.

    Queries are taken in blocks of ``BLOCK_BYTES`` at most, one after the other: a block goes to all tasks, and
    these read the rows twice, first those of the nearest cells. So neither rows nor queries are ever shuffled with their vectors.
    """
    rows = cells.rows if view is None else view(cells.rows)
    asked = queries.where(F.col("vector").isNotNull()).select("query", "vector")
    bars = [F.lit(None).cast("double") if least is None else F.lit((math.floor(least * 1e9) + 1) / 1e9)]  # scores have nine decimals
    if floor is not None:
        asked, bars = asked.join(floor.select("query", "floor"), "query", "left"), [*bars, F.col("floor")]
    asked = stash(asked.select("query", "vector", F.greatest(*bars, *bars).alias("bar")), "asked")
    kinds, spark = f"query {dict(asked.dtypes)['query']}, key {dict(rows.dtypes)['key']}, score double, rank int", rows.sparkSession
    none = spark.createDataFrame([], kinds)
    blocks = -(-asked.count() // (block or max(1, BLOCK_BYTES // (8 * cells.pivots.shape[1]))))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    best, met = none, spark.createDataFrame([], f"query {dict(asked.dtypes)['query']}, cell int")

    def meet(some: DataFrame, who: DataFrame) -> DataFrame:
        """The best rows of ``some`` queries (query, vector, least) in the cells that they meet, and perhaps in others."""
        listed = who.groupBy("query").agg(F.collect_list("cell").alias("cells"))
        told = some.join(listed, "query").select("query", "vector", "cells", F.col("bar").alias("least")).toArrow()
        if not told.num_rows:
            return none
        mine = block_of(told, len(cells.n))
        here = np.flatnonzero(mine.met.any(axis=0))
        near = rows.where(F.col("cell").isin(here.tolist())) if 2 * len(here) < len(cells.n) else rows
        held = spark.sparkContext.broadcast(mine)  # of bounded bytes
        found = scan(near, held, k, dict(asked.dtypes)["query"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = stash(found, "best")
        held.destroy()
        return found

    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        first = stash(visits(cells, some, k, True), "visits").select("query", "cell")
        theta = meet(some, first).where(F.col("rank") == k).select("query", F.col("score").alias("theta"))
        some = stash(some.join(theta, "query", "left").select("query", "vector", F.greatest("bar", "theta").alias("bar")), "asked")
        more = stash(visits(cells, some.withColumnRenamed("bar", "theta"), k, False), "visits").select("query", "cell")
        best, met = best.unionByName(meet(some, first.unionByName(more))), met.unionByName(first).unionByName(more)
    return Met(best.withColumnRenamed("key", cells.key), met)
