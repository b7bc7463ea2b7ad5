"""A stored inverted index: for every term, in blocks, the rows that have it and with what weight.

Rows are dealt by a hash of their key into slices of bounded size, and numbered inside
them. A block holds a term's rows of one slice, in ascending order, with its smallest and
greatest weight; so the list of a term that every row has is cut into pieces of bounded
size, and lists meet slice by slice. Blocks are laid out by bucket, term and slice, so that
a lookup reads the few pages of its terms. Rows keep their slice and number, laid out by
slice, so that hits are fetched without reading the other rows' pages.

The same structure holds the tokens of texts (:func:`holding`: all of some tokens) and the
entries of sparse vectors (:func:`sparse_topk_pruned`: the best rows of many queries, exactly).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.storage import passing, stash, without_leftovers

#: Rows of a slice, folders that blocks are dealt into, and slices that a fetch names one by one.
SLICE, BUCKETS, NAMED = 16_384, 64, 1000
#: Rows of a slice that go to a task together when entries are made.
SPREAD = 256
#: Queries that are answered together: they meet a slice in one task.
QUERIES = 16_384
PLACE = ["slice", "local"]
#: Sums in another order may differ by this share.
SLACK = 1e-9


@dataclass(frozen=True)
class Postings:
    """``entries``: slice, local and the rows' columns; ``blocks``: term, slice, n, low, top, locals, weights."""

    entries: DataFrame
    blocks: DataFrame


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term.cast("string")), F.lit(BUCKETS)).cast("int")


def sliced(rows: DataFrame, key: str = "point_id", name: str = "", size: int = SLICE) -> DataFrame:
    """``rows`` with slice and local. ``name`` keeps slices of several writes apart; keys are distinct."""
    slices = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("slice", F.concat(F.lit(name + "-"), F.lpad(F.pmod(F.xxhash64(key), F.lit(slices)).cast("string"), 9, "0")))
    return dealt.withColumn("local", F.row_number().over(Window.partitionBy("slice").orderBy(key)) - 1)


def spread(rows: DataFrame, size: int = SPREAD) -> DataFrame:
    """Sliced rows, dealt to many tasks by pieces of a slice: there are fewer slices than tasks, or not evenly as many."""
    many = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(many, "slice", F.floor(F.col("local") / size)).sortWithinPartitions(*PLACE)


def text_terms(text: Column) -> Column:
    """The tokens of a text as terms, of weight one."""
    return F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(1.0).cast("float").alias("weight")))


def sparse_terms(vector: Column) -> Column:
    return F.arrays_zip(vector["indices"].alias("term"), vector["values"].alias("weight"))


def blocks_of(entries: DataFrame, terms: Column) -> DataFrame:
    """The blocks of ``terms``, an array of (term, weight) for each row. Rows go to their slice before their terms are listed, which take twice the bytes."""
    listed = entries.repartition("slice").sortWithinPartitions(*PLACE).select(*PLACE, terms.alias("terms"))
    kind = dict(listed.select(F.explode("terms").alias("t")).select("t.term", "t.weight").dtypes)

    def gather(rows: pa.Table) -> pa.Table:
        rows = rows.select(["slice", "local", "terms"]).sort_by("local").combine_chunks()
        lists = rows.column("terms").combine_chunks()
        flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        held = flat.field("term").dictionary_encode()
        local, weight = rows.column("local").to_numpy()[parent.to_numpy()], flat.field("weight").to_numpy(zero_copy_only=False)
        code = held.indices.to_numpy()
        small = code.astype(np.uint16) if len(held.dictionary) <= 1 << 16 else code  # short numbers are sorted by digits
        order = np.argsort(small, kind="stable")  # rows lie by local
        if ((local[order][1:] == local[order][:-1]) & (code[order][1:] == code[order][:-1])).any():  # a row has a term twice
            order = np.lexsort((weight, local, code))
        local, weight = local[order], weight[order]
        n = np.bincount(code, minlength=len(held.dictionary))
        start = np.cumsum(n) - n
        ends = pa.array(np.append(start, len(code)), pa.int32())
        low, top = (np.asarray(f.reduceat(weight, start)) if len(start) else weight for f in (np.minimum, np.maximum))
        whole = [held.dictionary, pa.repeat(rows.column("slice")[0], len(start)), pa.array(n, pa.int32()), pa.array(low), pa.array(top)]
        return pa.table([*whole, pa.ListArray.from_arrays(ends, pa.array(local)), pa.ListArray.from_arrays(ends, pa.array(weight))], ["term", "slice", "n", "low", "top", "locals", "weights"])

    return listed.groupBy("slice").applyInArrow(gather, f"term {kind['term']}, slice string, n int, low {kind['weight']}, top {kind['weight']}, locals array<int>, weights array<{kind['weight']}>")


def write_blocks(blocks: DataFrame, path: str, **parts: str) -> None:
    """Append blocks to a table. They are dealt by bucket and a hash of the slice, so that a common term's blocks go to several tasks;
    ranges would have to be found by making all blocks once before."""
    many = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = F.pmod(F.xxhash64("slice"), F.lit(max(4, -(-many // 16))))
    own = blocks.withColumn("bucket", bucket(F.col("term"))).repartition(many, "bucket", share).sortWithinPartitions("bucket", "term", "slice")
    for name, value in parts.items():
        own = own.withColumn(name, F.lit(value))
    with without_leftovers(blocks.sparkSession):
        own.write.partitionBy(*parts, "bucket").mode("append").option("compression", "zstd").parquet(path)


def fetch(entries: DataFrame, hits: DataFrame, named: int = NAMED) -> DataFrame:
    """The rows of ``hits`` (slice, local and further columns), with those columns.

    Where hits lie in few slices, these are named, so that the reader skips all other pages;
    hits in more slices are joined with all rows, of which little could be skipped.
    """
    few = hits.select("slice").distinct().limit(named + 1).collect()  # bounded
    if len(few) <= named:
        entries = entries.where(F.col("slice").isin([r.slice for r in few]))
    return entries.join(hits, PLACE)


def holding(index: Postings, queries: DataFrame) -> DataFrame:
    """query, slice, local: the rows that hold all tokens of each query (query, tokens). No tokens: no rows.

    Slice by slice the lists of a query's tokens are intersected, shortest first; nothing longer
    than a slice meets anywhere.
    """
    wanted = queries.select("query", F.size("tokens").alias("many"), F.explode("tokens").alias("term")).withColumn("bucket", bucket(F.col("term")))
    lists = wanted.join(index.blocks.select("term", "slice", "n", "locals", *([c] if (c := "bucket") in index.blocks.columns else [])), ["term", "bucket"] if "bucket" in index.blocks.columns else ["term"])
    met = lists.groupBy("query", "slice", "many").agg(F.sort_array(F.collect_list(F.struct("n", "locals"))).alias("p")).where(F.size("p") == F.col("many"))
    both = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.col("p")[0]["locals"], lambda s, p: F.array_intersect(s, p["locals"]))
    return met.select("query", "slice", F.explode(both).alias("local"))


def count_holding(index: Postings, queries: DataFrame, seen: DataFrame) -> DataFrame:
    """query, hits: how many of the rows that ``seen`` has (entries, or a view of them) hold all tokens of each query (query, tokens); those that none holds have no row.

    As fetching and counting what :func:`holding` finds, but a slice's lists go to one task once, whatever the number of queries, and
    only counts leave it. Equal questions are asked once, ``QUERIES`` of them at a time.
    """
    asked = stash(queries.where(F.size("tokens") > 0).select("query", F.array_sort(F.array_distinct("tokens")).alias("tokens")), "asked")
    sets = stash(asked.select("tokens").distinct(), "sets")
    blocks = -(-sets.count() // QUERIES)
    found = [stash(counts_of_slices(index, seen, sets.where(F.pmod(F.xxhash64("tokens"), F.lit(blocks)) == b)), "counts") for b in range(blocks)]
    if not found:
        return asked.select("query", F.lit(0).cast("long").alias("hits")).limit(0)
    return asked.join(reduce(DataFrame.unionByName, found), "tokens").select("query", "hits")


def counts_of_slices(index: Postings, seen: DataFrame, sets: DataFrame) -> DataFrame:
    """tokens, hits: of a bounded number of sets of tokens (tokens)."""
    names = index.blocks.columns
    by = ["term", "bucket"] if "bucket" in names else ["term"]
    wanted = sets.select(F.explode("tokens").alias("term")).distinct().withColumn("bucket", bucket(F.col("term"))).select(*by)
    # the rows that are seen come as a list without a term
    rows = seen.groupBy("slice").agg(F.sort_array(F.collect_list("local")).alias("locals")).select(F.lit(None).cast("string").alias("term"), "slice", "locals")
    lists = index.blocks.join(F.broadcast(wanted), by, "left_semi").select("term", "slice", "locals").unionByName(rows)
    asked = [r.tokens for r in sets.collect()]  # QUERIES at most

    def count(lists: pa.Table) -> pa.Table:
        held = {t: np.asarray(at.values) for t, at in zip(lists.column("term").to_pylist(), lists.column("locals"), strict=True)}
        size = 64 * -(-(1 + max(int(at[-1]) for at in held.values())) // 64)

        def bits(at: np.ndarray) -> np.ndarray:
            out = np.zeros(size, bool)
            out[at] = True
            return np.packbits(out).view(np.uint64)

        shown = bits(held.pop(None, np.zeros(0, np.int32)))
        held = {t: bits(at) for t, at in held.items()}
        n = [np.bitwise_count(reduce(np.bitwise_and, [held[t] for t in a], shown)).sum() if all(t in held for t in a) else 0 for a in asked]
        some = [i for i, m in enumerate(n) if m]
        return pa.table({"tokens": pa.array([asked[i] for i in some], pa.list_(pa.string())), "n": pa.array([n[i] for i in some], pa.int64())})

    return lists.groupBy("slice").applyInArrow(count, "tokens array<string>, n long").groupBy("tokens").agg(F.sum("n").alias("hits"))


def holding_all(index: Postings, wanted: list[str]) -> DataFrame:
    """slice, local: the rows that hold all of a few tokens, which are named to the reader."""
    wanted = sorted(set(wanted))
    some = index.blocks.where(F.col("term").isin(wanted))
    if "bucket" in some.columns:
        places = some.sparkSession.createDataFrame([(w,) for w in wanted] or [("",)], "term string").select(bucket(F.col("term"))).collect()
        some = some.where(F.col("bucket").isin([r[0] for r in places]))
    asked = some.sparkSession.createDataFrame([(0, wanted)], "query int, tokens array<string>")
    return holding(Postings(index.entries, some), asked).select(*PLACE)


def best_of_slices(index: Postings, seen: DataFrame, asked: DataFrame, pairs: DataFrame, k: int, blocks: int = 1, key: str = "point_id") -> DataFrame:
    """query, key, score: the best ``k`` rows of each pair of a query and a slice (query, slice, ~low) that ``seen`` has and
    that score ``~low`` at least (null: any), ties by local. A slice's lists meet a block of queries in one task; each block gets its own copy of them.

    What is broadcast is bounded by the number of queries, or a row a slice.
    """
    kinds, term, named = dict(asked.dtypes), dict(index.blocks.dtypes)["term"], dict(seen.dtypes)[key]
    wanted = asked.select(F.explode(F.col("sparse")["indices"]).alias("term")).distinct()
    # the rows that are seen come as a list without a term
    shown = F.sort_array(F.collect_list(F.struct("local", F.col(key).alias("key"))))
    rows = seen.groupBy("slice").agg(shown.alias("s")).select(F.lit(None).cast(term).alias("term"), "slice", F.col("s.local").alias("locals"), F.lit(None).cast(dict(index.blocks.dtypes)["weights"]).alias("weights"), F.col("s.key").alias("keys"))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")
    met = pairs.join(F.broadcast(asked), "query").select("slice", block, "query", F.col("sparse")["indices"].alias("indices"), F.col("sparse")["values"].alias("values"), "~low")
    lists = index.blocks.join(F.broadcast(wanted), "term", "left_semi").select("term", "slice", "locals", "weights", F.lit(None).cast(f"array<{named}>").alias("keys")).unionByName(rows)
    lists = lists.join(F.broadcast(pairs.select("slice", block).distinct()), "slice").select(*(F.col(c).alias(c) for c in ("term", "slice", "block", "locals", "weights", "keys")))

    def best(lists: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        terms, held = lists.column("term").to_pylist(), {}
        shown, keys = np.zeros(0, np.int64), pa.array([], lists.schema.field("keys").type.value_type)
        for i, t in enumerate(terms if queries.num_rows else []):
            at = lists.column("locals")[i].values.to_numpy().astype(np.int64)
            if t is None:
                shown, keys = at, lists.column("keys")[i].values
            else:
                held[t] = at, lists.column("weights")[i].values.to_numpy(zero_copy_only=False).astype(np.float64)
        size = 1 + max([int(at[-1]) for at, _ in held.values()] + [int(shown[-1]) if len(shown) else -1])
        visible = np.zeros(size, bool)
        visible[shown] = True
        lows = queries.column("~low").to_numpy(zero_copy_only=False).astype(float)
        for i in range(queries.num_rows):
            mine = [(held[t], w) for t, w in zip(queries.column("indices")[i].as_py(), queries.column("values")[i].as_py(), strict=True) if t in held]
            if not mine:
                continue
            at = np.concatenate([a for (a, _), _ in mine])
            score = np.bincount(at, np.concatenate([v * w for (_, v), w in mine]), size)  # in the order of the query's terms
            hit = visible & (np.bincount(at, minlength=size) > 0)
            if not np.isnan(lows[i]):
                hit &= score >= lows[i]
            rows = np.flatnonzero(hit)
            s = score[rows]
            if len(s) > k:
                near = s >= np.partition(s, -k)[-k]
                rows, s = rows[near], s[near]
            top = np.argsort(-s, kind="stable")[:k]
            found.append((np.full(len(top), i), rows[top], s[top]))
        i, rows, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([queries.column("query").take(pa.array(i)), keys.take(pa.array(np.searchsorted(shown, rows))), pa.array(s, pa.float64())], ["query", key, "score"])

    return lists.groupBy("slice", "block").cogroup(met.groupBy("slice", "block")).applyInArrow(best, f"query {kinds['query']}, `{key}` {named}, score double")


@dataclass(frozen=True)
class Pruned:
    """``best``: query, key, score, rank. ``terms``: query, term, df, theta, essential; a term that is not essential is not read for candidates."""

    best: DataFrame
    terms: DataFrame


def sparse_topk_pruned(
    index: Postings,
    queries: DataFrame,
    k: int = 10,
    key: str = "point_id",
    vector: str = "sparse",
    view: Callable[[DataFrame], DataFrame] | None = None,
    floor: DataFrame | None = None,
    seeds: int | None = None,
) -> Pruned:
    """The best ``k`` rows of each sparse query (query, sparse) by dot product, ties by key, with bounds that skip what cannot be among them.

    1. The slices with some rows of each query's rarest terms, about ``seeds`` (ten times k), are scored in full: the
       k-th best score is a threshold. Fewer than k give none, and nothing is skipped.
    2. A query's most common terms are set aside as long as all of them together stay
       below the threshold (max-score): a row that has no other term of it cannot reach
       the threshold, so slices without the other terms are skipped.
    3. So are all slices whose greatest weights stay below the threshold even together (block-max).
    4. In the others the lists of a query's terms are summed up slice by slice (:func:`best_of_slices`),
       and only the best ``k`` rows of a slice leave it.

    Results are those of scoring everything, for weights of any sign. ``view`` filters
    rows (a function of a DataFrame of entries) before anything is ranked. ``floor`` (query,
    floor): rows that score less are not asked for, which skips more; those from there on
    have the ranks that they have among all.
    """
    seen, seeds = index.entries if view is None else view(index.entries), 10 * k if seeds is None else seeds
    asked = stash(queries.where(F.size(F.col("sparse")["indices"]) > 0).select("query", "sparse"), "asked")
    blocks = max(1, -(-asked.count() // QUERIES))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    found = [pruned_block(index, seen, asked.where(block == b), k, key, floor, seeds) for b in range(blocks)]  # one after the other: each leaves its results alone
    return Pruned(reduce(DataFrame.unionByName, (f.best for f in found)), reduce(DataFrame.unionByName, (f.terms for f in found)))


def pruned_block(index: Postings, seen: DataFrame, asked: DataFrame, k: int, key: str, floor: DataFrame | None, seeds: int) -> Pruned:
    """:func:`sparse_topk_pruned` of a bounded number of queries."""
    entries_of = asked.select("query", F.inline(sparse_terms(F.col("sparse")))).withColumnRenamed("weight", "w")
    weight = F.col("w").cast("double")
    bound = F.greatest(weight * F.col("top").cast("double"), weight * F.col("low").cast("double"), F.lit(0.0))
    with passing(index.blocks.select("term", "slice", "n", "low", "top").join(entries_of, "term").select("query", "term", "w", "slice", "n", bound.alias("bound")), "met") as met:
        # which rows to score first: the rarest terms' up to `seeds`; of the one that goes beyond, a share of its slices
        df = met.groupBy("query", "term", "w").agg(F.sum("n").alias("df"), F.max("bound").alias("most"))
        rare = Window.partitionBy("query").orderBy("df", "term")  # as many rows as the query has terms
        before = F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = stash(df.withColumn("before", before), "df")
        share = (F.lit(seeds) - F.col("before")) / F.col("df")
        chosen = counted.where(F.col("before") < seeds).select("query", "term", share.alias("share"))
        lot = F.pmod(F.xxhash64("slice"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        picked = met.join(chosen, ["query", "term"]).withColumn("first", F.min(F.struct(lot.alias("lot"), "slice")).over(Window.partitionBy("query", "term"))["slice"])
        picked = picked.where((lot < F.col("share")) | (F.col("slice") == F.col("first"))).select("query", "term", "slice")
        order = Window.partitionBy("query").orderBy(F.desc("score"), key)
        ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        first = stash(picked.select("query", "slice").distinct(), "first")
        begun = stash(ranked(best_of_slices(index, seen, asked, first.withColumn("~low", F.lit(None).cast("double")), k, key=key)), "begun")
        theta = begun.where(F.col("rank") == k).select("query", F.col("score").alias("theta"))
        if floor is not None:
            theta = theta.unionByName(floor.select("query", F.col("floor").alias("theta"))).groupBy("query").agg(F.max("theta").alias("theta"))

        low = F.col("theta") - F.abs("theta") * SLACK - SLACK
        common = Window.partitionBy("query").orderBy(F.desc("df"), "term")
        upto = F.sum("most").over(common.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        told = counted.join(theta, "query", "left").withColumn("essential", F.coalesce(upto >= low, F.lit(True)))
        rest = F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("most"))).over(Window.partitionBy("query"))
        told = stash(told.select("query", "term", "w", "df", "theta", low.alias("~low"), "essential", rest.alias("rest")), "terms")

        lows = told.groupBy("query").agg(F.first("~low").alias("~low"))
        kept = met.groupBy("query", "slice").agg(F.sum("bound").alias("~bound")).join(lows, "query").where(F.col("~low").isNull() | (F.col("~bound") >= F.col("~low"))).select("query", "slice")
        more = stash(kept.join(first, ["query", "slice"], "left_anti").join(lows, "query"), "kept")
    best = begun.drop("rank").unionByName(best_of_slices(index, seen, asked, more, k, key=key))
    return Pruned(stash(ranked(best), "best"), told.select("query", "term", "df", "theta", "essential"))
