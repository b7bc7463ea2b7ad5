"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: all sources share ``share`` times the size of everything by weight; none
gets more than ``cap`` times its own size, and what it cannot take goes to the
others by weight. A source's whole epochs come first. For the rest of its target,
every document draws the exponential key ``-ln(u) / quality`` from a hash of its
id, keys are sorted inside the source, sizes are summed along them, and documents
are taken while their middle lies within the budget, so that a source misses its
target by half a document at most. DataFrame functions only.

A source may hold most of the rows: keys are cut into ranges, and sorting and sums
run by source and range, with the totals of the ranges before added.

Defined cases: a null or empty text has size 0 and is never taken; null sources
form one source, last in order; a null id draws the key of the empty string; equal
rows draw equal keys and are ordered by size; an empty table gives an empty result;
sources without a word get target 0; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, range_bounds, range_bucket, shuffle_partitions, stash, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)


def word_length_quality(text: Column, words: Column) -> Column:
    """A quality weight in (0, 1]: words of about six characters with their space weigh most."""
    return F.when(words > 0, F.lit(1.0) / (F.lit(1.0) + F.abs(F.length(text) / words - F.lit(6.0)))).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(_source, _source_size) to the same with _target; one row a source, sorted in one task.

    Water filling: with sources in the order of cap over weight, the level at a
    source is what is left after the caps before it, over the weights from it on;
    the first level that does not exceed its source's own ratio holds for all.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    whole = Window.partitionBy()
    rated = sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rated = rated.withColumn("_cap", F.lit(cap) * F.col("_source_size")).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    order = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    capped = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.lit(share) * F.sum("_source_size").over(whole)
    levels = rated.withColumn("_budget", budget).withColumn("_rank", F.row_number().over(order)).withColumn("_level", (F.col("_budget") - capped) / left)
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_rank", "_level"))).over(whole)["_level"]
    filled = F.least(F.col("_cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("_weight"))
    return levels.select("_source", "_source_size", filled.alias("_target"))


def draws(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """_id, _source, _size, _key and the columns of ``carry``, row by row."""
    text = text_or_empty(text_col)
    sized = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.col(source_col).cast("string").alias("_source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"),
        text.alias("_text"),
        *(f"`{c}`" for c in carry),
    )
    draw = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"))
    uniform = (F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") + 1.0) / F.lit(float(2**52 + 1))
    key = (-F.log(uniform) / word_length_quality(F.col("_text"), F.col("_size"))).alias("_key")
    return sized.select("_id", "_source", "_size", *(f"`{c}`" for c in carry), key)


def decided(slim: DataFrame, weights: tuple[float, ...], share: float, cap: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Of draws: _id, _source, _size, _key, _source_size, _target, _epochs, _picked and the columns of ``carry``, which order rows of equal key, id and size."""
    extra = [f"`{c}`" for c in carry]
    bounds = range_bounds(slim, "_key", shuffle_partitions(slim.sparkSession))
    ranged = slim.withColumn("_range", range_bucket(F.col("_key"), bounds, "double"))
    totals = ranged.groupBy("_source", "_range").agg(F.sum("_size").alias("_range_size"))
    targets = source_targets(totals.groupBy("_source").agg(F.sum("_range_size").alias("_source_size")), weights, share, cap)
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_range_size").over(before), F.lit(0)))
    t, s = targets.alias("t"), starts.alias("s")
    starts = s.join(t, F.col("s._source").eqNullSafe(F.col("t._source"))).select("s._source", "s._range", "_start", "_source_size", "_target")

    inside = Window.partitionBy("_source", "_range").orderBy("_key", "_id", "_size", *extra).rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.withColumn("_run", F.coalesce(F.sum("_size").over(inside), F.lit(0))).alias("r")
    s = starts.alias("s")
    joined = run.join(s, F.col("r._source").eqNullSafe(F.col("s._source")) & (F.col("r._range") == F.col("s._range"))).select("r._id", "r._source", "_size", "_key", "_run", "_start", "_source_size", "_target", *extra)
    epochs = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0))
    rest = F.col("_target") - F.col("_epochs") * F.col("_source_size")
    middle = F.col("_start") + F.col("_run") + F.col("_size") / 2
    return joined.withColumn("_epochs", epochs.cast("long")).withColumn("_picked", ((F.col("_size") > 0) & (middle <= rest)).cast("long"))


def mix_to_targets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "",
) -> DataFrame:
    """One row per document: id, _source, size, source_size, target, epochs, picked, taken."""
    slim = stash(draws(docs, id_col, text_col, source_col, seed), "mixing")
    return decided(slim, weights, share, cap).select(
        F.col("_id").alias(id_col),
        "_source",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_epochs").alias("epochs"),
        F.col("_picked").alias("picked"),
        ((F.col("_epochs") + F.col("_picked")) * F.col("_size")).alias("taken"),
    )


#: Sources whose borders are broadcast; with more they are joined as any other table.
FEW_SOURCES = 10_000


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "",
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in any order.

    What a source picks is the beginning of its order, so one border a source tells a
    row's copies from its own draw: texts are neither sorted nor shuffled. Rows of
    equal key, id and size go by a hash of all their columns; where only some of a
    border's equal rows are picked, these rows are the same, and one stands for all.
    """
    same, source, key, size, doc, copies, lot = (free_name(docs, x) for x in ("~same", "~source", "~key", "~size", "~doc", "~copies", "~lot"))
    plain = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    told = docs.withColumn(same, F.xxhash64(*(F.col(f"`{c}`") for c in plain)))
    slim = stash(draws(told, id_col, text_col, source_col, seed, (same,)), "mixing")
    order = F.struct("_key", "_id", "_size", same)
    cut = decided(slim, weights, share, cap, (same,)).groupBy("_source").agg(F.max("_epochs").alias("_epochs"), F.max(F.when(F.col("_picked") == 1, order)).alias("_last"), F.sum("_picked").alias("_picks"))
    cut = stash(cut.select(F.col("_source").alias("_of"), "_epochs", "_last", "_picks"), "borders")
    hint = F.broadcast if cut.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else (lambda df: df)
    by_source = lambda df, column: df.join(hint(cut), F.col(column).eqNullSafe(F.col("_of")))
    sized = by_source(slim.where("_size > 0"), "_source").groupBy("_of").agg(F.count_if(order < F.col("_last")).alias("less"), F.count_if(order == F.col("_last")).alias("equal"))
    c, n = cut.alias("c"), sized.alias("n")
    left = F.coalesce(F.col("_picks") - F.col("less"), F.lit(0))
    cut = stash(c.join(n, F.col("c._of").eqNullSafe(F.col("n._of")), "left").select("c._of", "_epochs", "_last", left.alias("_left"), (left >= F.coalesce("equal", F.lit(0))).alias("_all")), "borders")

    own = draws(told.withColumn(doc, F.struct(*(f"`{c}`" for c in docs.columns))), id_col, text_col, source_col, seed, (same, doc))
    met = by_source(own.select(F.col("_source").alias(source), F.struct("_key", "_id", "_size", same).alias(key), F.col("_size").alias(size), f"`{doc}`"), f"`{source}`")
    at_border = (F.col(f"`{size}`") > 0) & (F.col(f"`{key}`") == F.col("_last"))
    picked = (F.col(f"`{size}`") > 0) & ((F.col(f"`{key}`") < F.col("_last")) | (at_border & F.col("_all")))
    many = (F.col("_epochs") + F.coalesce(picked, F.lit(False)).cast("long")).cast("int")
    columns = [F.col(f"`{doc}`")[c].alias(c) for c in docs.columns]
    out = met.withColumn(copies, many).where(F.col(f"`{copies}`") > 0).withColumn(lot, F.explode(F.sequence(F.lit(1), F.col(f"`{copies}`")))).select(*columns)
    if cut.where("NOT _all").isEmpty():
        return out
    stands = met.where("NOT _all").where(at_border).groupBy("_of").agg(F.first(doc).alias(doc), F.max("_left").alias("_left"))
    lots = stands.withColumn(lot, F.explode(F.sequence(F.lit(0), F.expr("(_left - 1) div 4096")))).repartition("_of", lot)
    return out.unionByName(lots.withColumn(copies, F.explode(F.sequence(F.lit(1), F.least(F.lit(4096), F.col("_left") - F.col(f"`{lot}`") * 4096)))).select(*columns))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_to_targets(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH slim AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370497.0 AS u,
         length(coalesce(text, '')) AS chars
  FROM documents),
keyed AS (
  SELECT *, -ln(u) / (CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + abs(chars::DOUBLE / size - 6.0::DOUBLE)) ELSE 1.0::DOUBLE END) AS k FROM slim),
src AS (
  SELECT source, sum(size)::BIGINT AS s,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM keyed GROUP BY source),
rated AS (
  SELECT *, 2.0::DOUBLE * s AS c, 2.0::DOUBLE * s / w AS r, 1.5::DOUBLE * sum(s) OVER () AS b FROM src),
levels AS (
  SELECT *, row_number() OVER (ORDER BY r, source NULLS LAST) AS j,
         (b - coalesce(sum(c) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l
  FROM rated),
targets AS (
  SELECT source, s, least(c, w * (SELECT l FROM levels WHERE l <= r ORDER BY j LIMIT 1)) AS t FROM levels),
epochs AS (SELECT *, CASE WHEN s > 0 THEN floor(t / s)::BIGINT ELSE 0 END AS e FROM targets),
run AS (
  SELECT doc_id, source, size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed)
SELECT doc_id, size, s AS source_size, t AS target,
       ((e + CASE WHEN size > 0 AND before + size / 2.0::DOUBLE <= t - e * s THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM run JOIN epochs ON run.source IS NOT DISTINCT FROM epochs.source
"""
