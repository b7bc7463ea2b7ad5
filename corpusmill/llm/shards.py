"""Sharding: contiguous shards of like byte size from global prefix sums.

Documents keep the order of their ids. Each range of ids gets its total size, the
totals are summed from the first range on, and every document's place on the byte
axis of the whole corpus is its range's start plus a running sum inside the range.
A shard is one of ``shards`` equal stretches of that axis; a document belongs to
the stretch that holds its middle byte. DataFrame functions only.

Defined cases: a null or empty text has size 1 (0 bytes plus 1); rows with equal
ids stay, ordered by checksum and size; null ids come first; an empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import range_bounds, range_bucket, shuffle_partitions, stash, text_or_empty


def prefix_sums(slim: DataFrame, key: str, order: list[str], sizes: dict[str, str], kind: str = "bigint") -> DataFrame:
    """Add, for each ``out: column`` of ``sizes``, the sum of ``column`` over all rows before.

    Two levels: totals of key ranges (one row a range), then running sums inside each.
    """
    bounds = range_bounds(slim, key, shuffle_partitions(slim.sparkSession))
    ranged = slim.withColumn("_range", range_bucket(F.col(key), bounds, kind))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_total_{o}") for o, c in sizes.items())).select(
        F.col("_range"), *(F.coalesce(F.sum(f"_total_{o}").over(before), F.lit(0)).alias(f"_start_{o}") for o in sizes)
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_run_{o}") for o, c in sizes.items()))
    out = running.join(F.broadcast(starts), "_range")  # a row a range: as many as shuffle partitions at most
    return out.select(*slim.columns, *((F.col(f"_start_{o}") + F.col(f"_run_{o}")).cast("long").alias(o) for o in sizes))


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """One row per document: id, size, text_crc32, byte_start, shard, slot."""
    text = text_or_empty(text_col)
    slim = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.lit(1).cast("long").alias("_one"),
    )
    slim = stash(slim, "shards")
    placed = prefix_sums(slim, "_id", ["_id", "_crc", "_size"], {"_at": "_size", "_row": "_one"})
    total = slim.agg(F.sum("_size")).first()[0] or 1
    middle = F.col("_at") * 2 + F.col("_size")
    placed = placed.withColumn("_shard", F.least(F.lit(shards - 1), F.floor(middle / F.lit(2 * total / shards))).cast("int"))
    firsts = placed.groupBy("_shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(firsts), "_shard").select(  # a row a shard
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_at").alias("byte_start"),
        F.col("_shard").alias("shard"),
        (F.col("_row") - F.col("_first")).alias("slot"),
    )


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "byte_start")
