"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ascending array of the ``k`` smallest distinct 64-bit hashes of a
text's shingles of ``words`` words. Sketches of parts merge into the sketch of the
whole; from sketches come resemblance, containment and the number of distinct
shingles. DataFrame functions only.

Defined cases: a null text counts as empty; a text without words has the empty
sketch, and two empty sketches resemble each other fully (1), an empty and a full
one not at all (0); a text of fewer words has one shingle, the whole word sequence;
repeated shingles count once; equal ids are neighbours in the order of their texts'
checksums; null ids come first; a lone document is its own successor; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import WORD, range_bounds, range_bucket, shuffle_partitions, text_or_empty

K, WORDS = 128, 5


def with_sketch(df: DataFrame, text: Column, out: str, k: int = K, words: int = WORDS) -> DataFrame:
    """Add the sketch of ``text`` as ``out``."""
    hashes, many = F.col("_hashes"), F.size("_hashes") >= words
    df = df.withColumn("_hashes", F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    shingles = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - (words - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *(F.get(hashes, i + j) for j in range(1, words))),
    )
    few = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, bottom_k(F.when(many, shingles).otherwise(few), k)).drop("_hashes")


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge_sketches(sketches: Column, k: int = K) -> Column:
    """Aggregate: the sketch of all shingles of a group.

    Use :func:`merge_by` where a group may hold very many rows.
    """
    return bottom_k(F.flatten(F.collect_list(sketches)), k)


def merge_by(df: DataFrame, keys: list[str], sketch: str, k: int = K, salts: int = 64) -> DataFrame:
    """Merge by ``keys`` in two steps, so that no task gathers a whole hot group."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(sketch), F.lit(salts)))
    part = salted.groupBy(*keys, "_salt").agg(merge_sketches(F.col(sketch), k).alias(sketch))
    return part.groupBy(*keys).agg(merge_sketches(F.col(sketch), k).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two sketches."""
    shared = lambda last: F.size(F.filter(F.array_intersect(a, b), lambda h: h <= last))
    share = let(F.slice(F.sort_array(F.array_union(a, b)), 1, k), lambda u: let(F.get(u, F.size(u) - 1), shared) / F.nullif(F.size(u), F.lit(0)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    both = let(resemblance(a, b, k), lambda j: j / (F.lit(1.0) + j)) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_string(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.hex(h)), ".")


def with_successor(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add ``_next_<column>`` of the next row by ``key``; the last row's next is the first.

    One shuffle by key ranges. The first row of each range also goes, as a guest,
    to the range before, whose last row needs it. ``key`` has no nulls.
    """
    bounds = range_bounds(docs, key, shuffle_partitions(docs.sparkSession))
    place = range_bucket(F.col(key), bounds, "bigint")
    firsts = {r[0]: r[1] for r in docs.select(key).groupBy(place.alias("_range")).agg(F.min(key)).collect()}  # a row a range
    used = sorted(firsts)
    first = F.lit([firsts.get(i, 0) for i in range(len(bounds) + 1)]).cast("array<bigint>")
    before = F.lit([next((u for u in reversed(used) if u < i), used[-1] if used else 0) for i in range(len(bounds) + 1)]).cast("array<int>")
    home = F.struct(F.col("_range").cast("int").alias("range"), F.lit(0).alias("guest"))
    guest = F.struct(F.get(before, F.col("_range")).alias("range"), F.lit(1).alias("guest"))
    places = F.when(F.col(key) == F.get(first, F.col("_range")), F.array(home, guest)).otherwise(F.array(home))
    dealt = docs.withColumn("_range", place).withColumn("_at", F.explode(places))
    order = Window.partitionBy(F.col("_at.range")).orderBy(F.col("_at.guest"), key, "_tie")
    led = dealt.select("*", *(F.lead(c).over(order).alias(f"_next_{c}") for c in columns))
    return led.where("_at.guest = 0").drop("_range", "_at")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """One row per document: id, text, sketch, the next document's text and sketch."""
    base = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    base = base.withColumn("_key", F.coalesce("_id", F.lit(-(2**63)))).withColumn("_tie", F.crc32(F.col("_text").cast("binary")))
    return with_successor(with_sketch(base, F.col("_text"), "_sketch", k, words), "_key", ["_text", "_sketch"]).select(
        F.col("_id").alias(id_col), "_text", "_sketch", "_next__text", "_next__sketch"
    )


def op6_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    chars = F.length("_text")
    cut = F.floor(chars / 4).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), chars - cut), F.substring(F.col("_next__text"), F.lit(1), cut))
    both = with_sketch(both.withColumn("_edited", edited), F.col("_edited"), "_edited_sketch")
    return both.select(
        "doc_id",
        chars.cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("_sketch")).alias("fingerprint"),
        as_string(F.col("_edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_edited_sketch")).alias("near_edited"),
        resemblance(F.col("_sketch"), F.col("_next__sketch")).alias("near_next"),
        distinct_shingles(F.col("_sketch")).alias("n_shingles"),
        containment(F.col("_edited_sketch"), F.col("_sketch")).alias("edited_contained"),
    )
