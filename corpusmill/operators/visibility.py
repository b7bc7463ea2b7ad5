"""Which generation of a document readers see, and filters on top of it.

Readers see active chunks of the highest active generation of each document. That
generation is taken over the whole corpus, whatever else a query filters by.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_states(log: DataFrame) -> DataFrame:
    """The last state by ``seq`` of every (document_id, ingest_generation) in a state log."""
    newest = F.max_by(F.col("state"), F.col("seq"))
    return log.groupBy("document_id", "ingest_generation").agg(newest.alias("ingest_state"))


def max_active_generation(rows: DataFrame) -> DataFrame:
    """document_id, newest: the highest active generation; documents without one have no row."""
    return rows.where("ingest_state = 'active'").groupBy("document_id").agg(F.max("ingest_generation").alias("newest"))


def visible(rows: DataFrame) -> DataFrame:
    """Rows (with their ingest_state) of each document's highest active generation."""
    heads = max_active_generation(rows).select(F.col("document_id").alias("~d"), F.col("newest").alias("~g"))
    return rows.where("ingest_state = 'active'").join(heads, (F.col("document_id") == F.col("~d")) & (F.col("ingest_generation") == F.col("~g"))).select(*(f"`{c}`" for c in rows.columns))


def verification_view(rows: DataFrame, document_id: str, generation: int) -> DataFrame:
    """All active rows, and those of one generation whatever its state."""
    return rows.where((F.col("ingest_state") == "active") | ((F.col("document_id") == document_id) & (F.col("ingest_generation") == generation)))


def matches(source_id: str | None = None, document_path: str | None = None, since: str | datetime | None = None, tags: list[str] | None = None, source_type: str | None = None) -> Column:
    """The conjunction of the filters that are given; an empty list of tags filters nothing."""
    out = F.lit(True)
    for column, value in (("source_id", source_id), ("document_path", document_path), ("source_type", source_type)):
        if value is not None:
            out = out & (F.col(column) == value)
    if since is not None:
        out = out & (F.col("ingested_at") >= F.lit(since).cast("timestamp"))
    if tags:
        out = out & F.arrays_overlap(F.col("tags"), F.array(*map(F.lit, tags)))
    return out


def active_content(rows: DataFrame) -> DataFrame:
    """document_id, document_sha256, newest: the content of the highest active generation."""
    return rows.where("ingest_state = 'active'").groupBy("document_id").agg(F.max_by("document_sha256", F.struct("ingest_generation", "document_sha256")).alias("document_sha256"), F.max("ingest_generation").alias("newest"))


def with_next_generation(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """``docs`` (document_id, document_sha256, ...) with no_op and the generation to write."""
    h = heads.select(F.col("document_id").alias("~d"), F.col("document_sha256").alias("~sha"), F.col("newest").alias("~g"))
    joined = docs.join(h, F.col("document_id") == F.col("~d"), "left")
    same = F.coalesce(F.col("document_sha256") == F.col("~sha"), F.lit(False))
    return joined.select(*(f"`{c}`" for c in docs.columns), same.alias("no_op"), F.when(same, F.col("~g")).otherwise(F.coalesce("~g", F.lit(0)) + 1).alias("generation"))


def gc_counts(rows: DataFrame) -> DataFrame:
    """One row: superseded_deleted, orphan_deleted, documents_affected."""
    heads = max_active_generation(rows).select(F.col("document_id").alias("~d"), "newest")
    both = rows.join(heads, F.col("document_id") == F.col("~d"), "left")
    superseded = (F.col("ingest_state") == "active") & (F.col("ingest_generation") < F.col("newest"))
    orphan = F.col("ingest_state").isin("pending", "failed")
    return both.agg(
        F.count_if(superseded).alias("superseded_deleted"),
        F.count_if(orphan).alias("orphan_deleted"),
        F.count_distinct(F.when(superseded | orphan, F.col("document_id"))).alias("documents_affected"),
    )


def status(rows: DataFrame) -> DataFrame:
    """One row of counts: all points, and what readers see."""
    seen = visible(rows).agg(
        F.count("*").alias("active_chunk_count"), F.count_distinct("document_id").alias("document_count"),
        F.count_distinct("source_id").alias("source_count"), F.max("ingested_at").alias("last_ingested_at"),
    )
    return rows.agg(F.count("*").alias("point_count")).crossJoin(seen)  # one row each
