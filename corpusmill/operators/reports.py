"""The ingest report: one outcome for each path and counts by outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From best to worst.
OUTCOMES = ["no_op", "success", "skipped", "index_suspect", "error"]


def severity(outcome: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, OUTCOMES)), outcome)


def by_path(results: DataFrame) -> DataFrame:
    """(path, document_id, outcome, chunk_count) to a row for each path: its worst outcome, documents and chunks."""
    return results.groupBy("path").agg(F.max_by("outcome", severity(F.col("outcome"))).alias("outcome"), F.count("*").alias("documents"), F.sum("chunk_count").alias("chunk_count"))


def path_details(results: DataFrame) -> DataFrame:
    """(path, document_id, outcome, generation, chunk_count) to a row for each path: as :func:`by_path`, with the ids of its documents,
    ascending, their generations in that order, and how many have each outcome."""
    told = F.array_sort(F.collect_list(F.struct("document_id", "generation", "outcome")))
    rows = by_path(results).join(results.groupBy("path").agg(told.alias("~told")), "path")
    many = lambda o: F.size(F.filter("~told", lambda t: t["outcome"] == o))
    counts = F.map_from_arrays(F.lit(OUTCOMES), F.array(*map(many, OUTCOMES)))
    return rows.select("path", "outcome", "documents", "chunk_count", F.col("~told.document_id").alias("document_ids"), F.col("~told.generation").alias("generations"), F.map_filter(counts, lambda k, v: v > 0).alias("outcomes"))


def totals(paths: DataFrame) -> DataFrame:
    """One row: total_paths and a count for each outcome."""
    return paths.agg(F.count("*").alias("total_paths"), *(F.count_if(F.col("outcome") == o).alias(f"{o}_count") for o in OUTCOMES))
