"""Exhaustive reads: chunks that hold all tokens of a term, exact counts, and documents by metadata.

Scans, for rows without an index; :mod:`..plans.corpus_index` answers the same from stored postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_all_tokens, occurrences


def lexscan(rows: DataFrame, term: str) -> DataFrame:
    """Rows of a visible view that hold all tokens of ``term``, with the occurrences of the term itself.

    A term of several words may match with no occurrence: its words need not stand together.
    """
    text = F.coalesce("text", F.lit(""))
    return rows.where(has_all_tokens(text, F.lit(term))).withColumn("occurrences", occurrences(text, F.lit(term)))


def lexscan_counts(rows: DataFrame, term: str) -> DataFrame:
    """One row: chunk_count, document_count, occurrence_count."""
    return scan_counts(lexscan(rows, term))


def scan_counts(found: DataFrame) -> DataFrame:
    """The same of what a scan found."""
    return found.agg(F.count("*").alias("chunk_count"), F.count_distinct("document_id").alias("document_count"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrence_count"))


def scroll(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each document of a visible view: ``fields`` of its first chunk, and chunk_count."""
    first = F.min_by(F.struct(*fields), F.struct("chunk_index", "point_id"))
    return rows.groupBy("document_id").agg(first.alias("~first"), F.count("*").alias("chunk_count")).select("document_id", *(F.col("~first")[f].alias(f) for f in fields), "chunk_count")
