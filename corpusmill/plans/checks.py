"""What a chunk must satisfy to be stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(values: Column) -> Column:
    """Whether all entries are numbers: none null, NaN or infinite."""
    return F.forall(values, lambda v: F.coalesce(F.abs(v.cast("double")) < F.lit(float("inf")), F.lit(False)))


def dense_flaw(vector: Column, dim: int | None) -> Column:
    return F.when(vector.isNull(), "dense: none").when(F.lit(dim is not None) & (F.size(vector) != F.lit(dim or 0)), f"dense: not of {dim} entries").when(~finite(vector), "dense: an entry is no number")


def sparse_flaw(vector: Column, dim: int | None) -> Column:
    """Indices ascend and none comes twice; there are as many values."""
    indices, values = vector["indices"], vector["values"]
    ascending = F.forall(F.sequence(F.lit(1), F.size(indices)), lambda i: (i == F.size(indices)) | F.coalesce(F.get(indices, i - 1) < F.get(indices, i), F.lit(False)))
    within = F.forall(indices, lambda i: F.coalesce((i >= 0) & (F.lit(dim is None) | (i < F.lit(dim or 0))), F.lit(False)))
    return (
        F.when(indices.isNull() | values.isNull(), "sparse: none")
        .when(F.size(indices) != F.size(values), "sparse: indices and values differ in length")
        .when((F.size(indices) > 1) & ~ascending, "sparse: indices do not ascend")
        .when(~within, "sparse: an index out of range")
        .when(~finite(values), "sparse: a value is no number")
    )


def chunk_flaw(dense_dim: int | None = None, sparse_dim: int | None = None) -> Column:
    """The first flaw of a CHUNK row; null: none."""
    missing = [F.when(F.col(c).isNull(), f"{c}: none") for c in ("point_id", "document_id", "document_sha256", "ingest_generation", "chunk_index", "text")]
    words = F.when(F.col("chunk_end_word") < F.col("chunk_start_word"), "words: the end before the start")
    number = F.when(F.col("ingest_generation") < 1, "ingest_generation: below 1")
    return F.coalesce(*missing, number, words, dense_flaw(F.col("dense"), dense_dim), sparse_flaw(F.col("sparse"), sparse_dim))
