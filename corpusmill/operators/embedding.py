"""Embedding chunks. The hashing embedder is made of built-in functions; a model comes in as an Arrow map."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hash_dense, hash_sparse

HASHING = "hashing:1.0"


def embed_hashing(chunks: DataFrame, dense_dim: int = 1024, sparse_dim: int = 30_000) -> DataFrame:
    """Add dense, sparse and embedding_model from the words of ``text``."""
    text = F.coalesce("text", F.lit(""))
    return chunks.withColumns({"dense": hash_dense(text, dense_dim), "sparse": hash_sparse(text, sparse_dim), "embedding_model": F.lit(HASHING)})


def embed_with_model(chunks: DataFrame, load: Callable[[], Callable[[list[str]], tuple[list[list[float]], list[dict[int, float]]]]], name: str, batch: int = 32) -> DataFrame:
    """The same from a model: ``load`` runs once in each worker and returns a function from texts to
    dense vectors and to sparse weights by index (names of indices may be digits)."""
    schema = ", ".join(f"`{c}` {t}" for c, t in chunks.dtypes) + ", dense array<float>, sparse struct<indices:array<int>,values:array<float>>"
    sparse_type = pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])
    text_at = chunks.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for some in batches:
            for at in range(0, some.num_rows, batch):
                part = some.slice(at, batch)
                dense, weights = encode([t or "" for t in part.column(text_at).to_pylist()])
                entries = [sorted((int(i), float(w)) for i, w in x.items()) for x in weights]
                sparse = pa.array([{"indices": [i for i, _ in e], "values": [w for _, w in e]} for e in entries], sparse_type)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(dense, pa.list_(pa.float32())), sparse], [*part.schema.names, "dense", "sparse"])

    return chunks.mapInArrow(run, schema).withColumn("embedding_model", F.lit(name))
