"""Column functions on dense and sparse vectors, and a hashing embedder."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let, words


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; the shorter vector counts as zero beyond its end."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a vector of zeros."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def sparse_vector(weights: Column) -> Column:
    """map<int,float> to a struct of ascending indices and their values."""
    entries = F.array_sort(F.map_entries(weights))
    return F.struct(F.transform(entries, lambda e: e["key"]).alias("indices"), F.transform(entries, lambda e: e["value"]).alias("values"))


def hashed(text: Column, at: int, size: int) -> Column:
    """Ascending distinct slots of a text's words: four hex digits of their MD5 from ``at`` on, modulo ``size``."""
    slots = F.transform(F.array_distinct(words(F.lower(text))), lambda w: (F.conv(F.substring(F.md5(F.encode(w, "UTF-8")), at, 4), 16, 10).cast("int") % size).cast("int"))
    return F.array_sort(F.array_distinct(slots))


def hash_dense(text: Column, size: int = 1024) -> Column:
    """A vector of length one with equal parts at the words' slots; no words: zeros."""
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)

    def filled(slots: Column) -> Column:
        part = (F.lit(1.0) / F.sqrt(F.greatest(F.size(slots), F.lit(1)).cast("double"))).cast("float")
        upto = F.flatten(F.transform(slots, lambda s, i: F.concat(zeros(s - F.coalesce(F.get(slots, i - 1), F.lit(-1)) - 1), F.array(part))))
        return F.concat(upto, zeros(F.lit(size - 1) - F.coalesce(F.get(slots, F.size(slots) - 1), F.lit(-1))))

    return let(hashed(text, 1, size), filled)


def hash_sparse(text: Column, size: int = 30_000) -> Column:
    """Weight one at the words' slots."""
    ones = lambda slots: F.transform(slots, lambda _: F.lit(1.0).cast("float"))
    return let(hashed(text, 5, size), lambda slots: F.struct(slots.alias("indices"), ones(slots).alias("values")))


def word_slots(texts: pa.Array, dense: int, sparse: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each text has a word at each dense slot; and the sparse slots of all texts' words, text by text, with their ends.

    All words lie in one Arrow array, of which only the distinct ones are hashed: most words of a batch are copies or occur once, so nothing is remembered.
    """
    lists = pc.utf8_split_whitespace(texts)
    parent, held = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).dictionary_encode()
    found = held.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    digests = np.frombuffer(b"".join([md5(w).digest() for w in found]), ">u2").reshape(-1, 8)[:, :2].astype(np.int64)
    empty = pc.equal(pc.binary_length(held.dictionary), 0).to_numpy(zero_copy_only=False)  # beside white space at an end
    code = held.indices.to_numpy()
    if empty.any():
        parent, code = (x[~empty[code]] for x in (parent, code))
    near = np.zeros((len(texts), dense), bool)
    near[parent, (digests[:, 0] % dense)[code]] = True
    far = np.sort(parent.astype(np.int64) * sparse + (digests[:, 1] % sparse)[code])  # most of a text's slots are empty
    far = far[np.append(True, far[1:] != far[:-1])[: len(far)]]
    ends = np.searchsorted(far, np.arange(len(texts) + 1) * sparse)
    return near, (far % sparse).astype(np.int32), ends.astype(np.int32)


def with_hash_vectors(rows: DataFrame, column: str, dense: int = 1024, sparse: int = 30_000) -> DataFrame:
    """``rows`` with dense and sparse, as :func:`hash_dense` and :func:`hash_sparse` make them of a text; a word is hashed once a batch."""
    names, width = rows.columns, len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                texts = some.column(width)
                told, listed, ends = word_slots(texts.fill_null(""), dense, sparse)
                parts = (1.0 / np.sqrt(np.maximum(1, np.count_nonzero(told, axis=1)))).astype(np.float32)
                gone = texts.is_null()
                near = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dense, pa.int32()), pa.array((told * parts[:, None]).ravel()), mask=gone)
                offsets = pa.array(ends)
                indices = pa.ListArray.from_arrays(offsets, pa.array(listed), mask=gone)
                weights = pa.ListArray.from_arrays(offsets, pa.array(np.ones(len(listed), np.float32)), mask=gone)
                both = pa.StructArray.from_arrays([indices, weights], ["indices", "values"])
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in range(width)), near, both], [*names, "dense", "sparse"])

    numbers = T.ArrayType(T.FloatType())
    schema = T.StructType([*rows.schema.fields, T.StructField("dense", numbers), T.StructField("sparse", T.StructType([T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", numbers)]))])
    return rows.select("*", F.lower(F.col(column)).alias("~low")).mapInArrow(run, schema)
