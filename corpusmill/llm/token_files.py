"""Token-id files: Parquet with list columns, made for selective reads.

Documents are dealt into id ranges, sorted, encoded with the tokenizers library (the
id ``end`` after each) and written by Spark's Parquet writer: one row a document with
its id, number of tokens, place in its file and the ids. Ids are dictionary-encoded
(a vocabulary of 50 thousand needs 16 bits an id), counts and places delta-encoded
(format version 2), row groups and pages have stated sizes, and column and offset
indexes let a reader skip pages. Files are in ascending order of ids, so the count
columns alone, a fraction of the bytes, give every document's place in the stream.

Defined cases: a null text counts as empty and has only the end id; rows with equal
ids stay side by side, in the order of their texts; null ids come first; an empty
table gives no file and an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import TextEncoder, byte_letters, check_kind, default_tokenizer, portions
from .common import shared_dir, shuffle_partitions, text_or_empty

SCHEMA = "doc_id bigint, n_tokens bigint, file int, file_start bigint, token_ids array<int>"
ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 256 << 10


@lru_cache(maxsize=4)
def library_encoder(path: str | None) -> TextEncoder:
    """The tokenizers library for texts, and for words: letters through its model, others as lines of one text, cut at the line ends' id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    path = path or default_tokenizer()
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()

    def ids(text: str) -> np.ndarray:
        return np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def words(units: list[str]) -> list[bytes]:
        """A space, if any, and letters are one piece, which the library's model takes in its own spelling of bytes."""
        out, rest = [], []
        for i, u in enumerate(units):
            if u.isalpha() or (u[:1] == " " and u[1:].isalpha()):
                spelled = u.replace(" ", space) if u.isascii() else u.encode().decode("latin-1").translate(spelling)
                out.append(array("I", [x.id for x in tokenize(spelled)]).tobytes())
            else:
                rest.append(i)
                out.append(b"")
        if rest:
            for i, ids_of in zip(rest, lines([units[i] for i in rest]), strict=True):
                out[i] = ids_of
        return out

    def lines(units: list[str]) -> list[bytes]:
        found = ids("\n".join(units))
        cuts = np.flatnonzero(found == end)
        data, a = memoryview(found).cast("B"), 0
        out = []
        for b in (4 * cuts).tolist():
            out.append(bytes(data[a:b]))
            a = b + 4
        return [*out, bytes(data[a:])]

    spelling = str.maketrans({chr(b): c for c, b in byte_letters().items()})
    space, tokenize = spelling[ord(" ")], t.model.tokenize
    (end,) = ids("\n").tolist()
    with open(path, encoding="utf-8") as f:
        check_kind(json.load(f))
    specials = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
    return TextEncoder(specials, lambda text: ids(text).tobytes(), words)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> None:
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = library_encoder(tokenizer), int(end).to_bytes(4, "little")
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k, upto in portions(batch.column(1)):  # bounds the ids in memory
                some = batch.slice(k, upto - k)
                made = [ids + tail for _, ids in encoder.batches(some.column(1))]
                counts = np.array([len(b) // 4 for b in made], np.int64)
                starts = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(made), "<u4").astype(np.int32)))
                columns = [some.column(0), pa.array(counts), pa.array(np.full(len(counts), part, np.int32)), pa.array(starts), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "file", "file_start", "token_ids"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    dealt = slim.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#token_ids.list.element": "true",
        "parquet.dictionary.page.size": str(4 << 20), "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES),
    }
    dealt.mapInArrow(run, SCHEMA).write.options(**options).parquet(path)


def stream_places(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, file, file_start, from the count columns of the files alone."""
    files = spark.read.schema(SCHEMA).parquet(path)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return files.join(F.broadcast(starts), "file").withColumn("start", F.col("_start") + F.col("file_start"))  # a row a file


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as they stand in the files. A count that differs from the ids read fails the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, values = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            counts = np.diff(ends).astype(np.int64)
            if not np.array_equal(counts, batch.column(2).to_numpy()):
                raise ValueError("a file's counts of tokens are not those of its lists")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return stream_places(spark, path).select("doc_id", "start", "n_tokens", "token_ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_tokens(spark: SparkSession, path: str, first_id: int, last_id: int) -> DataFrame:
    """The ids of the documents from ``first_id`` to ``last_id``; other pages are skipped by their index."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("doc_id").between(first_id, last_id)).select("doc_id", "token_ids")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_digests(spark, path)
