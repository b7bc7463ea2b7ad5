"""From raw documents to a tokenised training mix, in five stages.

1. ``quality``: documents that the weak-label classifier rejects go.
2. ``near_dedup``: of documents with alike five-word shingles (0.8 or more), one stays.
3. ``repeats``: passages of 50 bytes that a document with a smaller id has too are cut out.
4. ``mix``: sources are sampled to their target weights; a document may come twice.
5. ``tokenise``: texts become token ids, and back to check.

Every stage works on all that its predecessor kept and, but for the last, returns the
columns of ``documents``. ``run`` writes each stage's rows as Parquet to the shared
folder and reads them again. Nulls, empty tables and further columns are handled as
the operators' docstrings say; a document without words is never taken by the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, mixing, pfp, simhash, weak_labels
from corpusmill.llm.common import stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_labels.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.distinct_documents(docs, words=5, similarity=0.8)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pfp.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenised(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeats", repeats), ("mix", mix), ("tokenise", tokenise)]
#: Models, fingerprints and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
