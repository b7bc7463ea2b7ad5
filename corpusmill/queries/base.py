"""The register of queries, and rows that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import text_sha256
from ..functions.text import SPACES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Words of ``text`` in DuckDB.
SQL_WORDS = f"list_filter(regexp_split_to_array(text, '[{SPACES}]+'), lambda x: x <> '')".replace(r"\x85\xa0", r"\x{85}\x{a0}")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of a corpus: three rows are generations of one document, in states told by the id."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("p"), F.lpad(n.cast("string"), 12, "0")).alias("point_id"),
        F.concat(F.lit("d"), F.expr("doc_id div 3").cast("string")).alias("document_id"),
        (n % 3 + 1).cast("int").alias("ingest_generation"),
        F.when(n % 7 == 0, "pending").when(n % 7 == 1, "failed").otherwise("active").alias("ingest_state"),
        F.col("source").alias("source_id"),
        F.concat("source", F.lit("/"), n.cast("string")).alias("document_path"),
        F.array("lang", F.concat(F.lit("t"), (n % 5).cast("string"))).alias("tags"),
        F.timestamp_seconds(F.lit(1704067200) + n * 60).alias("ingested_at"),
        text_sha256(F.col("text")).alias("document_sha256"),
        F.lit(0).alias("chunk_index"),
        "lang",
        "text",
    )


STORED = """stored AS (
  SELECT doc_id, 'p' || lpad(doc_id::VARCHAR, 12, '0') AS point_id, 'd' || (doc_id // 3) AS document_id, (doc_id % 3 + 1)::INT AS ingest_generation,
         CASE doc_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'active' END AS ingest_state, source AS source_id,
         source || '/' || doc_id AS document_path, [lang, 't' || (doc_id % 5)] AS tags, make_timestamp((1704067200 + doc_id * 60) * 1000000) AS ingested_at,
         sha256(text) AS document_sha256, lang, text
  FROM documents),
heads AS (SELECT document_id, max(ingest_generation) AS newest FROM stored WHERE ingest_state = 'active' GROUP BY 1),
visible AS (SELECT s.* FROM stored s JOIN heads h ON s.document_id = h.document_id AND s.ingest_generation = h.newest WHERE ingest_state = 'active')"""


def sql_uuid5(name: str) -> str:
    h = f"sha1(unhex('a1b2c3d4e5f67890abcdef1234567890') || encode({name}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', (('0x' || substr({h}, 17, 1))::INT % 4) + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
