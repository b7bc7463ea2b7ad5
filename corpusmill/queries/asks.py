"""Queries on questions asked in parts: three sub-queries each, of every document whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_words
from ..operators import ask
from .base import SQL_WORDS, STORED, query, table
from .prepared import indexed, seen
from .retrieval import ARMS, asked

#: As in the search queries, but rows of no likeness are no hits.
LIKE = ARMS.replace("WHERE len(v.d) > 0 AND len(q.d) > 0", "WHERE list_has_any(v.d, q.d)")


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sub = asked(spark, sf_dir).withColumn("ask", F.expr("query div 300"))
    return ask.answer_parts(indexed(spark, sf_dir), sub, 20, view=seen)


@query(f"WITH {STORED}, {LIKE} SELECT query // 300 AS ask, point_id, round(max(score), 6) AS score, count(*) AS sub_queries FROM fused GROUP BY 1, 2")
def ask_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir)[0].withColumn("score", F.round("score", 6))


@query(f"""
WITH {STORED}, {LIKE}, n AS (SELECT query, count(*) AS hits FROM fused GROUP BY 1)
SELECT query // 300 AS ask, q.query, coalesce(hits, 0) AS hits, CASE WHEN hits > 0 THEN 'answered' ELSE 'empty' END AS status FROM q LEFT JOIN n USING (query)""")
def ask_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir)[1]


@query(rf"""
WITH {STORED}, {LIKE}, n AS (SELECT query, count(*) AS hits FROM fused GROUP BY 1),
kinds AS (SELECT doc_id AS query, ['recall', 'synthesis', 'enumeration'][(doc_id // 100 % 3 + 1)::INT] AS ask_type, regexp_extract_all(lower(array_to_string(({SQL_WORDS})[1:2], ' ')), '[\p{{L}}\p{{N}}_]+') AS t FROM documents WHERE doc_id % 100 = 0),
listed AS (SELECT query, count(*) AS hits FROM kinds, visible WHERE ask_type = 'enumeration' AND len(t) > 0 AND list_has_all(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), t) GROUP BY 1)
SELECT query // 300 AS ask, query, ask_type, coalesce(CASE ask_type WHEN 'enumeration' THEN l.hits ELSE n.hits END, 0) AS hits,
       CASE WHEN coalesce(CASE ask_type WHEN 'enumeration' THEN l.hits ELSE n.hits END, 0) > 0 THEN 'answered' ELSE 'empty' END AS status
FROM kinds k LEFT JOIN n USING (query) LEFT JOIN listed l USING (query)""")
def ask_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger where every third sub-query asks for all chunks with its first two words."""
    kind = F.element_at(F.array(*map(F.lit, (*ask.SEARCHED, ask.LISTED))), F.expr("query div 100 % 3 + 1").cast("int"))
    words = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), first_words(F.col("text"), 2).alias("text"))
    sub = asked(spark, sf_dir).join(words, "query").withColumns({"ask": F.expr("query div 300"), "ask_type": kind})
    told = ask.answer_routed(indexed(spark, sf_dir), sub, 20, view=seen)[1]
    return told.join(sub.select("query", "ask_type"), "query").select("ask", "query", "ask_type", "hits", "status")
