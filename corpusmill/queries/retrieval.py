"""Queries on search, probes and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PROBE_STOPWORDS, first_words
from ..functions.vectors import cosine
from ..operators import evals, search, verify
from ..operators.cells import dense_topk_cells
from ..operators.postings import sparse_topk_pruned
from .base import SQL_WORDS, STORED, query, stored, table
from .prepared import DENSE, SPARSE, indexed, seen, vector_cells, with_vectors

def sql_slots(column: str, at: int, size: int) -> str:
    words = SQL_WORDS.replace("(text,", f"(lower({column}),")
    return f"list_sort(list_distinct(list_transform(list_distinct({words}), lambda w: ('0x' || substr(md5(w), {at}, 4))::INT % {size})))"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, dense, sparse: the first ten words of every document whose id is divisible by 100."""
    rows = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), first_words(F.col("text")).alias("~text"))
    return with_vectors(rows, "~text").select("query", "dense", "sparse")


COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query(f"SELECT e.vec_id, {COSINE} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    q = rows.where("vec_id = 0").first().embedding
    return search.dense_topk(rows, q, 20, "embedding", "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"""
SELECT q.vec_id AS query, e.vec_id, {COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id)::BIGINT AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10""")
def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    out = dense_topk_cells(vector_cells(spark, sf_dir), queries, 10).best
    return out.select("query", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


ARMS = f"""
q AS (SELECT doc_id AS query, {sql_slots('text', 1, DENSE)} AS d, {sql_slots('text', 5, SPARSE)} AS s FROM (SELECT doc_id, array_to_string(({SQL_WORDS})[1:10], ' ') AS text FROM documents WHERE doc_id % 100 = 0)),
vec AS (SELECT point_id, {sql_slots('text', 1, DENSE)} AS d, {sql_slots('text', 5, SPARSE)} AS s FROM visible),
dense AS (SELECT query, point_id, round(len(list_intersect(v.d, q.d)) / sqrt(len(v.d)::DOUBLE * len(q.d)), 9) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, point_id) AS r FROM vec v, q WHERE len(v.d) > 0 AND len(q.d) > 0 QUALIFY r <= 20),
sparse AS (SELECT query, point_id, len(list_intersect(v.s, q.s))::DOUBLE AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, point_id) AS r FROM vec v, q WHERE list_has_any(v.s, q.s) QUALIFY r <= 20),
fused AS (SELECT query, point_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT query, point_id, r FROM dense UNION ALL SELECT query, point_id, r FROM sparse) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, point_id) <= 20)"""


@query(f"WITH {STORED}, {ARMS} SELECT query, point_id, round(score, 6) AS score, r::BIGINT AS rank FROM sparse")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sparse_topk_pruned(indexed(spark, sf_dir).weights, asked(spark, sf_dir), 20, view=seen).best
    return found.select("query", "point_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {STORED}, {ARMS} SELECT query, point_id, document_path, round(score, 6) AS score FROM fused JOIN visible USING (point_id)")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexed(spark, sf_dir)
    found, _ = index.hybrid(asked(spark, sf_dir), 20, view=seen)
    return found.join(index.entries.select("point_id", "document_path"), "point_id").select("query", "point_id", "document_path", F.round("score", 6).alias("score"))


@query(f"""
WITH {STORED}, {ARMS}, n AS (
  SELECT query, (SELECT count(*) FROM dense d WHERE d.query = q.query)::BIGINT AS dense_hits, (SELECT count(*) FROM sparse s WHERE s.query = q.query)::BIGINT AS sparse_hits,
         (SELECT count(*) FROM fused f WHERE f.query = q.query)::BIGINT AS candidate_count,
         (SELECT count(*) FILTER (text <> '' AND document_path <> '') FROM fused f JOIN visible USING (point_id) WHERE f.query = q.query)::BIGINT AS citationable_count FROM q)
SELECT *, candidate_count >= 1 AND (dense_hits >= 1 OR sparse_hits >= 1) AND citationable_count >= 1 AS passed FROM n""")
def retriever_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit counts and the verdict for every query."""
    queries, index = asked(spark, sf_dir), indexed(spark, sf_dir)
    found, counts = index.hybrid(queries, 20, view=seen)
    citationable = (F.length("text") > 0) & (F.length("document_path") > 0)
    told = found.join(index.entries.select("point_id", citationable.alias("~good")), "point_id").groupBy("query").agg(F.count("*").alias("candidate_count"), F.count_if("~good").alias("citationable_count"))
    out = queries.select("query").join(counts, "query", "left").join(told, "query", "left")
    return out.select("query", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("dense_hits", "sparse_hits", "candidate_count", "citationable_count"))).withColumn("passed", search.passes_gate())


VERIFY = f"""
view AS (SELECT *, {sql_slots('text', 1, DENSE)} AS d, {sql_slots('text', 5, SPARSE)} AS s FROM stored WHERE ingest_state = 'active' OR doc_id % 100 = 0),
probes AS (SELECT doc_id AS id, 'topical' AS kind, array_to_string(({SQL_WORDS})[1:10], ' ') AS query, 10 AS k FROM stored WHERE doc_id % 100 = 0
           UNION ALL SELECT doc_id, 'negative', '{verify.NONSENSE}', 5 FROM stored WHERE doc_id % 100 = 0),
asked AS (SELECT *, {sql_slots('query', 1, DENSE)} AS qd, {sql_slots('query', 5, SPARSE)} AS qs FROM probes),
ranks AS (
  SELECT id, kind, k, point_id, row_number() OVER (PARTITION BY id, kind ORDER BY round(len(list_intersect(d, qd)) / sqrt(len(d)::DOUBLE * len(qd)), 9) DESC, point_id) AS r FROM asked, view WHERE list_has_any(d, qd) QUALIFY r <= k
  UNION ALL
  SELECT id, kind, k, point_id, row_number() OVER (PARTITION BY id, kind ORDER BY len(list_intersect(s, qs)) DESC, point_id) AS r FROM asked, view WHERE list_has_any(s, qs) QUALIFY r <= k),
fused AS (SELECT id, kind, k, point_id, row_number() OVER (PARTITION BY id, kind ORDER BY sum(1.0::DOUBLE / (60 + r)) DESC, point_id) AS place FROM ranks GROUP BY 1, 2, 3, 4 QUALIFY place <= k),
hits AS (SELECT id, kind FROM fused WHERE point_id = 'p' || lpad(id::VARCHAR, 12, '0'))"""


@query(f"""
WITH {STORED}, {VERIFY},
w AS (SELECT *, list_transform({SQL_WORDS}, lambda x: trim(x, '.,;:!?"''()[]{{}}')) AS b FROM stored WHERE doc_id % 100 = 0),
p AS (SELECT *, list_filter(b, lambda x: length(x) >= 5 AND regexp_full_match(x, '\\p{{L}}+') AND NOT list_contains({PROBE_STOPWORDS}, lower(x)))[1] AS word FROM w),
v AS (
  SELECT document_id, ingest_generation::BIGINT AS ingest_generation, len({SQL_WORDS}) = 0 OR EXISTS (FROM hits WHERE id = doc_id AND kind = 'topical') AS topical,
       word IS NULL OR list_has_all(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), regexp_extract_all(lower(word), '[\\p{{L}}\\p{{N}}_]+')) AND contains(lower(text), lower(word)) AS specific,
       NOT EXISTS (FROM hits WHERE id = doc_id AND kind = 'negative') AS negative, (SELECT count(*) FROM stored s WHERE s.ingest_state = 'active' AND s.document_id <> p.document_id) < 5 AS deferred
  FROM p)
SELECT *, topical AND specific AND (negative OR deferred) AS passed FROM v""")
def verify_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All probes, and the verdict, of every document whose id is divisible by 100, against all chunks."""
    docs = stored(spark, sf_dir).where("doc_id % 100 = 0").select("document_id", "ingest_generation", F.lit("").alias("title"), F.col("text").alias("raw_text"))
    view = lambda rows: rows.where("ingest_state = 'active' OR doc_id % 100 = 0")
    out = verify.run_probes(verify.derive_probes(docs), indexed(spark, sf_dir), view, lambda rows: rows.where("ingest_state = 'active'"))
    return out.withColumn("ingest_generation", F.col("ingest_generation").cast("long"))


@query(rf"""
WITH w AS (SELECT doc_id, text, list_transform({SQL_WORDS}, lambda x: trim(x, '.,;:!?"''()[]{{}}')) AS b FROM documents),
p AS (SELECT *, list_filter(b, lambda x: length(x) >= 5 AND regexp_full_match(x, '\p{{L}}+') AND NOT list_contains({PROBE_STOPWORDS}, lower(x)))[1] AS word FROM w)
SELECT doc_id, list_has_all(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), regexp_extract_all(lower(word), '[\p{{L}}\p{{N}}_]+')) AND contains(lower(text), lower(word)) AS passed FROM p WHERE word IS NOT NULL""")
def verify_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specific probe of every document, against its own chunk."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("ingest_generation"), F.lit("").alias("title"), F.col("text").alias("raw_text"))
    out = verify.specific_results(verify.derive_probes(docs), docs.withColumnRenamed("raw_text", "text"))
    return out.select(F.col("document_id").alias("doc_id"), "passed")


@query("""
WITH ranked AS (
  SELECT q.vec_id AS case_id, e.vec_id AS document_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rank <= 20),
gold AS (SELECT q.vec_id AS case_id, e.vec_id AS document_id FROM embeddings q JOIN embeddings e ON e.vec_id > q.vec_id AND e.vec_id <= q.vec_id + 99 AND e.label = q.label WHERE q.vec_id % 100 = 0),
first AS (SELECT case_id, min(rank) AS f FROM ranked JOIN gold USING (case_id, document_id) GROUP BY 1)
SELECT c.case_id, CASE WHEN NOT EXISTS (FROM gold g WHERE g.case_id = c.case_id) OR f <= 1 THEN 1.0::DOUBLE ELSE 0 END AS recall_at_1,
  CASE WHEN NOT EXISTS (FROM gold g WHERE g.case_id = c.case_id) OR f <= 3 THEN 1.0::DOUBLE ELSE 0 END AS recall_at_3,
  CASE WHEN NOT EXISTS (FROM gold g WHERE g.case_id = c.case_id) OR f <= 5 THEN 1.0::DOUBLE ELSE 0 END AS recall_at_5, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr
FROM (SELECT DISTINCT case_id FROM ranked) c LEFT JOIN first USING (case_id)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant: vectors of the same label among the next 99."""
    rows = table(spark, sf_dir, "embeddings")
    chosen = rows.where("vec_id % 100 = 0")
    ranked = dense_topk_cells(vector_cells(spark, sf_dir), chosen.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 20).best
    ranked = ranked.select(F.col("query").alias("case_id"), F.col("vec_id").alias("document_id"), "rank")
    cases = chosen.select(F.col("vec_id").alias("case_id"), "label")
    of = F.expr("vec_id - vec_id % 100")
    gold = rows.where("vec_id % 100 <> 0").select(of.alias("case_id"), F.col("vec_id").alias("document_id"), "label").join(cases, ["case_id", "label"]).select("case_id", "document_id")
    return evals.retrieval_metrics(cases, ranked, gold).withColumn("mrr", F.round("mrr", 6))


@query("""
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the next."""
    rows = table(spark, sf_dir, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(after, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))
