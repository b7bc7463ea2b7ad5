"""Queries on sources, identity, text functions and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import chunking
from ..sources.routing import source_type
from .base import SQL_WORDS, query, sql_uuid5, table


@query(f"SELECT doc_id, sha256(text) AS document_sha256, {sql_uuid5("source || '|' || doc_id")} AS document_id FROM documents")
def doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", identity.text_sha256(F.col("text")).alias("document_sha256"), identity.document_id(F.col("source"), F.col("doc_id").cast("string")).alias("document_id"))


@query(f"SELECT doc_id, {sql_uuid5("source || '|' || sha256(text) || '|' || (doc_id % 9)")} AS point_id FROM documents")
def point_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", identity.point_id(F.col("source"), identity.text_sha256(F.col("text")), F.col("doc_id") % 9).alias("point_id"))


ENDINGS = ".pdf .docx .MD .txt .markdown .rst .text .xyz".split()


@query(f"""
SELECT doc_id, CASE WHEN e = 'pdf' THEN 'pdf' WHEN e = 'docx' THEN 'docx' WHEN e IN ('md', 'txt', 'markdown', 'rst', 'text') THEN 'markdown' END AS source_type,
       source || '.v' || doc_id AS title
FROM (SELECT *, lower({ENDINGS}[(doc_id % 8 + 1)::INT][2:]) AS e FROM documents)""")
def source_type_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 8 + 1).cast("int"))
    path = F.concat(F.lit("/corpus/"), "source", F.lit(".v"), F.col("doc_id").cast("string"), ending)
    return docs.select("doc_id", source_type(path).alias("source_type"), text.stem(path).alias("title"))


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '[\x01-\x08\x0e-\x1a\x1c-\x1f]')) <= 0.3 * strlen(html) AS as_is,
       len(regexp_extract_all(html, '[^a-z]')) <= 0.3 * length(html) AS noisy
FROM pages""")
def text_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As they are, and with all but a to z turned to control bytes."""
    pages = table(spark, sf_dir, "pages")
    noisy = F.encode(F.regexp_replace("html", "[^a-z]", "\x01"), "UTF-8")
    return pages.select("page_id", text.looks_like_text(F.encode("html", "UTF-8")).alias("as_is"), text.looks_like_text(noisy).alias("noisy"))


@query(r"""
WITH m AS (
  SELECT doc_id, text, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{P}\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))::DOUBLE / nullif(length(text), 0) AS g,
         len(regexp_extract_all(text, '[\x{FFFD}\p{Cf}\x00-\x08\x0e-\x1b\x7f-\x{84}\x{86}-\x{9f}]'))::DOUBLE / nullif(length(text), 0) AS b
  FROM documents)
SELECT doc_id, round(coalesce(g, 1), 6) AS good, round(coalesce(b, 0), 6) AS bad,
       CASE WHEN length(replace(text, chr(10), '')) < 100 THEN 'scanned' WHEN g < 0.7 OR b > 0.1 THEN 'low_confidence' ELSE 'ok' END AS verdict
FROM m""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "documents").select("doc_id", text.quality(F.col("text")).alias("q"))
    return told.select("doc_id", F.round("q.good", 6).alias("good"), F.round("q.bad", 6).alias("bad"), "q.verdict")


@query(r"""
SELECT doc_id, coalesce(nullif(trim(regexp_extract(regexp_replace(text, '(^|\n)([^\n]{0,20})\n', '\1# \2' || chr(10)), '(?m)^#\s+(.+)$', 1)), ''), source) AS title FROM documents""")
def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first short line is made a heading, so that some documents have one."""
    headed = F.regexp_replace("text", r"(?s)(^|\n)([^\n]{0,20})\n(.*)", "$1# $2\n$3")
    return table(spark, sf_dir, "documents").select("doc_id", text.title(headed, F.concat("source", F.lit(".md"))).alias("title"))


RANGES = """
sized AS (SELECT *, {words} AS w FROM documents),
counted AS (SELECT *, len(w) AS n FROM sized WHERE len(w) > 0),
many AS (SELECT *, CASE WHEN n <= 220 THEN 1 ELSE ceil((n - 220) / 180.0)::INT + 1 END AS k FROM counted),
last AS (SELECT *, k - CASE WHEN k > 1 AND n - (k - 1) * 180 < 80 THEN 1 ELSE 0 END AS m FROM many),
ranges AS (SELECT *, unnest(range(m)) AS i FROM last),
cut AS (SELECT doc_id, i AS chunk_index, i * 180 AS chunk_start_word, CASE WHEN i = m - 1 THEN n ELSE i * 180 + 220 END AS chunk_end_word, w FROM ranges)""".format(words=SQL_WORDS)


@query(f"WITH {RANGES} SELECT doc_id, chunk_index::BIGINT AS chunk_index, chunk_start_word::BIGINT AS chunk_start_word, chunk_end_word::BIGINT AS chunk_end_word FROM cut")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.chunk_prose(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return cut.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("chunk_index", "chunk_start_word", "chunk_end_word")))


@query(f"WITH {RANGES} SELECT doc_id, chunk_index::BIGINT AS chunk_index, sha256(array_to_string(w[chunk_start_word + 1 : chunk_end_word], ' ')) AS text_sha256 FROM cut")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.chunk_prose(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return cut.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), identity.text_sha256(F.col("text")).alias("text_sha256"))


@query(f"""
WITH pages AS (SELECT conv_id, turn, {SQL_WORDS} AS w, len({SQL_WORDS}) AS n FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pages),
many AS (SELECT *, CASE WHEN n <= 20 THEN 1 ELSE ceil((n - 20) / 15.0)::INT + 1 END AS k FROM placed WHERE n > 0),
last AS (SELECT *, k - CASE WHEN k > 1 AND n - (k - 1) * 15 < 8 THEN 1 ELSE 0 END AS m FROM many),
cut AS (SELECT *, unnest(range(m)) AS i FROM last)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY page, i) - 1)::BIGINT AS chunk_index, page::BIGINT AS pdf_page,
       (before + i * 15)::BIGINT AS chunk_start_word, (before + CASE WHEN i = m - 1 THEN n ELSE i * 15 + 20 END)::BIGINT AS chunk_end_word,
       sha256(array_to_string(w[i * 15 + 1 : CASE WHEN i = m - 1 THEN n ELSE i * 15 + 20 END], ' ')) AS text_sha256
FROM cut""")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a paged document, a turn a page."""
    turns = table(spark, sf_dir, "conversations")
    paged = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("pages")).select("conv_id", F.col("pages.text").alias("pages"))
    cut = chunking.chunk_pages(paged, "pages", 20, 5, 8)
    return cut.select("conv_id", *(F.col(c).cast("long").alias(c) for c in ("chunk_index", "pdf_page", "chunk_start_word", "chunk_end_word")), identity.text_sha256(F.col("text")).alias("text_sha256"))


@query()
def markdown_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are, read as Markdown. No SQL: their marks need a parser; tested on small texts."""
    return chunking.chunk_markdown(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def as_markdown(docs: DataFrame) -> DataFrame:
    """doc_id, text: every token of a document's text, laid out with headings, code, a quote, a nested list, a table and a comment."""
    tokens, lit, id_ = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lit, F.col("doc_id").cast("string")
    w = docs.select("doc_id", F.coalesce(tokens, F.array().cast("array<string>")).alias("w")).withColumn("a", F.expr("size(w) div 4"))
    quarter = lambda i: F.slice("w", F.col("a") * i + 1, F.col("a"))
    before = lambda i: F.when(i % 10 != 0, " ").when(i > 0, "\n").otherwise("")  # noqa: E731  ten tokens a line; a slice a line would copy all tokens each time
    lines = lambda part: F.array_join(F.transform(part, lambda x, i: F.concat(before(i), x)), "")
    text = F.concat(
        lit("Head "), id_, lit(" *x*\n===\n\n"), lines(quarter(0)), lit("\n\n## Code `c` ##\n\n~~~py\n"), lines(quarter(1)), F.when(F.col("a") > 0, "\n").otherwise(""), lit("~~~\n\n### Deep [link](http://x)\n\n> "),
        lines(quarter(2)), lit("\n\n- item\n\n  1. "), F.array_join(F.slice("w", F.col("a") * 3 + 1, F.greatest(F.size("w"), lit(1))), " "),
        lit("\n\n# Table\n\n| a | b |\n| --- | :-: |\n| "), id_, lit(" | t |\n\n<!-- note -->\n"),
    )
    return w.select("doc_id", text.alias("text"))


@query(r"""
WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[\p{L}\p{N}]+'), []) AS w FROM documents),
s AS (SELECT *, len(w) // 4 AS a, len(w) - 3 * (len(w) // 4) AS m FROM t),
code AS (SELECT *, w[a + 1 : 2 * a] AS c FROM s),
pieces AS (
  SELECT doc_id, 1 AS nr, '# Head ' || doc_id || ' x' AS path, 4 AS pos, w[1 : a] AS v, NULL AS whole FROM s
  UNION ALL SELECT doc_id, 2, '# Head ' || doc_id || ' x | ## Code `c`', 7 + a, [], '```py' || chr(10) || array_to_string(list_transform(range((a + 9) // 10), lambda i: array_to_string(c[i * 10 + 1 : i * 10 + 10], ' ') || chr(10)), '') || '```' FROM code
  UNION ALL SELECT doc_id, 3, '# Head ' || doc_id || ' x | ## Code `c` | ### Deep link', 12 + 2 * a, CASE WHEN 1 + m + a > 220 THEN w[2 * a + 1 : 3 * a] ELSE w[2 * a + 1 : 3 * a] || ['item'] || w[3 * a + 1 :] END, NULL FROM s
  UNION ALL SELECT doc_id, 4, '# Head ' || doc_id || ' x | ## Code `c` | ### Deep link', 12 + 3 * a, ['item'] || w[3 * a + 1 :], NULL FROM s WHERE 1 + m + a > 220
  UNION ALL SELECT doc_id, 5, '# Table', 15 + 3 * a + m, [], 'a b' || chr(10) || doc_id || ' t' FROM s
  UNION ALL SELECT doc_id, 6, '# Table', 19 + 3 * a + m, ['<!--', 'note', '-->'], NULL FROM s),
sized AS (SELECT *, CASE WHEN whole IS NULL THEN len(v) ELSE len(regexp_extract_all(whole, '\S+')) END AS n FROM pieces),
many AS (SELECT *, CASE WHEN whole IS NOT NULL OR n <= 220 THEN 1 ELSE ceil((n - 220) / 180.0)::INT + 1 END AS k FROM sized WHERE n > 0),
last AS (SELECT *, k - CASE WHEN k > 1 AND n - (k - 1) * 180 < 80 THEN 1 ELSE 0 END AS last FROM many),
cut AS (SELECT *, unnest(range(last)) AS i FROM last)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY nr, i) - 1)::BIGINT AS chunk_index, path AS heading_path, (pos + i * 180)::BIGINT AS chunk_start_word,
       (pos + CASE WHEN i = last - 1 THEN n ELSE i * 180 + 220 END)::BIGINT AS chunk_end_word,
       sha256(coalesce(whole, array_to_string(v[i * 180 + 1 : CASE WHEN i = last - 1 THEN n ELSE i * 180 + 220 END], ' '))) AS text_sha256
FROM cut""")
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of every document, laid out as Markdown and cut by its blocks."""
    cut = chunking.chunk_markdown(as_markdown(table(spark, sf_dir, "documents")), "text")
    return cut.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "heading_path", *(F.col(c).cast("long").alias(c) for c in ("chunk_start_word", "chunk_end_word")), identity.text_sha256(F.col("text")).alias("text_sha256"))


@query(f"""
WITH w AS (SELECT doc_id, text, {SQL_WORDS} AS w FROM documents),
bare AS (SELECT *, list_transform(w, lambda x: trim(x, '.,;:!?"''()[]{{}}')) AS b FROM w)
SELECT doc_id, array_to_string(w[1:10], ' ') AS topical,
       list_filter(b, lambda x: length(x) >= 5 AND regexp_full_match(x, '\\p{{L}}+') AND NOT list_contains({text.PROBE_STOPWORDS}, lower(x)))[1] AS specific
FROM bare""".replace("\\\\p", "\\p"))
def probe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.first_words(t).alias("topical"), text.specific_word(t).alias("specific"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text || ' eyJ' || md5(text) || ' ' || sha256(text), 'eyJ[A-Za-z0-9+/=]{20,}', '[REDACTED]', 'g'),
       '\b[0-9a-fA-F]{32,}\b', '[REDACTED]', 'g'), '\b[A-Za-z0-9+]{40,}={0,2}\b', '[REDACTED]', 'g') AS text FROM documents""")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.concat(t, F.lit(" eyJ"), F.md5(F.encode(t, "UTF-8")), F.lit(" "), identity.text_sha256(t))).alias("text"))
