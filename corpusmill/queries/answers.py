"""Queries on the answer gates, the summary gate and the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import GATE_STOPWORDS, REFUSALS, gate_tokens
from ..operators import gates, journal
from ..streaming.streams import event_counts
from .base import query, table


def talks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as answers: an assistant's turn answers from its conversation's user turns, and cites the turn before."""
    turns = table(spark, sf_dir, "conversations")
    ident = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    name = lambda t: F.concat(F.lit("c"), t.cast("string"))
    said = turns.where("role = 'assistant'").select("conv_id", "turn", ident.alias("answer_id"), "text")
    heard = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("at"), F.col("text").alias("given"))
    answers = said.select(
        "answer_id", F.col("text").alias("answer"), F.when(F.col("turn") % 3 == 0, "enumeration").otherwise("synthesis").alias("mode"),
        F.when(F.col("turn") % 2 == 1, "partial").otherwise("complete").alias("coverage_verdict"), F.when(F.col("conv_id") % 2 == 0, "some is missing").alias("qualification"),
        F.create_map(F.lit("a"), F.when(F.col("turn") % 4 == 1, "empty").otherwise("answered")).alias("ledger"),
    )
    citations = said.select("answer_id", F.concat(F.lit("Claim. "), F.col("text")).alias("claim"), name(F.col("turn") - 1).alias("chunk_id"))
    chunks = said.join(heard, "conv_id").select("answer_id", name(F.col("at")).alias("chunk_id"), F.col("given").alias("text"))
    return answers, citations, chunks


TALKS = """
said AS (SELECT *, conv_id || '/' || turn AS answer_id FROM conversations WHERE role = 'assistant'),
chunks AS (SELECT answer_id, 'c' || u.turn AS chunk_id, u.text FROM said s JOIN conversations u ON u.conv_id = s.conv_id AND u.role = 'user'),
citations AS (SELECT answer_id, 'Claim. ' || text AS claim, 'c' || (turn - 1) AS chunk_id FROM said)"""


def sql_tokens(column: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({column}), '[^a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({GATE_STOPWORDS}, w)))"


@query(f"WITH {TALKS} SELECT c.answer_id, bool_and(EXISTS (FROM chunks k WHERE k.answer_id = c.answer_id AND k.chunk_id = c.chunk_id)) AS passed FROM citations c GROUP BY 1")
def gate_cited_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.cited_ids(*talks(spark, sf_dir)).select("answer_id", "passed")


@query(f"""
WITH {TALKS}, t AS (SELECT c.answer_id, {sql_tokens('claim')} AS a, {sql_tokens("coalesce(k.text, '')")} AS b FROM citations c LEFT JOIN chunks k USING (answer_id, chunk_id))
SELECT answer_id, count(*) FILTER (len(a) > 0 AND NOT list_has_any(a, b)) = 0 AS passed, count(*) FILTER (len(a) > 0 AND NOT list_has_any(a, b))::BIGINT AS failures FROM t GROUP BY 1""")
def gate_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.grounded(*talks(spark, sf_dir))


@query(rf"""
WITH {TALKS},
parts AS (SELECT answer_id, turn, unnest(string_split(regexp_replace(regexp_replace(text, '(?i)\[source:[^\]]+\]', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM said),
sent AS (SELECT *, {sql_tokens('s')} AS t FROM parts WHERE trim(s) <> ''),
claims AS (SELECT * FROM sent WHERE len(t) > 0 AND NOT ({' OR '.join("contains(lower(s), '" + r.replace("'", "''") + "')" for r in REFUSALS)})),
cited AS (SELECT answer_id, {sql_tokens('claim')} AS c FROM citations WHERE trim(claim) <> ''),
unread AS (SELECT answer_id FROM said WHERE turn % 3 = 0 AND answer_id NOT IN (SELECT answer_id FROM chunks)),
alone AS (SELECT answer_id, count(*) AS n FROM claims JOIN cited USING (answer_id) WHERE NOT list_has_all(c, t) GROUP BY 1),
whole AS (SELECT answer_id, list_distinct(flatten(list(t))) AS u FROM claims GROUP BY 1),
beyond AS (SELECT answer_id, count(*) AS n FROM cited JOIN whole USING (answer_id) WHERE NOT list_has_all(u, c) GROUP BY 1)
SELECT s.answer_id, coalesce(CASE WHEN u.answer_id IS NOT NULL THEN 0 WHEN s.turn % 3 = 0 THEN b.n ELSE a.n END, 0) = 0 AS passed,
  coalesce(CASE WHEN u.answer_id IS NOT NULL THEN 0 WHEN s.turn % 3 = 0 THEN b.n ELSE a.n END, 0)::BIGINT AS uncited
FROM said s LEFT JOIN alone a USING (answer_id) LEFT JOIN beyond b USING (answer_id) LEFT JOIN unread u USING (answer_id)""")
def gate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.claims_cited(*talks(spark, sf_dir))


@query("""
SELECT conv_id || '/' || turn AS answer_id, NOT (turn % 4 = 1) OR (turn % 2 = 1 AND conv_id % 2 = 0) AS passed FROM conversations WHERE role = 'assistant'""")
def gate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.coverage(talks(spark, sf_dir)[0])


@query(f"SELECT doc_id, array_to_string(list_sort({sql_tokens('text')}), ' ') AS tokens FROM documents")
def key_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(gate_tokens(F.col("text"))), " ").alias("tokens"))


@query("""
WITH s AS (SELECT doc_id, text AS source, array_to_string(string_split(text, ' ')[1:40], ' ') AS summary, lang FROM documents)
SELECT doc_id AS id, (CASE WHEN contains(summary, lang) THEN 0 ELSE 1 END + CASE WHEN contains(summary, 'The') THEN 0 ELSE 1 END)::BIGINT AS missing_sections,
       (CASE WHEN contains(lower(summary), 'que') THEN 0 ELSE 1 END)::BIGINT AS missing_entities,
       coalesce(length(summary)::DOUBLE / nullif(length(source), 0) BETWEEN 0.05 AND 0.95, false) AS compression_in_bounds,
       contains(summary, lang) AND contains(summary, 'The') AND contains(lower(summary), 'que') AND coalesce(length(summary)::DOUBLE / nullif(length(source), 0) BETWEEN 0.05 AND 0.95, false) AS passed
FROM s""")
def summary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 words of a document as its summary."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("source"), F.substring_index("text", " ", 40).alias("summary"), F.array("lang", F.lit("The")).alias("sections"), F.array(F.lit("QUE")).alias("entities"))
    return gates.summary_gate(rows)


def as_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.when(F.col("event_type") == "signup", "RUN_START").when(F.col("event_type") == "click", "DISPATCH_START").when(F.col("event_type") == "error", "GATE_FAIL").otherwise("TELEMETRY")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", event.alias("event"), F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"), "value", "props")


JOURNAL = """journal AS (
  SELECT event_id AS id, ts, CASE event_type WHEN 'signup' THEN 'RUN_START' WHEN 'click' THEN 'DISPATCH_START' WHEN 'error' THEN 'GATE_FAIL' ELSE 'TELEMETRY' END AS event, 'run' || user_id AS run_id, value, props FROM events)"""


@query(f"WITH {JOURNAL} SELECT id, event, run_id FROM journal ORDER BY id DESC LIMIT 25")
def journal_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.recent_events(as_journal(spark, sf_dir), 25).select("id", "event", "run_id")


@query(f"""
WITH {JOURNAL}, begun AS (SELECT * FROM journal WHERE event = 'RUN_START' ORDER BY ts DESC, id DESC LIMIT 25)
SELECT id, run_id, (SELECT count(*) FROM journal j WHERE j.event = 'DISPATCH_START' AND j.run_id = begun.run_id)::BIGINT AS dispatch_count FROM begun""")
def journal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.recent_runs(as_journal(spark, sf_dir), 25).select("id", "run_id", "dispatch_count")


@query(f"""
WITH {JOURNAL} SELECT id, event, CASE WHEN event = 'DISPATCH_START' THEN json_extract_string(props, '$.k') WHEN event = 'GATE_FAIL' THEN run_id END AS source,
  CASE WHEN event = 'GATE_FAIL' THEN '[REDACTED]' END AS document_id FROM journal""")
def journal_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details that the event may not carry go; secrets are blanked."""
    rows = as_journal(spark, sf_dir)
    secret = F.sha2(F.encode("run_id", "UTF-8"), 256)
    source = F.when(F.col("event") == "GATE_FAIL", F.col("run_id")).otherwise(F.get_json_object("props", "$.k"))
    detail = F.create_map(F.lit("source"), source, F.lit("document_id"), secret, F.lit("props"), F.col("props"))
    blank = F.lit(None).cast("string")
    made = journal.prepared(rows.select("id", "event", detail.alias("detail"), *(blank.alias(c) for c in journal.FREE_TEXT)))
    return made.select("id", "event", F.try_element_at("detail", F.lit("source")).alias("source"), F.try_element_at("detail", F.lit("document_id")).alias("document_id"))


@query(f"WITH {JOURNAL} SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS hour, event, count(*)::BIGINT AS n FROM journal GROUP BY 1, 2")
def journal_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator runs on a stream."""
    return event_counts(as_journal(spark, sf_dir)).select(F.unix_timestamp("window_start").alias("hour"), "event", "n")
