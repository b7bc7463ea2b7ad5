"""Deterministic gates over cited answers.

Tables: ``answers`` (answer_id, answer, mode, coverage_verdict, qualification, ledger
map<string,string>), ``citations`` (answer_id, claim, chunk_id) and ``chunks``
(answer_id, chunk_id, text): what an answer was given to work with. Each gate returns
a row for each answer. An answer's citations and chunks meet by its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import gate_tokens, is_refusal, sentences


def cited_ids(answers: DataFrame, citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """answer_id, passed, bad_ids: whether every cited chunk was among those given."""
    missing = citations.join(chunks.select("answer_id", "chunk_id").distinct(), ["answer_id", "chunk_id"], "left_anti")
    bad = missing.groupBy("answer_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("bad_ids"))
    out = answers.select("answer_id").join(bad, "answer_id", "left")
    return out.select("answer_id", F.col("bad_ids").isNull().alias("passed"), F.coalesce("bad_ids", F.array().cast("array<string>")).alias("bad_ids"))


def grounded(answers: DataFrame, citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """answer_id, passed, failures: every claim with key tokens shares one with its chunk."""
    text = chunks.groupBy("answer_id", "chunk_id").agg(F.min("text").alias("~text"))
    both = citations.join(text, ["answer_id", "chunk_id"], "left")
    claim = gate_tokens(F.col("claim"))
    fails = both.where((F.size(claim) > 0) & ~F.arrays_overlap(claim, gate_tokens(F.coalesce("~text", F.lit("")))))
    counted = fails.groupBy("answer_id").agg(F.count("*").alias("failures"))
    return answers.select("answer_id").join(counted, "answer_id", "left").select("answer_id", F.col("failures").isNull().alias("passed"), F.coalesce("failures", F.lit(0)).alias("failures"))


def claims_cited(answers: DataFrame, citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """answer_id, passed, uncited: every sentence that claims something lies in one citation's claim.

    In mode "enumeration" each citation's claim must lie in the answer instead, and an
    answer that was given no chunks passes. Blank claims are no citations. Sentences that refuse, or have no key tokens, claim nothing; an answer without
    claims passes. With claims but no citations an answer fails.
    """
    cited = citations.where(F.btrim("claim") != "").groupBy("answer_id").agg(F.collect_list(gate_tokens(F.col("claim"))).alias("~cited"))
    given = chunks.select("answer_id").distinct().withColumn("~given", F.lit(True))
    both = answers.select("answer_id", "mode", sentences(F.coalesce("answer", F.lit(""))).alias("~all")).join(cited, "answer_id", "left").join(given, "answer_id", "left")
    sets = F.coalesce("~cited", F.array().cast("array<array<string>>"))
    made = F.filter(F.transform(F.filter("~all", lambda s: ~is_refusal(s)), gate_tokens), lambda t: F.size(t) > 0)
    both = both.select("answer_id", F.col("mode").eqNullSafe("enumeration").alias("~lists"), F.col("~given").isNull().alias("~none"), sets.alias("~sets"), made.alias("~claims"))
    claims, sets = F.col("~claims"), F.col("~sets")
    alone = F.filter(claims, lambda t: ~F.exists(sets, lambda c: F.size(F.array_except(t, c)) == 0))
    union = F.array_distinct(F.flatten(claims))
    beyond = F.filter(sets, lambda c: F.size(F.array_except(c, union)) > 0)
    listed = F.col("~lists") & (F.size(sets) > 0)
    uncited = F.when((F.size(claims) == 0) | (F.col("~lists") & F.col("~none")), 0).when(listed, F.size(beyond)).otherwise(F.size(alone))
    return both.select("answer_id", uncited.alias("uncited")).select("answer_id", (F.col("uncited") == 0).alias("passed"), F.col("uncited").cast("long").alias("uncited"))


def coverage(answers: DataFrame) -> DataFrame:
    """answer_id, passed: an answer with an empty sub-query says that it is partial, and how."""
    empty = F.exists(F.map_values("ledger"), lambda v: v == "empty")
    told = (F.col("coverage_verdict") == "partial") & F.col("qualification").isNotNull()
    return answers.select("answer_id", (~F.coalesce(empty, F.lit(False)) | F.coalesce(told, F.lit(False))).alias("passed"))


def overall(answers: DataFrame, citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """answer_id, the four gates and their conjunction."""
    out = answers.select("answer_id")
    gates = {"all_claims_cited": claims_cited(answers, citations, chunks), "all_cited_ids_in_input": cited_ids(answers, citations, chunks), "groundedness_pass": grounded(answers, citations, chunks), "coverage_ledger_consistent": coverage(answers)}
    for name, gate in gates.items():
        out = out.join(gate.select("answer_id", F.col("passed").alias(name)), "answer_id")
    return out.withColumn("overall", F.expr(" AND ".join(gates)))


def summary_gate(summaries: DataFrame, least: float = 0.05, most: float = 0.95) -> DataFrame:
    """(id, source, summary, sections, entities) to id and what is missing of a summary.

    Lengths in characters; a source without text has no ratio and fails.
    """
    ratio = F.length("summary") / F.nullif(F.length("source"), F.lit(0))
    lost = F.filter("sections", lambda s: ~F.contains(F.col("summary"), s))
    gone = F.filter("entities", lambda e: ~F.contains(F.lower("summary"), F.lower(e)))
    bounds = F.coalesce(ratio.between(least, most), F.lit(False))
    return summaries.select("id", F.size(lost).cast("long").alias("missing_sections"), F.size(gone).cast("long").alias("missing_entities"), bounds.alias("compression_in_bounds"), ((F.size(lost) == 0) & (F.size(gone) == 0) & bounds).alias("passed"))
