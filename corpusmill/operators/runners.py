"""Cases run against the engine: thresholds, least hits and expected verdicts, each a join. A row a case, with ``passed``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import gate_tokens, tokens
from ..functions.vectors import hash_dense, hash_sparse
from ..plans.corpus_index import CorpusIndex, View
from . import gates
from .evals import retrieval_metrics
from .postings import count_holding

KS = (1, 3, 5)


def run_retrieval(cases: DataFrame, index: CorpusIndex, view: View | None = None, limit: int = 10, k: int = 60, dense_dim: int = 1024, sparse_dim: int = 30_000) -> DataFrame:
    """case_id, mode, recall_at_1, recall_at_3, recall_at_5, mrr, hits, failed (names of what is too low), passed.

    All hybrid cases are one search, all lexical ones one look into the postings. A least
    reciprocal rank may stand beside the thresholds or among them.
    """
    named = cases.select(F.col("id").alias("case_id"), F.coalesce("query", "term", F.lit("")).alias("q"), F.coalesce("search_mode", F.lit("hybrid")).alias("mode"), "expected")
    hybrid, lexical = named.where("mode <> 'lexscan'"), named.where("mode = 'lexscan'")
    asked = hybrid.select(F.col("case_id").alias("query"), hash_dense(F.col("q"), dense_dim).alias("dense"), hash_sparse(F.col("q"), sparse_dim).alias("sparse"))
    found, _ = index.hybrid(asked, limit, k, view)
    ranked = found.join(index.entries.select(index.key, "document_id"), index.key).select(F.col("query").alias("case_id"), "document_id", "rank")
    gold = hybrid.select("case_id", F.explode("expected.relevant_document_ids").alias("document_id"))
    metrics = retrieval_metrics(hybrid, ranked, gold, KS)
    terms = lexical.select(F.col("case_id").alias("query"), tokens(F.col("q")).alias("tokens"))
    seen = index.entries if view is None else view(index.entries)
    hits = count_holding(index.tokens, terms, seen).withColumnRenamed("query", "case_id")

    wanted = F.col("expected.thresholds")
    low = lambda name, got, least: F.when(got < least, name)
    checks = [low(f"recall_at_{n}", F.col(f"recall_at_{n}"), wanted[f"recall_at_{n}"]) for n in KS]
    checks += [low("mrr", F.col("mrr"), F.coalesce("expected.min_mrr", wanted["min_mrr"])), low("hits", F.coalesce("hits", F.lit(0)), F.when(F.col("mode") == "lexscan", F.coalesce("expected.min_hits", F.lit(0))))]
    out = named.join(metrics, "case_id", "left").join(hits, "case_id", "left")
    failed = F.array_compact(F.array(*checks))
    return out.select("case_id", "mode", *(f"recall_at_{n}" for n in KS), "mrr", F.when(F.col("mode") == "lexscan", F.coalesce("hits", F.lit(0))).alias("hits"), failed.alias("failed"), (F.size(failed) == 0).alias("passed"))


def gate_tables(cases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """answers, citations and chunks, as the gates take them, of gate cases."""
    out, meta = F.col("synth_output.output"), F.col("synth_output.metadata")
    ledger = F.coalesce(meta["sub_query_ledger"], F.create_map().cast("map<string,string>"))
    answers = cases.select(F.col("id").alias("answer_id"), F.coalesce(out["answer"], F.lit("")).alias("answer"), meta["ask_type"].alias("mode"), out["coverage_verdict"].alias("coverage_verdict"), out["qualification"].alias("qualification"), ledger.alias("ledger"))
    citations = cases.select(F.col("id").alias("answer_id"), F.inline(out["citations"])).select("answer_id", F.coalesce("claim", F.lit("")).alias("claim"), F.coalesce("chunk_id", F.lit("")).alias("chunk_id"))
    chunks = cases.select(F.col("id").alias("answer_id"), F.inline("ranked_chunks")).where("point_id IS NOT NULL").select("answer_id", F.col("point_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    return answers, citations, chunks


GATES = ("all_claims_cited", "all_cited_ids_in_input", "groundedness_pass", "coverage_ledger_consistent")


def run_gates(cases: DataFrame) -> DataFrame:
    """case_id, the four gates, exit_code (0: all pass, else 1), failed (names of what is not as expected), passed."""
    verdicts = gates.overall(*gate_tables(cases)).withColumn("exit_code", F.when(F.col("overall"), 0).otherwise(1))
    both = verdicts.join(cases.select(F.col("id").alias("answer_id"), "expected"), "answer_id")
    other = lambda name: F.when(F.col(f"expected.{name}").isNotNull() & (F.col(name) != F.col(f"expected.{name}")), name)
    code = F.when(F.col("exit_code") != F.coalesce("expected.exit_code", F.lit(0)), "exit_code")
    failed = F.array_compact(F.array(code, *map(other, GATES)))
    return both.select(F.col("answer_id").alias("case_id"), *GATES, "exit_code", failed.alias("failed"), (F.size(failed) == 0).alias("passed"))


def gate_report(cases: DataFrame) -> DataFrame:
    """case_id, overall, the gates, the ids that were not given, and claims without a ground: their first 120
    characters and first ten key tokens."""
    answers, citations, chunks = gate_tables(cases)
    text = chunks.groupBy("answer_id", "chunk_id").agg(F.min("text").alias("~text"))
    claim: Column = gate_tokens(F.col("claim"))
    bare = citations.join(text, ["answer_id", "chunk_id"], "left").where((F.size(claim) > 0) & ~F.arrays_overlap(claim, gate_tokens(F.coalesce("~text", F.lit("")))))
    told = F.struct(F.substring("claim", 1, 120).alias("claim"), F.slice(F.array_sort(claim), 1, 10).alias("tokens"))
    claims = bare.groupBy("answer_id").agg(F.array_sort(F.collect_list(told)).alias("ungrounded"))
    ids = gates.cited_ids(answers, citations, chunks).select("answer_id", "bad_ids")
    out = gates.overall(answers, citations, chunks).join(ids, "answer_id").join(claims, "answer_id", "left")
    return out.withColumnRenamed("answer_id", "case_id")


def run_summaries(cases: DataFrame, least: float = 0.05, most: float = 0.95) -> DataFrame:
    """case_id, missing_sections, missing_entities, compression_in_bounds, failed, passed: the gate's verdict on each summary, against the expected one (true where none is given).

    Entities and bounds may stand in the case or in what it expects.
    """
    bounds = F.col("expected.compression_ratio_bounds")
    none = F.array().cast("array<string>")
    rows = cases.select(
        "id", F.coalesce("input.source", F.lit("")).alias("source"), F.coalesce("agent_output.output.summary_text", F.lit("")).alias("summary"), F.coalesce("expected.required_sections", none).alias("sections"),
        F.coalesce("must_contain_entities", "expected.must_contain_entities", none).alias("entities"), F.coalesce(bounds["min"], F.lit(least)).alias("least"), F.coalesce(bounds["max"], F.lit(most)).alias("most"),
        F.coalesce("expected.passed", F.lit(True)).alias("wanted"),
    )
    judged = gates.summary_gate(rows).drop("compression_in_bounds", "passed").join(rows.select("id", "source", "summary", "least", "most", "wanted"), "id")
    ratio = F.length("summary") / F.nullif(F.length("source"), F.lit(0))
    within = F.coalesce(ratio.between(F.col("least"), F.col("most")), F.lit(False))
    failed = F.array_compact(F.array(F.when(F.col("missing_sections") > 0, "missing_sections"), F.when(F.col("missing_entities") > 0, "missing_entities"), F.when(~within, "compression_in_bounds")))
    return judged.select(F.col("id").alias("case_id"), "missing_sections", "missing_entities", within.alias("compression_in_bounds"), failed.alias("failed"), ((F.size(failed) == 0) == F.col("wanted")).alias("passed"))
