"""A question asked in parts: every sub-query is searched, what they find is merged, and a ledger tells which found anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.corpus_index import CorpusIndex, View
from ..plans.storage import stash
from .postings import PLACE, count_holding, holding


def evidence(found: DataFrame, sub_queries: DataFrame, key: str = "point_id") -> DataFrame:
    """ask, key, score, sub_queries: each row once for a question, by its best score, and how many of its sub-queries found it.

    ``found``: query, key, score, as :func:`.search.hybrid_batch` gives them; ``sub_queries``: ask, query.
    """
    both = found.join(sub_queries.select("ask", "query").distinct(), "query")
    return both.groupBy("ask", key).agg(F.max("score").alias("score"), F.count("*").alias("sub_queries"))


def ledger(found: DataFrame, sub_queries: DataFrame) -> DataFrame:
    """ask, query, hits, status: ``answered`` where a sub-query found anything, else ``empty``."""
    return ledger_of(found.groupBy("query").agg(F.count("*").alias("hits")), sub_queries)


def ledger_of(hits: DataFrame, sub_queries: DataFrame) -> DataFrame:
    """As :func:`ledger`, of numbers of hits (query, hits)."""
    out = sub_queries.select("ask", "query").distinct().join(hits, "query", "left").select("ask", "query", F.coalesce("hits", F.lit(0)).alias("hits"))
    return out.withColumn("status", F.when(F.col("hits") > 0, "answered").otherwise("empty"))


def answer_parts(index: CorpusIndex, sub_queries: DataFrame, limit: int = 10, k: int = 60, view: View | None = None, least: float | None = 0.0) -> tuple[DataFrame, DataFrame]:
    """Evidence and ledger of all questions together: sub_queries are (ask, query, dense, sparse), ``view`` shows what readers see of the index.

    A sub-query of several questions is searched once. Rows of no likeness are no
    evidence, unless ``least`` is None: else no sub-query would ever be empty.
    """
    asked = sub_queries.select("query", "dense", "sparse").dropDuplicates(["query"])
    found, _ = index.hybrid(asked, limit, k, view, least)
    return evidence(found, sub_queries, index.key), ledger(found, sub_queries)


#: Kinds of questions. What a collection holds is listed in full; the others are searched for.
SEARCHED, LISTED = ("recall", "synthesis"), "enumeration"


def answer_routed(index: CorpusIndex, sub_queries: DataFrame, limit: int = 10, k: int = 60, view: View | None = None, least: float | None = 0.0) -> tuple[DataFrame, DataFrame]:
    """Evidence and ledger of questions of every kind: sub_queries are (ask, ask_type, query, text, dense, sparse).

    Recall and synthesis (of one and of several sub-queries) go through hybrid search, up to
    ``limit`` rows for each. An enumeration is exhaustive: all rows that hold all tokens of the text, from
    the postings, without a score. An unknown kind is taken as recall.
    """
    lists = F.coalesce(F.col("ask_type") == LISTED, F.lit(False))
    listed = sub_queries.where(lists)
    terms = stash(listed.select("query", tokens(F.coalesce("text", F.lit(""))).alias("tokens")).dropDuplicates(["query"]), "terms")
    rows = index.entries if view is None else view(index.entries)
    hits = count_holding(index.tokens, terms, rows)  # the ledger needs no rows; before the search, so that not all indices are there while that of tokens is built
    all_of = rows.select(*PLACE, index.key).join(holding(index.tokens, terms), PLACE).select("query", index.key, F.lit(None).cast("double").alias("score"))
    found, told = answer_parts(index, sub_queries.where(~lists), limit, k, view, least)
    return found.unionByName(evidence(all_of, listed, index.key)), told.unionByName(ledger_of(hits, listed))
