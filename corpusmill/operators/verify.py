"""Probes that a new generation must pass before readers see it, for many documents at once.

A topical probe finds the generation by search, a specific one by a word that it must
hold, a negative one makes sure that nonsense does not find it. Probes are rows
(document_id, ingest_generation, probe_type, query, expected, limit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import body_word, contains_folded, first_words, has_all_tokens, specific_word, words
from ..functions.vectors import cosine, hash_dense, hash_sparse
from ..plans.corpus_index import CorpusIndex, View
from ..plans.storage import stash

#: What names a generation.
KEY = ["document_id", "ingest_generation"]
#: Generations whose names are broadcast.
FEW = 1 << 18

# Queries that nothing should answer, of an ingest and of a later look.
NONSENSE = "xyzzy_nonexistent_term_for_negative_probe"
ANOTHER = "zxqjvf_wbhkm_plxnq_gjrtv_dfwck"


def derive_probes(docs: DataFrame, topical: int = 10, specific: int = 5, negative: int = 5) -> DataFrame:
    """Probes of documents (document_id, ingest_generation, title, raw_text).

    Topical: the title, where the text has a word of it, else the first ten words (a file
    may be named unlike its text); none gives no topical probe. Specific: the first telling word of the
    lines that are no headings, else of the text; none gives no specific probe.
    """
    text = F.coalesce("raw_text", F.lit(""))
    name = F.btrim(F.coalesce("title", F.lit("")))
    named = (name != "") & F.arrays_overlap(words(F.lower(name)), words(F.lower(text)))
    told = docs.select("document_id", "ingest_generation", body_word(text).alias("~word"), F.when(named, name).otherwise(first_words(text)).alias("~topic"))
    word = F.col("~word")
    probe = lambda kind, query, expected, limit: F.struct(F.lit(kind).alias("probe_type"), query.alias("query"), expected.alias("expected"), F.lit(limit).alias("limit"))
    none = F.lit(None).cast("string")
    made = F.array(probe("topical", F.col("~topic"), none, topical), probe("specific", word, word, specific), probe("negative", F.lit(NONSENSE), none, negative))
    return told.select("document_id", "ingest_generation", F.inline(made)).where("query <> ''")


def probes_of_chunks(chunks: DataFrame, topical: int = 10, specific: int = 5, negative: int = 5, nonsense: str = ANOTHER) -> DataFrame:
    """Probes of generations that are stored, from their chunks (document_id, ingest_generation, chunk_index, title, text).

    Topical: the title, else the first ten words of the first chunk. Specific: the first telling word of the first chunk that has one.
    """
    word = specific_word(F.coalesce("text", F.lit("")))
    told = chunks.groupBy(*KEY).agg(F.min_by(F.struct("title", "text"), F.col("chunk_index")).alias("~first"), F.min_by(word, F.when(word.isNotNull(), F.col("chunk_index"))).alias("~word"))
    query = F.coalesce(F.nullif(F.btrim("~first.title"), F.lit("")), first_words(F.coalesce("~first.text", F.lit(""))))
    none = F.lit(None).cast("string")
    probe = lambda kind, query, expected, limit: F.struct(F.lit(kind).alias("probe_type"), query.alias("query"), expected.alias("expected"), F.lit(limit).alias("limit"))
    made = F.array(probe("topical", query, none, topical), probe("specific", F.col("~word"), F.col("~word"), specific), probe("negative", F.lit(nonsense), none, negative))
    return told.select(*KEY, F.inline(made)).where("query <> ''")


def of_generations(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` of the generations that ``keys`` names; up to ``FEW`` are looked up where the rows lie, so that the others' texts and vectors are not shuffled."""
    keys = keys.select(*KEY).distinct()
    few = keys.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(keys) if few else keys, KEY, "left_semi")


def specific_results(probes: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, passed: a chunk of the generation has all tokens of the query and holds what is expected.

    Only the generation's own chunks are read: a word that is common elsewhere does no harm.
    """
    asked = probes.where("probe_type = 'specific'").select("document_id", "ingest_generation", "query", "expected")
    both = asked.join(chunks.select("document_id", "ingest_generation", "text"), ["document_id", "ingest_generation"], "left")
    text = F.coalesce("text", F.lit(""))
    hit = has_all_tokens(text, F.col("query")) & F.coalesce(contains_folded(text, F.col("expected")), F.lit(True))
    return both.groupBy("document_id", "ingest_generation").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("passed"))


def asked_for(probes: DataFrame, dense_dim: int, sparse_dim: int) -> DataFrame:
    """query (its text), dense, sparse, of the distinct queries of probes."""
    return probes.select("query").distinct().select("query", hash_dense(F.col("query"), dense_dim).alias("dense"), hash_sparse(F.col("query"), sparse_dim).alias("sparse"))


def found_by_search(probes: DataFrame, index: CorpusIndex, view: View, limit: int, rrf_k: int = 60, dense_dim: int = 1024, sparse_dim: int = 30_000) -> DataFrame:
    """document_id, ingest_generation, found: whether hybrid search in what ``view`` shows, for the
    probe's query, brings up the generation. Equal queries are searched once, all together.
    Rows of no likeness at all are no hits: nearest among equals would be a matter of ids."""
    hits, _ = index.hybrid(asked_for(probes, dense_dim, sparse_dim), limit, rrf_k, view, least=0.0)
    places = fetch_keys(index, hits.select("query", index.key)).select("query", *KEY).distinct().withColumn("found", F.lit(True))
    return probes.select("query", *KEY).join(places, ["query", *KEY], "left").select(*KEY, F.coalesce("found", F.lit(False)).alias("found"))


def fetch_keys(index: CorpusIndex, hits: DataFrame) -> DataFrame:
    """``hits`` with the generations of their rows."""
    return hits.join(index.entries.select(index.key, *KEY), index.key)


def found_by_rank(probes: DataFrame, index: CorpusIndex, view: View, limit: int, rrf_k: int = 60, dense_dim: int = 1024, sparse_dim: int = 30_000) -> DataFrame:
    """As :func:`found_by_search`, by counting what beats the generation's own chunks.

    The best score of a generation's own chunks for its query is a floor: only rows that
    reach it are looked for, and a chunk of it that is among the first ``limit`` of an arm
    has its true rank there. A chunk of ranks a and b is beaten after fusion only by rows
    that one of the arms puts before it, so by a + b - 2 at most: fewer than the limit, and
    the generation is found. In neither arm's first ``limit``, and it is not. Only what this leaves open is searched in full.
    """
    asked = stash(asked_for(probes, dense_dim, sparse_dim), "probes")
    mine = probes.select("query", *KEY).distinct()
    own = of_generations(view(index.entries), mine).join(mine, KEY).select("query", *KEY, index.key, F.col("dense").alias("~d"), F.col("sparse").alias("~s")).join(asked, "query")
    shared = F.array_intersect(F.col("sparse")["indices"], F.col("~s")["indices"])
    value = lambda of, i: F.get(F.col(of)["values"], (F.array_position(F.col(of)["indices"], i) - 1).cast("int")).cast("double")
    dotted = F.aggregate(shared, F.lit(0.0), lambda s, i: s + value("sparse", i) * value("~s", i))
    scores = stash(own.select("query", *KEY, index.key, F.round(cosine(F.col("~d"), F.col("dense")), 9).alias("near"), dotted.alias("dot")), "own")
    best = scores.groupBy("query", *KEY).agg(F.max("near").alias("near"), F.max("dot").alias("dot")).groupBy("query").agg(F.min("near").alias("near"), F.min("dot").alias("dot"))  # several documents may ask alike
    floors = best.where("near IS NOT NULL").select("query", (F.col("near") - 2e-9).alias("floor")), best.where("dot IS NOT NULL").select("query", (F.col("dot") - F.abs("dot") * 1e-9 - 1e-9).alias("floor"))
    dense, sparse = index.arms(asked, limit, view, 0.0, floors)
    ranks = scores.join(dense.select("query", index.key, F.col("rank").alias("a")), ["query", index.key], "left").join(sparse.select("query", index.key, F.col("rank").alias("b")), ["query", index.key], "left")
    told = ranks.groupBy("query", *KEY).agg(F.min(F.col("a") + F.col("b")).alias("both"), F.max(F.coalesce("a", "b")).alias("any"))
    sure = F.when(F.col("both") - 2 < limit, True).when(F.col("any").isNull(), False)
    judged = stash(mine.join(told, ["query", *KEY], "left").select("query", *KEY, sure.alias("found")), "judged")
    rest = found_by_search(judged.where("found IS NULL").select("query", *KEY), index, view, limit, rrf_k, dense_dim, sparse_dim)
    return judged.where("found IS NOT NULL").select(*KEY, "found").unionByName(rest)


def run_probes(probes: DataFrame, index: CorpusIndex, view: View, active: View, rrf_k: int = 60, topical: int = 10, negative: int = 5, dense_dim: int = 1024, sparse_dim: int = 30_000) -> DataFrame:
    """document_id, ingest_generation, topical, specific, negative, deferred, passed.

    ``view`` shows the verification view of the index, ``active`` the chunks that readers see. The
    negative probe is deferred, which passes, while other documents have fewer active
    chunks than its limit. A probe that was not asked passes.
    """
    sizes = {"dense_dim": dense_dim, "sparse_dim": sparse_dim}
    probes = stash(probes, "probes")
    top = found_by_rank(probes.where("probe_type = 'topical'"), index, view, topical, rrf_k, **sizes).withColumnRenamed("found", "topical")
    neg = found_by_search(probes.where("probe_type = 'negative'"), index, view, negative, rrf_k, **sizes).withColumnRenamed("found", "~absent")
    spec = specific_results(probes, of_generations(view(index.entries), probes)).withColumnRenamed("passed", "specific")
    seen = active(index.entries)
    own = seen.groupBy("document_id").agg(F.count("*").alias("~own"))
    total = seen.agg(F.count("*").alias("~all"))
    out = probes.select(*KEY).distinct().join(top, KEY, "left").join(spec, KEY, "left").join(neg, KEY, "left").join(own, "document_id", "left").crossJoin(total)  # one row
    deferred = F.col("~all") - F.coalesce("~own", F.lit(0)) < negative
    out = out.select(*KEY, F.coalesce("topical", F.lit(True)).alias("topical"), F.coalesce("specific", F.lit(True)).alias("specific"), (~F.coalesce("~absent", F.lit(False))).alias("negative"), deferred.alias("deferred"))
    return out.withColumn("passed", F.col("topical") & F.col("specific") & (F.col("negative") | F.col("deferred")))
