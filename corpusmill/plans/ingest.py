"""Ingest: a batch of documents becomes a new generation of each that changed, after its probes pass."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import point_id
from ..operators import chunking, embedding, reports, verify, visibility
from ..settings import Settings
from .corpus_table import CorpusTable, single_writer


def fixed(table: CorpusTable, df: DataFrame) -> DataFrame:
    """``df`` as it is now, written beside the table: a cached plan would be computed anew once the table changes."""
    path = f"{table.path}/work/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return table.spark.read.schema(df.schema).parquet(path)


def ingest(table: CorpusTable, documents: DataFrame, tags: tuple[str, ...] = (), settings: Settings = Settings(), producer: str | None = None, force: bool = False) -> DataFrame:
    """One report row a document: path, document_id, outcome, generation, chunk_count, loader_verdict, detail.

    Encrypted, scanned and unreadable documents are skipped or errors. A document whose
    content is that of its active generation is a no-op (unless ``force``). The rest
    are chunked, embedded and written; those whose probes pass, and whose chunks are all
    there, are published in one write to the state log, the others stay invisible and
    marked failed. If a step raises, nothing is published and the whole write is marked failed.
    """
    with single_writer(table.spark, table.path):
        table.ensure(settings.dense_dim, settings.sparse_dim)
        heads = table.heads().select("document_id", "document_sha256", F.col("ingest_generation").alias("newest"))  # from the log: no chunk is read
        plan = visibility.with_next_generation(documents.dropDuplicates(["document_id"]), heads)
        if force:
            plan = plan.withColumn("generation", F.when(F.col("no_op"), F.col("generation") + 1).otherwise(F.col("generation"))).withColumn("no_op", F.lit(False))
        verdict = F.col("loader_verdict")
        first = F.when(verdict == "error", "error").when(verdict.isin("encrypted", "scanned"), "skipped").when(F.col("no_op"), "no_op")
        plan = fixed(table, plan.withColumn("outcome", first))
        new = plan.where("outcome IS NULL")
        cut = chunking.chunk_documents(new, settings.window_words, settings.overlap_words, settings.least_tail_words)
        numbered = cut.join(new.select("document_id", F.col("generation").cast("int").alias("ingest_generation")), "document_id")
        if producer is not None:
            numbered = numbered.withColumn("producer", F.lit(producer))
        filled = numbered.withColumns({
            "point_id": point_id(F.col("document_id"), F.col("document_sha256"), F.col("chunk_index")),
            "tags": F.array(*map(F.lit, tags)).cast("array<string>"), "ingested_at": F.current_timestamp(),
        })
        key, write_id = ["document_id", "ingest_generation"], uuid.uuid4().hex
        mine = new.select("document_id", F.col("generation").cast("int").alias("ingest_generation"), "title", "raw_text", "document_sha256")
        # announced first: chunks that an earlier, broken write left for these generations are no longer read
        table.set_states(mine, "pending", write_id)
        try:
            table.append(embedding.embed_hashing(filled, settings.dense_dim, settings.sparse_dim), write_id)
            judged = judge(table, mine, settings)
            table.set_states(judged.where("`~passed` AND chunk_count > 0"), "active", write_id)
            table.set_states(judged.where("NOT `~passed`"), "failed", write_id)
        except BaseException:
            table.set_states(mine, "failed", write_id)
            raise
        result = plan.join(judged.select("document_id", "chunk_count", "~passed", "topical", "specific", "negative", "whole"), "document_id", "left")
        outcome = F.coalesce("outcome", F.when(F.col("~passed"), F.lit("success")).otherwise(F.lit("index_suspect")))
        failed = F.concat_ws(", ", *(F.when(~F.col(p), F.lit(p)) for p in ("topical", "specific", "negative", "whole")))
        report = result.select(
            F.col("document_path").alias("path"), "document_id", outcome.alias("outcome"), F.col("generation").cast("int").alias("generation"),
            F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "loader_verdict", F.coalesce("error", F.when(outcome == "index_suspect", failed)).alias("detail"),
        )
        path = f"{table.path}/reports"
        report.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
        at = table.spark.read.parquet(path).agg(F.max("at")).first()[0]
        return table.spark.read.parquet(path).where(F.col("at") == F.lit(at)).drop("at")


def judge(table: CorpusTable, mine: DataFrame, settings: Settings) -> DataFrame:
    """document_id, ingest_generation, topical, specific, negative, chunk_count, whole, ~passed of pending generations.

    ``whole``: chunks number 0 to the last one are there, once each. A document without
    any words has no chunk: nothing to find, nothing to publish, so it passes.
    """
    key, index, states = ["document_id", "ingest_generation"], table.index(), fixed(table, table.states())
    own = states.join(mine.select(*key), key, "left_semi")
    view, active = table.view(states.where("ingest_state = 'active'").unionByName(own.where("ingest_state <> 'active'"))), table.view(fixed(table, table.heads()))
    written = table.view(own)(index.entries)
    probes = fixed(table, verify.derive_probes(mine, settings.topical_limit, settings.specific_limit, settings.negative_limit))
    sizes = {"dense_dim": settings.dense_dim, "sparse_dim": settings.sparse_dim}
    checked = verify.run_probes(probes, index, view, active, settings.rrf_k, settings.topical_limit, settings.negative_limit, **sizes)
    whole = (F.count("*") == F.max("chunk_index") + 1) & (F.count_distinct("chunk_index") == F.count("*"))
    counts = written.groupBy(*key).agg(F.count("*").alias("chunk_count"), whole.alias("whole"))
    both = mine.select(*key).join(checked, key, "left").join(counts, key, "left")
    passed = F.col("chunk_count").isNull() | (F.coalesce("passed", F.lit(False)) & F.col("whole"))
    return fixed(table, both.withColumn("~passed", passed))


def report_totals(report: DataFrame) -> dict[str, int]:
    """Counts of paths by their worst outcome."""
    return reports.totals(reports.by_path(report)).first().asDict()
