"""Command line over a corpus table: ingest, search, lexscan, scroll, verify, status, gc; gates and cases; the journal. Prints JSON lines.

Exit codes: 0 done, 1 a path, gate or case failed, or a document is unknown, 2 wrong usage or
input that cannot be read, 3 another writer is at work, 4 a document's probes failed, 5 the
table's own files contradict each other.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import hash_dense, hash_sparse
from .operators import lexical, runners, search, verify, visibility
from .operators.journal import DETAILS, FIELDS, Journal
from .plans.corpus_table import CorpusTable
from .plans.ingest import ingest, report_totals
from .schemas import CITATION
from .settings import Settings, load_settings
from .sources.cases import NoCases, read_cases
from .sources.readers import override_source, read_documents, read_files
from .sources.routing import registered_source_types


def show(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusmill")
    out.add_argument("--table", help="the corpus table's folder; the journal's verbs take the journal's")
    verbs = out.add_subparsers(dest="verb", required=True)
    add = verbs.add_parser("ingest")
    add.add_argument("paths", nargs="+")
    add.add_argument("--source-id")
    add.add_argument("--source-type", help="for files of unknown kind: take them as this type")
    add.add_argument("--producer")
    add.add_argument("--tag", action="append", default=[])
    add.add_argument("--force", action="store_true")
    for verb in ("search", "lexscan", "scroll"):
        p = verbs.add_parser(verb)
        if verb != "scroll":
            p.add_argument("query")
        else:
            p.add_argument("--source-type")
        p.add_argument("--source-id")
        p.add_argument("--document-path")
        p.add_argument("--since")
        p.add_argument("--tag", action="append", default=[])
        p.add_argument("--limit" if verb == "search" else "--count", **({"type": int} if verb == "search" else {"action": "store_true"}))
    look = verbs.add_parser("verify")
    look.add_argument("document_id")
    look.add_argument("--generation", type=int)
    verbs.add_parser("status")
    verbs.add_parser("gc")
    gate = verbs.add_parser("gate")
    gate.add_argument("cases", nargs="+")
    run = verbs.add_parser("cases")
    run.add_argument("kind", choices=["retrieval", "gates", "summaries"])
    run.add_argument("cases", nargs="+")
    note = verbs.add_parser("journal")
    note.add_argument("event", nargs="?")
    note.add_argument("--list", type=int, dest="last")
    note.add_argument("--runs", type=int)
    for name in [*FIELDS, *sorted({k for keys in DETAILS.values() for k in keys})]:
        note.add_argument("--" + name.replace("_", "-"))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args, settings = parser().parse_args(argv), load_settings()
    if args.verb not in ("gate",) and not args.table and not (args.verb == "cases" and args.kind != "retrieval"):
        print(json.dumps({"error": "--table is needed"}), file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.verb in ("gate", "cases"):
            return run_cases(spark, args, settings)
        if args.verb == "journal":
            return note(Journal(spark, args.table), args)
        return over_table(spark, CorpusTable(spark, args.table), args, settings)
    except NoCases as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 2


def run_cases(spark: SparkSession, args: argparse.Namespace, settings: Settings) -> int:
    """Run the cases of some files: 0 if all are as expected, or (``gate``) pass."""
    kind = "gates" if args.verb == "gate" else args.kind
    cases = read_cases(spark, kind, *args.cases)
    if args.verb == "gate":
        out = runners.gate_report(cases).withColumn("passed", F.col("overall"))
    elif kind == "retrieval":
        table = CorpusTable(spark, args.table)
        out = runners.run_retrieval(cases, table.index(), table.view(table.heads()), settings.search_limit, settings.rrf_k, settings.dense_dim, settings.sparse_dim)
    else:
        out = runners.run_gates(cases) if kind == "gates" else runners.run_summaries(cases)
    rows = [json.loads(x) for x in out.orderBy("case_id").toJSON().collect()]  # a row a case of the files
    print(json.dumps({"cases": len(rows), "passed": sum(r["passed"] for r in rows)}))
    for r in rows:
        print(json.dumps(r))
    return 0 if all(r["passed"] for r in rows) else 1


def note(journal: Journal, args: argparse.Namespace) -> int:
    """Append an event, or show the last events or runs. An event that is unknown is told, but no failure: a journal never stops a run."""
    if args.last is not None or args.runs is not None:
        print(json.dumps(journal.recent(args.last) if args.last is not None else journal.runs(args.runs)))
        return 0
    if not args.event:
        print(json.dumps({"error": "an event is needed"}), file=sys.stderr)
        return 2
    whole, real = {"escalated", "tokens", "dispatches", "dispatches_used", "indexed", "failed", "paths"}, {"gate_score", "spend"}
    fields: dict[str, object] = {}
    for name in [*FIELDS, *sorted({k for keys in DETAILS.values() for k in keys})]:
        value = getattr(args, name)
        if value is None:
            continue
        try:
            fields[name] = int(value) if name in whole else float(value) if name in real else value
        except ValueError:
            if name not in FIELDS:  # a detail may be of any kind, a field may not
                fields[name] = value
    try:
        print(json.dumps(journal.append_event(args.event, **fields)))
    except ValueError as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
    return 0


def look_again(table: CorpusTable, document_id: str, generation: int | None, settings: Settings) -> int:
    """Run the probes of a stored generation against what readers see: 4 if one fails."""
    generation = table.max_active_generation(document_id) if generation is None else generation
    rows = table.generation(document_id, generation) if generation is not None else None
    if rows is None or rows.isEmpty():
        print(json.dumps({"error": "not_found", "document_id": document_id, "generation": generation}))
        return 1
    probes = verify.probes_of_chunks(rows, settings.topical_limit, settings.specific_limit, settings.negative_limit)
    states = table.states().where("ingest_state = 'active'")
    sizes = {"dense_dim": settings.dense_dim, "sparse_dim": settings.sparse_dim}
    out = verify.run_probes(probes, table.index(), table.view(states), table.view(table.heads()), settings.rrf_k, settings.topical_limit, settings.negative_limit, **sizes).first().asDict()
    asked = {r.probe_type: r.query for r in probes.collect()}  # three rows
    print(json.dumps(out | {"probes": asked, "index_suspect": not out["passed"]}))
    return 0 if out["passed"] else 4


def over_table(spark: SparkSession, table: CorpusTable, args: argparse.Namespace, settings: Settings) -> int:
    if args.verb == "ingest":
        if args.source_type is not None and args.source_type not in registered_source_types():
            print(json.dumps({"error": f"no loader for {args.source_type!r}; there are {registered_source_types()}"}), file=sys.stderr)
            return 2
        files = read_files(spark, *args.paths)
        if args.source_type is not None:
            unknown = F.col("sniffed") | F.col("source_type").isNull()
            files = files.withColumns({"source_type": F.when(unknown, F.lit(args.source_type)).otherwise(F.col("source_type")), "error": F.when(~unknown, F.col("error")), "sniffed": F.lit(False)})
        docs = read_documents(files)
        if args.source_id:
            docs = override_source(docs, args.source_id, None if docs.count() == 1 else args.paths[0])
        try:
            report = ingest(table, docs, tuple(args.tag), settings, args.producer, args.force)
        except FileExistsError as e:
            print(json.dumps({"error": str(e)}), file=sys.stderr)
            return 3
        totals = report_totals(report)
        print(json.dumps(totals))
        show(report)
        return 4 if totals["index_suspect_count"] else 1 if totals["error_count"] else 0
    if args.verb == "gc":
        try:
            print(json.dumps(table.gc()))
        except FileExistsError as e:
            print(json.dumps({"error": str(e)}), file=sys.stderr)
            return 3
        return 0
    if args.verb == "status":
        told = table.status().first()
        print(json.dumps(told.asDict() | {"table_path": args.table}, default=str))
        return 5 if told.table_exists and not told.healthy else 0
    if args.verb == "verify":
        return look_again(table, args.document_id, args.generation, settings)
    wanted = visibility.matches(args.source_id, args.document_path, args.since, args.tag, getattr(args, "source_type", None))
    heads = table.view(table.heads())
    view = lambda rows: heads(rows).where(wanted)
    if args.verb == "scroll":
        rows = table.visible().where(wanted)
        if args.count:
            show(rows.agg(F.count_distinct("document_id").alias("document_count"), F.count("*").alias("chunk_count")))
        show(lexical.scroll(rows, ["document_path", "source_id", "source_type", "title", "producer", "ingested_at", "ingest_generation", "tags"]))
    elif args.verb == "lexscan":
        found = table.index().lexscan(args.query, view)
        show(lexical.scan_counts(found).withColumn("term", F.lit(args.query)))
        if not args.count:
            show(found.select(*CITATION, "occurrences"))
    else:
        asked = spark.range(1).select(F.lit(args.query).alias("query"), hash_dense(F.lit(args.query), settings.dense_dim).alias("dense"), hash_sparse(F.lit(args.query), settings.sparse_dim).alias("sparse"))
        index = table.index()
        found, counts = index.hybrid(asked, args.limit or settings.search_limit, settings.rrf_k, view)
        rows = view(index.entries).join(F.broadcast(found.select(index.key, "score")), index.key)  # as many as the limit
        citationable = (F.length("text") > 0) & (F.length("document_path") > 0)
        n = rows.agg(F.count("*").alias("candidate_count"), F.count_if(citationable).alias("citationable_count"))
        hits = counts.agg(F.coalesce(F.sum("dense_hits"), F.lit(0)).alias("dense_hits"), F.coalesce(F.sum("sparse_hits"), F.lit(0)).alias("sparse_hits"))
        show(hits.crossJoin(n).withColumn("passes_gate", search.passes_gate()))  # one row each
        show(rows.orderBy(F.desc("score"), index.key).select("score", *CITATION))
    return 0


if __name__ == "__main__":
    sys.exit(main())
