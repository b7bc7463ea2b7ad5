"""Case files and their runners, the journal's folder, and the commands over them."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusmill.operators import runners
from corpusmill.operators.journal import Journal, redact_variant, without_secrets
from corpusmill.plans.corpus_index import build_index
from corpusmill.queries.prepared import with_vectors
from corpusmill.sources.cases import NoCases, read_cases

PATH = "library/strategy.md"


def gate_case(name, answer, citations, code, ledger=None, verdict="complete", note=None, kind="recall", text="The team chose blue-green deployment to keep the service up.", **expected):
    cited = [{"claim": c, "chunk_id": i, "document_path": PATH} for c, i in citations]
    return {
        "id": name,
        "synth_output": {"output": {"answer": answer, "citations": cited, "coverage_verdict": verdict, "qualification": note}, "metadata": {"ask_type": kind, "sub_query_ledger": ledger or {}}},
        "ranked_chunks": [{"point_id": "c1", "text": text}],
        "expected": {"exit_code": code, **expected},
    }


CLAIM = "Blue-green deployment was chosen."
GATE_CASES = [
    gate_case("ids_pass", CLAIM, [(CLAIM, "c1")], 0, all_cited_ids_in_input=True, groundedness_pass=True, coverage_ledger_consistent=True),
    gate_case("ids_fail", CLAIM, [(CLAIM, "c9")], 1, all_cited_ids_in_input=False),
    gate_case("uncited", CLAIM + " Token buckets limit the rate.", [(CLAIM, "c1")], 1, all_claims_cited=False),
    gate_case("ungrounded", "Whales sing songs.", [("Whales sing songs.", "c1")], 1, groundedness_pass=False),
    gate_case("covered", CLAIM, [(CLAIM, "c1")], 0, ledger={"a": "answered", "b": "empty"}, verdict="partial", note="nothing on b", coverage_ledger_consistent=True),
    gate_case("not_covered", CLAIM, [(CLAIM, "c1")], 1, ledger={"b": "empty"}, coverage_ledger_consistent=False),
]


def write(path, cases, as_json=False):
    import yaml

    data = {"schema_version": 1, "cases": cases}
    path.write_text(json.dumps(data) if as_json else yaml.safe_dump(data))
    return str(path)


@pytest.mark.parametrize("as_json", [False, True])
def test_gate_cases(spark, tmp_path, as_json):
    cases = read_cases(spark, "gates", write(tmp_path / "g.yaml", GATE_CASES, as_json))
    got = {r.case_id: r for r in runners.run_gates(cases).collect()}
    assert len(got) == 6 and all(r.passed and not r.failed for r in got.values())
    assert {k for k, r in got.items() if r.exit_code} == {"ids_fail", "uncited", "ungrounded", "not_covered"}
    wrong = [c | {"expected": {"exit_code": 0, "groundedness_pass": False}} for c in GATE_CASES]
    bad = {r.case_id: r.failed for r in runners.run_gates(read_cases(spark, "gates", write(tmp_path / "w.yaml", wrong))).collect()}
    assert bad["ids_pass"] == ["groundedness_pass"] and bad["ungrounded"] == ["exit_code"] and bad["uncited"] == ["exit_code", "groundedness_pass"]
    told = {r.case_id: r for r in runners.gate_report(cases).collect()}
    assert told["ids_fail"].bad_ids == ["c9"] and [tuple(x) for x in told["ungrounded"].ungrounded] == [("Whales sing songs.", ["sing", "songs", "whales"])] and told["ids_pass"].ungrounded is None


def test_retrieval_cases(spark, tmp_path):
    texts = {"d1": "the migration went blue green with two fleets", "d2": "token buckets limit the rate of requests", "d3": "whales sing songs at night"}
    rows = spark.createDataFrame([(f"p-{d}", d, t, True) for d, t in texts.items()], "point_id string, document_id string, text string, seen boolean")
    index = build_index(with_vectors(rows), ("seen",))
    case = lambda name, query, gold, mode="hybrid", **more: {"id": name, "query": query, "search_mode": mode, "expected": {"relevant_document_ids": gold, **more}}
    cases = [
        case("first", "blue green migration", ["d1"], thresholds={"recall_at_1": 1.0, "min_mrr": 0.9}),
        case("rate", "rate of requests", ["d2"], thresholds={"recall_at_1": 1.0}, min_mrr=0.9),
        case("wrong", "whales songs", ["d1"], thresholds={"recall_at_1": 1.0, "min_mrr": 0.9}),
        case("no_gold", "anything", [], thresholds={"recall_at_5": 1.0}),
        case("lex", "The", [], "lexscan", min_hits=2),
        case("lex_low", "whales requests", [], "lexscan", min_hits=1),
        {"id": "lex_any", "term": "nothing", "search_mode": "lexscan", "expected": {}},
    ]
    got = {r.case_id: r for r in runners.run_retrieval(read_cases(spark, "retrieval", write(tmp_path / "r.yaml", cases)), index, lambda r: r.where("seen")).collect()}
    assert {k for k, r in got.items() if not r.passed} == {"wrong", "lex_low"}
    assert got["wrong"].failed == ["recall_at_1", "mrr"] and got["lex_low"].failed == ["hits"] and got["lex"].hits == 2 and got["first"].hits is None
    assert got["first"].mrr == 1.0 and got["no_gold"].recall_at_1 == 1.0


def test_summary_cases(spark, tmp_path):
    source = "Alice Chen chose blue-green. " * 20
    summary = "## TL;DR\nalice chen and blue-green"
    case = lambda name, **over: {"id": name, "input": {"source": source}, "agent_output": {"output": {"summary_text": summary}}, "expected": {"required_sections": ["## TL;DR"], "must_contain_entities": ["Alice Chen"], **over}}
    cases = [case("good"), case("entity", must_contain_entities=["Bob"], passed=False), case("section", required_sections=["## Risks"], passed=False), case("long", compression_ratio_bounds={"min": 0.0, "max": 0.01}, passed=False), case("bad", must_contain_entities=["Bob"])]
    got = {r.case_id: r for r in runners.run_summaries(read_cases(spark, "summaries", write(tmp_path / "s.json", cases, True))).collect()}
    assert {k for k, r in got.items() if not r.passed} == {"bad"}
    assert got["long"].failed == ["compression_in_bounds"] and got["section"].missing_sections == 1


@pytest.mark.parametrize("content", ["cases: []", "other: 1", "- 1", "cases: [", "\xff\xfe"])
def test_files_without_cases(spark, tmp_path, content):
    (tmp_path / "x.yaml").write_bytes(content.encode("latin-1"))
    with pytest.raises(NoCases):
        read_cases(spark, "gates", str(tmp_path / "x.yaml"))


JWT = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.x"


@pytest.mark.parametrize(
    "value, want",
    [
        ("hello", "hello"),
        (JWT, "[REDACTED].x"),
        ("a" * 32, "[REDACTED]"),
        ("a" * 31, "a" * 31),
        ({"password": "s", "name": "alice"}, {"password": "[REDACTED]", "name": "alice"}),
        ({"config": {"Token": {"deep": 1}, "n": [1, {"api_key": ["x"]}, "a" * 40]}}, {"config": {"Token": "[REDACTED]", "n": [1, {"api_key": "[REDACTED]"}, "[REDACTED]"]}}),
        (["hello", {"password": "x"}, None, True, 3.5], ["hello", {"password": "[REDACTED]"}, None, True, 3.5]),
        ("/home/someone/dev/project/tests/fixtures/sample.md", "/home/someone/dev/project/tests/fixtures/sample.md"),
    ],
)
def test_redaction_of_any_depth(spark, value, want):
    assert without_secrets(value) == want
    row = spark.createDataFrame([(json.dumps(value),)], "v string").select(F.to_json(redact_variant(F.parse_json("v"))).alias("v")).first()
    assert json.loads(row.v) == want


def test_journal_folder(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "journal"))
    assert journal.recent() == journal.runs() == []
    with pytest.raises(ValueError, match="unknown event"):
        journal.append_event("BOGUS")
    record = journal.append_event("RUN_START", run_id="a" * 32, paths=3, secret="x", agent="a" * 32)
    assert record["detail"] == {"paths": 3} and record["run_id"] == "a" * 32 and record["agent"] == "[REDACTED]" and "secret" not in record
    for agent in ("one", "two"):
        journal.append_event("DISPATCH_START", run_id="a" * 32, agent=agent, source={"token": "t", "path": ["/x"]}, tokens=5, spend=0.5)
    journal.append_event("GATE_PASS", run_id="other")
    assert [e["event"] for e in journal.recent(3)] == ["DISPATCH_START", "DISPATCH_START", "GATE_PASS"]
    first = journal.recent()[1]
    assert first["detail"] == {"source": {"token": "[REDACTED]", "path": ["/x"]}} and (first["tokens"], first["spend"]) == (5, 0.5) and "model" not in first
    assert [(r["run_id"], r["event"], r["dispatches"]) for r in journal.runs()] == [("a" * 32, "RUN_START", 2)]
    batch = spark.createDataFrame([("ASK_START", "q1", '{"question": "who?", "ask_type": {"a": [1, {"secret": 2}]}, "extra": 1}'), ("TELEMETRY", "q1", '{"extra": 1}'), ("ASK_CLOSE", "q1", None)], "event string, run_id string, detail string")
    blank = {c: F.lit(None).cast(t) for c, t in dict(ts="timestamp", ask_id="string", ingest_id="string", attempt_id="string", agent="string", gate="string", gate_score="double", verdict="string", model="string", escalated="int", tokens="int", spend="double").items()}
    journal.append(batch.withColumns(blank).withColumn("detail", F.parse_json("detail")))
    last = {e["event"]: e for e in journal.recent(3)}
    assert last["ASK_START"]["detail"] == {"question": "who?", "ask_type": {"a": [1, {"secret": "[REDACTED]"}]}} and "detail" not in last["TELEMETRY"]
    assert [r["run_id"] for r in journal.runs(1)] == ["q1"] and len(journal.runs(5)) == 2
    with pytest.raises(PySparkException, match="unknown event"):
        journal.append(batch.withColumn("event", F.lit("NOPE")).withColumns(blank).withColumn("detail", F.parse_json("detail")))


def test_run_counter_on_a_stream(spark, tmp_path):
    from corpusmill.streaming.streams import run_counts

    rows = [("r1", "2024-01-01 00:00:00", "RUN_START"), ("r1", "2024-01-01 00:01:00", "DISPATCH_START"), ("r2", "2024-01-01 00:02:00", "ASK_START"), (None, "2024-01-01 00:03:00", "DISPATCH_START"), ("r1", "2024-01-01 00:04:00", "GATE_PASS")]
    more = [("r1", "2024-01-01 00:05:00", "DISPATCH_START"), ("r3", "2024-01-01 00:06:00", "DISPATCH_START")]
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (rows, more):
            spark.createDataFrame(part, "run_id string, ts string, event string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            stream = spark.readStream.schema("run_id string, ts timestamp, event string").json(str(tmp_path / "in"))
            query = run_counts(stream).writeStream.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            query.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if kept is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("run_id").agg(F.max_by(F.struct("event", "dispatches"), "batch").alias("x")).select("run_id", "x.*").collect()
    assert sorted((r.run_id, r.event, r.dispatches) for r in last) == [("r1", "RUN_START", 2), ("r2", "ASK_START", 0), ("r3", None, 1)]


def test_commands(spark, tmp_path, capsys):
    from corpusmill import cli
    from corpusmill.plans.corpus_table import CorpusTable

    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    (folder / "a.md").write_text("# About whales\n\nAbout whales we say that humpback whales sing at night.")
    (folder / "b.bin").write_bytes(b"\x00\x01 binary but wanted as text, says the caller")
    run = lambda *argv, at=table: cli.main(["--table", at, *argv] if at else list(argv), spark)
    said = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert run("ingest", str(folder / "a.md"), "--source-type", "nothing") == 2
    assert run("verify", "nobody") == 1 and said()[0]["error"] == "not_found"
    assert run("status") == 0 and said()[0]["table_exists"] is False
    assert run("ingest", str(folder), "--source-type", "markdown") == 0
    assert said()[0]["success_count"] == 2
    rows = {r.title: r for r in CorpusTable(spark, table).visible().collect()}
    assert run("verify", rows["About whales"].document_id) == 0
    told = said()[0]
    assert told["passed"] and told["topical"] and told["specific"] and told["probes"]["topical"] == "About whales" and told["probes"]["specific"] == "whales"
    assert run("verify", rows["About whales"].document_id, "--generation", "7") == 1
    said()
    assert run("search", "whales sing", "--limit", "1") == 0
    counts, best = said()
    assert counts["candidate_count"] == 1 and counts["passes_gate"] and best["title"] == "About whales" and best["score"] > 0
    assert run("lexscan", "whales", "--document-path", "nowhere") == 0 and said()[0]["chunk_count"] == 0
    assert run("lexscan", "whales humpback") == 0 and said()[1]["occurrences"] == 0
    assert run("scroll", "--count", "--source-type", "markdown") == 0 and said()[0] == {"document_count": 2, "chunk_count": 2}
    (tmp_path / "table" / "writer.lock").write_text("")
    assert run("gc") == 3 and run("ingest", str(folder)) == 3
    (tmp_path / "table" / "writer.lock").unlink()
    case = {"id": "x", "query": "humpback whales", "search_mode": "hybrid", "expected": {"relevant_document_ids": [rows["About whales"].document_id], "thresholds": {"recall_at_1": 1.0, "min_mrr": 1.0}}}
    capsys.readouterr()
    assert run("cases", "retrieval", write(tmp_path / "r.yaml", [case])) == 0 and said()[0] == {"cases": 1, "passed": 1}
    assert run("cases", "gates", write(tmp_path / "g.yaml", GATE_CASES), at=None) == 0
    assert run("gate", write(tmp_path / "one.yaml", GATE_CASES[:1]), at=None) == 0 and run("gate", str(tmp_path / "g.yaml"), at=None) == 1
    (tmp_path / "empty.yaml").write_text("cases: []")
    assert run("gate", str(tmp_path / "empty.yaml"), at=None) == 2 and run("cases", "retrieval", "x", at=None) == 2
    journal = str(tmp_path / "journal")
    capsys.readouterr()
    assert run("journal", "RUN_START", "--run-id", "r1", "--paths", "3", "--tokens", "many", at=journal) == 0
    assert said()[0]["detail"] == {"paths": 3}
    assert run("journal", "NOPE", at=journal) == 0 and run("journal", at=journal) == 2
    assert run("journal", "--list", "5", at=journal) == 0 and [e["event"] for e in said()[0]] == ["RUN_START"]
    assert run("journal", "--runs", "5", at=journal) == 0 and said()[0][0]["dispatches"] == 0
    import shutil

    for part in (tmp_path / "table").glob("v-*/chunks"):
        shutil.rmtree(part)  # the log still speaks of them
    assert run("status") == 5 and said()[0]["documents_without_chunks"] == 2
