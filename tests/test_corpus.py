"""Gates, metrics, search and the write path, on tiny tables."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill import cli
from corpusmill.operators import evals, gates, lexical, reports, search, visibility
from corpusmill.plans import ingest as ingesting
from corpusmill.plans.corpus_table import CorpusTable, single_writer
from corpusmill.plans.ingest import ingest, report_totals
from corpusmill.settings import Settings
from corpusmill.sources.readers import load_docx, override_source, read_documents, read_files
from corpusmill.streaming.streams import event_counts, watch

SMALL = Settings(dense_dim=1024, sparse_dim=30_000, window_words=30, overlap_words=5, least_tail_words=8)


def gate(spark, answer, citations, chunks, mode="synthesis", verdict="complete", note=None, ledger=None):
    a = spark.createDataFrame([("a", answer, mode, verdict, note, ledger or {"q": "answered"})], "answer_id string, answer string, mode string, coverage_verdict string, qualification string, ledger map<string,string>")
    c = spark.createDataFrame([("a", *x) for x in citations], "answer_id string, claim string, chunk_id string")
    k = spark.createDataFrame([("a", *x) for x in chunks], "answer_id string, chunk_id string, text string")
    return gates.overall(a, c, k).first().asDict()


def test_gates(spark):
    claim, chunk = "Paris hosts the tower", [("c1", "The tower of Paris stands tall")]
    good = gate(spark, "Paris hosts the tower.", [(claim, "c1")], chunk)
    assert good["overall"]
    assert not gate(spark, "Paris hosts the tower.", [(claim, "c9")], chunk)["all_cited_ids_in_input"]
    assert not gate(spark, "Paris hosts the tower. Berlin hosts museums.", [(claim, "c1")], chunk)["all_claims_cited"]
    assert not gate(spark, "Whales sing songs.", [("Whales sing songs", "c1")], chunk)["groundedness_pass"]
    assert gate(spark, "Paris hosts the tower [source: x.md].", [(claim, "c1")], chunk)["overall"]
    assert gate(spark, "I could not find whales.", [], chunk)["all_claims_cited"]
    assert not gate(spark, "Whales sing.", [], chunk)["all_claims_cited"]
    listed = gate(spark, "Paris tower, Berlin museum.", [("Paris tower", "c1"), ("Berlin museum", "c1")], chunk, "enumeration")
    assert listed["all_claims_cited"]
    assert gate(spark, "Whales sing.", [("", "c1")], [], "enumeration")["all_claims_cited"]  # nothing was given to list
    assert not gate(spark, "Paris tower.", [(" ", "c1")], chunk, "enumeration")["all_claims_cited"]  # a blank claim cites nothing
    assert not gate(spark, "x", [], chunk, ledger={"q": "empty"})["coverage_ledger_consistent"]
    assert gate(spark, "x", [], chunk, verdict="partial", note="q is missing", ledger={"q": "empty"})["coverage_ledger_consistent"]


@pytest.mark.parametrize("rank, recall, mrr", [(1, [1, 1, 1], 1), (3, [0, 1, 1], 1 / 3), (4, [0, 0, 1], 1 / 4), (None, [0, 0, 0], 0)])
def test_metrics(spark, rank, recall, mrr):
    ranked = spark.createDataFrame([("c", i, "gold" if i == rank else f"d{i}") for i in range(1, 8)], "case_id string, rank int, document_id string")
    cases = spark.createDataFrame([("c",), ("none",)], "case_id string")
    gold = spark.createDataFrame([("c", "gold")], "case_id string, document_id string")
    got = {r.case_id: tuple(r)[1:] for r in evals.retrieval_metrics(cases, ranked, gold).collect()}
    assert got["c"] == pytest.approx((*recall, mrr)) and got["none"] == (1, 1, 1, 0)
    assert evals.summary(evals.retrieval_metrics(cases, ranked, gold), {"recall_at_1": 1.0}).first().passed == 1 + (rank == 1)


CHUNK = "document_id string, ingest_generation int, ingest_state string, point_id string, tags array<string>, source_id string, text string, document_path string, chunk_index int"


def test_newest_generation_counts_for_the_whole_corpus(spark):
    rows = spark.createDataFrame(
        [("d", 1, "active", "p1", ["old"], "s", "one cat", "x", 0), ("d", 2, "active", "p2", ["new"], "s", "two cats", "x", 0), ("d", 3, "pending", "p3", ["old"], "s", "cat three", "x", 0), ("e", 1, "failed", "p4", None, "s", None, None, 0)], CHUNK
    )
    seen = visibility.visible(rows)
    assert [r.point_id for r in seen.collect()] == ["p2"]
    assert seen.where(visibility.matches(tags=["old"])).count() == 0 and seen.where(visibility.matches(tags=[])).count() == 1
    assert {r.point_id for r in visibility.verification_view(rows, "d", 3).collect()} == {"p1", "p2", "p3"}
    assert tuple(visibility.gc_counts(rows).first()) == (1, 2, 2)
    assert tuple(lexical.lexscan_counts(rows, "cat").first()) == (2, 1, 2)
    assert tuple(lexical.lexscan_counts(rows.where("1 = 0"), "cat").first()) == (0, 0, 0)
    assert lexical.lexscan(rows, "...").count() == 0


def test_hybrid(spark):
    schema = "point_id string, dense array<float>, sparse struct<indices:array<int>,values:array<float>>, text string, document_path string"
    rows = spark.createDataFrame([("a", [1.0, 0.0], ([1, 5], [1.0, 0.5]), "t", "p"), ("b", [1.0, 1.0], ([5], [2.0]), "", "p"), ("c", [0.0, 0.0], ([9], [1.0]), "t", "p"), ("d", None, None, "t", "p")], schema)
    found, counts = search.hybrid(rows, [1.0, 0.0], {5: 1.0}, limit=3, k=60)
    assert [(r.point_id, round(r.score, 6)) for r in found.select("point_id", "score").collect()] == [("a", round(1 / 61 + 1 / 62, 6)), ("b", round(1 / 61 + 1 / 62, 6))]
    assert counts.first().asDict() == {"dense_hits": 2, "sparse_hits": 2, "candidate_count": 2, "citationable_count": 1}
    assert counts.select(search.passes_gate()).first()[0]
    none, zero = search.hybrid(rows.where("1 = 0"), [1.0, 0.0], {5: 1.0})
    assert none.count() == 0 and zero.first().candidate_count == 0 and not zero.select(search.passes_gate()).first()[0]
    assert search.sparse_topk(rows, {}).count() == 0


def test_hybrid_batch(spark):
    schema = "point_id string, dense array<float>, sparse struct<indices:array<int>,values:array<float>>"
    rows = spark.createDataFrame([("a", [1.0, 0.0], ([1, 5], [1.0, 0.5])), ("b", [1.0, 1.0], ([5], [2.0])), ("c", [0.0, 0.0], ([9], [1.0])), ("d", None, None), ("e", [0.0, 1.0], ([], []))], schema)
    asked = spark.createDataFrame([("q", [1.0, 0.0], ([5], [1.0])), ("none", [0.0, 0.0], ([], []))], "query string, dense array<float>, sparse struct<indices:array<int>,values:array<float>>")
    found, counts = search.hybrid_batch(rows, asked, 3)
    assert [(r.query, r.point_id, round(r.score, 6), r["rank"]) for r in found.orderBy("rank").collect()] == [("q", "a", round(1 / 61 + 1 / 62, 6), 1), ("q", "b", round(1 / 61 + 1 / 62, 6), 2), ("q", "e", round(1 / 63, 6), 3)]
    assert [tuple(r) for r in counts.collect()] == [("q", 3, 2)]
    assert [r.dense_hits for r in search.hybrid_batch(rows, asked, 3, least=0.0)[1].collect()] == [2]


def test_batch_search_equals_single(spark):
    rows = spark.range(60).selectExpr("id AS point_id", "transform(sequence(0, 5), i -> cast(sin(id * (i + 1)) as float)) AS dense")
    queries = rows.where("point_id < 7").selectExpr("point_id AS query", "dense AS vector")
    got = search.dense_topk_batch(rows, queries, 4, block=3).collect()
    for q in queries.collect():
        want = [tuple(r) for r in search.dense_topk(rows, q.vector, 4).collect()]
        mine = sorted((r for r in got if r.query == q.query), key=lambda r: r.rank)
        assert [r.point_id for r in mine] == [w[0] for w in want] and [r.score for r in mine] == pytest.approx([w[1] for w in want])


def docx(paragraphs, table=None):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda t, s=None: f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in table or [])
    body = "".join(para(*p) for p in paragraphs) + (f"<w:tbl>{rows}</w:tbl>" if table else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="S1"><w:name w:val="heading 2"/></w:style></w:styles>')
    return out.getvalue()


def test_docx(spark):
    files = [
        ("/x/a.docx", docx([("My title", "Title"), ("Sub", "S1"), ("Plain text that is long enough", None)], [["h1", "h|2"], ["1", "2"]])),
        ("/x/short.docx", docx([("hi", None)])),
        ("/x/old.docx", bytes.fromhex("D0CF11E0A1B11AE1") + b"rest"),
        ("/x/broken.docx", b"PK nonsense"),
    ]
    df = spark.createDataFrame([(p, bytearray(d), "docx", False, None) for p, d in files], "path string, content binary, source_type string, sniffed boolean, error string")
    got = {r.document_path: r for r in load_docx(df).collect()}
    assert got["/x/a.docx"].raw_text == "# My title\n\n## Sub\n\nPlain text that is long enough\n\n| h1 | h\\|2 |\n| --- | --- |\n| 1 | 2 |"
    assert (got["/x/a.docx"].title, got["/x/a.docx"].loader_verdict) == ("My title", "ok")
    assert [got[f"/x/{n}.docx"].loader_verdict for n in ("short", "old", "broken")] == ["low_confidence", "encrypted", "error"]
    assert got["/x/short.docx"].title == "short"


def prose(word, n=70):
    return "# About " + word + "\n\nAbout " + word + " we say: " + " ".join(f"{word}{chr(97 + i % 26)}{chr(97 + i // 26)} lorem" for i in range(n))


@pytest.mark.parametrize("place", ["in", "other", "a/long/way/down", "zz"])  # ids hang on the path; verdicts must not
def test_ingest_publishes_after_probes(spark, tmp_path, place):
    folder = tmp_path / place
    folder.mkdir(parents=True)
    (folder / "a.md").write_text(prose("alpha"))
    (folder / "b.txt").write_text(prose("beta"))
    (folder / "c.data").write_bytes("caf\xe9 latin text without heading".encode("latin-1"))
    (folder / "e.md").write_text("\n\n")
    table = CorpusTable(spark, str(tmp_path / "table"))
    read = lambda: read_documents(read_files(spark, str(folder)))
    first = {r.path.rsplit("/", 1)[1]: r for r in ingest(table, read(), ("t",), SMALL).collect()}
    assert {k: v.outcome for k, v in first.items()} == {"a.md": "success", "b.txt": "success", "c.data": "success", "e.md": "success"}
    assert first["c.data"].loader_verdict == "low_confidence" and first["e.md"].chunk_count == 0
    assert {r.title for r in table.visible().select("title").distinct().collect()} == {"About alpha", "About beta", "c"}
    assert table.visible().where("tags[0] = 't' AND ingest_generation = 1").count() == table.visible().count()
    (folder / "a.md").write_text(prose("sigma"))
    again = ingest(table, read(), (), SMALL)
    totals = report_totals(again)
    assert totals["no_op_count"] == 2 and totals["success_count"] == 2
    assert lexical.lexscan_counts(table.visible(), "alphaaa").first().chunk_count == 0
    assert lexical.lexscan_counts(table.visible(), "sigmaaa").first().chunk_count > 0
    before = table.visible().count()
    assert table.gc()["superseded_deleted"] > 0 and table.visible().count() == before and table.chunks().count() == before
    with single_writer(spark, table.path), pytest.raises(FileExistsError):
        ingest(table, read(), (), SMALL)
    moved = override_source(read(), "lib", str(folder)).where("title = 'About beta'").first()
    assert (moved.source_id, moved.document_path) == ("lib", "lib/b.txt")


def test_command_line_and_watch(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("CORPUSMILL_OVERLAP_WORDS", "20")
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text(prose("delta"))
    table = str(tmp_path / "t")
    assert cli.main(["--table", table, "ingest", str(folder / "a.md"), "--source-id", "sid"], spark) == 0
    assert cli.main(["--table", table, "search", "deltaaa lorem", "--limit", "3"], spark) == 0
    assert cli.main(["--table", table, "lexscan", "deltaaa", "--count"], spark) == 0
    assert cli.main(["--table", table, "scroll"], spark) == 0
    assert cli.main(["--table", table, "status"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert lines[0]["success_count"] == 1 and any(x.get("dense_hits") for x in lines) and lines[-1]["document_count"] == 1
    assert any(x.get("source_id") == "sid" for x in lines)
    other = CorpusTable(spark, str(tmp_path / "w"))
    watch(other, str(folder), str(tmp_path / "ck"), SMALL).awaitTermination(120)
    assert other.visible().count() > 0


def test_event_stream(spark, tmp_path):
    src = tmp_path / "events"
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "A"), ("2024-01-01 00:50:00", "A"), ("2024-01-01 01:10:00", "B")], "ts string, event string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.json(str(src))
    stream = spark.readStream.schema("ts timestamp, event string").json(str(src))
    q = event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = lambda df: sorted((str(r.window_start), r.event, r.n) for r in df.collect())
    assert key(spark.table("counts")) == key(event_counts(rows)) and len(key(event_counts(rows))) == 2


def test_reports(spark):
    rows = spark.createDataFrame([("p", "d1", "no_op", 1), ("p", "d2", "error", 0), ("q", "d3", "success", 4)], "path string, document_id string, outcome string, chunk_count long")
    paths = reports.by_path(rows)
    assert sorted(map(tuple, paths.collect())) == [("p", "error", 2, 1), ("q", "success", 1, 4)]
    more = reports.path_details(rows.withColumn("generation", F.lit(2)).unionByName(spark.createDataFrame([("p", "d0", "error", 0, None)], "path string, document_id string, outcome string, chunk_count long, generation int")))
    assert [tuple(r)[1:] for r in more.orderBy("path").collect()] == [("error", 3, 1, ["d0", "d1", "d2"], [None, 2, 2], {"no_op": 1, "error": 2}), ("success", 1, 4, ["d3"], [2], {"success": 1})]
    assert reports.totals(paths).first().asDict() == {"total_paths": 2, "no_op_count": 0, "success_count": 1, "skipped_count": 0, "index_suspect_count": 0, "error_count": 1}


def test_a_broken_write_is_never_read(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text(prose("alpha"))
    table = CorpusTable(spark, str(tmp_path / "table"))
    read = lambda: read_documents(read_files(spark, str(folder)))
    with monkeypatch.context() as m:
        m.setattr(ingesting, "judge", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest(table, read(), (), SMALL)
    assert table.visible().count() == 0 and [r.ingest_state for r in table.states().collect()] == ["failed"]
    with single_writer(spark, table.path):  # the lock is free again
        left = table.chunks().count()
    assert left > 0 and table.chunks().where("ingest_state = 'failed'").count() == left
    assert [r.outcome for r in ingest(table, read(), (), SMALL).collect()] == ["success"]
    seen = table.visible().count()  # same generation, same point ids: the broken write's rows are gone
    assert seen == left == table.chunks().count() == table.visible().select("point_id").distinct().count()
    table.set_states(table.heads(), "retired")
    assert table.visible().count() == 0 == table.chunks().count()
    assert table.set_states(spark.createDataFrame([("nobody", 1)], "document_id string, ingest_generation int"), "active") == 0


def test_chunks_that_are_missing_fail_a_generation(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text(prose("alpha", 400))
    table = CorpusTable(spark, str(tmp_path / "table"))
    append = table.append
    monkeypatch.setattr(table, "append", lambda rows, write_id: append(rows.where("chunk_index <> 1"), write_id))
    report = ingest(table, read_documents(read_files(spark, str(folder))), (), SMALL).first()
    assert report.outcome == "index_suspect" and "whole" in report.detail and table.visible().count() == 0
