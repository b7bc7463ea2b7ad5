"""What searches and their indices leave on disk: steps remove their shuffles, and rows, texts and vectors are not sent once for every block of queries."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import tokens
from corpusmill.operators import ask, cells, postings, search, verify
from corpusmill.plans import storage
from corpusmill.plans.corpus_index import build_index

DOCS = "point_id string, document_id string, ingest_generation int, text string"


def shuffled(spark):
    """Bytes of the session's shuffle files."""
    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = [os.path.join(at, f) for folder in folders for at, _, names in os.walk(folder) for f in names if f.startswith("shuffle_") and f.endswith(".data")]
    return {f: os.path.getsize(f) for f in files}


@pytest.fixture
def sent(spark, monkeypatch):
    """Bytes that a function has shuffled; nothing is removed."""
    monkeypatch.setattr(storage, "CLEANUP", "spark.corpusmill.nothing")

    def run(make):
        before = shuffled(spark)
        out = make()
        return out, sum(n for f, n in shuffled(spark).items() if f not in before)

    return run


def noise(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = [(f"p{i:04d}", f"d{i}", 1, f"w{i % 7} w{i % 3} common " + " ".join(noise(rng, 9) for _ in range(200))) for i in range(600)]
    return rows, storage.stash(spark.createDataFrame(rows, DOCS).repartition(4), "docs")


def test_a_stash_leaves_no_shuffle(spark):
    before, conf = set(shuffled(spark)), spark.conf.get(storage.CLEANUP, None)
    kept = storage.stash(spark.range(5000).repartition(3, "id"), "some")
    assert set(shuffled(spark)) <= before and kept.count() == 5000 and spark.conf.get(storage.CLEANUP, None) == conf
    with storage.passing(spark.range(5), "some") as some:
        (path,) = {os.path.dirname(f.removeprefix("file://")) for f in some.inputFiles()}
        assert some.count() == 5
    assert not os.path.exists(path)


def test_texts_are_shuffled_once(docs, sent):
    rows, df = docs
    index, n = sent(lambda: build_index(df, vectors=lambda r: r.withColumns({"dense": F.array(F.lit(1.0).cast("float")), "sparse": F.lit(None).cast("struct<indices:array<int>,values:array<float>>")})))
    assert n < 1.1 * sum(len(r[3]) for r in rows) and index.entries.count() == 600
    assert sorted((r.slice, r.local, r.point_id) for r in index.entries.collect()) == sorted((r.slice, r.local, r.point_id) for r in postings.sliced(df).collect())


def test_dense_search_shuffles_no_vectors(spark, sent):
    rng = np.random.default_rng(5)
    df = storage.stash(spark.createDataFrame([(f"p{i:04d}", rng.normal(size=256).tolist(), i % 2) for i in range(1500)], "point_id string, dense array<float>, odd int"), "vectors")
    one = [0.0] * 256
    asked = [(i, rng.normal(size=256).tolist()) for i in range(60)] + [(100 + i, one[:i] + [1.0, -0.5] + one[i + 2 :]) for i in range(60)] + [(200, one), (201, None)]
    queries = storage.stash(spark.createDataFrame(asked, "query int, vector array<float>"), "queries")
    built = cells.build_cells(df, carry=("odd",), pivots=20)
    key = lambda found: sorted((r.query, r["rank"], r.point_id, round(r.score, 6)) for r in found.collect())
    want = key(search.dense_topk_batch(df.where("odd = 1"), queries, 7))
    assert len(want) == 7 * 120
    for block in (None, 25):  # whole ones and few entries in separate blocks, and together
        met, n = sent(lambda: cells.dense_topk_cells(built, queries, 7, lambda r: r.where("odd = 1"), block=block))
        assert n < 1500 * 256 * 4 / 4 and key(met.best) == want
    some = cells.dense_topk_cells(built, queries.where("query >= 100"), 7, lambda r: r.where("odd = 1"), least=0.1).best
    assert key(some) == [r for r in want if r[0] >= 100 and r[3] > 0.1]


def test_ties_and_rows_of_no_likeness(spark):
    """Copies in several tasks and cells: the smaller keys come first; what is at a right angle is no hit where none is asked for."""
    rows = [(f"p{i:03d}", [1.0, 0.0, 0.0] if i % 3 == 0 else [0.0, float(i % 3), 1.0]) for i in range(300)]
    built = cells.build_cells(spark.createDataFrame(rows, "point_id string, dense array<float>").repartition(5), pivots=3)
    queries = spark.createDataFrame([(1, [2.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])], "query int, vector array<float>")
    got = [(r["rank"], r.point_id, r.score) for r in cells.dense_topk_cells(built, queries, 150).best.orderBy("rank").collect()]
    same, other = [r[0] for r in rows if r[1][0]], [r[0] for r in rows if not r[1][0]]
    assert got == [(i + 1, p, float(i < 100)) for i, p in enumerate([*same, *other][:150])]
    assert cells.dense_topk_cells(built, queries, 150, least=0.0).best.count() == 100


def test_sparse_search_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    vector = lambda: (sorted(rng.sample(range(40), 6)), [1.0] * 6)
    rows = spark.createDataFrame([(f"p{i:04d}", vector()) for i in range(400)], "point_id string, sparse struct<indices:array<int>,values:array<float>>")
    queries = spark.createDataFrame([(i, vector()) for i in range(30)], "query int, sparse struct<indices:array<int>,values:array<float>>")
    entries = storage.stash(postings.sliced(rows, size=50), "entries")
    index = postings.Postings(entries, storage.stash(postings.blocks_of(entries, postings.sparse_terms(F.col("sparse"))), "blocks"))
    monkeypatch.setattr(postings, "QUERIES", 8)
    found = postings.sparse_topk_pruned(index, queries, 5)
    key = lambda df: sorted((r.query, r["rank"], r.point_id, r.score) for r in df.collect())
    assert key(found.best) == key(search.sparse_topk_batch(rows, queries, 5)) and found.terms.count() == 180


def test_own_rows_are_looked_up_where_they_lie(spark, docs, sent, monkeypatch):
    rows, df = docs
    keys = spark.createDataFrame([(f"d{i}", 1) for i in range(0, 700, 50)], "document_id string, ingest_generation int")
    want = sorted(f"p{i:04d}" for i in range(0, 600, 50))
    got, n = sent(lambda: verify.of_generations(df, keys).select("point_id", "text").collect())
    assert sorted(r.point_id for r in got) == want and n < 100_000 < sum(len(r[3]) for r in rows)
    monkeypatch.setattr(verify, "FEW", 3)
    assert sorted(r.point_id for r in verify.of_generations(df, keys).collect()) == want


def test_holders_are_counted_in_their_slices(spark, docs, sent, monkeypatch):
    """A slice's lists are sent once, not once for every question, and no row is."""
    _, df = docs
    entries = storage.stash(postings.sliced(df, size=64), "entries")
    index = postings.Postings(entries, storage.stash(postings.blocks_of(entries, postings.text_terms(F.col("text"))), "blocks"))
    asked = lambda n: spark.createDataFrame([(i, [f"w{i % 7}", "common"][: 1 + i % 2] * (i % 5 > 0)) for i in range(n)], "query int, tokens array<string>")
    seen = entries.where("point_id LIKE '%1'")
    want = lambda q: {r["query"]: r["count"] for r in postings.fetch(seen.select("slice", "local"), postings.holding(index, q)).groupBy("query").count().collect()}
    taken = {}
    for n in (40, 2000):
        got, taken[n] = sent(lambda: {r["query"]: r.hits for r in postings.count_holding(index, asked(n), seen).collect()})
        assert got == want(asked(n)) and len(got) == n * 4 // 5
    assert taken[2000] < taken[40] + 60_000  # queries and counts
    monkeypatch.setattr(postings, "QUERIES", 4)
    assert {r["query"]: r.hits for r in postings.count_holding(index, asked(40), seen).collect()} == want(asked(40))
    odd = spark.createDataFrame([(1, ["w1", "nowhere"]), (2, [])], "query int, tokens array<string>")
    assert postings.count_holding(index, odd, seen).count() == 0 == postings.count_holding(index, odd.where("query = 2"), seen).count()


def test_the_ledger_fetches_no_rows(spark, docs, monkeypatch):
    _, df = docs
    rows = df.withColumns({"dense": F.array(F.lit(1.0).cast("float")), "sparse": F.from_json(F.lit('{"indices":[1],"values":[1]}'), "struct<indices:array<int>,values:array<float>>")})
    index = build_index(rows, ("document_id",), pivots=1)
    sub = rows.limit(6).select(F.lit(1).alias("ask"), F.col("point_id").alias("query"), F.when(F.col("point_id") >= "p", "enumeration").alias("ask_type"), F.substring("text", 1, 12).alias("text"), "dense", "sparse")
    want = {r.point_id: r.n for r in sub.select(F.col("query").alias("point_id"), tokens(F.col("text")).alias("t")).crossJoin(rows.select(tokens(F.col("text")).alias("u"))).groupBy("point_id").agg(F.count_if(F.size(F.array_except("t", "u")) == 0).alias("n")).collect()}
    holding, never = ask.holding, F.raise_error(F.lit("rows are looked for")).cast("boolean")
    monkeypatch.setattr(ask, "holding", lambda *a: holding(*a).where(F.coalesce(never, F.col("local") >= 0)))
    assert {r["query"]: r.hits for r in ask.answer_routed(index, sub, 5)[1].collect()} == want and min(want.values()) > 0
    monkeypatch.undo()
    found = ask.answer_routed(index, sub, 5)[0].collect()
    assert sum(r.sub_queries for r in found) == sum(want.values())
