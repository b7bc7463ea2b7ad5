"""Postings, pruned search, cells and the table that keeps them, against scans of everything."""

import random
import tracemalloc
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import vectors
from corpusmill.functions.text import tokens
from corpusmill.functions.vectors import hash_dense, hash_sparse, with_hash_vectors
from corpusmill.operators import cells, lexical, postings, search, verify
from corpusmill.plans.corpus_index import build_index
from corpusmill.plans.corpus_table import CARRY, CorpusTable
from corpusmill.plans.storage import stash
from corpusmill.schemas import CHUNK

VOCAB = ["the", "of", "cat", "Cat's", "mañana", "x_1", "12", "dog", "tree", "über", "日本"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(VOCAB if rng.random() < 0.8 else VOCAB[:3]) for _ in range(rng.choice([0, 1, 3, 8, 40]))) for _ in range(400)]
    rows = [(f"p{i:04d}", f"d{i % 90}", t if i % 50 else None, i % 3 > 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "point_id string, document_id string, text string, seen boolean")
    df = df.withColumns({"dense": hash_dense(F.coalesce("text", F.lit("")), 64), "sparse": hash_sparse(F.coalesce("text", F.lit("")), 500), "ingest_generation": F.lit(1)})
    return stash(df, "corpus"), build_index(df, ("seen",), size=32, pivots=9, part_bytes=2000)


@pytest.mark.parametrize("term", ["the", "cat the", "Mañana DOG", "x_1 x_1", "12", "nowhere", "the nowhere", "...", "", "cat's"])
def test_lexscan_through_postings(corpus, term):
    rows, index = corpus
    for view in (None, lambda r: r.where("seen")):
        want = lexical.lexscan(rows if view is None else view(rows), term).select("point_id", "text", "occurrences")
        got = index.lexscan(term, view).select("point_id", "text", "occurrences")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_many_terms_at_once(spark, corpus):
    rows, index = corpus
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["the of", "dog tree 12", "cat", "nobody", ""])], "query int, t string").select("query", tokens(F.col("t")).alias("tokens"))
    got = postings.fetch(index.entries, postings.holding(index.tokens, asked)).select("query", "point_id").collect()
    want = [(q.query, r.point_id) for q in asked.collect() for r in rows.select("point_id", tokens(F.coalesce("text", F.lit(""))).alias("t")).collect() if q.tokens and set(q.tokens) <= set(r.t)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_common_token_is_cut_and_the_reader_gets_the_filter(corpus):
    _, index = corpus
    the = index.tokens.blocks.where("term = 'the'").select("slice", "n").collect()
    assert len(the) > 5 and max(r.n for r in the) < 70 and len({r.slice for r in the}) == len(the)
    plan = postings.holding_all(index.tokens, ["the", "cat"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "In(term" in plan.replace("`", "")


def sparse_rows(spark, n, seed, negative=0.1):
    rng, out = random.Random(seed), []
    for i in range(n):
        at = sorted({min(999, int(rng.paretovariate(0.6)) - 1) for _ in range(rng.choice([0, 1, 5, 30]))})
        out.append((f"p{i:05d}", (at, [-0.5 if rng.random() < negative else rng.choice([1.0, 1.0, 0.5, 2.0]) for _ in at])))
    out += [("q1", None), ("q2", out[7][1]), ("q3", out[7][1])]
    return spark.createDataFrame(out, "point_id string, sparse struct<indices:array<int>,values:array<float>>")


@pytest.mark.parametrize("seeds, negative", [(1, 0.1), (60, 0.0), (100000, 0.3)])
def test_pruned_sparse_search_is_exact(spark, seeds, negative):
    rows = sparse_rows(spark, 1500, 1, negative)
    queries = sparse_rows(spark, 30, 2, negative).withColumnRenamed("point_id", "query")
    entries = stash(postings.sliced(rows, size=64), "entries")
    index = postings.Postings(entries, stash(postings.blocks_of(entries, postings.sparse_terms(F.col("sparse"))), "blocks"))
    key = lambda df: sorted((r.query, r["rank"], r.point_id, round(r.score, 6)) for r in df.collect())
    got = postings.sparse_topk_pruned(index, queries, 7, seeds=seeds)
    assert key(got.best) == key(search.sparse_topk_batch(rows, queries, 7))
    odd = lambda r: r.where("point_id LIKE '%1'")
    assert key(postings.sparse_topk_pruned(index, queries, 7, view=odd, seeds=seeds).best) == key(search.sparse_topk_batch(odd(rows), queries, 7))
    if not negative:
        read = {r.essential: r.n for r in got.terms.groupBy("essential").agg(F.sum("df").alias("n")).collect()}
        assert read[False] > read[True] / 2  # common words are mostly not read
    floor = queries.select("query", F.lit(2.0).alias("floor"))
    some = key(postings.sparse_topk_pruned(index, queries, 7, floor=floor, seeds=seeds).best)
    assert [r for r in some if r[3] >= 2] == [r for r in key(got.best) if r[3] >= 2]


def test_rows_that_leave_a_slice_are_bounded(spark):
    """A query of words that all rows have, and ties without end: k rows of a slice at most leave it, and no list is spread out in rows."""
    n, slices = 600, 4
    rows = spark.createDataFrame([(f"p{i:05d}", (list(range(8)) + [100 + i], [1.0] * 9)) for i in range(n)], "point_id string, sparse struct<indices:array<int>,values:array<float>>")
    queries = spark.createDataFrame([(q, (list(range(8)), [1.0] * 8)) for q in range(40)], "query int, sparse struct<indices:array<int>,values:array<float>>")
    entries = stash(postings.sliced(rows, size=n // slices), "entries")
    index = postings.Postings(entries, stash(postings.blocks_of(entries, postings.sparse_terms(F.col("sparse"))), "blocks"))
    pairs = queries.select("query").crossJoin(entries.select("slice").distinct()).withColumn("~low", F.lit(None).cast("double"))
    assert postings.best_of_slices(index, entries, queries, pairs, 5, 3).count() == 40 * slices * 5
    best = postings.sparse_topk_pruned(index, queries, 5).best.collect()
    assert sorted((r.query, r["rank"], r.point_id, r.score) for r in best) == [(q, k + 1, f"p{k:05d}", 8.0) for q in range(40) for k in range(5)]


def test_vectors_of_a_pass_equal_those_of_columns(spark):
    texts = ["", " \n", None, "The the THE", "mañana ÜBER x_1\x1cy\u3000z\xa0w\u1680v", "İstanbul ΣΑΣ ß 日本 🙂🙂", " ".join(f"w{i}" for i in range(3000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for dense, sparse in ((64, 500), (1024, 30_000)):
        want = df.withColumns({"dense": hash_dense(F.col("text"), dense), "sparse": hash_sparse(F.col("text"), sparse)})
        got = with_hash_vectors(df, "text", dense, sparse)
        assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_parts_of_an_index_are_built_when_asked_for(corpus, monkeypatch):
    rows, _ = corpus
    monkeypatch.setattr("corpusmill.plans.corpus_index.build_cells", None)
    index = build_index(rows, ("seen",))
    assert index.lexscan("the").count() > 0 and index.weights.blocks.count() > 0


def test_cells_are_exact_and_skip(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(30, 16))
    rows = [(f"p{i:05d}", [float(x) for x in centre[i % 30] + 0.3 * rng.normal(size=16)], i % 2) for i in range(1500)]
    rows += [(f"z{i}", rows[0][1], 1) for i in range(700)] + [("n", None, 1), ("zero", [0.0] * 16, 1)]  # a hot vector
    df = spark.createDataFrame(rows, "point_id string, dense array<float>, odd int")
    queries = spark.createDataFrame([(i, rows[i * 37][1]) for i in range(40)] + [(99, None), (98, [0.0] * 16)], "query int, vector array<float>")
    built = cells.build_cells(df, carry=("odd",), pivots=25, part_bytes=20_000)
    assert built.n.sum() == 2200 and built.parts.max() > 3
    key = lambda found: sorted((r.query, r["rank"], r.point_id, round(r.score, 6)) for r in found.collect())
    met = cells.dense_topk_cells(built, queries, 10, block=16)
    want = key(search.dense_topk_batch(df, queries, 10, part_bytes=20_000))
    assert key(met.best) == want and len(want) == 400
    assert met.visits.distinct().count() == met.visits.count() < 40 * 25 / 4
    view = lambda r: r.where("odd = 1")
    assert key(cells.dense_topk_cells(built, queries, 10, view).best) == key(search.dense_topk_batch(view(df), queries, 10))
    floor = queries.select("query", F.lit(0.9).alias("floor"))
    some = key(cells.dense_topk_cells(built, queries, 10, floor=floor).best)
    assert [r for r in some if r[3] >= 0.9] == [r for r in want if r[3] >= 0.9]


def test_visits_carry_no_vectors_and_hits_reach_the_threshold(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(f"p{i:03d}", rng.normal(size=8).tolist(), i % 10 == 0) for i in range(600)], "point_id string, dense array<float>, seen boolean")
    asked = df.limit(5).select(F.col("point_id").alias("query"), F.col("dense").alias("vector"))
    built = cells.build_cells(df, carry=("seen",), pivots=30)
    first = cells.visits(built, asked, 2, True)
    assert first.columns == ["query", "cell", "theta"]
    held = first.groupBy("query").agg(F.sum(F.get(F.lit(built.n.tolist()), F.col("cell"))).alias("n")).collect()
    assert len(held) == 5 and min(r.n for r in held) >= 2 * cells.SEEDS  # a view of one in ten shows two
    left = df.select(F.lit(0).alias("part"), F.col("point_id").alias("key"), F.col("dense").alias("vector"))
    right = asked.withColumns({"part": F.lit(0), "theta": F.lit(0.5).cast("double")})
    free = search.grid(left, right.drop("theta"), ["part"], 600).where("score >= 0.5")
    held = search.grid(left, right, ["part"], 600)
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, free.collect())) and 5 < held.count() < 3000


def test_entries_are_made_in_more_tasks_than_slices(spark):
    rows = postings.spread(postings.sliced(spark.range(300).select(F.col("id").cast("string").alias("point_id")), size=300), 10)
    assert rows.select("slice").distinct().count() == 1 < rows.select(F.spark_partition_id().alias("p")).distinct().count()


def test_empty_index(corpus):
    rows, _ = corpus
    index = build_index(rows.limit(0), ("seen",))
    asked = rows.limit(2).select(F.col("point_id").alias("query"), "dense", "sparse")
    found, counts = index.hybrid(asked)
    assert found.count() == counts.count() == index.lexscan("the").count() == 0


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_probes_by_rank_equal_probes_by_search(spark, corpus, limit):
    rows, index = corpus
    probes = rows.where("text <> ''").where(F.crc32("point_id") % 9 == 0).select("document_id", F.lit(1).alias("ingest_generation"), F.substring("text", 1, 30).alias("query"))
    probes = probes.unionByName(spark.createDataFrame([("d3", 1, "tree"), ("nobody", 1, "cat"), ("d4", 1, "nothing like it")], "document_id string, ingest_generation int, query string"))
    view, sizes = (lambda r: r.where("seen OR document_id = 'd3'")), {"dense_dim": 64, "sparse_dim": 500}
    wide = build_index(rows, ("seen", "document_id", "ingest_generation"), size=50)
    a, b = (sorted(map(tuple, f(probes, wide, view, limit, **sizes).collect())) for f in (verify.found_by_rank, verify.found_by_search))
    assert a == b and {x[2] for x in a} == {True, False}


NAMES = "source_id source_type document_id document_path document_sha256 ingest_generation chunk_index tags text point_id dense sparse".split()


def chunk(document, generation, number, text="one two", **over):
    row = {"source_id": "s", "source_type": "text", "document_id": document, "document_path": f"{document}.txt", "document_sha256": f"sha-{document}-{generation}", "ingest_generation": generation, "chunk_index": number, "tags": ["t"], "text": text, "point_id": f"{document}/{generation}/{number}", "dense": [1.0, 0.5, 0.0], "sparse": ([1, 4], [1.0, 2.0])}
    return tuple((row | over)[n] for n in NAMES)


KINDS = "source_id string, source_type string, document_id string, document_path string, document_sha256 string, ingest_generation int, chunk_index int, tags array<string>, text string, point_id string, dense array<float>, sparse struct<indices:array<int>,values:array<float>>"


def frame(spark, rows):
    df = spark.createDataFrame(rows, KINDS)
    empty = spark.createDataFrame([], CHUNK)
    return empty.unionByName(df, allowMissingColumns=True)


def store(spark, table, rows, write_id, state=None):
    df = frame(spark, rows)
    table.set_states(df.select("document_id", "ingest_generation", "document_sha256").distinct(), "pending", write_id)
    counts = table.append(df, write_id)
    if state:
        table.set_states(df.select("document_id", "ingest_generation"), state)
    return counts


@pytest.fixture
def table(spark, tmp_path):
    out = CorpusTable(spark, str(tmp_path / "table"))
    assert out.ensure(3, 10) and not out.ensure(3, 10)
    return out


def test_promotion_and_deletes(spark, table):
    store(spark, table, [chunk("a", g, i) for g in (1, 2, 3, 4) for i in range(g)], "w1", "active")
    store(spark, table, [chunk("b", 3, i) for i in range(3)] + [chunk("a", 5, 0)], "w2")
    assert table.promote_generation("b", 3) == 3 and table.promote_generation("b", 3) == 0 and table.promote_generation("nobody", 99) == 0
    assert table.max_active_generation("b") == 3 and table.max_active_generation("nobody") is None
    assert table.delete_generations("nobody", states=["pending"]) == 0
    assert table.delete_generations("a", states=["pending"]) == 1 and table.delete_generations("a", states=["pending"]) == 0
    assert table.delete_generations("a", generation=2) == 2
    assert table.delete_generations("a", generation=1, max_generation=4) == 1  # the generation goes before
    assert table.delete_generations("a", max_generation=3) == 3
    assert table.max_active_generation("a") == 4 and table.visible().count() == 7
    assert [r.chunk_index for r in table.generation("a", 4).collect()] == [0, 1, 2, 3] and table.generation("a", 3).count() == 0


def test_flawed_rows_are_refused(spark, table):
    bad = {
        "dense: not of 3 entries": {"dense": [1.0, 2.0]},
        "dense: none": {"dense": None},
        "dense: an entry is no number": {"dense": [1.0, float("nan"), 0.0]},
        "sparse: indices and values differ in length": {"sparse": ([1, 2], [1.0])},
        "sparse: indices do not ascend": {"sparse": ([4, 1], [1.0, 1.0])},
        "sparse: an index out of range": {"sparse": ([1, 10], [1.0, 1.0])},
        "sparse: a value is no number": {"sparse": ([1], [float("inf")])},
        "sparse: none": {"sparse": None},
        "text: none": {"text": None},
        "point_id: none": {"point_id": None},
        "ingest_generation: below 1": {"ingest_generation": 0},
    }
    rows = [chunk("a", 1, i, **over) for i, over in enumerate(bad.values())]
    rows += [chunk("a", 1, 20, sparse=([2, 2], [1.0, 1.0])), chunk("a", 1, 21, sparse=([], [])), chunk("a", 1, 22)]
    assert store(spark, table, rows, "w1") == {"accepted": 2, "refused": 12}
    assert sorted(r.flaw for r in table.rejected().collect()) == sorted([*bad, "sparse: indices do not ascend"])
    assert table.entries().count() == 2
    with pytest.raises(ValueError, match="1 rows are flawed"):
        table.append(frame(spark, [chunk("b", 1, 0), chunk("b", 1, 1, dense=[0.0])]), "w2", strict=True)
    assert table.entries().count() == 2
    with pytest.raises(ValueError, match="dimensions"):
        table.ensure(4, 10)


def test_gc_checkpoints_and_removes(spark, table, tmp_path):
    store(spark, table, [chunk("a", 1, 0, "old cat"), chunk("b", 1, 0, "the dog")], "w1", "active")
    store(spark, table, [chunk("a", 2, i, f"new cat {i}") for i in range(3)], "w2", "active")
    store(spark, table, [chunk("c", 1, 0, "pending cat")], "w3")
    heads = lambda: sorted((r.document_id, r.ingest_generation, r.document_sha256) for r in table.heads().collect())
    before, seen = heads(), sorted(map(tuple, table.visible().select("point_id", "text").collect()))
    assert table.gc() == {"superseded_deleted": 1, "orphan_deleted": 1, "documents_affected": 2}
    assert heads() == before and table.log().count() == 0  # the tail is empty, the checkpoint holds
    assert sorted(map(tuple, table.visible().select("point_id", "text").collect())) == seen and table.entries().count() == 4
    store(spark, table, [chunk("b", 2, 0, "a dog and a cat")], "w4", "active")
    assert heads() == [("a", 2, "sha-a-2"), ("b", 2, "sha-b-2")] and table.log().count() == 2
    index, view = table.index(), table.view(table.heads())
    assert sorted(r.text for r in index.lexscan("cat", view).collect()) == ["a dog and a cat", "new cat 0", "new cat 1", "new cat 2"]
    assert table.gc()["superseded_deleted"] == 1 and table.gc()["superseded_deleted"] == 0
    folders = [p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("v-")]
    assert len(folders) == 2 and "v-0" not in folders  # the newest and the one before
    assert sorted(r.text for r in table.index().lexscan("cat", table.view(table.heads())).collect()) == ["a dog and a cat", "new cat 0", "new cat 1", "new cat 2"]
    told = table.status().first()
    assert (told.active_chunk_count, told.document_count, told.table_exists, told.healthy, told.documents_without_chunks) == (4, 2, True, True, 0)


def test_search_over_several_writes(spark, table):
    rng = random.Random(4)
    rows = [[chunk(f"d{w}-{i}", 1, 0, f"{rng.choice(VOCAB)} {rng.choice(VOCAB)}", dense=[rng.random(), rng.random(), 1.0], sparse=(sorted(rng.sample(range(10), 3)), [1.0, 0.5, 2.0])) for i in range(25)] for w in range(3)]
    for w, some in enumerate(rows):
        store(spark, table, some, f"w{w}", "active")
    seen, asked = table.visible(), table.visible().where("document_id LIKE '%7'").select(F.col("point_id").alias("query"), "dense", "sparse")
    found, counts = table.index().hybrid(asked, 5, view=table.view(table.heads()))
    want, expected = search.hybrid_batch(seen, asked, 5)
    key = lambda df: sorted((r.query, r.point_id, round(r.score, 9), r["rank"]) for r in df.collect())
    assert key(found) == key(want) and sorted(map(tuple, counts.collect())) == sorted(map(tuple, expected.collect()))
    assert set(CARRY) <= set(table.index().cells.rows.columns)


def test_status_of_no_table(spark, tmp_path):
    told = CorpusTable(spark, str(tmp_path / "none")).status().first()
    assert (told.table_exists, told.point_count, told.document_count, told.last_ingested_at, told.healthy) == (False, 0, 0, None, False)


def test_word_slots_make_no_table_of_texts_times_slots():
    texts = pa.array(["", " a ", "a b\na", "Ü é x", "a"] * 400)
    tracemalloc.start()
    near, listed, ends = vectors.word_slots(texts, 64, 1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20  # 125 MB as a table
    for i, t in enumerate(texts.to_pylist()[:5]):
        digests = [md5(w.encode()).digest() for w in set(t.split())]
        assert np.flatnonzero(near[i]).tolist() == sorted({int.from_bytes(d[:2], "big") % 64 for d in digests})
        assert listed[ends[i] : ends[i + 1]].tolist() == sorted({int.from_bytes(d[2:4], "big") for d in digests})


def test_a_term_that_a_row_has_twice(spark):
    terms = "array(named_struct('term', 'b', 'weight', 2f), named_struct('term', 'a', 'weight', 1f), named_struct('term', 'b', 'weight', 1f))"
    rows = spark.createDataFrame([("s", i) for i in (2, 0, 1)], "slice string, local int")
    got = {r.term: (r.n, r.low, r.top, r.locals, r.weights) for r in postings.blocks_of(rows, F.expr(terms)).collect()}
    assert got == {"a": (3, 1.0, 1.0, [0, 1, 2], [1.0] * 3), "b": (6, 1.0, 2.0, [0, 0, 1, 1, 2, 2], [1.0, 2.0] * 3)}
