import hashlib
import zlib
from collections import defaultdict
from math import log

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import fingerprints as fp
from corpusmill.llm import mixing, shards


def test_shards(docs, no_docs, rows):
    got = shards.shard_by_bytes(docs, shards=8).collect()
    want = sorted((r[0] if r[0] is not None else -(2**63), zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows)
    total, at, seen = sum(w[2] for w in want), 0, defaultdict(int)
    expected = []
    for i, crc, size in want:
        shard = min(7, int((2 * at + size) // (2 * total / 8)))
        expected.append((None if i == -(2**63) else i, size, crc, at, shard, seen[shard]))
        seen[shard] += 1
        at += size
    assert sorted(map(tuple, got), key=lambda r: r[3]) == expected
    assert shards.shard_by_bytes(no_docs).count() == 0


def test_mix_targets_and_reruns(docs, no_docs, rows):
    a = sorted(map(tuple, mixing.mix_to_targets(docs).collect()), key=repr)
    assert a == sorted(map(tuple, mixing.mix_to_targets(docs.repartition(2)).collect()), key=repr)
    assert len(a) == len(rows) and mixing.mix_to_targets(no_docs).count() == 0
    by, top = defaultdict(lambda: [0, 0, 0.0]), defaultdict(int)
    for _, source, size, source_size, target, _, _, taken in a:
        assert taken <= 2 * size
        by[source][0] += taken
        by[source][1], by[source][2] = source_size, target
        top[source] = max(top[source], size)
    total = sum(v[1] for v in by.values())
    assert sum(v[2] for v in by.values()) == pytest.approx(1.5 * total)
    weights = dict(zip(sorted((s for s in by if s is not None)) + [None], (5, 2, 1, 5, 2), strict=False))
    level = {s: v[2] / weights[s] for s, v in by.items() if v[2] < 2 * v[1] * (1 - 1e-9)}
    assert len({round(x, 6) for x in level.values()}) <= 1
    for s, (taken, source_size, target) in by.items():
        assert abs(taken - target) <= top[s] / 2 + 1e-6


def test_epochs_come_before_picks(docs):
    got = mixing.mix_to_targets(docs).where("size > 0")
    assert got.where("taken < epochs * size").count() == 0
    assert got.groupBy("_source").agg(F.countDistinct("epochs").alias("n")).where("n > 1").count() == 0


def test_mixed_documents_are_what_the_mix_takes(spark, docs, no_docs, rows):
    many = [(None, "the same words here", "en", "hot", 5, "x", 1, "y")] * 101 + [(7, "one two", "en", "hot", 1, "x", 1, "y")]
    hot = spark.createDataFrame(many, docs.schema).repartition(3)
    for df in (docs, hot, docs.unionByName(hot)):
        taken = defaultdict(int)
        for r in mixing.mix_to_targets(df).collect():
            taken[(r.doc_id, r._source)] += r.epochs + r.picked
        made = defaultdict(int)
        for r in mixing.mixed_documents(df).collect():
            made[(r.doc_id, r.source)] += 1
        assert made == {k: n for k, n in taken.items() if n}
        assert set(map(repr, mixing.mixed_documents(df).collect())) <= set(map(repr, df.collect()))
    assert mixing.mixed_documents(no_docs).count() == 0


def test_keys_prefer_quality(spark):
    many = spark.range(4000).selectExpr("id as doc_id", "CASE WHEN id % 2 = 0 THEN 'fivers fivers' ELSE 'x y' END AS text", "'s' AS source")
    r = mixing.mix_to_targets(many, share=0.5).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("picked").alias("n")).collect()
    n = {x.odd: x.n for x in r}
    assert n[0] > 1.5 * n[1]
    assert log(n[0] / n[1]) > 0.4


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def sketches(docs):
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return fp.with_sketch(base, F.col("t"), "s", k=16, words=5).collect()


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketch_sizes(sketches):
    for r in sketches:
        assert len(r.s) == min(16, len(shingle_set(r.t))) and r.s == sorted(r.s)
    by_text = defaultdict(set)
    for r in sketches:
        by_text[" ".join(x.decode() for x in words(r.t))].add(tuple(r.s))
    assert all(len(v) == 1 for v in by_text.values())


def test_estimates(spark):
    a = " ".join(f"w{i}" for i in range(1500))
    b = " ".join(f"w{i}" for i in range(500, 2000))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = fp.with_sketch(fp.with_sketch(df, F.col("a"), "sa", 512), F.col("b"), "sb", 512)
    sa, sb = F.col("sa"), F.col("sb")
    j, c, n, m = df.select(fp.resemblance(sa, sb, 512), fp.containment(sa, sb, 512), fp.distinct_shingles(sa, 512), fp.distinct_shingles(sb, 512)).first()
    assert j == pytest.approx(0.5, abs=0.08) and c == pytest.approx(0.667, abs=0.1) and n == pytest.approx(1496, rel=0.15) and m == pytest.approx(1496, rel=0.15)


def test_merge_equals_the_whole(spark):
    parts = spark.createDataFrame([("g", " ".join(f"w{i}" for i in range(a, a + 300))) for a in range(0, 900, 100)], "g string, t string")
    merged = fp.merge_by(fp.with_sketch(parts, F.col("t"), "s", 64), ["g"], "s", 64).first().s
    whole = spark.createDataFrame([(" ".join(f"w{i}" for i in range(1100)),)], "t string")
    assert merged == fp.with_sketch(whole, F.col("t"), "s", 64).first().s


def test_successors_and_edits(docs, no_docs, rows, spark, tmp_path):
    distinct = docs.dropDuplicates(["doc_id"])
    distinct.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fp.op6_bottom_k(spark, str(tmp_path)).collect()}
    texts = {r[0]: r[1] or "" for r in rows}
    order = sorted(texts, key=lambda i: (i is not None, i or 0))
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = texts[i], texts[j]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((got[i].near_edited, edited), (got[i].near_next, nxt)):
            a, b = shingle_set(t), shingle_set(other)
            if len(a | b) <= 128:
                assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert fp.fingerprint_documents(no_docs).count() == 0
