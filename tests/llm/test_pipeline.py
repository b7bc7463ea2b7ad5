"""The pipeline on a small corpus, each stage against what it must keep, drop and return."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from corpusmill.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9))) for _ in range(2500)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(150)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]  # copies
    for i in range(10, 20):  # near copies
        w = rows[i][1].split()
        w[70] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, prose(80) + " " + passage + " " + prose(80)) for i in range(12)]  # a shared passage
    junk = [(400 + i, " ".join(w + "&&&##" for w in prose(90).split())) for i in range(10)]
    junk += [(420 + i, (rng.choice(vocab) + " ") * 120) for i in range(10)]
    rows += junk + [(500, None), (501, ""), (None, prose(120))]
    return [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], {i for i, _ in junk}, passage


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows, junk, passage = corpus()
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, int(i not in junk), 0) for i, *_ in rows if i is not None and i % 3 == 0], "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    docs, out = spark.read.parquet(str(folder / "documents.parquet")), {}
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, str(folder))
        if name != "tokenise":
            assert made.dtypes == docs.dtypes
        path = str(folder / name)
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return rows, junk, passage, out, str(folder)


def test_quality(stages):
    rows, junk, _, out, _ = stages
    kept = {r.doc_id for r in out["quality"]}
    clean = {r[0] for r in rows} - junk
    assert len(kept & junk) == 0 and kept >= clean


def test_near_dedup(stages):
    kept = Counter(r.doc_id for r in stages[3]["near_dedup"])
    assert all(kept[i] == 1 for i in range(60)) and not any(kept[100 + i] for i in range(10)) and not any(kept[i] for i in range(210, 220))
    assert all(kept[300 + i] == 1 for i in range(12)) and kept[None] == 1 and kept[500] + kept[501] == 1


def test_repeats(stages):
    _, _, passage, out, _ = stages
    before = {r.doc_id: r.text or "" for r in out["near_dedup"]}
    after = {r.doc_id: r for r in out["repeats"]}
    assert sum(passage in r.text for r in after.values()) == 1 and passage in after[300].text
    assert after.keys() == before.keys()
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        if i is None or i < 300 or i >= 320:
            assert r.text == before[i]


def test_mix_and_tokens(stages, spark):
    _, _, _, out, folder = stages
    have = {r.doc_id: r for r in out["repeats"]}
    times = Counter(r.doc_id for r in out["mix"])
    want = {r.doc_id: r.epochs + r.picked for r in mixing.mix_to_targets(spark.read.parquet(f"{folder}/repeats")).collect()}
    assert times == Counter({i: n for i, n in want.items() if n}) and max(times.values()) <= 2
    assert all(tuple(r) == tuple(have[r.doc_id]) for r in out["mix"])
    by = Counter()
    for r in out["mix"]:
        by[r.source] += len(r.text.split())
    total = sum(len(r.text.split()) for r in have.values())
    assert sum(by.values()) == pytest.approx(1.5 * total, rel=0.05)
    assert len(out["tokenise"]) == len(out["mix"]) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in out["tokenise"])


def test_run(spark, stages):
    got = pipeline.run(spark, stages[4]).select("doc_id", "n_tokens").collect()
    assert Counter(map(tuple, got)) == Counter((r.doc_id, r.n_tokens) for r in stages[3]["tokenise"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark):
    rows, _, _ = corpus()
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA + ", _id int, _row string, `~row` int, `~fp` int, `~copies` int")
    made = pipeline.near_dedup(spark, df, "")
    assert made.columns == df.columns and np.all([r._row == "x" for r in made.collect()])
    assert pipeline.repeats(spark, df, "").columns == df.columns and pipeline.mix(spark, df, "").columns == df.columns
