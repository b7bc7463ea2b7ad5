import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import identity, text, vectors
from corpusmill.operators import chunking, journal
from corpusmill.settings import load_settings
from corpusmill.sources import readers, routing  # noqa: F401  readers register their loaders when imported


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def samples(n=120, seed=3):
    rng = random.Random(seed)
    letters = "ab cd é　日,.#\n\t\x1c x1 "
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", " ", "\u0085a"]


def test_words_are_those_of_python(spark):
    texts = samples()
    assert column(spark, texts, text.words) == [t.split() for t in texts]
    assert column(spark, [None], text.words) == [None]


def test_uuid5(spark):
    names = samples() + ["tests/eval/corpus/note_technical.md|tests/eval/corpus/note_technical.md"]
    assert column(spark, names, identity.uuid5) == [str(uuid.uuid5(uuid.UUID(identity.NAMESPACE), n)) for n in names]


def test_gold_document_ids(spark):
    paths = ["tests/eval/corpus/note_raw_transcript.md", "tests/eval/corpus/note_prestructured.md", "tests/eval/corpus/note_technical.md"]
    want = ["6131b682-d4c2-5c9e-a78b-7d35067e0b12", "b39899a7-6a26-5ed7-a6d3-85c27a21119c", "b37eb527-d616-50e8-97ed-ce0952062741"]
    assert column(spark, paths, lambda x: identity.document_id(x, x)) == want


def test_occurrences(spark):
    texts = [t + "abAB" for t in samples()]
    for term in ("ab", "a", "aB", ""):
        assert column(spark, texts, lambda x: text.occurrences(x, F.lit(term))) == [t.lower().count(term.lower()) if term else 0 for t in texts]


def looks_like_text(data):
    odd = sum(b < 32 and b not in (9, 10, 11, 12, 13, 27) for b in data)
    return not data or (0 not in data and odd / len(data) <= 0.3)


def test_sniff(spark):
    rng = random.Random(1)
    blobs = [bytes(rng.choice([1, 7, 9, 27, 31, 65, 66, 200]) for _ in range(rng.randrange(30))) for _ in range(200)] + [b"", b"\x00", b"a\x00", bytes(range(1, 256))]
    assert column(spark, blobs, text.looks_like_text, "binary") == [looks_like_text(b) for b in blobs]


def windows(n, w, o, tail):
    out, at, step = [], 0, max(1, w - o)
    while n:
        out.append((at, min(n, at + w)))
        if at + w >= n:
            break
        at += step
    if len(out) > 1 and out[-1][1] - out[-1][0] < tail:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


@pytest.mark.parametrize("setting", [(220, 40, 80), (50, 5, 80), (10, 10, 3), (7, 9, 0), (20, 5, 8)])
def test_windows(spark, setting):
    sizes = [*range(0, 70), 219, 220, 221, 400, 479, 480, 1000]
    got = column(spark, sizes, lambda n: chunking.windows(n, *setting), "int")
    assert [[(r.start, r.end) for r in x] for x in got] == [windows(n, *setting) for n in sizes]


def test_redaction(spark):
    jwt, digest, key = "eyJ" + "a" * 30, "0f" * 20, "Ab12" * 12
    texts = [f"see {jwt} and {digest}", f"k {key}==", f"k {key}==x", f"{key}+ {digest}z", "short abc123", "/an/absolute/path/to/some/file/that/is/long.txt"]
    want = list(texts)
    for pattern in text.SECRETS:
        want = [re.sub(pattern, "[REDACTED]", t) for t in want]
    assert column(spark, texts, text.redact) == want and want[0] == "see [REDACTED] and [REDACTED]" and want[-2:] == texts[-2:]
    assert column(spark, [{"Token": "x", "note": "a" * 40, "n": None}], text.redact_map, "map<string,string>") == [{"Token": "[REDACTED]", "note": "[REDACTED]", "n": None}]


def test_journal(spark):
    rows = spark.createDataFrame([("RUN_START", {"paths": "p", "other": "x"}), ("TELEMETRY", {"a": "b"})], "event string, detail map<string,string>")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in journal.FREE_TEXT})
    assert [r.detail for r in journal.prepared(rows).collect()] == [{"paths": "p"}, {}]
    with pytest.raises(Exception, match="unknown event"):
        journal.prepared(rows.withColumn("event", F.lit("NOPE"))).collect()


def test_sentences_and_tokens(spark):
    got = column(spark, ["One is here. Two! [source: a.md] Three?  ", "", None], text.sentences)
    assert got == [["One is here.", "Two!", "Three?"], [], None]
    assert column(spark, ["The Café has 2 big x_rays"], text.gate_tokens) == [["caf", "big", "rays"]]


def test_vectors(spark):
    assert column(spark, [{10: 0.5, 9: 1.0, 100: 2.0}], vectors.sparse_vector, "map<int,float>")[0].asDict() == {"indices": [9, 10, 100], "values": [1.0, 0.5, 2.0]}
    texts = ["a b c", "", "b b B"]
    import hashlib

    for t, dense, sparse in zip(texts, column(spark, texts, lambda x: vectors.hash_dense(x, 64)), column(spark, texts, vectors.hash_sparse)):
        slots = {int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64 for w in set(t.lower().split())}
        assert [i for i, v in enumerate(dense) if v] == sorted(slots) and len(dense) == 64
        assert not slots or sum(v * v for v in dense) == pytest.approx(1)
        assert sparse.indices == sorted({int(hashlib.md5(w.encode()).hexdigest()[4:8], 16) % 30000 for w in set(t.lower().split())})
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert zero.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] is None


def test_routing(spark):
    paths = ["/a/b.PDF", "x.docx", "y.md", "noext", "z.tar.gz", ".hidden"]
    assert column(spark, paths, routing.source_type) == ["pdf", "docx", "markdown", None, None, None]
    rows = spark.createDataFrame([("a.xyz", b"plain"), ("b.xyz", b"\x00\x01"), ("c.md", b"\x00")], "p string, c binary")
    got = [r[0].asDict() for r in rows.select(routing.resolve(F.col("p"), F.col("c"))).collect()]
    assert got[0] == {"source_type": "markdown", "sniffed": True, "error": None}
    assert got[1]["source_type"] is None and "looks binary" in got[1]["error"]
    assert got[2] == {"source_type": "markdown", "sniffed": False, "error": None}
    with pytest.raises(ValueError):
        routing.register_loader("markdown", len)
    with pytest.raises(TypeError):
        routing.register_loader("new", 3)
    with pytest.raises(KeyError, match="markdown"):
        routing.get_loader("none")


def test_settings():
    assert load_settings({"CORPUSMILL_WINDOW_WORDS": "50", "CORPUSMILL_RRF_K": "x", "CORPUSMILL_COLLECTION": "c2"}) == load_settings({}).__class__(window_words=50, collection="c2")


MARKDOWN = """# Top

First *prose* with `code` and [a link](http://x).
soft break.

## Sub
| a | b |
|---|---|
| 1 | 2 |

```py
x = 1

y = 2
```
Under
=====
last words
"""


def test_markdown_blocks(spark):
    assert list(chunking.blocks(MARKDOWN)) == [
        ("heading", 1, "Top"),
        ("prose", 0, "First prose with `code` and a link. soft break."),
        ("heading", 2, "Sub"),
        ("table", 0, "a b\n1 2"),
        ("code", 0, "```py\nx = 1\n\ny = 2\n```"),
        ("heading", 1, "Under"),
        ("prose", 0, "last words"),
    ]
    big = "# H\n\n" + "\n\n".join(" ".join(f"w{i}" for i in range(30)) for _ in range(4)) + "\n\n```\n" + "z " * 100 + "\n```"
    rows = spark.createDataFrame([(1, MARKDOWN, "x"), (2, big, None), (3, "", None), (4, None, None)], "doc_id int, text string, heading string")
    got = {}
    for r in chunking.chunk_markdown(rows, "text", 50, 5, 8).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {1, 2}
    assert [(c.heading_path, c.text.split()[0]) for c in got[1]] == [("# Top", "First"), ("# Top | ## Sub", "a"), ("# Top | ## Sub", "```py"), ("# Under", "last")]
    assert [c.chunk_index for c in got[2]] == [0, 1, 2, 3, 4] and [len(c.text.split()) for c in got[2]] == [30, 30, 30, 30, 102]
    assert [(c.chunk_start_word, c.chunk_end_word) for c in got[2]][:2] == [(2, 32), (32, 62)]
    assert all(re.search("w0", c.text) for c in got[2][:4])


def test_tokens_of_a_text_are_told_as_by_listing_them(spark):
    texts = ["the", "The end", "other", "the_", "_the the", "\U0001d400the", "the\U0001d400", "\U0001d400 the\U0001d7d9 the", "日本the", "日本 the", "x the\u0301", "the" * 9, "12the 12", "", "\U0001f642the\U0001f642", "ethe thee the-"]
    queries = ["the", "The 12", "12", "日本", "\U0001d400", "the_", "", "...", "the x"]
    df = spark.createDataFrame([(t, q) for t in texts for q in queries], "t string, q string")
    wanted, held = text.tokens(F.col("q")), text.tokens(F.col("t"))
    listed = (F.size(wanted) > 0) & (F.size(F.array_except(wanted, held)) == 0)
    rows = df.select("t", "q", text.has_all_tokens(F.col("t"), F.col("q")).alias("got"), listed.alias("want")).collect()
    assert [r for r in rows if r.got != r.want] == [] and {r.want for r in rows} == {True, False}


def test_first_words_need_no_more_than_the_first(spark):
    """Texts whose first words, or specific word, come before, at or after the end of what is looked at first."""
    base = [" ".join(["ab"] * n + ["telling", "words"]) for n in (0, 5, 30, 31, 32, 33, 80)]
    texts = [lead + t + tail for t in base for lead in ("", " \u3000", "# heading\n") for tail in ("", " ", "\n#only about")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    told = [F.array_join(F.slice(text.words(F.col("t")), 1, 10), " ").alias("ten"), text.first_words(F.col("t")).alias("got"), text.specific_word(F.col("t")).alias("word"), text.body_word(F.col("t")).alias("body")]
    for r in df.select("t", *told).collect():
        assert r.got == r.ten and r.word == ("heading" if "# heading" in r.t else "telling") and r.body == "telling"
    plan = df.select(text.first_words(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert ", 12)" in plan  # the split ends there


def test_one_term_is_scanned_without_an_index(spark, monkeypatch):
    from corpusmill.queries import QUERIES, prepared

    monkeypatch.setattr(prepared, "build_index", None)
    assert QUERIES["lexscan_counts"](spark, "/root/testdata/sf0.001").first().chunk_count > 0
    assert QUERIES["lexscan_rows"](spark, "/root/testdata/sf0.001").count() > 0
