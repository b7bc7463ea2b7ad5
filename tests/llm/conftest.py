import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _text int, size string"


def make_rows(seed=7, n=60):
    """Rows with nulls, empty and long texts, ties, repeated rows and clashing column names."""
    rng = random.Random(seed)
    vocab = ["the", "of", "Été", "mañana", "über", "x1", "12", "don't", "日本語", "🙂🙂", "&&&", "|", "a\tb", "end."]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 4, 5, 30, 200]))) for _ in range(n)]
    texts += [None, "", "   ", "\n\n", "a", "<|endoftext|>", "x <|endoftext|>\n y", " \x1c 　z", "é \U0001e900", "z" * 5000, "word " * 4000]
    texts += [texts[3], texts[3], texts[5] + " tail"]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["src0", "src0", "src1", "Ωmega", None]), len(t or ""), "x", 1, "y") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "null id", None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
