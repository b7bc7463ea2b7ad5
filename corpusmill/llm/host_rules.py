"""Quality rules with host-level verdicts.

Every document is measured and held against fixed rules. Rule failures are counted
by host. The hosts' failure rates are taken as draws from a beta distribution whose
parameters come from all hosts (moments of the rates, weighted by documents), and
each host's rate is shrunk towards the prior mean. Documents of a host whose shrunk
rate is above ``max_rate`` go, besides those that fail themselves.

The measures are computed once and written; hosts are counted with partial sums, so
a hot host is no burden, and verdicts are joined back to the slim rows of measures.

Defined cases: a null text has no words and fails; null hosts form one host; repeated
rows count each; one lone host keeps its prior's rate, so its own; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash

#: The characters that count as symbols, and those between words.
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_RATE = 50, 50, 0.5


def repeated_words(words: list) -> int:
    """How many words stand in a 3-word window that is found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, reach = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(reach, i)
            reach = i + 3
    return covered


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def document_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """_id, _host and the five measures of every text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [measure(t or "") for t in batch.column(2).to_pylist()]
            columns = [pa.array([m[i] for m in made], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["_id", "_host", *names])

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(host_col).cast("string").alias("_host"), F.col(text_col).cast("string").alias("_text"))
    return slim.mapInArrow(run, "_id bigint, _host string, " + ", ".join(f"{n} bigint" for n in names))


def host_rates(failures: DataFrame) -> DataFrame:
    """(_host, _failed 0/1) to _host, n_docs, n_failed, shrunk_rate."""
    hosts = failures.groupBy("_host").agg(F.count("*").alias("n_docs"), F.sum("_failed").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    n, hit, squares, least = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.sum(rate * rate * F.col("n_docs")), F.count("*")).first()
    a, b = beta_prior(n or 0, hit or 0, squares or 0.0, least)
    return hosts.withColumn("shrunk_rate", (F.col("n_failed") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b)))


def beta_prior(docs: int, failed: int, squares: float, hosts: int) -> tuple[float, float]:
    """Parameters of the beta distribution with the mean and variance of the hosts' rates.

    The strength is kept between 2 and 1000 documents: rates that do not vary, or
    vary more than a beta distribution can, give no estimate of it.
    """
    if not docs:
        return 1.0, 1.0
    mean = min(max(failed / docs, 1e-6), 1 - 1e-6)
    spread = max(squares / docs - (failed / docs) ** 2, 0.0)
    strength = min(max(mean * (1 - mean) / spread - 1 if spread > 0 and hosts > 1 else 1000.0, 2.0), 1000.0)
    return mean * strength, (1 - mean) * strength


def apply_host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Measures, base_failed, the host's shrunk rate and kept, of every document."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = stash(document_measures(docs, id_col, text_col, host_col).withColumn("base_failed", base_failed), "measures")
    rates = host_rates(measured.select("_host", F.col("base_failed").cast("int").alias("_failed")))
    m, r = measured.alias("m"), rates.alias("r")
    joined = m.join(r, F.col("m._host").eqNullSafe(F.col("r._host")))
    kept = ~F.col("base_failed") & (F.col("shrunk_rate") <= max_rate)
    return joined.select(F.col("m._id").alias(id_col), F.col("m._host").alias("host"), *(c for c in measured.columns if c[0] != "_"), "shrunk_rate", kept.alias("kept"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) > 2)),
twice AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM base),
dups AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT base.r, doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN rep ON base.r = rep.r LEFT JOIN dups ON base.r = dups.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f GROUP BY source),
mom AS (
  SELECT greatest(least(sum(k) / sum(n), 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) AS mu,
         greatest(sum((k / n) * (k / n) * n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)), 0) AS v, count(*) AS h FROM hosts),
prior AS (SELECT mu, least(greatest(CASE WHEN v > 0 AND h > 1 THEN mu * (1 - mu) / v - 1 ELSE 1000 END, 2), 1000) AS s FROM mom)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (k + mu * s) / (n + s) <= 0.5 AS kept
FROM f JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source, prior
"""
