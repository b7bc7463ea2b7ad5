"""Retrieval metrics over ranked results (case_id, rank, document_id) and gold sets (case_id, document_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(cases: DataFrame, ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """case_id, recall_at_<k> and mrr.

    Recall is 1 if any gold document is among the first k, else 0; a case without
    gold documents has recall 1. The reciprocal rank of the first hit is 0 without one.
    """
    hits = ranked.join(gold.select("case_id", "document_id").distinct(), ["case_id", "document_id"], "left_semi")
    first = hits.groupBy("case_id").agg(F.min("rank").alias("~first"))
    some = gold.select("case_id").distinct().withColumn("~gold", F.lit(True))
    out = cases.select("case_id").distinct().join(first, "case_id", "left").join(some, "case_id", "left")
    recall = {f"recall_at_{k}": F.when(F.col("~gold").isNull() | (F.col("~first") <= k), 1.0).otherwise(0.0) for k in ks}
    return out.select("case_id", *(c.alias(n) for n, c in recall.items()), F.coalesce(F.lit(1.0) / F.col("~first"), F.lit(0.0)).alias("mrr"))


def summary(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """One row: cases, those that meet every threshold, and the mean of each metric."""
    met = F.lit(True)
    for name, least in thresholds.items():
        met = met & (F.col(name) >= least)
    means = [F.avg(c).alias(c) for c in metrics.columns if c != "case_id"]
    return metrics.agg(F.count("*").alias("cases"), F.count_if(met).alias("passed"), *means)
