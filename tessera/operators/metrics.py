"""Retrieval quality, latency and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval(probes: DataFrame, ks=(1, 5, 20)) -> DataFrame:
    """recall@k, and MRR over found probes and over all. probes: probe_id, rank (null: not found)."""
    recall = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks]
    return probes.agg(*recall, F.avg(1 / F.col("rank")).alias("mrr_found"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr_all"), F.count("*").alias("probes"))


def accuracy(answers: DataFrame, category: str = "category", correct: str = "correct") -> DataFrame:
    """Accuracy by category and over all (null category)."""
    return answers.rollup(category).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("n_correct"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def nearest_rank(samples: DataFrame, by: list[str], value: str, ps=(0.5, 0.9, 0.99)) -> DataFrame:
    """Count, sum and quantiles by nearest rank: the value at index round-half-even(p (n - 1))."""
    ordered = Window.partitionBy(*by).orderBy(value)
    placed = samples.withColumn("__i", F.row_number().over(ordered) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    picks = [F.max(F.when(F.col("__i") == F.bround(F.lit(p) * (F.col("__n") - 1), 0).cast("long"), F.col(value))).alias(f"p{int(p * 100)}") for p in ps]
    return placed.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), *picks)


def counters(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("n"))
