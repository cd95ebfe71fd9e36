"""Fusion of ranked lists. A ranked list: query_id, list_name, list_pos, rank, id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text


def as_list(ranked: DataFrame, name: str, pos: int) -> DataFrame:
    return ranked.select("query_id", F.lit(name).alias("list_name"), F.lit(pos).alias("list_pos"), "rank", "id", *(["score"] if "score" in ranked.columns else []))


def lists(*ranked: tuple[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (as_list(df, name, i) for i, (name, df) in enumerate(ranked)))


def rrf(ranked: DataFrame, k: int = scoring.RRF_K, limit: int | None = None, weight: Column | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion: one union and one aggregate.

    Lists that weigh nothing or less are out; ties go to the earlier list, the better
    rank in it, the smaller id.
    """
    w = F.lit(1.0) if weight is None else weight
    live = ranked.withColumn("w", w).where("w > 0")
    best = F.min(F.struct("list_pos", "rank"))
    fused = live.groupBy("query_id", "id").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), best.alias("first"), F.array_sort(F.collect_set(F.struct("list_pos", "list_name"))).alias("from"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "first", "id")
    out = fused.withColumn("rank", F.row_number().over(order).cast("long"))
    if limit is not None:
        out = out.where(F.col("rank") <= limit)
    return out.select("query_id", "rank", "id", "score", F.transform("from", lambda x: x["list_name"]).alias("sources"))


def static_weight(weights: dict[str, float]) -> Column:
    table = F.create_map([F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(table[F.col("list_name")], F.lit(1.0))


def adaptive_weight(query_text: str, override: dict[str, float] | None = None) -> Column:
    """Weight of a list under the profile of its query's shape; an override wins."""
    shape, out = text.query_shape(query_text), None
    for name, profile in scoring.WEIGHT_PROFILES.items():
        value = static_weight(profile) if profile else F.lit(1.0)
        out = F.when(shape == name, value) if out is None else out.when(shape == name, value)
    if override:
        table = F.create_map([F.lit(x) for k, v in override.items() for x in (k, float(v))])
        return F.coalesce(table[F.col("list_name")], out)
    return out


def merge_sources(ranked: DataFrame, payload: list[str], vector_list: str = "vector") -> DataFrame:
    """Per id the first list's payload, all sources in list order, and the best raw vector score."""
    first = [F.min_by(c, F.struct("list_pos", "rank")).alias(c) for c in payload]
    raw = F.max(F.when(F.col("list_name") == vector_list, F.col("score"))).alias("raw_vector_score")
    return ranked.groupBy("query_id", "id").agg(*first, F.transform(F.array_sort(F.collect_set(F.struct("list_pos", "list_name"))), lambda x: x["list_name"]).alias("sources"), raw)


def vector_floor(results: DataFrame, vector: DataFrame, n: int, decay: float = 0.999) -> DataFrame:
    """Appends the best n vector hits that are missing, each a little under the one before."""
    if n <= 0:
        return results.select("query_id", "rank", "id", "score")
    last = results.groupBy("query_id").agg(F.min("score").alias("floor"), F.max("rank").alias("last"))
    missing = vector.where(F.col("rank") <= n).select("query_id", "id", F.col("rank").alias("vrank")).join(results.select("query_id", "id"), ["query_id", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("vrank", "id"))
    added = missing.withColumn("place", place).join(last, "query_id", "left")
    added = added.select("query_id", (F.coalesce("last", F.lit(0)) + F.col("place")).cast("long").alias("rank"), "id", (F.coalesce("floor", F.lit(1.0)) * F.pow(F.lit(decay), F.col("place"))).alias("score"))
    return results.select("query_id", "rank", "id", "score").unionByName(added)


def fallback_merge(results: DataFrame, fallback: DataFrame) -> DataFrame:
    """Shared ids keep the higher score; ids only of the fallback come in under the rest."""
    least = results.groupBy("query_id").agg(F.min("score").alias("least"))
    a, b = results.select("query_id", "id", F.col("score").alias("own")), fallback.select("query_id", "id", F.col("score").alias("other"))
    both = a.join(b, ["query_id", "id"], "full_outer").join(least, "query_id", "left")
    score = F.when(F.col("own").isNotNull(), F.greatest("own", "other")).otherwise(F.least(0.5 * F.col("other"), F.coalesce(F.col("least") - 0.01, 0.5 * F.col("other"))))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return both.select("query_id", "id", score.alias("score")).withColumn("rank", F.row_number().over(order).cast("long"))


def expand(ranked_by_variant: DataFrame, k: int = scoring.RRF_K, limit: int | None = None) -> DataFrame:
    """Fuses the results of query variants (query_id, variant, rank, id): the variants are the lists."""
    return rrf(ranked_by_variant.withColumn("list_name", F.col("variant").cast("string")).withColumn("list_pos", F.col("variant")), k, limit)


def token_budget(results: DataFrame, budget: int, tokens: Column) -> DataFrame:
    """The ranked prefix whose tokens fit the budget; the first that overruns ends it."""
    if budget <= 0:
        raise ValueError(f"a token budget is positive, not {budget}")
    used = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("tokens", tokens.cast("long")).withColumn("used", used).where(F.col("used") <= budget)
