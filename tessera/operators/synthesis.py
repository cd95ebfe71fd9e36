"""Entity synthesis: facts without near repeats, subtopics, timeline."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

SIMILARITY, CONTAINMENT = 0.92, 0.75


def normalized(c) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))), r"\s+", " ")


def exact_facts(facts: DataFrame, by: str = "entity") -> DataFrame:
    """The most relevant fact of each normalised text."""
    order = Window.partitionBy(by, "__n").orderBy(F.desc("relevance"), "fact_id")
    return facts.withColumn("__n", normalized("text")).where("__n <> ''").withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "__n")


def alike(a: str, b: str) -> bool:
    """One holds the other and is not much longer, or their matching blocks cover nearly all."""
    if a in b or b in a:
        return min(len(a), len(b)) > CONTAINMENT * max(len(a), len(b))
    short, long_ = sorted((len(a), len(b)))
    if 2 * short < SIMILARITY * (short + long_):
        return False  # no blocks could cover enough
    return SequenceMatcher(None, a, b).ratio() >= SIMILARITY


def near_facts(facts: DataFrame, by: str = "entity", most: int = 50) -> DataFrame:
    """Greedy: facts by relevance, each kept unless it is alike to one kept before; at most ``most`` by entity."""
    slim = exact_facts(facts, by).select(by, "fact_id", "relevance", normalized("text").alias("n"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, str]] = []
        for row in pdf.sort_values(["relevance", "fact_id"], ascending=[False, True]).itertuples():
            if len(kept) >= most:
                break
            if not any(alike(row.n, k) for _, k in kept):
                kept.append((row.fact_id, row.n))
        return pd.DataFrame({by: pdf[by].iloc[0], "fact_id": [i for i, _ in kept], "place": range(1, len(kept) + 1)})

    schema = f"{by} {slim.schema[by].dataType.simpleString()}, fact_id {slim.schema['fact_id'].dataType.simpleString()}, place long"
    return slim.groupBy(by).applyInPandas(greedy, schema).join(facts, [by, "fact_id"])


def subtopics(facts: DataFrame, by: str = "entity") -> DataFrame:
    """Adds subtopic: the fact's most frequent word that is neither the entity's nor a stopword, the first one in a tie."""
    pattern = r"[\p{L}\p{N}_@-]+"
    words = facts.select(by, "fact_id", F.posexplode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(pattern), F.lit(0))).alias("pos", "w"))
    entity = F.regexp_extract_all(F.lower(F.col(by).cast("string")), F.lit(pattern), F.lit(0))
    own = words.where(~F.array_contains(F.array([F.lit(s) for s in text.STOPWORDS]), F.col("w")) & ~F.array_contains(entity, F.col("w")))
    counted = own.groupBy(by, "fact_id", "w").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counted.groupBy(by, "fact_id").agg(F.max_by("w", F.struct("n", -F.col("first"))).alias("w"))
    return facts.join(best, [by, "fact_id"], "left").withColumn("subtopic", F.coalesce(text.capital("w"), F.lit("General"))).drop("w")


def timeline(facts: DataFrame, by: str = "entity") -> DataFrame:
    order = Window.partitionBy(by).orderBy("ts", "fact_id")
    return facts.where("ts IS NOT NULL").withColumn("place", F.row_number().over(order).cast("long"))


def related(results: DataFrame) -> DataFrame:
    """Names that graph results point at: query_id, name, in order of first sight."""
    hits = results.where(F.array_contains("sources", "memgraph")).select("query_id", "rank", F.posexplode(F.regexp_extract_all("text", F.lit(r"->\s*([^;\n]+)"), F.lit(1))).alias("pos", "name"))
    named = hits.withColumn("name", F.trim("name")).where("name <> ''")
    return named.groupBy("query_id", F.lower("name").alias("key")).agg(F.min_by("name", F.struct("rank", "pos")).alias("name"), F.min(F.struct("rank", "pos")).alias("first"))
