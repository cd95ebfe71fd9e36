"""Ids that a model wrote, resolved to candidates: by ordinal, exactly, or by the longest candidate that begins with it or that it begins with.

Prefixes are joined as keys, of those lengths only that the other side has, so names are not compared with every candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a model puts before its list.
LABELS = ("RELEVANT_IDS", "RANKED_IDS", "NONE", "")


def parse_ids(said: Column) -> Column:
    """The ids of an answer's first line, in order, without brackets and quotes around them; none if it begins with NONE."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(said, F.lit("")), r"[\[\]\"';]", " "), r"^\s+|\s+$", "")
    parts = F.transform(F.split(F.substring_index(text, "\n", 1), r"[\s,]+"), lambda t: F.regexp_replace(t, r"\.+$", ""))
    kept = F.filter(parts, lambda t: ~F.upper(F.regexp_replace(t, ":+$", "")).isin(*LABELS))
    return F.when(F.startswith(F.upper(text), F.lit("NONE")), F.array().cast("array<string>")).otherwise(kept)


def ordinals(candidates: DataFrame) -> DataFrame:
    """Adds ordinal: R0, R1, .. by rank; more Rs where a candidate's own id is the same. candidates: query_id, rank (from 1), id."""
    own = candidates.groupBy("query_id").agg(F.collect_set(F.when(F.rlike(F.col("id").cast("string"), F.lit("^R+[0-9]+$")), F.col("id").cast("string"))).alias("__taken"))
    place = (F.col("rank") - 1).cast("string")
    free = F.filter(F.sequence(F.lit(1), F.size("__taken") + 1), lambda m: ~F.array_contains("__taken", F.concat(F.repeat(F.lit("R"), m), place)))
    return candidates.join(own, "query_id").withColumn("ordinal", F.concat(F.repeat(F.lit("R"), F.get(free, F.lit(0))), place)).drop("__taken")


def longest_prefix(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, name, id: the longest id that begins with the name or that the name begins with; of two as long the one of better rank.

    names: query_id, name (distinct); candidates: query_id, rank, id (string).
    """
    kept = candidates.select("query_id", "rank", "id", F.length("id").alias("size"))
    sizes = lambda df, c, out: df.groupBy("query_id").agg(F.collect_set(F.length(c)).alias(out))
    cut = lambda c, by: F.transform(F.filter(by, lambda n: n <= F.length(c)), lambda n: F.substring(c, F.lit(1), n))
    shorter = names.join(sizes(candidates, "id", "__n"), "query_id").select("query_id", "name", F.explode(cut(F.col("name"), F.col("__n"))).alias("id"))
    begun = shorter.join(kept, ["query_id", "id"])
    longer = kept.join(sizes(names, "name", "__n"), "query_id").select("query_id", "rank", "id", "size", F.explode(cut(F.col("id"), F.col("__n"))).alias("name"))
    begins = longer.join(names, ["query_id", "name"])
    columns = ["query_id", "name", "id", "rank", "size"]
    found = begun.select(columns).unionByName(begins.select(columns))
    return found.groupBy("query_id", "name").agg(F.min_by("id", F.struct(-F.col("size"), "rank")).alias("id"))


def resolve(named: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, pos, name, id: what names stand for; names that fit nothing are left out.

    named: query_id, pos, name; candidates: query_id, rank, id. Ordinals come first, then ids as they are, then prefixes.
    """
    kept = ordinals(candidates.withColumn("id", F.col("id").cast("string")))
    names = named.select("query_id", "name").where("name <> ''").distinct()
    first = names.join(kept.select("query_id", F.col("ordinal").alias("name"), F.col("id").alias("by_ordinal")), ["query_id", "name"], "left")
    second = first.join(kept.select("query_id", F.col("id").alias("name"), F.col("id").alias("by_id")).distinct(), ["query_id", "name"], "left")
    open_ = second.where("by_ordinal IS NULL AND by_id IS NULL").select("query_id", "name")
    settled = second.select("query_id", "name", F.coalesce("by_ordinal", "by_id").alias("id")).where("id IS NOT NULL")
    return named.select("query_id", "pos", "name").join(settled.unionByName(longest_prefix(open_, kept)), ["query_id", "name"])
