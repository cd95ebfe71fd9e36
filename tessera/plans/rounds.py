"""What follows a first answer: a second round of recall where it is not sure of itself, and exact names for general words.

Both work on the rows that need it, ask the model and recall about these alone, and leave all others as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fuse
from ..sources.tables import written
from .answers import ABSTAIN, answer
from .plugins import Model, ask
from .recall import context_lines

Recall = Callable[[DataFrame], DataFrame]


def should_retry(said: Column, confidence: Column, threshold: float = 0.4, abstention: str = ABSTAIN) -> Column:
    """No answer, an abstention, or less confidence than the threshold."""
    text = F.lower(F.coalesce(said, F.lit("")))
    return (text == "") | F.contains(text, F.lit("not in memory")) | F.contains(text, F.lit(abstention.lower())) | F.coalesce(confidence < threshold, F.lit(True))


def decompose(queries: DataFrame, model: Model, most: int = 4) -> DataFrame:
    """query_id, sub (from 1), text: short queries for evidence, as the model lists them in JSON; none where it does not."""
    prompt = F.concat(F.lit('Two to five words each, different angles, as JSON {"queries": [..]}: what evidence would answer: '), "text")
    said = F.regexp_replace(F.coalesce(ask(prompt, model), F.lit("")), r"(?m)^\s*```(?:json)?\s*|\s*```\s*$", "")
    listed = F.from_json(said, "queries array<string>")["queries"]
    kept = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return queries.select("query_id", F.posexplode(F.slice(kept, 1, most)).alias("sub", "text")).withColumn("sub", F.col("sub") + 1)


def merged_results(results: DataFrame, found: DataFrame, queries: DataFrame, most: int = 30) -> DataFrame:
    """A query's first list and those of its sub-queries, fused by rank. found: as results, with sub."""
    lists = results.select("query_id", F.lit("first").alias("list_name"), F.lit(0).alias("list_pos"), "rank", "id")
    lists = lists.unionByName(found.select("query_id", F.concat(F.lit("sub"), F.col("sub").cast("string")).alias("list_name"), F.col("sub").alias("list_pos"), "rank", "id"))
    fused = fuse.rrf(lists, limit=most).select("query_id", "rank", "id", "score")
    told = results.select("query_id", "id", "text", "source").unionByName(found.select("query_id", "id", "text", "source")).groupBy("query_id", "id").agg(F.min(F.struct("text", "source")).alias("t"))
    return fused.join(told, ["query_id", "id"]).join(queries.select("query_id", F.col("text").alias("query")), "query_id").select("query_id", "rank", "id", "score", "t.*", "query")


def second_round(queries: DataFrame, drafts: DataFrame, results: DataFrame, model: Model, recall: Recall, threshold: float = 0.4, accept: float = 0.5, rounds: int = 1, memories: int = 15) -> tuple[DataFrame, DataFrame]:
    """(answers, results) after at most ``rounds`` further rounds.

    Queries whose draft is to be retried are decomposed; their parts are recalled together as one batch, fused with what was
    found before, and answered again. An answer that is not an abstention and has confidence ``accept`` takes the draft's place, with its results;
    otherwise both stay. recall: (query_id, text) -> query_id, rank, id, text, source, in the scope of the first round.
    """
    columns = ["query_id", "rank", "id", "score", "text", "source", "query"]
    results = results.select(columns)
    for _ in range(rounds):
        low = queries.join(drafts.where(should_retry(F.col("answer"), F.col("confidence"), threshold)).select("query_id"), "query_id", "left_semi")
        subs = written(decompose(low, model).withColumn("key", F.concat_ws("#", F.col("query_id").cast("string"), F.col("sub").cast("string"))))
        if subs.isEmpty():
            break
        asked = low.join(subs.select("query_id").distinct(), "query_id", "left_semi")
        found = recall(subs.select(F.col("key").alias("query_id"), "text")).withColumnRenamed("query_id", "key").join(subs.select("key", "query_id", "sub"), "key").drop("key")
        merged = written(merged_results(results.join(asked.select("query_id"), "query_id", "left_semi"), found, queries))
        again = answer(asked.join(merged.select("query_id").distinct(), "query_id", "left_semi"), merged, model, memories)
        good = written(again.where(~should_retry(F.col("answer"), F.col("confidence"), accept)))
        drafts = written(drafts.join(good.select("query_id"), "query_id", "left_anti").unionByName(good))
        results = results.join(good.select("query_id"), "query_id", "left_anti").unionByName(merged.join(good.select("query_id"), "query_id", "left_semi").select(columns))
    return drafts, results


# Words that stand for a name, and what to look up for them.
POSSESSED = "country home pet dog cat book job friend colleague spouse sister brother son daughter company school university city town".split()
NAMED = "book movie film game song place colleague friend city town country someone something".split()
CATEGORIES = ("video games", "social media")
LOOKUPS = {
    "country": "specific name of country where the person lives or is from",
    "home": "specific home country or hometown",
    "pet": "specific pet name",
    "dog": "specific dog name",
    "cat": "specific cat name",
    "book": "specific book title",
    "movie": "specific movie title",
    "film": "specific film title",
    "game": "specific game title or platform",
    "friend": "specific person's name",
    "colleague": "specific colleague's name",
    "someone": "specific person's name",
    "spouse": "specific spouse's name",
    "sister": "specific sister's name",
    "brother": "specific brother's name",
    "son": "specific son's name",
    "daughter": "specific daughter's name",
    "company": "specific company name",
    "school": "specific school name",
    "university": "specific university name",
    "city": "specific city name",
    "town": "specific town name",
    "place": "specific place or location name",
    "song": "specific song title",
    "video games": "specific video game titles or platforms",
    "social media": "specific social media platform",
}
_SPAN = re.compile(
    rf"\b(?:(?:her|his|their)\s+(?:(?:home|best)\s+)?(?P<own>{'|'.join(POSSESSED)})|(?:an?|the|that)\s+(?P<one>{'|'.join(NAMED)})|(?P<kind>{'|'.join(CATEGORIES)}))\b", re.I
)
_NAME_AFTER = re.compile(r"\s+[A-Z][\w'’-]+")


def find_placeholders(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, phrase, what to look up) of general phrases that no name follows, each phrase once, in order."""
    out: dict[str, tuple[int, int, str, str]] = {}
    for m in _SPAN.finditer(text or ""):
        phrase = m[0]
        if not _NAME_AFTER.match(text, m.end()):
            noun = (m["own"] or m["one"] or m["kind"]).lower()
            out.setdefault(phrase.lower(), (m.start(), m.end(), phrase, LOOKUPS.get(noun, f"specific name for {phrase}")))
    return list(out.values())


_PLACEHOLDER = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("phrase", T.StringType()), T.StructField("lookup", T.StringType())]))


@F.pandas_udf(_PLACEHOLDER)
def placeholders(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("start", "end", "phrase", "lookup"), p, strict=True)) for p in find_placeholders(t)])


def rewrite(said: Column, spans: Column) -> Column:
    """A text with some of its spans (start, end, name; sorted, apart) put in other words; all else keeps its place and spelling."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.substring(said, s["at"] + 1, x["start"] - s["at"]), x["name"]).alias("out"), x["end"].alias("at"))
    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(said, s["at"] + 1, F.length(said))))


def specify(queries: DataFrame, drafts: DataFrame, model: Model, recall: Recall, memories: int = 15) -> DataFrame:
    """drafts with exact names for general phrases, where recall finds memories that hold the name which the model gives.

    Every phrase of every draft is a query of its own, all recalled as one batch. A name that its memories do not hold, NONE, or a failure leaves the phrase.
    """
    spans = drafts.select("query_id", F.posexplode(placeholders("answer")).alias("n", "p")).select("query_id", "n", "p.*").withColumn("key", F.concat_ws("#", F.col("query_id").cast("string"), F.col("n").cast("string")))
    asked = written(spans.join(queries.select("query_id", F.col("text").alias("question")), "query_id"))
    if asked.isEmpty():
        return drafts
    found = written(recall(asked.select(F.col("key").alias("query_id"), F.concat_ws(" ", "lookup", "question").alias("text"))).where(F.col("rank") <= memories))
    lines = context_lines(found, most=memories).withColumnRenamed("query_id", "key")
    prompt = F.concat(F.lit("The exact name for '"), "phrase", F.lit("' ("), "lookup", F.lit("), or NONE.\nQuestion: "), "question", F.lit("\nMemories:\n"), "context")
    named = asked.join(lines, "key").withColumn("name", F.regexp_replace(F.coalesce(ask(prompt, model), F.lit("")), r"^[\s\"'.]+|[\s\"'.]+$", "")).where("name <> '' AND upper(name) <> 'NONE'")
    held = found.select(F.col("query_id").alias("key"), "text").join(named.select("key", "name"), "key").where(F.contains(F.lower("text"), F.lower("name"))).select("key").distinct()
    sure = named.join(held, "key").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "name"))).alias("__spans"))
    joined = drafts.join(sure, "query_id", "left")
    return joined.withColumn("answer", F.when(F.col("__spans").isNull(), F.col("answer")).otherwise(rewrite(F.col("answer"), F.col("__spans")))).select(drafts.columns)
