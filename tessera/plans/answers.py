"""Plans around a language model: hypothetical documents, query variants, reranking, answers, extraction.

The model is a plain callable (``plugins.Model``); prompts are columns. A model that
fails leaves the plain result in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import prefixes
from .plugins import Embedder, Model, ask, embed, parse_answer
from .recall import context_lines

ABSTAIN = "Not in memory."
INSTRUCTIONS = {
    "list": "List every item that the memories name.",
    "count": "Count the items that the memories name.",
    "temporal": "Answer with the date or time.",
    "multihop": "Combine the memories to answer.",
    "inference": "Say what the memories make likely.",
    "adversarial": "Say so if the memories never mention it.",
    "general": "Answer from the memories alone.",
}
_LINES = r"(?m)^\s*(?:[-*•]|\d+[.)])?\s*(.+?)\s*$"


def hypothetical(queries: DataFrame, model: Model, embedder: Embedder) -> DataFrame:
    """queries with vec of a document that would answer them; the query's own text where the model fails."""
    prompt = F.concat(F.lit("Write a short note that answers: "), "text")
    guessed = queries.withColumn("__doc", F.coalesce(F.nullif(ask(prompt, model), F.lit("")), "text"))
    return embed(guessed, embedder, "__doc").withColumnRenamed("embedding", "__vec").withColumn("vec", F.col("__vec")).drop("__doc", "__vec")


def variants(queries: DataFrame, model: Model, n: int = 3, lists_only: bool = False) -> DataFrame:
    """query_id, variant (0: the query itself), text: paraphrases without repeats."""
    said = ask(F.concat(F.lit(f"Rewrite in {n} other ways, one a line: "), "text"), model)
    wanted = text.is_list_question("text") if lists_only else F.lit(True)
    lines = F.when(wanted, F.regexp_extract_all(F.coalesce(said, F.lit("")), F.lit(_LINES), F.lit(1))).otherwise(F.array().cast("array<string>"))
    own = F.filter(F.array_distinct(lines), lambda x: F.lower(x) != F.lower(F.col("text")))
    return queries.select("query_id", F.posexplode(F.concat(F.array("text"), F.slice(own, 1, n))).alias("variant", "text"))


def rerank(results: DataFrame, model: Model, head: int = 20) -> DataFrame:
    """Orders each query's head by the model's list of ordinals (R0, R1, ..), ids or their beginnings; what it leaves out keeps its order behind."""
    line = F.concat("ordinal", F.lit(": "), text.snippet("text", 200))
    heads = prefixes.ordinals(results.where(F.col("rank") <= head)).groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    prompt = F.concat(F.lit("Most relevant first for: "), "query", F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    named = heads.select("query_id", F.posexplode(prefixes.parse_ids(ask(prompt, model))).alias("pos", "name"))
    head_ids = results.where(F.col("rank") <= head).select("query_id", "rank", "id")
    hit = prefixes.resolve(named, head_ids).groupBy("query_id", "id").agg(F.min("pos").alias("__pos"))
    hit = head_ids.select("query_id", F.col("id").alias("__id"), F.col("id").cast("string").alias("id")).join(hit, ["query_id", "id"]).select("query_id", F.col("__id").alias("id"), "__pos")
    order = Window.partitionBy("query_id").orderBy(F.col("__pos").asc_nulls_last(), "rank")
    return results.join(hit, ["query_id", "id"], "left").withColumn("__new", F.row_number().over(order).cast("long")).drop("rank", "__pos").withColumnRenamed("__new", "rank")


def answer(queries: DataFrame, results: DataFrame, model: Model, memories: int = 15) -> DataFrame:
    """query_id, category, answer, confidence, sources; queries without memories get an abstention."""
    lines = context_lines(results, most=memories)
    order = F.array_sort(F.collect_list(F.struct("rank", F.col("source").cast("string").alias("source"))))
    first = F.slice(F.array_distinct(F.filter(F.transform("s", lambda x: x["source"]), lambda x: x.isNotNull() & (x != ""))), 1, 5)
    sources = results.where(F.col("rank") <= memories).groupBy("query_id").agg(order.alias("s")).select("query_id", first.alias("sources"))
    asked = queries.withColumn("category", text.classify_question("text")).join(lines, "query_id", "left").join(sources, "query_id", "left")
    table = F.create_map([F.lit(x) for pair in INSTRUCTIONS.items() for x in pair])
    prompt = F.concat(table[F.col("category")], F.lit("\nMemories:\n"), "context", F.lit("\nQuestion: "), "text", F.lit("\nEnd with CONFIDENCE: 0 to 1."))
    held = asked.where("context IS NOT NULL").withColumn("__a", parse_answer(F.coalesce(ask(prompt, model), F.lit(f"{ABSTAIN}\nCONFIDENCE: 0"))))
    done = held.select("query_id", "category", F.col("__a.text").alias("answer"), F.col("__a.confidence").alias("confidence"), "sources")
    none = asked.where("context IS NULL").select("query_id", "category", F.lit(ABSTAIN).alias("answer"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("sources"))
    return done.unionByName(none)


def needs_retry(c: Column | str, threshold: float = 0.4) -> Column:
    return F.col(c) < threshold if isinstance(c, str) else c < threshold


def extract_items(results: DataFrame, model: Model, batch: int = 40) -> DataFrame:
    """query_id, item, key, support: what the model lists over all results in batches; the first spelling of an item stays."""
    grouped = results.withColumn("batch", F.floor((F.col("rank") - 1) / batch)).groupBy("query_id", "batch").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("rank", text.snippet("text", 200).alias("line")))).alias("lines"))
    prompt = F.concat(F.lit("Items, one a line, for: "), "query", F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    items = grouped.select("query_id", "batch", F.posexplode(F.regexp_extract_all(F.coalesce(ask(prompt, model), F.lit("")), F.lit(_LINES), F.lit(1))).alias("pos", "item"))
    keyed = items.withColumn("key", F.regexp_replace(F.lower(F.trim("item")), r"\s+", " ")).where("key <> ''")
    return keyed.groupBy("query_id", "key").agg(F.min_by("item", F.struct("batch", "pos")).alias("item"), F.count("*").alias("support"))


def triples(docs: DataFrame, model: Model, most: int = 10) -> DataFrame:
    """id, src, rel, dst: facts that the model reads from a text, as JSON lists of three."""
    said = F.regexp_replace(F.coalesce(ask(F.concat(F.lit("Facts as [[subject, relation, object], ..]: "), "text"), model), F.lit("")), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    parsed = F.from_json(said, T.ArrayType(T.ArrayType(T.StringType())))
    each = docs.select("id", F.explode(F.slice(F.filter(F.coalesce(parsed, F.array().cast("array<array<string>>")), lambda t: F.size(t) == 3), 1, most)).alias("t"))
    return each.select("id", F.trim(F.col("t")[0]).alias("src"), F.upper(F.regexp_replace(F.trim(F.col("t")[1]), r"[^A-Za-z0-9]+", "_")).alias("rel"), F.trim(F.col("t")[2]).alias("dst")).where("src <> '' AND dst <> ''")


def field_weights(spec: str | dict | None) -> dict[str, float]:
    """{field: weight} of 'title:2.0,text' or a mapping; malformed ones raise."""
    if not spec:
        return {}
    pairs = list(spec.items()) if isinstance(spec, dict) else [tuple(p.split(":", 1)) if ":" in p else (p, "1.0") for p in spec.split(",")]
    out: dict[str, float] = {}
    for name, weight in pairs:
        if isinstance(name, bool) or not str(name).strip() or str(name).strip() in out or isinstance(weight, bool):
            raise ValueError(f"no list of fields and weights: {spec!r}")
        out[str(name).strip()] = float(weight)
        if not 0 <= out[str(name).strip()] < float("inf"):
            raise ValueError(f"a weight is a number from 0 on: {weight!r}")
    return out
