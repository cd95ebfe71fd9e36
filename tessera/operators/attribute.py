"""Which memory an extracted item came from, and whose source is named first.

An item is looked for as a whole phrase, without regard to case. Items meet memories by one
key each, a word or sign that any text with the phrase must hold, so only pairs that share it are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Kana, ideographs, syllables and letters of scripts that are written without blanks.
UNSPACED = r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯฀-๿]"
#: What a text shows beside words: single signs, and single letters of unspaced scripts.
SIGN = r"[^\p{L}\p{N}_\s]"


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _keys(c: Column) -> Column:
    return F.array_distinct(F.concat(_all(c, WORD), _all(c, SIGN), F.transform(_all(c, UNSPACED), lambda x: F.concat(F.lit("\x00"), x))))


def _bounded(said: Column, needle: Column) -> Column:
    quoted = F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
    return F.rlike(said, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])")))


def matches(items: DataFrame, memories: DataFrame) -> DataFrame:
    """query_id, place, rank, bounded: memories that hold an item, as a phrase between word boundaries or, for unspaced scripts, at all.

    items: query_id, place, item; memories: query_id, rank, text. An item's key is its longest word (whole words of a phrase are whole in the text),
    its first sign if it has no word, and for mere containment its first unspaced letter.
    """
    needle = F.lower(F.regexp_replace(F.coalesce("item", F.lit("")), r"^\s+|\s+$", ""))
    wanted = items.select("query_id", "place", needle.alias("needle")).where("needle <> ''")
    longest = F.array_max(F.transform(_all(F.col("needle"), WORD), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    loose = F.when(F.rlike("needle", F.lit(UNSPACED)), F.concat(F.lit("\x00"), F.regexp_extract("needle", UNSPACED, 0)))
    keys = F.array_compact(F.array(F.coalesce(longest, F.substring("needle", 1, 1)), loose))
    said = memories.select("query_id", "rank", F.lower(F.coalesce("text", F.lit(""))).alias("said"))
    asked = wanted.select("query_id", "place", "needle", F.explode(keys).alias("key"))
    pairs = said.select("query_id", "rank", F.explode(_keys(F.col("said"))).alias("key")).join(asked, ["query_id", "key"])
    found = pairs.select("query_id", "rank", "place", "needle", F.startswith("key", F.lit("\x00")).alias("loose")).join(said, ["query_id", "rank"])
    held = F.when(F.col("loose"), F.contains("said", "needle")).otherwise(_bounded(F.col("said"), F.col("needle")))
    return found.where(held).groupBy("query_id", "place", "rank").agg(F.bool_or(~F.col("loose")).alias("bounded"))


def claims(found: DataFrame) -> DataFrame:
    """query_id, place, rank: each memory with the first item that claims it.

    Items claim in order, each all that no item before has: the memories that hold it between boundaries or, if none of these is left, those that
    hold it at all. Where every pair is bounded that is the first item of each memory; only queries with others are folded, item by item.
    """
    mixed = found.groupBy("query_id").agg(F.bool_and("bounded").alias("plain"))
    joined = found.join(mixed, "query_id")
    simple = joined.where("plain").groupBy("query_id", "rank").agg(F.min("place").alias("place")).select("query_id", "place", "rank")
    by_item = joined.where("NOT plain").groupBy("query_id", "place").agg(F.array_sort(F.collect_list(F.when(F.col("bounded"), F.col("rank")))).alias("bounded"), F.array_sort(F.collect_list("rank")).alias("loose"))
    turns = by_item.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "bounded", "loose"))).alias("items"))
    kinds = {f: found.schema[f].dataType.simpleString() for f in ("place", "rank")}
    start = F.struct(F.array().cast(f"array<{kinds['rank']}>").alias("taken"), F.array().cast(f"array<struct<place:{kinds['place']},rank:{kinds['rank']}>>").alias("out"))

    def step(s: Column, item: Column) -> Column:
        strict = F.array_except(item["bounded"], s["taken"])
        own = F.when(F.size(strict) > 0, strict).otherwise(F.array_except(item["loose"], s["taken"]))
        mine = F.transform(own, lambda r: F.struct(item["place"].alias("place"), r.alias("rank")))
        return F.struct(F.concat(s["taken"], own).alias("taken"), F.concat(s["out"], mine).alias("out"))

    folded = turns.select("query_id", F.inline(F.aggregate("items", start, step, lambda s: s["out"])))
    return simple.unionByName(folded)


def attribute(items: DataFrame, memories: DataFrame, most: int = 5, source: str = "source") -> DataFrame:
    """query_id, place (from 1), source: the first ``most`` sources of each query.

    Every item's first memory comes before anyone's second, then memories that hold no item, in their order; a source is named once, unnamed ones are left out.
    memories: query_id, rank, text, source.
    """
    claimed = claims(matches(items, memories)).select("query_id", "rank", F.col("place").alias("item"))
    turn = claimed.withColumn("turn", F.row_number().over(Window.partitionBy("query_id", "item").orderBy("rank")))
    named = memories.where(F.col(source) != "").select("query_id", "rank", F.col(source).alias("source"))
    order = F.struct(F.coalesce("turn", F.lit(1 << 30)).alias("turn"), F.coalesce(F.col("item").cast("long"), F.lit(-1)).alias("item"), "rank")
    first = named.join(turn, ["query_id", "rank"], "left").groupBy("query_id", "source").agg(F.min(order).alias("first"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))
    return placed.where(F.col("place") <= most).select("query_id", F.col("place").cast("long").alias("place"), "source")
