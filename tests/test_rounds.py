"""A second round where the first answer is not sure, and exact names for general phrases; with fake models."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from tessera.plans import answers, rounds

MEMORIES = [("m1", "Ann moved to Portugal", "s1"), ("m2", "Ann's dog is called Rex", "s2"), ("m3", "the weather was fine", "s3"), ("m4", "Bob likes the sea", "s4")]


def recaller(spark, calls):
    memories = spark.createDataFrame(MEMORIES, "id string, text string, source string")

    def recall(queries):
        calls.append(queries.orderBy("query_id").collect())
        words = queries.select("query_id", F.explode(F.split(F.lower("text"), r"\W+")).alias("w")).where("w <> ''")
        said = memories.select("*", F.explode(F.array_distinct(F.split(F.lower("text"), r"\W+"))).alias("w"))
        hit = words.join(said, "w").groupBy("query_id", "id", "text", "source").agg(F.count("*").cast("double").alias("score"))
        return hit.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long"))

    return recall


def model(prompt):
    if "as JSON" in prompt:
        if "where" in prompt:
            return '```json\n{"queries": ["Ann moved", " dog ", ""]}\n```'
        return "no json" if "unknown" in prompt else '{"queries": ["weather"]}'
    if "Portugal" in prompt:
        return "Portugal\nCONFIDENCE: 0.9"
    if "weather" in prompt:
        return "maybe rain\nCONFIDENCE: 0.3"
    return f"{answers.ABSTAIN}\nCONFIDENCE: 0"


def test_only_unsure_answers_get_a_second_round(spark):
    queries = spark.createDataFrame([(1, "where does she live"), (2, "what of the sea"), (3, "how was it"), (4, "unknown")], "query_id long, text string")
    drafts = spark.createDataFrame([(1, "g", "Not in memory.", 0.8, []), (2, "g", "Bob", 0.9, ["s4"]), (3, "g", "wet", 0.2, []), (4, "g", "", 0.9, [])], "query_id long, category string, answer string, confidence double, sources array<string>")
    first = spark.createDataFrame([(1, 1, "m3", 0.5, "the weather was fine", "s3", "q"), (2, 1, "m4", 0.5, "Bob likes the sea", "s4", "q")], "query_id long, rank long, id string, score double, text string, source string, query string")
    calls = []
    done, results = rounds.second_round(queries, drafts, first, model, recaller(spark, calls))
    got = {r.query_id: (r.answer, r.confidence) for r in done.collect()}
    assert got == {1: ("Portugal", 0.9), 2: ("Bob", 0.9), 3: ("wet", 0.2), 4: ("", 0.9)}
    assert [(r.query_id, r.text) for c in calls for r in c] == [("1#1", "Ann moved"), ("1#2", "dog"), ("3#1", "weather")]
    ids = {q: [r.id for r in results.where(f"query_id = {q}").orderBy("rank").collect()] for q in (1, 2, 3)}
    assert ids[2] == ["m4"] and ids[3] == [] and set(ids[1]) == {"m1", "m2", "m3"} and ids[1][0] == "m2"  # in two lists


def test_rounds_are_bounded_and_stop_when_all_are_sure(spark):
    queries = spark.createDataFrame([(1, "where is it")], "query_id long, text string")
    drafts = spark.createDataFrame([(1, "g", None, None, None)], "query_id long, category string, answer string, confidence double, sources array<string>")
    none = spark.createDataFrame([], "query_id long, rank long, id string, score double, text string, source string, query string")
    calls = []
    done, _ = rounds.second_round(queries, drafts, none, model, recaller(spark, calls), rounds=5)
    assert done.first().answer == "Portugal" and len(calls) == 1
    calls = []
    unsure = lambda p: '{"queries": ["weather"]}' if "as JSON" in p else "hm\nCONFIDENCE: 0.1"
    done, _ = rounds.second_round(queries, drafts, none, unsure, recaller(spark, calls), rounds=3)
    assert done.first().answer is None and len(calls) == 3


def test_placeholders_keep_their_places():
    said = "😀 Her home country and his dog, a book; HER DOG, her brother John; video games and the Country, their best friend."
    got = rounds.find_placeholders(said)
    assert [(said[a:b], p) for a, b, p, _ in got] == [(p, p) for _, _, p, _ in got]
    assert [p for _, _, p, _ in got] == ["Her home country", "his dog", "a book", "HER DOG", "video games", "the Country", "their best friend"]
    assert [q for *_, q in got][:2] == ["specific name of country where the person lives or is from", "specific dog name"]
    assert rounds.find_placeholders("the company of something") == [] and rounds.find_placeholders(None) == []
    assert rounds.find_placeholders("that something")[0][3] == "specific name for that something"


def test_names_replace_phrases_only_if_memories_hold_them(spark):
    queries = spark.createDataFrame([(1, "where does Ann live"), (2, "who"), (3, "plain")], "query_id long, text string")
    drafts = spark.createDataFrame([(1, "😀 In her home country, with her dog, a book."), (2, "A friend of Ann"), (3, "Paris")], "query_id long, answer string")
    names = {"'her home country'": '"Portugal".', "'her dog'": "Rex", "'a book'": "Moby Dick", "'A friend'": "NONE"}
    calls = []
    out = rounds.specify(queries, drafts, lambda p: next((v for k, v in names.items() if k in p), None), recaller(spark, calls))
    assert {r.query_id: r.answer for r in out.collect()} == {1: "😀 In Portugal, with Rex, a book.", 2: "A friend of Ann", 3: "Paris"}
    assert [r.query_id for r in calls[0]] == ["1#0", "1#1", "1#2", "2#0"]
