"""Recall holds what stages and rerankers return against its scope, and searches paraphrases as lists of their own."""

from pyspark.sql import functions as F
from tessera.operators import rank
from tessera.plans.recall import RecallConfig, recall

ROWS = [
    (1, "blue harbour lights", "s", "t", "a", None),
    (2, "blue mountain path", "s", "t", "b", None),
    (3, "blue secret of others", "s", "u", "a", None),
    (4, "blue but withdrawn", "s", "t", "a", "2024-01-01"),
    (5, "green meadow", "s", "t", "a", None),
]
VECTORS = [(i, [1.0 if j == i else 0.1 for j in range(6)]) for i in range(1, 6)]


def tables(spark):
    chunks = spark.createDataFrame(ROWS, "id long, text string, source string, tenant_id string, lang string, invalidated_at string")
    chunks = chunks.withColumn("ts", F.lit("2024-01-01").cast("timestamp")).withColumn("access_count", F.lit(0))
    vectors = spark.createDataFrame(VECTORS, "id long, embedding array<double>")
    queries = spark.createDataFrame([(7, "blue", [1.0, 1.0, 1.0, 1.0, 1.0, 0.0])], "query_id long, text string, vec array<double>")
    return chunks, vectors, queries


def adds_strangers(chunks):
    def stage(df):
        extra = chunks.where("id IN (2, 3, 4)").select("id", "text", "source", "tenant_id", "lang", "invalidated_at", "ts", "access_count", F.lit(7).cast("long").alias("query_id"), F.lit(99.0).alias("score"), F.lit(50).cast("long").alias("rank"), F.array(F.lit("graph")).alias("sources"))
        return df.where("id <> 2").unionByName(extra, allowMissingColumns=True)

    return stage


def test_stages_cannot_add_rows_from_outside(spark):
    chunks, vectors, queries = tables(spark)
    config = RecallConfig(tenant="t", filters={"lang": "a"}, stages=[adds_strangers(chunks)])
    got = recall(chunks, vectors, queries, config).orderBy("rank").collect()
    assert {r.id for r in got} == {1, 5} and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    wider = recall(chunks, vectors, queries, RecallConfig(tenant="t", stages=[adds_strangers(chunks)])).collect()
    assert {r.id for r in wider} == {1, 2, 5}


def test_a_reranker_reorders_inside_the_scope(spark):
    chunks, vectors, queries = tables(spark)
    last_first = lambda df: rank.score_rerank(df, F.col("id").cast("double"))
    got = recall(chunks, vectors, queries, RecallConfig(tenant="t", stages=[], reranker=last_first)).orderBy("rank").collect()
    assert [r.id for r in got] == [5, 2, 1]


def test_paraphrases_are_lists_behind_the_query(spark):
    chunks, vectors, queries = tables(spark)
    plain = RecallConfig(tenant="t", lexical="bm25")
    before = {r.id: r for r in recall(chunks, None, queries, plain).collect()}
    variants = spark.createDataFrame([(7, 1, "green meadow", None), (7, 2, None, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0]), (7, 3, "blue secret", None)], "query_id long, variant int, text string, vec array<double>")
    words = {r.id: r for r in recall(chunks, None, queries, plain, variants=variants.drop("vec")).collect()}
    assert set(before) == {1, 2} and set(words) == {1, 2, 5} and words[5].sources == ["bm25~1"] and words[1].sources == ["bm25", "bm25~3"]
    both = {r.id: r for r in recall(chunks, vectors, queries, plain, variants=variants).collect()}
    assert "vector~2" in both[2].sources and both[2].score > before[2].score and 3 not in both
