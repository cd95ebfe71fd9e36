from pyspark.sql import functions as F
from tessera.llm import common
from tessera.llm.common import split_by_keys, spread_join


def test_rows_with_a_key_are_never_ruled_out(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 97 != 0, F.col("id")).alias("k"), F.lit("x").alias("__bits2"), F.col("id").alias("v"))
    keys = spark.range(0, 5000, 7).select(F.col("id").alias("any_name"))
    maybe, never = split_by_keys(df, F.col("k"), keys)
    assert maybe.columns == df.columns and never.columns == df.columns
    assert maybe.count() + never.count() == 5000
    assert never.where("k % 7 = 0").count() == 0
    assert maybe.where("k % 7 <> 0 OR k IS NULL").count() < 500
    assert split_by_keys(df, F.col("k"), keys.limit(0))[0].count() == 0


def test_hot_keys_join_like_others(spark, monkeypatch):
    left = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 97 != 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.where("k IS NOT NULL AND k % 2 = 1").groupBy("k").agg(F.count("*").alias("n"))
    for few in (5, 10_000):
        monkeypatch.setattr(common, "FEW", few)
        for how in ("inner", "left"):
            got = spread_join(left, right, ["k"], "n", 4000, how)
            want = left.join(right, ["k"], how)
            assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
