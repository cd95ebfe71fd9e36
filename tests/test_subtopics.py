"""Subtopics are spelt as the SQL spells them."""

import duckdb
from pyspark.sql import functions as F
from tessera.functions import text
from tessera.operators import synthesis

WORDS = ["ßheit", "éa", "ﬁn", "ᾀx", "ŉa", "ßß", "ǆa", "1a", "_a", "яблоко"]


def test_capital_equals_sql(spark):
    want = [duckdb.execute("SELECT upper(substr($1, 1, 1)) || substr($1, 2)", [w]).fetchall()[0][0] for w in WORDS]
    got = {r.w: r.c for r in spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", text.capital("w").alias("c")).collect()}
    assert [got[w] for w in WORDS] == want and got["ßheit"] == "ẞheit"


def test_subtopic_of_a_sharp_s(spark):
    facts = spark.createDataFrame([("e", 1, "ßheit und ßheit"), ("e", 2, None)], "entity string, fact_id long, text string")
    got = {r.fact_id: r.subtopic for r in synthesis.subtopics(facts).orderBy(F.col("fact_id")).collect()}
    assert got == {1: "ẞheit", 2: "General"}
