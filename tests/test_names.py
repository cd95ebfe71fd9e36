"""Names and keys against plain versions."""

import hashlib
from urllib.parse import quote

from pyspark.sql import functions as F
from tessera.functions import names

WORDS = ["works at", "été-1", "1st", "", "_x", "a:b", "ß*~ +/é", "日本", "x_y"]


def rel(p):
    c = "".join(x if x.isalnum() or x == "_" else "_" for x in p)
    return (c if c and c[0].isalpha() else "_" + c).upper()


def lab(p):
    c = "".join(x if x.isalnum() or x == "_" else "_" for x in p)
    return c if c and c[0].isalpha() else "Node"


def test_names_equal_plain_versions(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "i int, w string")
    none = F.lit(None).cast("string")
    got = df.select(names.relation(F.col("w")), names.label(F.col("w")), names.quoted(F.col("w")), names.graph_id(F.lit("n"), F.col("w")), names.graph_id(F.col("w"), none), names.state_key(F.lit("q"), F.col("w"))).collect()
    want = [(rel(w), lab(w), quote(w, safe=""), f"graph:{quote(w, safe='')}:n", f"graph:{w}", f"q:{quote(w, safe='')}") for w in WORDS]
    assert sorted(map(tuple, got)) == sorted(want)


def test_cache_keys_tags_and_payloads(spark):
    df = spark.createDataFrame([("q|é", ["a", "b:c"], ["x", "", None], "one", {"a": "1", "text": "t", "_attributed_filters": "z"}), ("q", [], [], "one", None)], "q string, ids array<string>, tags array<string>, tag string, p map<string,string>")
    got = df.select(names.cache_key(F.col("q"), F.col("ids")), names.tags(F.col("tags"), F.col("tag")), names.public_payload(F.col("p")), names.public_payload(F.col("p"), "text")).collect()
    key = lambda q, ids: hashlib.sha256("|".join(f"{len(x)}:{x}" for x in [q, *ids]).encode()).hexdigest()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(key("q|é", ["a", "b:c"]), ["x"], {"a": "1", "text": "t"}, {"a": "1"}), (key("q", []), ["one"], {}, {})]))


def test_expansions(spark):
    said = ["1. Rephrase 1: where is it\n- \"Question 2: what place\"\nHypothetical answer: in Rome\nmore", "one; two ;\"three\"", "single", None]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select(names.expansions(F.col("s")), "i").orderBy("i").collect()]
    assert got == [["where is it", 'Question 2: what place', "in Rome"], ["one", "two", "three"], ["single"], []]
