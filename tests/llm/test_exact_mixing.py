import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tessera.llm import exact_dedup, mixing

DOCS = "doc_id long, text string, digest string, `__x` int"


def rows():
    rnd = random.Random(1)
    texts = ["same"] * 40 + [None, "", "", "a", "a", "b", "long " * 5000, "long " * 5000, "Same"]
    rnd.shuffle(texts)
    out = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return [*out, (None, "b", "n", 0), (3, out[3][1], "again", 2)]


def test_exact_groups_equal_brute_force(spark):
    data = rows()
    got = exact_dedup.exact_groups(spark.createDataFrame(data, DOCS).repartition(5)).collect()
    groups = {}
    for d, t, *_ in data:
        groups.setdefault(t or "", []).append(d)
    want = []
    for d, t, *_ in data:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((d, keep, len(g), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_drop_exact_keeps_one_row_of_each_text(spark):
    data = rows()
    df = spark.createDataFrame(data, DOCS)
    kept = exact_dedup.drop_exact(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted((r.text or "") for r in got) == sorted({t or "" for _, t, *_ in data})


def test_digest_collisions_stay_apart(spark, monkeypatch):
    def weak(docs, text):
        return docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__digest", F.length("__text").cast("string"))

    monkeypatch.setattr(exact_dedup, "_hashed", weak)
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(df).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_exact_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact(empty).count() == 0


def test_water_fill_caps_and_reshares():
    got = mixing.water_fill({"a": 10, "b": 100, "c": 50}, {"a": 5, "b": 2, "c": 1}, 160)
    assert got["a"] == 30 and got["b"] == pytest.approx(2 * got["c"]) and sum(got.values()) == pytest.approx(160)


def test_flow_spreads_overlapping_sources():
    # x can only come from the shared pattern, so y is served from its own.
    flows = mixing.route([(("x", "y"), 100), (("y",), 100)], {"x": 100.0, "y": 100.0})
    assert flows == [100, 100]
    # Repetition is convex: both are used twice before one is used three times.
    assert mixing.route([(("x",), 100), (("x",), 100)], {"x": 400.0}) == [200, 200]
    # No more than three passes.
    assert mixing.route([(("x",), 10)], {"x": 100.0}) == [30]


def mix_rows(n=400):
    rnd = random.Random(4)
    out = [(i, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice(["a", "a", "a", "b", "c", None, ""])) for i in range(n)]
    return [*out, (n, None, "a"), (n + 1, "x y", None), (7, out[7][1], out[7][2])]


def test_mix_is_near_its_targets_and_reruns_agree(spark):
    data = mix_rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows_ = mixing.mix_sources(df).collect()
    assert len(rows_) == len(data)
    for s in {d[2] for d in data}:
        own = [r for r in rows_ if r.sources[0] == s]
        target, taken = own[0].target, sum(r.taken for r in own)
        assert abs(taken - target) <= max(r.size for r in own) / 2, (s, taken, target)
        assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in own)
    again = mixing.mix_sources(df.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, rows_)) == sorted(map(key, again))


def test_mix_of_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["x", "y"] if i % 2 else ["y"]) for i in range(200)], "doc_id long, text string, m array<string>")
    out = mixing.mix(df, F.col("m"), weights={"x": 1.0, "y": 1.0}).groupBy("sources").agg(F.sum("taken").alias("t")).collect()
    assert {tuple(r.sources): r.t for r in out} == {("x", "y"): 1000, ("y",): 1000}


def test_apply_mix_repeats_documents(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string").withColumn("repeats", F.lit("clash"))
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    want = mixing.mix_sources(df).agg(F.sum("taken")).first()[0]
    got = out.select(mixing.word_count("text").alias("n")).agg(F.sum("n")).first()[0]
    assert abs(got - want) <= 60


def test_mix_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
