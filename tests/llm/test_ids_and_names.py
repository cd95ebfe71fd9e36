"""Ids beyond 2^53 beside nulls, repeated ids and clashing column names, for every operator."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tessera.llm import exact_dedup, langid, lines, matroska, mixing, packing, pitman_yor, simhash, toxicity, warc

BIG = (1 << 60) + 1
IDS = [BIG, None, BIG + 2, 7]


@pytest.fixture()
def docs(spark):
    rows = [(d, t, "en") for d, t in zip(IDS, ["one two", "three", "one two", ""], strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)


@pytest.mark.parametrize(
    "run",
    [
        simhash.near_groups,
        pitman_yor.score_documents,
        exact_dedup.exact_groups,
        packing.pack_documents,
        matroska.media_digests,
        lambda d: toxicity.score(d, toxicity.ToxicityModel()),
        lambda d: matroska.packet_table(matroska.muxed(d)),
        lambda d: mixing.mix_sources(d, "lang"),
        lambda d: langid.identify(d.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/").alias("url"), F.col("text").alias("html")), d).withColumnRenamed("page_id", "doc_id"),
        lambda d: lines.strip_boilerplate(d, "doc_id", "lang", "text").withColumnRenamed("page_id", "doc_id"),
    ],
)
def test_ids_come_back_whole(docs, run):
    assert Counter(r.doc_id for r in run(docs).collect()) == Counter(IDS)


def test_held_out_follows_the_id(spark):
    ids = [BIG + i for i in range(200)]
    d = spark.createDataFrame([(i, "a b") for i in [None, *ids]], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.held_out for r in pitman_yor.score_documents(d).collect()}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 10 == 0) for i in ids) and got[None] is False


def test_archives_keep_ids(spark):
    rows = [(BIG, "u", "same"), (BIG + 2, "u", "same"), (None, "u", "same"), (None, "u", "alone")]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    want = [(BIG, "response", None), (BIG + 2, "revisit", BIG), (None, "revisit", BIG), (None, "response", None)]
    assert sorted(map(repr, ((r.page_id, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, want))


def test_own_names_do_not_clash(spark):
    names = ["__text", "__digest", "__bits", "__at", "__keep", "__h", "__size", "__sources", "__key", "__hot", "a.b"]
    rnd = random.Random(1)
    texts = [" ".join(f"w{rnd.getrandbits(40)}" for _ in range(30)) for _ in range(8)]
    rows = [(i, t, "s", *[f"{n}{i}" for n in names]) for i, t in enumerate([*texts, texts[0]])]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    want = {tuple(r) for r in rows}
    for out in (exact_dedup.drop_exact(df), simhash.drop_near(df), mixing.apply_mix(df)):
        assert out.columns == df.columns
        assert {tuple(r) for r in out.collect()} <= want
    assert exact_dedup.drop_exact(df).count() == simhash.drop_near(df).count() == 8


def test_mix_of_repeated_ids_is_the_same_again(spark):
    rnd = random.Random(5)
    rows = [(1, " ".join(["w"] * rnd.randint(1, 40)), rnd.choice("ab")) for _ in range(60)] + [(2, "x y z", "a")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda f: sorted((r.doc_id, r.size, r.taken) for r in mixing.mix_sources(f).collect())
    first = key(df.coalesce(1))
    assert first == key(df.repartition(7)) == key(df.orderBy(F.rand(3)))


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 3)
    df = spark.createDataFrame([(i, "w", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="patterns"):
        mixing.mix_sources(df)
