"""Versioned tables and folder synchronisation."""

import json
import os

import pytest
from pyspark.sql import functions as F
from tessera.operators import lifecycle
from tessera.plans import folder
from tessera.plans.plugins import hashing_embedder
from tessera.sources.versions import Change, Conflict, Store

A = {
    "a.md": "---\ntitle: Alpha\nkind: note\n---\n# One\nfirst [[b]] and [x](sub/c.md)\n\n# Two\nmore words here",
    "b.md": "# B\nlinks to [[missing]] and [[a]]",
    "sub/c.md": "# C\nup to [a](../a.md), [[later]]",
    "gone.md": "# Gone\nsee [[a]]",
    "empty.md": "",
}
B = {
    "a.md": "---\ntitle: Alpha 2\n---\n# One\nfirst [[b]] and [x](sub/c.md)\n\n# Three\nother words",
    "b.md": A["b.md"],
    "sub/c.md": A["sub/c.md"],
    "later.md": "# Later\nnew, [[gone]]",
    "z/missing.md": "# M\nfound",
    "empty.md": "# Now\nfull",
}


def files(spark, state):
    return spark.createDataFrame(sorted(state.items()), "source string, text string")


def store(spark, path, buckets=4):
    return Store(spark, f"file://{path}", buckets)


def rows(s):
    chunks = s.table("chunks").select("id", "source", "text", F.array_sort(F.map_entries("payload")).alias("p"), F.array_sort("owned").alias("o"), "space", F.size("embedding").alias("e"))
    links = s.table("links").select("source", "target", "resolved", "is_resolved")
    return tuple(sorted(map(repr, df.collect())) for df in (chunks, links, s.table("sources")))


def test_sync_equals_a_rebuild(spark, tmp_path):
    s, embedder = store(spark, tmp_path / "s"), hashing_embedder(8)
    folder.sync(s, files(spark, A), embedder)
    assert folder.sync(s, files(spark, A), embedder).count() == 0 and s.manifest()["version"] == 1
    done = {r.source: r for r in folder.sync(s, files(spark, B), embedder).collect()}
    assert {k: r.action for k, r in done.items()} == {"a.md": "change", "gone.md": "remove", "later.md": "add", "z/missing.md": "add", "empty.md": "change"}
    assert (done["a.md"].inserted, done["a.md"].refreshed, done["a.md"].pruned) == (1, 1, 1)
    fresh = store(spark, tmp_path / "fresh")
    folder.sync(fresh, files(spark, B), embedder)
    assert rows(s) == rows(fresh)
    links = {(r.source, r.target): r.resolved for r in s.table("links").where("is_resolved").collect()}
    assert links == {("a.md", "b"): "b.md", ("a.md", "sub/c"): "sub/c.md", ("b.md", "a"): "a.md", ("b.md", "missing"): "z/missing.md", ("sub/c.md", "../a"): "a.md", ("sub/c.md", "later"): "later.md"}


@pytest.mark.parametrize("at", ["_write", "_publish"])
def test_a_crash_leaves_the_last_commit(spark, tmp_path, monkeypatch, at):
    s, embedder = store(spark, tmp_path / "s"), hashing_embedder(8)
    folder.sync(s, files(spark, A), embedder)
    before, real, calls = rows(s), getattr(Store, at), []

    def dies(self, *a):
        calls.append(a)
        if at == "_publish" or len(calls) == 2:
            raise SystemExit
        return real(self, *a)

    with monkeypatch.context() as m:
        m.setattr(Store, at, dies)
        with pytest.raises(SystemExit):
            folder.sync(s, files(spark, B), embedder)
    again = store(spark, tmp_path / "s")
    assert rows(again) == before
    folder.sync(again, files(spark, B), embedder)
    fresh = store(spark, tmp_path / "fresh")
    folder.sync(fresh, files(spark, B), embedder)
    assert rows(again) == rows(fresh)
    assert again.vacuum(1) > 0 and rows(again) == rows(fresh)


def test_failed_sources_keep_what_they_had_and_are_retried(spark, tmp_path):
    good = hashing_embedder(8)

    def fails(texts):
        if any("other words" in t for t in texts):
            raise RuntimeError
        return good(texts)

    s = store(spark, tmp_path / "s")
    folder.sync(s, files(spark, A), good)
    done = {r.source: r for r in folder.sync(s, files(spark, B), fails).collect()}
    assert done["a.md"].failed == 1 and done["a.md"].pruned == 0
    texts = " ".join(r.text for r in s.table("chunks").where("source = 'a.md'").collect())
    assert "more words here" in texts and "other words" not in texts
    assert [r.source for r in s.table("sources").where("failed").collect()] == ["a.md"]
    assert [r.action for r in folder.sync(s, files(spark, B), good).collect()] == ["retry"]
    fresh = store(spark, tmp_path / "fresh")
    folder.sync(fresh, files(spark, B), good)
    assert rows(s) == rows(fresh)


def test_foreign_keys_spaces_quota_and_scope(spark, tmp_path):
    s, embedder = store(spark, tmp_path / "s"), hashing_embedder(8)
    folder.sync(s, files(spark, A), embedder, tenant="t")

    def enrich(s, base):
        return {"chunks": Change(s.table("chunks").withColumn("payload", F.map_concat("payload", F.create_map(F.lit("topic"), F.lit("x")))), "source")}

    s.update(enrich)
    folder.sync(s, files(spark, B), embedder, tenant="t")
    kept = s.table("chunks").where("source = 'a.md' AND payload['topic'] = 'x'").collect()
    assert len(kept) == 1 and kept[0].payload["title"] == "Alpha 2" and "kind" not in kept[0].payload and kept[0].tenant_id == "t"
    version = s.manifest()["version"]
    with pytest.raises(ValueError, match="quota"):
        folder.sync(s, files(spark, A), embedder, tenant="t", limit=3)
    assert s.manifest()["version"] == version
    changed = {**B, "b.md": "---\nx: 1\n---\n" + B["b.md"]}
    assert folder.sync(s, files(spark, changed), embedder, space="other", tenant="t").first().conflicts == 1
    only = folder.sync(s, files(spark, {"z/missing.md": B["z/missing.md"]}), embedder, tenant="t", within="z/")
    assert only.count() == 0 and s.table("sources").count() == len(B)


def test_of_two_writers_one_is_told(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    rows_ = spark.createDataFrame([(i, f"k{i}") for i in range(20)], "n int, k string")
    assert s.commit({"t": Change(rows_, "k")}, 0) == 1
    base = s.manifest()["version"]
    only = s.buckets_of(rows_.where("n = 3"), "k")
    touched = s.table("t", only)
    s.commit({"t": Change(touched.withColumn("n", F.col("n") + 100), "k", only)}, base)
    with pytest.raises(Conflict):
        s.commit({"t": Change(rows_, "k")}, base)
    got = {r.k: r.n for r in s.table("t").collect()}
    assert len(got) == 20 and got["k3"] == 103
    assert {r.k: r.n for r in s.table("t", version=1).collect()}["k3"] == 3
    tries = []

    def plan(s, base):
        tries.append(base)
        if len(tries) == 1:
            s.commit({"u": Change(rows_, "k")}, base)
        return {"t": Change(s.table("t").where("n <> 5"), "k")}

    s.update(plan)
    assert len(tries) == 2 and s.table("t").count() == 19 and s.table("u").count() == 20
    with pytest.raises(Exception, match="no bucket"):
        s.commit({"t": Change(rows_, "k", only)}, s.manifest()["version"])


def test_manifest_names_every_file(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    s.commit({"t": Change(spark.range(10).withColumn("k", F.col("id").cast("string")), "k")}, 0)
    held = json.loads((tmp_path / "s/versions" / sorted(f for f in os.listdir(tmp_path / "s/versions") if f.endswith(".json"))[-1]).read_text())
    assert held["version"] == 1 and all((tmp_path / "s/data" / p).is_dir() for p in held["tables"]["t"]["files"].values())


def test_joint_patches_delete_then_set_in_order(spark):
    stored = spark.createDataFrame([("a", {"x": "1", "y": "2", "tenant_id": "t"}, "t"), ("b", {"x": "1"}, "u"), ("c", None, "t")], "id string, payload map<string,string>, tenant_id string")
    patches = [("a", 0, ["x", "tenant_id"], {"z": "3"}), ("a", 1, ["z"], {"z": "4", "tenant_id": "u"}), ("b", 0, ["x"], None), ("c", 0, None, {"q": "9"}), ("gone", 0, ["x"], {"x": "2"})]
    df = spark.createDataFrame(patches, "id string, seq int, deleted array<string>, changed map<string,string>")
    got = {r.id: (r.payload, r.patched) for r in lifecycle.patch_payloads(stored, df, tenant="t").collect()}
    assert got == {"a": ({"y": "2", "tenant_id": "t", "z": "4"}, True), "b": ({"x": "1"}, False), "c": ({"q": "9"}, True)}


def test_another_spelling_of_a_time_is_no_change(spark, tmp_path):
    s, embedder = store(spark, tmp_path / "s", 1), hashing_embedder(8)
    note = "---\nat: '2024-01-01T10:00:00+02:00'\n---\n# One\nfirst\n\n# Two\n"
    folder.sync(s, files(spark, {"a.md": note + "second"}), embedder)
    s.update(lambda s, base: {"chunks": Change(s.table("chunks").withColumn("payload", F.transform_values("payload", lambda k, v: F.when(k == "at", "2024-01-01 08:00:00Z").otherwise(v))), "source")})
    done = folder.sync(s, files(spark, {"a.md": note + "third"}), embedder).first()
    assert (done.inserted, done.refreshed, done.pruned) == (1, 0, 1)
