"""Streams over several micro-batches: late rows, windows across batches, ingest."""

import os

from pyspark.sql import functions as F
from tessera.plans import plugins
from tessera.streaming import streams


def put(spark, folder, number, rows, schema):
    """One file a batch, with rising times of change, since a stream takes files in that order."""
    staged = f"{folder}-{number}"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(staged)
    (name,) = [f for f in os.listdir(staged) if f.endswith(".parquet")]
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{staged}/{name}", f"{folder}/{number}.parquet")
    os.utime(f"{folder}/{number}.parquet", (1_700_000_000 + number, 1_700_000_000 + number))


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    folder, schema = str(tmp_path / "late"), "ts string, k string, v double"
    put(spark, folder, 0, [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 1.0)], schema)
    # A batch drops what is behind the watermark that the batch before it began with: one batch
    # after 05:00 was seen, 00:20 still counts; two batches after, 00:30 does not. 04:30 is inside an hour.
    put(spark, folder, 1, [("2024-01-01 00:20:00", "a", 9.0), ("2024-01-01 04:40:00", "a", 1.0)], schema)
    put(spark, folder, 2, [("2024-01-01 00:30:00", "a", 50.0), ("2024-01-01 04:30:00", "a", 2.0)], schema)
    put(spark, folder, 3, [("2024-01-01 09:00:00", "a", 1.0)], schema)
    events = streams.read(spark, folder, schema, files=1)
    out = streams.run_available(streams.tumbling(events, "1 hour", ["k"], "v"), "late_rows", "append")
    got = {r.start: (r.n, r.total) for r in out.select(F.date_format("start", "HH:mm").alias("start"), "n", "total").collect()}
    assert got["00:00"] == (2, 10.0) and got["04:00"] == (2, 3.0) and got["05:00"] == (1, 1.0)


def test_windows_reach_across_batches(spark, tmp_path):
    folder, schema = str(tmp_path / "turns"), "source string, offset long, text string"
    put(spark, folder, 0, [("s", 2, "b"), ("s", 1, "a"), ("t", 1, "x")], schema)
    put(spark, folder, 1, [("s", 3, None), ("t", 2, "y")], schema)
    put(spark, folder, 2, [("s", 4, "d")], schema)
    items = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = streams.run_available(streams.count_windows(items, 3, separator=""), "turn_windows", "append")
    assert {tuple(r) for r in out.collect()} == {("s", "ab", 2, 1, 3), ("s", "bd", 3, 2, 4)}


def test_ingest_stores_each_item_once(spark, tmp_path):
    folder, schema = str(tmp_path / "items"), "source string, offset long, text string"
    put(spark, folder, 0, [("s", 0, "a"), ("s", 1, "b"), ("s", 1, "b")], schema)
    put(spark, folder, 1, [("s", 1, "b"), ("s", 2, "c")], schema)
    path, checkpoint = str(tmp_path / "table"), str(tmp_path / "progress")
    for _ in range(2):  # the second run finds nothing new
        items = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        streams.ingest(items, path, plugins.hashing_embedder(4), checkpoint, "t").awaitTermination()
        rows = spark.read.parquet(f"{path}/chunks").collect()
        assert sorted((r.text, r.tenant_id, len(r.embedding), r.batch) for r in rows) == [("a", "t", 4, 0), ("b", "t", 4, 0), ("c", "t", 4, 1)]
    stats = spark.read.json(f"{path}/stats").orderBy("number").collect()
    assert [(r.number, r.seen, r.stored, r.skipped) for r in stats] == [(0, 3, 2, 1), (1, 2, 1, 1)]


def test_results_stay_with_the_tasks(spark, tmp_path):
    """Every mode returns files that tasks wrote; the last batch alone is the result of mode complete."""
    folder, schema = str(tmp_path / "kept"), "ts string, k string, v double"
    put(spark, folder, 0, [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "b", 2.0)], schema)
    put(spark, folder, 1, [("2024-01-01 00:30:00", "a", 4.0)], schema)
    for mode, want in (("complete", {("a", 2, 5.0), ("b", 1, 2.0)}), ("update", {("a", 1, 1.0), ("b", 1, 2.0), ("a", 2, 5.0)})):
        out = streams.run_available(streams.tumbling(streams.read(spark, folder, schema, files=1), "1 hour", ["k"], "v"), f"kept_{mode}", mode)
        assert out.inputFiles() and not spark.catalog.tableExists(f"kept_{mode}")
        assert {tuple(r) for r in out.select("k", "n", "total").collect()} == want
    once = streams.run_available(streams.dedupe(streams.read(spark, folder, schema, files=1), ["k"]), "kept_once", "append")
    assert once.inputFiles() and sorted(r.k for r in once.collect()) == ["a", "b"]
