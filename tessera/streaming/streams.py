"""Structured Streaming: dedupe, windows, sessions, keyed folds, debounced file events, ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import skip_known
from ..operators.state import take
from ..plans.ingest import with_ids
from ..plans.plugins import Embedder, embed
from ..sources.tables import working_folder


def read(spark: SparkSession, path: str, schema, ts: str = "ts", lateness: str = "1 hour", files: int | None = None) -> DataFrame:
    """A file stream with an event-time watermark.

    A micro-batch drops rows behind the watermark that the one before it began with, so a late row of the next batch
    after the watermark moved is still counted.
    """
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def dedupe(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, size: str, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    return sliding(events, size, size, keys, value, ts)


def sliding(events: DataFrame, size: str, step: str, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    w = F.window(ts, size, step)
    return events.groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, keys: list[str], ts: str = "ts") -> DataFrame:
    w = F.session_window(ts, gap)
    return events.groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def debounce(events: DataFrame, quiet: str, path: str = "path", kind: str = "kind", ts: str = "ts") -> DataFrame:
    """The last event of each path once it has been quiet."""
    w = F.session_window(ts, quiet)
    return events.groupBy(w, path).agg(F.max_by(kind, ts).alias(kind), F.count("*").alias("n")).select(path, F.col("session_window.start").alias("start"), kind, "n")


def q_state(feedback: DataFrame, alpha: float = 0.15, decay: float = 0.995, default: float = 0.5, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Keyed fold of rewards: source, query_type, q, n after each batch. Rows of a batch are folded in event time."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q, n = state.get if state.exists else (default, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for r in rows["reward"]:
            q = q * decay + default * (1 - decay)
            q = max(low, min(high, q + alpha * (r - q)))
            n += 1
        state.update((q, n))
        yield pd.DataFrame([(*key, q, n)], columns=["source", "query_type", "q", "n"])

    grouped = feedback.groupBy("source", "query_type")
    return grouped.applyInPandasWithState(fold, "source string, query_type string, q double, n long", "q double, n long", "update", GroupStateTimeout.NoTimeout)


def limiter(requests: DataFrame, rate: float, capacity: float) -> DataFrame:
    """tenant_id, event_id, allowed: a token bucket per tenant that goes on across batches; a batch's requests are taken in order of time."""

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, then = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        allowed = []
        for t in rows["t"].tolist():
            tokens, ok = take(tokens, then, max(t, then or t), rate, capacity)
            then = max(t, then or t)
            allowed.append(ok)
        state.update((tokens, then))
        yield pd.DataFrame({"tenant_id": key[0], "event_id": rows["event_id"], "allowed": allowed})

    slim = requests.select("tenant_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    kinds = {c: slim.schema[c].dataType.simpleString() for c in ("tenant_id", "event_id")}
    return slim.groupBy("tenant_id").applyInPandasWithState(admit, f"tenant_id {kinds['tenant_id']}, event_id {kinds['event_id']}, allowed boolean", "tokens double, t long", "append", GroupStateTimeout.NoTimeout)


def count_windows(items: DataFrame, size: int, source: str = "source", position: str = "offset", separator: str = "\n") -> DataFrame:
    """Windows of ``size`` neighbours of a source, also across batches: source, text, middle, chunk_start, chunk_end.

    The state is a source's last size - 1 items. Items of a source come in order of
    ``position`` (long); those of one batch are sorted.
    """
    if size < 2:
        raise ValueError("a window has two items at least")

    def slide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("position")
        out = []
        for item in zip(rows["position"], rows["text"].fillna(""), strict=True):
            held = [*held[-(size - 1) :], (int(item[0]), item[1])]
            if len(held) == size:
                out.append((key[0], separator.join(t for _, t in held), held[size // 2][0], held[0][0], held[-1][0]))
        held = held[-(size - 1) :]
        state.update(([p for p, _ in held], [t for _, t in held]))
        yield pd.DataFrame(out, columns=["source", "text", "middle", "chunk_start", "chunk_end"])

    own = items.select(F.col(source).cast("string").alias("source"), F.col(position).cast("long").alias("position"), F.col("text").cast("string").alias("text"))
    kind, kept = "source string, text string, middle long, chunk_start long, chunk_end long", "positions array<long>, texts array<string>"
    return own.groupBy("source").applyInPandasWithState(slide, kind, kept, "append", GroupStateTimeout.NoTimeout)


def ingest(items: DataFrame, path: str, embedder: Embedder, checkpoint: str, tenant=None):
    """Embeds and stores the items of a stream that the table lacks; ends when all that is there is stored.

    Each micro-batch overwrites a folder of its own, ``path/chunks/batch=n``, so one that
    is run again after a failure leaves the same rows, and writes one record to
    ``path/stats``: batch, seen, stored, skipped. The reader bounds a batch (``files`` of
    ``read``). Items: source, offset, text.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = with_ids(batch, tenant)
        known = _before(spark, f"{path}/chunks", number)
        new = fresh if known is None else skip_known(fresh, known)
        if tenant is not None:
            new = new.withColumn("tenant_id", F.lit(tenant))
        embed(new, embedder).write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        done = spark.read.parquet(f"{path}/chunks/batch={number}").agg(F.count("*").alias("stored"))
        stats = batch.agg(F.count("*").alias("seen")).join(done).select(F.lit(number).alias("number"), "seen", "stored", (F.col("seen") - F.col("stored")).alias("skipped"))
        stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats/batch={number}")

    return into_table(items, write, checkpoint)


def _before(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """What earlier batches stored."""
    if not set(_batches(spark, path)) - {number}:
        return None
    return spark.read.option("mergeSchema", "true").parquet(path).where(F.col("batch") != number)


def run_available(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs what is there and returns it, written by the tasks: each micro-batch to a folder of its own under a new working folder.

    Mode complete returns the last batch, the other two all of them. Without a checkpoint, progress and state are kept beside the result.
    """
    path = working_folder(df.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    into_table(df, write, checkpoint or f"{path}/progress", mode).awaitTermination()
    done = _batches(df.sparkSession, f"{path}/{name}")
    if not done:
        return df.sparkSession.createDataFrame([], df.schema)
    kept = done if mode != "complete" else [max(done)]
    return df.sparkSession.read.schema(df.schema).parquet(*[f"{path}/{name}/batch={n}" for n in kept])


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the micro-batches that have a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))


def into_table(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Hands each micro-batch to ``write`` (batch, number); it sees a batch again after a failure, so it is idempotent by number."""
    return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
