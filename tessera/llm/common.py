"""Shared helpers: the durable folder, written intermediates, input tables, joins that stand hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine, as in local tests.
LOCAL_DIR = "file:///tmp/checkpoints/tessera"

#: A word, and what stands between words, as in every contract of this package.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
LOWERING = bytes.maketrans(UPPER, LOWER)

#: Texts that a Python worker turns into objects at once; Spark bounds a batch's bytes itself.
TEXT_ROWS = 500


def slices(batches: Iterable, rows: int = TEXT_ROWS) -> Iterator:
    """Arrow batches cut into few rows, so that a worker never holds many texts as objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Bytes of text whose words a Python worker holds as arrays at once.
TEXT_BYTES = 4 << 20


def byte_slices(batches: Iterable, at: int, most: int = TEXT_BYTES) -> Iterator:
    """Arrow batches cut so that the texts of column ``at`` come to about ``most`` bytes; a longer text is alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        done, sent = 0, 0
        while done < batch.num_rows:
            upto = max(done + 1, int(np.searchsorted(ends, sent + most, "right")))
            yield batch.slice(done, upto - done)
            done, sent = upto, int(ends[upto - 1])


def byte_class(outside: bytes) -> np.ndarray:
    """By byte, whether words hold it; what is not ASCII always is."""
    held = np.ones(256, bool)
    held[list(outside)] = False
    return held


def words_of(texts: pa.Array, held: np.ndarray, parting: bytes = b"") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of some texts (null: none), A-Z lowered, without a loop over them.

    Returns the words, the place of each one's text, and whether it goes on from the word
    before: in the same text, with no byte of ``parting`` between. Words are maximal runs of
    the bytes that ``byte_class`` holds, so bytes of one character never part.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return pa.array([], pa.large_string()), np.empty(0, np.int64), np.empty(0, bool)
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[places[0] : places[-1]]
    places = places - places[0]
    inside = held[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = places[:-1][places[:-1] < len(data)]
    start[heads] = inside[heads]
    begins = np.flatnonzero(start)
    text = np.searchsorted(places, begins, "right") - 1
    ends = np.append(np.flatnonzero(start[inside]), np.count_nonzero(inside))
    lowered = np.frombuffer(LOWERING, np.uint8)[data[inside]]
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(lowered))
    follows = np.zeros(len(begins), bool)
    if len(begins):
        follows[1:] = text[1:] == text[:-1]
        if parting:
            parts = np.cumsum(~byte_class(parting)[data], dtype=np.int32)[begins]
            follows[1:] &= parts[1:] == parts[:-1]
    return words, text, follows


def release() -> None:
    """Returns a worker's free memory to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def give_back() -> None:
    """As ``release``, cycles too; Spark reuses workers, and what they hold adds up."""
    import gc

    gc.collect()
    release()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each extended until it clashes with no column (Spark compares without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = LOCAL_DIR
    return named.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    hadoop, fs = _filesystem(spark, path)
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


#: Shuffles of a query that is written are of no use behind it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, codec: str = "snappy", by: str | None = None) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    Unlike a local checkpoint the result survives lost executors, and an
    expensive or order-dependent stage is evaluated once. The write's shuffle files
    are removed behind it. ``by`` names a column whose values get folders of their own.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, tag)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.mode("overwrite").option("compression", codec)
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame, part: str = "") -> None:
    """Removes the files of materialized tables, or of a part's folder, that nothing will read again."""
    for t in tables:
        hadoop, fs = _filesystem(t.sparkSession, f"{t._written}/{part}")
        fs.delete(hadoop, True)


def word_count(text: str) -> F.Column:
    """Number of words of a text column (null: 0), without Python."""
    return F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("long")


#: Bits of one bitmap row, and most bits of a filter: 2,048 rows, 8 MB.
BITMAP_ROW = 32_768
MOST_BITS = 1 << 26


def split_by_keys(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the keys, rows that surely have none), without a shuffle of ``df``.

    keys has one column. A bitmap of their hashes, at most ``MOST_BITS`` whatever their
    number, is sent to all tasks; what it cannot rule out is left to an exact join. So
    wide rows that no decision touches stay where they are. Beyond some ten million keys
    the bitmap fills and rules out less: results stay whole, but more rows are moved.
    """
    (name,) = keys.columns
    spot, bucket, bitmap = unused([*df.columns, name], "__at", "__bucket", "__bits")
    count = keys.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * count).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    at = place(column(name))
    maps = keys.groupBy(F.bitmap_bucket_number(at).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(bitmap))
    held = df.withColumn(spot, place(key)).join(F.broadcast(maps), F.bitmap_bucket_number(spot) == F.col(bucket), "left")
    byte = F.conv(F.hex(F.expr(f"substring({bitmap}, CAST(bitmap_bit_position({spot}) DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.bitmap_bit_position(spot) % 8).cast("int")) == 1, F.lit(False))
    columns = [column(c) for c in df.columns]
    return held.where(hit).select(columns), held.where(~hit).select(columns)


#: Most keys that are sent to all tasks by ``spread_join``, and rows of a key that burden no task.
HOT, FEW = 1024, 1000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right on keys, where right has a row a key and ``weight`` says how much of ``total`` is the key's.

    Keys with more than a ``HOT``-th of the total (and over ``FEW``), of which there cannot be
    more than ``HOT``, are sent to all tasks, so their rows in left stay where they are; the
    others meet by a shuffle, and none of them is hot. Without hot keys it is a plain
    join. left is read twice: hand in a written table.
    """
    is_hot = (F.col(weight) * HOT > F.lit(total)) & (F.col(weight) > FEW)
    if total <= FEW or right.where(is_hot).isEmpty():
        return left.join(right, keys, how)
    (mark,) = unused([*left.columns, *right.columns], "__hot")
    hot = right.where(is_hot)
    found = left.join(F.broadcast(hot.withColumn(mark, F.lit(True))), keys, how).where(F.col(mark)).drop(mark)
    rest = left.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(right.where(~is_hot), keys, how)
    return found.unionByName(rest)
