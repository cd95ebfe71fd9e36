"""Exact deduplication by skew-safe combining.

Equal texts meet in three steps, and each step groups by the full content
beside its digest: tasks combine their own rows first (Spark's map-side partial
aggregation), then groups of (digest, salt), then the salts' winners. So a text
that a third of all rows share reaches any task at most once per (task, salt).

A digest that occurs once needs no comparison (equal texts have equal digests), so
only texts that a bitmap of the repeated digests, bounded in size, cannot rule out are moved;
what it lets through beside them forms groups of one. Decisions go back to rows without
moving those of hot digests. Two different texts with one digest stay two groups.

Defined cases: a null text counts as empty; empty texts are one group; a null id
loses to any other; rows equal in id and text count singly in ``group_size`` and
are all reported as kept (``drop_exact`` keeps one of them); very long texts are
compared whole; an empty table gives an empty result; other columns, whatever their names,
are ignored here and kept by ``drop_exact``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, split_by_keys, spread_join

SALTS = 16


def _hashed(docs: DataFrame, text: str, content: str = "__text", digest: str = "__digest") -> DataFrame:
    """docs with its text (null: empty) and the text's digest."""
    return docs.withColumn(content, F.coalesce(column(text), F.lit(""))).withColumn(digest, F.sha2(F.col(content), 256))


def _repeated(docs: DataFrame, text: str) -> DataFrame:
    """Digests that occur more than once and how often, written."""
    light = _hashed(docs.select(column(text).alias("__raw")), "__raw").select("__digest")
    return materialize(light.groupBy("__digest").agg(F.count("*").alias("__rows")).where("__rows > 1"), "exact-repeated")


def _classes(docs: DataFrame, repeated: DataFrame, id_col: str, text: str, salts: int) -> DataFrame:
    """(__digest, __text, __keep, __n) for each text of the repeated digests, and for texts that the bitmap lets through."""
    base = _hashed(docs.select(column(id_col).alias("__id"), column(text).alias("__raw")), "__raw").drop("__raw")
    suspects, _ = split_by_keys(base, F.col("__digest"), repeated.select("__digest"))
    salted = suspects.groupBy("__digest", F.pmod(F.xxhash64("__id"), F.lit(salts)).alias("__salt"), "__text").agg(F.max("__id").alias("__keep"), F.count("*").alias("__n"))
    return salted.groupBy("__digest", "__text").agg(F.max("__keep").alias("__keep"), F.sum("__n").alias("__n"))


def _winners(docs: DataFrame, repeated: DataFrame, id_col: str, text: str, salts: int) -> tuple[DataFrame, DataFrame | None]:
    """Winners by digest, and winners by (digest, text) for digests that two texts share (None: there are none)."""
    classes = _classes(docs, repeated, id_col, text, salts)
    by_digest = materialize(
        classes.groupBy("__digest").agg(F.max("__keep").alias("__keep"), F.sum("__n").alias("__n"), F.count("*").alias("__variants")).where("__n > 1 OR __variants > 1"),
        "exact-winners",
    )
    collided = by_digest.where("__variants > 1").select("__digest")
    if collided.isEmpty():
        return by_digest.drop("__variants"), None
    return by_digest.where("__variants = 1").drop("__variants"), classes.join(collided, "__digest", "left_semi")


def _with_winner(docs: DataFrame, id_col: str, text: str, salts: int) -> DataFrame:
    """docs with __digest, __keep and __n; only rows of repeated digests that are not hot are moved."""
    repeated = _repeated(docs, text)
    by_digest, by_text = _winners(docs, repeated, id_col, text, salts)
    count = docs.count()
    maybe, single = split_by_keys(_hashed(docs, text), F.col("__digest"), repeated.select("__digest"))
    own = (F.coalesce("__keep", column(id_col)).alias("__keep"), F.coalesce("__n", F.lit(1)).cast("long").alias("__n"))
    columns = [column(c) for c in docs.columns] + [F.col("__digest")]
    alone = single.select(*columns, column(id_col).alias("__keep"), F.lit(1).cast("long").alias("__n"))
    if by_text is None:
        return alone.unionByName(spread_join(maybe.drop("__text"), by_digest, ["__digest"], "__n", count, "left").select(*columns, *own))
    shared = by_text.select("__digest").distinct()
    plain = spread_join(maybe.join(shared, "__digest", "left_anti"), by_digest, ["__digest"], "__n", count, "left").select(*columns, *own)
    return alone.unionByName(plain).unionByName(spread_join(maybe, by_text, ["__digest", "__text"], "__n", count).select(*columns, *own))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest id stays."""
    slim = docs.select(column(id_col).alias("doc_id"), column(text).alias("text"))
    return _with_winner(slim, "doc_id", "text", salts).select(
        "doc_id",
        F.col("__keep").alias("keep_id"),
        F.col("__n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__digest").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The documents that stay, with all their columns; exactly one row of each distinct text."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of the input clashes with ours
    plain = docs.toDF(*names)
    id_, text_ = (names[docs.columns.index(c)] for c in (id_col, text))
    light = _hashed(plain.select(id_, text_), text_).select(F.col(id_).alias("__id"), "__digest")
    same = materialize(light.groupBy("__id", "__digest").agg(F.count("*").alias("n")).where("n > 1").select("__id", "__digest"), "exact-repeats")
    kept = _with_winner(plain, id_, text_, salts).where(F.col(id_).eqNullSafe(F.col("__keep")))
    if not same.isEmpty():
        match = kept[id_].eqNullSafe(same["__id"]) & (kept["__digest"] == same["__digest"])
        once = kept.join(same, match, "left_anti")
        kept = once.unionByName(kept.join(same, match, "left_semi").dropDuplicates([id_, "__digest", text_]))
    return kept.select(names).toDF(*docs.columns)
