"""Text index as tables: postings, document lengths, term statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, scoring, text
from ..sources.tables import dealt, written

#: Bytes of text that one task cuts into tokens and counts.
TEXT_TASK = 16_000_000


@dataclass
class TextIndex:
    """postings(id, term, tf, len); terms(term, df, idf); the number of documents and their mean length."""

    postings: DataFrame
    terms: DataFrame
    documents: int
    mean: float


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text", tokenizer=text.tokens, only: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """id, term, tf, len, dealt by id: what later sums over a document's terms finds them together.

    only: a batch's terms (column term); other postings are left out before any
    aggregation, which leaves those of the batch and their statistics unchanged.
    Texts are dealt, not their tokens, which are several times as much, to tasks of about
    TEXT_TASK bytes each. size: bytes of all texts, summed if not given.
    """
    return _counted(docs, id_col, text_col, tokenizer, only, size)


def _counted(docs: DataFrame, id_col: str, text_col: str, tokenizer, only: DataFrame | None, size: int | None, lengths: bool = False) -> DataFrame:
    """lengths: with rows of no term for all documents, tf of length len each; tokens themselves are never null."""
    if size is None:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0]
    held = dealt(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), -(-(size or 0) // TEXT_TASK), "id")
    toks = held.select("id", tokenizer("text").alias("toks"))
    none = F.lit(None).cast("string")
    terms = toks.select("id", F.size("toks").cast("long").alias("len"), F.explode(F.array_append("toks", none) if lengths else F.col("toks")).alias("term"))
    if only is not None:
        wanted = only.select(F.col("term").alias("__term")).distinct()
        if lengths:
            wanted = wanted.unionByName(docs.sparkSession.range(1).select(none.alias("__term")))
        same = F.col("term").eqNullSafe(F.col("__term")) if lengths else F.col("term") == F.col("__term")
        terms = terms.join(wanted, same, "left_semi")
    return terms.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def term_stats(posts: DataFrame, documents: int) -> DataFrame:
    """term, df, idf."""
    return posts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", scoring.idf(F.lit(float(documents)), F.col("df")))


def build(docs: DataFrame, id_col: str = "id", text_col: str = "text", tokenizer=text.tokens, only: DataFrame | None = None) -> TextIndex:
    """only: see ``postings``; those of a batch are written once, since statistics and search read them.

    A batch's texts are cut into tokens once, after they are dealt: how many documents and tokens there are is written
    beside the postings, so no task of a scan does so for all texts that its part of a file holds.
    """
    if only is None:
        n, total, size = docs.agg(F.count("*"), F.sum(F.size(tokenizer(text_col))), F.sum(F.octet_length(text_col))).first()
        posts = postings(docs, id_col, text_col, tokenizer, size=size or 0)
    else:
        found = written(_counted(docs, id_col, text_col, tokenizer, only, None, lengths=True))
        n, total = found.where("term IS NULL").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.sum(F.col("tf") * F.col("len"))).first()
        posts = found.where("term IS NOT NULL")
    return TextIndex(posts, term_stats(posts, n), n, (total or 0) / max(n, 1))


def save(idx: TextIndex, path: str, buckets: int = 256) -> None:
    """Writes an index in folders by term, so that a batch reads those of its terms."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    for name, table in (("postings", idx.postings), ("terms", idx.terms)):
        table.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    idx.postings.sparkSession.createDataFrame([(idx.documents, float(idx.mean), buckets)], "documents long, mean double, buckets long").coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")


def load(spark: SparkSession, path: str, only: DataFrame | None = None) -> TextIndex:
    """A saved index; ``only`` (column term) prunes it to a batch's terms and their folders."""
    corpus = spark.read.parquet(f"{path}/corpus").first()
    posts, terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
    if only is not None:
        wanted = only.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(corpus.buckets)).cast("int"))
        posts, terms = (t.join(wanted, ["bucket", "term"], "left_semi") for t in (posts, terms))
    return TextIndex(posts.drop("bucket"), terms.drop("bucket"), corpus.documents, corpus.mean)


#: Terms that are named in a filter, which prunes files and cached batches; more are joined.
NAMED_TERMS = 2000


def narrow(idx: TextIndex, terms: DataFrame) -> TextIndex:
    """The index's part of a batch's terms (column term); its statistics stay those of the whole."""
    wanted = terms.select("term").distinct()
    named = [t for (t,) in wanted.limit(NAMED_TERMS + 1).collect()]
    if len(named) > NAMED_TERMS:
        return TextIndex(idx.postings.join(wanted, "term", "left_semi"), idx.terms.join(wanted, "term", "left_semi"), idx.documents, idx.mean)
    return TextIndex(idx.postings.where(F.col("term").isin(named)), idx.terms.where(F.col("term").isin(named)), idx.documents, idx.mean)


def sparse_vectors(posts: DataFrame) -> DataFrame:
    """id, index, value: hashed sparse vectors; terms that share an index add up."""
    return posts.groupBy("id", ids.token_index(F.col("term")).alias("index")).agg(F.sum("tf").cast("double").alias("value"))


def coverage_gap(docs: DataFrame, posts: DataFrame, id_col: str = "id") -> DataFrame:
    """How many rows have no encoding."""
    have = posts.select(F.col("id").alias("__id")).distinct()
    return docs.join(have, docs[id_col] == have["__id"], "left_anti").agg(F.count("*").alias("missing"))
