"""File corpora as document tables, and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED_FOLDERS = ("node_modules", ".git", ".venv", "venv", "__pycache__", "dist", "build", "target", "vendor")


def files(spark: SparkSession, path: str, globs=("*.md", "*.txt")) -> DataFrame:
    """path, mtime, text of the files under a folder."""
    out = None
    for g in globs:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", g).load(path)
        out = part if out is None else out.unionByName(part)
    return out.select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


def documents(spark: SparkSession, path: str, size: int = 800, globs=("*.md", "*.txt")) -> DataFrame:
    """Windows of ``size`` characters with ids 'path:offset'; blank windows are left out."""
    from ..operators.chunk import char_chunks

    cut = char_chunks(files(spark, path, globs), size, 0)
    return cut.select(F.concat_ws(":", "path", "offset").alias("id"), F.col("path").alias("source"), "offset", F.col("chunk").alias("text"), "mtime")


def code(spark: SparkSession, path: str) -> DataFrame:
    """Source files with their language, vendored folders left out."""
    from ..functions.text import language_for

    skipped = "/(" + "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS) + ")/"
    found = files(spark, path, ("*.*",)).where(~F.rlike("path", F.lit(skipped)))
    return found.withColumn("language", language_for("path")).where("language IS NOT NULL")


def export_tenant(chunks: DataFrame, tenant, path: str, vectors: bool = False) -> None:
    """JSON lines: a header row, then the tenant's chunks."""
    own = chunks.where(F.col("tenant_id") == F.lit(tenant))
    if not vectors and "embedding" in own.columns:
        own = own.drop("embedding")
    head = own.agg(F.count("*").alias("count")).select(F.to_json(F.struct(F.lit("meta").alias("kind"), F.lit(str(tenant)).alias("tenant"), "count")).alias("value"))
    head.unionByName(own.select(F.to_json(F.struct("*")).alias("value"))).write.mode("overwrite").text(path)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def tail_audit(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """The last events of an audit log; lines that do not parse are in _corrupt_record."""
    return spark.read.schema("ts timestamp, actor string, action string, detail string, _corrupt_record string").json(path).orderBy(F.desc("ts")).limit(limit)


def exposition(counters: DataFrame) -> DataFrame:
    """Text lines of counters: name, labels (map), n."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return counters.select(F.concat("name", F.lit("{"), pairs, F.lit("} "), F.col("n").cast("string")).alias("line")).orderBy("line")
