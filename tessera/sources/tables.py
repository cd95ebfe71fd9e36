"""Chunk tables on disk: layout, replacement, point lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def working_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: in the session's checkpoint folder, or local where none is set and all is one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/tessera"
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Evaluated once: written to a new working folder and read back, so what a model or a clock answered stays the same for every use."""
    path = working_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, tasks: int, *by: str) -> DataFrame:
    """Dealt by key to as many tasks as its amount asks for, whatever number of shuffle partitions is set; a small one still keeps all cores busy."""
    spark = df.sparkSession
    return df.repartition(max(tasks, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)), *by)


def replace(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Swaps a table: written beside the old one, then renamed, so a plan may read what it replaces.

    If the new one cannot be moved in, the old one is moved back and the call raises.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    staged, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(p(path))
    if had and not fs.rename(p(path), p(old)):
        fs.delete(p(staged), True)
        raise OSError(f"{path} cannot be moved away")
    if not fs.rename(p(staged), p(path)):
        if had:
            fs.rename(p(old), p(path))
        raise OSError(f"{path} cannot be replaced; the new rows are in {staged}")
    if had:
        fs.delete(p(old), True)
    return spark.read.parquet(path)


def scroll(spark: SparkSession, path: str, columns: list[str] | None = None, where=None, with_vectors: bool = False) -> DataFrame:
    """A filtered scan; vectors are pruned from the read unless asked for."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    names = columns or [c for c in df.columns if with_vectors or c != "embedding"]
    return df.select(*names)


def lookup(df: DataFrame, id_, tenant=None, id_col: str = "id") -> DataFrame:
    own = df.where(F.col(id_col) == F.lit(id_))
    return own if tenant is None else own.where(F.col("tenant_id") == F.lit(tenant))


def check_dimension(df: DataFrame, size: int, column: str = "embedding") -> None:
    wrong = df.where(F.col(column).isNotNull() & (F.size(column) != size)).limit(1).count()
    if wrong:
        raise ValueError(f"vectors in {column} do not all have {size} dimensions")
