"""Ingest as a batch plan: ids, skip known, embed, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import chunk, lifecycle
from .plugins import Embedder, embed


def with_ids(items: DataFrame, tenant=None) -> DataFrame:
    """Adds id from source, offset and text (and the tenant)."""
    scope = None if tenant is None else F.lit(tenant)
    return items.withColumn("id", ids.stable_id(F.col("source"), F.col("offset"), F.col("text"), scope)).dropDuplicates(["id"])


def expand_windows(items: DataFrame, size: int) -> DataFrame:
    """Items and their sliding windows."""
    if size < 1:
        raise ValueError("a window has one item at least")
    if size == 1:
        return items
    wide = chunk.windows(items, size, "source", "offset").withColumnRenamed("middle", "offset")
    return items.unionByName(wide, allowMissingColumns=True)


def ingest(items: DataFrame, stored: DataFrame, embedder: Embedder, tenant=None, window: int = 1, limit: int | None = None) -> DataFrame:
    """The table with the new chunks; known ids are not embedded again. Raises if the tenant's quota would be passed."""
    fresh = with_ids(expand_windows(items, window), tenant)
    new = lifecycle.skip_known(fresh, stored)
    if tenant is not None:
        if not lifecycle.ownership_conflicts(stored, fresh, tenant).isEmpty():
            raise PermissionError("ids of another tenant")
        new = new.withColumn("tenant_id", F.lit(tenant))
    own = stored if tenant is None else stored.where(F.col("tenant_id") == F.lit(tenant))
    if limit is not None and own.count() + new.count() > limit:
        raise ValueError(f"the quota of {limit} chunks would be passed")
    return stored.unionByName(embed(new, embedder), allowMissingColumns=True)
