"""Upserts, patches, pruning, invalidation and tenant operations on stored chunk tables.

Tables are immutable: each operation returns the new rows, and ``sources.tables.replace``
swaps them in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROTECTED = ("tenant_id",)


def upsert(stored: DataFrame, fresh: DataFrame, id_col: str = "id", order: list[str] | None = None, keep_owner: bool = True) -> DataFrame:
    """Full replace by id: the latest fresh row by ``order`` wins, of equal ones that with the largest content; an owner survives a writer without a tenant."""
    latest = Window.partitionBy(id_col).orderBy(*[F.desc(c) for c in order or []], F.desc(F.to_json(F.struct(*fresh.columns))))
    newest = fresh.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
    if keep_owner and "tenant_id" in stored.columns and "tenant_id" in newest.columns:
        owner = stored.select(F.col(id_col), F.col("tenant_id").alias("__owner"))
        newest = newest.join(owner, id_col, "left").withColumn("tenant_id", F.coalesce("tenant_id", "__owner")).drop("__owner")
    rest = stored.join(newest.select(id_col), id_col, "left_anti")
    return rest.unionByName(newest, allowMissingColumns=True)


def ownership_conflicts(stored: DataFrame, fresh: DataFrame, tenant, id_col: str = "id") -> DataFrame:
    """Incoming ids that another tenant owns."""
    return stored.where(F.col("tenant_id").isNotNull() & (F.col("tenant_id") != F.lit(tenant))).join(fresh.select(id_col).distinct(), id_col, "left_semi").select(id_col, "tenant_id")


def skip_known(fresh: DataFrame, stored: DataFrame, id_col: str = "id") -> DataFrame:
    return fresh.join(stored.select(id_col).distinct(), id_col, "left_anti")


def existing(ids: DataFrame, stored: DataFrame, id_col: str = "id", tenant=None) -> DataFrame:
    own = stored if tenant is None else stored.where(F.col("tenant_id") == F.lit(tenant))
    return ids.join(own.select(id_col).distinct(), id_col, "left_semi")


def stale(stored: DataFrame, fresh: DataFrame, failed: DataFrame | None = None, id_col: str = "id", source: str = "source") -> DataFrame:
    """Stored rows of re-indexed sources that the fresh set lacks; sources that failed are left alone."""
    seen = fresh.select(source).distinct()
    if failed is not None:
        seen = seen.join(failed.select(source).distinct(), source, "left_anti")
    return stored.join(fresh.select(id_col), id_col, "left_anti").join(seen, source, "left_semi")


def prune(stored: DataFrame, fresh: DataFrame, failed: DataFrame | None = None, id_col: str = "id", source: str = "source") -> DataFrame:
    return stored.join(stale(stored, fresh, failed, id_col, source).select(id_col), id_col, "left_anti")


def payload_diff(old: DataFrame, new: DataFrame, columns: list[str], id_col: str = "id", space: str | None = None) -> DataFrame:
    """id, changed (columns to set), removed (columns to clear), conflict (another embedding space)."""
    a = old.select(id_col, *[F.col(c).alias(f"__o_{c}") for c in columns], *([F.col(space).alias("__os")] if space else []))
    b = new.select(id_col, *[F.col(c).alias(f"__n_{c}") for c in columns], *([F.col(space).alias("__ns")] if space else []))
    both = a.join(b, id_col)
    pick = lambda c, when: F.when(when, F.lit(c))
    changed = F.array_compact(F.array([pick(c, F.col(f"__n_{c}").isNotNull() & ~F.col(f"__n_{c}").eqNullSafe(F.col(f"__o_{c}"))) for c in columns]))
    removed = F.array_compact(F.array([pick(c, F.col(f"__n_{c}").isNull() & F.col(f"__o_{c}").isNotNull()) for c in columns]))
    clash = ~F.col("__os").eqNullSafe(F.col("__ns")) if space else F.lit(False)
    out = both.select(id_col, changed.alias("changed"), removed.alias("removed"), clash.alias("conflict"))
    return out.where((F.size("changed") > 0) | (F.size("removed") > 0) | F.col("conflict"))


def set_payload(stored: DataFrame, patch: DataFrame, id_col: str = "id") -> DataFrame:
    """Merges map columns: patched keys win. Both tables have id and payload."""
    joined = stored.join(patch.select(id_col, F.col("payload").alias("__p")), id_col, "left")
    kept = F.map_filter("payload", lambda k, v: ~F.coalesce(F.map_contains_key(F.col("__p"), k), F.lit(False)))
    return joined.withColumn("payload", F.when(F.col("__p").isNull(), F.col("payload")).otherwise(F.map_concat(kept, F.col("__p")))).drop("__p")


def delete_keys(stored: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    gone = F.array([F.lit(k) for k in keys if k not in PROTECTED]).cast("array<string>")
    return stored.withColumn(payload, F.map_filter(payload, lambda k, v: ~F.array_contains(gone, k)))


def patch_payloads(stored: DataFrame, patches: DataFrame, tenant=None, id_col: str = "id", payload: str = "payload", key: str | None = None) -> DataFrame:
    """Joint patches: of each, first ``deleted`` keys go, then ``changed`` ones are set; several of one id apply in the order of ``seq``.

    patches: id, seq, deleted (array), changed (map), and ``key`` if ids are unique by it only. Patches of rows that are gone, or that another
    tenant owns, are skipped; protected keys stay as they are. Adds ``patched``.
    """
    keys = [id_col] + ([key] if key else [])
    safe = [F.lit(k) for k in PROTECTED]
    allowed = F.map_filter(F.coalesce("changed", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*PROTECTED))
    removed = F.array_except(F.coalesce("deleted", F.array().cast("array<string>")), F.array(*safe))
    in_turn = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)
    each = F.array_sort(F.collect_list(F.struct("seq", removed.alias("deleted"), allowed.alias("changed"))), in_turn)
    by = patches.groupBy(*keys).agg(each.alias("__patches"))
    joined = stored.join(by, keys, "left")
    mine = F.col("__patches").isNotNull() & (F.lit(True) if tenant is None else F.col("tenant_id").eqNullSafe(F.lit(tenant)))

    def apply(p: Column, x: Column) -> Column:
        kept = F.map_filter(p, lambda k, v: ~F.array_contains(x["deleted"], k) & ~F.map_contains_key(x["changed"], k))
        return F.map_concat(kept, x["changed"])

    start = F.coalesce(F.col(payload), F.create_map().cast("map<string,string>"))
    return joined.withColumn("patched", mine).withColumn(payload, F.when(mine, F.aggregate("__patches", start, apply)).otherwise(F.col(payload))).drop("__patches")


def delete_points(stored: DataFrame, ids: DataFrame, id_col: str = "id", tenant=None) -> DataFrame:
    target = ids.select(id_col).distinct()
    if tenant is not None:
        target = target.join(stored.where(F.col("tenant_id") == F.lit(tenant)).select(id_col), id_col, "left_semi")
    return stored.join(target, id_col, "left_anti")


def delete_tenant(stored: DataFrame, tenant) -> DataFrame:
    if tenant in (None, ""):
        raise ValueError("a tenant has a name")
    return stored.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant)))


def invalidate(stored: DataFrame, ids: DataFrame, at: Column, until: Column | None = None, id_col: str = "id", tenant=None) -> DataFrame:
    """Soft delete: stamps rows that are not stamped yet, and their end in world time if given."""
    mark = ids.select(id_col).distinct().withColumn("__hit", F.lit(True))
    hit = F.col("__hit") & F.col("invalidated_at").isNull()
    if tenant is not None:
        hit = hit & (F.col("tenant_id") == F.lit(tenant))
    out = stored.join(mark, id_col, "left").withColumn("__hit", F.coalesce(hit, F.lit(False)))
    out = out.withColumn("invalidated_at", F.when(F.col("__hit"), at).otherwise(F.col("invalidated_at")))
    if until is not None:
        out = out.withColumn("valid_until", F.when(F.col("__hit"), until).otherwise(F.col("valid_until")))
    return out.drop("__hit")


def stamp_tenant(stored: DataFrame, tenant, only_missing: bool = True) -> DataFrame:
    return stored.withColumn("tenant_id", F.coalesce("tenant_id", F.lit(tenant)) if only_missing else F.lit(tenant))


def quota(stored: DataFrame, fresh: DataFrame, limits: DataFrame | int, id_col: str = "id") -> DataFrame:
    """tenant_id, points, added (new unique ids), allowed."""
    now = stored.groupBy("tenant_id").agg(F.count("*").alias("points"))
    new = skip_known(fresh, stored, id_col).groupBy("tenant_id").agg(F.countDistinct(id_col).alias("added"))
    both = now.join(new, "tenant_id", "full_outer").na.fill(0, ["points", "added"])
    both = both.withColumn("limit", F.lit(limits).cast("long")) if isinstance(limits, int) else both.join(limits, "tenant_id", "left")
    return both.withColumn("allowed", F.coalesce(F.col("points") + F.col("added") <= F.col("limit"), F.lit(True)))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, action of two listings (path, mtime): upsert or remove."""
    both = before.select("path", F.col("mtime").alias("a")).join(after.select("path", F.col("mtime").alias("b")), "path", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("path", F.when(F.col("b").isNull(), "remove").otherwise("upsert").alias("action"))
