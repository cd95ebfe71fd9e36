"""Upkeep of a temporal graph whose nodes and edges are versioned tables: each change of both is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.versions import Change, Store

NODES = "name string, type string, tenant_id string, valid_until string"
EDGES = "src string, rel string, dst string, tenant_id string, valid_from timestamp, valid_until timestamp"


def assert_facts(store: Store, facts: DataFrame, tenant: str | None = None) -> int:
    """Stores facts (src, rel, dst, valid_from) of relations that hold one thing at a time, and the nodes they name; returns the version.

    Only the buckets of the facts' subjects and of their nodes are read and written; after a conflict it is done anew on the newer version.
    """
    own = facts.select("src", "rel", "dst", F.lit(tenant).cast("string").alias("tenant_id"), F.col("valid_from").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until")).distinct()
    names = own.select(F.explode(F.array("src", "dst")).alias("name"), "tenant_id").distinct()

    def plan(store: Store, base: int) -> dict[str, Change]:
        subjects, named = store.buckets_of(own, "src"), store.buckets_of(names, "name")
        if not subjects:
            return {}
        edges = store.table("edges", subjects, base or None, EDGES)
        mine = F.col("tenant_id").eqNullSafe(F.lit(tenant).cast("string"))
        after = edges.where(~mine).unionByName(graph.supersede(edges.where(mine), own))
        nodes = store.table("nodes", named, base or None, NODES)
        fresh = names.join(nodes.where(mine).select("name"), "name", "left_anti").select("name", F.lit(None).cast("string").alias("type"), "tenant_id", F.lit(graph.CURRENT).alias("valid_until"))
        return {"edges": Change(after, "src", subjects), "nodes": Change(nodes.unionByName(fresh), "name", named)}

    return store.update(plan)


def delete_tenant(store: Store, tenant: str) -> DataFrame:
    """Removes a tenant's nodes and edges, and others' edges that hang on them, in one commit; what, n."""
    told: list[DataFrame] = []

    def plan(store: Store, base: int) -> dict[str, Change]:
        nodes, edges = store.table("nodes", version=base or None, schema=NODES), store.table("edges", version=base or None, schema=EDGES)
        kept, left, report = graph.delete_tenant(nodes, edges, tenant)
        told[:] = [store.keep(report)]
        return {"nodes": Change(kept, "name"), "edges": Change(left, "src")} if report.agg(F.sum("n")).first()[0] else {}

    store.update(plan)
    return told[0]


def backfill_current(store: Store, dry_run: bool = False) -> DataFrame:
    """Marks nodes without an end as current; table, n, unmarked as it was before. Edges keep a null end, which is open too."""
    base = store.manifest()["version"]
    nodes, edges = store.table("nodes", version=base or None, schema=NODES), store.table("edges", version=base or None, schema=EDGES)
    before = store.keep(graph.upkeep_counts(nodes, edges))
    if not dry_run:
        store.update(lambda s, b: {"nodes": Change(graph.backfill_current(s.table("nodes", version=b or None, schema=NODES)), "name")})
    return before
