"""A folder of notes kept in step with its tables: chunks, links and visited sources change in one commit.

Files are compared by content with the record of sources, so only new, changed, vanished and formerly
failed ones are worked on, and only buckets that hold them are read and written. Known chunks are
not embedded again; their payload is patched if it differs (not in the spelling of a time only), without touching keys that others own. A source whose
embedding failed keeps its old chunks and links and is tried again by the next sync. Links are stored as written and where
they lead; a note that appears or vanishes changes where others' links lead, so these are resolved again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, ids, markup
from ..operators import chunk, lifecycle
from ..sources.versions import Change, Store
from .plugins import Embedder, embed

CHUNKS = "id string, source string, offset long, text string, payload map<string,string>, owned array<string>, tenant_id string, space string, embedding array<float>"
LINKS = "source string, target string, path string, name string, resolved string, is_resolved boolean"
SOURCES = "source string, digest string, failed boolean"
REPORT = ["inserted", "refreshed", "pruned", "failed", "conflicts", "edges"]


def note_chunks(files: DataFrame, size: int = 1200) -> DataFrame:
    """source, offset, text, payload of notes' sections; the front matter's fields are payload."""
    parts = files.withColumn("__note", markup.split_front_matter("text")).select("source", F.col("__note.body").alias("text"), F.from_json("__note.fields", "map<string,string>").alias("fields"))
    cut = chunk.markdown_chunks(parts, size)
    heading = F.map_from_arrays(F.array(F.lit("heading_path")), F.array(F.array_join("heading_path", " > ")))
    payload = F.map_concat(F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, v: k != "heading_path"), heading)
    return cut.select("source", "offset", F.col("chunk").alias("text"), payload.alias("payload"))


def note_links(files: DataFrame) -> DataFrame:
    """source, target of notes' links."""
    return files.select("source", F.inline(markup.links("text"))).select("source", "target").distinct()


def _keys(links: DataFrame) -> DataFrame:
    """Adds path and name: what a link's target is compared with."""
    folder = F.regexp_extract("source", r"^(.*/)?", 0)
    joined = F.lower(F.regexp_replace(F.concat(F.when(F.startswith("target", F.lit("/")), F.lit("")).otherwise(folder), F.ltrim("target", F.lit("/"))), r"(^|/)(?:\./)+", "$1"))
    up = reduce(lambda c, _: F.regexp_replace(c, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1"), range(8), joined)
    return links.withColumn("path", up).withColumn("name", F.lower(F.regexp_extract("target", r"([^/]+)$", 1)))


def _note(source: str = "source") -> F.Column:
    return F.regexp_replace(F.col(source), r"(?i)\.md$", "")


def resolve(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Where links lead: to the note of that path, else to the first note of that name, else nowhere yet."""
    slim = links.select("source", "target", "path", "name")
    notes = sources.select("source", F.lower(_note()).alias("path"))
    named = notes.groupBy(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).agg(F.min("source").alias("named"))
    exact = notes.groupBy("path").agg(F.min("source").alias("exact"))
    found = slim.join(exact, "path", "left").join(named, "name", "left")
    to = F.coalesce("exact", "named")
    return found.select("source", "target", "path", "name", F.coalesce(to, "target").alias("resolved"), to.isNotNull().alias("is_resolved"))


def sync(
    store: Store,
    files: DataFrame,
    embedder: Embedder,
    space: str = "default",
    tenant: str | None = None,
    within: str | None = None,
    limit: int | None = None,
    chunks: Callable[[DataFrame], DataFrame] = note_chunks,
    links: Callable[[DataFrame], DataFrame] = note_links,
) -> DataFrame:
    """Brings the store to the state of files (source, text) and returns what was done, a row per source that was worked on.

    within: only sources under this prefix are the folder's, others are left alone. limit: the tenant's chunks afterwards; beyond it
    nothing is written. Report: source, action (add, change, remove, retry), inserted, refreshed, pruned, failed, conflicts (chunks of
    another embedding space, left alone), edges. Running it again after a crash goes on from the last commit.
    """
    report: list[DataFrame] = []

    def plan(store: Store, base: int) -> dict[str, Change]:
        report[:] = []
        seen = store.table("sources", version=base or None, schema=SOURCES)
        mine = seen if within is None else seen.where(F.startswith("source", F.lit(within)))
        now = files.select("source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
        both = now.drop("text").join(mine.withColumnRenamed("digest", "was"), "source", "full_outer")
        action = (
            F.when(F.col("digest").isNull(), "remove").when(F.col("was").isNull(), "add").when(F.col("failed"), "retry").when(F.col("was") != F.col("digest"), "change")
        )
        work = store.keep(both.select("source", "digest", action.alias("action")).where("action IS NOT NULL"))
        touched = store.buckets_of(work, "source")
        if not touched:
            return {}
        todo = now.join(work.where("action <> 'remove'").select("source", "action"), "source")

        old = store.table("chunks", touched, base or None, CHUNKS)
        own = old.join(work.select("source", "action"), "source").where(F.size("owned") > 0)
        scope = None if tenant is None else F.lit(tenant)
        fresh = chunks(todo.select("source", "text"))
        fresh = fresh.select(ids.stable_id(F.col("source"), F.col("offset"), F.col("text"), scope).alias("id"), "source", "offset", "text", "payload", F.map_keys("payload").alias("owned"))
        fresh = store.keep(fresh.dropDuplicates(["source", "id"]))

        new = fresh.join(old.select("source", "id"), ["source", "id"], "left_anti")
        made = store.keep(embed(new, embedder).withColumn("space", F.lit(space)).withColumn("tenant_id", F.lit(tenant).cast("string")))
        failed = made.where("embedding IS NULL").groupBy("source").agg(F.count("*").alias("failed"))
        landed = made.where("embedding IS NOT NULL").select(*[c.split()[0] for c in CHUNKS.split(", ")])

        known = old.select("source", "id", F.col("payload").alias("had"), F.col("owned").alias("owned_then"), F.col("space").alias("space_then")).join(fresh, ["source", "id"])
        stale = F.array_except("owned_then", "owned")
        differs = F.exists("owned", lambda k: ~canonical.instant(F.col("had")[k]).eqNullSafe(canonical.instant(F.col("payload")[k]))) | (F.size(stale) > 0)
        clash = F.coalesce(F.col("space_then") != F.lit(space), F.lit(False))
        patches = store.keep(known.where(differs).select("source", "id", F.lit(0).alias("seq"), stale.alias("deleted"), F.col("payload").alias("changed"), "owned", clash.alias("clash")))
        gone = own.join(fresh.select("source", "id"), ["source", "id"], "left_anti").join(failed, "source", "left_anti").select("source", "id")

        left = old.join(gone, ["source", "id"], "left_anti")
        owners = patches.where("NOT clash").select("source", "id", F.col("owned").alias("owned_now"))
        patched = lifecycle.patch_payloads(left, patches.where("NOT clash"), key="source").join(owners, ["source", "id"], "left")
        columns = [F.coalesce("owned_now", "owned").alias("owned") if c == "owned" else F.col(c) for c in landed.columns]
        after = patched.select(columns).unionByName(landed)
        if limit is not None:
            held = store.table("chunks", version=base or None, schema=CHUNKS).where(F.col("tenant_id").eqNullSafe(F.lit(tenant))).count()
            total = held + landed.count() - gone.count()
            if total > limit:
                raise ValueError(f"{total} chunks, the quota is {limit}")

        others = seen.join(work.select("source"), "source", "left_anti")
        record = todo.select("source", "digest").join(failed, "source", "left").select("source", "digest", F.col("failed").isNotNull().alias("failed"))
        sources_after = store.keep(others.unionByName(record))

        moved = work.where("action IN ('add', 'remove')").select(F.lower(_note()).alias("path"))
        moved_names = moved.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).distinct()
        all_links = store.table("links", version=base or None, schema=LINKS)
        redone = work.select("source").join(failed, "source", "left_anti")
        written = store.keep(_keys(links(todo.select("source", "text").join(failed, "source", "left_anti"))).select("source", "target", "path", "name"))
        standing = all_links.join(redone, "source", "left_anti")
        concerned = standing.join(moved.distinct(), "path", "left_semi").unionByName(standing.join(moved_names, "name", "left_semi")).select("source", "target", "path", "name").distinct()
        settled = store.keep(resolve(written.unionByName(concerned), sources_after))
        link_buckets = sorted({*touched, *store.buckets_of(settled, "source")})
        still = store.table("links", link_buckets, base or None, LINKS).join(redone, "source", "left_anti").join(settled.select("source", "target"), ["source", "target"], "left_anti")

        count = lambda df, name, where="true": df.groupBy("source").agg(F.count(F.when(F.expr(where), 1)).alias(name))
        parts = [count(landed, "inserted"), count(patches, "refreshed", "NOT clash"), count(gone, "pruned"), failed, count(patches, "conflicts", "clash"), count(settled, "edges", "is_resolved")]
        told = reduce(lambda a, b: a.join(b, "source", "left"), parts, work.select("source", "action"))
        report.append(store.keep(told.na.fill(0, REPORT).select("source", "action", *[F.col(c).cast("long").alias(c) for c in REPORT])))
        return {
            "chunks": Change(after, "source", touched),
            "links": Change(still.unionByName(settled), "source", link_buckets),
            "sources": Change(sources_after.where(store.bucket("source").isin(touched)), "source", touched),
        }

    store.update(plan)
    store.forget(but=report)
    return report[0] if report else store.spark.createDataFrame([], "source string, action string, " + ", ".join(f"{c} long" for c in REPORT))
