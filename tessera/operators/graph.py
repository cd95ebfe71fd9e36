"""Temporal facts as edge tables: src, rel, dst, valid_from, valid_until."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .filters import valid_at


def triples(edges: DataFrame, src=None, rel=None, dst=None, as_of: str | None = None, limit: int | None = None) -> DataFrame:
    out = edges
    for column, want in (("src", src), ("rel", rel), ("dst", dst)):
        if want is not None:
            out = out.where(F.col(column) == F.lit(want))
    if as_of is not None:
        out = out.where(valid_at(F.lit(as_of)))
    return out if limit is None else out.orderBy("src", "rel", "dst").limit(limit)


def neighbors(edges: DataFrame, nodes: DataFrame, as_of: str | None = None, each: int | None = None) -> DataFrame:
    """Outgoing neighbours of the nodes (column node)."""
    found = triples(edges, as_of=as_of).join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select("src", "rel", "dst").distinct()
    return found if each is None else found.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("rel", "dst"))).where(F.col("n") <= each).drop("n")


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return both.groupBy("id").agg(F.count("*").alias("degree"))


def upsert_triples(edges: DataFrame, fresh: DataFrame, keys=("src", "rel", "dst")) -> DataFrame:
    rest = edges.join(fresh.select(*keys).distinct(), list(keys), "left_anti")
    return rest.unionByName(fresh.dropDuplicates(list(keys)), allowMissingColumns=True)


def close_edges(edges: DataFrame, targets: DataFrame, ended: Column, keys=("src", "rel", "dst")) -> DataFrame:
    """Ends edges that are open."""
    mark = targets.select(*keys).distinct().withColumn("__hit", F.lit(True))
    open_ = F.col("__hit") & F.coalesce(F.nullif(F.col("valid_until").cast("string"), F.lit("current")).isNull(), F.lit(True))
    return edges.join(mark, list(keys), "left").withColumn("valid_until", F.when(open_, ended).otherwise(F.col("valid_until"))).drop("__hit")


def sync_links(edges: DataFrame, sources: DataFrame, links: DataFrame, rel: str = "LINKS_TO") -> DataFrame:
    """Replaces the outgoing links of the sources (column src)."""
    rest = edges.join(sources.select("src").distinct().withColumn("rel", F.lit(rel)), ["src", "rel"], "left_anti")
    return rest.unionByName(links.withColumn("rel", F.lit(rel)), allowMissingColumns=True)


def tag_edges(items: DataFrame, id_col: str = "id", tags: str = "tags") -> DataFrame:
    return items.select(F.col(id_col).alias("src"), F.lit("TAGGED").alias("rel"), F.explode(F.array_distinct(tags)).alias("dst"))


def referrers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sources that link to the nodes (column name), by lower-cased name."""
    keys = nodes.select(F.lower("name").alias("key")).distinct()
    return edges.withColumn("key", F.lower(F.col("dst").cast("string"))).join(keys, "key", "left_semi").select("src", "rel", "dst")


def resurrect(queries: DataFrame, nodes: DataFrame, edges: DataFrame, results: DataFrame, limit: int = 3, shortest: int = 4, seeds: int = 8, each: int = 5) -> DataFrame:
    """Neighbours of the nodes that a query names, if no result speaks of them.

    queries: query_id, text; nodes: name; edges: src, dst (names); results: query_id, text.
    Score: 0.10 + 0.15 x (matched seeds / seeds), at most 0.30.
    """
    words = F.filter(F.split(F.trim(F.lower(F.coalesce("text", F.lit("")))), r"\s+"), lambda w: F.length(w) >= shortest)
    chosen = F.slice(F.array_sort(F.array_distinct(F.array_except(words, F.array([F.lit(s) for s in text.STOPWORDS])))), 1, seeds)
    picked = queries.select("query_id", chosen.alias("seeds")).where(F.size("seeds") > 0)
    seed = picked.select("query_id", F.size("seeds").alias("n"), F.explode("seeds").alias("seed"))
    around = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    hit = seed.join(nodes.select("name", F.lower("name").alias("seed")), "seed").join(around.withColumnRenamed("src", "name"), "name")
    near = hit.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "seed").orderBy("dst"))).where(F.col("k") <= each)
    scored = near.groupBy("query_id", F.col("dst").alias("name")).agg(F.least(F.lit(0.30), F.lit(0.10) + 0.15 * F.countDistinct("seed") / F.max("n")).alias("score"))
    said = scored.join(results.select("query_id", F.lower(F.coalesce("text", F.lit(""))).alias("said")), "query_id").where(F.contains("said", F.lower("name"))).select("query_id", "name").distinct()
    fresh = scored.join(said, ["query_id", "name"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "name")
    return fresh.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Where links lead: by exact path, then by name without its ending, else dangling. links: source, target; files: path."""
    paths = files.select("path", F.lower("path").alias("__path"))
    names = files.groupBy(F.lower(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("__name")).agg(F.min("path").alias("named"))
    folder = F.regexp_extract("source", r"^(.*/)?", 0)
    relative = F.lower(F.regexp_replace(F.concat(folder, F.col("target")), r"(^|/)\./", "$1"))
    keyed = links.withColumn("__path", F.regexp_replace(relative, r"[^/]+/\.\./", "")).withColumn("__name", F.lower(F.regexp_extract("target", r"([^/]+?)(?:\.[^./]*)?$", 1)))
    found = keyed.join(paths, "__path", "left").join(names, "__name", "left")
    to = F.coalesce("path", "named", "target")
    return found.select("source", "target", to.alias("resolved"), (F.col("path").isNotNull() | F.col("named").isNotNull()).alias("is_resolved"))


CURRENT = "current"


def is_open(until: str = "valid_until") -> Column:
    """No end, or the explicit mark of what still holds."""
    return F.coalesce(F.col(until).cast("string"), F.lit(CURRENT)).isin("", CURRENT)


def supersede(edges: DataFrame, facts: DataFrame, keys: tuple = ("src", "rel")) -> DataFrame:
    """edges with facts of relations that hold one thing at a time: each ends where the next of its keys begins.

    edges: keys, dst, valid_from, valid_until (times), and more; facts: keys, dst, valid_from, and what else edges has. A fact that repeats what holds at
    its time is not stored again; one that comes late is put between those around it; an end that is there stays if it is earlier.
    Only chains of keys that facts name are looked at. Of two at one time the stored one comes first, then the smaller dst.
    """
    touched = facts.select(*keys).distinct()
    rest = edges.join(touched, list(keys), "left_anti")
    old = edges.join(touched, list(keys), "left_semi").withColumn("__new", F.lit(False))
    both = old.unionByName(facts.withColumn("__new", F.lit(True)), allowMissingColumns=True)
    chain = Window.partitionBy(*keys).orderBy("valid_from", "__new", "dst")
    ends = F.lag("valid_until").over(chain)
    holds = (F.lag("dst").over(chain) == F.col("dst")) & (ends.isNull() | (ends > F.col("valid_from")))
    fresh = both.withColumn("__again", F.col("__new") & F.coalesce(holds, F.lit(False))).where("NOT __again").drop("__again")
    following = F.lead("valid_from").over(chain)
    return rest.unionByName(fresh.withColumn("valid_until", F.least("valid_until", following)).select(edges.columns))


def backfill_current(table: DataFrame, until: str = "valid_until") -> DataFrame:
    """Rows without an end get the explicit mark (the column is text)."""
    return table.withColumn(until, F.coalesce(F.col(until).cast("string"), F.lit(CURRENT)))


def upkeep_counts(nodes: DataFrame, edges: DataFrame, until: str = "valid_until") -> DataFrame:
    """table, n, unmarked: how many nodes and edges there are, and how many a backfill would mark."""
    one = lambda df, name: df.agg(F.count("*").alias("n"), F.count(F.when(F.col(until).isNull(), 1)).alias("unmarked")).select(F.lit(name).alias("table"), "n", "unmarked")
    return one(nodes, "nodes").unionByName(one(edges, "edges"))


def tenants(data: list[DataFrame], configured: DataFrame) -> DataFrame:
    """tenant_id, n: every tenant of the data with its rows, and those that only a key or a quota names, with none."""
    rows = [d.where("tenant_id IS NOT NULL").select(F.col("tenant_id").cast("string").alias("tenant_id"), F.lit(1).cast("long").alias("one")) for d in data]
    named = configured.where("tenant_id IS NOT NULL").select(F.col("tenant_id").cast("string").alias("tenant_id"), F.lit(0).cast("long").alias("one"))
    whole = named
    for d in rows:
        whole = whole.unionByName(d)
    return whole.groupBy("tenant_id").agg(F.sum("one").alias("n"))


def link_sources(edges: DataFrame, rel: str = "LINKS_TO") -> DataFrame:
    return edges.where(F.col("rel") == rel).select("src").distinct()


def stamp_tenant(nodes: DataFrame, edges: DataFrame, tenant, only_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both tables with an owner."""
    own = F.coalesce("tenant_id", F.lit(tenant)) if only_missing else F.lit(tenant)
    return nodes.withColumn("tenant_id", own), edges.withColumn("tenant_id", own)


def delete_tenant(nodes: DataFrame, edges: DataFrame, tenant) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report) without a tenant's; edges of others that hang on its nodes go too and are reported as detached.

    nodes: name, tenant_id. A name that another tenant's node has keeps that tenant's edges.
    """
    if tenant in (None, ""):
        raise ValueError("a tenant has a name")
    mine = lambda df: F.col("tenant_id").eqNullSafe(F.lit(tenant).cast(df.schema["tenant_id"].dataType))
    kept = nodes.where(~mine(nodes))
    gone = nodes.where(mine(nodes)).select("name", F.lit(True).alias("__gone")).distinct().join(kept.select("name").distinct(), "name", "left_anti")
    others = edges.where(~mine(edges))
    ends = [gone.select(F.col("name").alias(c), F.col("__gone").alias(f"__{c}")) for c in ("src", "dst")]
    marked = others.join(ends[0], "src", "left").join(ends[1], "dst", "left")
    hangs = F.coalesce(F.col("__src"), F.col("__dst"), F.lit(False))
    left = marked.where(~hangs).select(edges.columns)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    report = count(nodes.where(mine(nodes)), "nodes").unionByName(count(edges.where(mine(edges)), "edges")).unionByName(count(marked.where(hangs), "detached"))
    return kept, left, report
