"""Recall for batches of queries: arms, fusion, floor, stages, budget, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters as flt
from ..operators import fuse, index, rank, retrieve

LEXICAL = ("auto", "off", "bm25", "qdrant_bm25", "lexical", "sparse")


@dataclass
class RecallConfig:
    limit: int = 10
    vector_limit: int = 20
    bm25_limit: int = 20
    rrf_k: int = 60
    vector_floor: int = 0
    adaptive: bool = False
    lexical: str = "bm25"
    weights: dict = field(default_factory=dict)
    token_budget: int | None = None
    as_of: str | None = None
    include_invalidated: bool = False
    tenant: object = None
    filters: dict = field(default_factory=dict)
    stages: list | None = None
    exact: bool = False
    now: str | None = None  # set, it turns the temporal arm on
    fields: dict = field(default_factory=dict)  # text fields searched by gate and vector, with their weights
    vector_min_score: float | None = None
    fallback: bool = False
    timestamp_key: str | None = None
    timestamp_unit: str = "auto"
    reranker: Callable[[DataFrame], DataFrame] | None = None  # reorders what the stages leave, by query_id and rank

    def __post_init__(self):
        if self.lexical not in LEXICAL:
            raise ValueError(f"lexical is one of {LEXICAL}")
        if self.token_budget is not None and self.token_budget <= 0:
            raise ValueError("a token budget is positive")

    @property
    def pool(self) -> int:
        """Candidates that reach the stages."""
        return max(3 * self.limit, 30)


def in_scope(chunks: DataFrame, config: RecallConfig) -> DataFrame:
    """Tenant, validity and payload filters, below every cut."""
    out = flt.tenant_scope(chunks, config.tenant)
    if "invalidated_at" in chunks.columns or config.as_of is not None:
        out = flt.validity(out, config.as_of, config.include_invalidated)
    if not config.filters:
        return out
    key = config.timestamp_key
    own = flt.native_bounds(config.filters, key, chunks.schema) if key else config.filters
    return out.where(flt.payload_filter(own, chunks.schema, key if own is config.filters else None, config.timestamp_unit))


def recall(
    chunks: DataFrame,
    vectors: DataFrame | None,
    queries: DataFrame,
    config: RecallConfig | None = None,
    idx: index.TextIndex | None = None,
    nodes: DataFrame | None = None,
    edges: DataFrame | None = None,
    variants: DataFrame | None = None,
) -> DataFrame:
    """query_id, rank, id, score, sources and the chunk's columns.

    chunks: id, text, ..; vectors: id, embedding; queries: query_id, text, vec. idx: a
    stored index of the chunks' texts, else the batch's terms are indexed. nodes (name,
    type) and edges turn the graph arm on; ids then are strings. A tenant's graph needs
    tenant_id in both; without it, as the exact arm under a tenant, the arm is off.
    variants: query_id, variant (from 1), text and vec (either may be null): paraphrases, and
    documents that would answer; each is searched by words and vectors, as a list of its own behind the query's.
    What stages and reranker return is held against tenant, validity and filters once more.
    """
    config = config or RecallConfig()
    if nodes is not None:
        chunks = chunks.withColumn("id", F.col("id").cast("string"))
        vectors = None if vectors is None else vectors.withColumn("id", F.col("id").cast("string"))
        if idx is not None:
            idx = index.TextIndex(idx.postings.withColumn("id", F.col("id").cast("string")), idx.terms, idx.documents, idx.mean)
    scope = in_scope(chunks, config)
    ids = scope.select("id")

    def indexed(terms: DataFrame, column: str = "text") -> index.TextIndex:
        whole = index.narrow(idx, terms) if idx is not None and column == "text" else index.build(chunks.select("id", F.col(column).alias("text")), only=terms)
        return index.TextIndex(whole.postings.join(ids, "id", "left_semi"), whole.terms, whole.documents, whole.mean)

    arms = []
    if config.lexical != "off":
        terms = retrieve.query_terms(queries)
        arm = retrieve.sparse if config.lexical == "sparse" else retrieve.bm25
        arms.append(("bm25", arm(indexed(terms), terms, config.bm25_limit)))
    dense = None
    if vectors is not None:
        vectors = vectors.join(ids, "id", "left_semi")
        dense = retrieve.vector(vectors, queries, config.vector_limit, min_score=config.vector_min_score)
        arms.append(("vector", dense))
        gates = queries.select("query_id", F.explode(text.gate_tokens("text")).alias("token")).select("query_id", F.explode(text.tokens("token")).alias("term")).distinct()
        for name in config.fields:
            arms.append((f"text:{name}", retrieve.gated(indexed(gates, name), gates, vectors, queries, config.vector_limit)))
        if config.now is not None:
            arms.append(("temporal", retrieve.temporal(scope, vectors, queries, config.now, config.limit)))
    if config.exact and config.tenant is None:
        terms = retrieve.exact_terms(queries)
        arms.append(("exact", retrieve.bm25(indexed(terms), terms, config.limit)))
    named = graph_arm(nodes, edges, scope, queries, config)
    if named is not None:
        arms.append(("graph", named.select("query_id", "rank", "id", "score")))
        own = [F.lit(config.tenant).alias("tenant_id")] if config.tenant is not None else []
        scope = scope.unionByName(named.select("id", "text", F.col("name").alias("source"), *own).distinct(), allowMissingColumns=True)
    ranked = fuse.lists(*arms)
    if variants is not None:
        ranked = ranked.unionByName(variant_lists(variants, vectors, config, indexed, len(arms)), allowMissingColumns=True)
    # A weight of 1 leaves a field's arm to the adaptive profile.
    weights = {**{f"text:{name}": w for name, w in config.fields.items() if w != 1.0}, **config.weights}
    if config.adaptive:
        ranked = ranked.join(queries.select("query_id", F.col("text").alias("__q")), "query_id")
        weight = fuse.adaptive_weight("__q", weights)
    else:
        weight = fuse.static_weight(weights) if weights else None
    fused = fuse.rrf(ranked, config.rrf_k, config.pool if config.stages else config.limit, weight)
    if dense is not None and config.fallback:
        fused = with_fallback(fused, dense, vectors, queries, config)
    if dense is not None and config.vector_floor:
        floor = fuse.vector_floor(fused, dense, config.vector_floor)
        fused = floor.join(fused.select("query_id", "id", "sources"), ["query_id", "id"], "left").withColumn("sources", F.coalesce("sources", F.array(F.lit("vector"))))
    raw = dense.select("query_id", "id", F.col("score").alias("raw_vector_score")) if dense is not None else None
    out = fused if raw is None else fused.join(raw, ["query_id", "id"], "left")
    out = out.join(scope.join(fused.select("id").distinct(), "id", "left_semi"), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    if config.stages:
        out = rank.apply(out, config.stages)
    if config.reranker is not None:
        out = config.reranker(out)
    if config.stages or config.reranker is not None:
        out = rechecked(out, config, named)
    if config.stages:
        out = out.where(F.col("rank") <= config.limit)
    if config.token_budget is not None:
        out = fuse.token_budget(out, config.token_budget, text.estimate_tokens("text"))
    return out


def variant_lists(variants: DataFrame, vectors: DataFrame | None, config: RecallConfig, indexed, first: int) -> DataFrame:
    """Ranked lists of paraphrases, all searched as one batch: query_id, list_name (arm~variant), list_pos, rank, id, score."""
    keyed = variants.withColumn("__key", F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant").cast("string")))
    asked = keyed.select(F.col("__key").alias("query_id"), "text", *(["vec"] if "vec" in variants.columns else []))
    arms = []
    if config.lexical != "off":
        terms = retrieve.query_terms(asked.where("text IS NOT NULL"))
        arms.append(("bm25", (retrieve.sparse if config.lexical == "sparse" else retrieve.bm25)(indexed(terms), terms, config.bm25_limit)))
    if vectors is not None and "vec" in variants.columns:
        arms.append(("vector", retrieve.vector(vectors, asked, config.vector_limit, min_score=config.vector_min_score)))
    names = keyed.select("__key", "query_id", "variant")
    places = [a for a, _ in arms]
    out = fuse.lists(*arms).withColumnRenamed("query_id", "__key").join(names, "__key")
    place = F.lit(first) + (F.col("variant") - 1) * len(places) + F.col("list_pos")
    return out.select("query_id", F.concat_ws("~", "list_name", F.col("variant").cast("string")).alias("list_name"), place.cast("int").alias("list_pos"), "rank", "id", "score")


def rechecked(out: DataFrame, config: RecallConfig, proven: DataFrame | None = None) -> DataFrame:
    """Results that are in scope by their own columns; ranks are closed up. A stage may add rows or change them, but none from outside.

    proven: query_id, id of the graph arm's hits, which under filters chunks in scope back; they pass where they are graph hits alone.
    """
    kept = flt.scrub_tenant(out, config.tenant)
    if "invalidated_at" in out.columns or config.as_of is not None:
        kept = flt.validity(kept, config.as_of, config.include_invalidated)
    if config.filters:
        key = config.timestamp_key
        own = flt.native_bounds(config.filters, key, kept.schema) if key else config.filters
        matches = flt.payload_filter(own, kept.schema, key if own is config.filters else None, config.timestamp_unit)
        known = kept.withColumn("__proven", F.lit(False)) if proven is None else kept.join(proven.select("query_id", "id").distinct().withColumn("__proven", F.lit(True)), ["query_id", "id"], "left")
        kept = known.where(flt.passes_scope(matches, "__proven"))
    order = Window.partitionBy("query_id").orderBy("rank", "id")
    return kept.withColumn("__new", F.row_number().over(order).cast("long")).drop("rank").withColumnRenamed("__new", "rank").select(out.columns)


def graph_arm(nodes: DataFrame | None, edges: DataFrame | None, scope: DataFrame, queries: DataFrame, config: RecallConfig) -> DataFrame | None:
    """Hits of the graph; under filters only those that a chunk in scope backs, without their edges' other ends."""
    if nodes is None or edges is None or (config.tenant is not None and not all("tenant_id" in t.columns for t in (nodes, edges))):
        return None
    hits = retrieve.graph(flt.tenant_scope(nodes, config.tenant), flt.tenant_scope(edges, config.tenant), queries, config.limit, as_of=config.as_of)
    if not config.filters:
        return hits
    return flt.attributed(hits, scope).withColumn("text", F.concat(F.substring_index("text", ": ", 1), F.lit(": "), "name"))


def with_fallback(fused: DataFrame, dense: DataFrame, vectors: DataFrame, queries: DataFrame, config: RecallConfig) -> DataFrame:
    """Queries without a vector hit are searched again without a least score."""
    missed = queries.join(dense.select("query_id").distinct(), "query_id", "left_anti")
    most = max(config.limit, config.vector_limit)
    more = retrieve.vector(vectors, missed, most)
    own = fused.join(missed.select("query_id"), "query_id", "left_semi")
    merged = fuse.fallback_merge(own.select("query_id", "rank", "id", "score"), more).where(F.col("rank") <= (config.pool if config.stages else config.limit))
    found = more.select("query_id", "id", F.array(F.lit("vector")).alias("__v"))
    none = F.array().cast("array<string>")
    merged = merged.join(own.select("query_id", "id", "sources"), ["query_id", "id"], "left").join(found, ["query_id", "id"], "left")
    merged = merged.select("query_id", "rank", "id", "score", F.array_union(F.coalesce("sources", none), F.coalesce("__v", none)).alias("sources"))
    return fused.join(missed.select("query_id"), "query_id", "left_anti").unionByName(merged)


def trace(lists: DataFrame, fused: DataFrame) -> DataFrame:
    """What each arm and the fusion returned, as rows."""
    return lists.select("query_id", "list_name", "rank", "id", F.col("score").cast("double").alias("score")).unionByName(fused.select("query_id", F.lit("fused").alias("list_name"), "rank", "id", "score"))


def context_lines(results: DataFrame, width: int = 100, most: int = 15) -> DataFrame:
    """query_id, context: the memories of a prompt, one numbered line each."""
    line = F.format_string("[%d] (%s) %s", F.col("rank"), F.coalesce(F.col("source").cast("string"), F.lit("?")), text.snippet("text", width))
    ranked = results.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return ranked.select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))
