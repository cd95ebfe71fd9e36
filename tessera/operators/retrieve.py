"""Retrieval arms: ranked lists for batches of queries.

Every arm returns (query_id, rank, id, score); filters apply below the cut, scores are
ranked at nine decimals and ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text, times
from ..sources.tables import dealt, written
from .filters import intersect_window, valid_at
from .index import TextIndex

#: Query vectors that are sent to the tasks at once; more are searched in rounds.
ROW_STEP = 1000
QUERY_BLOCK = 4096
#: Postings of a shard and query terms of a block, which one task adds up, and about the most sums it makes.
SHARD_POSTINGS = 1_000_000
BLOCK_TERMS = 2_000_000
PAIR_SUMS = 100_000_000


def top_k(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")


def query_terms(queries: DataFrame, tokenizer=text.tokens) -> DataFrame:
    """query_id, term, times: repeated terms count repeatedly."""
    return queries.select("query_id", F.explode(tokenizer("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def bm25(index: TextIndex, terms: DataFrame, k: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """allowed: ids that may be returned, applied before the cut."""
    posts = index.postings if allowed is None else index.postings.join(allowed.select("id").distinct(), "id", "left_semi")
    return _summed(posts, index.terms, terms, scoring.bm25(F.col("tf"), F.col("len"), F.lit(index.mean), F.col("idf")), k)


def sparse(index: TextIndex, terms: DataFrame, k: int = 20) -> DataFrame:
    """Dot product of term counts under idf, over terms."""
    return _summed(index.postings, index.terms, terms, F.col("tf") * F.col("idf"), k)


def _summed(posts: DataFrame, stats: DataFrame, terms: DataFrame, part: Column, k: int) -> DataFrame:
    """Best k of the sums of ``part`` (positive) times the query's count of the term, over a query's terms; written once.

    Postings are dealt by id into shards, queries into blocks, and each pair of the two meets in one task, which adds up one
    query at a time and returns its best k: no pair of query and document leaves a task unless it is among those.
    """
    spark = posts.sparkSession
    kinds = terms.schema["query_id"].dataType.simpleString(), posts.schema["id"].dataType.simpleString()
    found = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    known = written(terms.select("term").distinct().join(stats, "term").withColumn("code", F.monotonically_increasing_id()))
    total = known.agg(F.sum("df")).first()[0]
    if not total:
        return spark.createDataFrame([], f"query_id {kinds[0]}, rank long, id {kinds[1]}, score double")
    asked = written(terms.join(known.select("term", "code", "df"), "term").select("query_id", "code", "times", "df"))
    n, adds = asked.agg(F.count("*"), F.sum("df")).first()
    shards = -(-total // SHARD_POSTINGS)
    blocks = max(-(-n // BLOCK_TERMS), -(-adds // (shards * PAIR_SUMS)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = posts.join(known.select("term", "idf", "code"), "term").select("id", "code", part.cast("double").alias("part"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    left = left.withColumn("block", each(blocks) if blocks > 1 else F.lit(0))
    right = asked.drop("df").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", each(shards))
    by = ["shard", "block"]
    left, right = (dealt(t, 2 * shards * blocks, *by) for t in (left, right))  # few pairs share a task
    return written(top_k(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(lambda p, a: _best_sums(p, a, k), found), k))


def _best_sums(posts: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """posts: id, code, part; asked: query_id, code, times."""
    codes = np.unique(asked["code"].to_numpy(np.int64))
    posts = posts[np.isin(posts["code"].to_numpy(np.int64), codes)]
    if posts.empty:
        return pd.DataFrame({"query_id": asked["query_id"][:0], "id": posts["id"], "score": posts["part"]})
    place, ids = pd.factorize(posts["id"], sort=True, use_na_sentinel=False)
    term = np.searchsorted(codes, posts["code"].to_numpy(np.int64))
    order = np.lexsort((place, term))
    term, place, part = term[order], place[order], posts["part"].to_numpy(np.float64)[order]
    first = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(place) != 0)][: len(term)])
    if len(first) < len(term):  # an id that several rows have
        term, place, part = term[first], place[first], np.add.reduceat(part, first)
    ends = np.searchsorted(term, np.arange(len(codes) + 1))
    own, names = pd.factorize(asked["query_id"], use_na_sentinel=False)
    t, times = np.searchsorted(codes, asked["code"].to_numpy(np.int64)), asked["times"].to_numpy(np.float64)
    live = np.flatnonzero(ends[t + 1] > ends[t])
    live = live[np.lexsort((t[live], own[live]))]
    own, t, times = own[live], t[live], times[live]
    cuts = np.flatnonzero(np.r_[True, np.diff(own) != 0][: len(own)])
    sums, out = np.zeros(len(ids)), []
    for lo, hi in zip(cuts, [*cuts[1:], len(own)], strict=True):
        spans = [slice(ends[x], ends[x + 1]) for x in t[lo:hi]]
        for span, n in zip(spans, times[lo:hi], strict=True):
            sums[place[span]] += part[span] * n
        few = 8 * sum(s.stop - s.start for s in spans) < len(ids)
        hit = np.unique(np.concatenate([place[s] for s in spans])) if few else np.flatnonzero(sums)
        value = sums[hit]
        sums[hit] = 0.0
        key = -np.round(value, 9)
        if len(hit) > k:
            near = np.flatnonzero(key <= np.partition(key, k - 1)[k - 1])
            hit, value, key = hit[near], value[near], key[near]
        top = np.argsort(key, kind="stable")[:k]
        out.append((np.full(len(top), own[lo]), hit[top], value[top]))
    q, i, score = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"query_id": names[q], "id": ids[i], "score": score})


def vector(vectors: DataFrame, queries: DataFrame, k: int = 20, exclude_self: bool = False, min_score: float | None = None, ts: str | None = None) -> DataFrame:
    """Exact cosine top-k. vectors: id, embedding; queries: query_id, vec. Ids keep their types; rows without one are left out.

    ts names a time of the vectors; queries then have start and end, both inclusive, and see no others.

    Query vectors go to the tasks in blocks of bounded size; rows are multiplied a few at a
    time, and each step keeps its own best k (ties by id), so what is shuffled does not
    grow with the table times the queries. The result is written once.
    """
    spark = vectors.sparkSession
    span = [F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("start", "end")] if ts else []
    when = [F.unix_micros(F.col(ts).cast("timestamp")).alias("at")] if ts else []
    wanted = queries.select("query_id", "vec", *span).where("vec IS NOT NULL").orderBy("query_id")
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    out = None
    rows = wanted.limit(QUERY_BLOCK + 1).collect()
    if not rows:
        return spark.createDataFrame([], f"query_id {kinds[0]}, rank long, id {kinds[1]}, score double")
    blocks = [rows] if len(rows) <= QUERY_BLOCK else _blocks(wanted)
    for block in blocks:
        ids = np.array([r["query_id"] for r in block], object)
        matrix = np.array([r["vec"] for r in block], np.float64).reshape(len(ids), -1)
        norms = np.linalg.norm(matrix, axis=1)
        bounds = np.array([[r["start"], r["end"]] for r in block], np.int64).reshape(len(ids), 2).T if ts else None
        shared = spark.sparkContext.broadcast((ids, matrix, norms, bounds))

        def best(batches, shared=shared):
            qids, q, qn, span = shared.value
            for pdf in batches:
                for at in range(0, len(pdf) if len(qids) else 0, ROW_STEP):
                    part = pdf.iloc[at : at + ROW_STEP]
                    own = part["id"].to_numpy(object)
                    x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        s = (x @ q.T) / (np.linalg.norm(x, axis=1)[:, None] * qn[None, :])
                    s[~np.isfinite(s)] = -np.inf
                    if exclude_self:
                        s[own[:, None] == qids[None, :]] = -np.inf
                    if span is not None:
                        at_ = part["at"].to_numpy(np.int64)[:, None]
                        s[(at_ < span[0][None, :]) | (at_ > span[1][None, :])] = -np.inf
                    by_id = np.argsort(own, kind="stable")
                    order = by_id[np.argsort(-np.round(s[by_id], 9), axis=0, kind="stable")][:k]
                    i, j = order.ravel(), np.tile(np.arange(len(qids)), len(order))
                    real = np.isfinite(s[i, j])
                    yield pd.DataFrame({"query_id": qids[j[real]], "id": own[i[real]], "score": s[i[real], j[real]]})

        held = vectors.select("id", "embedding", *when).where("id IS NOT NULL AND embedding IS NOT NULL" + (" AND at IS NOT NULL" if ts else ""))
        part = held.mapInPandas(best, f"query_id {kinds[0]}, id {kinds[1]}, score double")
        out = part if out is None else out.unionByName(part)
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    return written(top_k(out, k))


def _blocks(wanted: DataFrame):
    block: list = []
    for row in wanted.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


def gated(index: TextIndex, gates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Dense ranking of the documents that hold at least one gate term of the query. gates: query_id, term."""
    admitted = index.postings.join(gates, "term").select("query_id", "id").distinct()
    pairs = admitted.join(vectors.select("id", "embedding"), "id").join(queries.select("query_id", "vec"), "query_id")
    return top_k(pairs.select("query_id", "id", scoring.cosine(F.col("embedding"), F.col("vec")).alias("score")).where("score IS NOT NULL"), k)


def in_window(docs: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    return docs.where((F.col(ts).cast("timestamp") >= start.cast("timestamp")) & (F.col(ts).cast("timestamp") <= end.cast("timestamp")))


def date_focused(docs: DataFrame, target: str, k: int, ts: str = "ts", source: str = "source") -> DataFrame:
    """The day itself first, its diary before other sources, then by distance to noon."""
    day = F.lit(target).cast("date")
    distance = F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lit(f"{target} 12:00:00").cast("timestamp"))) / 1e6
    order = [F.coalesce(F.col(ts).cast("date") != day, F.lit(True)), ~F.endswith(F.coalesce(F.col(source), F.lit("")), F.lit(f"{target}.md")), F.coalesce(distance, F.lit(float("inf"))), F.col("id")]
    top = docs.withColumn("distance", distance).orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # at most k rows


def exact(index: TextIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """BM25 over the technical tokens of the queries that have any."""
    return bm25(index, exact_terms(queries), k)


def exact_terms(queries: DataFrame) -> DataFrame:
    return query_terms(queries.select("query_id", F.array_join(text.exact_tokens("text"), " ").alias("text")))


def temporal(docs: DataFrame, vectors: DataFrame, queries: DataFrame, now: str, k: int = 10, ts: str = "ts", source: str = "source", gte: Column | None = None, lte: Column | None = None) -> DataFrame:
    """Documents of the time that a query speaks of, inside the caller's bounds; other queries return nothing.

    A query about a day and nothing else gets that day, its diary first, then its
    neighbours by distance to noon; the rest are searched by vector inside their window.
    Days are ranked once for all queries that ask for them. The batch's windows are kept
    in the cache, since three branches read them.
    """
    # Exploded, since a projection would be copied into each of its uses.
    spoken = queries.select("query_id", "vec", F.explode(F.array(times.temporal_window(F.col("text"), now))).alias("w")).where("w.start IS NOT NULL")
    low, high, some = intersect_window(F.col("w.start").cast("timestamp"), F.col("w.end").cast("timestamp"), gte, lte)
    day = F.col("w.target").cast("date")
    inside = (day >= low.cast("date")) & (day <= high.cast("date"))
    asked = spoken.where(some).select("query_id", "vec", low.alias("start"), high.alias("end"), day.alias("target"), F.coalesce(F.col("w.date_focused") & inside, F.lit(False)).alias("focused")).persist()

    window = ["start", "end", "target"]
    spans = asked.where("focused").select(*window).distinct().withColumn("day", F.explode(F.sequence(F.col("start").cast("date"), F.col("end").cast("date"))))
    own = docs.select("id", F.col(ts).cast("timestamp").alias("ts"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).withColumn("day", F.col("ts").cast("date"))
    near = own.join(spans, "day").where("ts BETWEEN start AND end")
    noon = F.unix_micros(F.col("target").cast("timestamp")) + 43_200_000_000
    away = F.abs(F.unix_micros("ts") - noon) / 1e6
    order = Window.partitionBy(*window).orderBy(F.col("day") != F.col("target"), ~F.endswith("source", F.concat(F.date_format("target", "yyyy-MM-dd"), F.lit(".md"))), away, "id")
    best = near.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select(*window, "rank", "id", (1 / (1 + away / 86400)).alias("score"))
    by_day = asked.where("focused").select("query_id", *window).join(best, window).select("query_id", "rank", "id", "score")

    timed = vectors.select("id", "embedding").join(docs.select("id", F.col(ts).alias("__ts")), "id")
    return by_day.unionByName(vector(timed, asked.where("NOT focused"), k, ts="__ts"))


def graph(nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 10, each: int = 5, width: int = 300, as_of: str | None = None) -> DataFrame:
    """Nodes that a query names and that have a valid edge: query_id, rank, id ('graph:name'), score, name, text.

    nodes: name, type; edges: src, rel, dst, valid_from, valid_until. The text lists up to
    ``each`` edges, in either direction; only those of hit nodes are gathered.
    """
    hits = graph_hits(nodes, queries.select("query_id", F.explode(F.array_distinct(text.query_tokens("text"))).alias("token")), k=5 * k)
    valid = edges.where(valid_at(F.lit(as_of))) if as_of is not None else edges
    named = hits.select("name").distinct()
    arrow = F.concat("src", F.lit("-["), "rel", F.lit("]->"), "dst").alias("edge")
    out = valid.select(F.col("src").alias("name"), arrow).unionByName(valid.where("src <> dst").select(F.col("dst").alias("name"), arrow)).join(named, "name", "left_semi").distinct()
    first = out.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("edge"))).where(F.col("n") <= each)
    said = first.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("edge")), "; ").alias("edges"))
    kinds = nodes.groupBy("name").agg(F.min("type").alias("type"))
    told = F.substring(F.concat(F.coalesce("type", F.lit("")), F.lit(": "), "name", F.lit(". "), "edges"), 1, width)
    found = hits.drop("rank").join(said, "name").join(kinds, "name").select("query_id", "name", F.concat(F.lit("graph:"), "name").alias("id"), F.col("hits").cast("double").alias("score"), told.alias("text"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "name")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def graph_hits(nodes: DataFrame, tokens: DataFrame, shortest_part: int = 5, k: int = 10) -> DataFrame:
    """Nodes named by query tokens: (query_id, name, hits). tokens: query_id, token.

    A token is matched at the first level that has any node: its number (six digits or
    more), its exact name, its handle, or a part of a name (five characters or more).
    """
    low = nodes.select("name", F.lower("name").alias("name_lower"))
    number = tokens.where(F.rlike("token", F.lit(r"^\d{6,}$"))).withColumn("end", F.right("token", F.lit(6)))
    number = number.join(low.withColumn("end", F.right("name_lower", F.lit(6))), "end").where(F.endswith("name_lower", "token")).drop("end").withColumn("level", F.lit(0))
    exact = tokens.join(low, F.col("token") == F.col("name_lower")).withColumn("level", F.lit(1))
    handle = tokens.withColumn("handle", F.concat(F.lit("@"), "token")).join(low, F.col("handle") == F.col("name_lower")).drop("handle").withColumn("level", F.lit(2))
    # A part is looked up by its first characters among the runs of that length in the names.
    long_ = low.where(F.length("name_lower") >= shortest_part)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name_lower") - (shortest_part - 1)), lambda i: F.substr("name_lower", i, F.lit(shortest_part))))
    keyed = tokens.where(F.length("token") >= shortest_part).withColumn("run", F.substring("token", 1, shortest_part))
    part = keyed.join(long_.withColumn("run", F.explode(runs)), "run").where(F.contains("name_lower", "token")).drop("run").withColumn("level", F.lit(3))
    found = number.unionByName(exact).unionByName(handle).unionByName(part)
    first = found.groupBy("query_id", "token").agg(F.min("level").alias("level"))
    hits = found.join(first, ["query_id", "token", "level"]).groupBy("query_id", "name").agg(F.countDistinct("token").alias("hits"))
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "name")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
