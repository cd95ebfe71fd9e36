"""The registered queries over the operators, each beside the SQL that it must equal."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import canonical, ids, names, scoring, text, times
from .operators import attribute, cells, chunk, filters, fuse, graph, index, lifecycle, metrics, prefixes, provenance, rank, retrieve, state, synthesis
from .plans import folder, plugins
from .plans import recall as plan
from .sources import tables
from .sources.versions import Store
from .streaming import streams

NOW, AS_OF = "2024-02-01 00:00:00", "2024-01-20 00:00:00"
K = 20
#: Lines of orders that one task counts.
LINES_TASK = 1_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Named parts of the SQL; a query names those it starts from, and they name theirs.
PARTS: dict[str, tuple[list[str], str]] = {
    "chunks": ([], "SELECT d.doc_id AS id, d.text, d.lang, d.source, d.n_chars, CAST(e.ts AS TIMESTAMP) AS ts, e.user_id % 5 AS tenant_id, e.user_id % 11 AS access_count, CAST(e.ts AS TIMESTAMP) AS valid_from, CASE WHEN d.doc_id % 3 = 0 THEN CAST(e.ts AS TIMESTAMP) + INTERVAL 10 DAY END AS valid_until, CASE WHEN d.doc_id % 7 = 0 THEN CAST(e.ts AS TIMESTAMP) + INTERVAL 5 DAY END AS invalidated_at FROM documents d LEFT JOIN events e ON d.doc_id = e.event_id"),
    "toks": ([], r"SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS toks FROM documents"),
    "posts": (["toks"], "SELECT id, term, len(toks) AS len, count(*) AS tf FROM (SELECT id, toks, unnest(toks) AS term FROM toks) GROUP BY id, term, len(toks)"),
    "corpus": (["toks"], "SELECT count(*) AS n, sum(len(toks)) / greatest(count(*), 1) AS mean FROM toks"),
    "terms": (["posts", "corpus"], "SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts CROSS JOIN corpus GROUP BY term"),
    "q": ([], r"SELECT item_id AS query_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') AS text FROM benchmark"),
    "qterms": (["q"], r"SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM q) GROUP BY query_id, term"),
    "bm25_all": (["posts", "corpus", "terms", "qterms"], "SELECT query_id, id, sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / greatest(mean, 1))) * times) AS score FROM posts JOIN terms USING (term) JOIN qterms USING (term) CROSS JOIN corpus GROUP BY query_id, id"),
    "bm25": (["bm25_all"], "SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm25_all) WHERE rank <= 20"),
    "qv": ([], "SELECT b.item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS vec FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id"),
    "dense": (["qv"], "SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), vec) AS score FROM embeddings CROSS JOIN qv WHERE vec_id <> query_id)) WHERE rank <= 20"),
    "two_lists": (["bm25", "dense"], "SELECT query_id, 'bm25' AS list_name, 0 AS list_pos, rank, id, score FROM bm25 UNION ALL SELECT query_id, 'vector', 1, rank, id, score FROM dense"),
    "fused": (["two_lists"], "SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list_pos * 1000 + rank) AS first FROM two_lists GROUP BY query_id, id"),
    "ranked": (["fused"], "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, id) AS rank FROM fused"),
    "hits": (["ranked", "chunks", "q", "two_lists"], "SELECT r.query_id, r.id, r.rank, r.score * 10 AS score, q.text AS query, c.text, c.source, c.ts, c.access_count, (SELECT max(b.score) FROM two_lists b WHERE b.query_id = r.query_id AND b.id = r.id AND list_name = 'vector') AS raw, (SELECT count(*) FROM two_lists b WHERE b.query_id = r.query_id AND b.id = r.id AND list_name = 'vector') > 0 AS dense, (SELECT count(*) FROM two_lists b WHERE b.query_id = r.query_id AND b.id = r.id AND list_name = 'bm25') > 0 AS lexical FROM ranked r JOIN chunks c ON r.id = c.id JOIN q ON r.query_id = q.query_id"),
    "supplies": ([], "SELECT 's' || l_suppkey AS src, 'SUPPLIES' AS rel, 'p' || l_partkey AS dst, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey"),
    "degree": (["supplies"], "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM supplies UNION ALL SELECT dst FROM supplies) GROUP BY id"),
    "facts": ([], "SELECT 'c' || o_custkey AS src, 'PLACED' AS rel, 'o' || o_orderkey AS dst, CAST(o_orderdate AS TIMESTAMP) AS valid_from, lead(CAST(o_orderdate AS TIMESTAMP)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_until FROM orders"),
    "fb": ([], "SELECT event_id, ts, event_type AS source, CAST(CAST(json_extract_string(props, '$.k') AS INT) % 3 AS VARCHAR) AS query_type, least(1.0, value / 100) AS reward FROM events"),
    "q_table": (["fb"], "SELECT source, query_type, list_reduce(list_prepend(0.5::DOUBLE, list(CAST(reward AS DOUBLE) ORDER BY ts, event_id)), lambda q, r: greatest(0.05, least(0.95, (q * 0.995 + 0.5 * (1 - 0.995)) + 0.15 * (r - (q * 0.995 + 0.5 * (1 - 0.995)))))) AS q, count(*) AS n FROM fb GROUP BY source, query_type"),
    "asked": (["qv"], "SELECT query_id, vec, query_id % 2 = 0 AS focused, CAST('2024-01-0' || (query_id % 5 + 1) AS DATE) AS target FROM qv"),
    "own": (["chunks"], "SELECT * FROM chunks WHERE id % 2 = 0"),
}


def with_parts(body: str, parts: list[str]) -> str:
    """body under a WITH of the parts and all that they need."""
    order: list[str] = []

    def need(name: str):
        for other in PARTS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in parts:
        need(name)
    return ("WITH " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" if order else "") + body


def query(sql: str | None = None, parts: tuple = ()):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_parts(sql, list(parts))
        return f

    return register


# --- inputs -----------------------------------------------------------------


def read(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs_of(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").withColumnRenamed("doc_id", "id")


def chunks_of(spark, sf, ids: DataFrame | None = None) -> DataFrame:
    """ids: the only ones that are wanted; others are left out before the join."""
    e = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id")
    d, e = (t if ids is None else t.join(ids, "id", "left_semi") for t in (docs_of(spark, sf), e))
    c = d.join(e, "id", "left").withColumn("tenant_id", F.col("user_id") % 5).withColumn("access_count", F.col("user_id") % 11).drop("user_id")
    c = c.withColumn("last_accessed", F.col("ts")).withColumn("valid_from", F.col("ts"))
    return c.withColumn("valid_until", F.when(F.col("id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 10 DAY"))).withColumn("invalidated_at", F.when(F.col("id") % 7 == 0, F.col("ts") + F.expr("INTERVAL 5 DAY")))


def text_queries(spark, sf) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(text.tokens("text"), " ").alias("text"))


def vectors_of(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")


def queries_of(spark, sf) -> DataFrame:
    vec = vectors_of(spark, sf).select(F.col("id").alias("query_id"), F.col("embedding").alias("vec"))
    return text_queries(spark, sf).join(vec, "query_id", "left")


def bm25_of(spark, sf, k: int = K) -> DataFrame:
    terms = retrieve.query_terms(text_queries(spark, sf))
    return retrieve.bm25(index.build(docs_of(spark, sf), only=terms), terms, k)


def dense_of(spark, sf, k: int = K) -> DataFrame:
    return retrieve.vector(vectors_of(spark, sf), queries_of(spark, sf), k, exclude_self=True)


def lists_of(spark, sf) -> DataFrame:
    return fuse.lists(("bm25", bm25_of(spark, sf)), ("vector", dense_of(spark, sf)))


def hits_of(spark, sf) -> DataFrame:
    """Fused results with their chunks, as the stages take them."""
    dense = dense_of(spark, sf)
    fused = fuse.rrf(fuse.lists(("bm25", bm25_of(spark, sf)), ("vector", dense)))
    raw = dense.select("query_id", "id", F.col("score").alias("raw_vector_score"))
    out = fused.join(raw, ["query_id", "id"], "left").join(chunks_of(spark, sf, fused.select("id").distinct()), "id").join(text_queries(spark, sf).withColumnRenamed("text", "query"), "query_id")
    return out.withColumn("score", F.col("score") * 10)


def recall_events(spark, sf) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("tenant_id"))


def feedback_of(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"), (k % 3).cast("string").alias("query_type"), F.least(F.lit(1.0), F.col("value") / 100).alias("reward"))


def supplies_of(spark, sf) -> DataFrame:
    lines = read(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    pairs = tables.dealt(lines, -(-lines.count() // LINES_TASK), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return pairs.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.lit("SUPPLIES").alias("rel"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "n")


def facts_of(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp"))
    until = F.lead("d").over(Window.partitionBy("o_custkey").orderBy("d", "o_orderkey"))
    return o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.lit("PLACED").alias("rel"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.col("d").alias("valid_from"), until.alias("valid_until"))


def scored(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "rank", "id", F.round("score", 6).alias("score"), *more)


# --- index and retrieval ------------------------------------------------------


@query("SELECT id, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_terms FROM toks", ("toks",))
def token_stats(spark, sf):
    t = text.tokens("text")
    return docs_of(spark, sf).select("id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


@query("SELECT term, df, round(idf, 6) AS idf FROM terms", ("terms",))
def term_df_idf(spark, sf):
    return index.build(docs_of(spark, sf)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("SELECT query_id, rank, id, round(score, 6) AS score FROM bm25", ("bm25",))
def bm25_topk(spark, sf):
    return scored(bm25_of(spark, sf))


@query("SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT b.query_id, b.id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm25_all b JOIN documents d ON b.id = d.doc_id WHERE d.lang = 'en' AND d.n_chars >= 500) WHERE rank <= 20", ("bm25_all",))
def bm25_filtered_topk(spark, sf):
    docs = docs_of(spark, sf)
    allowed = docs.where(filters.payload_filter({"lang": "en", "n_chars": {"gte": 500}}, docs.schema))
    terms = retrieve.query_terms(text_queries(spark, sf))
    return scored(retrieve.bm25(index.build(docs, only=terms), terms, K, allowed))


@query("SELECT query_id, rank, id, round(score, 6) AS score FROM dense", ("dense",))
def vector_index_topk(spark, sf):
    """The same from a stored index of cells."""
    path = f"{tables.working_folder(spark)}/cells"
    cells.build(vectors_of(spark, sf), path)
    return scored(cells.search(spark, path, queries_of(spark, sf), K, exclude_self=True))


@query("SELECT query_id, rank, id, round(score, 6) AS score FROM dense", ("dense",))
def vector_topk(spark, sf):
    return scored(dense_of(spark, sf))


@query("SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), vec) AS score FROM embeddings CROSS JOIN qv WHERE vec_id <> query_id AND label = 1)) WHERE rank <= 20 AND score >= 0.0", ("qv",))
def vector_topk_filtered(spark, sf):
    return scored(retrieve.vector(vectors_of(spark, sf).where("label = 1"), queries_of(spark, sf), K, exclude_self=True, min_score=0.0))


@query("SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT query_id, id, sum(tf * times * idf) AS score FROM posts JOIN terms USING (term) JOIN qterms USING (term) GROUP BY query_id, id)) WHERE rank <= 20", ("posts", "terms", "qterms"))
def sparse_tfidf_topk(spark, sf):
    terms = retrieve.query_terms(text_queries(spark, sf))
    return scored(retrieve.sparse(index.build(docs_of(spark, sf), only=terms), terms, K))


PARTS["crc_table"] = ([], "SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t")
PARTS["term_bytes"] = (["posts"], "SELECT term, list_transform(range(0, strlen(term)), lambda i: CAST('0x' || substr(hex(encode(term)), CAST(2 * i + 1 AS INT), 2) AS BIGINT)) AS bytes FROM (SELECT DISTINCT term FROM posts)")
PARTS["term_index"] = (["crc_table", "term_bytes"], "SELECT term, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INT)])), 4294967295) AS idx FROM term_bytes CROSS JOIN crc_table")


@query('SELECT id, idx AS "index", CAST(sum(tf) AS DOUBLE) AS value FROM posts JOIN term_index USING (term) GROUP BY id, idx', ("posts", "term_index"))
def sparse_vectors(spark, sf):
    return index.sparse_vectors(index.postings(docs_of(spark, sf)))


GATE_SQL = (
    "SELECT query_id, unnest(list_slice(list_sort(list_transform(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')), lambda w: length(w) >= 3 AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in text.STOPWORDS)
    + "], w)), lambda w: lpad(CAST(1000 - length(w) AS VARCHAR), 4, '0') || w)), 1, 8)) AS keyed FROM q"
)
PARTS["gates"] = (["q"], f"SELECT query_id, substr(keyed, 5) AS term FROM ({GATE_SQL})")


@query("SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT g.query_id, e.vec_id AS id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), v.vec) AS score FROM (SELECT DISTINCT query_id, id FROM posts JOIN gates USING (term)) g JOIN embeddings e ON e.vec_id = g.id JOIN qv v ON v.query_id = g.query_id)) WHERE rank <= 20", ("posts", "gates", "qv"))
def lexical_gated_dense(spark, sf):
    qs = queries_of(spark, sf)
    gates = qs.select("query_id", F.explode(text.gate_words("text")).alias("term"))
    return scored(retrieve.gated(index.build(docs_of(spark, sf), only=gates), gates, vectors_of(spark, sf), qs, K))


@query(r"SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b'))) AS token FROM documents")
def exact_token_addresses(spark, sf):
    return docs_of(spark, sf).select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(text.IDENTIFIERS[1]), F.lit(0)))).alias("token"))


@query()
def exact_token_prefilter(spark, sf):
    """BM25 over the technical tokens of documents that have any."""
    # No filter on the tokens, which would find them twice; a document without any has no terms.
    terms = tables.written(retrieve.exact_terms(docs_of(spark, sf).withColumnRenamed("id", "query_id")))
    return scored(retrieve.bm25(index.build(docs_of(spark, sf), only=terms), terms, 10))


# --- fusion -------------------------------------------------------------------


@query("SELECT query_id, rank, id, round(score, 6) AS score FROM ranked WHERE rank <= 10", ("ranked",))
def hybrid_rrf(spark, sf):
    return scored(fuse.rrf(lists_of(spark, sf), limit=10))


@query("SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, id) AS rank FROM (SELECT query_id, id, sum(CASE list_name WHEN 'bm25' THEN 1.4::DOUBLE ELSE 0.6::DOUBLE END / (60 + rank)) AS score, min(list_pos * 1000 + rank) AS first FROM two_lists GROUP BY query_id, id)) WHERE rank <= 10", ("two_lists",))
def hybrid_rrf_weighted(spark, sf):
    return scored(fuse.rrf(lists_of(spark, sf), limit=10, weight=fuse.static_weight({"bm25": 1.4, "vector": 0.6})))


SHAPE_SQL = r"""CASE WHEN regexp_matches(lower({q}), '\b\d{{1,3}}(?:\.\d{{1,3}}){{3}}\b|\b\d{{4,5}}\b|\b\d{{4}}\.\d+\.\d+\b|\b[A-Za-z]+[-_]\d+[A-Za-z0-9-]*\b') OR list_has_any(regexp_extract_all(lower({q}), '[\p{{L}}\p{{N}}_@]+'), ['ip', 'порт', 'port', 'версия', 'version', 'uuid', 'api']) THEN 'exact_token'
 WHEN list_has_any(regexp_extract_all(lower({q}), '[\p{{L}}\p{{N}}_@]+'), ['кто', 'who', 'telegram', 'handle', 'username', 'contact', 'контакт']) OR regexp_matches(lower({q}), '@[\p{{L}}\p{{N}}_]+') THEN 'person'
 WHEN list_has_any(regexp_extract_all(lower({q}), '[\p{{L}}\p{{N}}_@]+'), ['когда', 'when', 'дата', 'date', 'вчера', 'yesterday', 'сегодня', 'today', 'завтра', 'tomorrow']) THEN 'temporal' ELSE 'general' END"""
#: Queries of all shapes: a few words in front of the plain ones.
LEADS = ["", "when ", "who ", "port "]
PARTS["qs"] = (["q"], "SELECT query_id, ['', 'when ', 'who ', 'port '][query_id % 4 + 1] || text AS text FROM q")
PARTS["shapes"] = (["qs"], f"SELECT query_id, {SHAPE_SQL.format(q='text')} AS shape FROM qs")


def led_queries(spark, sf) -> DataFrame:
    return text_queries(spark, sf).withColumn("text", F.concat(F.element_at(F.array([F.lit(x) for x in LEADS]), (F.col("query_id") % 4 + 1).cast("int")), "text"))


@query("SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, id) AS rank FROM (SELECT query_id, id, sum(CASE WHEN shape = 'exact_token' AND list_name = 'bm25' THEN 1.4::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)) AS score, min(list_pos * 1000 + rank) AS first FROM two_lists JOIN shapes USING (query_id) GROUP BY query_id, id)) WHERE rank <= 10", ("two_lists", "shapes"))
def adaptive_weight_rrf(spark, sf):
    ranked = lists_of(spark, sf).join(led_queries(spark, sf).withColumnRenamed("text", "q"), "query_id")
    return scored(fuse.rrf(ranked, limit=10, weight=fuse.adaptive_weight("q")))


@query("SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, id) AS rank FROM (SELECT query_id // 4 AS query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((query_id % 4) * 1000 + rank) AS first FROM ranked WHERE rank <= 10 GROUP BY query_id // 4, id)) WHERE rank <= 10", ("ranked",))
def multi_query_rrf(spark, sf):
    """Four queries are variants of one."""
    once = fuse.rrf(lists_of(spark, sf), limit=10)
    variants = once.select(F.floor(F.col("query_id") / 4).alias("query_id"), (F.col("query_id") % 4).alias("variant"), "rank", "id")
    return scored(fuse.expand(variants, limit=10))


@query("SELECT query_id, id, array_to_string(list(list_name ORDER BY list_pos), ',') AS sources, round(max(CASE WHEN list_name = 'vector' THEN score END), 6) AS raw_vector_score, min(rank) FILTER (WHERE list_pos = m) AS rank FROM (SELECT *, min(list_pos) OVER (PARTITION BY query_id, id) AS m FROM two_lists) GROUP BY query_id, id", ("two_lists",))
def source_merge(spark, sf):
    out = fuse.merge_sources(lists_of(spark, sf), ["rank"])
    return out.select("query_id", "id", F.array_join("sources", ",").alias("sources"), F.round("raw_vector_score", 6).alias("raw_vector_score"), "rank")


@query("SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT query_id, rank, id, score FROM ranked WHERE rank <= 10 UNION ALL SELECT query_id, last + place, id, floor * pow(0.999, place) FROM (SELECT d.query_id, d.id, row_number() OVER (PARTITION BY d.query_id ORDER BY d.rank, d.id) AS place, floor, last FROM dense d JOIN (SELECT query_id, min(score) AS floor, max(rank) AS last FROM ranked WHERE rank <= 10 GROUP BY query_id) f ON d.query_id = f.query_id WHERE d.rank <= 8 AND NOT EXISTS (SELECT 1 FROM ranked r WHERE r.query_id = d.query_id AND r.id = d.id AND r.rank <= 10)))", ("ranked", "dense"))
def vector_floor(spark, sf):
    return scored(fuse.vector_floor(fuse.rrf(lists_of(spark, sf), limit=10), dense_of(spark, sf), 8))


@query("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, id, round(score, 6) AS score FROM (SELECT query_id, id, CASE WHEN own IS NOT NULL THEN greatest(own, coalesce(other, own)) ELSE least(0.5 * other, coalesce(least_ - 0.01, 0.5 * other)) END AS score FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.score AS own, b.score AS other FROM bm25 a FULL JOIN dense b ON a.query_id = b.query_id AND a.id = b.id) LEFT JOIN (SELECT query_id, min(score) AS least_ FROM bm25 GROUP BY query_id) USING (query_id))", ("bm25", "dense"))
def fallback_merge(spark, sf):
    return scored(fuse.fallback_merge(bm25_of(spark, sf), dense_of(spark, sf)))


@query("SELECT query_id, rank, id, tokens, used FROM (SELECT query_id, rank, id, tokens, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM (SELECT query_id, rank, id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, CAST(round_even(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 4 + (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) / 2, 0) AS BIGINT)) END AS tokens FROM hits)) WHERE used <= 2000", ("hits",))
def token_budget_prefix(spark, sf):
    return fuse.token_budget(hits_of(spark, sf), 2000, text.estimate_tokens("text")).select("query_id", "rank", "id", "tokens", "used")


# --- predicates ---------------------------------------------------------------


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 7")
def payload_filter_exact(spark, sf):
    e = read(spark, sf, "events")
    return e.where(filters.payload_filter({"event_type": "click", "user_id": 7}, e.schema)).select("event_id")


@query("SELECT event_id FROM events WHERE value >= 10 AND value <= 20 AND event_type = 'view'")
def payload_filter_range(spark, sf):
    e = read(spark, sf, "events")
    return e.where(filters.payload_filter({"value": {"gte": 10.0, "lte": 20.0}, "event_type": "view"}, e.schema)).select("event_id")


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x >= 0.3)) > 0")
def array_any_match(spark, sf):
    e = read(spark, sf, "embeddings")
    return e.where(filters.payload_filter({"embedding": {"gte": 0.3}}, e.schema)).select("vec_id")


@query("SELECT id FROM chunks WHERE invalidated_at IS NULL", ("chunks",))
def hide_invalidated(spark, sf):
    return filters.validity(chunks_of(spark, sf)).select("id")


@query("SELECT id FROM chunks WHERE valid_from <= TIMESTAMP '2024-01-20 00:00:00' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-20 00:00:00')", ("chunks",))
def as_of_validity(spark, sf):
    return filters.validity(chunks_of(spark, sf), as_of=AS_OF).select("id")


@query("SELECT id, lang FROM chunks WHERE tenant_id = 3", ("chunks",))
def tenant_scope(spark, sf):
    return filters.tenant_scope(chunks_of(spark, sf), 3).select("id", "lang")


@query("SELECT query_id, id FROM two_lists GROUP BY query_id, id HAVING bool_or(list_name = 'bm25')", ("two_lists",))
def source_family_filter(spark, sf):
    return fuse.rrf(lists_of(spark, sf)).where(filters.source_family(["bm25"])).select("query_id", "id")


@query("SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), vec) AS score FROM embeddings JOIN chunks ON vec_id = id CROSS JOIN qv WHERE vec_id <> query_id AND ts >= TIMESTAMP '2024-01-01 06:00:00' AND ts <= TIMESTAMP '2024-01-02 12:00:00')) WHERE rank <= 20", ("chunks", "qv"))
def temporal_window_recall(spark, sf):
    """The query's window (1 January noon on) is cut by the caller's (until 2 January noon)."""
    low, high, _ = filters.intersect_window(F.lit("2024-01-01 06:00:00").cast("timestamp"), F.lit("2024-01-05 00:00:00").cast("timestamp"), lte=F.lit("2024-01-02 12:00:00").cast("timestamp"))
    scope = retrieve.in_window(chunks_of(spark, sf), low, high).select("id")
    return scored(retrieve.vector(vectors_of(spark, sf).join(scope, "id", "left_semi"), queries_of(spark, sf), K, exclude_self=True))


@query("SELECT id, row_number() OVER (ORDER BY CAST(ts AS DATE) <> DATE '2024-01-02', abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-02 12:00:00')), id) AS rank FROM chunks QUALIFY rank <= 25", ("chunks",))
def date_focused_sort(spark, sf):
    return retrieve.date_focused(chunks_of(spark, sf), "2024-01-02", 25).select("id", "rank")


@query(
    "SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT query_id, rank, id, score FROM asked JOIN (SELECT target, id, 1 / (1 + away / 86400) AS score, row_number() OVER (PARTITION BY target ORDER BY CAST(ts AS DATE) <> target, away, id) AS rank FROM (SELECT target, id, ts, abs(epoch_us(ts) - epoch_us(CAST(target AS TIMESTAMP) + INTERVAL 12 HOUR)) / 1e6 AS away FROM chunks JOIN (SELECT DISTINCT target FROM asked WHERE focused) ON CAST(ts AS DATE) BETWEEN target - 1 AND target + 1)) USING (target) WHERE focused AND rank <= 10 UNION ALL SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, id, score FROM (SELECT query_id, id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), vec) AS score FROM asked JOIN chunks ON CAST(ts AS DATE) BETWEEN target - 1 AND target + 1 JOIN embeddings ON vec_id = id WHERE NOT focused) QUALIFY rank <= 10)",
    ("chunks", "asked"),
)
def temporal_arm(spark, sf):
    """Even queries ask for a day and nothing else, odd ones for a topic of that day."""
    said = F.concat(F.when(F.col("query_id") % 2 == 0, "what happened on 2024-01-0").otherwise("report on 2024-01-0"), F.col("query_id") % 5 + 1)
    return scored(retrieve.temporal(chunks_of(spark, sf), vectors_of(spark, sf), queries_of(spark, sf).where("vec IS NOT NULL").withColumn("text", said), NOW, 10))


@query()
def temporal_expressions(spark, sf):
    """Windows that the users' turns speak of."""
    turns = read(spark, sf, "conversations")
    asked = F.concat(F.element_at(F.array([F.lit(x) for x in ("yesterday ", "late april 2026 ", "on 2024-01-05 ", "3 weeks ago ", "")]), (F.col("turn") % 5 + 1).cast("int")), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", times.temporal_window(asked, NOW).alias("w")).select("conv_id", "turn", "w.*")


# --- query classes ------------------------------------------------------------

MARKER_SQL = "CASE " + " ".join(f"WHEN list_has_any(toks, [{', '.join(repr(w) for w in words)}]) THEN '{name}'" for name, words in text.QUERY_MARKERS.items()) + " ELSE 'general' END"
TURNS = r"SELECT conv_id, turn, ['', 'who is ', 'how do i fix ', 'when was ', 'why '][turn % 5 + 1] || coalesce(text, '') AS text FROM conversations"


def led_turns(spark, sf, leads=("", "who is ", "how do i fix ", "when was ", "why ")) -> DataFrame:
    lead = F.element_at(F.array([F.lit(x) for x in leads]), (F.col("turn") % len(leads) + 1).cast("int"))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.concat(lead, F.coalesce("text", F.lit(""))).alias("text"))


@query(rf"SELECT conv_id, turn, {MARKER_SQL} AS query_type FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS toks FROM ({TURNS}))")
def classify_query(spark, sf):
    return led_turns(spark, sf).select("conv_id", "turn", text.classify_query("text").alias("query_type"))


QUESTION_LEADS = ("how many ", "what are ", "which year did ", "would ", "which books ", "what did a and b both ", "what is fictional ", "")
QUESTION_SQL = "CASE WHEN t = '' THEN 'general' WHEN regexp_matches(t, '{}') AND regexp_matches(t, '{}') THEN 'adversarial' ".format(text.NEVER_MENTIONED, text.QUESTION_WORD) + " ".join(
    "WHEN regexp_matches(t, '{}') THEN '{}'".format((r"\bmight\b([^'’]|$)" if p == r"\bmight\b" else p).replace("'", "''"), name) for name, p in text.QUESTION_RULES
) + " ELSE 'general' END"


@query(
    f"SELECT conv_id, turn, {QUESTION_SQL} AS category FROM (SELECT conv_id, turn, regexp_replace(lower(trim([{', '.join(repr(x) for x in QUESTION_LEADS)}][turn % 8 + 1] || coalesce(text, ''))), '\\s+', ' ', 'g') AS t FROM conversations)"
)
def classify_question(spark, sf):
    lead = F.element_at(F.array([F.lit(x) for x in QUESTION_LEADS]), (F.col("turn") % len(QUESTION_LEADS) + 1).cast("int"))
    asked = read(spark, sf, "conversations").select("conv_id", "turn", F.concat(lead, F.coalesce("text", F.lit(""))).alias("text"))
    return asked.select("conv_id", "turn", text.classify_question("text").alias("category"))


@query("SELECT query_id, shape FROM shapes", ("shapes",))
def query_shape(spark, sf):
    return led_queries(spark, sf).select("query_id", text.query_shape("text").alias("shape"))


@query(r"SELECT doc_id AS id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, CAST(round_even(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 4 + (length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) / 2, 0) AS BIGINT)) END AS tokens FROM documents")
def estimate_tokens(spark, sf):
    return docs_of(spark, sf).select("id", text.estimate_tokens("text").alias("tokens"))


# --- stages -------------------------------------------------------------------

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
KEYS_SQL = rf"list_filter(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 2 AND NOT list_contains({STOP_SQL}, t))"
GRAVITY_SQL = f"CASE WHEN len({KEYS_SQL}) > 0 AND score > 0.1 AND len(list_filter({KEYS_SQL}, lambda t: contains(lower(coalesce(text, '')), t))) = 0 THEN score * 0.5 ELSE score END"
DAYS_SQL = "(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 86400000000.0::DOUBLE"
FRESH_SQL = f"((1 - 0.2) * score + 0.2 * exp(-ln(2) * greatest({DAYS_SQL}, 0) / 14) * CASE WHEN {DAYS_SQL} * 1440 < 10 THEN 0.5 ELSE 1.0 END) * greatest(0.1, exp(-0.693 * greatest({DAYS_SQL}, 0) / (30 * (1 + 0.2 * least(greatest(access_count, 0), 10)))))"
EXACT_SQL = r"(regexp_matches(lower(query), '\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{4,5}\b|\b\d{4}\.\d+\.\d+\b|\b[a-z]+[-_]?\d+[a-z0-9-]*\b') OR list_has_any(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+'), ['ip', 'порт', 'port', 'версия', 'version', 'id', 'uuid', 'токен', 'api']))"
PARTS["led"] = (["hits", "qs"], "SELECT h.* REPLACE (qs.text AS query) FROM hits h JOIN qs USING (query_id)")
PARTS["rescued"] = (["led"], rf"SELECT * REPLACE (score + CASE WHEN {EXACT_SQL} AND source = 'src1' AND regexp_matches(text, '\b\d{{4,5}}\b|\b\d{{1,3}}(?:\.\d{{1,3}}){{3}}\b|\b\d{{4}}\.\d+') THEN 0.5 ELSE 0.0 END AS score) FROM led")
PARTS["pulled"] = (["led"], f"SELECT * REPLACE ({GRAVITY_SQL} AS score) FROM led")
PARTS["recalled"] = ([], "SELECT user_id AS id, count(*) AS n_all, count(*) FILTER (WHERE epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts) < 24 * 3600000000) AS n_day FROM events GROUP BY user_id")


def staged(sql_score: str, source: str = "led") -> str:
    return f"SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank, id) AS rank FROM (SELECT query_id, id, rank, {sql_score} AS score FROM {source}))"


def led_hits(spark, sf) -> DataFrame:
    return hits_of(spark, sf).drop("query").join(led_queries(spark, sf).withColumnRenamed("text", "query"), "query_id")


@query(staged("score", "rescued"), ("rescued",))
def stage_exact_rescue(spark, sf):
    hits = led_hits(spark, sf).withColumn("source", F.when(F.col("source") == "src1", "src1/").otherwise(F.col("source")))
    return scored(rank.apply(hits, [rank.exact_rescue(("src1/",))]))


@query(staged(GRAVITY_SQL), ("led",))
def stage_gravity(spark, sf):
    return scored(rank.apply(led_hits(spark, sf), [rank.gravity()]))


PARTS["limits"] = (["degree"], "SELECT list_sort(list(degree))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] AS p90, max(degree) AS top FROM degree")


@query(staged("score * CASE WHEN degree > p90 THEN greatest(0.4, 1 - 0.6 * (degree - p90) / greatest(top - p90, 1)) ELSE 1.0 END", "(SELECT led.*, coalesce(degree, 0) AS degree, p90, top FROM led LEFT JOIN degree ON degree.id = 's' || led.id CROSS JOIN limits)"), ("led", "degree", "limits"))
def stage_hub(spark, sf):
    degrees = graph.degrees(supplies_of(spark, sf)).withColumn("id", F.col("id"))
    hits = led_hits(spark, sf).withColumn("number", F.col("id")).withColumn("id", F.concat(F.lit("s"), F.col("id")))
    p90_top = rank.hub(degrees)(hits)
    return scored(rank.apply(p90_top.drop("id").withColumnRenamed("number", "id"), []))


@query(staged(FRESH_SQL), ("led",))
def stage_freshness(spark, sf):
    return scored(rank.apply(led_hits(spark, sf), [rank.freshness(NOW)]))


@query(staged("score * (1 - least(0.15, 0.03 * coalesce(n_day, 0)))", "(SELECT led.*, n_day FROM led LEFT JOIN recalled ON led.id = recalled.id)"), ("led", "recalled"))
def stage_ior(spark, sf):
    return scored(rank.apply(led_hits(spark, sf), [rank.inhibition(recall_events(spark, sf).select("id", "ts"), "2024-01-15 00:00:00")]))


@query(staged(f"score + CASE WHEN coalesce(n_all, 0) > 2 THEN 0.0 WHEN floor({DAYS_SQL}) >= 7 THEN 0.05 ELSE 0.0 END", "(SELECT led.*, n_all FROM led LEFT JOIN recalled ON led.id = recalled.id)"), ("led", "recalled"))
def stage_curiosity(spark, sf):
    return scored(rank.apply(led_hits(spark, sf), [rank.curiosity(recall_events(spark, sf).select("id", "ts"), NOW)]))


PARTS["q_small"] = (["q_table"], "SELECT ['bm25', 'vector', 'error', 'purchase', 'view'][list_position(['click', 'error', 'purchase', 'signup', 'view'], source)] AS source, CASE query_type WHEN '0' THEN 'general' WHEN '1' THEN 'event' ELSE 'person' END AS query_type, q, n % 13 AS n FROM q_table")
PARTS["q_value"] = (["q_small"], "SELECT source, query_type, q + CASE WHEN n >= 10 THEN 0 WHEN n = 0 THEN 0.1 ELSE 0.1 * sqrt(ln(greatest(sum(n) OVER (PARTITION BY query_type), 1)) / n) END AS value FROM q_small")
TYPE_SQL = "(SELECT led.*, " + MARKER_SQL.replace("toks", r"regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')") + " AS qt FROM led)"


@query(
    staged(
        "0.8 * score + 0.2 * ((CASE WHEN lexical THEN coalesce(a.value, 0.6) ELSE 0 END + CASE WHEN dense THEN coalesce(b.value, 0.6) ELSE 0 END) / (CAST(lexical AS INT) + CAST(dense AS INT)))",
        f"{TYPE_SQL} t LEFT JOIN q_value a ON a.source = 'bm25' AND a.query_type = t.qt LEFT JOIN q_value b ON b.source = 'vector' AND b.query_type = t.qt",
    ),
    ("led", "q_value"),
)
def stage_qlearning(spark, sf):
    names = F.create_map([F.lit(x) for pair in zip(("click", "error", "purchase", "signup", "view"), ("bm25", "vector", "error", "purchase", "view"), strict=True) for x in pair])
    table = state.q_fold(feedback_of(spark, sf), ["source", "query_type"], ["ts", "event_id"])
    table = table.select(names[F.col("source")].alias("source"), F.when(F.col("query_type") == "0", "general").when(F.col("query_type") == "1", "event").otherwise("person").alias("query_type"), "q", (F.col("n") % 13).alias("n"))
    return scored(rank.apply(led_hits(spark, sf), [rank.classify(), rank.q_learning(table)]))


@query(staged("CASE WHEN query_id % 4 = 3 AND coalesce(raw, 0) >= 0.2 AND dense THEN greatest(score, 0.25) ELSE score END"), ("led",))
def stage_protection(spark, sf):
    hits = led_hits(spark, sf).withColumn("query", F.when(F.col("query_id") % 4 == 3, F.concat(F.lit("where is snake_case_name "), "query")).otherwise(F.lit("plain words")))
    return scored(rank.apply(hits, [rank.protection(gate=0.2)]))


PARTS["stateless_1"] = (["led"], f"SELECT query_id, id, rank, text, query, ts, access_count, raw, dense, {GRAVITY_SQL} AS score FROM led")


@query(staged(FRESH_SQL, "stateless_1"), ("stateless_1",))
def pipeline_stateless(spark, sf):
    return scored(rank.apply(led_hits(spark, sf), rank.stateless(NOW)))


PARTS["full_1"] = (
    ["led", "recalled"],
    f"SELECT query_id, id, rank, query, ts, access_count, n_day, score + CASE WHEN coalesce(n_all, 0) > 2 THEN 0.0 WHEN floor({DAYS_SQL}) >= 7 THEN 0.05 ELSE 0.0 END AS score FROM (SELECT led.* REPLACE ({GRAVITY_SQL} AS score), n_all, n_day_31 AS n_day FROM led LEFT JOIN (SELECT r.*, (SELECT count(*) FROM events e WHERE e.user_id = r.id AND epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(e.ts) < 24 * 3600000000) AS n_day_31 FROM recalled r) r ON led.id = r.id)",
)


@query(staged("score * (1 - least(0.15, 0.03 * coalesce(n_day, 0)))", f"(SELECT query_id, id, rank, n_day, {FRESH_SQL} AS score FROM full_1)"), ("full_1",))
def pipeline_full(spark, sf):
    return scored(rank.apply(led_hits(spark, sf), rank.full(NOW, events=recall_events(spark, sf).select("id", "ts"))))


@query(f"SELECT id, round(greatest(0.1, exp(-0.693 * greatest({DAYS_SQL}, 0) / (30 * (1 + 0.2 * least(greatest(access_count, 0), 10))))), 6) AS decay FROM chunks", ("chunks",))
def confidence_decay(spark, sf):
    return chunks_of(spark, sf).select("id", F.round(scoring.decay(F.col("last_accessed"), F.col("access_count"), F.lit(NOW)), 6).alias("decay"))


# --- state --------------------------------------------------------------------


@query("SELECT source, query_type, round(q, 9) AS q, n FROM q_table", ("q_table",))
def q_table_fold(spark, sf):
    return state.q_fold(feedback_of(spark, sf), ["source", "query_type"], ["ts", "event_id"]).select("source", "query_type", F.round("q", 9).alias("q"), "n")


@query("SELECT user_id AS id, count(*) AS n FROM events WHERE epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts) < 24 * 3600000000 GROUP BY user_id")
def ior_counts(spark, sf):
    return rank.recall_counts(recall_events(spark, sf), "2024-01-15 00:00:00")


@query("SELECT event_id, tenant_id, age FROM (SELECT event_id, user_id % 5 AS tenant_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 500")
def ior_keep_last(spark, sf):
    return state.keep_last(recall_events(spark, sf)).select("event_id", "tenant_id", "age")


@query("SELECT p90, top FROM limits", ("limits",))
def hub_degrees_p90(spark, sf):
    p90, top = rank.hub_limits(tables.written(graph.degrees(supplies_of(spark, sf))))
    return spark.createDataFrame([(p90, top)], "p90 long, top long")


@query(
    "WITH RECURSIVE e AS (SELECT user_id % 5 AS tenant_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS i FROM events), b AS (SELECT tenant_id, event_id, t, i, 19.0::DOUBLE AS tokens, true AS allowed FROM e WHERE i = 1 "
    "UNION ALL SELECT tenant_id, event_id, t, i, CASE WHEN filled >= 1 THEN filled - 1 ELSE filled END, filled >= 1 FROM (SELECT e.tenant_id, e.event_id, e.t, e.i, least(20.0::DOUBLE, b.tokens + (e.t - b.t) / 1e6::DOUBLE * 0.01::DOUBLE) AS filled FROM b JOIN e ON e.tenant_id = b.tenant_id AND e.i = b.i + 1)) SELECT tenant_id, event_id, allowed FROM b"
)
def token_bucket(spark, sf):
    return state.token_bucket(recall_events(spark, sf), rate=0.01, capacity=20.0)


# --- chunks -------------------------------------------------------------------


@query(r"SELECT id, CAST(o AS BIGINT) AS off, substr(text, o + 1, 800) AS chunk FROM (SELECT doc_id AS id, text, unnest(range(0, length(text), 700)) AS o FROM documents) WHERE regexp_matches(substr(text, o + 1, 800), '\S')")
def char_chunks(spark, sf):
    return chunk.char_chunks(docs_of(spark, sf)).select("id", F.col("offset").alias("off"), "chunk")


@query()
def paragraph_chunks(spark, sf):
    d = docs_of(spark, sf).withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return chunk.paragraph_chunks(d).select("id", "offset", "chunk")


@query()
def markdown_chunks(spark, sf):
    d = docs_of(spark, sf).withColumn("text", F.concat(F.lit("# "), F.regexp_replace("text", "\n", "\n\n## ")))
    return chunk.markdown_chunks(d).select("id", "offset", "chunk", F.array_join("heading_path", " > ").alias("heading"))


@query()
def code_chunks(spark, sf):
    d = docs_of(spark, sf).withColumn("text", F.concat(F.lit("def first():\n    "), F.regexp_replace("text", "\n", "\n\ndef next_one():\n    "))).withColumn("language", F.lit("python"))
    return chunk.code_chunks(d, "language").select("id", "offset", "chunk", "symbol")


MESSAGES = "(SELECT conv_id, turn, coalesce(text, '') AS text, CAST(coalesce(sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nt, lead(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations)"


@query(f"SELECT conv_id, off, text, turn AS middle, CAST(1 AS BIGINT) AS size FROM {MESSAGES} UNION ALL SELECT conv_id, off, text || chr(10) || nx, nt, 2 FROM {MESSAGES} WHERE nt IS NOT NULL")
def message_pairs(spark, sf):
    out = chunk.message_chunks(read(spark, sf, "conversations"), "conv_id", "turn")
    return out.select("conv_id", F.col("offset").alias("off"), "text", "middle", F.col("window").cast("long").alias("size"))


@query("SELECT conv_id, a || chr(10) || b || chr(10) || c AS text, t1 AS middle, t0 AS chunk_start, t2 AS chunk_end FROM (SELECT conv_id, turn AS t0, coalesce(text, '') AS a, lead(turn) OVER w AS t1, lead(coalesce(text, '')) OVER w AS b, lead(turn, 2) OVER w AS t2, lead(coalesce(text, ''), 2) OVER w AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE t2 IS NOT NULL")
def sliding_windows(spark, sf):
    return chunk.windows(read(spark, sf, "conversations"), 3, "conv_id", "turn")


# --- identity -----------------------------------------------------------------


@query("SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS chunk_id FROM (SELECT doc_id AS id, sha256(source || '|0|' || text) AS h FROM documents)")
def stable_ids(spark, sf):
    return docs_of(spark, sf).select("id", ids.stable_id(F.col("source"), F.lit(0), F.col("text")).alias("chunk_id"))


@query("SELECT doc_id AS id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf):
    return docs_of(spark, sf).select("id", ids.content_hash(F.col("text")).alias("hash"))


# --- lifecycle ----------------------------------------------------------------


@query("SELECT id, lang, CAST(tenant_id AS BIGINT) AS tenant_id FROM (SELECT id, lang, tenant_id FROM own WHERE id % 3 <> 0 UNION ALL SELECT c.id, 'xx', o.tenant_id FROM chunks c LEFT JOIN own o ON c.id = o.id WHERE c.id % 3 = 0)", ("own",))
def upsert_latest(spark, sf):
    c = chunks_of(spark, sf).select("id", "lang", "ts", F.col("tenant_id").cast("long").alias("tenant_id"))
    new = c.where("id % 3 = 0").withColumn("tenant_id", F.lit(None).cast("long"))
    fresh = new.unionByName(new.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")).withColumn("lang", F.lit("xx")))
    return lifecycle.upsert(c.where("id % 2 = 0"), fresh, order=["ts"]).select("id", "lang", "tenant_id")


@query("SELECT doc_id AS id, CASE WHEN upper(text) <> text AND doc_id % 5 = 0 THEN CASE WHEN doc_id % 10 = 0 THEN 'text' ELSE 'text' END ELSE '' END AS changed, CASE WHEN doc_id % 11 = 0 AND source IS NOT NULL THEN 'source' ELSE '' END AS removed FROM documents WHERE (upper(text) <> text AND doc_id % 5 = 0) OR (doc_id % 11 = 0 AND source IS NOT NULL)")
def payload_diff(spark, sf):
    d = docs_of(spark, sf).select("id", "text", "source", "lang")
    new = d.withColumn("text", F.when(F.col("id") % 5 == 0, F.upper("text")).otherwise(F.col("text"))).withColumn("source", F.when(F.col("id") % 11 != 0, F.col("source")))
    out = lifecycle.payload_diff(d, new, ["text", "source", "lang"])
    return out.select("id", F.array_join("changed", ",").alias("changed"), F.array_join("removed", ",").alias("removed"))


@query("SELECT doc_id AS id FROM documents d WHERE doc_id % 7 = 0 AND source <> 'src0' AND source IN (SELECT source FROM documents WHERE doc_id % 7 <> 0)")
def prune_stale(spark, sf):
    d = docs_of(spark, sf).select("id", "source")
    return lifecycle.stale(d, d.where("id % 7 <> 0"), spark.createDataFrame([("src0",)], "source string")).select("id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def skip_known(spark, sf):
    return lifecycle.skip_known(docs_of(spark, sf).where("id % 3 = 0").select("id"), vectors_of(spark, sf))


@query("SELECT id, id % 2 = 0 AND tenant_id = 1 OR id % 7 = 0 AS invalid FROM chunks", ("chunks",))
def invalidate_rows(spark, sf):
    c = chunks_of(spark, sf)
    out = lifecycle.invalidate(c, c.where("id % 2 = 0").select("id"), F.lit(NOW).cast("timestamp"), tenant=1)
    return out.select("id", F.col("invalidated_at").isNotNull().alias("invalid"))


@query("SELECT id, tenant_id FROM chunks WHERE tenant_id <> 2 AND id % 9 = 0", ("chunks",))
def ownership_conflicts(spark, sf):
    c = chunks_of(spark, sf)
    return lifecycle.ownership_conflicts(c, c.where("id % 9 = 0").select("id"), 2)


@query("SELECT tenant_id, count(*) FILTER (WHERE id % 3 <> 0) AS points, count(*) FILTER (WHERE id % 3 = 0) AS added, count(*) <= 150 AS allowed FROM chunks GROUP BY tenant_id", ("chunks",))
def quota_check(spark, sf):
    c = chunks_of(spark, sf).select("id", "tenant_id")
    return lifecycle.quota(c.where("id % 3 <> 0"), c, 150).select("tenant_id", "points", "added", "allowed")


@query("SELECT tenant_id, count(*) AS n FROM chunks GROUP BY tenant_id", ("chunks",))
def tenant_facets(spark, sf):
    return metrics.counters(chunks_of(spark, sf), ["tenant_id"])


@query("SELECT count(*) AS points, count(*) FILTER (WHERE tenant_id = 1) AS own, count(invalidated_at) AS invalidated FROM chunks", ("chunks",))
def overview_counts(spark, sf):
    return chunks_of(spark, sf).agg(F.count("*").alias("points"), F.count_if(F.col("tenant_id") == 1).alias("own"), F.count("invalidated_at").alias("invalidated"))


@query("SELECT count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def coverage_gap(spark, sf):
    return index.coverage_gap(docs_of(spark, sf), vectors_of(spark, sf))


# --- graph --------------------------------------------------------------------


@query("SELECT src, rel, dst FROM facts WHERE valid_from <= TIMESTAMP '1996-06-01 00:00:00' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1996-06-01 00:00:00')", ("facts",))
def triples_as_of(spark, sf):
    return graph.triples(facts_of(spark, sf), rel="PLACED", as_of="1996-06-01 00:00:00").select("src", "rel", "dst")


@query("SELECT DISTINCT src, rel, dst FROM supplies WHERE src IN (SELECT 's' || s_suppkey FROM supplier)", ("supplies",))
def neighbors(spark, sf):
    """Of all suppliers."""
    nodes = read(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return graph.neighbors(supplies_of(spark, sf), nodes)


@query(r"SELECT query_id, name, hits, rank FROM (SELECT query_id, name, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, name) AS rank FROM (SELECT query_id, name, count(DISTINCT token) AS hits FROM (SELECT t.query_id, t.token, p.p_name AS name FROM (SELECT p_partkey AS query_id, unnest(string_split(lower(p_name), ' ')) AS token FROM part WHERE p_partkey % 50 = 0) t JOIN part p ON lower(p.p_name) = t.token OR (length(t.token) >= 5 AND contains(lower(p.p_name), t.token) AND NOT EXISTS (SELECT 1 FROM part x WHERE lower(x.p_name) = t.token))) GROUP BY query_id, name)) WHERE rank <= 10")
def graph_token_hits(spark, sf):
    part = read(spark, sf, "part")
    tokens = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.explode(F.split(F.lower("p_name"), " ")).alias("token")).distinct()
    return retrieve.graph_hits(part.select(F.col("p_name").alias("name")).distinct(), tokens).select("query_id", "name", "hits", "rank")


PARTS["regional"] = ([], "SELECT lower(n_name) AS src, replace(lower(r_name), ' ', '_') AS dst FROM nation JOIN region ON n_regionkey = r_regionkey")


@query(
    "SELECT query_id, name, round(score, 6) AS score, rank FROM (SELECT query_id, name, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, name) AS rank FROM (SELECT query_id, dst AS name, least(0.30, 0.10 + 0.15 * count(DISTINCT seed) / max(n)) AS score FROM (SELECT q.query_id, q.n, q.seed, e.dst, row_number() OVER (PARTITION BY q.query_id, q.seed ORDER BY e.dst) AS k FROM (SELECT n_nationkey AS query_id, lower(n_name) AS seed, CAST(2 AS BIGINT) AS n FROM nation UNION ALL SELECT n_nationkey, replace(lower(r_name), ' ', '_'), 2 FROM nation JOIN region ON n_regionkey = r_regionkey) q JOIN (SELECT src, dst FROM regional UNION SELECT dst, src FROM regional) e ON e.src = q.seed) WHERE k <= 5 GROUP BY query_id, dst) WHERE NOT contains('<nation_' || query_id || '>', name)) WHERE rank <= 3",
    ("regional",),
)
def graph_resurrection(spark, sf):
    """Queries name a nation and its region; results already speak of the nation."""
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    both = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    edges = both.select(F.lower("n_name").alias("src"), F.regexp_replace(F.lower("r_name"), " ", "_").alias("dst"))
    nodes = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    asked = both.select(F.col("n_nationkey").alias("query_id"), F.concat_ws(" ", "n_name", F.regexp_replace("r_name", " ", "_")).alias("text"))
    said = n.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("<"), F.lower("n_name"), F.lit(">")).alias("text"))
    return graph.resurrect(asked, nodes, edges, said).select("query_id", "name", F.round("score", 6).alias("score"), "rank")


@query("SELECT src, rel, dst FROM supplies WHERE lower(dst) IN (SELECT 'p' || p_partkey FROM part)", ("supplies",))
def dangling_referrers(spark, sf):
    """To all parts."""
    names = read(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"))
    return graph.referrers(supplies_of(spark, sf), names).select("src", "rel", "dst")


@query(
    r"SELECT source, target, coalesce(f.path, g.path, target) AS resolved, f.path IS NOT NULL OR g.path IS NOT NULL AS is_resolved FROM (SELECT 'docs/' || lower(n_name) || '.md' AS source, CASE n_nationkey % 3 WHEN 0 THEN 'NATION_' || (n_nationkey + 1) || '.md' WHEN 1 THEN '../other/nation_' || n_nationkey || '.md' ELSE 'missing_' || n_nationkey || '.md' END AS target, n_nationkey AS k FROM nation) l LEFT JOIN (SELECT 'docs/' || lower(n_name) || '.md' AS path FROM nation) f ON l.k % 3 = 0 AND f.path = 'docs/' || lower(target) LEFT JOIN (SELECT 'docs/' || lower(n_name) || '.md' AS path, lower(n_name) AS name FROM nation) g ON g.name = lower(regexp_extract(target, '([^/]+?)(?:\.[^./]*)?$', 1))"
)
def link_resolution(spark, sf):
    n = read(spark, sf, "nation")
    files = n.select(F.concat(F.lit("docs/"), F.lower("n_name"), F.lit(".md")).alias("path"))
    k = F.col("n_nationkey")
    target = F.when(k % 3 == 0, F.concat(F.lit("NATION_"), k + 1, F.lit(".md"))).when(k % 3 == 1, F.concat(F.lit("../other/nation_"), k, F.lit(".md"))).otherwise(F.concat(F.lit("missing_"), k, F.lit(".md")))
    return graph.resolve_links(n.select(F.concat(F.lit("docs/"), F.lower("n_name"), F.lit(".md")).alias("source"), target.alias("target")), files)


# --- synthesis and citations --------------------------------------------------


def facts_for_synthesis(spark, sf) -> DataFrame:
    c = chunks_of(spark, sf)
    return c.select(F.col("source").alias("entity"), F.col("id").alias("fact_id"), "text", "ts", (F.col("n_chars") % 100).cast("double").alias("relevance"))


@query("SELECT entity, fact_id FROM (SELECT source AS entity, id AS fact_id, row_number() OVER (PARTITION BY source, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') ORDER BY n_chars % 100 DESC, id) AS k FROM chunks WHERE trim(text) <> '') WHERE k = 1", ("chunks",))
def exact_facts(spark, sf):
    return synthesis.exact_facts(facts_for_synthesis(spark, sf)).select("entity", "fact_id")


@query()
def near_dup_facts(spark, sf):
    return synthesis.near_facts(facts_for_synthesis(spark, sf)).select("entity", "fact_id", "place")


@query("SELECT source AS entity, id AS fact_id, row_number() OVER (PARTITION BY source ORDER BY ts, id) AS place FROM chunks", ("chunks",))
def timeline(spark, sf):
    return synthesis.timeline(facts_for_synthesis(spark, sf)).select("entity", "fact_id", "place")


@query(
    rf"SELECT entity, fact_id, coalesce(upper(substr(w, 1, 1)) || substr(w, 2), 'General') AS subtopic FROM (SELECT source AS entity, id AS fact_id FROM chunks) LEFT JOIN (SELECT id AS fact_id, arg_max(w, n * 1000000 - first) AS w FROM (SELECT id, w, count(*) AS n, min(pos) AS first FROM (SELECT id, source, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM (SELECT id, source, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_@-]+') AS toks FROM chunks)) WHERE NOT list_contains({STOP_SQL}, w) AND w <> source GROUP BY id, w) GROUP BY id) USING (fact_id)",
    ("chunks",),
)
def subtopics(spark, sf):
    return synthesis.subtopics(facts_for_synthesis(spark, sf)).select("entity", "fact_id", "subtopic")


@query()
def entity_synthesis(spark, sf):
    facts = synthesis.subtopics(synthesis.near_facts(facts_for_synthesis(spark, sf)))
    return facts.groupBy("entity", "subtopic").agg(F.count("*").alias("facts"), F.max("relevance").alias("relevance"), F.min("ts").cast("string").alias("first"))


@query(
    r"SELECT id, o AS off, CASE WHEN id % 4 = 3 THEN 'missing' WHEN substr(now, o + 1, length(f)) = f THEN CASE WHEN id % 4 = 0 OR now = text THEN 'intact' ELSE 'source_changed' END WHEN contains(now, f) THEN 'moved' ELSE 'changed' END AS verdict FROM (SELECT *, substr(text, o + 1, 800) AS f FROM (SELECT doc_id AS id, text, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'x' || text WHEN 2 THEN reverse(text) END AS now, unnest(range(0, length(text), 700)) AS o FROM documents)) WHERE regexp_matches(f, '\S')"
)
def citation_verdicts(spark, sf):
    """Every window of every text is cited; the source then is the same, moved by a character, reversed or gone."""
    d = docs_of(spark, sf)
    cited = chunk.char_chunks(d).select("id", F.col("chunk").alias("text"), "offset", F.sha2("text", 256).alias("snapshot"))
    k = F.col("id") % 4
    current = d.where(k < 3).select("id", F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("x"), "text")).otherwise(F.reverse("text")).alias("content"))
    return provenance.verdicts(cited, current, "id").select("id", F.col("offset").alias("off"), "verdict")


@query("SELECT conv_id, turn, text FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM conversations)")
def strip_metadata(spark, sf):
    """Envelopes are put around every third turn first, and must be gone."""
    t = F.coalesce("text", F.lit(""))
    wrapped = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('Sender (untrusted metadata):\n```json\n{"a": 1}\n```\n'), t)).when(F.col("turn") % 3 == 1, F.concat(F.lit("<system-reminder>x\ny</system-reminder>\n"), t)).otherwise(t)
    return read(spark, sf, "conversations").select("conv_id", "turn", text.strip_metadata(wrapped).alias("text"))


@query("SELECT conv_id, turn, turn % 4 = 0 AS poll FROM conversations")
def heartbeat_filter(spark, sf):
    k = F.col("turn") % 4
    said = F.when(k == 0, F.lit("HEARTBEAT_OK fine")).when(k == 1, F.concat(F.lit("HEARTBEAT_OK "), F.repeat(F.lit("long body "), 20))).when(k == 2, F.lit("we spoke of HEARTBEAT_OK")).otherwise(F.col("text"))
    return read(spark, sf, "conversations").select("conv_id", "turn", text.is_heartbeat(said).alias("poll"))


PARTS["last_turn"] = ([], "SELECT conv_id, arg_max(coalesce(text, ''), turn) AS text FROM conversations GROUP BY conv_id")
PARTS["asked_words"] = (["last_turn"], r"SELECT conv_id, unnest(w) AS needle, generate_subscripts(w, 1) - 1 AS place FROM (SELECT conv_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM last_turn)")
PARTS["claimed"] = (
    ["asked_words"],
    r"SELECT m.conv_id, m.turn, min(place) AS item FROM (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS needle FROM conversations) m JOIN asked_words a ON m.conv_id = a.conv_id AND m.needle = a.needle GROUP BY m.conv_id, m.turn",
)


@query(
    "SELECT conv_id, place, source FROM (SELECT conv_id, source, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS place FROM (SELECT m.conv_id, m.role || m.turn // 2 AS source, min({'t': coalesce(k, 1073741824), 'i': coalesce(item, -1), 'r': m.turn}) AS first FROM conversations m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id, item ORDER BY turn) AS k FROM claimed) c ON m.conv_id = c.conv_id AND m.turn = c.turn GROUP BY m.conv_id, m.role || m.turn // 2)) WHERE place <= 5",
    ("claimed",),
)
def item_sources(spark, sf):
    """The words of each conversation's last turn, looked for in all its turns; which turns are named, word by word in rounds."""
    c = read(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max_by(F.coalesce("text", F.lit("")), "turn").alias("text"))
    items = last.select(F.col("conv_id").alias("query_id"), F.posexplode(F.regexp_extract_all("text", F.lit(attribute.WORD), F.lit(0))).alias("place", "item"))
    memories = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text", F.concat("role", F.floor(F.col("turn") / 2).cast("string")).alias("source"))
    return attribute.attribute(items, memories).select(F.col("query_id").alias("conv_id"), "place", "source")


PARTS["note_ids"] = ([], "SELECT source, source || '/' || doc_id AS id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE source IS NOT NULL")
PARTS["note_names"] = (["note_ids"], "SELECT DISTINCT source, CASE doc_id % 5 WHEN 0 THEN id WHEN 1 THEN id || ':45' WHEN 2 THEN substr(id, 1, length(id) - 1) WHEN 3 THEN 'R' || (rank - 1) ELSE 'x' || id END AS name FROM note_ids")


@query(
    "SELECT n.source, n.name, i.id FROM note_names n JOIN note_ids i ON n.source = i.source AND (n.name = 'R' || (i.rank - 1) OR starts_with(n.name, i.id) OR starts_with(i.id, n.name)) QUALIFY row_number() OVER (PARTITION BY n.source, n.name ORDER BY CASE WHEN n.name = 'R' || (i.rank - 1) THEN 0 WHEN n.name = i.id THEN 1 ELSE 2 END, length(i.id) DESC, i.rank) = 1",
    ("note_names",),
)
def resolved_ids(spark, sf):
    """Ids of all documents as a model may write them: whole, with an ending, cut short, by ordinal, or wrong."""
    d = read(spark, sf, "documents").where("source IS NOT NULL").select(F.col("source").alias("query_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("id"), "doc_id")
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    k = F.col("doc_id") % 5
    name = F.when(k == 0, F.col("id")).when(k == 1, F.concat("id", F.lit(":45"))).when(k == 2, F.substring("id", F.lit(1), F.length("id") - 1)).when(k == 3, F.concat(F.lit("R"), (F.col("rank") - 1).cast("string"))).otherwise(F.concat(F.lit("x"), "id"))
    named = d.select("query_id", F.lit(0).alias("pos"), name.alias("name")).distinct()
    return prefixes.resolve(named, d).select(F.col("query_id").alias("source"), "name", "id")


@query(
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || CASE event_id % 4 WHEN 0 THEN '' ELSE '+00:00' END AS canonical, event_id % 4 <> 3 AS same, 'es1:' || substr(sha256('{\"dimension\":' || user_id || ',\"document_transform\":{\"prefix\":\"p\"},\"extras\":{\"a\":\"' || event_type || '\",\"b\":\"2\"},\"model\":\"m\",\"provider\":\"hf\"}'), 1, 32) AS space FROM (SELECT event_id, user_id, event_type, CAST(ts AS TIMESTAMP) AS ts FROM events)"
)
def canonical_values(spark, sf):
    """Times of all events in four spellings, payloads in two orders of keys (every fourth changed), and fingerprints of spaces."""
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))
    k = F.col("event_id") % 4
    spelled = lambda c: F.regexp_replace(F.regexp_replace(c.cast("string"), r"\.(\d{1,2}|\d{4,5})$", ".$1"), " ", "T")
    whole = lambda c: F.concat(F.substring_index(spelled(c), ".", 1), F.when(F.contains(spelled(c), F.lit(".")), F.concat(F.lit("."), F.rpad(F.substring_index(spelled(c), ".", -1), 6, "0"))).otherwise(""))
    hours = F.make_dt_interval(hours=F.lit(2), mins=F.lit(30))
    text_ = F.when(k == 0, F.replace(whole(F.col("ts")), F.lit("T"), F.lit(" "))).when(k == 1, F.concat(whole(F.col("ts")), F.lit("Z"))).when(k == 2, F.concat(whole(F.col("ts") + hours), F.lit("+02:30"))).otherwise(F.concat(whole(F.col("ts") - hours), F.lit("-02:30")))
    other = F.when(k == 0, whole(F.col("ts"))).otherwise(F.concat(whole(F.col("ts")), F.lit("+00:00")))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    one = F.concat(F.lit('{"at": '), quoted(text_), F.lit(', "list": [1, {"z": 1, "a": '), quoted(F.col("event_type")), F.lit("}]}"))
    two = F.concat(F.lit('{"list": [1, {"a": '), quoted(F.col("event_type")), F.lit(', "z": '), F.when(k == 3, "2").otherwise("1"), F.lit('}], "at": '), quoted(other), F.lit("}"))
    extras = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.col("event_type"))
    space = canonical.fingerprint(F.lit("HF"), F.lit("M"), F.col("user_id"), F.create_map(F.lit("prefix"), F.lit("p")), extras)
    return e.select("event_id", canonical.instant(text_).alias("canonical"), canonical.same(one, two).alias("same"), space.alias("space"))


PARTS["sold"] = ([], "SELECT l_suppkey, l_partkey, CAST(l_shipdate AS TIMESTAMP) AS shipped FROM lineitem GROUP BY ALL")


@query(
    "SELECT src, dst, valid_from, lead(valid_from) OVER (PARTITION BY src ORDER BY valid_from, fresh, dst) AS valid_until FROM (SELECT *, fresh AND lag(dst) OVER (PARTITION BY src ORDER BY valid_from, fresh, dst) = dst AS again FROM (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, shipped AS valid_from, l_partkey % 3 <> 0 AS fresh FROM sold)) WHERE NOT coalesce(again, false)",
    ("sold",),
)
def superseded_facts(spark, sf):
    """What each supplier shipped last: a third of the parts are stored, the others come as facts, some of them between."""
    li = read(spark, sf, "lineitem").select("l_suppkey", "l_partkey", F.col("l_shipdate").cast("timestamp").alias("valid_from")).distinct()
    edges = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.lit("SHIPS").alias("rel"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), "valid_from", (F.col("l_partkey") % 3 == 0).alias("stored"))
    old = edges.where("stored").drop("stored").withColumn("valid_until", F.lit(None).cast("timestamp"))
    return graph.supersede(old, edges.where("NOT stored").drop("stored")).select("src", "dst", "valid_from", "valid_until")


@query(
    "SELECT tenant_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(user_id % 5 AS VARCHAR) AS tenant_id, 1 AS n FROM events UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 1 FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 0 FROM supplier) GROUP BY tenant_id"
)
def tenant_listing(spark, sf):
    """Tenants of events and customers, and suppliers as tenants that are only configured."""
    data = [read(spark, sf, "events").select((F.col("user_id") % 5).alias("tenant_id")), read(spark, sf, "customer").select(F.col("c_nationkey").alias("tenant_id"))]
    return graph.tenants(data, read(spark, sf, "supplier").select(F.col("s_suppkey").alias("tenant_id")))


@query(
    "SELECT doc_id AS id, upper(CASE WHEN regexp_matches(clean, '^\\p{L}') THEN replace(clean, 'ß', 'SS') ELSE '_' || replace(clean, 'ß', 'SS') END) AS relation, CASE WHEN regexp_matches(clean, '^\\p{L}') THEN clean ELSE 'Node' END AS label, 'graph:' || url_encode(part) || ':' || source AS graph_id, 'q_table:' || url_encode(part) AS state_key, sha256(length(part) || ':' || part || '|' || length(source) || ':' || source) AS cache_key FROM (SELECT doc_id, source, part, regexp_replace(part, '[^\\p{L}\\p{N}_]', '_', 'g') AS clean FROM (SELECT doc_id, coalesce(source, '') AS source, substr(coalesce(text, ''), 1 + CAST(doc_id % 50 AS INT), 30) AS part FROM documents))".replace("\\\\", "\\")
)
def safe_names(spark, sf):
    """Pieces of all documents as relations, labels, tenants and cache keys."""
    part = F.substring(F.coalesce("text", F.lit("")), (F.col("doc_id") % 50 + 1).cast("int"), F.lit(30))
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("source"), part.alias("part"))
    p, s = F.col("part"), F.col("source")
    return d.select("id", names.relation(p).alias("relation"), names.label(p).alias("label"), names.graph_id(s, p).alias("graph_id"), names.state_key(F.lit("q_table"), p).alias("state_key"), names.cache_key(p, F.array(s)).alias("cache_key"))


# --- folders --------------------------------------------------------------------

PARTS["note_a"] = ([], "SELECT doc_id, coalesce(lang, '') AS lang, source || '/' || doc_id || '.md' AS source, text FROM documents WHERE coalesce(lang, '') <> 'de'")
PARTS["note_b"] = ([], "SELECT doc_id, coalesce(lang, '') AS lang, source || '/' || doc_id || '.md' AS source, CASE WHEN lang = 'fr' THEN text || chr(10) || 'changed' ELSE text END AS text FROM documents WHERE coalesce(lang, '') <> 'es'")
for _side in "ab":
    PARTS[f"cut_{_side}"] = ([f"note_{_side}"], rf"SELECT source, length(text) AS size, o, substr(text, o + 1, 800) AS chunk FROM (SELECT *, unnest(range(0, length(text), 700)) AS o FROM note_{_side}) WHERE regexp_matches(substr(text, o + 1, 800), '\S')")


@query(
    "SELECT s.source, action, coalesce(inserted, 0) AS inserted, coalesce(refreshed, 0) AS refreshed, coalesce(pruned, 0) AS pruned, 0::BIGINT AS failed, 0::BIGINT AS conflicts, CASE WHEN action <> 'remove' AND prior IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS edges FROM (SELECT source, doc_id, CASE lang WHEN 'de' THEN 'add' WHEN 'fr' THEN 'change' END AS action FROM note_b WHERE lang IN ('de', 'fr') UNION ALL SELECT source, doc_id, 'remove' FROM note_a WHERE lang = 'es') s "
    "LEFT JOIN (SELECT coalesce(a.source, b.source) AS source, count(*) FILTER (WHERE a.source IS NULL) AS inserted, count(*) FILTER (WHERE b.source IS NULL) AS pruned, count(*) FILTER (WHERE a.size <> b.size) AS refreshed FROM cut_a a FULL JOIN cut_b b ON a.source = b.source AND a.o = b.o AND a.chunk = b.chunk GROUP BY ALL) c ON c.source = s.source LEFT JOIN (SELECT doc_id AS prior FROM note_b) n ON n.prior = s.doc_id - 1",
    ("cut_a", "cut_b"),
)
def folder_sync(spark, sf):
    """A folder of all documents goes from one state to another: de notes come, es ones go, fr ones change; each names the note before it."""
    d = read(spark, sf, "documents").withColumn("kind", F.coalesce("lang", F.lit(""))).select("kind", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), "text")
    after = d.where("kind <> 'es'").withColumn("text", F.when(F.col("kind") == "fr", F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text")))
    named = lambda f: f.select("source", (F.regexp_extract("source", r"(\d+)\.md$", 1).cast("long") - 1).cast("string").alias("target"))
    sized = lambda f: chunk.char_chunks(f).select("source", "offset", F.col("chunk").alias("text"), F.create_map(F.lit("size"), F.length("text").cast("string")).alias("payload"))
    notes = Store(spark, f"{tables.working_folder(spark)}/notes", buckets=8)
    each = [folder.sync(notes, f.select("source", "text"), plugins.hashing_embedder(8), chunks=sized, links=named) for f in (d.where("kind <> 'de'"), after)]
    return each[1]


# --- metrics ------------------------------------------------------------------


@query(
    "SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0.0 END), 6) AS recall_20, round(avg(1.0::DOUBLE / rank), 6) AS mrr_found, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr_all, count(*) AS probes FROM q LEFT JOIN (SELECT query_id, min(rank) AS rank FROM bm25 JOIN documents d ON d.doc_id = bm25.id JOIN benchmark b ON b.item_id = bm25.query_id WHERE contains(d.text, b.text) GROUP BY query_id) USING (query_id)",
    ("q", "bm25"),
)
def retrieval_metrics(spark, sf):
    """How well BM25 finds documents that hold a query's passage."""
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    hits = bm25_of(spark, sf).join(docs_of(spark, sf).select("id", "text"), "id").join(b, "query_id").where(F.contains("text", "passage"))
    probes = text_queries(spark, sf).join(hits.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")
    out = metrics.retrieval(probes)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns if c != "probes"], "probes")


@query("SELECT CAST(toxic AS VARCHAR) AS category, count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_correct, round(avg(quality), 6) AS accuracy FROM labels GROUP BY ROLLUP (CAST(toxic AS VARCHAR))")
def qa_accuracy_rollup(spark, sf):
    answers = read(spark, sf, "labels").select(F.col("toxic").cast("string").alias("category"), F.col("quality").alias("correct"))
    return metrics.accuracy(answers).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, list_sort(list(value))[CAST(round_even(0.5 * (count(*) - 1), 0) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(round_even(0.9 * (count(*) - 1), 0) AS BIGINT) + 1] AS p90, list_sort(list(value))[CAST(round_even(0.99 * (count(*) - 1), 0) AS BIGINT) + 1] AS p99 FROM events GROUP BY event_type")
def latency_quantiles(spark, sf):
    return metrics.nearest_rank(read(spark, sf, "events"), ["event_type"], "value").withColumn("total", F.round("total", 4))


# --- streaming ----------------------------------------------------------------


def _stream(spark, sf, keep: list[str]) -> DataFrame:
    """events as a file stream; a link in a folder of its own, since a stream reads folders."""
    schema = read(spark, sf, "events").schema
    folder = f"{sf}/events.parquet"
    return spark.readStream.schema(schema).option("pathGlobFilter", "*events*.parquet" if not _is_folder(spark, folder) else "*.parquet").parquet(sf if not _is_folder(spark, folder) else folder).select(*keep).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def _is_folder(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _ran(df: DataFrame, name: str, mode: str) -> DataFrame:
    return streams.run_available(df, f"{name}_{next(tempfile._get_candidate_names())}", mode)


@query("SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT event_id) AS BIGINT) AS n_ids FROM events")
def stream_dedupe(spark, sf):
    e = streams.dedupe(_stream(spark, sf, ["event_id", "ts"]), ["event_id"])
    return _ran(e, "dedupe", "append").agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("n_ids"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    out = streams.tumbling(_stream(spark, sf, ["ts", "event_type", "value"]), "1 hour", ["event_type"], "value")
    return _ran(out, "tumbling", "complete").select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT epoch_us(s) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1, 2")
def stream_sliding(spark, sf):
    out = streams.sliding(_stream(spark, sf, ["ts", "event_type", "value"]), "1 hour", "30 minutes", ["event_type"], "value")
    return _ran(out, "sliding", "complete").select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


SESSION_SQL = "(SELECT user_id, ts, event_type, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= {gap} THEN 1 ELSE 0 END AS fresh FROM events))"


@query(f"SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM {SESSION_SQL.format(gap=3 * 3600 * 10**6)} GROUP BY user_id, s")
def stream_session(spark, sf):
    out = streams.sessions(_stream(spark, sf, ["ts", "user_id"]), "3 hours", ["user_id"])
    return _ran(out, "session", "complete").select("user_id", F.unix_micros("start").alias("start"), "n")


@query(f"SELECT user_id AS path, epoch_us(min(ts)) AS start, arg_max(event_type, ts) AS kind, count(*) AS n FROM {SESSION_SQL.format(gap=3600 * 10**6)} GROUP BY user_id, s")
def stream_debounce(spark, sf):
    e = _stream(spark, sf, ["ts", "user_id", "event_type"]).select("ts", F.col("user_id").alias("path"), F.col("event_type").alias("kind"))
    return _ran(streams.debounce(e, "1 hour"), "debounce", "complete").select("path", F.unix_micros("start").alias("start"), "kind", "n")


@query("SELECT source, query_type, round(q, 6) AS q, n FROM q_table", ("q_table",))
def stream_state_fold(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    fb = _stream(spark, sf, ["event_id", "ts", "event_type", "props", "value"]).select("event_id", "ts", F.col("event_type").alias("source"), (k % 3).cast("string").alias("query_type"), F.least(F.lit(1.0), F.col("value") / 100).alias("reward"))
    out = _ran(streams.q_state(fb), "fold", "update")
    return out.groupBy("source", "query_type").agg(F.round(F.max_by("q", "n"), 6).alias("q"), F.max("n").alias("n"))


# --- plans --------------------------------------------------------------------


@query()
def recall_flow(spark, sf):
    """All together: scope, two arms, adaptive weights, floor, stages, budget."""
    chunks = chunks_of(spark, sf)
    config = plan.RecallConfig(adaptive=True, vector_floor=3, stages=rank.stateless(NOW), token_budget=4000, tenant=None)
    return scored(plan.recall(chunks, vectors_of(spark, sf), queries_of(spark, sf), config))


@query(
    r"SELECT query_id, string_agg('[' || rank || '] (' || coalesce(source, '?') || ') ' || CASE WHEN length(flat) <= 100 THEN flat ELSE rtrim(substr(flat, 1, 99), ' ') || '…' END, chr(10) ORDER BY rank) AS context FROM (SELECT query_id, rank, source, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS flat FROM hits WHERE rank <= 15) GROUP BY query_id",
    ("hits",),
)
def prompt_context(spark, sf):
    return plan.context_lines(hits_of(spark, sf))
