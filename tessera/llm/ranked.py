"""Ranked lexical search by Fagin's threshold algorithm.

``forward_index`` writes, for each document, its terms and how often it holds each. The
index is read in shards of about ``SHARD`` entries. A shard's entries, sorted by term and falling impact, are
its lists; its rows are the forward index. A query reads its terms' lists in rounds, equally deep
in each; a document met for the first time is looked up in the forward index and scored
whole. The threshold is what a document could score that no list has shown yet, and the query is done with the
shard when that falls strictly below its k-th best score, which a task carries from shard to shard. What ties with
the k-th score is thus always read, so ties can go to the smaller id. Tasks send their k best,
which meet in two steps, so no query's candidates gather in one task.

Statistics (documents, terms, document frequencies) cover all documents. Queries go in blocks of at
most ``BLOCK`` and some ``BLOCK_TERMS`` terms, and only a block's terms with their weights are sent to
tasks. The index holds the queries' terms, or every term if they have more than ``MOST_TERMS``.

Defined cases: a null or empty text has no term and is not counted; null and empty queries match
nothing; equal rows are ranked singly, each query row by itself; a null id comes after all others
in ties; documents that score 0 are never returned; very long texts are read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_class, byte_slices, column, discard, give_back, materialize, words_of

#: A term is a run of ASCII letters and digits and of characters that are not ASCII.
TERM = byte_class(bytes(b for b in range(128) if not chr(b).isalnum()))
K = 50
BLOCK, BLOCK_TERMS, MOST_TERMS = 1024, 200_000, 1_000_000
SHARD = 1 << 20
FIRST_ROUND = 32

#: Groups in which the tasks' best documents of a query meet before they meet as one.
PARTS = 256


def _lists(places: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """Lists of a column's rows from values in order and the row of each."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(places, np.arange(rows + 1)).astype(np.int32)), values)


def forward_index(docs: DataFrame, terms: list[str] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, terms, tfs) of each document with a term: all its terms' number, and the terms asked for (None: all) with how often it holds them."""
    shared = None if terms is None else docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if shared is None else pa.array(shared.value, pa.large_string())
        for batch in byte_slices(batches, 1):
            words, text_, _ = words_of(batch.column(1), TERM)
            n = np.bincount(text_, minlength=batch.num_rows)
            coded = words.dictionary_encode()
            size, codes = max(1, len(coded.dictionary)), coded.indices.to_numpy()
            if asked is not None:
                wanted = pc.is_in(coded.dictionary, value_set=asked).to_numpy(zero_copy_only=False)
                there = np.flatnonzero(wanted[codes])
                text_, codes = text_[there], codes[there]
            entries, tf = np.unique(text_ * size + codes, return_counts=True)
            place, code = np.divmod(entries, size)
            names = coded.dictionary.take(pa.array(code)).cast(pa.string())
            rows = [batch.column(0), pa.array(n), _lists(place, batch.num_rows, names), _lists(place, batch.num_rows, pa.array(tf))]
            yield pa.RecordBatch.from_arrays(rows, ["id", "n", "terms", "tfs"]).filter(pa.array(n > 0))
        give_back()

    slim = docs.select(column(id_col).cast("long").alias("id"), column(text).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, n long, terms array<string>, tfs array<long>")


def _query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, terms): each item's distinct terms in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1):
            words, place, _ = words_of(batch.column(1), TERM)
            coded = words.dictionary_encode()
            size = max(1, len(coded.dictionary))
            row, code = np.divmod(np.unique(place * size + coded.indices.to_numpy()), size)
            terms = _lists(row, batch.num_rows, coded.dictionary.take(pa.array(code)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), terms], ["item", "terms"])

    slim = items.select(column(item_id).alias("item"), column(text).cast("string").alias("text"))
    return slim.mapInArrow(run, f"item {slim.schema['item'].dataType.simpleString()}, terms array<string>")


def _blocks(queries: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    block, terms = [], 0
    for row in queries.toLocalIterator():
        if block and (len(block) == BLOCK or terms + len(row.terms) > BLOCK_TERMS):
            yield block
            block, terms = [], 0
        block.append((row.item, row.terms))
        terms += len(row.terms)
    if block:
        yield block


class Shard:
    """Impact-sorted lists and forward rows of some documents, for the terms of a block."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: pa.Array, documents: int, length: int):
        lists, tfs = batch.column(2), batch.column(3).flatten().to_numpy().astype(np.int64)
        code = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy()
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
        held = np.flatnonzero(code >= 0)
        self.code, self.row, tf = code[held], row[held], tfs[held]
        m = 50 + (50 * batch.column(1).to_numpy() * documents) // length
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.row])
        self.rows = np.searchsorted(self.row, np.arange(batch.num_rows + 1))
        order = np.lexsort((-self.impact, self.code))
        self.list_row, self.list_impact = self.row[order], self.impact[order]
        self.lists = np.searchsorted(self.code[order], np.arange(len(vocabulary) + 1))
        self.met = np.zeros(batch.num_rows, bool)

    def look_up(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of documents from their forward rows; weights are by term, 0 for terms not asked."""
        sizes = self.rows[rows + 1] - self.rows[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.rows[rows] - (ends - sizes), sizes)
        return np.add.reduceat(weights[self.code[at]] * self.impact[at], ends - sizes)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of this shard's documents met before the threshold fell below the k-th best score, known ones included."""
        begin, end = self.lists[terms], self.lists[terms + 1]
        weight, scores = weights[terms], known
        found_rows, found_scores = [], []
        deep, step = 0, FIRST_ROUND
        while True:
            upto = np.minimum(begin + deep + step, end)
            sizes = np.maximum(upto - begin - deep, 0)
            read = np.arange(sizes.sum()) + np.repeat(begin + deep - np.cumsum(sizes) + sizes, sizes)
            rows = np.unique(self.list_row[read])
            rows = rows[~self.met[rows]]
            if len(rows):
                self.met[rows] = True
                found_rows.append(rows)
                found_scores.append(self.look_up(rows, weights))
                scores = np.concatenate([scores, found_scores[-1]])
                if len(scores) > k:
                    scores = np.partition(scores, len(scores) - k)[-k:]
            more = upto < end
            if not more.any():
                break
            threshold = int((weight[more] * self.list_impact[upto[more] - 1]).sum())
            if len(scores) == k and threshold < scores.min():
                break
            deep, step = deep + step, step * 2
        if not found_rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rows, scores = np.concatenate(found_rows), np.concatenate(found_scores)
        self.met[rows] = False
        return rows, scores


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())
        done, sent = 0, 0
        while done < batch.num_rows:
            upto = max(done + 1, int(np.searchsorted(ends, sent + SHARD, "right")))
            yield batch.slice(done, upto - done)
            done, sent = upto, int(ends[upto - 1])


def _first(score: np.ndarray, missing: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, missing, -score))[:k]
    return score[order], missing[order], ids[order]


def _block_best(index: DataFrame, queries: list[list[str]], weights: dict[str, int], documents: int, length: int, k: int) -> DataFrame:
    """(q, doc_id, score): each task's k best documents for each query of the block."""
    vocabulary = sorted(t for t, w in weights.items() if w > 0)
    place = {t: i for i, t in enumerate(vocabulary)}
    plan = [np.array([place[t] for t in terms if t in place], np.int64) for terms in queries]
    shared = index.sparkSession.sparkContext.broadcast((vocabulary, np.array([weights[t] for t in vocabulary], np.int64), plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight, plan = shared.value
        names = pa.array(vocabulary, pa.string())
        none = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        held = [none] * len(plan)
        own = np.zeros(len(vocabulary), np.int64)
        for batch in _shards(batches):
            shard = Shard(batch, names, documents, length)
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch.column(0), 0).to_numpy()
            for q, terms in enumerate(plan):
                if len(terms):
                    own[terms] = weight[terms]
                    rows, scores = shard.best(terms, own, k, held[q][0])
                    own[terms] = 0
                    good = scores > 0
                    rows, scores = rows[good], scores[good]
                    held[q] = _first(np.concatenate([held[q][0], scores]), np.concatenate([held[q][1], missing[rows]]), np.concatenate([held[q][2], ids[rows]]), k)
        score, missing, ids = (np.concatenate([h[i] for h in held]) for i in range(3)) if held else none
        q = np.repeat(np.arange(len(plan), dtype=np.int32), [len(h[0]) for h in held])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids, mask=missing), pa.array(score)], ["q", "doc_id", "score"])
        give_back()

    out = index.mapInArrow(run, "q int, doc_id long, score long")
    out._shared = shared
    return out


def search(index: DataFrame, items: DataFrame, k: int = K, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents of a written forward index that holds the items' terms."""
    return _search(index, materialize(_query_terms(items, item_id, text), "ranked-queries"), k)


def _search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark = index.sparkSession
    documents, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = materialize(index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "ranked-counts")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    kind = queries.schema["item"].dataType.simpleString()
    found = []
    for block in _blocks(queries):
        asked = spark.createDataFrame([(t,) for t in sorted({t for _, terms in block for t in terms})], "term string")
        known = counts.join(F.broadcast(asked), "term").collect()
        weights = {t: floor(1000 * log((2 * documents + 2) / (2 * df + 1))) for t, df in known}
        each = _block_best(index, [terms for _, terms in block], weights, documents, length, k)
        near = each.withColumn("part", F.spark_partition_id() % PARTS)
        for by in (["q", "part"], ["q"]):
            near = near.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], f"q int, item_id {kind}")
        found.append(materialize(near.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"), "ranked-found"))
        each._shared.destroy()
    discard(counts)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents, indexed for the terms of the items."""
    queries = materialize(_query_terms(items, item_id, item_text), "ranked-queries")
    terms = [t for (t,) in queries.select(F.explode("terms").alias("term")).distinct().limit(MOST_TERMS + 1).collect()]
    index = materialize(forward_index(docs, terms if len(terms) <= MOST_TERMS else None, id_col, text), "ranked-forward")
    return _search(index, queries, k)
