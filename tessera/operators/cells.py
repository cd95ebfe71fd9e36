"""A stored vector index that is exact and reads only what it must.

Vectors are dealt to cells: by their nearest pivot, then by rings of distance from it, so that a pivot with many vectors has
many cells. A cell's folder, size and nearest and farthest distance are recorded. By the triangle inequality, no vector of a cell is nearer to a
query than the query's distance from the pivot leaves room for. A search first reads the cells that seem best until it
has k vectors for each query, and then those cells only that could hold a nearer one.

Distances are between unit vectors, so their order is that of the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieve import ROW_STEP, top_k

#: Pivots at most, taken from the table by hash; the width of a ring; query vectors that are sent to tasks at once.
PIVOTS, RING, QUERIES = 256, 0.1, 1024

#: More than rounding can move a distance or a score that is ranked at nine decimals.
SLACK = 1e-4


@dataclass
class Searched:
    """What a search read: cells and vectors of how many, and (query, vector) pairs compared."""

    cells: int = 0
    of_cells: int = 0
    vectors: int = 0
    of_vectors: int = 0
    pairs: int = 0


def _unit(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def build(vectors: DataFrame, path: str, pivots: int = PIVOTS) -> None:
    """Writes the index of vectors (id, embedding). Rows without id or vector, of length zero or with parts that are no finite numbers are left out, as no cosine has them.

    All vectors must have one dimension; others raise. At most ``PIVOTS`` pivots are held by the driver.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = vectors.select("id", "embedding").where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))
    sizes = usable.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} dimensions")
    count = min(pivots, PIVOTS)
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(count).collect()
    centres = np.unique(_unit(np.array([r.embedding for r in chosen], np.float64)), axis=0) if chosen else np.empty((0, 0))
    shared = spark.sparkContext.broadcast(centres)
    kind = usable.schema["id"].dataType.simpleString()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ROW_STEP):
                part = pdf.iloc[at : at + ROW_STEP]
                far = _distances(_unit(np.stack(part["embedding"].to_numpy()).astype(np.float64)), shared.value)
                nearest = far.argmin(1)
                away = far[np.arange(len(part)), nearest]
                yield pd.DataFrame({"id": part["id"], "embedding": part["embedding"], "away": away, "cell": nearest.astype(np.int64) * 32 + (away / RING).astype(np.int64)})

    element = usable.schema["embedding"].dataType.simpleString()
    dealt = usable.mapInPandas(deal, f"id {kind}, embedding {element}, away double, cell long")
    if chosen:
        dealt.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    else:
        dealt.write.parquet(f"{path}/vectors")
    spark.read.schema(f"id {kind}, embedding {element}, away double, cell long").parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).coalesce(1).write.parquet(f"{path}/cells")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "pivot int, centre array<double>").coalesce(1).write.parquet(f"{path}/pivots")
    shared.destroy()


def _compare(stored: DataFrame, wanted: dict[int, np.ndarray], ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool, kinds: tuple[str, str], held: list) -> DataFrame:
    """(query_id, id, score): each task's best k of each query among the cells that are read for it."""
    spark = stored.sparkSession
    shared = spark.sparkContext.broadcast((wanted, ids, q))
    held.append(shared)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        wanted, ids, q = shared.value
        norms = np.linalg.norm(q, axis=1)
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for cell, part in pdf.groupby("cell", sort=False):
                mine = wanted[cell]
                for at in range(0, len(part), ROW_STEP):
                    rows = part.iloc[at : at + ROW_STEP]
                    x, own = np.stack(rows["embedding"].to_numpy()).astype(np.float64), rows["id"].to_numpy(object)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        scores = (x @ q[mine].T) / (np.linalg.norm(x, axis=1)[:, None] * norms[mine][None, :])
                    if exclude_self:
                        scores[own[:, None] == ids[mine][None, :]] = -np.inf
                    for j, query in enumerate(mine):
                        old_ids, old = kept.get(query, (np.empty(0, object), np.empty(0)))
                        new = np.flatnonzero(np.isfinite(scores[:, j]))
                        all_ids, all_ = np.concatenate([old_ids, own[new]]), np.concatenate([old, scores[new, j]])
                        by_id = np.argsort(all_ids, kind="stable")
                        order = by_id[np.argsort(-np.round(all_[by_id], 9), kind="stable")][:k]
                        kept[query] = all_ids[order], all_[order]
        for query, (own, scores) in kept.items():
            yield pd.DataFrame({"query_id": np.repeat(ids[query : query + 1], len(own)), "id": own, "score": scores})

    cells = sorted(wanted)
    read = stored.where(F.col("cell").isin(cells)).select("id", "embedding", "cell")
    return read.mapInPandas(best, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, exclude_self: bool = False, told: Searched | None = None) -> DataFrame:
    """query_id, rank, id, score: exact cosine top-k, as by comparing all. queries: query_id, vec; those without a usable vector have no result.

    Query vectors go in blocks of ``QUERIES``; a block's distances to all cells are held by the driver, at most ``QUERIES`` x 32 x ``PIVOTS`` numbers.
    """
    stored = spark.read.parquet(f"{path}/vectors").withColumn("cell", F.col("cell").cast("long"))
    kinds = queries.schema["query_id"].dataType.simpleString(), stored.schema["id"].dataType.simpleString()
    cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda c: c.cell)
    centres = np.array([r.centre for r in sorted(spark.read.parquet(f"{path}/pivots").collect(), key=lambda r: r.pivot)], np.float64)
    none = spark.createDataFrame([], f"query_id {kinds[0]}, rank long, id {kinds[1]}, score double")
    if not cells:
        return none
    names = np.array([c.cell for c in cells])
    number, low, high = (np.array([c[f] for c in cells], np.float64) for f in ("n", "low", "high"))
    told = Searched() if told is None else told
    told.of_cells, told.of_vectors = len(cells), int(number.sum())
    seen: set[int] = set()
    need, out = k + 1 if exclude_self else k, None
    usable = queries.select("query_id", "vec").where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)).orderBy("query_id")
    for block in _blocks(usable):
        ids = np.array([r.query_id for r in block], object)
        q = np.array([r.vec for r in block], np.float64)
        if q.shape[1] != centres.shape[1]:
            raise ValueError(f"queries of {q.shape[1]} dimensions, vectors of {centres.shape[1]}")
        away = _distances(_unit(q), centres)[:, names // 32]
        room = np.maximum(0.0, np.maximum(away - high, low - away)) - SLACK
        reach = away + high
        order = np.argsort(reach, axis=1, kind="stable")
        first = np.zeros(room.shape, bool)
        enough = np.cumsum(np.take_along_axis(np.broadcast_to(number, room.shape), order, 1), axis=1)
        took = np.concatenate([np.zeros((len(ids), 1)), enough[:, :-1]], axis=1) < need
        np.put_along_axis(first, order, took, axis=1)
        held: list = []
        near = _compare(stored, _by_cell(first, names), ids, q, k, exclude_self, kinds, held)
        ranked = top_k(near, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect()
        kth = {r.query_id: r.least for r in ranked if r.n == k}
        bound = np.array([np.sqrt(max(0.0, 2.0 - 2.0 * kth[i])) if i in kth else np.inf for i in ids.tolist()])
        both = first | (room <= bound[:, None] + SLACK)
        part = top_k(_compare(stored, _by_cell(both, names), ids, q, k, exclude_self, kinds, held), k)
        out = part if out is None else out.unionByName(part)
        seen |= set(np.flatnonzero(both.any(0)).tolist())
        told.pairs += int((both * number).sum())
    told.cells, told.vectors = len(seen), int(number[sorted(seen)].sum())
    return none if out is None else out


def _by_cell(chosen: np.ndarray, names: np.ndarray) -> dict[int, np.ndarray]:
    return {int(names[c]): np.flatnonzero(chosen[:, c]) for c in np.flatnonzero(chosen.any(0))}


def _blocks(rows: DataFrame) -> Iterator[list]:
    block: list = []
    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == QUERIES:
            yield block
            block = []
    if block:
        yield block
