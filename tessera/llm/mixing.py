"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by membership
pattern, so what the driver sees grows with the number of patterns and not with
the corpus. A min-cost flow routes each pattern's words to the quotas of its
sources; a pattern can be used again, and every further pass costs more (a convex
cost), so words are repeated only where the quotas ask for it and evenly.

A pattern whose flow is ``k`` whole passes and ``r`` words gives every document
``k`` times and, once more, the documents at the head of a seeded order (a hash of id and
text) until ``r`` words are full. The head is found by sums over a radix of the order's
hash, so no task orders a whole pattern. One further document, the one whose size is
nearest to the words still missing, closes the gap; it is one of those that no other row
repeats. The driver plans over at most ``MOST_PATTERNS`` patterns and says so beyond.

Defined cases: a null text has no words; words are never cut, so a document is
taken 0, 1, .. ``max_repeats`` times; a document without words is taken 0 times;
null is a source of its own and sorts last; repeated rows are separate documents, and
which of them is taken makes no difference to the result; very long texts count whole;
other columns, whatever their names, are ignored by ``mix`` and kept by ``apply_mix``; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column, materialize, word_count

SEED = "mix-1"
MAX_REPEATS = 3
WEIGHTS = (5.0, 2.0, 1.0)
#: Documented limit: membership patterns that the driver plans over.
MOST_PATTERNS = 100_000


@dataclass
class _Arc:
    to: int
    room: int
    cost: int
    back: int


class FlowNetwork:
    """Successive cheapest augmenting paths over integer capacities."""

    def __init__(self, nodes: int):
        self.arcs: list[list[_Arc]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: int, cost: int) -> tuple[int, int]:
        self.arcs[a].append(_Arc(b, room, cost, len(self.arcs[b])))
        self.arcs[b].append(_Arc(a, 0, -cost, len(self.arcs[a]) - 1))
        return a, len(self.arcs[a]) - 1

    def used(self, handle: tuple[int, int]) -> int:
        arc = self.arcs[handle[0]][handle[1]]
        return self.arcs[arc.to][arc.back].room

    def run(self, start: int, end: int) -> int:
        total = 0
        while True:
            best: list[float] = [float("inf")] * len(self.arcs)
            via: list[tuple[int, int] | None] = [None] * len(self.arcs)
            best[start], queue, queued = 0, [start], {start}
            while queue:
                a = queue.pop(0)
                queued.discard(a)
                for i, arc in enumerate(self.arcs[a]):
                    if arc.room > 0 and best[a] + arc.cost < best[arc.to]:
                        best[arc.to], via[arc.to] = best[a] + arc.cost, (a, i)
                        if arc.to not in queued:
                            queued.add(arc.to)
                            queue.append(arc.to)
            if via[end] is None:
                return total
            path, at = [], end
            while at != start:
                path.append(via[at])
                at = via[at][0]
            step = min(self.arcs[a][i].room for a, i in path)
            for a, i in path:
                arc = self.arcs[a][i]
                arc.room -= step
                self.arcs[arc.to][arc.back].room += step
            total += step


def water_fill(sizes: dict, weights: dict, total: int, max_repeats: int = MAX_REPEATS) -> dict:
    """Shares of ``total`` by weight; none above ``max_repeats`` times its size, the excess reshared by weight."""
    order = sorted(sizes, key=lambda s: (max_repeats * sizes[s] / weights[s], str(s)))
    out, spent, left = {}, 0, sum(weights[s] for s in order)
    for i, s in enumerate(order):
        cap = max_repeats * sizes[s]
        level = (total - spent) / left
        if weights[s] * level < cap:
            for t in order[i:]:
                out[t] = weights[t] * level
            break
        out[s] = float(cap)
        spent, left = spent + cap, left - weights[s]
    return out


def _parts(patterns: list[tuple[tuple, int]]) -> list[list[int]]:
    """Patterns that share no source, even through others, apart; each part is a flow by itself."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for members, _ in patterns:
        for s in members[1:]:
            root[find(s)] = find(members[0])
    parts: dict = {}
    for i, (members, _) in enumerate(patterns):
        parts.setdefault(find(members[0]) if members else (), []).append(i)
    return list(parts.values())


def route(patterns: list[tuple[tuple, int]], targets: dict, max_repeats: int = MAX_REPEATS) -> list[int]:
    """Words taken from each pattern. patterns: (sources, words); pass r over a pattern costs r, r = 1, 2, .."""
    taken = [0] * len(patterns)
    for part in _parts(patterns):
        names = sorted({s for i in part for s in patterns[i][0]}, key=lambda s: (s is None, s or ""))
        place = {s: 2 + len(part) + i for i, s in enumerate(names)}
        net = FlowNetwork(2 + len(part) + len(names))
        passes: list[list[tuple[int, int]]] = []
        for node, i in enumerate(part, 2):
            members, words = patterns[i]
            passes.append([net.add(0, node, words, r) for r in range(1, max_repeats + 1)])
            for s in members:
                net.add(node, place[s], max_repeats * words, 0)
        for s in names:
            net.add(place[s], 1, int(targets[s] + 0.5), 0)
        net.run(0, 1)
        for i, hs in zip(part, passes, strict=True):
            taken[i] = sum(net.used(h) for h in hs)
    return taken


def default_weights(sources: list, cycle: tuple = WEIGHTS) -> dict:
    """Weights 5, 2, 1, repeating, for sources by code point, null last."""
    order = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(order)}


def _order(id_col: str, text: str, seed: str) -> Column:
    """The seeded order of documents; only rows equal in id and text share a place."""
    content = F.md5(F.coalesce(column(text).cast("string"), F.lit("")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column(id_col).cast("string"), F.lit("")), F.lit(":"), content))


def _quotas(sized: DataFrame, weights: dict | None, max_repeats: int) -> DataFrame | None:
    """sources, source_size, target, passes, rest: a row per pattern."""
    grouped = sized.groupBy("__sources").agg(F.sum("__size").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(grouped) > MOST_PATTERNS:
        raise ValueError(f"documents have more than {MOST_PATTERNS} patterns of sources; name coarser sources")
    patterns = [(tuple(r["__sources"]), r["words"]) for r in grouped]
    sizes: dict = {}
    for members, words in patterns:
        for s in members:
            sizes[s] = sizes.get(s, 0) + words
    if not sizes:
        return None
    targets = water_fill(sizes, weights or default_weights(list(sizes)), sum(w for _, w in patterns), max_repeats)
    flows = route(patterns, targets, max_repeats)
    return sized.sparkSession.createDataFrame(
        [(list(p), sizes[p[0]], float(targets[p[0]]), f // w if w else 0, f % w if w else 0) for (p, w), f in zip(patterns, flows, strict=True)],
        "__sources array<string>, __source_size long, __target double, __passes long, __rest long",
    )


def _cuts(sized: DataFrame, quotas: DataFrame) -> DataFrame:
    """sources, cut (the cell of the order where the head ends), words before it; windows span at most 256 and 4,096 cells."""
    cells = sized.groupBy("__sources", F.substring("__h", 1, 2).alias("hi"), F.substring("__h", 3, 3).alias("lo")).agg(F.sum("__size").alias("words"))
    upto = lambda part, order: F.coalesce(F.sum("words").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    his = cells.groupBy("__sources", "hi").agg(F.sum("words").alias("words")).withColumn("before", upto(["__sources"], "hi"))
    his = his.join(F.broadcast(quotas.select("__sources", "__rest")), "__sources").where("before < __rest AND before + words >= __rest").drop("words")
    los = cells.join(F.broadcast(his), ["__sources", "hi"])  # at most one row per pattern
    los = los.withColumn("before", F.col("before") + upto(["__sources", "hi"], "lo"))
    return los.where("before < __rest AND before + words >= __rest").select("__sources", F.concat("hi", "lo").alias("__cut"), F.col("before").alias("__before"))


def _headed(df: DataFrame, quotas: DataFrame, cuts: DataFrame) -> DataFrame:
    """df with its quota and __more: 1 for the head of the order. Only documents of a cut cell, a millionth, are moved."""
    placed = df.join(F.broadcast(quotas), "__sources").join(F.broadcast(cuts), "__sources", "left").withColumn("__cell", F.substring("__h", 1, 5))
    at_cut = F.coalesce(F.col("__cell") == F.col("__cut"), F.lit(False))
    whole = placed.where(~at_cut).withColumn("__more", F.coalesce((F.col("__cell") < F.col("__cut")).cast("int"), F.lit(0)))
    used = F.col("__before") + F.sum("__size").over(Window.partitionBy("__sources").orderBy("__h").rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.where(at_cut).withColumn("__more", (used <= F.col("__rest")).cast("int"))
    return whole.unionByName(edge).withColumn("__more", F.when(F.col("__rest") == 0, 0).otherwise(F.col("__more")))


def _fillers(headed: DataFrame) -> DataFrame:
    """sources, and the one document whose size is nearest to the words that the head leaves open."""
    gaps = materialize(headed.groupBy("__sources").agg((F.first("__rest") - F.sum(F.col("__more") * F.col("__size"))).alias("gap")), "mix-gaps")
    fits = headed.where("__more = 0 AND __size > 0").join(F.broadcast(gaps), "__sources").where("abs(__size - gap) < gap")
    miss = F.abs(F.col("__size") - F.col("gap")).alias("miss")
    nearest = lambda rows: rows.groupBy("__sources").agg(F.min(F.struct("miss", "__h")).alias("f")).select("__sources", F.col("f.__h").alias("__fill_h"))
    best = materialize(nearest(fits.select("__sources", miss, "__h")), "mix-fillers")
    same = (headed["__sources"] == best["__sources"]) & (headed["__h"] == best["__fill_h"])
    if headed.join(F.broadcast(best), same, "left_semi").groupBy("__sources", "__h").count().where("count > 1").isEmpty():
        return best
    single = fits.select("__sources", miss, "__h").groupBy("__sources", "__h").agg(F.min("miss").alias("miss"), F.count("*").alias("n")).where("n = 1")
    return materialize(nearest(single), "mix-fillers")


def _repeated(headed: DataFrame, fillers: DataFrame, empty: Column, max_repeats: int) -> DataFrame:
    """Adds __repeats."""
    filled = ((F.col("__more") == 0) & (F.col("__h") == F.col("__fill_h"))).cast("int")
    times = F.least(F.col("__passes") + F.col("__more") + F.coalesce(filled, F.lit(0)), F.lit(max_repeats))
    return headed.join(F.broadcast(fillers), "__sources", "left").withColumn("__repeats", F.when(empty, 0).otherwise(times).cast("int"))


def _decide(docs: DataFrame, members: Column, id_col: str, text: str, weights: dict | None, seed: str, max_repeats: int):
    """(sized documents, quotas, cuts, fillers); quotas is None for an empty table. All but the first have a row per pattern, ``MOST_PATTERNS`` at most."""
    sized = docs.select(column(id_col).alias("__id"), members.alias("__sources"), word_count(text).alias("__size"), _order(id_col, text, seed).alias("__h"))
    sized = materialize(sized, "mix-sizes")
    quotas = _quotas(sized, weights, max_repeats)
    if quotas is None:
        return sized, None, None, None
    cuts = materialize(_cuts(sized, quotas), "mix-cuts")
    return sized, quotas, cuts, _fillers(_headed(sized, quotas, cuts))


def mix(docs: DataFrame, members: Column, id_col: str = "doc_id", text: str = "text", weights: dict | None = None, seed: str = SEED, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: doc_id, sources, size, source_size, target, taken (words), repeats.

    ``members`` is an array of source names. source_size and target are those of
    the first source of the array.
    """
    sized, quotas, cuts, fillers = _decide(docs, members, id_col, text, weights, seed, max_repeats)
    names = (F.col("__id").alias("doc_id"), F.col("__sources").alias("sources"), F.col("__size").alias("size"))
    if quotas is None:
        return sized.select(*names, F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), F.lit(0).alias("repeats"))
    out = _repeated(_headed(sized, quotas, cuts), fillers, F.col("__size") == 0, max_repeats)
    taken = (F.col("__size") * F.col("__repeats")).cast("long")
    return out.select(*names, F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken"), F.col("__repeats").alias("repeats"))


def mix_sources(docs: DataFrame, source: str = "source", **options) -> DataFrame:
    """``mix`` for documents that belong to one source each."""
    return mix(docs, F.array(column(source).cast("string")), **options)


def apply_mix(docs: DataFrame, source: str = "source", id_col: str = "doc_id", text: str = "text", weights: dict | None = None, seed: str = SEED, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken; decided row by row, without moving them."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of the input clashes with ours
    plain = docs.toDF(*names)
    source_, id_, text_ = (names[docs.columns.index(c)] for c in (source, id_col, text))
    members = F.array(F.col(source_).cast("string"))
    _, quotas, cuts, fillers = _decide(plain, members, id_, text_, weights, seed, max_repeats)
    if quotas is None:
        return docs.where(F.lit(False))
    own = plain.withColumns({"__sources": members, "__size": word_count(text_), "__h": _order(id_, text_, seed)})
    wordless = ~F.coalesce(F.rlike(F.col(text_), F.lit(WORD)), F.lit(False))
    out = _repeated(_headed(own, quotas, cuts), fillers, wordless, max_repeats).where("__repeats > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__repeats")))).select(names).toDF(*docs.columns)
