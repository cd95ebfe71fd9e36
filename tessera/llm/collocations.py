"""Phrase collocation mining by pivot partitioning.

Every phrase belongs to its rarest word, its pivot. Texts are rewritten for each pivot: of
a piece, the fragment around an occurrence keeps only words that are no rarer than the pivot and
near enough to share a phrase with it; words that no candidate can hold (of fewer than
``least`` occurrences) part fragments. Equal fragments are counted once, fragments travel to their
pivot, and there all phrases are counted that the pivot owns. So every phrase is counted in
one place, and a very common word owns few phrases, as all others in them must be commoner still.
A phrase that holds its pivot twice is counted at the first.

Which of two words is rarer is decided by counts in a table of ``WIDTH`` cells (8 bytes
each), the only thing sent to all tasks: exact unless words share a cell, and an order of all
words in any case (ties by the word), which is all that ownership needs. A pivot of more than ``SHARE``
occurrences is dealt in parts by fragment, and the counts of its phrases are added up.

Defined cases: a null text counts as empty, a null language as ``und``; repeated rows count singly;
very long texts are read whole; ties go to the phrase that sorts first in bytes; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_class, byte_slices, column, discard, give_back, materialize, release, spread_join, words_of

PARTING = b".,;:!?\n\x0b\x0c\r"
HELD = byte_class(b" \t" + PARTING)
UNKNOWN = "und"

#: Between the words of a fragment; no word holds it.
APART = "\n"

WIDTH = 1 << 20

#: Occurrences of a pivot that one part of it holds, and fragments that a worker counts at once.
SHARE, ROWS = 1 << 18, 1 << 18


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(column(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), column(text).cast("string").alias("text"))


#: An odd multiplier and a finaliser: a word's hash is a polynomial over its bytes.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of large strings without a loop over them."""
    places = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    sizes = np.diff(places)
    out = sizes.astype(np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        data = np.frombuffer(words.buffers()[2], np.uint8)[places[0] : places[-1]].astype(np.uint64)
        power = np.full(int(sizes.max()), BASE)
        power = np.multiply.accumulate(power)
        heads = places[:-1][full] - places[0]
        data *= power[np.arange(len(data)) - np.repeat(heads, sizes[full])]
        out[full] += np.add.reduceat(data, heads)
    out = (out ^ (out >> np.uint64(32))) * MIX
    return out ^ (out >> np.uint64(29))


def _coded(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Languages and words of the (language, word) pairs of some texts; each word's pair, and whether it goes on."""
    words, text, follows = words_of(batch.column(1), HELD, PARTING)
    coded = words.dictionary_encode()
    langs = batch.column(0).cast(pa.large_string()).dictionary_encode()
    codes = langs.indices.to_numpy().astype(np.int64)[text] * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    pairs = pa.array(codes).dictionary_encode()
    lang, word = np.divmod(pairs.dictionary.to_numpy(), max(1, len(coded.dictionary)))
    return langs.dictionary.take(pa.array(lang)), coded.dictionary.take(pa.array(word)), pairs.indices.to_numpy(), follows


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, f): occurrences of every word by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1):
            langs, words, at, _ = _coded(batch)
            f = np.bincount(at, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([langs.cast(pa.string()), words.cast(pa.string()), pa.array(f)], ["lang", "word", "f"])
            release()
        give_back()

    partial = _texts(docs, text, lang).mapInArrow(run, "lang string, word string, f long")
    return partial.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _cell(langs: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The cell and the hash of each word of a language."""
    mixed = _hashes(words) * MIX + _hashes(langs)
    mixed ^= mixed >> np.uint64(31)
    return (mixed & np.uint64(WIDTH - 1)).astype(np.int64), mixed


def _cells(words: DataFrame) -> np.ndarray:
    """Counts of frequent words by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, _ = _cell(batch.column(0).cast(pa.large_string()), batch.column(1).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(2)], ["cell", "f"])

    found = words.mapInArrow(run, "cell long, f long").groupBy("cell").agg(F.sum("f").alias("f")).toArrow()
    out = np.zeros(WIDTH, np.int64)
    out[found["cell"].to_numpy()] = found["f"].to_numpy()
    return out


def _ranks(langs: pa.Array, words: pa.Array, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the words' cells, a rank that falls with rarity, and hashes; words of equal count and hash are told apart in full."""
    cell, hashed = _cell(langs, words)
    counts = cells[cell]
    order = np.lexsort((hashed, counts))
    same = (counts[order][1:] == counts[order][:-1]) & (hashed[order][1:] == hashed[order][:-1])
    if same.any():
        full = np.empty(len(counts), np.int64)
        full[pc.sort_indices(words).to_numpy()] = np.arange(len(counts))
        order = np.lexsort((full, hashed, counts))
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    return counts, rank, hashed


def _neighbours(at: np.ndarray, follows: np.ndarray, rank: np.ndarray, usable: np.ndarray, reach: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By distance, the pairs left and right of each word that its fragment keeps (-1: none).

    On the left only commoner words, on the right also the same one: so a phrase that holds its
    pivot twice is in one fragment's reach only.
    """
    size, mine, may = len(at), rank[at], usable[at]
    sides: tuple[list[np.ndarray], list[np.ndarray]] = [], []
    left, right = may.copy(), may.copy()
    for d in range(1, reach + 1):
        left[:d] = False
        right[max(0, size - d) :] = False
        if size > d:
            left[d:] &= follows[1 : size - d + 1] & may[:-d] & (mine[:-d] > mine[d:])
            right[:-d] &= follows[d:] & may[d:] & (mine[d:] >= mine[:-d])
        far = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        there = np.flatnonzero(left)
        far[0][there] = at[there - d]
        there = np.flatnonzero(right)
        far[1][there] = at[there + d]
        sides[0].append(far[0])
        sides[1].append(far[1])
    return sides


def _slots(longest: int) -> list[str]:
    """The words of a fragment in order: left of the pivot, the pivot, right of it."""
    return [f"l{d}" for d in range(longest - 1, 0, -1)] + ["pivot"] + [f"r{d}" for d in range(1, longest)]


def fragments(docs: DataFrame, words: DataFrame, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """(route, part, n, lang, fragment): fragments with their counts, each slice of a task combined; of each slot the word that stays, or nothing, by lines.

    Rows of one ``route`` belong together: those of a pivot, or of a part of it if its words come to
    more than ``SHARE``; ``part`` is 0 for a pivot that is whole. words are the frequent ones of ``word_counts``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_cells(words))
    slots = _slots(longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank, nothing = pa.scalar(APART, pa.large_string()), pa.scalar("", pa.large_string())
        for batch in byte_slices(batches, 1):
            langs, names, at, follows = _coded(batch)
            counts, rank, hashed = _ranks(langs, names, shared.value)
            before, after = _neighbours(at, follows, rank, counts >= least, longest - 1)
            kept = np.flatnonzero((before[0] >= 0) | (after[0] >= 0))
            each = dict(zip(slots, [*before[::-1], at, *after], strict=True))
            same = pa.table({k: x[kept] for k, x in each.items()}).group_by(slots, use_threads=False).aggregate([([], "count_all")])
            del before, after, each
            same = same.take(pc.sort_indices(same["pivot"]))  # neighbours in a shuffle block are alike, so it is smaller
            ids = {k: same[k].to_numpy() for k in slots}
            pivot = ids["pivot"]
            parts = (1 + counts[pivot] // SHARE).astype(np.uint64)
            mixed = np.zeros(len(pivot), np.uint64)
            for k in slots:
                mixed = (mixed ^ np.where(ids[k] < 0, np.uint64(1), hashed[ids[k]])) * MIX
                mixed ^= mixed >> np.uint64(32)
            part = np.where(parts > 1, 1 + mixed % parts, 0)
            route = ((hashed[pivot] + part) * MIX).view(np.int64)
            columns = [pa.array(route), pa.array(part.astype(np.int32)), pa.array(same["count_all"].to_numpy().astype(np.int32)), langs.take(pa.array(pivot)).cast(pa.string())]
            words = [pc.fill_null(names.take(pa.array(ids[k], mask=ids[k] < 0)), nothing) for k in slots]
            columns.append(pc.binary_join_element_wise(*words, blank).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["route", "part", "n", "lang", "fragment"])
            del columns, same, ids, words
            release()
        give_back()

    out = _texts(docs, text, lang).mapInArrow(run, "route long, part int, n int, lang string, fragment string")
    out._shared = shared
    return out


def _counted(rows: pa.Table, longest: int, least: int) -> pa.RecordBatch:
    """(lang, phrase, a, part) of all phrases in whole routes that their pivots own."""
    slots = _slots(longest)
    each = pa.concat_arrays([pc.split_pattern(x.cast(pa.large_string()), APART).flatten() for x in rows["fragment"].chunks])
    coded = each.dictionary_encode()
    names = coded.dictionary
    ids = np.where(pc.equal(names, "").to_numpy(zero_copy_only=False), -1, np.arange(len(names)))[coded.indices.to_numpy()].reshape(rows.num_rows, len(slots)).T
    langs = rows["lang"].combine_chunks().dictionary_encode()
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    own = {"lang": langs.indices.to_numpy(), "part": rows["part"].to_numpy(), "n": rows["n"].to_numpy().astype(np.int64)}
    found: dict[str, list[np.ndarray]] = {k: [] for k in [*own, *slots[:longest]]}
    centre = longest - 1
    for i in range(longest):
        for j in range(longest - i):
            there = np.flatnonzero((ids[centre - i] >= 0) & (ids[centre + j] >= 0)) if i + j else []
            if len(there):
                for k in own:
                    found[k].append(own[k][there])
                for d, k in enumerate(slots[:longest]):
                    found[k].append(ids[centre - i + d][there] if d <= i + j else np.full(len(there), -1, ids.dtype))
    keys = ["lang", "part", *slots[:longest]]
    table = pa.table({k: np.concatenate(x) if x else np.empty(0, np.int64) for k, x in found.items()})
    sums = table.group_by(keys, use_threads=False).aggregate([("n", "sum")])
    sums = sums.filter(pc.or_(pc.greater(sums["part"], 0), pc.greater_equal(sums["n_sum"], least)))
    blank, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    words = [names.take(pa.array(x, mask=x < 0)) for x in (sums[k].to_numpy() for k in slots[:longest])]
    apart = [pc.fill_null(pc.binary_join_element_wise(x, nothing, blank), "") for x in words]
    phrase = pc.utf8_rtrim(pc.binary_join_element_wise(*apart, nothing), " ").cast(pa.string())
    lang = langs.dictionary.take(pa.array(sums["lang"].to_numpy())).cast(pa.string())
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(sums["n_sum"].to_numpy()), pa.array(sums["part"].to_numpy().astype(np.int32))], ["lang", "phrase", "a", "part"])


def owned_phrases(frags: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """(lang, phrase, a) of phrases of 2 to ``longest`` words with at least ``least`` occurrences, counted at their pivots.

    Fragments are sorted by route in each task, and whole routes are counted some ``ROWS`` rows
    at a time; phrases of a pivot in parts are added up over them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS and held[0].column(0)[0] != batch.column(0)[batch.num_rows - 1]:
                rows = pa.Table.from_batches(held)
                route = rows["route"].to_numpy()
                cut = int(np.searchsorted(route, route[-1]))
                yield _counted(rows.slice(0, cut), longest, least)
                held = rows.slice(cut).combine_chunks().to_batches()
                del rows
                release()
        if held:
            yield _counted(pa.Table.from_batches(held), longest, least)
        give_back()

    routed = frags.repartition("route").sortWithinPartitions("route")
    mined = materialize(routed.mapInArrow(run, "lang string, phrase string, a long, part int"), "phrases-mined")
    added = mined.where("part > 0").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return mined.where("part = 0").select("lang", "phrase", "a").unionByName(added)


def _cuts(phrases: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, a, k, side, part): both sides of every cut of every phrase."""
    words = F.split("phrase", " ")
    n = F.size(words)
    join = lambda at, size: F.array_join(F.slice(words, at, size), " ")
    sides = [
        F.when(n > k, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), piece.alias("part")))
        for k in range(1, longest)
        for side, piece in ((0, join(1, k)), (1, join(k + 1, n)))
    ]
    return phrases.select("lang", "phrase", "a", F.explode(F.array_compact(F.array(*sides))).alias("c")).select("lang", "phrase", "a", "c.*")


def scored(phrases: DataFrame, words: DataFrame, longest: int = 3) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each phrase at its lowest-scoring cut; exact in decimals of 38 digits."""
    cuts = materialize(_cuts(phrases, longest), "phrases-cuts")
    asked = cuts.groupBy("lang", "part").agg(F.count("*").alias("asked"))
    counts = words.select("lang", F.col("word").alias("part"), "f").unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    known = materialize(asked.join(counts, ["lang", "part"]), "phrases-parts")
    found = spread_join(cuts, known, ["lang", "part"], "asked", cuts.count())
    sides = found.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    wide = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    rated = sides.withColumn("score", F.expr(f"CAST((1000000 * {wide('a')} * {wide('a')}) DIV ({wide('l')} * {wide('r')}) AS BIGINT)"))
    return rated.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def uncovered(rated: DataFrame, longest: int = 3, cover: int = 50) -> DataFrame:
    """The phrases that no longer candidate with ``cover`` percent of their occurrences holds."""
    words = F.split("phrase", " ")
    n = F.size(words)
    inner = [F.when((n > size) & (n >= at + size - 1), F.array_join(F.slice(words, at, size), " ")) for size in range(2, longest) for at in range(1, longest - size + 2)]
    if not inner:
        return rated
    held = rated.select("lang", F.explode(F.array_compact(F.array(*inner))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    return rated.join(held, ["lang", "phrase"], "left").where(f"over IS NULL OR 100 * over < {cover} * a").drop("over")


def first_ranks(rated: DataFrame, most: int = 2000) -> DataFrame:
    """rated with each language's rank, the first ``most``; a language's phrases are cut in parts before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = 1 + isqrt(rated.count() // most)
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    cut = rated.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= most)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, cover: int = 50, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words."""
    every = materialize(word_counts(docs, text, lang), "phrases-words")
    sizes = materialize(every.groupBy("lang").agg(F.sum("f").alias("n")), "phrases-sizes")
    words = every.where(F.col("f") >= least)
    frags = fragments(docs, words, longest, least, text, lang)
    phrases = materialize(owned_phrases(frags, longest, least), "phrases-owned")
    frags._shared.destroy()
    rated = materialize(uncovered(scored(phrases, words, longest), longest, cover), "phrases-rated")
    discard(every, phrases)
    ranked = first_ranks(rated, most).join(sizes, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
