"""SimHash near-duplicates by multi-index hashing.

Fingerprints are computed in one pass over the texts. Search runs over distinct
fingerprints. Each is cut into segments, and the small Hamming ball around each segment
(radius 1: the segment and every value one bit off) is enumerated into a table keyed by
ball point. Two fingerprints whose segments differ in at most two bits share a point and
meet there; complete distances are then verified.

``near_groups`` links fingerprints of 64 bits at four or fewer differing bits: two halves
of 32 bits miss nothing. Distance decides, so a block returns the components among its
meetings as a forest (one link a fingerprint).

``drop_near`` is about similarity (Jaccard over sets of five-word shingles), which no
distance of fingerprints decides. Its sketches are wider SimHashes: a bit differs with
probability acos(2s / (1 + s)) / pi, 0.1515 at similarity s = 0.8. The segments are as wide
as the number of documents asks for (chance meetings a document stay few at any size), and
as many as make a pair at the similarity meet but for a probability of ``MISS``; the
complete distance rules out strangers, and only an exact Jaccard similarity of the shingle
sets makes a link. At a ball point members are first compared with its smallest one, so a
group of copies costs as many comparisons as it has members. Components that still meet
with near fingerprints are then joined to neighbourhoods, and the members of a neighbourhood
are compared across components in a grid of tasks; no list of pairs is ever written.

The table is dealt out by segment and its top bits: a fingerprint is sent to the blocks
that its ball touches (one, and one per top bit), and the ball is enumerated there. Links
are joined to components by alternating large-star and small-star rounds, each written
to the shared folder; no component is ever gathered in one place, and hubs are joined
without moving their links.

Defined cases: a null or empty text (or one of white space only) has fingerprint zero
and links like any other; a text of fewer words than a shingle is one shingle; words
are split at ASCII white space only and A-Z are lowered, nothing else; very long texts
are read whole, one at a time; repeated rows are separate documents with one fingerprint;
a row with a null id is a document that never names its component; an empty table gives an
empty result; other columns are ignored by ``near_groups`` and kept by ``drop_near``. There
documents are told apart by id and text: of equal ids each text is decided by itself, of
rows equal in both one stays, and rows with a null id stay.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWERING, column, discard, give_back, materialize, slices, split_by_keys, spread_join, unused

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Sketches that one block holds, about; each enters as many ball points as a segment has bits.
BLOCK_ROWS = 60_000
ROUNDS = 60

#: Bit i of byte value v.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(data: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included."""
    words = data.translate(LOWERING).split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], "<u8")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], "<u8")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each bit of (hashes, lanes) is set, lane by lane from the lowest bit on; 4,096 hashes at a time."""
    lanes = hashes.shape[1] * 8
    at = np.arange(lanes) * 256
    seen = np.zeros(lanes * 256, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[i : i + 4096])
        seen += np.bincount((part.view(np.uint8).reshape(len(part), lanes) + at).ravel(), minlength=lanes * 256)
    return (seen.reshape(lanes, 256) @ BITS).ravel()


def majority(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of (hashes, lanes): a bit is set if more than half of the hashes set it."""
    return np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view("<u8")


def fold(hashes: np.ndarray) -> int:
    """The fingerprint of 64 bits; zero without hashes."""
    return int(majority(hashes[:, None])[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches):
        for batch in slices(batches):
            fps = [0 if t is None else fold(shingle_hashes(t.encode(), shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(column(id_col).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


class Segments(NamedTuple):
    """How fingerprints are cut and compared; of 64-bit words, ``lanes`` are needed."""

    width: int
    count: int
    distance: int

    @property
    def lanes(self) -> int:
        return -(-self.width * self.count // 64)

    @property
    def kind(self) -> str:
        """The smallest type that holds a segment."""
        return "<u4" if self.width <= 32 else "<u8"

    def value(self, lanes: np.ndarray, segment: int) -> np.ndarray:
        """The segment's bits of each fingerprint."""
        word, shift = divmod(segment * self.width, 64)
        out = lanes[:, word] >> np.uint64(shift)
        if shift + self.width > 64:
            out = out | (lanes[:, word + 1] << np.uint64(64 - shift))
        return out & np.uint64((1 << self.width) - 1)


#: Two halves of one fingerprint; at most four differing bits leave a half with at most two, so none is missed.
EXACT = Segments(32, 2, DISTANCE)
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: Greatest probability that two documents at the similarity never meet.
MISS = 1e-4
#: Segments are this many bits wider than the number of documents has, so that strangers meet a few times at any size.
SPARE_BITS = 6
#: Standard deviations over the mean distance at the similarity that are still compared.
SLACK = 4.0
#: Segments that the first round uses, in which groups of copies find their smallest member.
FIRST_SEGMENTS = 4
#: Sketches a block of ``drop_near`` (52 bytes each), and ball points that it enumerates at once.
SIMILAR_BLOCK_ROWS, POINTS = 2_000_000, 2_000_000


def differing(similarity: float) -> float:
    """The probability that a bit differs."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def cut_off(bits: int, similarity: float) -> int:
    """The greatest distance of ``bits`` bits that is not ruled out."""
    p = differing(similarity)
    return math.ceil(p * bits + SLACK * math.sqrt(p * (1 - p) * bits))


@cache
def segments_for(count: int, similarity: float = SIMILARITY, miss: float = MISS) -> Segments:
    """The cut of sketches for ``count`` documents."""
    p = differing(similarity)
    width = max(16, max(count, 1).bit_length() + SPARE_BITS)
    meet = sum(math.comb(width, i) * p**i * (1 - p) ** (width - i) for i in range(3))
    pieces = max(1, math.ceil(math.log(miss) / math.log1p(-meet)))
    return Segments(width, pieces, cut_off(-(-width * pieces // 64) * 64, similarity))


def ball_entries(values: np.ndarray, width: int, top: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(ball point, row) for those points of each value's radius-1 ball whose top bits are ``prefix``."""
    low = width - top
    own = np.flatnonzero((values >> np.uint64(low)) == prefix)
    near = np.flatnonzero(np.bitwise_count((values >> np.uint64(low)) ^ np.uint64(prefix)) == 1)
    flips = np.concatenate([[0], 1 << np.arange(low)]).astype(np.uint64)
    points = (values[own][:, None] ^ flips).ravel()
    crossing = (values[near] & np.uint64((1 << low) - 1)) | np.uint64(prefix << low)
    return np.concatenate([points, crossing]), np.concatenate([np.repeat(own, low + 1), near])


def runs(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows by ball point, where a point's rows start, how many they are), for points with more than one row."""
    bits = np.uint64(max(1, int(owner.max(initial=0)).bit_length()))
    if len(points) and int(points.max()) >> (64 - int(bits)):
        order = np.lexsort((owner, points))
        points, owner = points[order], owner[order]
    else:  # one sort of plain numbers is several times as fast
        packed = np.sort((points << bits) | owner.astype(np.uint64))
        points, owner = packed >> bits, (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, points[1:] != points[:-1]]) if len(points) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(points)])
    keep = sizes > 1
    return owner, starts[keep], sizes[keep]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link (node, smallest node) for each node but the smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for at in (x, y, root[x], root[y]):
            np.minimum.at(new, at, low)
        new = new[new]
        if np.array_equal(new, root):
            keep = root != np.arange(len(nodes))
            return nodes[keep], nodes[root[keep]]
        root = new


def near(lanes: np.ndarray, a, b, distance: int, step: int = 500_000) -> np.ndarray:
    """Whether the complete fingerprints of rows a[i] and b[i] are near."""
    out = np.empty(len(a), bool)
    for i in range(0, len(a), step):
        out[i : i + step] = np.bitwise_count(lanes[a[i : i + step]] ^ lanes[b[i : i + step]]).sum(-1, dtype=np.int64) <= distance
    return out


def large_run_links(lanes: np.ndarray, members: np.ndarray, distance: int, comp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join a run's components. A member is compared with all those not joined to it; the largest component's own are not. comp: where components start from."""
    comp = np.arange(len(members)) if comp is None else comp.copy()
    done = np.zeros(len(members), bool)
    a, b = [], []
    at = 0
    while True:
        done[at] = True
        others = np.flatnonzero(comp != comp[at])
        hit = others[near(lanes, np.full(len(others), members[at]), members[others], distance)]
        if len(hit):
            comps, first = np.unique(comp[hit], return_index=True)
            a.append(np.full(len(first), members[at]))
            b.append(members[hit[first]])
            comp[np.isin(comp, comps)] = comp[at]
        sizes = np.bincount(comp, minlength=len(members))
        open_ = np.flatnonzero(~done & (comp != sizes.argmax()))  # pairs with the largest component are seen from the other side
        if not len(open_):
            none = np.empty(0, np.int64)
            return np.concatenate([none, *a]), np.concatenate([none, *b])
        at = open_[sizes[comp[open_]].argmin()] if len(open_) < 1000 else open_[0]


def pairs_at(owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs ``step`` apart in each run."""
    some = sizes > step
    left = np.repeat(starts[some], sizes[some] - step) + np.arange((sizes[some] - step).sum()) - np.repeat(np.cumsum(sizes[some] - step) - (sizes[some] - step), sizes[some] - step)
    return owner[left], owner[left + step]


def links_in_block(points: np.ndarray, owner: np.ndarray, lanes: np.ndarray, distance: int, small: int = 32, hold: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the verified links among entries with equal points, as rows of ``lanes``."""
    owner, starts, sizes = runs(points, owner)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def hold_on(a, b):
        nonlocal found, held
        found.append((a, b))
        held += len(a)
        if held > hold:
            found, held = [forest(*map(np.concatenate, zip(*found, strict=True)))], 0

    large = sizes > small
    for start, size in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
        hold_on(*large_run_links(lanes, np.unique(owner[start : start + size]), distance))
    for step in range(1, int(sizes[~large].max(initial=0))):
        a, b = pairs_at(owner, starts[~large], sizes[~large], step)
        hit = (a != b) & near(lanes, a, b, distance)
        hold_on(a[hit], b[hit])
    if not held and not any(len(a) for a, _ in found):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(*map(np.concatenate, zip(*found, strict=True)))


def _blocks(nodes: DataFrame, count: int, how: Segments, payload: list[str], schema: str, block_rows: int, segments: int | None = None):
    """(entries by block, number of top bits) of all or the first segments. A block's row holds, for part of the nodes, node ids, fingerprints and more as bytes."""
    top = min(how.width - 2, max(0, (max(count, 1) // block_rows).bit_length()))

    def enter(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lanes = ids.view(np.uint64)[:, None] if "sketch" not in payload else np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, how.lanes)
            more = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in payload if c != "sketch"]
            rows = []
            for s in range(segments or how.count):
                value = how.value(lanes, s) if len(ids) else np.empty(0, np.uint64)
                prefix = (value >> np.uint64(how.width - top)).astype(np.int64)
                for p in np.unique(np.concatenate([prefix ^ f for f in (0, *(1 << i for i in range(top)))])).tolist() if len(ids) else ():
                    at = np.bitwise_count(prefix ^ p) <= 1
                    rows.append(((s << top) | p, ids[at].tobytes(), value[at].astype(how.kind).tobytes() if "sketch" in payload else b"", lanes[at, :CHECK].tobytes() if "sketch" in payload else b"", *(m[at].tobytes() for m in more)))
            names = ["block", "nodes", "values", "lanes", *(c for c in payload if c != "sketch")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i == 0 else pa.binary()) for i, x in enumerate(zip(*rows, strict=True) if rows else [[]] * len(names))], names)

    entries = nodes.select("node", *payload).mapInArrow(enter, f"block long, nodes binary, values binary, lanes binary{schema}")
    return entries.repartition((segments or how.count) << top, "block").groupBy("block"), top


#: Words of a sketch that travel with a block's entries: 256 bits rule out strangers; what is left is compared whole.
CHECK = 4


def links(distinct: DataFrame, count: int, how: Segments = EXACT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) links between fingerprints (``node``, as signed longs), a forest by block."""
    blocks, top = _blocks(distinct, count, how, [], "", block_rows)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        nodes = np.frombuffer(b"".join(pdf["nodes"]), np.int64)
        lanes = nodes.view(np.uint64)[:, None]
        a, b = links_in_block(*ball_entries(how.value(lanes, block >> top), how.width, top, block & (1 << top) - 1), lanes, how.distance)
        out = pd.DataFrame({"a": nodes[a], "b": nodes[b]})
        del lanes, nodes
        give_back()
        return out

    return blocks.applyInPandas(verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes with a link. Alternating stars until nothing changes."""

    def star(pairs: DataFrame, total: int, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both if large else both.where("b < a")
        least = around.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        joined = spread_join(around, least, ["a"], "n", 2 * total)
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    pairs = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "star-0")
    total, mark = pairs.count(), None
    for i in range(1, ROUNDS + 1):
        outer = materialize(star(pairs, total, True), f"star-{i}-large")
        inner = materialize(star(outer, outer.count(), False), f"star-{i}")
        discard(pairs, outer)
        pairs = inner
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        total, mark = now[0], now
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def _rooted(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component_id (the least of the component's ``least``) for a written table of node, least and n (documents)."""
    found = components(edges).withColumnRenamed("node", "__node")
    rooted = materialize(distinct.join(found, distinct["node"] == found["__node"], "left").select("node", "n", "least", F.coalesce("root", "node").alias("root")), "near-rooted")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("__n"))
    return spread_join(rooted.drop("least"), firsts, ["root"], "__n", rooted.count()).select("node", "n", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = materialize(fingerprints(docs, id_col, text, shingle).withColumnRenamed("fp", "node"), "simhash-prints")
    distinct = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    rooted = materialize(_rooted(distinct, links(distinct, distinct.count())), "simhash-rooted")
    found = spread_join(prints, rooted, ["node"], "n", prints.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity -----------------------------------------------------------------

#: Shingle sets and pairs that one task of the exact check holds, about.
CELL_BYTES, CELL_PAIRS = 2 << 20, 200_000
#: Documents and bytes of shingle sets in a part of a neighbourhood.
AREA_ROWS, AREA_BYTES = 4000, 16 << 20


def shingle_set(text: str | None, size: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes((text or "").encode(), size))


def set_node(shingles: np.ndarray) -> int:
    """One number a shingle set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


@cache
def _mixers(lanes: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, lanes, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def sketch(shingles: np.ndarray, lanes: int) -> np.ndarray:
    """SimHash of a shingle set over ``lanes`` words; zeros for an empty set."""
    if not len(shingles):
        return np.zeros(lanes, np.uint64)
    mixed = shingles[:, None] * _mixers(lanes)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    return majority(mixed)


def similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the Jaccard similarity of sets a[i] and b[i] (sorted, distinct) is at least ``similarity``."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = (sizes[a] == 0) & (sizes[b] == 0)
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    at = np.flatnonzero((small > 0) & (small >= similarity * large))
    at = at[np.argsort(a[at], kind="stable")]
    for part in np.split(at, np.flatnonzero(np.diff(a[at])) + 1):
        for i in range(0, len(part), 256):
            rows = part[i : i + 256]
            own, others = sets[a[rows[0]]], np.concatenate([sets[x] for x in b[rows].tolist()])
            hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
            common = np.add.reduceat(hit.astype(np.int64), np.r_[0, np.cumsum(sizes[b[rows]])[:-1]])
            out[rows] = common >= similarity * (len(own) + sizes[b[rows]] - common)
    return out


def _similar_links(pairs: DataFrame, sets: DataFrame, size: int, how: Segments, similarity: float) -> DataFrame:
    """Those (a, b) of written pairs whose complete sketches are near and whose sets are similar enough. A set is sent once to each cell of a grid of tasks that needs it."""
    side = F.lit(1 + int(max(size / CELL_BYTES, pairs.count() / CELL_PAIRS) ** 0.5))
    celled = pairs.withColumn("cell", F.pmod("a", side) * side + F.pmod("b", side))
    needed = celled.select(F.col("cell").alias("at"), F.explode(F.array("a", "b")).alias("node")).distinct()

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        nodes = right["node"].to_numpy(np.int64)
        held = [np.frombuffer(x, np.uint64) for x in right["shingles"]]
        sketches = np.frombuffer(b"".join(right["sketch"]), np.uint64).reshape(-1, how.lanes)
        order = np.argsort(nodes)
        a, b = (order[np.searchsorted(nodes, left[k].to_numpy(np.int64), sorter=order)] for k in "ab")
        close = near(sketches, a, b, how.distance)
        close[close] = similar(held, a[close], b[close], similarity)
        out = left.loc[close, ["a", "b"]]
        del held, sketches
        give_back()
        return out

    found = celled.groupBy("cell").cogroup(needed.join(sets, "node").groupBy("at")).applyInPandas(check, "a long, b long")
    return materialize(found, "near-links")


def hub_pairs(owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run's smallest node with each other member, every pair once."""
    where = np.repeat(np.arange(len(starts)), sizes)
    rows = owner[np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    rank = np.argsort(np.argsort(nodes))
    low = np.minimum.reduceat(rank[rows], np.cumsum(sizes) - sizes) if len(rows) else np.empty(0, np.int64)
    hub = np.argsort(nodes)[low][where] if len(rows) else rows
    pairs = np.unique(hub[rows != hub] * len(nodes) + rows[rows != hub])
    return pairs // max(1, len(nodes)), pairs % max(1, len(nodes))


def label_links(owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lanes: np.ndarray, labels: np.ndarray, distance: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Forest of links between labels that have near members in one run."""
    none = np.empty(0, np.int64)
    if not len(starts):
        return none, none
    where = np.repeat(np.arange(len(starts)), sizes)
    rows = owner[np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    at = np.cumsum(sizes) - sizes
    mixed = np.minimum.reduceat(labels[rows], at) < np.maximum.reduceat(labels[rows], at)
    rows, sizes = rows[mixed[where]], sizes[mixed]
    starts = np.cumsum(sizes) - sizes
    found = [(none, none)]
    for start, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        members = np.unique(rows[start : start + size])
        found.append(large_run_links(lanes, members, distance, np.unique(labels[members], return_inverse=True)[1]))
    little = sizes <= small
    for step in range(1, int(sizes[little].max(initial=0))):
        a, b = pairs_at(rows, starts[little], sizes[little], step)
        differ = labels[a] != labels[b]
        a, b = a[differ], b[differ]
        hit = near(lanes, a, b, distance)
        found.append((a[hit], b[hit]))
    a, b = map(np.concatenate, zip(*found, strict=True))
    return forest(labels[a], labels[b])


def _meetings(nodes: DataFrame, count: int, how: Segments, similarity: float, block_rows: int, segments: int | None = None) -> DataFrame:
    """(a, b), a < b: each point's smallest node with the others that are near it. With a label column: labels with near members, a forest by block."""
    labelled = "label" in nodes.columns
    blocks, top = _blocks(nodes, count, how, ["sketch", "label"] if labelled else ["sketch"], ", label binary" if labelled else "", block_rows, segments)
    check = min(CHECK, how.lanes)
    most = cut_off(64 * check, similarity)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        ids = np.frombuffer(b"".join(pdf["nodes"]), np.int64)
        label = np.frombuffer(b"".join(pdf["label"]), np.int64) if labelled else None
        values = np.frombuffer(b"".join(pdf["values"]), how.kind).astype(np.uint64)
        lanes = np.frombuffer(b"".join(pdf["lanes"]), np.uint64).reshape(-1, check)
        finer = min(how.width - top - 1, (len(ids) * (how.width + 1) // POINTS).bit_length())
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for part in range(1 << finer):
            met = runs(*ball_entries(values, how.width, top + finer, (block & (1 << top) - 1) << finer | part))
            if labelled:
                found.append(label_links(*met, lanes, label, most))
                continue
            a, b = hub_pairs(*met, ids)
            hit = near(lanes, a, b, most)
            found.append((ids[a[hit]], ids[b[hit]]))
        a, b = map(np.concatenate, zip(*found, strict=True))
        a, b = forest(a, b) if labelled else (a, b)
        out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
        del values, lanes, found
        give_back()
        return out

    return blocks.applyInPandas(verify, "a long, b long").distinct()


def cross_links(sets: list[np.ndarray], lanes: np.ndarray, labels: np.ndarray, side: np.ndarray, distance: int, similarity: float, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are similar across labels, as links that join them. side: 0 or 1, and only rows of different sides are compared; or None, all are."""
    order = np.argsort(labels, kind="stable")
    labels = np.unique(labels, return_inverse=True)[1]
    a, b = [], []
    left = order if side is None else order[side[order] == 0]
    right = order if side is None else order[side[order] == 1]
    for i in range(0, len(left), step):
        rows = left[i : i + step]
        apart = np.zeros((len(rows), len(right)), np.uint16)
        for w in range(lanes.shape[1]):
            apart += np.bitwise_count(lanes[rows, w][:, None] ^ lanes[right, w][None, :])
        close = apart <= distance
        for x, hits in zip(rows.tolist(), close, strict=True):
            others = right[hits]
            others = others[labels[others] != labels[x]]
            if not len(others):
                continue
            for y in others[similar(sets, np.full(len(others), x), others, similarity)].tolist():
                if labels[y] != labels[x]:
                    a.append(x)
                    b.append(y)
                    labels[labels == labels[y]] = labels[x]
    return np.array(a, np.int64), np.array(b, np.int64)


def _neighbours(labelled: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label, area): nodes whose component meets another, and their neighbourhood; written."""
    areas = components(edges).select(F.col("node").alias("label"), F.col("root").alias("area"))
    areas = areas.unionByName(areas.select(F.col("area").alias("label"), "area")).distinct()
    sized = areas.join(labelled.groupBy("label").agg(F.count("*").alias("n")), "label")
    return materialize(spread_join(labelled.drop("sketch"), sized, ["label"], "n", labelled.count()).select("node", "label", "area"), "near-open")


def _area_links(open_: DataFrame, sets: DataFrame, how: Segments, similarity: float) -> DataFrame:
    """(a, b): similar nodes of different labels in one neighbourhood. A neighbourhood is cut into parts, and a task compares two parts."""
    sized = materialize(open_.join(sets.select("node", F.octet_length("shingles").alias("bytes")), "node"), "near-sized")
    areas = sized.groupBy("area").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    side = F.ceil(F.greatest(F.col("n") / AREA_ROWS, F.col("bytes") / AREA_BYTES, F.lit(1))).cast("int")
    areas = materialize(areas.select("area", "n", "bytes", side.alias("side")), "near-areas")
    # Small neighbourhoods share a task; a large one's parts meet in tasks of their own.
    tasks = 1 + int((areas.where("side = 1").agg(F.sum("bytes")).first()[0] or 0) // AREA_BYTES)
    placed = spread_join(sized.drop("bytes"), areas.drop("bytes"), ["area"], "n", sized.count()).withColumn("part", F.pmod(F.xxhash64("node"), "side"))
    dealt = placed.select("area", "node", "label", "part", "side", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("other"))
    large = F.col("side") > 1
    task = F.when(large, F.col("area")).otherwise(F.pmod(F.xxhash64("area"), F.lit(tasks)))
    dealt = dealt.select(large.alias("large"), task.alias("task"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "area", "node", "label", "part")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        lanes = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(-1, how.lanes)
        nodes, labels, i, j = pdf["node"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), pdf["i"].iloc[0], pdf["j"].iloc[0]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for rows in pdf.groupby("area").indices.values():
            side = None if i == j else (pdf["part"].to_numpy()[rows] == j).astype(int)
            a, b = cross_links([held[r] for r in rows], lanes[rows], labels[rows], side, how.distance, similarity)
            found.append((nodes[rows[a]], nodes[rows[b]]))
        a, b = map(np.concatenate, zip(*found, strict=True))
        del held, lanes
        give_back()
        return pd.DataFrame({"a": a, "b": b})

    return materialize(dealt.join(sets, "node").groupBy("large", "task", "i", "j").applyInPandas(check, "a long, b long"), "near-cross-links")


def _similar_pairs(prints: DataFrame, texts: DataFrame, shingle: int, similarity: float, how: Segments, block_rows: int) -> DataFrame:
    """(a, b) links between nodes that give the components of similarity; prints: key, node, sketch; texts: key, text."""
    nodes = materialize(prints.groupBy("node").agg(F.first("sketch").alias("sketch")), "near-nodes")
    count = nodes.count()
    first = materialize(_meetings(nodes, count, how, similarity, block_rows, min(FIRST_SEGMENTS, how.count)), "near-pairs")
    sets, size = _sets(prints, texts, first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle, how, "near-sets")
    some = _similar_links(first, sets, size, how, similarity)
    root = components(some).select(F.col("node").alias("__node"), "root")
    labelled = materialize(nodes.join(root, nodes["node"] == root["__node"], "left").select("node", "sketch", F.coalesce("root", "node").alias("label")), "near-labelled")
    discard(sets, nodes)
    edges = materialize(_meetings(labelled, count, how, similarity, block_rows), "near-edges")
    open_ = _neighbours(labelled, edges)
    discard(first, labelled, edges)
    sets, _ = _sets(prints, texts, open_.select("node"), shingle, how, "near-open-sets")
    return some.unionByName(_area_links(open_, sets, how, similarity))


def _sets(prints: DataFrame, texts: DataFrame, wanted: DataFrame, shingle: int, how: Segments, tag: str) -> tuple[DataFrame, int]:
    """(node, sketch, shingles) of the wanted nodes, written, and their bytes. Only their texts are read into Python again."""

    def draw(batches):
        for batch in slices(batches):
            drawn = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            columns = [[set_node(x) for x in drawn], [sketch(x, how.lanes).tobytes() for x in drawn], [x.tobytes() for x in drawn]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["node", "sketch", "shingles"])
        give_back()

    keys = materialize(prints.groupBy("node").agg(F.min("key").alias("key")).join(wanted, "node", "left_semi").select(F.col("key").alias("__key")), f"{tag}-keys")
    held, _ = split_by_keys(texts, F.col("key"), keys)
    drawn = held.join(keys, held["key"] == keys["__key"], "left_semi").select("text").mapInArrow(draw, "node long, sketch binary, shingles binary")
    sets = materialize(drawn.dropDuplicates(["node"]), tag)
    discard(keys)
    return sets, sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0


def _key(id_col: str, text: str) -> Column:
    """Tells documents apart by id and text; null for a null id."""
    return F.concat(column(id_col).cast("long").cast("string"), F.lit(":"), F.md5(F.coalesce(column(text).cast("string"), F.lit(""))))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, block_rows: int = SIMILAR_BLOCK_ROWS) -> DataFrame:
    """One document of each near-duplicate group (the smallest id) with all its columns."""
    how = segments_for(docs.count(), similarity)

    def draw(batches):
        for batch in slices(batches):
            texts_ = batch.column(1).to_pylist()
            drawn = [shingle_set(t, shingle) for t in texts_]
            ids = batch.column(0)
            keys = [f"{d}:{hashlib.md5((t or '').encode()).hexdigest()}" for d, t in zip(ids.to_pylist(), texts_, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(keys, pa.string()), pa.array([set_node(x) for x in drawn], pa.int64()), pa.array([sketch(x, how.lanes).tobytes() for x in drawn], pa.binary())],
                ["doc_id", "key", "node", "sketch"],
            )
        give_back()

    slim = docs.select(column(id_col).cast("long").alias("doc_id"), column(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    prints = materialize(slim.mapInArrow(draw, "doc_id long, key string, node long, sketch binary"), "near-prints")
    texts = slim.select(_key("doc_id", "text").alias("key"), "text")
    rank = F.struct("doc_id", "key")
    distinct = materialize(prints.groupBy("node").agg(F.min(rank).alias("least"), F.count("*").alias("n")), "near-distinct")
    rooted = materialize(_rooted(distinct, _similar_pairs(prints, texts, shingle, similarity, how, block_rows)), "near-roots")
    total = prints.count()
    gone = spread_join(prints.select("node", "key"), rooted, ["node"], "n", total).where(F.col("key") != F.col("component_id.key")).select(F.col("key").alias("__gone")).distinct()
    gone = materialize(gone, "near-gone")
    (key,) = unused(docs.columns, "__key")
    maybe, stays = split_by_keys(docs, _key(id_col, text), gone)
    columns = [column(c) for c in docs.columns]
    left = maybe.withColumn(key, _key(id_col, text)).join(gone, F.col(key) == gone["__gone"], "left_anti").select(columns)
    kept = stays.unionByName(left)
    twice = materialize(prints.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("__twice")), "near-twice")
    if twice.isEmpty():
        return kept
    maybe, once = split_by_keys(kept, _key(id_col, text), twice)
    keyed = maybe.withColumn(key, _key(id_col, text))
    again = keyed.join(twice, F.col(key) == twice["__twice"], "left_semi").dropDuplicates([key])
    return once.unionByName(keyed.join(twice, F.col(key) == twice["__twice"], "left_anti").select(columns)).unionByName(again.select(columns))
