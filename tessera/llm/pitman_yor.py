"""Scores by a hierarchical Pitman-Yor language model.

Every word is a context: a restaurant whose customers are the words that follow it (the
start of a text is a context of its own). All contexts share one parent restaurant, the
words by themselves, whose base is uniform over the known words and one unknown. Gibbs
sweeps draw the number of tables of each (context, word) from its conditional given all
other tables: with c customers, t tables weigh as the generalised Stirling number S(c, t)
times the restaurant's and the parent's probability of opening them. A pair met once has
one table. The tables are the parent's customers, whose tables are drawn likewise.
Discounts and strengths of both levels are slice-sampled from the seating. Predictive
probabilities are averaged over the sweeps behind the burn-in.

S is exact for up to ``EXACT`` customers; beyond, ln S(c, t) - ln S(c, 1) is continued to its
limit, -(t - 1) ln d - ln (t - 1)!, from which it differs in proportion to c^-d. Restaurants
are seated side by side, each given the others' tables of the sweep before, as
distributed samplers do.

Layout, in rounds of messages between rows of packed arrays:
- a task packs the texts of a chunk: its words, its tokens as word numbers, and the counts of
  its pairs, which are dealt to a grid of cells by context and word hash, so that neither
  a common context nor a common word is gathered in one of them;
- a cell merges the chunks' pairs and keeps those met more than once, with their tables;
- a reducer adds up the tables of its share of the words, as contexts and as customers of the
  parent, seats the parent and tells the cells;
- at last cells and reducers answer each chunk for its own pairs and words, and the chunk
  scores its texts.
No task holds more than a chunk, a cell or a reducer's share, whose sizes are parameters and
whose numbers grow with the corpus; what a chunk is told is proportional to its text. Counts
cover the whole corpus. The driver sees sums and histograms of bounded size. Words are told
apart by 64-bit hashes. Seating is a pure function of counts, seed and the round's input, and
every round is written to the shared folder, so a lost task is simply computed again.

Defined cases: a null text counts as empty; an empty text is the end token alone; A-Z
are lowered and words split at ASCII white space, nothing else; a very long text is a chunk
by itself; a null id is a training row; repeated rows count and score singly; with no
training tokens every word is unknown; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERING, column, discard, give_back, materialize, slices

SWEEPS, BURN_IN = 5, 2
EXACT = 512
SEED = 7
CHUNK_BYTES = 8 << 20
CHUNK_DOCS = 100_000
#: Text behind a cell; there are as many reducers.
CELL_BYTES = 32 << 20
#: No word holds a line feed.
END, START = (xxhash.xxh3_64_intdigest(x) for x in (b"\n", b"\n\n"))

ENTRIES, TOKENS, COUNTS, WHERE, STATE, MESSAGE, REPLY, LEXICON, STAT, REQUEST, WORDS, PAIRS = range(12)
ROW = ["dest", "kind", "src", "data", "n"]
ROWS = "dest long, kind int, src long, data binary, n double"


# --- packed arrays ----------------------------------------------------------------

KINDS = ["|u1", "<u2", "<u4", "<u8", "<i8"]


def small(x: np.ndarray) -> np.ndarray:
    """Non-negative whole numbers in the least bytes that hold them."""
    most = int(x.max(initial=0))
    return x.astype(KINDS[0 if most < 1 << 8 else 1 if most < 1 << 16 else 2 if most < 1 << 32 else 3])


def pack(*arrays: np.ndarray) -> bytes:
    """Compressed, each array byte by byte of its numbers: the high ones are alike."""
    head = np.array([len(arrays), *(v for a in arrays for v in (KINDS.index(a.dtype.str), len(a)))], np.int64)
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * n)
    at, out = head.nbytes, []
    for kind, length in head[1:].reshape(-1, 2).tolist():
        size = int(KINDS[kind][-1])
        planes = np.frombuffer(raw, np.uint8, length * size, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).view(KINDS[kind]).reshape(length))
        at += length * size
    return out


def by_frequency(numbers: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers by falling frequency, each number's place there): small places are common, so they pack well."""
    order = np.argsort(-np.bincount(numbers, minlength=count), kind="stable")
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    return order, place


# --- seating ----------------------------------------------------------------------


class Hyper(NamedTuple):
    """Discount and strength of contexts and of their parent, the parent's customers and tables, and known words."""

    d: float = 0.75
    s: float = 1.0
    d0: float = 0.75
    s0: float = 1.0
    customers: float = 0.0
    tables: float = 0.0
    words: float = 0.0

    @property
    def unknown(self) -> float:
        """What the parent's base gives to each word, known or not, times the parent's total."""
        return (self.s0 + self.d0 * self.tables) / (self.words + 1)

    def parent(self, customers, tables, gone=0.0):
        """The parent's probability of words with so many customers and tables, after ``gone`` customers have left."""
        return (customers - self.d0 * tables + self.unknown) / (self.s0 + self.customers - gone)


def stirling(discount: float, size: int = EXACT) -> np.ndarray:
    """ln of the generalised Stirling numbers: row c, column t, for c customers at t tables."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(size):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = out[c, 1 : c + 2] + np.log(np.maximum(c - t * discount, 0))
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], stay)
    return out


def _log_factorials(n: int) -> np.ndarray:
    return np.r_[0.0, np.cumsum(np.log(np.arange(1, n)))]


def draw_tables(counts: np.ndarray, log_base: np.ndarray, others: np.ndarray, discount: float, strength: float, table: np.ndarray, rng, step: int = 500_000) -> np.ndarray:
    """Tables for each count: p(t) ~ S(count, t) prod_{j < t} (strength + discount (others + j)) base."""
    size = len(table) - 1
    out = np.minimum(counts, 1).astype(np.int64)
    order = np.argsort(counts, kind="stable")
    ranked = counts[order]
    uniform = rng.random(len(counts))

    def draw(at: np.ndarray, logs: np.ndarray) -> None:
        """logs: row by row of ``at``, ln S less a constant, for t = 1, 2, .."""
        width = logs.shape[1]
        rows = max(1, step // width)
        for i in range(0, len(at), rows):
            part = at[i : i + rows]
            opened = np.cumsum(np.log(strength + discount * (others[part][:, None] + np.arange(width))) + log_base[part][:, None], 1)
            logits = opened + (logs if len(logs) == 1 else logs[i : i + rows])
            cum = np.cumsum(np.exp(logits - logits.max(1, keepdims=True)), 1)
            out[part] = 1 + (cum < uniform[part][:, None] * cum[:, -1:]).sum(1)

    few = ranked <= size
    cuts = np.flatnonzero(np.diff(ranked[few])) + 1
    for at in np.split(order[few], cuts):
        if len(at) and (c := int(counts[at[0]])) > 1:
            draw(at, table[c : c + 1, 1 : c + 1])
    many = order[~few]
    if len(many):
        mean = (strength + discount * others[many]) * np.exp(log_base[many]) / discount
        out[many] = np.minimum(1 + rng.poisson(mean), counts[many])
        many = many[mean <= size / 4]  # others have so many tables that the limit holds and the table ends too early
        limit = -np.arange(size) * math.log(discount) - _log_factorials(size)
        gap = table[size, 1:] - table[size, 1] - limit
        for i in range(0, len(many), 2000):
            part = many[i : i + 2000]
            draw(part, limit + gap * ((size / counts[part]) ** discount)[:, None])
    return out


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x) -> np.ndarray:
    return np.asarray(_lgamma(x), float)


# Statistics are (code, weight) rows; a code is a kind of statistic and a number of bounded range.
PAIR, LARGE, TABLES, CUSTOMERS, TOTAL = (i << 40 for i in range(5))
PARENT = 8 << 40


def binned(x: np.ndarray) -> np.ndarray:
    """Whole numbers up to 4,095, larger ones by their first 12 bits."""
    shift = np.maximum(np.frexp(x.astype(float))[1] - 12, 0)
    return (x >> shift) << shift


def seating_stats(counts: np.ndarray, tables: np.ndarray, level: int) -> list[tuple[int, float]]:
    """Histogram of (customers, tables); beyond ``EXACT`` customers, what the limit of S needs."""
    few = (counts <= EXACT) & (counts > 1)
    codes, n = np.unique(counts[few] * (EXACT + 1) + tables[few], return_counts=True)
    out = [(level + PAIR + int(c), float(k)) for c, k in zip(codes.tolist(), n.tolist(), strict=True)]
    many = counts > EXACT
    return [*out, (level + LARGE, float(many.sum())), (level + LARGE + 1, float((tables[many] - 1).sum())), (level + LARGE + 2, float(np.log(counts[many]).sum()))]


def histogram(kind: int, x: np.ndarray) -> list[tuple[int, float]]:
    """Of the values over one, which alone say anything of a restaurant."""
    values, n = np.unique(binned(x[x > 1]), return_counts=True)
    return [(kind + int(v), float(k)) for v, k in zip(values.tolist(), n.tolist(), strict=True)]


class Evidence:
    """ln of the seating's probability as a function of one level's discount and strength."""

    def __init__(self, stats: dict[int, float], level: int):
        kind = {k: [] for k in (PAIR, LARGE, TABLES, CUSTOMERS)}
        for code, n in stats.items():
            if code & PARENT == level and (k := (code - level) >> 40 << 40) in kind:
                kind[k].append((code - level - k, n))
        codes, self.pairs = (np.array(x) for x in (zip(*sorted(kind[PAIR]), strict=True) if kind[PAIR] else ((), ())))
        self.at = codes.astype(np.int64) // (EXACT + 1), codes.astype(np.int64) % (EXACT + 1)
        self.size = int(self.at[0].max(initial=1))
        large = dict(kind[LARGE])
        self.large = large.get(0, 0.0), large.get(1, 0.0), large.get(2, 0.0)
        if level:
            self.tables = np.array([[stats.get(TOTAL + 1, 0.0)], [1.0]])
            self.customers = np.array([[stats.get(TOTAL, 0.0)], [1.0]])
        else:
            self.tables, self.customers = (np.array(sorted(kind[k])).reshape(-1, 2).T for k in (TABLES, CUSTOMERS))

    def __call__(self, d: float, s: float) -> float:
        t, n = self.tables
        c, m = self.customers
        out = float((n * (lgamma(s / d + np.maximum(t, 1)) - math.lgamma(s / d + 1) + (t - 1) * math.log(d))).sum())
        out -= float((m * (lgamma(s + np.maximum(c, 1)) - math.lgamma(s + 1))).sum())
        if len(self.pairs):
            out += float((self.pairs * stirling(d, self.size)[self.at]).sum())
        many, opened, logs = self.large
        return out - many * math.lgamma(1 - d) - opened * math.log(d) - d * logs

    def sample(self, d: float, s: float, rng) -> tuple[float, float]:
        """A draw of both by slices, with a uniform prior on d and an exponential one on s."""
        squash = lambda x: 1 / (1 + math.exp(-x))
        at_d = lambda x: self(squash(x), s) + math.log(squash(x) * squash(-x)) if abs(x) < 7 else -math.inf
        d = squash(slice_draw(at_d, math.log(d / (1 - d)), 0.1, rng))
        at_s = lambda y: self(d, math.exp(y)) - math.exp(y) + y if -9 < y < 9 else -math.inf
        return d, math.exp(slice_draw(at_s, math.log(s), 0.5, rng))


def slice_draw(log_p, x: float, width: float, rng, most: int = 30) -> float:
    """One slice-sampling step with stepping out."""
    level = log_p(x) + math.log(1 - rng.random())
    low = x - width * rng.random()
    high = low + width
    for _ in range(most):
        if log_p(low) <= level:
            break
        low, width = low - width, 2 * width
    for _ in range(most):
        if log_p(high) <= level:
            break
        high, width = high + width, 2 * width
    while high - low > 1e-9:
        new = low + (high - low) * rng.random()
        if log_p(new) > level:
            return new
        low, high = (new, high) if new < x else (low, new)
    return x


# --- chunks -------------------------------------------------------------------------


def is_held_out(doc: int | None) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def token_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([*map(digest, text.encode().translate(LOWERING).split()), END] if text else [END], np.uint64)


class Grid(NamedTuple):
    """side x side cells by context and word hash; a word's reducer is its line and share."""

    side: int
    shares: int

    def line(self, words: np.ndarray) -> np.ndarray:
        return (words % np.uint64(self.side)).astype(np.int64)

    def share(self, words: np.ndarray) -> np.ndarray:
        """Grows with the hash, so that a sorted list has each share in one piece."""
        return ((words >> np.uint64(32)) * np.uint64(self.shares) >> np.uint64(32)).astype(np.int64)

    def reducer(self, words: np.ndarray) -> np.ndarray:
        return self.line(words) * self.shares + self.share(words)


def grid_for(size: int) -> Grid:
    side = max(2, math.ceil(math.sqrt(size / CELL_BYTES)))
    return Grid(side, side)


def chunk_pairs(words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell, context, word) of the chunk's distinct pairs in that order, as word numbers, and each token's pair."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = np.searchsorted(words, np.uint64(START))
    line, n = grid.line(words), len(words)
    keys, pair = np.unique(((line[before] * grid.side + line[tokens]) * n + before) * n + tokens, return_inverse=True)
    return keys // (n * n), keys // n % n, keys % n, pair


def chunk_rows(chunk: int, ids: list, texts: list, grid: Grid) -> list[tuple]:
    """The chunk's tokens, and its pairs cell by cell."""
    hashes = [token_hashes(t) for t in texts]
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    hashes = np.concatenate([*hashes, np.array([START], np.uint64)])
    words, tokens = np.unique(hashes, return_inverse=True)
    del hashes
    tokens = tokens[:-1]
    held = np.array([is_held_out(d) for d in ids], bool)
    null = np.array([d is None for d in ids], bool)
    numbers = np.array([0 if d is None else d for d in ids], np.int64)
    order, place = by_frequency(tokens, len(words))
    out = [(chunk, TOKENS, 0, pack(numbers, null.astype(np.uint8), held.astype(np.uint8), small(sizes), words[order], small(place[tokens])), 0.0)]
    cell, context, word, pair = chunk_pairs(words, tokens, sizes, grid)
    counts = np.bincount(pair, weights=np.repeat(~held, sizes), minlength=len(cell)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True]) if len(cell) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first = np.flatnonzero(np.r_[True, context[a + 1 : b] != context[a : b - 1]])
        own, index = np.unique(word[a:b], return_inverse=True)
        order, place = by_frequency(index, len(own))
        out.append((int(cell[a]), ENTRIES, chunk, pack(words[context[a:b][first]], small(np.diff(np.r_[first, b - a])), words[own[order]], small(place[index]), small(counts[a:b])), 0.0))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=ROW)


def _chunked(docs: DataFrame, grid: Grid) -> DataFrame:
    def run(batches):
        # A task that is computed again reads the same rows in the same order, so chunks may be numbered.
        chunk = (TaskContext.get().partitionId() + 1) << 36
        ids, texts, size = [], [], 0

        def flush():
            columns = zip(*chunk_rows(chunk, ids, texts, grid), strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ROW)

        for batch in slices(batches):
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(d)
                texts.append(t)
                size += len(t or "")
                if size >= CHUNK_BYTES or len(ids) >= CHUNK_DOCS:
                    yield flush()
                    ids, texts, size, chunk = [], [], 0, chunk + 1
        if ids:
            yield flush()
        give_back()

    return docs.mapInArrow(run, ROWS)


# --- cells and reducers ---------------------------------------------------------------


def messages(cell: int, grid: Grid, contexts: np.ndarray, words: np.ndarray, opened: np.ndarray, customers: np.ndarray, seen: np.ndarray | None = None) -> list[tuple]:
    """To the reducers: tables by context, and the parent's customers by word (and, once, how often it was met)."""
    out = []
    for flag, keys, values in ((0, contexts, [opened]), (1, words, [customers] if seen is None else [customers, seen])):
        share = grid.share(keys)
        cuts = np.searchsorted(share, np.arange(grid.shares + 1))
        line = cell // grid.side if flag == 0 else cell % grid.side
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                out.append((line * grid.shares + s, MESSAGE, cell * 2 + flag, pack(keys[a:b], *(small(v[a:b]) for v in values)), 0.0))
    return out


def merge(pdf: pd.DataFrame, grid: Grid) -> pd.DataFrame:
    """A cell's pairs from those of the chunks, and where each chunk's are among them."""
    if pdf["kind"].iloc[0] == TOKENS:
        return pdf
    cell = int(pdf["dest"].iloc[0])
    blocks = [unpack(x) for x in pdf["data"]]
    contexts, words = (np.unique(np.concatenate([b[i] for b in blocks])) for i in (0, 2))
    keys = [np.repeat(np.searchsorted(contexts, b[0]), b[1]) * len(words) + np.searchsorted(words, b[2])[b[3]] for b in blocks]
    cuts = np.cumsum([0, *map(len, keys)])
    met = np.concatenate([b[4] for b in blocks])
    del blocks
    keys = np.concatenate(keys)
    pairs, at = np.unique(keys, return_inverse=True)
    del keys
    counts = np.bincount(at, weights=met, minlength=len(pairs)).astype(np.int64)
    del met
    rows = [(cell, COUNTS, 0, pack(small(counts)), 0.0)]
    for chunk, a, b in zip(pdf["src"], cuts[:-1], cuts[1:], strict=True):
        rows.append((cell, WHERE, int(chunk), pack(small(np.diff(at[a:b], prepend=0))), 0.0))
    live = counts > 0
    context, word, counts = pairs[live] // len(words), pairs[live] % len(words), counts[live]
    (own, context), (met, word) = (np.unique(x, return_inverse=True) for x in (context, word))
    once = counts == 1
    by = lambda x, n, w=None: np.bincount(x, weights=w, minlength=n).astype(np.int64)
    contexts, words = contexts[own], words[met]
    more = ~once
    state = (by(context[once], len(own)), by(word[once], len(met)), context[more], word[more], counts[more], np.ones(more.sum(), np.int64))
    rows.append((cell, STATE, 0, pack(contexts, words, *map(small, state)), 0.0))
    rows += messages(cell, grid, contexts, words, by(context, len(own)), by(word, len(met)), by(word, len(met), counts))
    rows += [(code, STAT, 0, b"", n) for code, n in seating_stats(counts[more], state[-1], 0)]
    return _frame(rows)


def reduce(pdf: pd.DataFrame, sweep: int, hyper: Hyper) -> pd.DataFrame:
    """Sums of a share's words, the parent's seating, and the answers to the cells."""
    dest = int(pdf["dest"].iloc[0])
    pdf = pdf.sort_values("src", kind="stable")
    rng = np.random.default_rng([SEED, 1, sweep, dest])
    blocks = [(int(src), unpack(x)) for src, x in zip(pdf["src"], pdf["data"], strict=True)]
    sums = []
    for flag in (0, 1):
        own = [b for src, b in blocks if src % 2 == flag]
        keys, at = np.unique(np.concatenate([np.empty(0, np.uint64), *(b[0] for b in own)]), return_inverse=True)
        add = lambda i: np.bincount(at, weights=np.concatenate([np.empty(0), *(b[i] for b in own)]), minlength=len(keys)).astype(np.int64)  # noqa: B023, E731
        sums.append((keys, at, add(1), add(2) if own and len(own[0]) > 2 else None))
    (contexts, in_contexts, opened, _), (words, in_words, customers, seen) = sums
    n = len(words)
    base = np.full(n, -math.log((hyper.words or n) + 1))  # the first round does not know the number of words yet
    tables = draw_tables(customers, base, np.full(n, max(0.0, hyper.tables - 1)), hyper.d0, hyper.s0, stirling(hyper.d0, min(EXACT, int(customers.max(initial=1)))), rng)
    rows, at = [], [0, 0]
    for src, b in blocks:
        flag, k = src % 2, len(b[0])
        where = (in_words if flag else in_contexts)[at[flag] : at[flag] + k]
        at[flag] += k
        rows.append((src // 2, REPLY, flag << 40 | dest, pack(small(customers[where]), small(tables[where])) if flag else pack(small(opened[where])), 0.0))
    rows.append((dest, LEXICON, sweep, pack(contexts, small(opened), words, small(customers), small(tables), *([] if seen is None else [small(seen)])), 0.0))
    stats = [(TOTAL, float(customers.sum())), (TOTAL + 1, float(tables.sum())), (TOTAL + 2, float(n)), *seating_stats(customers, tables, PARENT)]
    if seen is not None:
        stats += [(TOTAL + 3, float(seen.sum())), (TOTAL + 4, float(seen[words == np.uint64(END)].sum()))]
    stats += histogram(TABLES, opened)
    if seen is not None:  # a word has as many customers as a context as it was met
        stats += histogram(CUSTOMERS, seen[words != np.uint64(END)])
    rows += [(code, STAT, 0, b"", x) for code, x in stats]
    return _frame(rows)


def sweep_cell(pdf: pd.DataFrame, sweep: int, hyper: Hyper, grid: Grid, keep: bool) -> pd.DataFrame:
    """New tables of a cell's repeated pairs, given what the reducers tell."""
    cell = int(pdf["dest"].iloc[0])
    contexts, words, once_c, once_w, context, word, counts, tables, *kept = unpack(pdf.loc[pdf["kind"] == STATE, "data"].iloc[0])
    told = pdf[pdf["kind"] == REPLY].sort_values("src", kind="stable")
    flags = told["src"].to_numpy() >> 40
    answers = [[unpack(x) for x in told["data"][flags == f]] for f in (0, 1)]
    joined = lambda part, i: np.concatenate([np.empty(0, np.int64), *(x[i] for x in part)]).astype(np.int64)
    opened, customers, parents = joined(answers[0], 0), joined(answers[1], 0), joined(answers[1], 1)
    context, word, counts, tables = (x.astype(np.int64) for x in (context, word, counts, tables))
    rest = customers[word] - tables
    base = hyper.parent(rest, np.minimum(parents[word], rest), tables)
    rng = np.random.default_rng([SEED, 0, sweep, cell])
    tables = draw_tables(counts, np.log(base), opened[context] - tables, hyper.d, hyper.s, stirling(hyper.d, min(EXACT, int(counts.max(initial=1)))), rng)
    by = lambda x, n: np.bincount(x, weights=tables, minlength=n).astype(np.int64)
    state = pack(contexts, words, once_c, once_w, small(context), small(word), small(counts), small(tables), *kept, *([small(tables)] if keep else []))
    rows = [(cell, STATE, 0, state, 0.0)]
    rows += messages(cell, grid, contexts, words, once_c + by(context, len(contexts)), once_w + by(word, len(words)))
    rows += [(code, STAT, 0, b"", n) for code, n in seating_stats(counts, tables, 0)]
    return _frame(rows)


def answer_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """To each chunk of a cell: count and sampled tables of its pairs."""
    cell = int(pdf["dest"].iloc[0])
    (counts,) = unpack(pdf.loc[pdf["kind"] == COUNTS, "data"].iloc[0])
    kept = unpack(pdf.loc[pdf["kind"] == STATE, "data"].iloc[0])[8:]
    full = []
    for tables in kept:
        x = (counts > 0).astype(tables.dtype)
        x[counts > 1] = tables
        full.append(x)
    rows = []
    for row in pdf[pdf["kind"] == WHERE].itertuples():
        at = np.cumsum(unpack(row.data)[0].astype(np.int64))
        rows.append((row.src, PAIRS, cell, pack(*(small(x[at]) for x in (counts, *full))), 0.0))
    return _frame(rows)


def answer_words(pdf: pd.DataFrame, samples: int) -> pd.DataFrame:
    """To each chunk, for its words: how often met, then by sample tables as a context, the parent's customers and tables."""
    dest = int(pdf["dest"].iloc[0])
    lexicon = [unpack(x) for x in pdf[pdf["kind"] == LEXICON].sort_values("src")["data"]]

    def look(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(want), np.int64)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, values[at], 0).astype(np.int64)

    rows = []
    for row in pdf[pdf["kind"] == REQUEST].itertuples():
        (want,) = unpack(row.data)
        out = [look(lexicon[0][2], lexicon[0][5], want)] if lexicon else [np.zeros(len(want), np.int64)] * (1 + 3 * samples)
        for contexts, opened, words, customers, tables, *_ in lexicon[1:]:
            out += [look(contexts, opened, want), look(words, customers, want), look(words, tables, want)]
        rows.append((row.src, WORDS, dest, pack(*map(small, out)), 0.0))
    return _frame(rows)


def requests(tokens: DataFrame, grid: Grid) -> DataFrame:
    """The words of each chunk, by reducer."""

    def run(batches):
        for pdf in batches:
            for chunk, data in zip(pdf["dest"], pdf["data"], strict=True):
                words = np.sort(unpack(data)[4])
                dest = grid.reducer(words)
                order = np.argsort(dest, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(dest[order]) > 0, True])
                yield _frame([(int(dest[order[a]]), REQUEST, int(chunk), pack(words[order[a:b]]), 0.0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    return tokens.select("dest", "data").mapInPandas(run, ROWS)


RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_chunk(pdf: pd.DataFrame, grid: Grid, samples: list[Hyper], train_tokens: int, train_texts: int) -> pd.DataFrame:
    """A row per text of the chunk."""
    ids, null, held, sizes, words, tokens = unpack(pdf.loc[pdf["kind"] == TOKENS, "data"].iloc[0])
    order = np.argsort(words)
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    words, tokens, sizes = words[order], number[tokens], sizes.astype(np.int64)
    _, context, word, pair = chunk_pairs(words, tokens, sizes, grid)
    about = [unpack(x) for x in pdf[pdf["kind"] == PAIRS].sort_values("src")["data"]]
    count, *tables = (np.concatenate([b[i] for b in about]) for i in range(1 + len(samples)))
    del about
    order = np.argsort(grid.reducer(words), kind="stable")
    told = [unpack(x) for x in pdf[pdf["kind"] == WORDS].sort_values("src")["data"]]
    by_word = np.empty((1 + 3 * len(samples), len(words)))
    for i in range(len(by_word)):
        by_word[i, order] = np.concatenate([b[i] for b in told])
    seen, *rest = by_word
    customers = np.where(words == np.uint64(START), train_texts, seen)[context]
    p = np.zeros(len(pair) if not len(count) else len(count))
    for i, h in enumerate(samples):
        opened, met, parents = rest[3 * i : 3 * i + 3]
        own = np.maximum(count - h.d * tables[i], 0) / (h.s + customers)
        p += own + (h.s + h.d * opened[context]) / (h.s + customers) * h.parent(met, parents)[word]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    add = lambda x: np.bincount(doc, weights=x, minlength=len(sizes))
    known = samples[-1].words if samples else 0
    base = np.log10((seen + 0.1) / (train_tokens + 0.1 * (known + 1)))
    return pd.DataFrame(
        {
            "doc_id": pd.arrays.IntegerArray(ids.copy(), null.astype(bool)), "held_out": held > 0, "n_tokens": sizes, "n_known": add(seen[tokens] > 0).astype(np.int64),
            "train_tokens": train_tokens, "base_score": add(base[tokens]), "score": add(np.log10(p / len(samples))[pair]),
        }
    )


# --- rounds ---------------------------------------------------------------------------


def _stats(*tables: DataFrame) -> dict[int, float]:
    """Sums by code, of bounded number."""
    out: dict[int, float] = {}
    for t in tables:
        for r in t.where(F.col("kind") == STAT).groupBy("dest").agg(F.sum("n").alias("n")).collect():
            out[r["dest"]] = out.get(r["dest"], 0.0) + r["n"]
    return out


def _exchange(rows: DataFrame, parts: int, step) -> DataFrame:
    return rows.repartition(parts, "dest").groupBy("dest").applyInPandas(_freed(step), ROWS)


def _freed(step):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = step(pdf)
        give_back()
        return out

    return run


def _of(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds))


def new_hyper(hyper: Hyper, stats: dict[int, float], sweep: int, fixed: bool) -> Hyper:
    """Totals of the round, and new discounts and strengths."""
    hyper = hyper._replace(customers=stats.get(TOTAL, 0.0), tables=stats.get(TOTAL + 1, 0.0), words=stats.get(TOTAL + 2, 0.0))
    if fixed or not hyper.words:
        return hyper
    rng = np.random.default_rng([SEED, 2, sweep])
    d, s = Evidence(stats, 0).sample(hyper.d, hyper.s, rng)
    d0, s0 = Evidence(stats, PARENT).sample(hyper.d0, hyper.s0, rng)
    return hyper._replace(d=d, s=s, d0=d0, s0=s0)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN, hyper: Hyper | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities). With ``hyper``, discounts and strengths stay."""
    slim = docs.select(column(id_col).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    if "Exchange" in slim._jdf.queryExecution().executedPlan().toString():
        slim = materialize(slim, "lm-texts")  # behind a shuffle a task's rows may come in another order when it is computed again
    grid = grid_for(slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    cells, reducers = grid.side**2, grid.side * grid.shares
    fixed, hyper = hyper is not None, hyper or Hyper()
    merged = materialize(_exchange(_chunked(slim, grid), cells, lambda pdf: merge(pdf, grid)), "lm-cells", by="kind")
    state, customers = _of(merged, STATE), {}
    rows, lexica, samples = merged, [], []
    for sweep in range(sweeps + 1):
        told = materialize(_exchange(_of(rows, MESSAGE), reducers, lambda pdf, s=sweep, h=hyper: reduce(pdf, s, h)), f"lm-reduce-{sweep}", by="kind")
        stats = _stats(rows, told)
        # Customers of contexts do not change; the first round tells them.
        customers = customers or {k: v for k, v in stats.items() if CUSTOMERS <= k < TOTAL or k in (TOTAL + 3, TOTAL + 4)}
        hyper = new_hyper(hyper, {**stats, **customers}, sweep, fixed)
        if sweep > burn_in:
            samples.append(hyper)
        if not sweep or sweep > burn_in:
            lexica.append(_of(told, LEXICON))
        else:
            discard(told, part=f"kind={LEXICON}")
        if sweep < sweeps:
            step = lambda pdf, s=sweep, h=hyper, k=sweep >= burn_in: sweep_cell(pdf, s, h, grid, k)
            now = materialize(_exchange(state.unionByName(_of(told, REPLY)), cells, step), f"lm-sweep-{sweep}", by="kind")
            for kind in (STATE, MESSAGE):
                discard(rows, part=f"kind={kind}")
            discard(told, part=f"kind={REPLY}")
            rows, state = now, _of(now, STATE)
    tokens = _of(merged, TOKENS)
    discard(rows, part=f"kind={MESSAGE}")
    pairs = materialize(_exchange(_of(merged, COUNTS, WHERE).unionByName(state), cells, answer_pairs), "lm-pairs")
    discard(rows)
    for kind in (COUNTS, WHERE):
        discard(merged, part=f"kind={kind}")
    asked = requests(tokens, grid)
    for lexicon in lexica:
        asked = asked.unionByName(lexicon)
    about = materialize(_exchange(asked, reducers, lambda pdf: answer_words(pdf, len(samples))), "lm-words")
    train_tokens, train_texts = int(customers.get(TOTAL + 3, 0)), int(customers.get(TOTAL + 4, 0))
    final = _freed(lambda pdf: score_chunk(pdf, grid, samples, train_tokens, train_texts))
    return tokens.unionByName(pairs).unionByName(about).groupBy("dest").applyInPandas(final, SCHEMA)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity a token of the held-out and of the training documents, by the model and by the base."""
    return scores.groupBy("held_out").agg(
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity")
    )
