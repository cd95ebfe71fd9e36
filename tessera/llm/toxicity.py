"""Toxic passages by maximum-scoring segments.

Training counts the documents with each word by label over a bounded sample of labelled documents and turns
them into log-odds with an informative Dirichlet prior (the prior is the pooled
counts), for whole words and for word beginnings, which carry over to inflections that
the sample lacks. A word's score is its log-odds where they are significant, else
those of its beginning, less a small drift that makes the mean of clean text negative.

Scoring finds, in one pass over a document's words, all maximal segments: passages
whose score no extension or part exceeds. Their scores follow an extreme-value law in
clean text: a passage of score S in n words is exceeded by chance K n exp(-lambda S)
times. Lambda and K come from clean documents of a part of the sample that the log-odds
have not seen. The significance of a document's best passage and the summed significance
of all significant ones give its probability by a logistic fit on that same part.

Defined cases: a null or empty text has no passage and gets the probability that goes
with none; unlabelled rows are scored but not learned from; labels that are null are no
labels; where either class is missing in training nothing is learned: every score is the base
rate of the labels (0 without any), and ``drop_toxic`` keeps every document; very long texts
are scored whole; repeated rows score alike; an empty table gives an empty result; other
columns are ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWERING, column, give_back, materialize, slices

#: Documented bound: labelled rows that are learned from.
SAMPLE_ROWS = 50_000
#: Characters of a word's beginning.
BEGINNING = 5
#: Weight of the prior, as a share of all counted words.
PRIOR = 0.05
SIGNIFICANT_Z = 2.5
DRIFT = 0.05
THRESHOLD = 0.3
#: A passage is significant if chance gives fewer than this many as good in a document of its length.
EXPECTED = 0.05
FLUSH = 400_000


@dataclass
class ToxicityModel:
    words: dict = field(default_factory=dict)
    beginnings: dict = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    #: Of the logistic fit; None where nothing was learned.
    weights: tuple | None = None
    base_rate: float = 0.0

    def __post_init__(self):
        self.seen = _Scores(self)


class _Scores(dict):
    """Scores of words met so far; unknown ones get the drift alone."""

    MOST = 100_000

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= self.MOST:
            self.clear()
        known = self.model.words.get(word)
        out = self[word] = (self.model.beginnings.get(word[:BEGINNING], 0.0) if known is None else known) - DRIFT
        return out

    def __reduce__(self):
        return _Scores, (self.model,)


def _words(text: str | None) -> list[str]:
    return [] if text is None else text.encode().translate(LOWERING).decode().split()


def word_scores(words: list[str], model: ToxicityModel) -> np.ndarray:
    return np.fromiter(map(model.seen.__getitem__, words), np.float64, len(words))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time.

    Each positive score opens a candidate with the running totals before and behind it.
    A candidate joins the nearest earlier one that starts lower, if it also ends higher.
    """
    total = np.cumsum(scores)
    found: list[tuple[int, int, float, float]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        start, low, high = i, float(total[i] - scores[i]), float(total[i])
        j = len(found) - 1
        while j >= 0:
            if found[j][2] >= low:
                j -= 1
            elif found[j][3] >= high:
                break
            else:
                start, low = found[j][0], found[j][2]
                del found[j:]
                j = len(found) - 1
        found.append((start, i + 1, low, high))
    return [(a, b, high - low) for a, b, low, high in found]


def significance(segments: list, n: int, model: ToxicityModel) -> tuple[float, float, int]:
    """-ln of the best passage's expected number by chance, the sum over significant ones, and their number."""
    best, total, many = 0.0, 0.0, 0
    for _, _, s in segments:
        bits = model.lam * s - math.log(max(model.k * n, 1e-9))
        best = max(best, bits)
        if bits > -math.log(EXPECTED):
            total += bits
            many += 1
    return best, total, many


def probability(best: float, total: float, model: ToxicityModel) -> float:
    if model.weights is None:
        return model.base_rate
    a, b, c = model.weights
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(best) + c * math.log1p(total)))))


def rating(text: str | None, model: ToxicityModel) -> tuple[float, int, float]:
    """(probability, number of significant passages, the best one's significance) of a text."""
    words = _words(text)
    best, total, many = significance(maximal_segments(word_scores(words, model)), max(1, len(words)), model)
    return probability(best, total, model), many, best


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, train: F.Column, rows: int) -> DataFrame:
    """doc_id, text, label, part (0, 1: log-odds; 2: calibration) of at most ``rows`` labelled training rows, by hash."""
    known = labels.select(column(id_col).cast("long").alias("doc_id"), column(label).cast("int").alias("label")).where(train & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.withColumn("h", F.xxhash64(F.lit("toxic"), "doc_id")).orderBy("h", "doc_id").limit(rows)
    slim = _slim(docs, id_col, text)
    return slim.join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod("h", F.lit(3)))


def _count(sample: DataFrame) -> DataFrame:
    """kind (0 word, 1 beginning), term, clean, toxic over parts 0 and 1."""

    def run(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def rows():
            terms = set(counts[0]) | set(counts[1])
            data = [(k, t, counts[0][(k, t)], counts[1][(k, t)]) for k, t in terms]
            for c in counts:
                c.clear()
            return pd.DataFrame(data, columns=["kind", "term", "clean", "toxic"])

        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["label"], strict=True):
                seen = set(_words(t))
                counts[y].update((0, w) for w in seen)
                counts[y].update((1, b) for b in {w[:BEGINNING] for w in seen})
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield rows()
        yield rows()
        give_back()

    part = sample.where("part < 2").select("text", "label").mapInPandas(run, "kind int, term string, clean long, toxic long")
    return part.groupBy("kind", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _log_odds(counts: DataFrame, totals: dict) -> list:
    """Significant terms with their log-odds; no more than the words of the bounded sample."""
    frames = None
    for kind, (clean, toxic) in totals.items():
        pooled = F.col("clean") + F.col("toxic")
        weight = PRIOR * (clean + toxic)
        prior = pooled * PRIOR
        t, c = F.col("toxic") + prior, F.col("clean") + prior
        odds = F.log(t / (toxic + weight - t)) - F.log(c / (clean + weight - c))
        own = counts.where((F.col("kind") == kind) & (pooled >= 2)).select("kind", "term", odds.alias("odds"), (odds / F.sqrt(1 / t + 1 / c)).alias("z"))
        frames = own if frames is None else frames.unionByName(own)
    return frames.where(F.abs("z") >= SIGNIFICANT_Z).select("kind", "term", "odds").collect()


def _gumbel(maxima: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """lambda and K of clean documents' best scores by the moments of S - ln(n) / lambda."""
    lam = 1.0
    for _ in range(50):
        x = maxima - np.log(lengths) / lam
        spread = max(float(x.std()), 1e-3)
        new = min(max(math.pi / (spread * math.sqrt(6)), 0.05), 5.0)
        if abs(new - lam) < 1e-6:
            break
        lam = 0.5 * (lam + new)
    mode = float((maxima - np.log(lengths) / lam).mean()) - 0.5772156649 / lam
    return lam, math.exp(min(max(lam * mode, -30.0), 30.0))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Weights (intercept first) and penalised loss by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-3, *[ridge] * x.shape[1]])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    z = np.clip(a @ w, -30, 30)
    return w, float((np.log1p(np.exp(z)) - y * z).sum() + 0.5 * w @ penalty @ w)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple:
    """Intercept and slopes that are not negative: the best fit among those over part of the features that has none."""
    best = None
    for use in itertools.chain.from_iterable(itertools.combinations(range(x.shape[1]), k) for k in range(x.shape[1], -1, -1)):
        w, loss = _newton(x[:, list(use)], y, ridge)
        if (w[1:] >= 0).all() and (best is None or loss < best[1]):
            full = np.zeros(1 + x.shape[1])
            full[[0, *(1 + i for i in use)]] = w
            best = full, loss
    return tuple(float(v) for v in best[0])


def _slim(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, train_rows: F.Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learns from labelled rows that ``train_rows`` (over doc_id) admits."""
    spark = docs.sparkSession
    sample = materialize(_sample(docs, labels, id_col, text, label, train_rows, rows), "toxicity-sample")
    counts = materialize(_count(sample), "toxicity-counts")
    totals = {r["kind"]: (r["c"], r["t"]) for r in counts.groupBy("kind").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).collect()}
    model = ToxicityModel()
    labelled, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    model.base_rate = toxic / labelled if labelled else 0.0
    if not totals or not all(c and t for c, t in totals.values()):
        return model
    for r in _log_odds(counts, totals):
        (model.beginnings if r["kind"] else model.words)[r["term"]] = float(r["odds"])
    shared = spark.sparkContext.broadcast(model)

    def segments(batches):
        for pdf in batches:
            rows_ = []
            for t, y in zip(pdf["text"], pdf["label"], strict=True):
                words = _words(t)
                rows_.append((int(y), max(1, len(words)), [s for _, _, s in maximal_segments(word_scores(words, shared.value))]))
            yield pd.DataFrame(rows_, columns=["y", "n", "scores"])

    found = materialize(sample.where("part = 2").select("text", "label").mapInPandas(segments, "y int, n long, scores array<double>"), "toxicity-segments")
    tops = found.select("y", "n", F.coalesce(F.array_max("scores"), F.lit(0.0)).alias("top")).collect()
    if len({r["y"] for r in tops}) < 2:
        return model
    y, n, top = (np.array([r[k] for r in tops], float) for k in ("y", "n", "top"))
    clean = (y == 0) & (n > 1)
    if clean.sum() >= 10:
        model.lam, model.k = _gumbel(top[clean], n[clean])

    def features(batches):
        for pdf in batches:
            sums = [significance([(0, 0, s) for s in scores], n_, model)[:2] for n_, scores in zip(pdf["n"], pdf["scores"], strict=True)]
            yield pd.DataFrame({"y": pdf["y"], "best": [b for b, _ in sums], "total": [t for _, t in sums]}).astype({"best": float, "total": float})

    held = found.mapInPandas(features, "y int, best double, total double").collect()
    y = np.array([r["y"] for r in held], float)
    x = np.array([(r["best"], r["total"]) for r in held])
    model.weights = _logistic(np.log1p(x), y)
    shared.destroy()
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, passages (number of significant ones), best (the best passage's significance)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [pa.float64(), pa.int64(), pa.float64()]

    def run(batches):
        for batch in slices(batches):
            rows = [rating(t, shared.value) for t in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "score", "passages", "best"])
        give_back()

    return _slim(docs, id_col, text).mapInArrow(run, "doc_id long, score double, passages long, best double")


def passages(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per significant passage: doc_id, first_word, last_word, score, expected (by chance), passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "first_word", "last_word", "score", "expected", "passage"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]

    def run(batches):
        m = shared.value
        for batch in slices(batches):
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _words(t)
                for a, b, s in maximal_segments(word_scores(words, m)):
                    expected = m.k * len(words) * math.exp(-m.lam * s)
                    if expected < EXPECTED:
                        rows.append((d, a, b - 1, s, expected, " ".join(words[a:b])))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return _slim(docs, id_col, text).mapInArrow(run, "doc_id long, first_word long, last_word long, score double, expected double, passage string")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    model = train(docs, labels, ~held_out(), id_col, text)
    if model.weights is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series([rating(t, shared.value)[0] for t in texts], dtype=float)

    return docs.where(rate(column(text).cast("string")) < threshold)
