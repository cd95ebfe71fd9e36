"""Scoring formulas as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
RRF_K = 60
DECAY_RATE = 0.693  # fixed value, not ln 2
#: Weights of the lists by query shape; lists not named weigh 1.
WEIGHT_PROFILES = {
    "exact_token": {"bm25": 1.4, "memgraph": 1.4, "vector": 1.0, "temporal": 0.9},
    "temporal": {"temporal": 1.4, "vector": 1.0, "bm25": 1.0, "memgraph": 1.0},
    "person": {"memgraph": 1.5, "vector": 1.0, "bm25": 1.0, "temporal": 0.9},
    "general": {},
}
REWARDS = {"useful": 1.0, "clicked": 0.7, "irrelevant": 0.0}


def idf(documents: Column, df: Column) -> Column:
    return F.log(1 + (documents - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, mean: Column, idf_: Column, k1: float = K1, b: float = B) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(mean, F.lit(1.0))))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000.0


def decay(last_accessed: Column, access_count: Column, now: Column, half_life: float = 30.0) -> Column:
    """Forgetting curve, slower for what was accessed often; 1 if never accessed, never under 0.1."""
    strength = half_life * (1 + 0.2 * F.least(F.greatest(F.coalesce(access_count, F.lit(0)), F.lit(0)), F.lit(10)))
    days = F.greatest(days_between(now, last_accessed), F.lit(0.0))
    return F.when(last_accessed.isNull(), 1.0).otherwise(F.greatest(F.lit(0.1), F.exp(-DECAY_RATE * days / strength)))


def freshness(ts: Column, now: Column, half_life: float = 14.0) -> Column:
    """1 for now, half after ``half_life`` days, 0.5 for unknown."""
    days = F.greatest(days_between(now, ts), F.lit(0.0))
    return F.when(ts.isNull(), 0.5).otherwise(F.exp(-math.log(2) * days / half_life))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def ucb(q: Column, n: Column, total: Column, samples: int = 10, exploration: float = 0.1) -> Column:
    """Value with a bonus while it rests on few samples."""
    bonus = F.when(n == 0, exploration).otherwise(exploration * F.sqrt(F.log(F.greatest(total, F.lit(1))) / F.greatest(n, F.lit(1))))
    return F.when(n < samples, q + bonus).otherwise(q)


def hub_penalty(degree: Column, p90: Column, top: Column, floor: float = 0.4) -> Column:
    return F.when(degree > p90, F.greatest(F.lit(floor), 1 - (1 - floor) * (degree - p90) / F.greatest(top - p90, F.lit(1)))).otherwise(1.0)
