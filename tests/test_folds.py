"""Folds that are composed from slices of time, against loops in order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tessera.operators import state
from tessera.streaming import streams

T0 = datetime(2024, 1, 1)


def rewards(n, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice("aaab"), T0 + timedelta(seconds=rnd.randint(0, n // 2)), i, rnd.choice([0.0, 0.3, 1.0, None, rnd.random()])) for i in range(n)]


def plain_q(rows, table=None, alpha=0.15, decay=0.995, default=0.5, low=0.05, high=0.95):
    out = dict(table or {})
    for k, _, _, r in sorted(rows, key=lambda x: (x[1], x[2])):
        q, n = out.get(k, (default, 0))
        if r is not None:
            q = q * decay + default * (1 - decay)
            q = max(low, min(high, q + alpha * (r - q)))
        out[k] = (q, n + 1)
    return out


SCHEMA = "source string, ts timestamp, event_id int, reward double"


@pytest.mark.parametrize("alpha", [0.15, 0.9])
def test_composed_q_equals_the_loop(spark, alpha):
    rows = rewards(600)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.source: (r.q, r.n) for r in state.q_fold(df, ["source"], ["ts", "event_id"], alpha=alpha, low=0.3, high=0.6).collect()}
    want = plain_q(rows, alpha=alpha, low=0.3, high=0.6)
    assert got.keys() == want.keys()
    for k, (q, n) in want.items():
        assert got[k] == (pytest.approx(q, abs=1e-12), n)


def test_a_key_is_spread_over_slices(spark):
    df = spark.createDataFrame([("a", *r[1:]) for r in rewards(400)], SCHEMA)
    steps = state.q_steps(df)
    slices = steps.repartitionByRange(4, "ts", "event_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(slices) == 4 and max(r["count"] for r in slices) < 250
    plan = state.fold_maps(steps.select("source", "ts", "event_id", "a", "b", "low", "high"), ["source"], ["ts", "event_id"])
    assert plan.first().n == 400


def test_a_table_is_brought_forward(spark):
    rows = sorted(rewards(300), key=lambda x: (x[1], x[2]))
    old, new = rows[:200], [r for r in rows[200:] if r[0] == "a"] + [("c", *rows[-1][1:])]
    table = state.q_fold(spark.createDataFrame(old, SCHEMA), ["source"], ["ts", "event_id"])
    got = {r.source: (r.q, r.n) for r in state.q_update(table, spark.createDataFrame(new, SCHEMA), ["source"], ["ts", "event_id"]).collect()}
    want = plain_q(new, plain_q(old))
    assert set(got) == {"a", "b", "c"} and all(got[k] == (pytest.approx(q, abs=1e-12), n) for k, (q, n) in want.items())
    assert state.q_fold(spark.createDataFrame([], SCHEMA), ["source"], ["ts", "event_id"]).count() == 0


def requests(n=800, seed=2):
    rnd, t, out = random.Random(seed), {"x": T0, "y": T0, None: T0}, []
    for i in range(n):
        k = rnd.choice(["x", "x", "x", "y", None])
        t[k] += timedelta(seconds=rnd.choice([0, 0, 0.2, 1, 2.5, 40]))
        out.append((k, i, t[k]))
    return out


def plain_bucket(rows, rate, capacity):
    out, held = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        tokens, then = held.get(k, (capacity, t))
        tokens = min(capacity, tokens + (t - then).total_seconds() * rate)
        out[i] = tokens >= 1
        held[k] = (tokens - out[i], t)
    return out


@pytest.mark.parametrize(("rate", "capacity"), [(0.5, 5.0), (2.0, 3.0), (0.1, 1.5)])
def test_bucket_equals_the_loop(spark, rate, capacity):
    rows = requests()
    df = spark.createDataFrame(rows, "tenant_id string, event_id int, ts timestamp").repartition(6)
    got = {r.event_id: r.allowed for r in state.token_bucket(df, rate, capacity).collect()}
    want = plain_bucket(rows, rate, capacity)
    assert got == want and len(set(want.values())) == 2


def test_busy_periods_are_those_of_the_whole_history(spark):
    rows = requests(300)
    df = spark.createDataFrame([(k, i, int(t.timestamp() * 1e6)) for k, i, t in rows], "tenant_id string, event_id int, t long")
    got = {r.event_id: r.period for r in state.busy_periods(df, 10e6).collect()}
    want, last = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        p, then = last.get(k, (0, None))
        p += then is None or (t - then).total_seconds() >= 10
        last[k] = (p, t)
        want[i] = p
    assert got == want


def test_limiter_goes_on_across_batches(spark, tmp_path):
    rows = requests(120, 5)
    path = f"{tmp_path}/requests"
    for part in range(3):
        mine = rows[part * 40 : part * 40 + 40]
        spark.createDataFrame(mine, "tenant_id string, event_id int, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    files = streams.read(spark, path, schema, files=1)
    got = {r.event_id: r.allowed for r in streams.run_available(streams.limiter(files, 0.5, 4.0), "limiter_test").collect()}
    assert got == plain_bucket(rows, 0.5, 4.0)
