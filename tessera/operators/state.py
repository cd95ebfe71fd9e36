"""Learning state as event tables, and the folds over them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring


def reward(signal: Column, override: Column | None = None) -> Column:
    """Reward of a feedback signal; an override between 0 and 1 wins."""
    table = F.create_map([F.lit(x) for k, v in scoring.REWARDS.items() for x in (k, v)])
    base = table[signal]
    return base if override is None else F.when(override.between(0, 1), override).otherwise(base)


def _clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def _then(f: Column, g: Column) -> Column:
    """The map that f and after it g make; maps are x -> clamp(a x + b, low, high) with a >= 0, and such maps compose to one."""
    through = lambda x: g["a"] * x + g["b"]
    bound = lambda x: _clamp(through(x), g["low"], g["high"])
    return F.struct((g["a"] * f["a"]).alias("a"), through(f["b"]).alias("b"), bound(f["low"]).alias("low"), bound(f["high"]).alias("high"), (f["n"] + g["n"]).alias("n"))


def fold_maps(steps: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, a, b, low, high, n: what all steps of a key come to, as one map of its start.

    steps: keys, order, and a step's a, b, low, high. Rows are dealt by ``order`` to slices of time, however many a key has;
    each slice of a key becomes one map, and only these few meet by key. So no key's history is in one task.
    """
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).cast("long").alias("n"))
    parts = ["a", "b", "low", "high", "n"]
    sliced = steps.withColumn("n", F.lit(1).cast("long")).repartitionByRange(*order).withColumn("__slice", F.spark_partition_id())
    gathered = sliced.groupBy(*keys, "__slice").agg(F.array_sort(F.collect_list(F.struct(*order, *parts))).alias("__steps"))
    maps = gathered.select(*keys, "__slice", F.aggregate("__steps", one, _then).alias("m")).select(*keys, "__slice", "m.*")
    met = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__slice", *parts))).alias("__steps"))
    return met.select(*keys, F.aggregate("__steps", one, _then).alias("m")).select(*keys, "m.*")


def q_steps(feedback: DataFrame, alpha: float = 0.15, decay: float = 0.995, default: float = 0.5, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rewards as maps of the learned value: drift towards the default, then a step to the reward. A null reward changes nothing."""
    known = F.col("reward").isNotNull()
    a = F.when(known, (1 - alpha) * decay).otherwise(1.0)
    b = F.when(known, (1 - alpha) * default * (1 - decay) + alpha * F.col("reward")).otherwise(0.0)
    return feedback.select("*", a.alias("a"), b.alias("b"), F.when(known, low).otherwise(F.lit(float("-inf"))).alias("low"), F.when(known, high).otherwise(F.lit(float("inf"))).alias("high"))


def q_fold(feedback: DataFrame, keys: list[str], order: list[str], alpha: float = 0.15, decay: float = 0.995, default: float = 0.5, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Learned value by key, and how many rewards made it."""
    return q_update(None, feedback, keys, order, alpha, decay, default, low, high)


def q_update(table: DataFrame | None, feedback: DataFrame, keys: list[str], order: list[str], alpha: float = 0.15, decay: float = 0.995, default: float = 0.5, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """A table of learned values (keys, q, n) brought forward by newer feedback, without the older; keys without any keep theirs."""
    maps = fold_maps(q_steps(feedback, alpha, decay, default, low, high).select(*keys, *order, "a", "b", "low", "high"), keys, order)
    if table is None:
        return maps.select(*keys, _clamp(F.col("a") * default + F.col("b"), F.col("low"), F.col("high")).alias("q"), "n")
    before = table.select(*keys, F.col("q").alias("__q"), F.col("n").alias("__n"))
    both = before.join(maps, keys, "full_outer")
    start = F.coalesce("__q", F.lit(default))
    moved = F.when(F.col("n").isNull(), start).otherwise(_clamp(F.col("a") * start + F.col("b"), F.col("low"), F.col("high")))
    return both.select(*keys, moved.alias("q"), (F.coalesce("n", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("n"))


def keep_last(events: DataFrame, n: int = 500, partition: str = "tenant_id") -> DataFrame:
    """The last n events of each tenant."""
    order = Window.partitionBy(partition).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("age", F.row_number().over(order).cast("long")).where(F.col("age") <= n)


def busy_periods(requests: DataFrame, idle: float, key: str = "tenant_id", ts: str = "t", last: str = "event_id") -> DataFrame:
    """Adds period: it begins where ``idle`` or more passed since the key's request before.

    Requests are dealt by (key, time), so that a hot key has several tasks; a slice learns from the others only when their
    last request was and how many periods began in them.
    """
    sliced = requests.repartitionByRange(key, ts, last).withColumn("__slice", F.spark_partition_id())
    own = Window.partitionBy(key, "__slice").orderBy(ts, last)
    near = sliced.withColumn("__before", F.lag(ts).over(own))
    tails = near.groupBy(key, "__slice").agg(F.max(ts).alias("__tail"), F.min(ts).alias("__head"), F.sum(F.when(F.col(ts) - F.col("__before") >= idle, 1).otherwise(0)).alias("__inner"))
    by = Window.partitionBy(key).orderBy("__slice")
    linked = tails.withColumn("__tail_before", F.lag("__tail").over(by))
    opens = F.when(F.col("__tail_before").isNull() | (F.col("__head") - F.col("__tail_before") >= idle), 1).otherwise(0)
    linked = linked.withColumn("__opens", opens)
    linked = linked.withColumn("__base", F.sum(F.col("__inner") + F.col("__opens")).over(by) - F.col("__inner"))
    began = F.sum(F.when(F.col(ts) - F.col("__before") >= idle, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    bases = linked.select(F.col(key).alias("__key"), F.col("__slice").alias("__at"), "__base")
    placed = near.withColumn("__began", began).join(bases, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__slice") == F.col("__at")))
    return placed.select(*requests.columns, (F.col("__base") + F.col("__began")).cast("long").alias("period"))


def token_bucket(requests: DataFrame, rate: float, capacity: float) -> DataFrame:
    """tenant_id, event_id, allowed: which requests a bucket per tenant admits. requests: tenant_id, event_id, ts.

    A bucket that had capacity / rate seconds of rest is full whatever was before, so periods between such rests are
    independent and go to tasks of their own, where they are read in order with one number kept of each.
    """
    if rate <= 0 or capacity <= 0:
        raise ValueError("rate and capacity are positive")
    slim = requests.select("tenant_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    periods = busy_periods(slim, capacity / rate * 1e6).repartition("tenant_id", "period").sortWithinPartitions("tenant_id", "period", "t", "event_id")
    kind = slim.schema["tenant_id"].dataType.simpleString()

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tokens, then = None, capacity, None
        for batch in batches:
            allowed = []
            for tenant, period, t in zip(batch["tenant_id"].to_pylist(), batch["period"].to_pylist(), batch["t"].to_pylist(), strict=True):
                if (tenant, period) != at:
                    at, tokens, then = (tenant, period), capacity, t
                tokens, ok = take(tokens, then, t, rate, capacity)
                then = t
                allowed.append(ok)
            yield pa.RecordBatch.from_arrays([batch["tenant_id"], batch["event_id"], pa.array(allowed, pa.bool_())], ["tenant_id", "event_id", "allowed"])

    return periods.mapInArrow(admit, f"tenant_id {kind}, event_id {slim.schema['event_id'].dataType.simpleString()}, allowed boolean")


def take(tokens: float, then: int | None, t: int | None, rate: float, capacity: float) -> tuple[float, bool]:
    """Tokens left, and whether a request at t (microseconds) is admitted, if there were ``tokens`` after the one at ``then``."""
    filled = min(capacity, tokens + ((t - then) / 1e6 if t is not None and then is not None else 0.0) * rate)
    return (filled - 1, True) if filled >= 1 else (filled, False)
