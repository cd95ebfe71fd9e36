"""Re-scoring stages and their presets.

A stage maps results to results. Results: query_id, id, text, source, score, rank,
sources, raw_vector_score, and the chunk's attributes; the query's text is a column
``query``. Stages only change scores; ``rerank`` gives the order once at the end, where
equal scores keep the order they came in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text, times
from ..sources.tables import written

Stage = Callable[[DataFrame], DataFrame]
RESCUE_SOURCES = ("MEMORY.md", "TOOLS.md")
CURRENT_FILES = ("MEMORY.md", "TOOLS.md", "AGENTS.md", "USER.md", "IDENTITY.md", "SOUL.md", "RULES.md", "HEALTHCHECK.md")  # fixed values


def _named(source: str, names) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.contains(F.coalesce(F.col(source).cast("string"), F.lit("")), F.lit(n))
    return out


def rerank(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "rank", "id")
    return df.withColumn("__new", F.row_number().over(order).cast("long")).drop("rank").withColumnRenamed("__new", "rank")


def classify() -> Stage:
    return lambda df: df.withColumn("query_type", text.classify_query("query"))


def exact_rescue(sources=RESCUE_SOURCES, boost: float = 0.5) -> Stage:
    """Lifts terse lines of trusted files that hold a number or an address, for queries that ask for one."""
    return lambda df: df.withColumn("score", F.col("score") + F.when(text.is_exact_query("query") & _named("source", sources) & F.rlike("text", F.lit(text.EXACT_ANSWER)), boost).otherwise(0.0))


def gravity(penalty: float = 0.5, min_score: float = 0.1) -> Stage:
    """Halves results that hold none of the query's key terms."""

    def run(df: DataFrame) -> DataFrame:
        terms = text.key_terms("query")
        held = F.exists(terms, lambda t: F.contains(F.lower(F.coalesce(F.col("text"), F.lit(""))), t))
        return df.withColumn("score", F.when((F.size(terms) > 0) & (F.col("score") > min_score) & ~held, F.col("score") * penalty).otherwise(F.col("score")))

    return run


def hub(degrees: DataFrame, floor: float = 0.4) -> Stage:
    """Dampens ids whose degree is over the 90th hundredth (by index, not interpolated). degrees: id, degree; written once."""

    def run(df: DataFrame) -> DataFrame:
        known = written(degrees.select("id", "degree"))
        p90, top = hub_limits(known)
        if p90 is None or top <= p90:
            return df
        own = df.join(known, "id", "left")
        return own.withColumn("score", F.col("score") * scoring.hub_penalty(F.coalesce("degree", F.lit(0)), F.lit(p90), F.lit(top), floor)).drop("degree")

    return run


def hub_limits(degrees: DataFrame) -> tuple[int | None, int | None]:
    """(p90 by index, maximum) from counts by degree, which are few however many nodes there are."""
    counts = degrees.groupBy("degree").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)))
    total, top = degrees.agg(F.count("*"), F.max("degree")).first()
    if not total:
        return None, None
    at = int(total * 0.9) if total > 1 else total - 1
    return upto.where(F.col("upto") > at).agg(F.min("degree")).first()[0], top


def q_learning(q_table: DataFrame, blend: float = 0.2, default: float = 0.5, samples: int = 10, bonus: float = 0.1) -> Stage:
    """Blends in the mean learned value of a result's sources. q_table: source, query_type, q, n."""

    def run(df: DataFrame) -> DataFrame:
        totals = q_table.groupBy("query_type").agg(F.sum("n").alias("total"))
        known = q_table.join(totals, "query_type").select("query_type", F.col("source").alias("__s"), scoring.ucb(F.col("q"), F.col("n"), F.col("total"), samples, bonus).alias("value"))
        listed = F.when(F.size(F.coalesce("sources", F.array())) > 0, F.col("sources")).otherwise(F.array(F.lit("vector")))
        each = df.select("query_id", "id", "query_type", F.explode(listed).alias("__s")).join(known, ["query_type", "__s"], "left")
        mean = each.groupBy("query_id", "id").agg(F.avg(F.coalesce("value", F.lit(default + bonus))).alias("q_value"))
        return df.join(mean, ["query_id", "id"], "left").withColumn("score", (1 - blend) * F.col("score") + blend * F.coalesce("q_value", F.lit(default)))

    return run


def recall_counts(events: DataFrame, now: str, hours: int | None = 24) -> DataFrame:
    """id, n: recalls inside the window before ``now`` (all if hours is None). events: id, ts."""
    live = events if hours is None else events.where(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) < hours * 3_600_000_000)
    return live.groupBy("id").agg(F.count("*").alias("n"))


def inhibition(events: DataFrame, now: str, each: float = 0.03, most: float = 0.15, hours: int = 24) -> Stage:
    """Lowers what was recalled in the last hours."""

    def run(df: DataFrame) -> DataFrame:
        own = df.join(recall_counts(events, now, hours).withColumnRenamed("n", "__n"), "id", "left")
        return own.withColumn("score", F.col("score") * (1 - F.least(F.lit(most), each * F.coalesce("__n", F.lit(0))))).drop("__n")

    return run


def curiosity(events: DataFrame, now: str, bonus: float = 0.05, min_age_days: int = 7, max_recalls: int = 2, ts: str = "ts") -> Stage:
    """Lifts old memories that are rarely recalled; half for those without a date."""

    def run(df: DataFrame) -> DataFrame:
        own = df.join(recall_counts(events, now, None).withColumnRenamed("n", "__n"), "id", "left")
        age = F.floor(scoring.days_between(F.lit(now), F.col(ts)))
        lift = F.when(F.coalesce("__n", F.lit(0)) > max_recalls, 0.0).when(F.col(ts).isNull(), bonus * 0.5).when(age >= min_age_days, bonus).otherwise(0.0)
        return own.withColumn("score", F.col("score") + lift).drop("__n")

    return run


def freshness(now: str, weight: float = 0.2, half_life: float = 14.0, confidence: float = 30.0, echo_minutes: int = 10, echo: float = 0.5, current: float = 0.8, ts: str = "ts") -> Stage:
    """Blends in freshness, quiets echoes of the last minutes, then applies the forgetting curve."""

    def run(df: DataFrame) -> DataFrame:
        at = F.coalesce(F.col(ts).cast("timestamp"), times.date_in_source(F.coalesce(F.col("source").cast("string"), F.lit(""))))
        fresh = scoring.freshness(at, F.lit(now), half_life)
        fresh = F.when(_named("source", CURRENT_FILES), F.greatest(fresh, F.lit(current))).otherwise(fresh)
        minutes = scoring.days_between(F.lit(now), at) * 1440
        fresh = fresh * F.when(minutes < echo_minutes, echo).otherwise(1.0)
        access = (F.col("last_accessed"), F.col("access_count")) if "last_accessed" in df.columns else (F.lit(None).cast("timestamp"), F.lit(0))
        return df.withColumn("score", ((1 - weight) * F.col("score") + weight * fresh) * scoring.decay(*access, F.lit(now), confidence))

    return run


def protection(floor: float = 0.25, gate: float = 0.75) -> Stage:
    """Strong vector hits keep a floor on queries with technical tokens."""

    def run(df: DataFrame) -> DataFrame:
        safe = (F.size(text.exact_tokens(F.coalesce("query", F.lit("")))) > 0) & (F.coalesce("raw_vector_score", F.lit(0.0)) >= gate) & F.array_contains("sources", "vector")
        return df.withColumn("score", F.when(safe, F.greatest("score", F.lit(floor))).otherwise(F.col("score")))

    return run


def apply(df: DataFrame, stages: list[Stage]) -> DataFrame:
    """Runs the stages; order is settled after each, since later ones break ties by it."""
    for stage in stages:
        df = stage(df)
    return rerank(df)


def stateless(now: str, degrees: DataFrame | None = None) -> list[Stage]:
    return [classify(), exact_rescue(), gravity(), *([hub(degrees)] if degrees is not None else []), freshness(now), protection()]


def full(now: str, q_table: DataFrame | None = None, events: DataFrame | None = None, degrees: DataFrame | None = None) -> list[Stage]:
    out = [classify(), exact_rescue(), gravity()]
    if degrees is not None:
        out.append(hub(degrees))
    if q_table is not None:
        out.append(q_learning(q_table))
    if events is not None:
        out.append(curiosity(events, now))
    out.append(freshness(now))
    if events is not None:
        out.append(inhibition(events, now))
    return [*out, protection()]


def score_rerank(df: DataFrame, relevance: Column, head: int = 200) -> DataFrame:
    """Orders the head by a scorer; a score that is no finite number sorts last, and the tail keeps its order."""
    s = F.when(relevance.isNull() | F.isnan(relevance) | (F.abs(relevance) == float("inf")), F.lit(float("-inf"))).otherwise(relevance)
    order = Window.partitionBy("query_id").orderBy(F.col("rank") > head, F.desc(F.when(F.col("rank") <= head, s)), "rank")
    return df.withColumn("__new", F.row_number().over(order).cast("long")).drop("rank").withColumnRenamed("__new", "rank")
