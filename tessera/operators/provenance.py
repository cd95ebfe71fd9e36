"""Citation checks against current sources, and embedding-space guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The verdicts.
INTACT, SOURCE_CHANGED, MOVED, CHANGED, MISSING, UNRESOLVABLE = "intact", "source_changed", "moved", "changed", "missing", "unresolvable"


#: Characters of a source whose citations are held against one copy of it.
SPAN = 100_000


def verdicts(cited: DataFrame, current: DataFrame, keys: list[str] | str = "source") -> DataFrame:
    """Adds verdict and supported.

    cited: keys, text, offset, snapshot (hash of the source at ingest, may be null),
    synthetic_prefix_len (may be absent); current: keys, content.

    A source is hashed once, and its text meets its citations by the span they start in, not one by one.
    """
    keys = [keys] if isinstance(keys, str) else keys
    rest = [c for c in cited.columns if c not in keys]
    here = current.select(*keys, F.col("content").alias("__now"), F.sha2("content", 256).alias("__hash"), F.lit(True).alias("__there"))
    packed = cited.groupBy(*keys, F.floor(F.coalesce("offset", F.lit(0)) / SPAN).alias("__span")).agg(F.collect_list(F.struct(*rest)).alias("__cited"))

    def judged(x: Column) -> Column:
        fragment = x["text"]
        if "synthetic_prefix_len" in rest:
            fragment = F.when(x["synthetic_prefix_len"] > 0, F.substring(fragment, x["synthetic_prefix_len"] + 1, F.length(fragment))).otherwise(fragment)
        blank = fragment.isNull() | (fragment == "")
        same = F.coalesce(F.col("__hash") == x["snapshot"], F.lit(True))
        inplace = F.substring(F.col("__now"), x["offset"].cast("int") + 1, F.length(fragment)) == fragment
        verdict = (
            F.when(F.col("__there").isNull(), MISSING)
            .when(blank | F.col("__now").isNull(), UNRESOLVABLE)
            .when(inplace, F.when(same, INTACT).otherwise(SOURCE_CHANGED))
            .when(F.contains(F.col("__now"), fragment), MOVED)
            .otherwise(CHANGED)
        )
        return F.struct(*[x[c].alias(c) for c in rest], verdict.alias("verdict"))

    each = packed.join(here, keys, "left").select(*keys, F.inline(F.transform("__cited", judged)))
    return each.select(*cited.columns, "verdict", F.col("verdict").isin(INTACT, SOURCE_CHANGED, MOVED).alias("supported"))


def space_guard(points: DataFrame, space: str, column: str = "space") -> str:
    """match, mismatch, legacy (no stamps), mixed or empty, over all points."""
    total, stamped, kinds, least = points.agg(F.count("*"), F.count(column), F.countDistinct(column), F.min(column)).first()
    if not total:
        return "empty"
    if not stamped:
        return "legacy"
    if kinds > 1 or stamped < total:
        return "mixed" if kinds > 1 else "mismatch" if least != space else "match"
    return "match" if least == space else "mismatch"
