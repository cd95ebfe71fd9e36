"""Row predicates: payload filters, validity in two times, tenants, source families."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times

ALIASES = {"graph": ["memgraph"], "bm25": ["bm25", "qdrant_text", "sparse"]}  # fixed values


def on_time_line(c: Column, want, unit: str = "auto") -> Column:
    """A stored time against an instant or an inclusive range of instants, whatever domain each is written in.

    Where the stored value or a bound is no instant, they are compared as they are; null if they cannot be.
    """
    value = times.parse_instant(c, unit)
    if not isinstance(want, dict):
        bound = times.parse_instant(F.lit(want), unit)
        return F.coalesce(value == bound, F.lit(False)) | F.coalesce(c.cast("string") == F.lit(want).cast("string"), F.lit(False))
    bounds = {op: F.lit(want[op]) for op in ("gte", "lte") if want.get(op) is not None}
    compare = {"gte": lambda x, y: x >= y, "lte": lambda x, y: x <= y}
    instants = {op: times.parse_instant(b, unit) for op, b in bounds.items()}
    comparable = reduce(lambda x, y: x & y, (i.isNotNull() for i in instants.values()), value.isNotNull())
    both = lambda side: reduce(lambda x, y: x & y, side, F.lit(True))
    plain = [compare[op](c.cast("string") if isinstance(want[op], str) else c.try_cast("double"), b) for op, b in bounds.items()]
    return F.when(comparable, both(compare[op](value, i) for op, i in instants.items())).otherwise(both(plain))


def payload_filter(filters: dict, schema, timestamp_key: str | None = None, unit: str = "auto") -> Column:
    """Conjunction of exact values and inclusive {'gte', 'lte'} ranges.

    A missing key never matches; an array column matches if any element does; a value
    that cannot be compared with its bound does not match. Values of ``timestamp_key``
    compare as instants; ``unit`` says what its numbers are. The result may be null, which
    ``where`` takes for no match; plain conjuncts let scans take them.
    """
    types = {f.name: f.dataType.simpleString() for f in schema.fields}

    def one(c: Column, want, kind: str) -> Column:
        if not isinstance(want, dict):
            return c == F.lit(want) if not isinstance(want, str) or kind in ("string", "date") or kind.startswith("timestamp") else c.cast("string") == want
        out = F.lit(True)
        for op in ("gte", "lte"):
            if want.get(op) is not None:
                bound = F.lit(want[op])
                number = not isinstance(want[op], str)
                if kind == "string":
                    value = c.try_cast("double") if number else c
                elif kind in ("date", "boolean") or kind.startswith("timestamp"):
                    value, bound = (c, F.lit(None)) if number else (c, bound.try_cast(kind))
                else:
                    value, bound = c, bound if number else bound.try_cast("double")
                out = out & (value >= bound if op == "gte" else value <= bound)
        return out

    def element(want, kind: str, key: str):
        return lambda x: F.coalesce(on_time_line(x, want, unit) if key == timestamp_key else one(x, want, kind), F.lit(False))

    parts = []
    for key, want in filters.items():
        if key not in types:
            return F.lit(False)
        kind = types[key]
        if kind.startswith("array"):
            parts.append(F.exists(key, element(want, kind[len("array<") : -1], key)))
        else:
            parts.append(on_time_line(F.col(key), want, unit) if key == timestamp_key else one(F.col(key), want, kind))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def native_bounds(filters: dict, timestamp_key: str, schema) -> dict:
    """The filter with its time bounds in the column's own domain, so that the scan can take them.

    Only for timestamp and date columns, whose bounds are instants; an exact instant
    becomes a range of no length. Bounds that are no instants stay.
    """
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    if timestamp_key not in filters or not kinds.get(timestamp_key, "").startswith(("timestamp", "date")):
        return filters
    want = filters[timestamp_key]
    sides = want if isinstance(want, dict) else {"gte": want, "lte": want}
    return {**filters, timestamp_key: {op: _instant_text(v) for op, v in sides.items()}}


def _instant_text(v):
    if not isinstance(v, int | float) or isinstance(v, bool):
        return v
    seconds = v / 1000 if abs(v) >= 1e12 or v > 32_503_680_000 else v
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")


def passes_scope(matches: Column, attributed: str = "attributed", sources: str = "sources") -> Column:
    """The check after the stages: a row matches, or it is a graph hit alone whose chunks were proven in scope."""
    alone = F.col(sources) == F.array(F.lit("graph"))
    return F.coalesce(matches, F.lit(False)) | F.coalesce(alone & F.col(attributed), F.lit(False))


def attributed(hits: DataFrame, chunks: DataFrame, name: str = "name", source: str = "source") -> DataFrame:
    """Graph hits that a chunk in scope backs: its source is the hit's name. Hits of unknown chunks are left out."""
    return hits.join(chunks.select(F.col(source).alias(name)).distinct(), name, "left_semi")


def scrub_tenant(results: DataFrame, tenant, nested: str | None = None, column: str = "tenant_id") -> DataFrame:
    """The last check of a tenant's results, also inside a list of candidates (an array of structs)."""
    if tenant is None:
        return results
    out = tenant_scope(results, tenant, column)
    return out.withColumn(nested, F.filter(nested, lambda x: F.coalesce(x[column] == F.lit(tenant), F.lit(False)))) if nested else out


def is_current(invalidated: str = "invalidated_at") -> Column:
    """Not invalidated; an empty mark counts as none."""
    return F.coalesce(F.col(invalidated).cast("string"), F.lit("")) == ""


def valid_at(instant: Column, start: str = "valid_from", end: str = "valid_until") -> Column:
    """World time: start inclusive, end exclusive, missing bounds open, 'current' is no end.

    A bound that is no instant is compared as text, so it decides on its own row only.
    """
    low, high = F.col(start), F.nullif(F.col(end).cast("string"), F.lit("current"))

    def bound(c: Column, compare) -> Column:
        parsed = c.try_cast("timestamp")
        return F.when(parsed.isNotNull(), compare(parsed, instant.cast("timestamp"))).otherwise(compare(c.cast("string"), instant.cast("string")))

    return (low.isNull() | bound(low, lambda x, y: x <= y)) & (high.isNull() | bound(high, lambda x, y: x > y))


def validity(df: DataFrame, as_of: str | None = None, include_invalidated: bool = False) -> DataFrame:
    """An instant decides alone; else invalidated rows are hidden unless asked for."""
    if as_of is not None:
        return df.where(valid_at(F.lit(as_of)))
    return df if include_invalidated else df.where(is_current())


def tenant_scope(df: DataFrame, tenant, column: str = "tenant_id") -> DataFrame:
    if tenant == "":
        raise ValueError("an empty tenant scopes nothing")
    return df if tenant is None else df.where(F.col(column) == F.lit(tenant))


def source_family(wanted: list[str], sources: str = "sources") -> Column:
    """A result came from one of the families; 'name:detail' belongs to 'name'."""
    names = sorted({a for w in wanted for a in ALIASES.get(w, [w])})
    base = F.transform(F.col(sources), lambda s: F.split_part(s, F.lit(":"), F.lit(1)))
    return F.arrays_overlap(base, F.array([F.lit(n) for n in names]))


def intersect_window(start: Column, end: Column, gte: Column | None = None, lte: Column | None = None) -> tuple[Column, Column, Column]:
    """(start, end, not empty) of a query window cut by a caller's bounds."""
    low = start if gte is None else F.greatest(start, gte)
    high = end if lte is None else F.least(end, lte)
    return low, high, low <= high
