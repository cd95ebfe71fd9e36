"""One form for values that mean the same: instants, JSON with sorted keys, and fingerprints of it, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of a time as stores and ``isoformat`` write it, and what begins a fingerprint.
INSTANT = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{3}|\.\d{6})?)?(?:Z|[+-]\d{2}:\d{2})?"
FINGERPRINT = "es1"


def instant(c: Column) -> Column:
    """A time's one form: T between date and time, six digits of a fraction that is not zero, UTC if it has an offset; other strings as they are."""
    offset = F.regexp_extract(c, r"(Z|[+-]\d{2}:\d{2})$", 1)
    local = F.substring(c, F.lit(1), F.length(c) - F.length(offset)).try_cast("timestamp_ntz")
    hours, minutes = F.substring(offset, 2, 2).try_cast("int"), F.substring(offset, 5, 2).try_cast("int")
    behind = F.when(offset.isin("", "Z"), 0).when((hours < 24) & (minutes < 60), F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1) * (hours * 60 + minutes))
    moved = (local - F.make_dt_interval(mins=behind)).cast("string")
    whole = F.replace(F.substring_index(moved, ".", 1), F.lit(" "), F.lit("T"))
    fraction = F.when(F.contains(moved, F.lit(".")), F.concat(F.lit("."), F.rpad(F.substring_index(moved, ".", -1), 6, "0"))).otherwise("")
    form = F.concat(whole, fraction, F.when(offset == "", "").otherwise("+00:00"))
    return F.when(F.rlike(c, F.lit(f"^(?:{INSTANT})$")), F.coalesce(form, c)).otherwise(c)


def payload(c: Column) -> Column:
    """A flat payload (map of strings) as JSON: keys sorted, times in their one form."""
    entries = F.array_sort(F.map_entries(F.transform_values(c, lambda k, v: instant(v))))
    return F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"})


def json(c: Column) -> Column:
    """JSON text with sorted keys at every level, without blanks, strings that are times in their one form; null if it does not parse.

    A null compares unequal to everything, so what has no one form is rewritten rather than skipped. Of a key that comes twice there is no one form either.
    """
    flat = F.to_json(F.try_parse_json(c))
    pattern = rf'"(?:{INSTANT})"(?!\s*:)'
    times = F.transform(F.regexp_extract_all(flat, F.lit(pattern), F.lit(0)), lambda t: F.concat(F.lit('"'), instant(F.substring(t, F.lit(2), F.length(t) - 2)), F.lit('"')))
    pieces = F.split(flat, pattern, -1)
    woven = F.array_join(F.zip_with(pieces, times, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
    return F.when(F.rlike(flat, F.lit(pattern)), woven).otherwise(flat)


def same(a: Column, b: Column) -> Column:
    """Whether two JSON texts mean the same; false if one of them has no one form."""
    return F.coalesce(json(a) == json(b), F.lit(False))


def fingerprint(provider: Column, model: Column, dimension: Column, transform: Column, extras: Column | None = None) -> Column:
    """Identity of a space of document vectors: what determines them, not the names of profiles. transform and extras are maps."""
    none = F.create_map().cast("map<string,string>")
    sorted_map = lambda m: F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(m, none))))
    whole = F.struct(
        dimension.cast("int").alias("dimension"),
        sorted_map(transform).alias("document_transform"),
        sorted_map(none if extras is None else extras).alias("extras"),
        F.lower(model).alias("model"),
        F.lower(provider).alias("provider"),
    )
    return F.concat(F.lit(f"{FINGERPRINT}:"), F.substring(F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256), 1, 32))
