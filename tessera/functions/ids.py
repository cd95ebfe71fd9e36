"""Identities and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(source: Column, offset: Column, text: Column, tenant: Column | None = None) -> Column:
    """The same id for the same (source, offset, text), in UUID form; a tenant gives ids of its own."""
    base = F.concat(source, F.lit("|"), offset.cast("string"), F.lit("|"), text)
    if tenant is not None:
        base = F.concat(tenant.cast("string"), F.lit("\x00"), base)
    h = F.sha2(base, 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def token_index(token: Column) -> Column:
    """Index of a token in a hashed sparse vector."""
    return F.crc32(F.encode(token, "UTF-8"))


def wrapper_filename(source: Column) -> Column:
    """A file name for a source: readable start and twelve digits of its hash."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(source), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.concat(F.substring(slug, 1, 80), F.lit("-"), F.substring(F.sha2(source, 256), 1, 12), F.lit(".md"))
