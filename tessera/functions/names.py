"""Names and keys that cannot be mistaken for others: relations, labels, ids by tenant, cache keys, payloads without internals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Payload keys that are none of a user's business.
INTERNAL = ("_vector_floor_candidates", "_attributed_filters")

_OTHER, _LETTER = r"[^\p{L}\p{N}_]", r"^\p{L}"


def relation(c: Column) -> Column:
    """A relation's name: letters, digits and underscores in capitals, an underscore in front if it does not begin with a letter."""
    clean = F.regexp_replace(c, _OTHER, "_")
    return F.upper(F.when(F.rlike(clean, F.lit(_LETTER)), clean).otherwise(F.concat(F.lit("_"), clean)))


def label(c: Column) -> Column:
    """A node's label likewise, Node if it does not begin with a letter."""
    clean = F.regexp_replace(c, _OTHER, "_")
    return F.when(F.rlike(clean, F.lit(_LETTER)), clean).otherwise("Node")


def quoted(c: Column) -> Column:
    """Percent-encoded, all but letters, digits and _.-~ of ASCII."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def graph_id(node: Column, tenant: Column) -> Column:
    """Id of a graph hit; a tenant's are its own, as what parts them cannot occur in the tenant's quoted name."""
    return F.when(tenant.isNull(), F.concat(F.lit("graph:"), node)).otherwise(F.concat(F.lit("graph:"), quoted(tenant), F.lit(":"), node))


def state_key(base: Column, tenant: Column) -> Column:
    return F.when(tenant.isNull(), base).otherwise(F.concat(base, F.lit(":"), quoted(tenant)))


def cache_key(query: Column, ids: Column) -> Column:
    """Hash of a query and its candidates in order; lengths in front keep any delimiter in them harmless."""
    framed = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)
    return F.sha2(F.array_join(F.concat(F.array(framed(query)), F.transform(ids, framed)), "|"), 256)


def tags(listed: Column, single: Column) -> Column:
    """An item's tags: the list, or else the one that metadata holds; blank ones are left out."""
    own = F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, listed).otherwise(F.array(single))
    return F.filter(own, lambda t: t.isNotNull() & (t != ""))


def public_payload(c: Column, text_key: str | None = None) -> Column:
    """A payload (map) without internal keys, and without the text where its key is given."""
    hidden = [*INTERNAL, *(["text", text_key] if text_key else [])]
    return F.coalesce(F.map_filter(c, lambda k, v: ~k.isin(hidden)), F.create_map().cast("map<string,string>"))


def expansions(said: Column) -> Column:
    """Up to three lines of a model's rephrasings and likely answer, without list marks, labels and quotes; parts between semicolons if there are fewer lines."""
    text = F.coalesce(said, F.lit(""))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[-*\d.)\s]+", ""), r"(?i)^(?:rephrase|question|hypothetical answer|answer)\s*\d*\s*[:：-]\s*", "")
    lines = F.transform(F.split(text, r"\R"), lambda x: F.regexp_replace(F.regexp_replace(bare(F.regexp_replace(x, r"^\s+", "")), r"^\s+|\s+$", ""), r'^"+|"+$', ""))
    whole = F.filter(lines, lambda x: x != "")
    parts = F.filter(F.transform(F.split(text, r"[;\n]+"), lambda x: F.regexp_replace(x, r'^[\s"-]+|[\s"-]+$', "")), lambda x: x != "")
    return F.slice(F.when(F.size(whole) >= 3, whole).otherwise(parts), 1, 3)
