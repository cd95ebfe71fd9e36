"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blob_ledger, collocations, exact_dedup, langid, lines, matroska, mixing, packing, pitman_yor, ranked, simhash, toxicity, warc
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.strip_boilerplate(table(spark, sf_dir, "pages"))


OP2_SQL = r"""
WITH l AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '')) AS host,
         list_filter(list_transform(
           string_split_regex(
             regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
               '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', '', 'g'),
               '(?i)</?(?:a|abbr|b|code|em|font|i|small|span|strong|sub|sup|u)(?:\s[^>]*)?>', '', 'g'),
               '<[^>]*>', chr(10), 'g'),
             '[\n\r]+'),
           lambda x: trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM pages
), h AS (
  SELECT host, count(*) AS host_pages FROM l GROUP BY host
), c AS (
  SELECT host, line, count(*) AS pages FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY host, line
), d AS (
  SELECT c.host, list(line) AS gone FROM c JOIN h ON c.host = h.host WHERE pages >= 3 AND pages / host_pages > 0.1 GROUP BY c.host
), k AS (
  SELECT page_id, l.host, lines, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, x)) END AS kept
  FROM l LEFT JOIN d ON l.host = d.host
)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text
FROM k
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


# With one source a document the flow is unique, so it has a closed form: a source is
# full at three times its size as long as its cap per weight stays under the level of
# those behind it.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat('mix-1:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM s
), f AS (
  SELECT *, row_number() OVER o AS place,
         (total - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, coalesce(source, 'None'))
), b AS (
  SELECT min(place) AS place, arg_min(level, place) AS level FROM f WHERE weight * level < 3 * source_size
), t AS (
  SELECT f.source, f.source_size,
         CASE WHEN b.place IS NULL OR f.place < b.place THEN CAST(3 * f.source_size AS DOUBLE) ELSE f.weight * b.level END AS target
  FROM f CROSS JOIN b
), u AS (
  SELECT source, source_size, target,
         CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) // source_size END AS passes,
         CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) % source_size END AS rest
  FROM t
), p AS (
  SELECT d.*, u.source_size, u.target, u.passes, u.rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) <= rest AS head,
         count(*) OVER (PARTITION BY d.source, h) = 1 AS alone
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
), g AS (
  SELECT *, rest - coalesce(sum(size) FILTER (WHERE head) OVER (PARTITION BY source), 0) AS gap FROM p
), k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN alone AND NOT head AND size > 0 AND abs(size - gap) < gap THEN 0 ELSE 1 END, abs(size - gap), h) AS place FROM g
)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN head THEN CASE WHEN rest = 0 THEN 0 ELSE 1 END
                                  WHEN place = 1 AND alone AND size > 0 AND abs(size - gap) < gap THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k
"""


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t,
         row_number() OVER () AS row
  FROM documents
), i AS (
  SELECT item_id, row_number() OVER () AS q, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark
), s AS (
  SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS length FROM d WHERE len(t) > 0
), f AS (
  SELECT doc_id, row, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, row, len(t) AS n, unnest(t) AS term FROM d) GROUP BY doc_id, row, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term) CROSS JOIN s
), p AS (
  SELECT doc_id, row, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))) AS part
  FROM f JOIN w USING (term) CROSS JOIN s
), r AS (
  SELECT q, any_value(item_id) AS item_id, doc_id, row, CAST(sum(part) AS BIGINT) AS score FROM i JOIN p USING (term) GROUP BY q, doc_id, row HAVING sum(part) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM r QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 50
"""


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blob_ledger.secret_scan(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), r(kind, rank, pattern, grp, least) AS (
  VALUES ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
         ('access', 1, 'AKIA[A-Z0-9]+', 0, 20), ('hex', 2, '[0-9a-f]+', 0, 24), ('pem', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1)
), p AS (
  SELECT row, 'assign' AS kind, 0 AS rank, 6 AS least, string_split_regex(text, (SELECT pattern FROM r WHERE rank = 0)) AS gaps,
         regexp_extract_all(text, (SELECT pattern FROM r WHERE rank = 0), 0) AS hits, regexp_extract_all(text, (SELECT pattern FROM r WHERE rank = 0), 2) AS groups FROM d
  UNION ALL SELECT row, kind, rank, least, string_split_regex(text, pattern), regexp_extract_all(text, pattern), regexp_extract_all(text, pattern) FROM d CROSS JOIN r WHERE rank > 0
), m AS (
  SELECT row, kind, rank, least, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(groups) AS grp, unnest(gaps[1 : len(hits)]) AS gap FROM p WHERE len(hits) > 0
), s AS (
  SELECT row, kind, rank, least, length(grp) AS size, length(hit) AS hit, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY row, kind ORDER BY i) AS BIGINT) AS stop FROM m
), f AS (
  SELECT row, kind, rank, stop - hit AS start, stop FROM s WHERE size >= least
), o AS (
  SELECT row, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
         coalesce(string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '') AS base,
         string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank) AS spans
  FROM f GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (row)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(list_transform(
           string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'),
           lambda x: regexp_extract_all(x, '[^\x20\x09]+')), lambda w: len(w) > 0) AS pieces
  FROM documents
), q AS (
  SELECT lang, unnest(pieces) AS w FROM p
), z AS (
  SELECT lang, unnest(list_zip(w, w[2:], w[3:])) AS z FROM q
), g AS (
  SELECT lang, 1 AS size, z[1] AS phrase FROM z
  UNION ALL SELECT lang, 2, z[1] || ' ' || z[2] FROM z WHERE z[2] IS NOT NULL
  UNION ALL SELECT lang, 3, z[1] || ' ' || z[2] || ' ' || z[3] FROM z WHERE z[3] IS NOT NULL
), f AS (
  SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY lang, size, phrase
), n AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (
  SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10
), k AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, l.a AS l, r.a AS r, 1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.size = k AND l.phrase = array_to_string(w[1 : k], ' ')
  JOIN f r ON r.lang = c.lang AND r.size = c.size - k AND r.phrase = array_to_string(w[k + 1 : c.size], ' ')
), b AS (
  SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), o AS (
  SELECT lang, phrase, max(a) AS over FROM (
    SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY lang, phrase
)
SELECT b.lang, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS INT) AS rank,
       b.phrase, b.a, b.l, b.r, n.n, CAST(score AS BIGINT) AS score
FROM b JOIN n ON b.lang = n.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
WHERE over IS NULL OR 100 * over < 50 * b.a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_lines": op2_lines,
    "op3_warc": op3_warc,
    "op4_pitman_yor": op4_pitman_yor,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_matroska": op9_matroska,
    "op10_langid": op10_langid,
    "op11_ranked": op11_ranked,
    "op12_secrets": op12_secrets,
    "op13_collocations": op13_collocations,
}

ORACLE: dict[str, str] = {
    "op2_lines": OP2_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op7_mixing": OP7_SQL,
    "op11_ranked": OP11_SQL,
    "op12_secrets": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
