"""Language identification by Bayesian evidence fusion.

For each page and language, log posteriors add up
- the text: hashed byte-trigram likelihoods of a multinomial model fitted on a bounded
  sample of labelled documents, tempered because neighbouring trigrams overlap;
- the declared markup language (the ``lang`` of the html element), weighed by how often
  declarations agree with the texts over the whole table;
- the address suffix (top-level domain), by the texts' posterior mass under it;
- the host's prior: the texts' posterior mass of its pages, smoothed towards its
  domain's, which is smoothed towards the whole table's. A page's own mass is taken out
  of its host's and domain's counts first.

Masses are grouped aggregations over all pages. Domains and suffixes are joined to hosts, and
hosts to pages without moving the pages of hot hosts.

Defined cases: a null page has no text and no declaration, a null URL no suffix and
host ''; a page without any evidence gets the table's own prior; undeclared or unknown
declared languages are no evidence; repeated rows count singly; without labelled
documents no language is known and lang is null; very long pages are read whole; a tie goes to
the language that sorts first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, give_back, materialize, slices, spread_join

#: Documented bound: labelled documents that the text model is fitted on.
SAMPLE_ROWS = 20_000
FEATURES = 1 << 16
TEMPER = 1 / 3
ALPHA = 0.5
HOST_STRENGTH, DOMAIN_STRENGTH, SUFFIX_STRENGTH = 5.0, 10.0, 1.0

HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)")
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
UNSEEN = re.compile(r"<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[^>]*>", re.I | re.S)

#: ASCII letters lowered, other ASCII to blanks; bytes of other scripts stay.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else (32 if b < 128 else b) for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the words, each word between blanks."""
    data = b" " + b" ".join(text.encode().translate(_FOLD).split()) + b" "
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.int64)
    code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log likelihoods (feature x language)."""
    slim = docs.select(column(id_col).alias("id"), column(lang).cast("string").alias("lang"), column(text).cast("string").alias("text"))
    chosen = slim.where("id IS NOT NULL AND lang IS NOT NULL").select("id", F.xxhash64(F.lit("langid"), "id").alias("h")).orderBy("h", "id").limit(rows).select("id").distinct()

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang_, t in zip(pdf["lang"], pdf["text"], strict=True):
                own = held.setdefault(lang_, np.zeros(FEATURES, np.int64))
                own += np.bincount(trigrams(t or ""), minlength=FEATURES)
        for lang_, own in held.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang_, "feature": at, "n": own[at]})

    sampled = slim.join(F.broadcast(chosen), "id").where("lang IS NOT NULL").select("lang", "text")
    counts = sampled.mapInPandas(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in counts})
    table = np.zeros((FEATURES, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    for lang_, feature, n in counts:
        table[feature, place[lang_]] = n
    table += ALPHA
    return langs, np.log(table / table.sum(0)) if langs else table


def text_evidence(pages: DataFrame, langs: list[str], table: np.ndarray, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, domain, suffix, declared (a known language or null), ll (tempered log likelihoods)."""
    shared = pages.sparkSession.sparkContext.broadcast(table)
    names = ["host", "domain", "suffix", "declared", "ll"]
    kinds = [*[pa.string()] * 4, pa.list_(pa.float64())]

    def run(batches):
        known = set(langs)
        for batch in slices(batches):
            rows = []
            for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                m = HOST.match(u or "")
                host = m[1].lower() if m else ""
                labels = host.split(".")
                d = DECLARED.search(h or "")
                declared = d[1].lower() if d and d[1].lower() in known else None
                ll = TEMPER * shared.value[trigrams(UNSEEN.sub(" ", h or ""))].sum(0)
                rows.append((host, ".".join(labels[-2:]), labels[-1], declared, (ll - ll.max()).tolist()))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["page_id", *names])
        give_back()

    slim = pages.select(column(id_col).cast("long").alias("page_id"), column(url).cast("string").alias("url"), column(html).cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, ll array<double>")


def _posterior(logs: list[F.Column]) -> list[F.Column]:
    """Normalised probabilities of log weights."""
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    weights = [F.exp(x - top) for x in logs]
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    return [w / total for w in weights]


def identify(pages: DataFrame, docs: DataFrame, **columns) -> DataFrame:
    """page_id, host, lang, confidence, text_lang, declared."""
    langs, table = fit(docs)
    if not langs:
        return pages.select(column(columns.get("id_col", "page_id")).cast("long").alias("page_id"), F.lit("").alias("host"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"))
    n = len(langs)
    seen = text_evidence(pages, langs, table, **columns)
    mass = [F.round(p, 9).alias(f"p{i}") for i, p in enumerate(_posterior([F.col("ll")[i] for i in range(n)]))]
    seen = materialize(seen.select("*", *mass), "langid-evidence")

    sums = lambda tag: [F.sum(f"p{i}").alias(f"{tag}{i}") for i in range(n)]
    agree = F.sum(F.coalesce(sum(F.when(F.col("declared") == x, F.col(f"p{i}")).otherwise(0.0) for i, x in enumerate(langs)), F.lit(0.0)))
    whole = seen.agg(F.count("*").alias("n"), F.count("declared").alias("declared"), agree.alias("agree"), *sums("g")).first()
    total = max(whole["n"], 1)
    base = [((whole[f"g{i}"] or 0.0) + 1.0) / (total + n) for i in range(n)]
    trust = ((whole["agree"] or 0.0) + 2.0) / (whole["declared"] + 3.0)
    hosts = seen.groupBy("host").agg(F.count("*").alias("hn"), F.first("domain").alias("domain"), F.first("suffix").alias("suffix"), *sums("h"))
    hosts = materialize(hosts, "langid-hosts")
    over = lambda tag: [F.sum(f"h{i}").alias(f"{tag}{i}") for i in range(n)]
    domains = hosts.groupBy("domain").agg(F.count("*").alias("__hosts"), F.sum("hn").alias("dn"), *over("d"))
    suffixes = hosts.groupBy("suffix").agg(F.count("*").alias("__hosts"), *over("s"))
    many = hosts.count()
    around = materialize(spread_join(hosts, domains, ["domain"], "__hosts", many).drop("__hosts", "domain"), "langid-domains")
    around = materialize(spread_join(around, suffixes, ["suffix"], "__hosts", many).drop("__hosts", "suffix"), "langid-around")
    joined = spread_join(seen, around, ["host"], "hn", total)

    logs = []
    for i in range(n):
        own = F.col(f"p{i}")
        domain = (F.col(f"d{i}") - own + DOMAIN_STRENGTH * base[i]) / (F.col("dn") - 1 + DOMAIN_STRENGTH)
        host = (F.col(f"h{i}") - own + HOST_STRENGTH * domain) / (F.col("hn") - 1 + HOST_STRENGTH)
        suffix = (F.col(f"s{i}") - own + SUFFIX_STRENGTH) / ((whole[f"g{i}"] or 0.0) - own + SUFFIX_STRENGTH * 2)
        said = F.when(F.col("declared").isNull(), 0.0).when(F.col("declared") == langs[i], float(np.log(trust))).otherwise(float(np.log((1 - trust) / max(1, n - 1))))
        logs.append(F.col("ll")[i] + said + F.log(F.greatest(suffix, F.lit(1e-9))) + F.log(F.greatest(host, F.lit(1e-9))))
    fused = joined.select("page_id", "host", "declared", F.array([F.struct(p.alias("p"), F.lit(-i).alias("o")) for i, p in enumerate(_posterior(logs))]).alias("post"), F.array([F.struct(F.col(f"p{i}").alias("p"), F.lit(-i).alias("o")) for i in range(n)]).alias("text"))
    names = F.array([F.lit(x) for x in langs])
    best, text_best = F.array_max("post"), F.array_max("text")
    return fused.select("page_id", "host", F.element_at(names, 1 - best["o"]).alias("lang"), best["p"].alias("confidence"), F.element_at(names, 1 - text_best["o"]).alias("text_lang"), "declared")
