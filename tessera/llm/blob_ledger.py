"""Secret scans with an incremental blob ledger, by SQL functions only.

Every version of every path is addressed by the SHA-256 of its text: a blob. The ledger is a
folder of runs; each run holds the blobs that it scanned, with the rules (kind and version) that it
applied, and what it found. A scan reads the ledger, applies to each blob only the rules that no run has applied in
their present version, and appends a run, which appears whole or not at all: its folder is renamed
into place. Findings of the present rules are then joined back to all paths.

A new blob that one row holds is scanned where it lies. Texts of other blobs move once, combined in each
task first, so a blob that a third of all rows share reaches a task once from each task that has it. Blobs
that need nothing are ruled out by a bitmap of bounded size before anything moves. Only lengths leave the
scan: those of matches and of the gaps between them, whose running sums are the places.

Defined cases: a null text counts as empty and has no findings; repeated rows are reported singly;
null paths are kept; very long texts are scanned whole, places are code points and ends are
exclusive; spans of one start come in the order of the rules; an empty table gives an empty result and an empty run;
other columns, whatever their names, are ignored. Two runs at a time may both scan a blob; findings are then joined once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, discard, fresh_dir, materialize, split_by_keys, spread_join


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose group has at least ``least`` characters. Raise ``version`` with any change."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed values of the contract. A run of hex digits or an access key that is long enough
#: begins where the shorter pattern's match would, so the length can stand in the pattern.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

BASE = (Rule("assign", 1, ASSIGN, 2, 6), Rule("access", 1, ACCESS), Rule("hex", 1, HEX))
RULES = (*BASE, Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"))

BLOBS = "digest string, rows long, rules array<string>, found array<struct<kind:string,version:int,gaps:array<int>,hits:array<int>,groups:array<int>>>"
FINDINGS = "digest string, kind string, version int, start long, stop long"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _runs(spark: SparkSession, ledger: str, part: str, schema: str) -> DataFrame:
    p, fs = _hadoop(spark, ledger)
    runs = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    paths = [f"{ledger}/{r}/{part}" for r in sorted(runs) if r.startswith("run-")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def blobs(spark: SparkSession, ledger: str) -> DataFrame:
    """(digest, rules): what each run scanned."""
    return _runs(spark, ledger, "blobs", "digest string, rules array<string>")


def findings(spark: SparkSession, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(digest, kind, version, start, stop) by the present versions of rules."""
    present = F.concat_ws("@", "kind", "version").isin([r.name for r in rules])
    return _runs(spark, ledger, "findings", FINDINGS).where(present).distinct()


def _matches(rule: Rule, text: Column) -> Column:
    """Lengths of the gaps before matches, of matches and of their groups; null without a match."""
    lengths = lambda a: F.transform(a, F.length)
    hits = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    groups = lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))) if rule.group else hits
    found = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), lengths(F.split(text, rule.pattern, -1)).alias("gaps"), hits.alias("hits"), groups.alias("groups"))
    return F.when(text.rlike(rule.pattern), found)


def _scanned(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows of ``BLOBS`` from (digest, rows, text, todo); a rule that is not to be done is not applied."""
    found = [F.when(F.array_contains("todo", r.name), _matches(r, F.col("text"))) for r in rules]
    return texts.select("digest", "rows", F.col("todo").alias("rules"), F.array_compact(F.array(*found)).alias("found"))


def _placed(scanned: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows of ``FINDINGS``: running sums of gaps and matches, without matches whose group is too short."""
    each = scanned.select("digest", F.explode("found").alias("f")).select("digest", "f.kind", "f.version", F.posexplode(F.arrays_zip("f.gaps", "f.hits", "f.groups")).alias("at", "m"))
    there = Window.partitionBy("digest", "kind", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.where("m.hits IS NOT NULL").select("*", F.sum(F.col("m.gaps") + F.col("m.hits")).over(there).alias("stop"))
    least = F.lit(0)
    for r in rules:
        least = F.when(F.col("kind") == r.kind, r.least).otherwise(least)
    return placed.where(F.col("m.groups") >= least).select("digest", "kind", "version", (F.col("stop") - F.col("m.hits")).alias("start"), "stop")


def _addressed(versions: DataFrame, text: str, *paths: Column) -> DataFrame:
    content = F.coalesce(column(text).cast("string"), F.lit(""))
    return versions.select(*paths, content.alias("text")).withColumn("digest", F.sha2("text", 256))


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Scans what the ledger has not seen and appends a run to it. Returns (digest, rows) of the versions' blobs."""
    spark = versions.sparkSession
    every = [r.name for r in rules]
    base = _addressed(versions, text)
    counts = materialize(base.groupBy("digest").agg(F.count("*").alias("rows")), "ledger-counts")
    seen = blobs(spark, ledger).select("digest", F.explode("rules").alias("rule")).where(F.col("rule").isin(every))
    done = F.coalesce("done", F.array().cast("array<string>"))
    todo = F.array_except(F.array(*map(F.lit, every)), done)
    state = materialize(counts.join(seen.groupBy("digest").agg(F.collect_set("rule").alias("done")), "digest", "left").select("digest", "rows", todo.alias("todo")), "ledger-state")

    needed, alone = F.size("todo") > 0, (F.size("todo") == len(every)) & (F.col("rows") == 1)
    kept = base if state.where(~needed).isEmpty() else split_by_keys(base, F.col("digest"), state.where(needed).select("digest"))[0]
    moved, single = split_by_keys(kept, F.col("digest"), state.where(~alone).select("digest"))
    combined = moved.groupBy("digest", "text").agg(F.count("*").alias("__n")).drop("__n").join(state.where(needed), "digest")
    fresh = single.select("digest", F.lit(1).cast("long").alias("rows"), "text", F.array(*map(F.lit, every)).alias("todo"))
    scanned = materialize(_scanned(combined.select(*fresh.columns).unionByName(fresh), rules), "ledger-scanned")

    run = f"{ledger}/.{uuid.uuid4().hex}"
    scanned.select("digest", "rules").write.parquet(f"{run}/blobs")
    _placed(scanned, rules).write.parquet(f"{run}/findings")
    (staged, fs), (final, _) = _hadoop(spark, run), _hadoop(spark, f"{ledger}/run-{uuid.uuid4().hex}")
    if not fs.rename(staged, final):
        raise OSError(f"{run} cannot be moved to {final}")
    discard(state, scanned)
    return counts


def _reports(found: DataFrame, rules: Sequence[Rule], base: Sequence[str]) -> DataFrame:
    """A row per blob with findings: counts by base kind, the digest of the base spans, all spans."""
    rank = F.lit(len(rules))
    for i, r in enumerate(rules):
        rank = F.when(F.col("kind") == r.kind, i).otherwise(rank)
    spans = found.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "stop"))).alias("s"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    number = [F.size(F.filter("s", lambda x: x["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in base]
    return spans.select("digest", *number, F.sha2(joined(F.filter("s", lambda x: x["kind"].isin(list(base)))), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


def report(versions: DataFrame, ledger: str, counts: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[str] = ("assign", "access", "hex"), path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, n_<kind> for each base kind, base_sha256, spans: the ledger's findings for every version; counts are what ``scan`` returned."""
    spark = versions.sparkSession
    reports = materialize(_reports(findings(spark, ledger, rules), rules, base).join(counts, "digest"), "ledger-reports")
    paths = materialize(_addressed(versions, text, column(path).alias("__path")).drop("text"), "ledger-paths")
    maybe, clean = split_by_keys(paths, F.col("digest"), reports.select("digest"))
    joined = spread_join(maybe, reports, ["digest"], "rows", paths.count(), "left")
    columns = [F.col("__path").alias(path)]
    columns += [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base]
    columns += [F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")]
    return joined.unionByName(clean, allowMissingColumns=True).select(columns)


def secret_scan(versions: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan and report in one; without a ledger a new one is begun in the shared folder."""
    ledger = ledger or fresh_dir(versions.sparkSession, "ledger")
    return report(versions, ledger, scan(versions, ledger, rules, text), rules, path=path, text=text)
