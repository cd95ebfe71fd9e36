"""Canonical values and resolved ids against plain versions."""

import datetime as dt
import hashlib
import json
import random
import re

from pyspark.sql import functions as F
from tessera.functions import canonical
from tessera.operators import prefixes
from tessera.plans import answers

SHAPE = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{3}|\.\d{6})?)?(?:Z|[+-]\d{2}:\d{2})?")


def plain(value):
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, str) and SHAPE.fullmatch(value):
        try:
            t = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            return value
        return (t.astimezone(dt.timezone.utc) if t.tzinfo else t).isoformat()
    return value


TIMES = [
    "2024-03-10T02:30", "2024-03-10 02:30:05", "2024-02-29T23:59:59.123Z", "2024-02-29T23:59:59.120000+05:30", "2024-01-01T00:10-00:30", "2023-02-29T00:00", "2024-13-01T00:00:00Z",
    "2024-01-01T25:00", "2024-01-01T10:00:00.000Z", "2024-01-01T10:00:00.12", "2024-01-01", "10:00", "2024-01-01T10:00+25:00", "x2024-01-01T10:00", "", "2024-01-01T10:00:00 Z",
]


def test_instants_have_one_form(spark):
    got = [r.c for r in spark.createDataFrame(list(enumerate(TIMES)), "i int, t string").select("i", canonical.instant(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [plain(t) for t in TIMES]
    assert spark.range(1).select(canonical.instant(F.lit(None).cast("string")).alias("c")).first().c is None


def test_json_compares_by_meaning(spark):
    rnd = random.Random(3)

    def value(depth=0):
        kind = rnd.random()
        if depth < 3 and kind < 0.3:
            return {k: value(depth + 1) for k in rnd.sample(["a", "b", "é", "A", "z9"], rnd.randint(0, 4))}
        if depth < 3 and kind < 0.45:
            return [value(depth + 1) for _ in range(rnd.randint(0, 3))]
        return rnd.choice([1, 2, True, None, "x", 'q"uote', *TIMES[:6]])

    def shuffled(v):
        if isinstance(v, dict):
            items = list(v.items())
            rnd.shuffle(items)
            return {k: shuffled(x) for k, x in items}
        if isinstance(v, list):
            return [shuffled(x) for x in v]
        if isinstance(v, str) and v == "2024-03-10 02:30:05":
            return "2024-03-10T02:30:05"
        return v

    pairs = []
    for _ in range(150):
        a = value()
        b = shuffled(a) if rnd.random() < 0.6 else value()
        pairs.append((a, b))
    rows = [(i, json.dumps(a, ensure_ascii=False), json.dumps(b, ensure_ascii=False, indent=1)) for i, (a, b) in enumerate(pairs)] + [(900, "{", "{"), (901, None, None), (902, "1", "true")]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, a string, b string").select("i", canonical.same(F.col("a"), F.col("b")).alias("s")).collect()}
    want = {i: json.dumps(plain(a), sort_keys=True) == json.dumps(plain(b), sort_keys=True) for i, (a, b) in enumerate(pairs)} | {900: False, 901: False, 902: False}
    assert got == want and 20 < sum(want.values()) < 150


def test_payloads_and_fingerprints(spark):
    df = spark.createDataFrame([({"b": "2024-01-01 10:00Z", "a": "x"}, {"prefix": "p", "a": "b"})], "p map<string,string>, t map<string,string>")
    row = df.select(canonical.payload(F.col("p")).alias("p"), canonical.fingerprint(F.lit("HF"), F.lit("Model"), F.lit(64), F.col("t")).alias("f")).first()
    assert json.loads(row.p) == {"a": "x", "b": "2024-01-01T10:00:00+00:00"} and row.p.index('"a"') < row.p.index('"b"')
    want = json.dumps({"provider": "hf", "model": "model", "document_transform": {"a": "b", "prefix": "p"}, "dimension": 64, "extras": {}}, sort_keys=True, separators=(",", ":"))
    assert row.f == "es1:" + hashlib.sha256(want.encode()).hexdigest()[:32]


def plain_resolve(name, ids):
    taken, out = set(ids), None
    for i, full in enumerate(ids):
        prefix = "R"
        while f"{prefix}{i}" in taken:
            prefix += "R"
        if name == f"{prefix}{i}":
            return full
    if name in ids:
        return name
    for full in sorted(ids, key=len, reverse=True):
        if full.startswith(name) or name.startswith(full):
            out = full
            break
    return out


def test_ids_resolve_as_by_comparing_all(spark):
    rnd = random.Random(5)
    cases = []
    for q in range(40):
        ids = list(dict.fromkeys("".join(rnd.choices("ab/R01:", k=rnd.randint(1, 6))) for _ in range(rnd.randint(1, 9))))
        names = list(dict.fromkeys("".join(rnd.choices("ab/R01:", k=rnd.randint(1, 7))) for _ in range(12))) + ["R0", "RR1", ids[0]]
        cases.append((q, ids, list(dict.fromkeys(names))))
    candidates = spark.createDataFrame([(q, i + 1, x) for q, ids, _ in cases for i, x in enumerate(ids)], "query_id int, rank int, id string")
    named = spark.createDataFrame([(q, p, n) for q, _, names in cases for p, n in enumerate(names)], "query_id int, pos int, name string")
    got = {(r.query_id, r.name): r.id for r in prefixes.resolve(named, candidates).collect()}
    want = {(q, n): w for q, ids, names in cases for n in names if (w := plain_resolve(n, ids)) is not None}
    assert got == want
    plan = prefixes.longest_prefix(named.select("query_id", "name").distinct(), candidates)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_parsed_ids(spark):
    said = ["3 7, 1", " RELEVANT_IDS: notes/a.md:45 b. \nprose", "none of them", None, "", "RANKED_IDS: R2,R0"]
    got = [r.p for r in spark.createDataFrame(list(enumerate(said)), "i int, s string").select("i", prefixes.parse_ids(F.col("s")).alias("p")).orderBy("i").collect()]
    assert got == [["3", "7", "1"], ["notes/a.md:45", "b"], [], [], [], ["R2", "R0"]]


def test_rerank_takes_beginnings_and_ordinals(spark):
    rows = [(1, i + 1, x, "q", f"text {x}") for i, x in enumerate(["MEMORY.md:45", "R1", "notes/x", "z"])]
    results = spark.createDataFrame(rows, "query_id int, rank long, id string, query string, text string")
    got = answers.rerank(results, lambda p: "notes/x:9 MEMORY.md RR1 nothing").orderBy("rank").collect()
    assert [r.id for r in got] == ["notes/x", "MEMORY.md:45", "R1", "z"] and [r["rank"] for r in got] == [1, 2, 3, 4]
