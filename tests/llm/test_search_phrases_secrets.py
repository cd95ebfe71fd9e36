"""Ranked search, collocations and the blob ledger against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tessera.llm import blob_ledger, collocations, ranked
from tessera.llm.blob_ledger import Rule

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, n int, `q` string, `term` string, digest string, `a.b` string"


def documents(seed=3, n=120):
    rnd = random.Random(seed)
    words = ["The", "the", "of", "Über", "été", "x1", "re-do", "naïve", "data", "model", "zeta", "日本語"] + [f"w{i}" for i in range(30)]
    weight = [1 / (i + 1) for i in range(len(words))]
    texts = ["".join(w + rnd.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "  "]) for w in rnd.choices(words, weight, k=rnd.randint(1, 60))) for _ in range(n)]
    texts += [None, "", " \n ", "...", texts[0], texts[0], "the of " * 6000, "data data data model " * 40]
    return [(i if i != 7 else None, t, rnd.choice(["en", "fr", None]), 1, "q", "t", "d", "e") for i, t in enumerate(texts)] + [(3, texts[3], "en", 2, None, None, None, None)]


def plain_search(docs, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: pattern.findall((t or "").translate(LOWER))
    bags = [(d, Counter(terms(t))) for d, t, *_ in docs]
    bags = [(d, c) for d, c in bags if c]
    n, length = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in bags:
            m = 50 + (50 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("k", [3, 50])
def test_ranked_equals_scoring_everything(spark, monkeypatch, k):
    docs = documents()
    items = [(0, "the data, The model"), (1, docs[0][1]), (2, None), (3, "absent"), (4, "日本語 été"), (None, "of of of"), (1, "w3 w4")]
    monkeypatch.setattr(ranked, "SHARD", 200)
    monkeypatch.setattr(ranked, "FIRST_ROUND", 2)
    monkeypatch.setattr(ranked, "BLOCK", 3)
    queries = spark.createDataFrame(items, "item_id int, text string")
    got = ranked.rank_documents(spark.createDataFrame(docs, DOCS).repartition(3), queries, k).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_search(docs, items, k)))


def test_threshold_stops_before_the_lists_end(spark):
    import numpy as np
    import pyarrow as pa

    rows = 5000
    tf = pa.array([[50] if i < 60 else [1] for i in range(rows)], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array([50 if i < 60 else 1 for i in range(rows)]), pa.array([["a"]] * rows), tf], ["id", "n", "terms", "tfs"])
    shard = ranked.Shard(batch, pa.array(["a"]), rows, 8000)
    found, scores = shard.best(np.array([0]), np.array([7]), 10, np.empty(0, np.int64))
    assert len(found) < rows / 10 and sorted(scores)[-10:] == [7 * shard.impact[:60].max()] * 10 and set(range(60)) <= set(found)


def test_one_index_serves_many_batches(spark):
    docs = documents(4, 30)
    table = spark.createDataFrame(docs, DOCS)
    from tessera.llm.common import materialize

    index = materialize(ranked.forward_index(table), "test-index")
    for items in ([(1, "data")], [(2, "model the"), (3, "w1")]):
        got = ranked.search(index, spark.createDataFrame(items, "item_id int, text string"), 5).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_search(docs, items, 5)))


def test_ranked_empty(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert ranked.rank_documents(none, items).count() == 0
    assert ranked.rank_documents(spark.createDataFrame(documents(n=3), DOCS), items.limit(0)).count() == 0


def plain_phrases(docs, longest, least, cover, most):
    f = defaultdict(Counter)
    for _, text, lang, *_ in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        total = sum(a for g, a in counts.items() if len(g) == 1)
        held = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        over = Counter()
        for g, a in held.items():
            for size in range(2, len(g)):
                for i in range(len(g) - size + 1):
                    over[g[i : i + size]] = max(over[g[i : i + size]], a)
        rows = []
        for g, a in held.items():
            if over[g] and 100 * over[g] >= cover * a:
                continue
            score, k = min((1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), " ".join(g), a, counts[g[:k]], counts[g[k:]], total, score))
        out += [(lang, i, *r[3:]) for i, r in enumerate(sorted(rows)[:most], 1)]
    return out


@pytest.mark.parametrize(("longest", "share", "width"), [(3, 1 << 18, 1 << 20), (3, 5, 2), (4, 40, 64), (2, 1 << 18, 1 << 20)])
def test_collocations_equal_counting_everything(spark, monkeypatch, longest, share, width):
    """With few cells words share estimates, and with small shares every pivot is dealt in parts."""
    monkeypatch.setattr(collocations, "SHARE", share)
    monkeypatch.setattr(collocations, "WIDTH", width)
    monkeypatch.setattr(collocations, "ROWS", 500)
    docs = documents(5)
    got = collocations.collocations(spark.createDataFrame(docs, DOCS).repartition(3), longest=longest, least=4, most=25).collect()
    want = plain_phrases(docs, longest, 4, 50, 25)
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    a = 3_000_000_019
    phrases = spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, a long")
    words = spark.createDataFrame([("en", "x", a + 1), ("en", "y", a + 7)], "lang string, word string, f long")
    assert collocations.scored(phrases, words).first().score == 1_000_000 * a * a // ((a + 1) * (a + 7))


def test_collocations_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, 1, "", "", "", "")], DOCS)).count() == 0


def test_every_phrase_has_one_pivot(spark):
    docs = spark.createDataFrame(documents(6, 40), DOCS)
    words = collocations.word_counts(docs).where("f >= 3")
    frags = collocations.fragments(docs, words, 3, 3)
    slots = F.split("fragment", "\n")
    owner = frags.select("lang", F.get(slots, F.lit(2)).alias("pivot"), "route", "part")
    assert owner.groupBy("lang", "pivot").agg(F.countDistinct("route").alias("r"), F.countDistinct("part").alias("p")).where("r <> p").count() == 0


BASE = {"assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}


def plain_secrets(text):
    found = [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, (kind, (p, g, least)) in enumerate(BASE.items()) for m in re.finditer(p, text or "", re.A) if len(m[g]) >= least]
    joined = ",".join(s for *_, s in sorted(found))
    return (*[sum(i == k for _, i, _ in found) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest(), joined)


SECRETS = [
    "password = hunter2x and TOKEN:'abc' then api_key=\"A.b-c/9=\"",
    "secret=token=abcdef token: ab secret=token:abcdefg",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "AKIAC",
    "é日😀 deadbeef " + "0123456789abcdef" * 2 + "g" + "f" * 24,
    None,
    "",
    "Passwdſ=abcdefgh",
    "apikey: " + "x" * 5 + "\n" + "a1" * 200_000 + " token=zzzzzz",
]


def versions(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, digest string, `rows` int")


def report(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_secrets_equal_plain_scan(spark):
    texts = SECRETS + [SECRETS[0]] * 30
    got = report(blob_ledger.secret_scan(versions(spark, texts).repartition(3), rules=blob_ledger.BASE))
    assert got == {i: plain_secrets(t) for i, t in enumerate(texts)}


def test_ledger_scans_only_what_it_has_not_seen(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    first = versions(spark, SECRETS[:4] + SECRETS[:1])
    blob_ledger.scan(first, ledger, blob_ledger.BASE)
    seen = blob_ledger.blobs(spark, ledger).count()
    assert seen == 4
    both = versions(spark, SECRETS)
    counts = blob_ledger.scan(both, ledger, blob_ledger.BASE)
    assert blob_ledger.blobs(spark, ledger).count() == len({t or "" for t in SECRETS})
    got = report(blob_ledger.report(both, ledger, counts, blob_ledger.BASE))
    assert got == {i: plain_secrets(t) for i, t in enumerate(SECRETS)}
    blob_ledger.scan(both, ledger, blob_ledger.BASE)
    assert blob_ledger.blobs(spark, ledger).count() == len({t or "" for t in SECRETS})


def test_a_new_rule_version_alone_is_applied_again(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    table = versions(spark, [SECRETS[0], SECRETS[3]])
    blob_ledger.scan(table, ledger, blob_ledger.BASE)
    newer = (*blob_ledger.BASE[:2], Rule("hex", 2, "[0-9a-f]{8,}"))
    counts = blob_ledger.scan(table, ledger, newer)
    again = [sorted(r.rules) for r in blob_ledger.blobs(spark, ledger).collect()]
    assert sorted(again) == [["access@1", "assign@1", "hex@1"]] * 2 + [["hex@2"]] * 2
    got = report(blob_ledger.report(table, ledger, counts, newer))
    assert got[1][-1] == "hex:4:12,hex:13:45,hex:46:70" and got[0] == plain_secrets(SECRETS[0])


def test_secret_scan_is_native(spark):
    plan = blob_ledger.secret_scan(versions(spark, SECRETS[:3]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secrets_empty(spark):
    assert blob_ledger.secret_scan(versions(spark, [])).count() == 0
