"""Search by sums over terms: shards, blocks and ties against a plain version."""

import random
import re
from collections import Counter

import pandas as pd
import pytest
from tessera.functions import text
from tessera.operators import index, retrieve


def test_texts_are_dealt_and_not_their_tokens(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "id long, text string")
    only = spark.createDataFrame([("a",)], "term string")
    plan = index.postings(docs, only=only)._jdf.queryExecution().executedPlan().toString()
    dealt = [i for i, line in enumerate(plan.split("\n")) if "Exchange hashpartitioning(id" in line]
    assert len(dealt) == 1 and dealt[0] > next(i for i, line in enumerate(plan.split("\n")) if "Generate explode" in line)


@pytest.mark.parametrize("ids", ["long", "string"])
def test_search_over_many_shards_and_blocks(spark, monkeypatch, ids):
    rnd = random.Random(5)
    texts = [(i if ids == "long" else f"d{i}", " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 6)))) for i in range(120)]
    texts += [(texts[3][0], "a a b"), (texts[3][0], "a a b"), (texts[4][0], "a c")]  # ids that several rows have
    asked = [(f"q{i}", " ".join(rnd.choice("abcdefghz") for _ in range(4))) for i in range(9)] + [("none", "zz")]
    docs, terms = spark.createDataFrame(texts, f"id {ids}, text string"), retrieve.query_terms(spark.createDataFrame(asked, "query_id string, text string"))
    monkeypatch.setattr(retrieve, "SHARD_POSTINGS", 20)
    monkeypatch.setattr(retrieve, "BLOCK_TERMS", 7)
    monkeypatch.setattr(retrieve, "PAIR_SUMS", 10)
    idx = index.build(docs, only=terms)
    idf = {r.term: r.idf for r in idx.terms.collect()}
    posts = Counter((i, len(t.split()), w) for i, t in texts for w in t.split())
    for search, weigh in ((retrieve.bm25, lambda tf, n, w: w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / max(idx.mean, 1)))), (retrieve.sparse, lambda tf, n, w: tf * w)):
        want = []
        for q, t in asked:
            sums = Counter()
            for (i, n, w), tf in posts.items():
                if w in t.split():
                    sums[i] += weigh(tf, n, idf[w]) * t.split().count(w)
            best = sorted(sums.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
            want += [(q, r, i, round(s, 6)) for r, (i, s) in enumerate(best, 1)]
        out = search(idx, terms, 5)
        assert out.inputFiles() and sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in out.collect()) == sorted(want)


def test_a_search_without_any_term_is_empty(spark):
    docs, terms = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([("q", "z", 1)], "query_id string, term string, times long")
    assert retrieve.bm25(index.build(docs, only=terms), terms).collect() == []
    empty = pd.DataFrame({"id": [], "code": [], "part": []}), pd.DataFrame({"query_id": ["q"], "code": [1], "times": [1]})
    assert len(retrieve._best_sums(*empty, 3)) == 0


def test_tasks_are_as_many_as_the_input_asks_for(spark, monkeypatch):
    """Not as many as the shuffle partitions that are set, which would make tasks grow with the input."""
    monkeypatch.setattr(index, "TEXT_TASK", 100)
    monkeypatch.setattr(retrieve, "SHARD_POSTINGS", 10)
    docs = spark.createDataFrame([(i, "a b c " * 5) for i in range(60)] + [(3, "a b c " * 5), (60, None)], "id long, text string")
    terms = retrieve.query_terms(spark.createDataFrame([("q", "a c")], "query_id string, text string"))
    dealt = re.findall(r"hashpartitioning\(id#\d+L?, (\d+)\)", index.postings(docs, only=terms)._jdf.queryExecution().executedPlan().toString())
    assert dealt == [str(61 * 30 // 100 + 1)]
    plans, write = [], retrieve.written
    monkeypatch.setattr(retrieve, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    idx = index.build(docs, only=terms)
    assert {(r.term, r.df) for r in idx.terms.collect()} == {("a", 60), ("c", 60)}
    assert [r.id for r in retrieve.bm25(idx, terms, 3).orderBy("rank").collect()] == [3, 0, 1]
    assert plans[-1].count("hashpartitioning(shard") == 2 and set(re.findall(r"hashpartitioning\(shard#\d+, block#\d+, (\d+)\)", plans[-1])) == {"24"}, plans[-1]


def test_a_batch_cuts_its_texts_once(spark):
    """Documents and tokens are counted where the postings are, also for rows without a term of the batch and for repeated ids."""
    texts = [(1, "a b a"), (1, "c b a"), (2, None), (3, ""), (4, "x y z x"), (None, "a q"), (None, "q a"), (5, "b")]
    docs = spark.createDataFrame(texts, "id long, text string")
    only = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "term string")
    cut = []
    idx = index.build(docs, tokenizer=lambda c: cut.append(c) or text.tokens(c), only=only)
    assert len(cut) == 1
    assert (idx.documents, idx.mean) == (len(texts), sum(len((t or "").split()) for _, t in texts) / len(texts))
    whole = index.build(docs)
    kept = {(r.id, r.term, r.tf, r.len) for r in whole.postings.collect() if r.term in "ab"}
    assert {(r.id, r.term, r.tf, r.len) for r in idx.postings.collect()} == kept and (whole.documents, whole.mean) == (idx.documents, idx.mean)
    assert {(r.term, r.df, r.idf) for r in idx.terms.collect()} == {(r.term, r.df, r.idf) for r in whole.terms.collect() if r.term in "ab"}
    none = index.build(docs.where("false"), only=only)
    assert (none.documents, none.mean, none.postings.count()) == (0, 0.0, 0)
