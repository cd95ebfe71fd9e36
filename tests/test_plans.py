"""Plans around a model, with fakes; Markdown links and front matter."""

import pytest
from pyspark.sql import functions as F
from tessera.functions import markup
from tessera.plans import answers, plugins


@pytest.fixture(scope="module")
def results(spark):
    rows = [(1, i + 1, f"m{i}", f"memory {i} of blue things", "who is it", f"s{i % 2}") for i in range(4)]
    return spark.createDataFrame(rows, "query_id long, rank long, id string, text string, query string, source string")


def test_rerank_takes_ordinals_and_ids_and_keeps_the_rest(results):
    out = answers.rerank(results, lambda p: "[R2, m0]").orderBy("rank").collect()
    assert [r.id for r in out] == ["m2", "m0", "m1", "m3"]

    def fails(p):
        raise RuntimeError

    assert [r.id for r in answers.rerank(results, fails).orderBy("rank").collect()] == ["m0", "m1", "m2", "m3"]


def test_answers_abstain_without_memories(spark, results):
    qs = spark.createDataFrame([(1, "how many blue things"), (2, "when was it")], "query_id long, text string")
    out = {r.query_id: r for r in answers.answer(qs, results, lambda p: "Four.\nCONFIDENCE: 0.9").collect()}
    assert (out[1].category, out[1].answer, out[1].confidence, out[1].sources) == ("count", "Four.", 0.9, ["s0", "s1"])
    assert (out[2].answer, out[2].confidence) == (answers.ABSTAIN, 0.0)
    assert [r.query_id for r in spark.createDataFrame(list(out.values())).where(answers.needs_retry("confidence")).collect()] == [2]


def test_items_and_variants_without_repeats(spark, results):
    items = {r.key: (r.item, r.support) for r in answers.extract_items(results, lambda p: "- Blue Cup\n- blue  cup\n2. Hat", batch=2).collect()}
    assert items == {"blue cup": ("Blue Cup", 4), "hat": ("Hat", 2)}
    qs = spark.createDataFrame([(1, "what are the cups"), (2, "cup?")], "query_id long, text string")
    got = answers.variants(qs, lambda p: "cups there\nWhat are the cups\ncups there", 2, lists_only=True).collect()
    assert sorted((r.query_id, r.variant, r.text) for r in got) == [(1, 0, "what are the cups"), (1, 1, "cups there"), (2, 0, "cup?")]


def test_hypothetical_documents_fall_back_to_the_query(spark):
    qs = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    embedder = plugins.hashing_embedder(8)
    assert answers.hypothetical(qs, lambda p: "beta gamma", embedder).first().vec == pytest.approx(embedder(["beta gamma"])[0], abs=1e-6)
    assert answers.hypothetical(qs, lambda p: "", embedder).first().vec == pytest.approx(embedder(["alpha"])[0], abs=1e-6)


def test_triples_and_enrichers(spark):
    docs = spark.createDataFrame([(1, "t", {"a": "1"})], "id long, text string, payload map<string,string>")
    got = answers.triples(docs, lambda p: '```json\n[["Ann", "works at", "Acme"], ["x", "y"]]\n```').collect()
    assert [(r.src, r.rel, r.dst) for r in got] == [("Ann", "WORKS_AT", "Acme")]
    assert answers.triples(docs, lambda p: "no json").count() == 0
    assert plugins.enrich(docs, lambda t: {"a": 2, "tenant_id": "evil"}).first().payload == {"a": "2"}


def test_field_weights():
    assert answers.field_weights("title:2.0,text") == {"title": 2.0, "text": 1.0} and answers.field_weights(None) == {}
    for bad in (",a", "a,a", "a:x", {True: 1}, "a:-1"):
        with pytest.raises(ValueError):
            answers.field_weights(bad)


def test_links_of_notes(spark):
    note = "[a](b.md) [x](http://e.org) ![i](p.png) [[Wiki Note|alias]] ![[embed]] \\[[no]] `[[code]]` [p](paper%2Epdf?d=1) [s](<my note.md>) [t](dir/c%20d.md#h \"t\") [[2026.07.04]]\n```\n[[fenced]]\n```\n<!-- [[gone]] --> [a](b.md)"
    assert markup.find_links(note) == [("b", False), ("Wiki Note", True), ("my note", False), ("dir/c d", False), ("2026.07.04", True)]
    row = spark.createDataFrame([(note,)], "x string").select(F.size(markup.links("x")).alias("n")).first()
    assert row.n == 5


def test_front_matter():
    assert markup.front_matter("﻿---\ntitle: T\ntags: [a]\n---\nbody") == ({"title": "T", "tags": ["a"]}, "body")
    assert markup.front_matter("---\n: [\n---\nbody") == ({}, "body") and markup.front_matter("no") == ({}, "no") and markup.front_matter("---\n---\nx") == ({}, "x")


def test_ids_keep_their_types(spark):
    from tessera.operators import filters, retrieve, synthesis
    from tessera.plans.recall import RecallConfig, recall

    big = (1 << 60) + 1
    for a, b in (("1f0c-a", "9e2d-b"), (big, big + 2)):
        kind = "string" if isinstance(a, str) else "long"
        chunks = spark.createDataFrame([(a, "blue cup on the table", "s"), (b, "red hat in the hall", "s"), (None, "blue cup", "s")], f"id {kind}, text string, source string").where("id IS NOT NULL")
        vectors = spark.createDataFrame([(a, [1.0, 0.0]), (b, [0.0, 1.0]), (None, [1.0, 0.0])], f"id {kind}, embedding array<double>").coalesce(1)
        queries = spark.createDataFrame([(1, "blue cup", [1.0, 0.1])], "query_id long, text string, vec array<double>")
        assert [r.id for r in retrieve.vector(vectors, queries, 2).orderBy("rank").collect()] == [a, b]
        assert recall(chunks, vectors, queries, RecallConfig()).orderBy("rank").first().id == a
        facts = spark.createDataFrame([("e", a, "one fact", 0.9, "2024-01-01"), ("e", b, "quite another thing", 0.8, "2024-01-02")], f"entity string, fact_id {kind}, text string, relevance double, ts string")
        assert {r.fact_id for r in synthesis.near_facts(facts).collect()} == {a, b}
    rows = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", "current"), (2, "someday", None), (3, None, "2023-01-01")], "id long, valid_from string, valid_until string")
    assert [r.id for r in filters.validity(rows, "2024-01-20 00:00:00").orderBy("id").collect()] == [1]


def test_ties_are_cut_by_id(spark):
    from tessera.operators import retrieve

    vectors = spark.range(2500).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    queries = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, vec array<double>")
    assert [r.id for r in retrieve.vector(vectors, queries, 3, exclude_self=True).orderBy("rank").collect()] == [0, 1, 2]


def test_arms_of_recall(spark):
    from tessera.operators import retrieve
    from tessera.plans.recall import RecallConfig, graph_arm, recall

    rows = [
        ("a", "plan of the day", "2024-01-05.md", "2024-01-05 09:00:00", [1.0, 0.0], "Ann wrote"),
        ("b", "other things of the day", "x.md", "2024-01-05 12:00:00", [0.0, 1.0], "Bob wrote"),
        ("c", "the day after", "Acme", "2024-01-06 01:00:00", [0.6, 0.8], "Ann again"),
        ("d", "error in parse_token_stream at 10.1.2.3", "y.md", "2023-05-01 00:00:00", [-1.0, 0.0], None),
    ]
    chunks = spark.createDataFrame(rows, "id string, text string, source string, ts string, embedding array<double>, author string")
    vectors, chunks = chunks.select("id", "embedding"), chunks.drop("embedding")
    queries = spark.createDataFrame([(1, "what happened on 2024-01-05", [1.0, 0.0]), (2, "report about budget in January 2024", [0.0, 1.0]), (3, "where is 10.1.2.3 used by Acme", [-1.0, 0.1])], "query_id long, text string, vec array<double>")

    plain = lambda df: [(r.query_id, r.id) for r in df.orderBy("query_id", "rank").collect()]
    assert plain(retrieve.temporal(chunks, vectors, queries, "2024-02-01")) == [(1, "a"), (1, "b"), (1, "c"), (2, "b"), (2, "c"), (2, "a")]
    assert plain(retrieve.temporal(chunks, vectors, queries, "2024-02-01", gte=F.lit("2024-01-06 00:00:00").cast("timestamp"))) == [(1, "c"), (2, "c")]

    nodes = spark.createDataFrame([("Acme", "Company"), ("Bare", "Person")], "name string, type string")
    edges = spark.createDataFrame([("Ann", "WORKS_AT", "Acme", "2024-01-01", None), ("Bob", "LEFT", "Acme", "2020-01-01", "2021-01-01")], "src string, rel string, dst string, valid_from string, valid_until string")
    named = queries.withColumn("text", F.concat("text", F.lit(" Bare")))
    assert [(r.query_id, r.id, r.text) for r in retrieve.graph(nodes, edges, named, as_of="2024-02-01").collect()] == [(3, "graph:Acme", "Company: Acme. Ann-[WORKS_AT]->Acme")]

    # All arms at once; only weights of arms that shall speak are left.
    config = RecallConfig(now="2024-02-01", exact=True, fields={"author": 2.0}, weights={"bm25": 0.0, "vector": 0.0})
    ask = queries.withColumn("text", F.when(F.col("query_id") == 2, "what has Ann done").otherwise(F.col("text")))
    got = recall(chunks, vectors, ask, config, nodes=nodes, edges=edges).collect()
    arms = {(r.query_id, s, r.id) for r in got for s in r.sources}
    assert {a[2] for a in arms if a[0] == 1 and a[1] == "temporal"} == {"a", "b", "c"} and {a for a in arms if a[1] == "exact"} == {(3, "exact", "d")}
    assert {a[2] for a in arms if a[1] == "text:author" and a[0] == 2} == {"a", "c"} and {a for a in arms if a[1] == "graph"} == {(3, "graph", "graph:Acme")}
    assert [r.text for r in got if r.id == "graph:Acme"] == ["Company: Acme. Ann-[WORKS_AT]->Acme; Bob-[LEFT]->Acme"]
    scoped = RecallConfig(lexical="off", weights={"vector": 0.0}, filters={"source": "Acme"})
    assert [(r.id, r.text) for r in recall(chunks, vectors, queries, scoped, nodes=nodes, edges=edges).collect()] == [("graph:Acme", "Company: Acme")]
    assert graph_arm(nodes, edges, chunks, queries, RecallConfig(tenant="t")) is None


def test_fallback_and_stored_index(spark, tmp_path):
    from tessera.operators import index, retrieve
    from tessera.plans.recall import RecallConfig, recall

    chunks = spark.createDataFrame([(1, "blue cup"), (2, "red hat"), (3, "blue hat")], "id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, "blue cup", [1.0, 0.0]), (2, "hat", [-1.0, 0.1])], "query_id long, text string, vec array<double>")
    got = recall(chunks, vectors, queries, RecallConfig(lexical="off", vector_min_score=0.9, fallback=True, limit=2)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.sources) for r in got] == [(1, 1, ["vector"]), (2, 2, ["vector"]), (2, 3, ["vector"])]

    index.save(index.build(chunks), str(tmp_path / "index"), 4)
    terms = retrieve.query_terms(queries)
    stored, fresh = index.load(spark, str(tmp_path / "index"), terms), index.build(chunks, only=terms)
    rows = lambda idx: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in retrieve.bm25(idx, terms).collect())
    assert rows(stored) == rows(fresh) and len(rows(stored)) == 4
    assert len(recall(chunks, None, queries, idx=stored).collect()) == 4
