"""Operators on small literal inputs."""

import random
import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera.functions import ids, scoring, text, times
from tessera.operators import chunk, filters, fuse, graph, index, lifecycle, metrics, provenance, rank, retrieve, state, synthesis
from tessera.plans import ingest, plugins, recall

NOW = "2026-05-04 18:16:00"


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, list_name string, list_pos int, rank long, id string")


def test_rrf_scores_and_ties(spark):
    rows = [(1, "x", 0, i + 1, d) for i, d in enumerate("abc")] + [(1, "y", 1, i + 1, d) for i, d in enumerate("bda")]
    got = [(r.id, r.score) for r in fuse.rrf(ranked(spark, rows)).orderBy("rank").collect()]
    assert [d for d, _ in got] == ["b", "a", "d", "c"]
    assert dict(got)["b"] == pytest.approx(1 / 62 + 1 / 61) and dict(got)["a"] == pytest.approx(1 / 61 + 1 / 63)
    only = fuse.rrf(ranked(spark, rows), weight=fuse.static_weight({"y": -5})).orderBy("rank").collect()
    assert [r.id for r in only] == ["a", "b", "c"]


def test_bm25_counts_repeated_terms(spark):
    docs = spark.createDataFrame([(1, "red apple red"), (2, "green pear"), (3, "apple")], "id long, text string")
    idx = index.build(docs)
    q = lambda t: {r.id: r.score for r in retrieve.bm25(idx, retrieve.query_terms(spark.createDataFrame([(1, t)], "query_id long, text string"))).collect()}
    once, twice = q("red"), q("red red")
    assert set(once) == {1} and twice[1] == pytest.approx(2 * once[1])
    n, df, tf, dl, avg = 3, 1, 2, 3, 2.0
    import math

    assert once[1] == pytest.approx(math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)))


def test_vector_search_is_exact_and_blockwise(spark, monkeypatch):
    rnd = random.Random(1)
    vecs = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    v = spark.createDataFrame([*vecs, (200, None), (201, [0.0] * 8)], "id long, embedding array<float>")
    qs = spark.createDataFrame([(i, x) for i, x in vecs[:7]] + [(999, None)], "query_id long, vec array<float>")
    want = {(r.query_id, r.rank, r.id) for r in retrieve.vector(v, qs, 5).collect()}
    assert len(want) == 35 and all((i, 1, i) in want for i in range(7))
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 2)
    assert {(r.query_id, r.rank, r.id) for r in retrieve.vector(v, qs, 5).collect()} == want
    assert all(r.query_id != r.id for r in retrieve.vector(v, qs, 5, exclude_self=True).collect())


def test_filters_miss_and_mismatch(spark):
    df = spark.createDataFrame([(1, "5", ["a", "b"]), (2, "seven", ["c"]), (3, None, None)], "id long, n string, tags array<string>")
    ids_ = lambda f: [r.id for r in df.where(filters.payload_filter(f, df.schema)).collect()]
    assert ids_({"n": {"gte": 5}}) == [1] and ids_({"tags": "b"}) == [1] and ids_({"absent": 1}) == [] and ids_({}) == [1, 2, 3]


def test_validity_in_two_times(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01", "2024-02-01", None), (2, "2024-01-01", "current", "2024-01-20"), (3, None, None, "")], "id long, valid_from string, valid_until string, invalidated_at string"
    )
    at = lambda t: sorted(r.id for r in filters.validity(df, t).collect())
    assert at("2024-02-01 00:00:00") == [2, 3] and at("2024-01-31 23:59:59") == [1, 2, 3]
    assert sorted(r.id for r in filters.validity(df).collect()) == [1, 3]
    with pytest.raises(ValueError):
        filters.tenant_scope(df, "")


def test_token_budget_is_never_passed(spark):
    rows = spark.createDataFrame([(1, i + 1, n) for i, n in enumerate([5, 4, 3])] + [(2, 1, 10), (2, 2, 1)], "query_id long, rank long, n long")
    kept = {(r.query_id, r.rank) for r in fuse.token_budget(rows, 9, F.col("n")).collect()}
    assert kept == {(1, 1), (1, 2)}
    with pytest.raises(ValueError):
        fuse.token_budget(rows, 0, F.col("n"))


def test_token_estimate_rounds_half_to_even(spark):
    texts = ["", "a" * 10, "a" * 14, "яя", "a"]
    got = [r.t for r in spark.createDataFrame([(x,) for x in texts], "x string").select(text.estimate_tokens("x").alias("t")).collect()]
    assert got == [0, 2, 4, 1, 1]


def test_hub_limits_take_the_index(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 100])], "id long, degree long")
    assert rank.hub_limits(df) == (100, 100)
    assert rank.hub_limits(spark.createDataFrame([(i, i) for i in range(20)], "id long, degree long")) == (18, 19)
    assert rank.hub_limits(df.limit(0)) == (None, None)


def test_degrees_are_found_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    edges = spark.createDataFrame([(i, i // 10 * 10) for i in range(1, 40)] + [(None, 7)], "src long, dst long")
    hits = spark.createDataFrame([("q", 10, 1, 1.0), ("q", 5, 2, 1.0), ("q", 99, 3, 1.0)], "query_id string, id long, rank long, score double")
    out = rank.hub(graph.degrees(edges.mapInPandas(counted, edges.schema)))(hits).collect()
    assert read.value == 40
    assert {r.id: round(r.score, 6) for r in out} == {10: 0.4, 5: 1.0, 99: 1.0}
    assert {r.id: r.degree for r in graph.degrees(edges).collect()}[None] == 1


def test_freshness_of_the_future_and_the_unknown(spark):
    rows = [(1, 1, 1, 0.0, "2026-05-05 18:16:00", "x"), (1, 2, 2, 0.0, None, "notes"), (1, 3, 3, 0.0, None, "MEMORY.md"), (1, 4, 4, 0.0, None, "log/2026-05-04.md")]
    df = spark.createDataFrame(rows, "query_id long, rank long, id long, score double, ts string, source string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: r.score for r in rank.freshness(NOW)(df).collect()}
    assert got[1] == pytest.approx(0.2 * 0.5) and got[2] == pytest.approx(0.2 * 0.5) and got[3] == pytest.approx(0.2 * 0.8) and got[4] > 0.19


def test_curiosity_of_unknown_dates(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.0, None), (1, 2, 2, 0.0, "2026-04-01"), (1, 3, 3, 0.0, "2026-05-03")], "query_id long, rank long, id long, score double, ts string")
    events = spark.createDataFrame([], "id long, ts timestamp")
    assert [r.score for r in rank.curiosity(events, NOW)(df).orderBy("id").collect()] == [0.025, 0.05, 0.0]


def value(spark, c):
    """Of a Column without a table."""
    return spark.range(1).select(c.alias("v")).first().v


def test_exact_tokens(spark):
    found = value(spark, text.exact_tokens(F.lit("fix /etc/app.conf on 10.0.0.1, see main/develop, src/x.py, fooBarBaz, snake_case, v-12b and/or 1/2")))
    assert found == ["10.0.0.1", "/etc/app.conf", "main", "develop", "src/x.py", "snake_case", "v-12b", "fooBarBaz"]
    assert value(spark, text.identifier_tokens(F.lit("parseHttpRequest x"))) == ["parse", "http", "request", "parsehttprequest"]
    assert value(spark, text.gate_tokens(F.lit("why does src/x.py fail on 10.0.0.1 yesterday")))[:3] == ["10.0.0.1", "src/x.py", "yesterday"]


@pytest.mark.parametrize(
    ("query", "target", "focused"),
    [
        ("what happened yesterday", "2026-05-03", True), ("что делали позавчера", "2026-05-02", True), ("notes on 2026-04-30", "2026-04-30", True), ("deploy issues 3 days ago", "2026-05-01", False),
        ("30 апреля", "2026-04-30", True), ("April 30th 2025 log", "2025-04-30", True), ("2 weeks ago", "2026-04-20", True),
    ],
)
def test_dates_in_queries(spark, query, target, focused):
    _, _, day, is_focused = value(spark, times.temporal_window(F.lit(query), "2026-05-04 18:16:00"))
    assert (day, is_focused) == (target, focused)


def test_windows_in_queries(spark):
    find = lambda q: value(spark, times.temporal_window(F.lit(q), "2026-05-04 18:16:00"))
    assert find("around April 30")[:2] == ("2026-04-27T00:00:00+00:00", "2026-05-03T23:59:59.999999+00:00")
    assert find("mid-April")[:2] == ("2026-04-11T00:00:00+00:00", "2026-04-20T23:59:59.999999+00:00")
    assert find("in december 2024")[:2] == ("2024-12-01T00:00:00+00:00", "2025-01-01T00:00:00+00:00")
    assert find("you may go").start is None and find("all of 2023").start.startswith("2023-01-01") and find("in may").end.startswith("2026-06-01")
    assert find("2026-02-31") == ("2026-02-01T00:00:00+00:00", "2026-03-01T00:00:00+00:00", None, False) or find("2026-02-31").target is None


def test_instants_in_three_domains(spark):
    rows = [("2026-05-04T00:00:00Z",), ("2026-05-04",), ("1777852800",), ("1777852800000",), ("2026",), ("T10:00",), ("soon",), (None,)]
    got = [r.t for r in spark.createDataFrame(rows, "x string").select(F.unix_timestamp(times.parse_instant(F.col("x"))).alias("t")).collect()]
    assert got[:4] == [1777852800] * 4 and got[4] == 2026 and got[5:] == [None] * 3


def test_tokens_split_at_combining_marks(spark):
    got = spark.createDataFrame([("a\u0301b Été_1",)], "x string").select(text.tokens("x").alias("t")).first().t
    assert got == ["a", "b", "été_1"]


def test_stable_ids_name_tenants(spark):
    import hashlib
    import uuid

    row = spark.range(1).select(ids.stable_id(F.lit("s"), F.lit(3), F.lit("t")).alias("a"), ids.stable_id(F.lit("s"), F.lit(3), F.lit("t"), F.lit("x")).alias("b")).first()
    assert row.a == str(uuid.UUID(hashlib.sha256(b"s|3|t").hexdigest()[:32])) and row.b == str(uuid.UUID(hashlib.sha256(b"x\0s|3|t").hexdigest()[:32]))


def test_message_windows_take_the_middle(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate("abcd")], "conv long, turn long, text string")
    assert {(r.text, r.middle) for r in chunk.windows(df, 3, "conv", "turn", separator="").collect()} == {("abc", 1), ("bcd", 2)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["def a():\n", "    x = 1\n", "# note\n", "@wrap\n", "class B:\n", "\n", "y = 2\n", "z" * 90 + "\n"]), max_size=60), st.integers(20, 200))
def test_code_chunks_partition_the_text(parts, most):
    source = "".join(parts)
    found = chunk.find_definitions(source, "python", most, 30)
    at = 0
    for offset, piece, _ in found:
        assert not source[at:offset].strip() and source[offset : offset + len(piece)] == piece and len(piece) <= most
        at = offset + len(piece)
    assert not source[at:].strip()


def test_comments_and_decorators_stay_with_their_definition():
    source = "def first():\n" + "    pass\n" * 30 + "# about second\n@wrap\ndef second():\n    pass\n"
    found = chunk.find_definitions(source, "python")
    assert [s for _, _, s in found] == ["first", "second"] and found[1][1].startswith("# about second\n@wrap")


def test_markdown_sections_carry_their_path():
    source = "intro\n\n# A\ntext\n\n```\n# no heading\n```\n\n## B\nmore\n\n> # quoted\n\nC\n===\nend\n"
    found = chunk.find_sections(source)
    assert [(p, t.split("\n")[0]) for _, t, p, _ in found] == [([], "intro"), (["A"], "# A"), (["A", "B"], "[A]"), (["C"], "C")]
    assert all(source[o:].startswith(t[n:][:3]) for o, t, p, n in found if p)


def test_paragraphs_pack_up_to_the_size():
    source = "\n\n".join(["a" * 300, "b" * 300, "c" * 300, "d" * 900])
    found = chunk.find_paragraphs(source)
    assert [(o, len(t)) for o, t in found] == [(0, 602), (604, 300), (906, 900)]
    assert all(source[o : o + len(t)] == t for o, t in found)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a" * 5, "b" * 12, " c" * 9, "d" * 40, "\n", "\n\n", "\n \t\n", "  "]), max_size=40), st.integers(1, 45), st.integers(0, 30))
def test_paragraphs_are_packed_as_one_by_one(parts, size, least):
    source, groups = "".join(parts), []
    at = 0
    for part in re.split(r"(\n\s*\n)", source):
        if body := part.strip():
            used = sum(len(b) + 2 for _, b in groups[-1]) if groups else 0
            if not groups or len(body) >= size or len(groups[-1][0][1]) >= size or (used + len(body) + 2 > size and used >= least):
                groups.append([])
            groups[-1].append((at, body))
        at += len(part)
    assert chunk.find_paragraphs(source, size, least) == [(g[0][0], "\n\n".join(b for _, b in g)) for g in groups]


@pytest.mark.parametrize(
    "language, line, name",
    [("rust", "pub(crate) fn run() {", "run"), ("typescript", "export default class Box {", "Box"), ("go", "func (r *Repo) Get() {", "Get"), ("c", "static int parse(char *s) {", "parse"), ("cpp", "int Box::size() {", "size"), ("kotlin", "enum class Kind {", "Kind"), ("shell", "run() {", "run")],
)
def test_definitions_by_language(language, line, name):
    source = "x = 1\n" * 60 + f"// about\n{line}\n}}\n"
    assert chunk.find_definitions(source, language)[-1][2] == name
    assert all(s is None for _, _, s in chunk.find_definitions("int parse(char *s);\n" * 20, "c"))


def test_times_compare_across_domains(spark):
    rows = [(1, "2024-01-01T00:00:00Z"), (2, "1704067200"), (3, "1704153600000"), (4, "someday"), (5, None), (6, "2024-01-03")]
    df = spark.createDataFrame(rows, "id long, ts string")

    def kept(want, frame=df, key="ts"):
        return [r.id for r in frame.where(filters.payload_filter({"ts": want}, frame.schema, key)).orderBy("id").collect()]

    assert kept("2024-01-01T00:00:00+00:00") == [1, 2] and kept(1704067200) == [1, 2] and kept("someday") == [4]
    assert kept({"gte": 1704067200, "lte": "2024-01-02T12:00:00Z"}) == [1, 2, 3] and kept({"gte": "2024-01-02"}) == [3, 4, 6]
    epochs = spark.createDataFrame([(1, 1704067200), (2, 1704153600), (3, None)], "id long, ts long")
    assert kept({"gte": "2024-01-02T00:00:00Z"}, epochs) == [2] and kept({"gte": "later"}, epochs, None) == [] and kept({"gte": "1704100000"}, epochs, None) == [2]
    stamps = epochs.select("id", F.timestamp_seconds("ts").alias("ts"))
    bounds = filters.native_bounds({"ts": {"gte": 1704153600}}, "ts", stamps.schema)
    assert [r.id for r in stamps.where(filters.payload_filter(bounds, stamps.schema)).collect()] == [2] and kept({"lte": 5}, stamps, None) == []


def test_scope_is_checked_again_after_the_stages(spark):
    hits = spark.createDataFrame([(1, ["graph"], True, "x"), (2, ["graph", "bm25"], True, "x"), (3, ["graph"], False, "x"), (4, ["bm25"], None, "y"), (5, ["graph"], None, None)], "id long, sources array<string>, attributed boolean, lang string")
    assert [r.id for r in hits.where(filters.passes_scope(F.col("lang") == "y")).orderBy("id").collect()] == [1, 4]
    names = spark.createDataFrame([("a.md",), ("b.md",), (None,)], "name string")
    chunks = spark.createDataFrame([("a.md",), ("a.md",), (None,)], "source string")
    assert [r.name for r in filters.attributed(names, chunks).collect()] == ["a.md"]
    nested = spark.createDataFrame([(1, "t", [(1, "t"), (2, "u"), (3, None)]), (2, "u", [])], "id long, tenant_id string, more array<struct<id:long,tenant_id:string>>")
    got = filters.scrub_tenant(nested, "t", "more").collect()
    assert [(r.id, [m.id for m in r.more]) for r in got] == [(1, [1])] and filters.scrub_tenant(nested, None).count() == 2


def test_lifecycle_round_trip(spark):
    stored = spark.createDataFrame([(1, "a", "t1", None), (2, "b", "t2", None), (3, "c", None, None)], "id long, source string, tenant_id string, invalidated_at string")
    fresh = spark.createDataFrame([(1, "a2", None), (4, "d", None)], "id long, source string, tenant_id string")
    new = {r.id: (r.source, r.tenant_id) for r in lifecycle.upsert(stored, fresh).collect()}
    assert new == {1: ("a2", "t1"), 2: ("b", "t2"), 3: ("c", None), 4: ("d", None)}
    gone = lifecycle.invalidate(stored, stored.select("id"), F.lit("now"), tenant="t1")
    assert [r.id for r in gone.where(filters.is_current()).orderBy("id").collect()] == [2, 3]
    assert [r.id for r in lifecycle.delete_tenant(stored, "t1").orderBy("id").collect()] == [2, 3]
    with pytest.raises(ValueError):
        lifecycle.delete_tenant(stored, "")
    maps = spark.createDataFrame([(1, {"a": "1", "tenant_id": "x"})], "id long, payload map<string,string>")
    patch = spark.createDataFrame([(1, {"a": "2", "b": "3"})], "id long, payload map<string,string>")
    assert lifecycle.set_payload(maps, patch).first().payload == {"a": "2", "b": "3", "tenant_id": "x"}
    assert lifecycle.delete_keys(maps, ["a", "tenant_id"]).first().payload == {"tenant_id": "x"}


def test_graph_edges_close_once(spark):
    edges = spark.createDataFrame([("a", "r", "b", None, "current"), ("a", "r", "c", None, "2024-01-01")], "src string, rel string, dst string, valid_from string, valid_until string")
    out = {r.dst: r.valid_until for r in graph.close_edges(edges, edges.select("src", "rel", "dst"), F.lit("2025-01-01")).collect()}
    assert out == {"b": "2025-01-01", "c": "2024-01-01"}


def test_verdicts(spark):
    import hashlib

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    cited = spark.createDataFrame([("s1", "abc", 0, h("abcdef")), ("s2", "abc", 0, h("abcdef")), ("s3", "abc", 0, None), ("s4", "abc", 0, None), ("s5", "abc", 0, None), ("s1", "", 0, None)], "source string, text string, offset int, snapshot string")
    current = spark.createDataFrame([("s1", "abcdef"), ("s2", "abcXYZ"), ("s3", "..abc"), ("s4", "nothing")], "source string, content string")
    got = [r.verdict for r in provenance.verdicts(cited, current).orderBy("source", F.desc("text")).collect()]
    assert got == ["intact", "unresolvable", "source_changed", "moved", "changed", "missing"]


def test_near_facts_keep_the_most_relevant(spark):
    rows = [("e", 1, "The quick brown fox jumps over the lazy dog", 0.5), ("e", 2, "the quick  brown fox jumps over the lazy dog!", 0.9), ("e", 3, "Something else entirely", 0.1)]
    df = spark.createDataFrame(rows, "entity string, fact_id long, text string, relevance double")
    assert [r.fact_id for r in synthesis.near_facts(df).orderBy("place").collect()] == [2, 3]


def test_token_bucket_refills(spark):
    rows = [("t", i, datetime(2026, 1, 1, 0, 0, s)) for i, s in enumerate([0, 0, 0, 1, 30])]
    df = spark.createDataFrame(rows, "tenant_id string, event_id long, ts timestamp")
    assert [r.allowed for r in state.token_bucket(df, rate=0.5, capacity=2.0).orderBy("event_id").collect()] == [True, True, False, False, True]


def test_metrics_over_found_and_all(spark):
    row = metrics.retrieval(spark.createDataFrame([(1, 1), (2, 4), (3, None)], "probe_id long, rank long")).first()
    assert (row.recall_1, row.recall_5) == (pytest.approx(1 / 3), pytest.approx(2 / 3)) and row.mrr_found == pytest.approx(0.625) and row.mrr_all == pytest.approx(1.25 / 3)


def test_answers_are_parsed(spark):
    df = spark.createDataFrame([("It is blue.\nCONFIDENCE: 1.7",), ("plain",)], "x string").select(plugins.parse_answer(F.col("x")).alias("a"))
    assert [(r.a.text, r.a.confidence) for r in df.collect()] == [("It is blue.", 1.0), ("plain", 0.5)]


def test_recall_isolates_tenants_and_respects_the_budget(spark):
    rows = [(i, f"alpha beta {'gamma ' * (i % 5)}", f"t{i % 2}", "src") for i in range(40)]
    chunks = spark.createDataFrame(rows, "id long, text string, tenant_id string, source string")
    embedder = plugins.hashing_embedder(16)
    vectors = plugins.embed(chunks, embedder).select("id", "embedding")
    qs = spark.createDataFrame([(1, "alpha gamma")], "query_id long, text string")
    qs = plugins.embed(qs, embedder).withColumnRenamed("embedding", "vec")
    out = recall.recall(chunks, vectors, qs, recall.RecallConfig(tenant="t1", token_budget=30, vector_floor=2)).collect()
    assert out and {r.tenant_id for r in out} == {"t1"} and sum(r.tokens for r in out) <= 30
    with pytest.raises(ValueError):
        recall.RecallConfig(lexical="other")


def test_ingest_is_idempotent(spark):
    calls = plugins.hashing_embedder(8)
    items = spark.createDataFrame([("s", 0, "one"), ("s", 1, "two"), ("s", 0, "one")], "source string, offset long, text string")
    empty = spark.createDataFrame([], "id string, source string, offset long, text string, tenant_id string, embedding array<float>")
    once = ingest.ingest(items, empty, calls, tenant="t").cache()
    assert once.count() == 2 and ingest.ingest(items, once, calls, tenant="t").count() == 2
    with pytest.raises(ValueError):
        ingest.ingest(items, empty, calls, tenant="t", limit=1)


def test_decay_has_a_floor(spark):
    row = spark.range(1).select(
        scoring.decay(F.lit(None).cast("timestamp"), F.lit(0), F.lit(NOW)).alias("a"), scoring.decay(F.lit("2020-01-01"), F.lit(0), F.lit(NOW)).alias("b"), scoring.decay(F.lit("2026-04-04 18:16:00"), F.lit(0), F.lit(NOW)).alias("c")
    ).first()
    assert row.a == 1 and row.b == 0.1 and row.c == pytest.approx(0.5, abs=1e-3)


def test_sources_skip_blank_windows(spark, tmp_path):
    from tessera.sources import corpus, tables

    (tmp_path / "a.md").write_text("x" * 900)
    (tmp_path / "b.txt").write_text("   \n")
    (tmp_path / "c.py").write_text("def f():\n    return 1\n")
    got = corpus.documents(spark, str(tmp_path)).collect()
    assert sorted((r.offset, len(r.text)) for r in got) == [(0, 800), (800, 100)]
    assert [r.language for r in corpus.code(spark, str(tmp_path)).collect()] == ["python"]
    path = str(tmp_path / "table")
    tables.replace(spark.createDataFrame([(1, "a")], "id long, x string"), path)
    again = tables.replace(spark.read.parquet(path).withColumn("x", F.lit("b")), path)
    assert [r.x for r in again.collect()] == ["b"]


def test_library_does_not_import_the_optional_part():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "tessera"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"tessera\.llm|from \.+llm|import llm", f.read_text()), f


def test_the_survivor_of_equal_ids_does_not_depend_on_partitions(spark):
    stored = spark.createDataFrame([], "id int, text string, ts int")
    rows = [(1, f"t{i}", i % 3) for i in range(20)]
    got = {lifecycle.upsert(stored, spark.createDataFrame(rows, "id int, text string, ts int").repartition(n), order=order).first().text for n in (1, 3, 7) for order in (None,)}
    assert got == {"t9"}
    assert lifecycle.upsert(stored, spark.createDataFrame(rows, "id int, text string, ts int"), order=["ts"]).first().text == "t8"
