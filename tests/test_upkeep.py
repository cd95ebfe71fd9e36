"""Intervals of facts against a plain version, and upkeep of a versioned graph."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tessera.operators import graph
from tessera.plans import upkeep
from tessera.sources.versions import Store

T0 = datetime(2024, 1, 1)
EDGE = "src string, rel string, dst string, valid_from timestamp, valid_until timestamp"


def at(n):
    return None if n is None else T0 + timedelta(days=n)


def plain(edges, facts):
    out = []
    keys = {(s, r) for s, r, *_ in facts}
    for s, r in {(e[0], e[1]) for e in [*edges, *facts]}:
        chain = [(f, False, d, u) for a, b, d, f, u in edges if (a, b) == (s, r)]
        if (s, r) in keys:
            chain += [(f, True, d, None) for a, b, d, f in facts if (a, b) == (s, r)]
            chain.sort(key=lambda x: x[:3])
            kept = []
            for i, (f, new, d, u) in enumerate(chain):
                before = chain[i - 1] if i else None
                if not (new and before and before[2] == d and (before[3] is None or before[3] > f)):
                    kept.append([f, d, u])
            for x, y in zip(kept, [*kept[1:], None], strict=True):
                x[2] = min((t for t in (x[2], y and y[0]) if t is not None), default=None)
            out += [(s, r, d, f, u) for f, d, u in kept]
        else:
            out += [(s, r, d, f, u) for f, _, d, u in chain]
    return sorted(map(repr, out))


def test_facts_end_where_the_next_begins(spark):
    rnd = random.Random(2)
    edges = [(s, r, rnd.choice("xyz"), at(t), at(rnd.choice([None, t + 3]))) for s in "ab" for r in ("LIVES", "WORKS") for t in rnd.sample(range(20), 3)]
    facts = [(s, "LIVES", rnd.choice("xyz"), at(t)) for s in "abc" for t in rnd.sample(range(25), 4)]
    got = graph.supersede(spark.createDataFrame(edges, EDGE), spark.createDataFrame(facts, "src string, rel string, dst string, valid_from timestamp")).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(edges, facts)


def test_a_versioned_graph(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/g", 4)
    facts = lambda rows: spark.createDataFrame([(a, "LIVES", b, at(t)) for a, b, t in rows], "src string, rel string, dst string, valid_from timestamp")
    upkeep.assert_facts(s, facts([("ann", "rome", 1), ("bob", "oslo", 2)]), "t")
    upkeep.assert_facts(s, facts([("ann", "paris", 5), ("ann", "paris", 7), ("ann", "lima", 3)]), "t")
    upkeep.assert_facts(s, facts([("ann", "rome", 9), ("cid", "kyiv", 1)]), "u")
    held = {(r.src, r.dst, r.tenant_id): (r.valid_from, r.valid_until) for r in s.table("edges").collect()}
    assert held[("ann", "rome", "t")] == (at(1), at(3)) and held[("ann", "lima", "t")] == (at(3), at(5)) and held[("ann", "paris", "t")] == (at(5), None)
    assert held[("ann", "rome", "u")] == (at(9), None) and len(held) == 6
    assert {r.name for r in s.table("nodes").where("tenant_id = 't'").collect()} == {"ann", "rome", "bob", "oslo", "paris", "lima"}
    version = s.manifest()["version"]
    assert {r.table: (r.n, r.unmarked) for r in upkeep.backfill_current(s, dry_run=True).collect()} == {"nodes": (10, 0), "edges": (6, 3 + 1)} and s.manifest()["version"] == version
    report = {r.what: r.n for r in upkeep.delete_tenant(s, "t").collect()}
    assert report == {"nodes": 6, "edges": 4, "detached": 0} and s.table("edges").count() == 2 and s.table("nodes").count() == 4
    with pytest.raises(ValueError):
        upkeep.delete_tenant(s, "")


def test_tenants_markers_and_detached_edges(spark):
    nodes = spark.createDataFrame([("a", "t", None), ("b", "u", "2024"), ("c", None, "current")], "name string, tenant_id string, valid_until string")
    edges = spark.createDataFrame([("a", "R", "b", "t", None), ("b", "LINKS_TO", "a", "u", None), ("b", "LINKS_TO", "c", "u", "x"), ("c", "R", "b", None, None)], "src string, rel string, dst string, tenant_id string, valid_until string")
    kept, left, report = graph.delete_tenant(nodes, edges, "t")
    assert sorted(r.name for r in kept.collect()) == ["b", "c"] and sorted((r.src, r.dst) for r in left.collect()) == [("b", "c"), ("c", "b")]
    assert {r.what: r.n for r in report.collect()} == {"nodes": 1, "edges": 1, "detached": 1}
    assert {r.tenant_id: r.n for r in graph.tenants([nodes, edges], spark.createDataFrame([("t",), ("new",), (None,)], "tenant_id string")).collect()} == {"t": 2, "u": 3, "new": 0}
    assert [r.valid_until for r in graph.backfill_current(nodes).orderBy("name").collect()] == ["current", "2024", "current"]
    assert [r.src for r in graph.link_sources(edges).collect()] == ["b"]
    n, e = graph.stamp_tenant(nodes, edges, "z")
    assert n.where("tenant_id = 'z'").count() == 1 and e.where("tenant_id = 'z'").count() == 1
    assert nodes.where(graph.is_open()).count() == 2
