import random

import numpy as np
import xxhash
from tessera.llm import simhash


def slow_print(text, size=4):
    words = (text or "").encode().translate(simhash.LOWERING).split()
    if not words:
        return 0
    runs = [words[i : i + size] for i in range(len(words) - size + 1)] or [words]
    hashes = [xxhash.xxh64(b" ".join(r), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    """doc_id -> (fingerprint, component) by comparing all pairs."""
    prints = [(d, slow_print(t)) for d, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 4:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        low[find(i)] = min(d, low.get(find(i), d))
    return {d: (f"{f:016x}", low[find(i)]) for i, (d, f) in enumerate(prints)}


def corpus(seed=5):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 30, 300, 800]))]
        rows.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 3])):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append(" ".join(copy))
    rows += [None, "", " \t ", rows[0], rows[0].upper(), "One", "one two\x85three four five"]
    return list(enumerate(rows))


def test_groups_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(df.repartition(3)).collect()}
    assert got == slow_groups(rows)


def test_every_link_of_random_fingerprints(spark):
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 400, dtype=np.int64).view(np.uint64)
    near = base.copy()
    for i in range(len(near)):
        for bit in rnd.choice(64, rnd.integers(1, 6), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(bit)
    fps = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "node long")
    for count in (len(fps), 8 * simhash.BLOCK_ROWS):  # one block a segment, and several
        got = {tuple(sorted((r.a, r.b))) for r in simhash.links(df, count).collect()}
        nodes = {x for pair in got for x in pair}
        want = set()
        for x in fps:
            d = np.bitwise_count(fps ^ x)
            for y in fps[(d > 0) & (d <= 4)]:
                want.add(tuple(sorted((int(x.view(np.int64)), int(y.view(np.int64))))))
        assert got <= want and nodes == {x for pair in want for x in pair}


def test_large_runs_join_without_all_pairs():
    rnd = np.random.default_rng(1)
    lanes = np.zeros((500, 1), np.uint64)
    lanes[:400, 0] = 1 << rnd.integers(0, 32, 400, dtype=np.uint64)
    lanes[400:, 0] = np.uint64(0xFFFFFFFF00000000) ^ (np.uint64(1) << rnd.integers(0, 32, 100, dtype=np.uint64))
    a, b = simhash.links_in_block(np.zeros(500, np.uint64), np.arange(500), lanes, 4)
    assert len(a) == 498 and set(b.tolist()) == {0, 400}


def test_near_copies_go_and_others_stay(spark):
    rnd = random.Random(2)
    words = [f"v{i}" for i in range(5000)]
    rows, copies = [], set()
    for i in range(120):
        base = [rnd.choice(words) for _ in range(400)]
        rows.append((len(rows), " ".join(base), "x"))
        if i % 2:
            for at in rnd.sample(range(400), 4):
                base[at] = "changed"
            copies.add(len(rows))
            rows.append((len(rows), " ".join(base), "y"))
    rows += [(None, "no id", "z"), (None, "no id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sketch string")
    got = simhash.drop_near(df)
    assert got.columns == df.columns
    kept = [r.doc_id for r in got.collect()]
    assert kept.count(None) == 2
    kept = {x for x in kept if x is not None}
    assert kept.isdisjoint(copies) and len(kept) == 120


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert simhash.near_groups(empty).count() == 0
    assert simhash.drop_near(empty).count() == 0


def halves(rnd, size, common):
    """Two texts of ``size`` five-word shingles each, of which they share the first ``common``."""
    words = lambda n: [f"h{rnd.getrandbits(60)}" for _ in range(n)]
    same = words(common + 4)
    return [" ".join(same + words(size - common)) for _ in range(2)]


def test_documents_under_the_similarity_stay(spark):
    rnd = random.Random(4)
    texts = [t for size, common in ((85, 70), (70, 60)) for _ in range(60) for t in halves(rnd, size, common)]  # 0.70, 0.75
    passage = " ".join(f"p{i}" for i in range(84))
    texts += [passage + " " + " ".join(f"h{rnd.getrandbits(60)}" for _ in range(15)) for _ in range(80)]  # 80 of 110 shingles: 0.73
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near(df).collect()) == list(range(len(texts)))


def test_pairs_of_the_similarity_and_above_go(spark):
    rnd = random.Random(6)
    texts = [t for size, common, n in ((90, 80, 150), (100, 90, 100), (185, 170, 50)) for _ in range(n) for t in halves(rnd, size, common)]  # 0.80, 0.82, 0.85
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near(df).collect()) == list(range(0, len(texts), 2))


def test_components_equal_brute_force(spark):
    rnd = random.Random(7)
    texts = ["", None, "a b", "A  b"]
    for _ in range(12):
        base = [f"h{rnd.getrandbits(60)}" for _ in range(90)]
        for _ in range(9):  # about 0.8 to the base, less among themselves
            copy = list(base)
            for at in rnd.sample(range(90), rnd.randint(0, 3)):
                copy[at] = f"h{rnd.getrandbits(60)}"
            texts.append(" ".join(copy))
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    low = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y) and low[i] != low[j]:
                a, b = sorted((low[i], low[j]))
                low = [a if v == b else v for v in low]
    order = list(enumerate(texts))
    rnd.shuffle(order)
    df = spark.createDataFrame(order, "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near(df).collect()} == set(low)


def test_large_ids_beside_nulls_stay_whole(spark):
    big = (1 << 60) + 1
    rows = [(big, "a b c d e"), (None, "x"), (big + 2, "a b c d e"), (big + 4, "z y x w v u")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id) for r in simhash.near_groups(df).collect()}
    assert got == {(big, big), (None, None), (big + 2, big), (big + 4, big + 4)}
    assert {r.doc_id for r in simhash.drop_near(df).collect()} == {big, None, big + 4}


def test_repeated_ids_are_told_apart_by_text(spark):
    rnd = random.Random(11)
    base = [f"h{rnd.getrandbits(60)}" for _ in range(120)]
    a, near_a, other = " ".join(base), " ".join([*base[:119], "changed"]), " ".join(f"h{rnd.getrandbits(60)}" for _ in range(80))
    df = spark.createDataFrame([(3, a), (5, near_a), (5, other), (5, other)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.drop_near(df).collect()) == sorted([(3, a), (5, other)])
    df = spark.createDataFrame([(5, a), (5, near_a)], "doc_id long, text string")
    assert simhash.drop_near(df).count() == 1


def test_large_runs_equal_brute_force():
    rnd = np.random.default_rng(5)
    for _ in range(20):
        centres = rnd.integers(0, 1 << 63, 6, dtype=np.uint64)
        lanes = centres[rnd.integers(0, 6, 120)][:, None]
        for _ in range(3):
            lanes ^= np.where(rnd.random((120, 1)) < 0.6, np.uint64(1) << rnd.integers(0, 12, (120, 1), dtype=np.uint64), np.uint64(0))
        low = np.arange(120)
        for i in range(120):
            for j in np.flatnonzero(np.bitwise_count(lanes[:, 0] ^ lanes[i, 0]) <= 2):
                low[low == max(low[i], low[j])] = min(low[i], low[j])
        a, b = simhash.forest(*simhash.large_run_links(lanes, np.arange(120), 2))
        got = np.arange(120)
        got[a] = b
        assert (got == low).all()


def joined(labels, a, b):
    """Labels after the links."""
    out = labels.copy()
    for x, y in zip(a.tolist(), b.tolist()):
        out[out == max(out[x], out[y])] = min(out[x], out[y])
    return out


def test_hub_pairs_and_label_links_equal_brute_force():
    rnd = np.random.default_rng(6)
    points, owner = rnd.integers(0, 40, 900, dtype=np.uint64), rnd.integers(0, 300, 900)
    points, owner = np.array(sorted(set(zip(points.tolist(), owner.tolist())))).T
    nodes, labels = rnd.permutation(300), rnd.integers(0, 60, 300)
    lanes = (np.uint64(1) << rnd.integers(0, 64, (300, 1), dtype=np.uint64)) | (np.uint64(1) << rnd.integers(0, 64, (300, 1), dtype=np.uint64))
    at = simhash.runs(points.astype(np.uint64), owner)
    groups = [set(owner[points == p].tolist()) for p in range(40)]
    want = {(min(g, key=lambda x: nodes[x]), b) for g in groups for b in g if b != min(g, key=lambda x: nodes[x])}
    assert set(zip(*map(np.ndarray.tolist, simhash.hub_pairs(*at, nodes)))) == want
    pairs = [(labels[a], labels[b]) for g in groups for a in g for b in g if np.bitwise_count(lanes[a] ^ lanes[b])[0] <= 2]
    want = joined(np.arange(60), *np.array(pairs).T)
    for small in (3, 1000):
        assert (joined(np.arange(60), *simhash.label_links(*at, lanes, labels, 2, small)) == want).all() and (want != np.arange(60)).any()


def test_cross_links_equal_brute_force():
    rnd = np.random.default_rng(8)
    base = [rnd.choice(1 << 40, 60, replace=False).astype(np.uint64) for _ in range(8)]
    sets = []
    for i in range(160):
        x = base[i % 8].copy()
        x[: rnd.integers(0, 9)] = rnd.integers(1 << 41, 1 << 42, dtype=np.uint64)
        sets.append(np.unique(x))
    how = simhash.segments_for(1000)
    lanes = np.array([simhash.sketch(x, how.lanes) for x in sets])
    labels, side = rnd.integers(0, 100, 160), rnd.integers(0, 2, 160)
    for part in (None, side):
        want = joined(labels, *np.array([(i, j) for i in range(160) for j in range(160) if (part is None or part[i] != part[j]) and len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 0.8 * len(set(sets[i].tolist()) | set(sets[j].tolist()))]).T)
        assert (joined(labels, *simhash.cross_links(sets, lanes, labels, part, how.distance, 0.8)) == want).all() and (want != labels).any()


def test_neighbourhoods_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "AREA_ROWS", 3)
    monkeypatch.setattr(simhash, "POINTS", 200)
    test_components_equal_brute_force(spark)


def test_segments_grow_with_the_corpus():
    small, large = simhash.segments_for(50_000), simhash.segments_for(10_000_000_000)
    assert (small.width, large.width) == (22, 40) and large.count > small.count


def test_components_with_a_hub(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "FEW", 10)
    links = [(1, i) for i in range(2, 3000)] + [(5000, 5001), (5001, 5002), (2999, 4000)]
    got = simhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == {*((i, 1) for i in range(2, 3000)), (4000, 1), (5001, 5000), (5002, 5000)}
