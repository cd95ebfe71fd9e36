import random

import corpus_pipeline
from tessera.llm.simhash import shingle_hashes


def make(tmp_path, spark):
    rnd = random.Random(8)
    words = [f"t{i}" for i in range(3000)]
    docs, labels = [], []
    for i in range(240):
        text = [rnd.choice(words) for _ in range(rnd.randint(80, 300))]
        bad = i % 8 == 0
        if bad:
            for at in rnd.sample(range(len(text)), 6):
                text[at] = rnd.choice(["vilest", "scummy", "filthy"])
        docs.append((i, " ".join(text), "en", rnd.choice(["s1", "s2", "s3"]), 0))
        labels.append((i, 1, int(bad)))
    exact = [(1000 + i, docs[i][1], "en", "s1", 0) for i in range(1, 60, 5)]
    near = []
    for i in range(2, 60, 5):
        text = docs[i][1].split()
        text[len(text) // 2] = "altered"
        near.append((2000 + i, " ".join(text), "en", "s2", 0))
    rows = [*docs, *exact, *near, (None, "null id", None, None, None), (3000, None, None, "s1", None), (3001, "", "en", None, 0), (5, docs[5][1], "en", docs[5][3], 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages_against_plain_versions(spark, tmp_path):
    rows = make(tmp_path, spark)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    seen = {"input": [tuple(r) for r in docs.collect()]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "best-fit packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [tuple(r) for r in docs.collect()]
    bad = {"vilest", "scummy", "filthy"}
    assert sorted(map(repr, seen["toxicity"])) == sorted(repr(r) for r in seen["input"] if not bad & set((r[1] or "").split()))
    texts = {}
    for r in seen["toxicity"]:
        texts.setdefault(r[1] or "", []).append(-1 if r[0] is None else r[0])
    assert sorted((r[1] or "", -1 if r[0] is None else r[0]) for r in seen["exact dedup"]) == sorted((t, max(i)) for t, i in texts.items())
    shingles = {r[0]: set(shingle_hashes((r[1] or "").encode(), 5).tolist()) for r in seen["exact dedup"]}
    gone = {r[0] for r in seen["exact dedup"]} - {r[0] for r in seen["SimHash near-dedup"]}
    want = {a for a in shingles for b in shingles if None not in (a, b) and b < a and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) > 0}
    assert gone == want and want
    assert {r[0] for r in seen["mixing sources to target weights"]} <= {r[0] for r in seen["SimHash near-dedup"]}
    ids = [r[0] for r in seen["best-fit packing"]]
    assert set(ids) == {r[0] for r in seen["mixing sources to target weights"]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(ids)


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
