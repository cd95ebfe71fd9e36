"""The stored vector index equals comparing all, and reads less."""

import numpy as np
import pytest
from tessera.operators import cells, retrieve

SCHEMA, ASKED = "id long, embedding array<float>", "query_id long, vec array<double>"


def clustered(seed=1, groups=12, each=60, size=8, spread=0.05):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, size))
    rows = np.concatenate([c + spread * rnd.normal(size=(each, size)) for c in centres])
    return centres, [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def same(spark, tmp_path, rows, asked, k, exclude_self=False, pivots=24):
    path = f"file://{tmp_path}/index"
    vectors, queries = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(asked, ASKED)
    cells.build(vectors, path, pivots)
    told = cells.Searched()
    got = cells.search(spark, path, queries, k, exclude_self, told).collect()
    usable = vectors.where("exists(embedding, x -> x <> 0) AND NOT exists(embedding, x -> isnan(x))")
    want = retrieve.vector(usable, queries, k, exclude_self).collect()
    key = lambda r: (r.query_id, r["rank"], r.id, round(r.score, 9))
    assert sorted(map(key, got)) == sorted(map(key, want)) and want
    return told


def test_clusters_are_read_in_part(spark, tmp_path):
    centres, rows = clustered()
    asked = [(i, [float(x) for x in centres[i]]) for i in range(3)] + [(100, None), (101, [0.0] * 8)]
    told = same(spark, tmp_path, rows, asked, 10)
    assert told.vectors <= 0.6 * told.of_vectors and told.pairs <= 3 * told.of_vectors / 4 and told.of_cells > 12


def test_scattered_vectors_ties_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "QUERIES", 4)
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.integers(-2, 3, size=4)]) for i in range(300)] + [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(300, 340)]
    rows += [(900, None), (901, [0.0] * 4), (902, [float("nan"), 1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    asked = [(i, [float(x) for x in rnd.normal(size=4)]) for i in range(9)] + [(310, [1.0, 1.0, 0.0, 0.0])]
    same(spark, tmp_path, rows, asked, 25, exclude_self=True)


def test_few_vectors_and_other_dimensions(spark, tmp_path):
    same(spark, tmp_path, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], [(5, [1.0, 0.2])], 10)
    with pytest.raises(ValueError, match="dimensions"):
        cells.search(spark, f"file://{tmp_path}/index", spark.createDataFrame([(1, [1.0])], ASKED), 3)
    with pytest.raises(ValueError, match="dimensions"):
        cells.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA), f"file://{tmp_path}/other")
    empty = f"file://{tmp_path}/empty"
    cells.build(spark.createDataFrame([], SCHEMA), empty)
    assert cells.search(spark, empty, spark.createDataFrame([(1, [1.0])], ASKED), 3).count() == 0
