"""Vector operators and components against plain versions."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rebuyflow.llm.block_search import Codes, nearest, tile_bounds
from rebuyflow.llm.components import connected_components
from rebuyflow.llm.pivot_index import near_duplicate_vectors

BAD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [float("nan")] * 8), (9005, [1.0] * 7 + [None]), (9006, [float("inf")] * 8), (9100, None), (9007, [1.0, 2.0])]


def table(spark, vectors, bad=BAD):
    rows = [(i, [float(x) for x in v], 1, 3, "x") for i, v in enumerate(vectors)] + [(i, v, 1, 3, "x") for i, v in bad]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, rep string")


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(1)
    v = r.normal(size=(700, 8)).astype(np.float32)
    v[100:160] = v[99]  # many ties
    v[200:400] = v[200] + r.normal(size=(200, 8)) * 0.05
    v[500:520] *= 1e4
    return v


def test_bounds_hold(vectors):
    v = vectors.astype(float)
    low, high = tile_bounds(Codes(v[:50]), Codes(v))
    true = ((v[:50, None] - v[None]) ** 2).sum(axis=2)
    assert (low <= true).all() and (true <= high).all()


@pytest.mark.parametrize("block_rows", [64, 8192])
def test_nearest_is_exact(spark, vectors, block_rows):
    got = {}
    for r in nearest(table(spark, vectors), F.col("vec_id") % 100 == 0, 10, block_rows=block_rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 700, 100))
    v = vectors.astype(float)
    for q, rows in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        order = np.lexsort((np.arange(len(v)), d))[:10]
        assert [(k, i) for k, i, _ in sorted(rows)] == [(k, i) for k, i in enumerate(order, 1)]
        assert np.allclose([s for _, _, s in sorted(rows)], d[order], rtol=1e-12)


def test_fewer_candidates_and_repeated_ids(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1)]


def exact_links(v, threshold=0.95):
    u = v.astype(float) / np.sqrt((v.astype(float) ** 2).sum(axis=1))[:, None]
    hit = u @ u.T >= threshold
    np.fill_diagonal(hit, False)
    return hit


@pytest.mark.parametrize("tile", [32, 1024])
def test_links_are_verified_and_recalled(spark, vectors, tile):
    hit = exact_links(vectors)
    rows = {r["vec_id"]: r for r in near_duplicate_vectors(table(spark, vectors), tile=tile).collect()}
    assert set(rows) == set(range(700)) | {i for i, _ in BAD}
    got = np.array([rows[i]["n_links"] for i in range(700)])
    assert (got <= hit.sum(axis=1)).all() and got.sum() >= 0.9 * hit.sum()
    assert all(rows[i]["n_links"] == 0 and rows[i]["component_id"] == i and rows[i]["kept"] for i, _ in BAD)
    assert all(rows[i]["component_id"] == 99 for i in range(99, 160))
    assert all(rows[i]["kept"] == (rows[i]["component_id"] == i) for i in rows)


def test_recall_on_the_given_embeddings(spark):
    source = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    base = np.array([r["embedding"] for r in source.orderBy("vec_id").limit(1500).collect()])
    r = np.random.default_rng(3)
    v = np.concatenate([base, base[:300] + r.normal(size=(300, base.shape[1])) * 0.02 * np.sqrt((base[:300] ** 2).sum(axis=1))[:, None]]).astype(np.float32)
    hit = exact_links(v)
    rows = near_duplicate_vectors(table(spark, v, [])).collect()
    assert hit.sum() > 400
    assert sum(r["n_links"] for r in rows) >= 0.9 * hit.sum()


def test_empty_tables(spark):
    empty = table(spark, [], [])
    assert near_duplicate_vectors(empty).count() == 0
    assert nearest(empty, F.lit(True)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(500 + i, 501 + i) for i in range(60)] + [(900, x) for x in range(901, 960)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
