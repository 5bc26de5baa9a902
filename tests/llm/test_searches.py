"""Both vector searches against brute force."""

import numpy as np
import pytest

from gradewell.llm import ann as A
from gradewell.llm import topk as T


def table_of(spark, vectors):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "image_id bigint, embedding array<float>, score int")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    out = (centres[rng.integers(0, 12, 1500)] + 0.7 * rng.normal(size=(1500, 16))).astype(np.float32)
    out[10:40] = out[10]  # copies: ties
    return out


def brute(scores, ids, own, n):
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != own][:n]
    return [(int(ids[i]), scores[i]) for i in order]


def test_exact_products(spark, vectors):
    out = T.top_images(table_of(spark, vectors), queries="id % 50 = 0", block_rows=300, block_queries=9, pivots=8).collect()
    whole = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    ids = np.arange(len(whole))
    for q in range(0, len(whole), 50):
        found = [(r["image_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert found == brute(whole @ whole[q], ids, q, 5)


def test_elimination_skips_candidates():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(scale=s, size=(1000, 4)) * 200 + c for s, c in ((0.1, 0), (0.1, 900), (0.1, -900))]).astype(np.int64)
    ids, length2 = np.arange(len(rows)), float((rows * rows).sum(axis=1).max())
    lift = np.sqrt(length2 - (rows * rows).sum(axis=1))
    pivots = T.choose_pivots(rows.astype(float), 8)
    pivot_lift = np.sqrt(np.maximum(length2 - (pivots * pivots).sum(axis=1), 0))
    table = T.pivot_distances(rows.astype(float), lift, pivots, pivot_lift)
    asks = T.pivot_distances(rows[:5].astype(float), np.zeros(5), pivots, pivot_lift)
    q, i, s, evaluated = T.block_best(ids, rows, table, ids[:5], rows[:5], asks, length2, 5)
    for n in range(5):
        assert [(a, b) for x, a, b in zip(q, i, s) if x == n] == brute(rows @ rows[n], ids, n, 5)
    assert evaluated < 5 * len(rows)


def test_approximate_recall_and_scores(spark, vectors):
    out = A.similar_images(table_of(spark, vectors), queries="id % 50 = 0", list_rows=40, block_rows=100).collect()
    unit = A.unit(vectors.astype(np.float64))
    hits = total = 0
    for q in range(0, len(unit), 50):
        scores = vectors.astype(np.float64) @ vectors[q].astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1) / np.linalg.norm(vectors[q].astype(np.float64))
        found = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - scores[r["image_id"]]) < 1e-12 for r in found)
        assert [(-r["score"], r["image_id"]) for r in found] == sorted((-r["score"], r["image_id"]) for r in found)
        hits += len({r["image_id"] for r in found} & {i for i, _ in brute(scores, np.arange(len(unit)), q, 5)})
        total += 5
    assert hits >= 0.9 * total


EDGES = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (50, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]),
         (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100, None)]


def test_edges(spark):
    images = spark.createDataFrame([(k, v, "x") for k, v in EDGES], "image_id bigint, embedding array<float>, rank string")
    near = A.similar_images(images, queries="id % 50 = 0").collect()
    assert sorted((r["query_id"], r["rank"], r["image_id"]) for r in near) == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    top = T.top_images(images, queries="id % 50 = 0").collect()
    assert sorted((r["query_id"], r["rank"], r["image_id"], r["score"]) for r in top) == [
        (0, 1, 1, 65536), (0, 2, 2, 0), (0, 3, 50, 0), (50, 1, 1, 131072), (50, 2, 0, 0), (50, 3, 2, 0)]
    for search in (A.similar_images, T.top_images):
        assert search(images.limit(0)).count() == 0


def test_graph_walk_finds_the_nearest(vectors):
    centroids = A.balanced_centroids(A.unit(vectors.astype(np.float64)), 60)
    graph = A.CentroidGraph(centroids, links=6)
    for query in A.unit(vectors[:100].astype(np.float64)):
        ids, d = graph.search(query, 1.2, 16)
        assert abs(d[0] - A.distances(query[None], centroids)[0].min()) < 1e-12
