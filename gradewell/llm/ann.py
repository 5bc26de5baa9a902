"""Similar images by cosine, approximately: balanced posting lists whose centroids are searched by an in-memory graph.

Centroids come from a bounded sample of the vectors (``SAMPLE``): a spherical k-means whose assignment charges large clusters,
so that lists stay of like size. Every vector goes into the list of its nearest centroid, and as a boundary vector into
further lists whose centroids are almost as near, unless such a centroid lies closer to one already chosen than to the
vector. A query walks the graph of near centroids best-first and keeps the lists whose centroid is within a ratio of the
nearest one's distance; their vectors are compared exactly, in double precision.

What is broadcast is bounded: at most ``MOST_LISTS`` centroids and their graph. Lists longer than a block are cut into
blocks, lists asked by very many queries cut those, and every pair of blocks is a task's group, so no list has to fit one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.vectors import block_of, image_vectors, leading, matrix, top_rows
from gradewell.session import store

SAMPLE = 20_000
LIST_ROWS = 128
MOST_LISTS = 2048
COPIES = 4
COPY_RATIO = 1.25
GRAPH_LINKS = 24
BEAM = 32
QUERY_RATIO = 1.22
BLOCK_ROWS = 4096


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (rows @ centroids.T), 0))


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 12, charge: float = 0.15) -> np.ndarray:
    """Unit centroids of clusters of like size: distance plus a charge that grows with the size the cluster had last."""
    lists = max(1, min(lists, len(sample)))
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    fee = np.zeros(lists)
    for _ in range(rounds):
        chosen = np.concatenate([(distances(part, centroids) + fee).argmin(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        sizes = np.bincount(chosen, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, chosen, sample)
        norms = np.linalg.norm(sums, axis=1)
        full = (sizes > 0) & (norms > 1e-12)
        centroids[full] = sums[full] / norms[full, None]
        fee = 0.5 * fee + charge * 0.5 * np.maximum(sizes * lists / len(sample) - 1, 0)
        fee = np.minimum(fee, 0.5)
    return centroids


class CentroidGraph:
    """Near centroids linked both ways, plus a ring that keeps the graph in one piece."""

    def __init__(self, centroids: np.ndarray, links: int = GRAPH_LINKS) -> None:
        self.centroids = centroids
        n = len(centroids)
        near = [set() for _ in range(n)]
        if n > 1:
            d = distances(centroids, centroids)
            np.fill_diagonal(d, np.inf)
            k = min(links, n - 1)
            for i, row in enumerate(np.argpartition(d, k - 1, axis=1)[:, :k]):
                near[i].update(row.tolist())
                for j in row.tolist():
                    near[j].add(i)
            for i in range(n):
                near[i].add((i + 1) % n)
                near[(i + 1) % n].add(i)
        self.near = [np.array(sorted(x), np.int64) for x in near]
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def search(self, query: np.ndarray, ratio: float = 1.0, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of near centroids, nearest first.

        Walks best-first until ``beam`` centroids are known and the nearest open end is farther than all of the best
        ``beam`` and farther than ``ratio`` times the nearest: whatever pruning by that ratio keeps is not cut short.
        """
        seen = np.zeros(len(self.centroids), bool)
        seen[self.entries] = True
        known = list(zip(distances(query[None], self.centroids[self.entries])[0].tolist(), self.entries.tolist()))
        open_ends, best = list(known), [-d for d, _ in known]
        heapq.heapify(open_ends)
        heapq.heapify(best)
        nearest = min(d for d, _ in known)
        while open_ends:
            d, at = heapq.heappop(open_ends)
            if len(best) >= beam and d > -best[0] and d > nearest * ratio:
                break
            new = self.near[at][~seen[self.near[at]]]
            if not len(new):
                continue
            seen[new] = True
            for x, i in zip(distances(query[None], self.centroids[new])[0].tolist(), new.tolist()):
                known.append((x, i))
                nearest = min(nearest, x)
                if len(best) < beam:
                    heapq.heappush(best, -x)
                elif x < -best[0]:
                    heapq.heapreplace(best, -x)
                heapq.heappush(open_ends, (x, i))
        known.sort()
        return np.array([i for _, i in known]), np.array([x for x, _ in known])


def lists_of_vectors(rows: np.ndarray, centroids: np.ndarray, copies: int = COPIES, ratio: float = COPY_RATIO) -> list[list[int]]:
    """Posting lists of every vector: the nearest centroid and boundary copies."""
    d = distances(rows, centroids)
    k = min(4 * copies, len(centroids))
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    between = distances(centroids, centroids)
    out = []
    for i, ids in enumerate(near):
        ids = ids[np.argsort(d[i, ids], kind="stable")]
        limit, chosen = d[i, ids[0]] * ratio, [int(ids[0])]
        for j in ids[1:].tolist():
            if d[i, j] > limit or len(chosen) == copies:
                break
            if all(between[j, c] > 0.6 * d[i, j] for c in chosen):
                chosen.append(j)
        out.append(chosen)
    return out


def lists_of_query(query: np.ndarray, graph: CentroidGraph, ratio: float = QUERY_RATIO, beam: int = BEAM) -> np.ndarray:
    """Lists whose centroid is within ``ratio`` of the nearest centroid's distance."""
    ids, d = graph.search(query, ratio, beam)
    return ids[d <= max(d[0], 1e-9) * ratio]


def spread_over_lists(vectors: DataFrame, assign) -> DataFrame:
    """One row per vector and posting list: (list, id, v). ``assign`` maps unit vectors to lists of list numbers."""
    target = pa.schema([("list", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                chosen = assign(unit(matrix(part.column(1))))
                sizes = np.array([len(c) for c in chosen])
                rows = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                lists = pa.array(np.concatenate([np.asarray(c, np.int32) for c in chosen]), pa.int32())
                yield pa.RecordBatch.from_arrays([lists, part.column(0).take(rows), part.column(1).take(rows).cast(target.field("v").type)], schema=target)

    return vectors.select("id", "v").mapInArrow(run, "list int, id bigint, v array<double>")


def similar_images(images: DataFrame, key: str = "image_id", vector: str = "embedding", queries: str = "true", n: int = 5,
                   sample: int = SAMPLE, list_rows: int = LIST_ROWS, most_lists: int = MOST_LISTS, copies: int = COPIES,
                   copy_ratio: float = COPY_RATIO, query_ratio: float = QUERY_RATIO, beam: int = BEAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, key, score): for every image picked by the SQL condition ``queries`` over ``id`` the ``n`` nearest found.

    ``score`` is the cosine in double precision on the vectors as given. An image is not its own neighbour. Ties go to
    the smaller key. Rows with a null key, or a vector that is null, empty, zero or holds null or non-finite components,
    take no part; of rows that repeat a key the least vector counts. All vectors must have one length. Where the lists
    chosen for a query hold fewer than ``n`` vectors, all lists are searched for it. Other columns are not read, whatever
    their names. An empty table gives an empty result.
    """
    spark = images.sparkSession
    vectors = store(image_vectors(images, key, vector).filter(F.exists("v", lambda x: x != 0)))
    total = vectors.count()
    lists = max(1, min(most_lists, -(-total // list_rows)))
    held = vectors.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(sample).select("v").toArrow().column("v")
    if not total:
        return spark.createDataFrame([], f"query_id bigint, rank int, `{key}` bigint, score double")
    centroids = balanced_centroids(unit(matrix(held)), lists)
    shared = spark.sparkContext.broadcast((centroids, CentroidGraph(centroids)))

    postings = store(spread_over_lists(vectors, lambda rows: lists_of_vectors(rows, shared.value[0], copies, copy_ratio)))
    sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("size"))
    asked = vectors.filter(queries)

    def lists_asked(rows: np.ndarray) -> list[np.ndarray]:
        return [lists_of_query(q, shared.value[1], query_ratio, beam) for q in rows]

    wanted = store(spread_over_lists(asked, lists_asked))
    poor = wanted.join(sizes, "list").groupBy("id").agg(F.sum("size").alias("reach"), F.count(F.lit(1)).alias("m")).filter(
        F.col("reach") < F.lit(copies * (n + 1))).select("id")
    everywhere = asked.join(poor, "id", "left_semi").select(F.explode(F.sequence(F.lit(0), F.lit(len(centroids) - 1))).alias("list"), "id", "v")
    wanted = wanted.join(poor, "id", "left_anti").unionByName(everywhere)
    best = search_blocks(postings, wanted, n, block_rows)
    # A vector found through several of its lists has one score.
    return leading(best.groupBy("query_id", "id").agg(F.max("score").alias("score")), n).withColumnRenamed("id", key)


def search_blocks(postings: DataFrame, wanted: DataFrame, n: int, block_rows: int) -> DataFrame:
    """(query_id, id, score): the ``n`` best of every query in every pair of blocks of a posting list."""
    stored = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("row_blocks"))
    asking = wanted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("query_blocks"))
    blocks = store(stored.join(asking, "list"))
    rows = postings.join(F.broadcast(blocks), "list").withColumn("row_block", block_of("id", F.col("row_blocks"))).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    asks = wanted.join(F.broadcast(blocks), "list").withColumn("query_block", block_of("id", F.col("query_blocks"))).withColumn(
        "row_block", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids, rows = left.column("id").to_numpy(), matrix(left.column("v"))
            norms = np.linalg.norm(rows, axis=1)
            query_ids, asked = right.column("id").to_numpy(), matrix(right.column("v"))
            for first in range(0, len(asked), 256):
                part = asked[first:first + 256]
                scores = (part @ rows.T) / (np.linalg.norm(part, axis=1)[:, None] * norms)
                for q, row in zip(query_ids[first:first + 256], scores):
                    others = np.flatnonzero(ids != q)
                    top = others[top_rows(row[others], ids[others], n)]
                    out["query_id"] += [q] * len(top)
                    out["id"] += ids[top].tolist()
                    out["score"] += row[top].tolist()
        return pa.table(out, schema=schema)

    by = ["list", "row_block", "query_block"]
    return rows.select(*by, "id", "v").groupBy(*by).cogroup(asks.select(*by, "id", "v").groupBy(*by)).applyInArrow(
        compare, "query_id bigint, id bigint, score double")
