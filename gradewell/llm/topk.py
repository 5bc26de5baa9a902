"""Exact top-k images by integer inner product, with pivot-table elimination.

Components are made integers, floor(scale * x). One more component makes all vectors equally long, so that the greatest
inner product is the least Euclidean distance, and distances to ``PIVOTS`` pivot vectors, kept beside every vector, bound
it: by the triangle inequality no distance is less than the greatest difference of pivot distances. Blocks of queries
meet blocks of candidates; in a block the candidates of a query are evaluated in the order of their bounds until the
next bound exceeds the distance of the k-th best so far, which is where no other candidate can matter.

Queries against all rows are what is asked for, so the work grows with their product; it is cut into block pairs, each
of bounded size. Pivots are chosen from a bounded sample and affect speed alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.vectors import block_of, image_vectors, leading, matrix, top_rows
from gradewell.session import store

PIVOTS = 48
SAMPLE = 2000
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
FIRST_STEP = 128


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first rows of the sample."""
    chosen = [0] if len(sample) else []
    far = np.full(len(sample), np.inf)
    while chosen and len(chosen) < min(pivots, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    return sample[chosen]


def pivot_distances(rows: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Distances of lifted vectors to lifted pivots."""
    squares = (rows * rows).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * rows @ pivots.T + (lift[:, None] - pivot_lift) ** 2
    return np.sqrt(np.maximum(squares, 0))


def block_best(ids: np.ndarray, rows: np.ndarray, table: np.ndarray, query_ids: np.ndarray, asked: np.ndarray, asked_table: np.ndarray,
               length2: float, k: int) -> tuple[list, list, list, int]:
    """(query ids, ids, scores, evaluated): the k best rows of one block for every query."""
    out_q, out_i, out_s, evaluated = [], [], [], 0
    whole, asked_whole = rows.astype(np.float64), asked.astype(np.float64)
    small = float(np.abs(whole).max(initial=0)) * float(np.abs(asked_whole).max(initial=0)) * rows.shape[1] < 2 ** 53
    slack = 1e-9 * (length2 + 1)
    columns = np.ascontiguousarray(table.T)
    for q, query, floats, to_pivots in zip(query_ids, asked, asked_whole, asked_table):
        bound = np.abs(columns[0] - to_pivots[0])
        for column, d in zip(columns[1:], to_pivots[1:]):
            np.maximum(bound, np.abs(column - d), out=bound)
        own = float(floats @ floats)
        # distance^2 = |q|^2 + length2 - 2 score, so a bound on the distance is one on the score.
        ceiling = (own + length2 - bound * bound) / 2 + slack + 1e-6 * np.abs(bound)
        order = np.argsort(-ceiling, kind="stable")
        order = order[ids[order] != q]
        at, step = 0, FIRST_STEP
        found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        while at < len(order):
            if len(scores) == k and ceiling[order[at]] < scores.min():
                break
            chunk = order[at:at + step]
            fresh = (whole[chunk] @ floats).astype(np.int64) if small else rows[chunk] @ query
            evaluated += len(chunk)
            places, values = np.concatenate([found, chunk]), np.concatenate([scores, fresh])
            top = top_rows(values, ids[places], k)
            found, scores = places[top], values[top]
            at, step = at + step, 2 * step
        out_q += [q] * len(found)
        out_i += ids[found].tolist()
        out_s += scores.tolist()
    return out_q, out_i, out_s, evaluated


def top_images(images: DataFrame, key: str = "image_id", vector: str = "embedding", queries: str = "true", k: int = 5, scale: int = 256,
               pivots: int = PIVOTS, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, key, score): for every image picked by the SQL condition ``queries`` over ``id`` the ``k`` highest scores.

    ``score`` is the inner product of floor(``scale`` * x) over the components x, taken as doubles; it must fit 64 bits.
    An image is not its own answer. Ties go to the smaller key; where there are fewer than ``k`` others, all are given.
    Rows with a null key, or a vector that is null, empty or holds null or non-finite components, take no part (zero
    vectors do); of rows that repeat a key the least vector counts. All vectors must have one length. Other columns
    are not read, whatever their names. An empty table gives an empty result.
    """
    spark = images.sparkSession
    whole = image_vectors(images, key, vector).select("id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("bigint")).alias("v"))
    vectors = store(whole)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, length2 = vectors.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not total:
        return spark.createDataFrame([], f"query_id bigint, rank int, `{key}` bigint, score bigint")
    held = matrix(vectors.orderBy(F.xxhash64(F.lit("pivots"), "id"), "id").limit(sample).select("v").toArrow().column("v")).astype(np.float64)
    chosen = choose_pivots(held, pivots)
    lift = np.sqrt(np.maximum(length2 - (chosen * chosen).sum(axis=1), 0))
    table_type = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.int64())), ("to_pivots", pa.list_(pa.float64())), ("asks_to_pivots", pa.list_(pa.float64()))])

    def measure(batches):
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(1)).astype(np.float64)
                own = np.sqrt(np.maximum(length2 - (rows * rows).sum(axis=1), 0))
                near, asks = pivot_distances(rows, own, chosen, lift), pivot_distances(rows, np.zeros(len(rows)), chosen, lift)
                listed = [pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), d.shape[1]).cast(pa.list_(pa.float64())) for d in (near, asks)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.int64())), *listed], schema=table_type)

    pivot_table = store(vectors.select("id", "v").mapInArrow(measure, "id bigint, v array<bigint>, to_pivots array<double>, asks_to_pivots array<double>"))
    asked = pivot_table.filter(queries)
    row_blocks, query_blocks = max(1, -(-total // block_rows)), max(1, -(-asked.count() // block_queries))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = pivot_table.select(block_of("id", row_blocks).alias("row_block"), every(query_blocks).alias("query_block"), "id", "v", F.col("to_pivots").alias("d"))
    asks = asked.select(every(row_blocks).alias("row_block"), block_of("id", query_blocks).alias("query_block"), "id", "v", F.col("asks_to_pivots").alias("d"))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q, i, s, _ = block_best(left.column("id").to_numpy(), matrix(left.column("v")), matrix(left.column("d")),
                                right.column("id").to_numpy(), matrix(right.column("v")), matrix(right.column("d")), length2, k)
        return pa.table({"query_id": q, "id": i, "score": s}, schema=schema)

    by = ["row_block", "query_block"]
    best = rows.groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(compare, "query_id bigint, id bigint, score bigint")
    return leading(best, k).withColumnRenamed("id", key)
