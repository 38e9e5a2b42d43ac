"""Exact nearest neighbours: one query by a sorted limit, many by blocks of queries.

Results are ordered by (distance, id). A block of queries is the only thing broadcast; its bytes are
bounded by ``BLOCK_BYTES``, and more queries make more blocks, each a scan of the vectors in which
every task keeps k rows per query before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions.distance import distance, literal
from vecspark.operators.kernel import TopK

BLOCK_BYTES = 32 << 20


def knn(vectors: DataFrame, query: list[float], k: int, metric: int, predicate: Column | None = None, dim: int | None = None) -> DataFrame:
    """(id, distance) of the k nearest; the predicate holds before the search. A query of another
    dimension finds nothing."""
    dim = len(query) if dim is None else dim
    rows = vectors if predicate is None else vectors.where(predicate)
    if k <= 0 or len(query) != dim:
        return rows.select("id", F.lit(0.0).alias("distance")).limit(0)
    rows = rows.select("id", distance(F.col("vector"), literal(query), metric, dim).alias("distance"))
    return rows.orderBy("distance", "id").limit(k)


def beam_then_filter(vectors: DataFrame, query: list[float], k: int, beam: int, metric: int, predicate: Column) -> DataFrame:
    """The k nearest among those of the max(beam, k) nearest for which the predicate holds."""
    nearest = knn(vectors, query, max(beam, k), metric)
    return nearest.where(predicate).orderBy("distance", "id").limit(k)


def query_blocks(queries: DataFrame, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries (query_id, vector) as ids and matrices of bounded size."""
    rows = queries.select("query_id", "vector").where("vector IS NOT NULL")
    size = rows.agg(F.sum(F.size("vector")).alias("n")).first().n or 0
    n = max(1, -(-size * 8 // BLOCK_BYTES))
    for k in range(n):
        found = (rows.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) if n > 1 else rows).collect()
        found = [r for r in found if dim is None or len(r.vector) == dim]
        if found:
            yield np.array([r.query_id for r in found], np.int64), np.array([r.vector for r in found], np.float32)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.empty((0, 0), np.float32)


def top_k(candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank): the k best of each query; ranks count from 1."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return candidates.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


RESULT = "query_id long, id long, distance double"


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: int, predicate: Column | None = None) -> DataFrame:
    """(query_id, id, distance, rank) for queries (query_id, vector)."""
    spark = vectors.sparkSession
    rows = (vectors if predicate is None else vectors.where(predicate)).select("id", "vector")
    found = []
    for ids, q in query_blocks(queries):
        block = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, q = block.value
            top = TopK(q, k, metric)
            for b in batches:
                top.add(b.column("id").to_numpy(), matrix(b.column("vector")))
            n, near, d = top.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[n]), pa.array(near, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "id", "distance"])

        found.append(rows.where(F.size("vector") == q.shape[1]).mapInArrow(run, RESULT))
    if not found or k <= 0:
        return spark.createDataFrame([], RESULT + ", rank long")
    return top_k(reduce(DataFrame.unionByName, found), k)
