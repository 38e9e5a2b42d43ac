"""Inverted lists: vectors with their cluster, searched in the clusters nearest to the query.

``vectors`` carries ``cluster_id``. Stored partitioned by it, a single query prunes partitions by
literals; many queries go to the lists they probe by a block of queries with their probes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.model import DistanceMetric
from vecspark.operators.kernel import TopK, exact
from vecspark.operators.kmeans import KMeans, KMeansParams, assign
from vecspark.operators.knn import RESULT, knn, matrix, query_blocks, top_k


def train(vectors: DataFrame, n_clusters: int, metric: int, seed: int = 42, max_iterations: int = 25) -> np.ndarray:
    dim = len(vectors.select("vector").first().vector)
    return KMeans(n_clusters, dim, metric, KMeansParams(max_iterations=max_iterations, seed=seed)).fit(vectors).centroids


def build(vectors: DataFrame, n_clusters: int, metric: int, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(vectors with cluster_id, centroids)."""
    centroids = train(vectors, n_clusters, metric, seed)
    return assign(vectors, centroids, metric), centroids


def nearest_centroids(centroids: np.ndarray, query: list[float], n: int, metric: int) -> list[int]:
    """The n nearest clusters, the smaller number first on ties; n is held to 1 .. clusters."""
    if not len(centroids):
        return []
    q = np.asarray(query, np.float32)
    d = exact(np.broadcast_to(q, centroids.shape), centroids, metric)
    return np.lexsort((np.arange(len(d)), d))[: min(max(n, 1), len(d))].tolist()


def search(lists: DataFrame, centroids: np.ndarray, query: list[float], k: int, n_probe: int, metric: int, predicate: Column | None = None) -> DataFrame:
    """(id, distance) of the k nearest in the probed lists; fewer if those hold fewer."""
    dim = centroids.shape[1] if centroids.ndim == 2 else 0
    if len(query) != dim:
        return knn(lists, query, 0, metric)
    probes = nearest_centroids(centroids, query, n_probe, metric)
    return knn(lists.where(F.col("cluster_id").isin(probes)), query, k, metric, predicate, dim)


def probes(queries: DataFrame, centroids: DataFrame, n_probe: int, metric: int) -> DataFrame:
    """(query_id, cluster_id, distance, rank) of each query's nearest clusters."""
    from vecspark.operators.knn import knn_batch

    found = knn_batch(centroids.select(F.col("cluster_id").cast("long").alias("id"), F.col("centroid").alias("vector")), queries, max(n_probe, 1), metric)
    return found.withColumnRenamed("id", "cluster_id")


def search_batch(lists: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, n_probe: int, metric: int, predicate: Column | None = None) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest in each query's probed lists."""
    spark = lists.sparkSession
    rows = (lists if predicate is None else lists.where(predicate)).select("id", "vector", "cluster_id")
    found = []
    for ids, q in query_blocks(queries, centroids.shape[1]):
        probing: dict[int, list[int]] = {}
        for i, v in enumerate(q):
            for c in nearest_centroids(centroids, v, n_probe, metric):
                probing.setdefault(c, []).append(i)
        block = spark.sparkContext.broadcast((ids, q, {c: np.array(x) for c, x in probing.items()}))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, q, probing = block.value
            top = TopK(q, k, metric)
            for b in batches:
                cluster, x, own = b.column("cluster_id").to_numpy(), matrix(b.column("vector")), b.column("id").to_numpy()
                for c in np.unique(cluster):
                    if (asking := probing.get(int(c))) is not None:
                        at = cluster == c
                        top.add(own[at], x[at], asking)
            n, near, d = top.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[n]), pa.array(near, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "id", "distance"])

        found.append(rows.where(F.col("cluster_id").isin(sorted(probing))).mapInArrow(run, RESULT))
    if not found or k <= 0:
        return spark.createDataFrame([], RESULT + ", rank long")
    return top_k(reduce(DataFrame.unionByName, found), k)


def centroid_table(spark, centroids: np.ndarray) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    return spark.createDataFrame(rows, "cluster_id int, centroid array<double>")


def list_sizes(lists: DataFrame) -> DataFrame:
    return lists.groupBy("cluster_id").agg(F.count("*").alias("n"))


__all__ = ["DistanceMetric", "build", "centroid_table", "list_sizes", "nearest_centroids", "probes", "search", "search_batch", "train"]
