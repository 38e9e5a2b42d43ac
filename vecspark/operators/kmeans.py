"""k-means: seeds spread by squared distance, then Lloyd's iterations over all rows.

Each iteration is one scan. Tasks add up their rows per cluster, so what is shuffled is a row of sums
per task and cluster, and one per cluster comes back; centroids are broadcast, k * dim numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.model import DistanceMetric
from vecspark.operators.kernel import exact, table
from vecspark.operators.knn import matrix

#: Bytes that centroids may have, as they are broadcast.
MODEL_BYTES = 256 << 20


@dataclass(frozen=True)
class KMeansParams:
    max_iterations: int = 100
    convergence_threshold: float = 1e-4
    seed: int = 42
    #: Rows that seeds are chosen from; all rows take part in the iterations.
    seed_rows: int = 20_000


def nearest_centroid(x: np.ndarray, centroids: np.ndarray, metric: int) -> np.ndarray:
    """The nearest centroid's number for each row; the smallest on ties."""
    return table(x, centroids, metric).argmin(axis=1) if len(x) else np.empty(0, np.int64)


def assign(vectors: DataFrame, centroids: np.ndarray, metric: int, column: str = "cluster_id") -> DataFrame:
    """The rows with the number of their nearest centroid."""
    if centroids.nbytes > MODEL_BYTES:
        raise ValueError("too many centroids to broadcast; raise MODEL_BYTES or train fewer")
    model = vectors.sparkSession.sparkContext.broadcast(np.asarray(centroids, float))
    names = [*vectors.columns, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vector"))
            near = np.concatenate([nearest_centroid(x[s : s + 4096], model.value, metric) for s in range(0, len(x), 4096)] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32())], names=names)

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField(column, T.IntegerType())]))


def step(vectors: DataFrame, centroids: np.ndarray, metric: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of the rows nearest to each centroid, and how many these are; NaN where none."""
    model = vectors.sparkSession.sparkContext.broadcast(np.asarray(centroids, float))
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dim)), np.zeros(k, np.int64)
        for b in batches:
            all_x = matrix(b.column("vector"))
            for s in range(0, len(all_x), 4096):
                x = all_x[s : s + 4096]
                near = nearest_centroid(x, model.value, metric)
                n += np.bincount(near, minlength=k)
                np.add.at(sums, near, x)
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array([sums[c].tobytes() for c in at], pa.binary())], names=["c", "n", "s"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        added = np.sum([np.frombuffer(x) for x in pdf["s"]], axis=0)
        return pd.DataFrame({"c": pdf["c"].iloc[:1], "n": [pdf["n"].sum()], "s": [added.tobytes()]})

    kind = "c long, n long, s binary"
    means, sizes = np.full((k, dim), np.nan), np.zeros(k, np.int64)
    for r in vectors.select("vector").mapInArrow(run, kind).groupBy("c").applyInPandas(total, kind).collect():  # a row per cluster
        means[r.c], sizes[r.c] = np.frombuffer(r.s) / r.n, r.n
    return means, sizes


def seed_centroids(sample: np.ndarray, k: int, metric: int, seed: int) -> np.ndarray:
    """k rows: the first at random, each other with a chance in proportion to its squared distance
    from those chosen (L2 of unit vectors for cosine, so the weight is a distance for any metric)."""
    x = np.asarray(sample, float)
    if metric == DistanceMetric.COSINE:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    least = table(x[chosen], x, DistanceMetric.L2)[0]
    tries = 2 + int(np.log(k))
    while len(chosen) < k:
        total = least.sum()
        if total <= 0:  # fewer different rows than seeds
            chosen.append(int(rng.integers(len(x))))
            continue
        # Of a few draws the one that leaves the smallest sum of squared distances.
        picks = np.minimum(np.searchsorted(np.cumsum(least), rng.random(tries) * total, side="right"), len(x) - 1)
        after = np.minimum(least, table(x[picks], x, DistanceMetric.L2))
        best = int(after.sum(axis=1).argmin())
        chosen.append(int(picks[best]))
        least = after[best]
    return np.asarray(sample, float)[chosen]


def seed_table(vectors: DataFrame, k: int, metric: int, seed: int) -> np.ndarray:
    """k rows of (id, vector), chosen like :func:`seed_centroids` but over the whole table: a scan
    for each seed, in which the row with the least of an exponential variable over its weight wins.
    Variables are hashes of id and round, so partitions don't matter."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10) if metric == DistanceMetric.COSINE else x
    rows = vectors.select("id", "vector")
    chosen = np.empty((0, 0))
    for i in range(k):
        model = vectors.sparkSession.sparkContext.broadcast(chosen)
        drawn = rows.withColumn("u", (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 52)) + 0.5) / float(1 << 52))

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, u = unit(matrix(b.column("vector")).astype(float)), b.column("u").to_numpy()
                w = table(unit(model.value), x, DistanceMetric.L2).min(axis=0) if len(model.value) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    cost = np.where(w > 0, -np.log(u) / np.maximum(w, 1e-300), np.inf)
                if len(cost):
                    at = [int(np.lexsort((b.column("id").to_numpy(), u, cost))[0])]
                    yield pa.RecordBatch.from_arrays([pa.array(cost[at]), pa.array(u[at]), b.column("id").take(pa.array(at)), b.column("vector").take(pa.array(at))], names=["cost", "u", "id", "vector"])

        kinds = {f.name: f.dataType for f in rows.schema.fields}
        best = drawn.mapInArrow(run, T.StructType([T.StructField("cost", T.DoubleType()), T.StructField("u", T.DoubleType()), T.StructField("id", kinds["id"]), T.StructField("vector", kinds["vector"])]))
        found = best.orderBy("cost", "u", "id").first()
        chosen = np.array([*chosen.tolist(), found.vector], float)
    return chosen


def movement(old: np.ndarray, new: np.ndarray, metric: int) -> float:
    """Sum of the distances that the centroids have moved."""
    return float(exact(old, new, metric).sum())


class KMeans:
    """Trains on rows (id, vector). The dot product has no mean to converge to, so training uses L2
    with it, and only assignment the metric."""

    def __init__(self, k: int, dimension: int, metric: int = DistanceMetric.L2, params: KMeansParams | None = None):
        if k <= 0 or dimension <= 0:
            raise ValueError("k and dimension must be positive")
        self._k, self._dim, self.metric, self.params = k, dimension, metric, params or KMeansParams()
        self._centroids: np.ndarray | None = None
        self._rows: DataFrame | None = None

    def fit(self, vectors: DataFrame) -> KMeans:
        p, train = self.params, DistanceMetric.L2 if self.metric == DistanceMetric.DOT_PRODUCT else self.metric
        facts = vectors.agg(F.count("*").alias("n"), F.sum((F.size("vector") != self._dim).cast("int")).alias("bad")).first()
        if not facts.n:
            raise ValueError("no vectors to train on")
        if facts.bad:
            raise ValueError("vectors of another dimension")
        k = min(self._k, facts.n)
        self._rows = self._centroids = None
        if k == facts.n:  # each row is its own centroid, from which no iteration moves it
            self._rows = vectors.select("id", "vector")
            return self
        share = min(1.0, 1.2 * max(p.seed_rows, 4 * k) / facts.n)
        rows = vectors.select("id", "vector").where(F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
        rows = rows.orderBy(F.xxhash64("id", F.lit(p.seed)), "id").limit(2 * max(p.seed_rows, 4 * k))
        rows = sorted(rows.collect(), key=lambda r: r.id)
        sample = np.array([r.vector for r in rows], float)
        if len(sample) < k:
            raise ValueError("too few rows to seed from; raise seed_rows")
        centroids = seed_centroids(sample, k, train, p.seed)
        for i in range(p.max_iterations):
            new, sizes = step(vectors, centroids, train)
            empty = np.nonzero(sizes == 0)[0]
            if len(empty):  # rows chosen by a hash of the round, so the same on any cluster
                new[empty] = sample[np.random.default_rng((p.seed, i)).integers(0, len(sample), len(empty))]
            moved = movement(centroids, new, train)
            centroids = new
            if moved < p.convergence_threshold:
                break
        self._centroids = centroids
        return self

    def predict(self, vectors: DataFrame) -> DataFrame:
        return assign(vectors, self.centroids, self.metric)

    @property
    def centroids(self) -> np.ndarray:
        """As a matrix, which is one thing in memory; :meth:`centroid_table` is not."""
        if self._centroids is None:
            if self._rows is None:
                raise RuntimeError("not fitted")
            if self._rows.count() * self._dim * 8 > MODEL_BYTES:
                raise ValueError("too many centroids for a matrix; use centroid_table")
            self._centroids = np.array([r.vector for r in self._rows.orderBy("id").collect()], float)
        return self._centroids

    def centroid_table(self) -> DataFrame:
        """A row (vector) per centroid. Where there is one per row trained on, these are the rows,
        wherever they lie."""
        if self._rows is not None:
            return self._rows.select(F.col("vector").cast("array<double>").alias("vector"))
        return SparkSession.active().createDataFrame([(c.tolist(),) for c in self.centroids], "vector array<double>")

    @property
    def is_fitted(self) -> bool:
        return self._centroids is not None or self._rows is not None

    @property
    def k(self) -> int:
        return self._k

    @property
    def dimension(self) -> int:
        return self._dim
