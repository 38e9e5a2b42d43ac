"""Quality of search results and clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of each query's k true neighbours that were found."""
    hits = truth.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.lit(float(k))).alias("recall"))


def rank_match(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(rank, rate): how often the same id is at a rank."""
    both = truth.select("query_id", "rank", F.col("id").alias("t")).join(found.select("query_id", "rank", F.col("id").alias("f")), ["query_id", "rank"], "left")
    return both.groupBy("rank").agg(F.avg(F.coalesce((F.col("t") == F.col("f")).cast("double"), F.lit(0.0))).alias("rate"))


def purity(clusters: DataFrame, cluster: str, label: str) -> DataFrame:
    """One row: the share of rows that have their cluster's most frequent label."""
    n = clusters.groupBy(cluster, label).agg(F.count("*").alias("n"))
    best = n.groupBy(cluster).agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return best.agg((F.sum("most") / F.sum("all")).alias("purity"))


def clustered_memory(n: int, clusters: int, dim: int) -> int:
    """Bytes of inverted lists: centroids, ids with vectors, and the id map."""
    return clusters * dim * 4 + n * (8 + dim * 4) + 16 * n


def flat_memory(n: int, dim: int) -> int:
    """Bytes of an exact index: ids with vectors, and the map's overhead."""
    return n * (8 + 4 * dim) + 32 * n


def graph_memory(n: int, dim: int, n_edges: int) -> int:
    """Bytes of a graph: vectors, both id maps, edges, and the marks of visited nodes."""
    return n * 4 * dim + 32 * n + 8 * n_edges + 4 * n
