"""A tour of a collection's operations, and a comparison of the three indexes.

``python -m vecspark.plans.tour [--index-type flat|hnsw|ivf] [--compare]``
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.model import Config, DistanceMetric, ErrorCode, HNSWParams, IndexType, IVFParams, SearchParams, VectorRecord, error_string, index_type_string, parse_index_type
from vecspark.operators import evaluate, knn
from vecspark.plans.collection import Collection
from vecspark.sources.formats import uniform_vectors


def tour(spark: SparkSession, index: IndexType, say: Callable[[str], object] = print, n: int = 200, dim: int = 16) -> Collection:
    """Each operation once; raises if one does not do what it should."""

    def done(what: str, code: int = ErrorCode.OK, want: int = ErrorCode.OK) -> None:
        if code != want:
            raise RuntimeError(f"{what}: {error_string(code)}")
        say(f"{what}: {error_string(code)}")

    c = Collection.create(spark, Config(dimension=dim, index_type=index, ivf_params=IVFParams(n_clusters=8, n_probe=8), hnsw_params=HNSWParams(m=8, ef_construction=64)))
    say(f"version {Collection.version()}, index {index_type_string(c.config.index_type)}, dimension {c.dimension}")
    rows = uniform_vectors(spark, n, dim).withColumn("metadata", F.concat(F.lit("row "), F.col("id").cast("string")))
    done("batch insert", c.batch_insert(rows))
    done("insert", c.insert(VectorRecord(n, (0.5,) * dim, "single")))
    done("insert of an id that is there", c.insert(VectorRecord(n, (0.5,) * dim)), ErrorCode.INVALID_PARAMETER)
    done("insert of another dimension", c.insert(VectorRecord(n + 1, (0.5,) * (dim + 1))), ErrorCode.DIMENSION_MISMATCH)
    say(f"size {c.size()}, contains {n}: {c.contains(n)}, metadata {c.get(n).metadata}")
    found = c.search([0.5] * dim, 5)
    if found.items[0][0] != n:
        raise RuntimeError("the nearest is not found")
    say(f"nearest {found.items[0]}, {len(found.items)} of {found.total_candidates} in {found.query_time_ms:.0f} ms")
    even = c.search([0.5] * dim, 5, SearchParams(ef_search=4 * n, n_probe=8, filter=F.col("id") % 2 == 1))
    say(f"with a filter {[i for i, _ in even.items]}")
    done("upsert", c.upsert([VectorRecord(n, (0.25,) * dim, "replaced")]))
    done("remove", c.remove(n))
    done("remove of what is gone", c.remove(n), ErrorCode.VECTOR_NOT_FOUND)
    done("compact", c.compact())
    done("optimize", c.optimize(), ErrorCode.OK if index == IndexType.HNSW else ErrorCode.INVALID_STATE)
    done("flush", c.flush())
    s = c.stats()
    say(f"{s.vector_count} vectors, {s.memory_usage_bytes} bytes, {s.total_queries} queries of {s.avg_query_time_ms:.0f} ms, {s.total_inserts} inserts")
    say(f"iterated over {sum(1 for _ in c.all_records())} records")
    return c


def compare(spark: SparkSession, rows: DataFrame, k: int = 10, metric: int = DistanceMetric.L2) -> DataFrame:
    """(index, recall, rank_match, build_s, search_s) of the three indexes over rows (id, vector), with
    every hundredth as a query."""
    dim, n = len(rows.first().vector), rows.count()
    queries = rows.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vector")
    truth, out = knn.knn_batch(rows, queries, k, metric).cache(), []
    for index in IndexType:
        began = time.perf_counter()
        c = Collection.create(spark, Config(dimension=dim, index_type=index, distance_metric=metric, ivf_params=IVFParams(n_clusters=max(1, int(n**0.5)), n_probe=max(1, int(0.75 * n**0.5))), hnsw_params=HNSWParams(m=16, ef_construction=100, ef_search=64)))
        if code := c.batch_insert(rows.select("id", "vector", F.lit(None).cast("string").alias("metadata"))):
            raise RuntimeError(error_string(code))
        found = c.search_batch(queries, k)
        built = time.perf_counter()
        found = found.cache()
        found.count()
        searched = time.perf_counter()
        recall = evaluate.recall(found, truth, k).agg(F.avg("recall")).first()[0]
        match = evaluate.rank_match(found, truth).agg(F.avg("rate")).first()[0]
        out.append((index.name, float(recall), float(match), built - began, searched - built))
    return spark.createDataFrame(out, "index string, recall double, rank_match double, build_s double, search_s double")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--index-type", default="hnsw", help="flat, hnsw or ivf")
    parser.add_argument("--compare", action="store_true", help="compare the three indexes instead")
    args = parser.parse_args()
    index = parse_index_type(args.index_type)
    if index is None:
        parser.error(f"unknown index type {args.index_type}")
    spark = SparkSession.builder.appName("tour").getOrCreate()
    if args.compare:
        compare(spark, uniform_vectors(spark, 2000, 128).select("id", "vector").cache()).show(truncate=False)
    else:
        tour(spark, index)


if __name__ == "__main__":
    main()
