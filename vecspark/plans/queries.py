"""Registered queries over ``embeddings`` (vec_id, embedding, label) and ``events``, with their SQL.

Distances are rounded to six digits on both sides; ties are ordered by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions import distance as dist
from vecspark.functions import sql as sql_functions
from vecspark.model import (
    DISTANCE_METRIC_STRINGS,
    ERROR_STRINGS,
    INDEX_TYPE_STRINGS,
    Config,
    DistanceMetric,
    HNSWParams,
    IndexType,
    IVFParams,
    SearchParams,
    VectorRecord,
)
from vecspark.operators import evaluate, hnsw, ivf, kmeans, knn, writes
from vecspark.plans.collection import Collection
from vecspark.sources.formats import uniform_vectors
from vecspark.sources.store import scratch
from vecspark.streaming.ingest import event_rates, event_sessions

DIM = 64
#: Per cent of trained lists that a search probes.
PROBED = 75
L2, COSINE, DOT = DistanceMetric.L2, DistanceMetric.COSINE, DistanceMetric.DOT_PRODUCT
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def scaled(rows: DataFrame) -> DataFrame:
    """Norms that differ, so that the metrics rank differently."""
    return rows.withColumn("vector", F.transform("vector", lambda x: (x * (1 + F.col("label"))).cast("float")))


def asked(rows: DataFrame) -> DataFrame:
    """Every hundredth id, so that queries grow with the table."""
    return rows.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vector")


def first_vector(rows: DataFrame) -> list[float]:
    return list(rows.where("id = 0").first().vector)


def rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("distance", F.round("distance", 6))


def ranked(rows: DataFrame) -> DataFrame:
    return rounded(knn.top_k(rows.withColumn("query_id", F.lit(0)), 1 << 30).drop("query_id"))


# SQL fragments ---------------------------------------------------------------------------------------

E = "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
S = "WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: (x * (1 + label))::FLOAT::DOUBLE) AS v, label FROM embeddings)"


def sql_dot(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 0.0)"


def sql_l2sq(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 0.0)"


def sql_distance(a: str, b: str, metric: int) -> str:
    if metric == L2:
        return f"sqrt({sql_l2sq(a, b)})"
    if metric == DOT:
        return f"-({sql_dot(a, b)})"
    na, nb = f"sqrt({sql_dot(a, a)})", f"sqrt({sql_dot(b, b)})"
    return f"CASE WHEN {na} < 1e-10 OR {nb} < 1e-10 THEN 1.0 ELSE 1 - greatest(-1.0, least(1.0, {sql_dot(a, b)} / ({na} * {nb}))) END"


def sql_knn(metric: int, k: int, where: str = "true", with_: str = E) -> str:
    d = sql_distance("e.v", "q.v", metric)
    return f"""{with_} SELECT id, round(d, 6) AS distance, row_number() OVER (ORDER BY d, id)::BIGINT AS rank
FROM (SELECT e.id, {d} AS d FROM e, (SELECT v FROM e WHERE id = 0) q WHERE {where}) ORDER BY d, id LIMIT {k}"""


def sql_batch(metric: int, k: int, where: str = "true", with_: str = E, asked: str = "q.id % 100 = 0") -> str:
    return f"""{with_} SELECT query_id, id, round(d, 6) AS distance, rank FROM (
SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::BIGINT AS rank
FROM (SELECT q.id AS query_id, e.id, {sql_distance("e.v", "q.v", metric)} AS d FROM e, e q WHERE {asked} AND {where})) WHERE rank <= {k}"""


#: The first eight vectors as centroids, and each vector's cluster.
CENTROIDS = f"""{E}, c AS (SELECT id::INT AS cluster_id, v FROM e WHERE id < 8),
a AS (SELECT id, cluster_id FROM (SELECT e.id, c.cluster_id, row_number() OVER (PARTITION BY e.id ORDER BY {sql_l2sq("e.v", "c.v")}, c.cluster_id) AS n FROM e, c) WHERE n = 1)"""


def centroids_of(rows: DataFrame, n: int = 8) -> np.ndarray:
    found = sorted(rows.where(F.col("id") < n).collect(), key=lambda r: r.id)
    return np.array([r.vector for r in found], float)


def sql_probed(n_probe: int, k: int, asked: str = "q.id % 100 = 0") -> str:
    """Searches in the lists of each query's n_probe nearest centroids."""
    return f"""{CENTROIDS},
p AS (SELECT query_id, cluster_id FROM (SELECT q.id AS query_id, c.cluster_id, row_number() OVER (PARTITION BY q.id ORDER BY {sql_distance("q.v", "c.v", L2)}, c.cluster_id) AS n FROM e q, c WHERE {asked}) WHERE n <= {n_probe}),
f AS (SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::BIGINT AS rank FROM (
  SELECT q.id AS query_id, e.id, {sql_distance("e.v", "q.v", L2)} AS d FROM p JOIN e q ON q.id = p.query_id JOIN a ON a.cluster_id = p.cluster_id JOIN e ON e.id = a.id)
  QUALIFY rank <= {k}),
t AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::BIGINT AS rank FROM (
  SELECT q.id AS query_id, e.id, {sql_distance("e.v", "q.v", L2)} AS d FROM e, e q WHERE {asked}) QUALIFY rank <= {k})"""


# Scans ------------------------------------------------------------------------------------------------


@query(f"{E} SELECT id, label, len(v)::INT AS dim, round(list_sum(v), 6) AS total FROM e")
def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return vectors(spark, sf_dir).select("id", "label", F.size("vector").alias("dim"), F.round(total, 6).alias("total"))


@query("SELECT vec_id AS id, label::VARCHAR AS metadata, len(embedding)::INT AS dim FROM embeddings WHERE vec_id = 17")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _filled(spark, sf_dir)
    r = c.get(17)
    return spark.createDataFrame([] if r is None else [(r.id, r.metadata, len(r.vector))], "id long, metadata string, dim int")


@query("SELECT i AS id, i IN (SELECT vec_id FROM embeddings) AS found FROM (SELECT unnest(range(0, 4000, 100)) AS i)")
def contains_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).contains_many(spark.range(0, 4000, 100))


@query("SELECT count(*)::BIGINT AS n, max(len(embedding))::INT AS dim, 0::INT AS flushed FROM embeddings")
def size_and_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _filled(spark, sf_dir)
    return spark.createDataFrame([(c.size(), c.dimension, int(c.flush()))], "n long, dim int, flushed int")


# Distances --------------------------------------------------------------------------------------------


def _distances(name: str, build: Callable, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scaled(vectors(spark, sf_dir))
        q = dist.literal(first_vector(rows))
        return rows.select("id", F.round(build(F.col("vector"), q), 6).alias("distance"))

    run.__name__ = name
    query(f"{S} SELECT e.id, round({sql}, 6) AS distance FROM e, (SELECT v FROM e WHERE id = 0) q")(run)


_distances("l2_squared", lambda a, b: dist.l2_squared(a, b, DIM), sql_l2sq("e.v", "q.v"))
_distances("l2", lambda a, b: dist.l2(a, b, DIM), sql_distance("e.v", "q.v", L2))
_distances("cosine", lambda a, b: dist.cosine(a, b, DIM), sql_distance("e.v", "q.v", COSINE))
_distances("neg_dot", lambda a, b: dist.neg_dot(a, b, DIM), sql_distance("e.v", "q.v", DOT))


@query(f"{E} SELECT id, 1.0::DOUBLE AS distance FROM e")
def cosine_zero_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", dist.cosine(F.col("vector"), dist.literal([0.0] * DIM), DIM).alias("distance"))


@query(f"""{S} SELECT e.id, round(CASE e.id % 4 WHEN 0 THEN {sql_distance("e.v", "q.v", L2)} WHEN 1 THEN {sql_distance("e.v", "q.v", COSINE)}
WHEN 2 THEN {sql_distance("e.v", "q.v", DOT)} ELSE -1.0 END, 6) AS distance FROM e, (SELECT v FROM e WHERE id = 0) q""")
def metric_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(vectors(spark, sf_dir))
    d = dist.distance_by(F.col("vector"), dist.literal(first_vector(rows)), (F.col("id") % 4).cast("int"))
    return rows.select("id", F.round(d, 6).alias("distance"))


@query("SELECT vec_id AS id, -1.0::DOUBLE AS l2, -1.0::DOUBLE AS cosine, -1.0::DOUBLE AS neg_dot FROM embeddings")
def dim_mismatch_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.slice("vector", 1, 10)
    return vectors(spark, sf_dir).select("id", *(f(F.col("vector"), short).alias(f.__name__) for f in (dist.l2, dist.cosine, dist.neg_dot)))


@query(f"""{S} SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm,
round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS head FROM e""")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(vectors(spark, sf_dir))
    unit = dist.normalize(F.col("vector"), DIM)
    return rows.select("id", F.round(dist.norm(F.col("vector"), DIM), 6).alias("norm"), F.round(F.get(unit, F.lit(0)), 6).alias("head"))


@query("SELECT vec_id AS id, CASE WHEN len(embedding) = 64 THEN 0 ELSE 1 END::INT AS code FROM embeddings")
def validate_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", dist.dimension_code(F.col("vector"), DIM).alias("code"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {int(i)}, '{t}')" for k, names in (("error", ERROR_STRINGS), ("index", INDEX_TYPE_STRINGS), ("metric", DISTANCE_METRIC_STRINGS)) for i, t in names.items()) + ") t(kind, number, text)")
def enum_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, int(i), t) for k, names in (("error", ERROR_STRINGS), ("index", INDEX_TYPE_STRINGS), ("metric", DISTANCE_METRIC_STRINGS)) for i, t in names.items()]
    return spark.createDataFrame(rows, "kind string, number int, text string")


# Exact search -----------------------------------------------------------------------------------------


def _knn(name: str, sql: str, **kw) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scaled(vectors(spark, sf_dir))
        args = {"k": 10, "metric": L2} | kw
        predicate = args.pop("predicate", None)
        q = first_vector(rows)
        return ranked(knn.knn(rows, q, predicate=None if predicate is None else predicate(), **args))

    run.__name__ = name
    query(sql)(run)


_knn("knn_flat_l2", sql_knn(L2, 10, with_=S))
_knn("knn_flat_cosine", sql_knn(COSINE, 10, with_=S), metric=COSINE)
_knn("knn_flat_dot", sql_knn(DOT, 10, with_=S), metric=DOT)
_knn("knn_k_gt_n", sql_knn(L2, 5000, with_=S), k=5000)
_knn("knn_k_zero", sql_knn(L2, 0, with_=S), k=0)
_knn("knn_dim_mismatch_empty", sql_knn(L2, 0, with_=S), dim=32)
_knn("knn_prefilter", sql_knn(L2, 10, "e.id % 2 = 1", S), predicate=lambda: F.col("id") % 2 == 1)
_knn("knn_prefilter_no_match", sql_knn(L2, 10, "e.id < 0", S), predicate=lambda: F.col("id") < 0)


@query(f"SELECT id, distance, row_number() OVER (ORDER BY rank)::BIGINT AS rank FROM ({sql_knn(L2, 50, with_=S)}) WHERE id % 7 = 0 ORDER BY rank LIMIT 10")
def knn_postfilter_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(vectors(spark, sf_dir))
    return ranked(knn.beam_then_filter(rows, first_vector(rows), 10, 50, L2, F.col("id") % 7 == 0))


@query(sql_batch(L2, 10, with_=S))
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(vectors(spark, sf_dir))
    return rounded(knn.knn_batch(rows, asked(rows), 10, L2))


@query(sql_batch(COSINE, 5, with_=S))
def knn_batch_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(vectors(spark, sf_dir))
    return rounded(knn.knn_batch(rows, asked(rows), 5, COSINE))


@query(sql_batch(DOT, 5, "e.label < 5", with_=S))
def knn_batch_dot_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(vectors(spark, sf_dir))
    return rounded(knn.knn_batch(rows, asked(rows), 5, DOT, F.col("label") < 5))


@query(sql_batch(L2, 3, "e.id <> q.id", asked="true"))
def knn_self_join_excl_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    found = knn.knn_batch(rows, rows.select(F.col("id").alias("query_id"), "vector"), 4, L2).where("query_id <> id").drop("rank")
    return rounded(knn.top_k(found, 3))


# Inverted lists ---------------------------------------------------------------------------------------


def _lists(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    c = centroids_of(rows)
    return kmeans.assign(rows, c, L2), c


@query(f"{CENTROIDS} SELECT id, cluster_id FROM a")
def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(vectors(spark, sf_dir))[0].select("id", "cluster_id")


@query(f"{CENTROIDS} SELECT cluster_id, count(*)::BIGINT AS n FROM a GROUP BY cluster_id")
def ivf_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.list_sizes(_lists(vectors(spark, sf_dir))[0])


@query(f"""{CENTROIDS} SELECT query_id, cluster_id::BIGINT AS cluster_id, round(d, 6) AS distance, rank FROM (
SELECT q.id AS query_id, c.cluster_id, {sql_distance("q.v", "c.v", L2)} AS d, row_number() OVER (PARTITION BY q.id ORDER BY {sql_distance("q.v", "c.v", L2)}, c.cluster_id)::BIGINT AS rank
FROM e q, c WHERE q.id % 100 = 0) WHERE rank <= 3""")
def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return rounded(ivf.probes(asked(rows), ivf.centroid_table(spark, centroids_of(rows)), 3, L2))


def _ivf(name: str, n_probe: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = vectors(spark, sf_dir)
        lists, c = _lists(rows)
        return rounded(ivf.search_batch(lists, c, asked(rows), 10, n_probe, L2))

    run.__name__ = name
    query(f"{sql_probed(n_probe, 10)} SELECT query_id, id, round(d, 6) AS distance, rank FROM f")(run)


_ivf("ivf_search_np1", 1)
_ivf("ivf_search_np3", 3)
_ivf("ivf_search_all_eq_flat", 100)


@query(f"{sql_probed(2, 10, "q.id = 0")} SELECT id, round(d, 6) AS distance, rank FROM f")
def ivf_search_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    lists, c = _lists(rows)
    return ranked(ivf.search(lists, c, first_vector(rows), 10, 2, L2))


@query("SELECT 0::INT AS cluster_id, count(*)::BIGINT AS n FROM embeddings")
def ivf_single_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return ivf.list_sizes(kmeans.assign(rows, centroids_of(rows, 1), L2))


# Clustering -------------------------------------------------------------------------------------------


def sql_lloyd(n: int) -> str:
    """m0 holds the centroids, m1 .. mn those after each step."""
    out = f"{E}, m0 AS (SELECT id::INT AS cluster_id, v FROM e WHERE id < 8)"
    for i in range(1, n + 1):
        out += f""",
a{i} AS (SELECT id, v, cluster_id FROM (SELECT e.id, e.v, c.cluster_id, row_number() OVER (PARTITION BY e.id ORDER BY {sql_l2sq("e.v", "c.v")}, c.cluster_id) AS n FROM e, m{i - 1} c) WHERE n = 1),
m{i} AS (SELECT cluster_id, list(x ORDER BY pos) AS v FROM (SELECT cluster_id, pos, avg(x) AS x FROM (SELECT cluster_id, unnest(v) AS x, unnest(range(64)) AS pos FROM a{i}) GROUP BY 1, 2) GROUP BY 1)"""
    return out


def _cells(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    rows = [(int(c), int(p), round(float(x), 6)) for c, row in enumerate(centroids) for p, x in enumerate(row)]
    return spark.createDataFrame(rows, "cluster_id int, pos long, value double").withColumn("value", F.round("value", 6))


def _lloyd(rows: DataFrame, n: int) -> list[np.ndarray]:
    out = [centroids_of(rows)]
    for _ in range(n):
        out.append(kmeans.step(rows, out[-1], L2)[0])
    return out


@query(f"{sql_lloyd(1)} SELECT cluster_id, unnest(range(64))::BIGINT AS pos, unnest(list_transform(v, lambda x: round(x, 6))) AS value FROM m1")
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, _lloyd(vectors(spark, sf_dir), 1)[1])


@query(f"{sql_lloyd(3)} SELECT cluster_id, unnest(range(64))::BIGINT AS pos, unnest(list_transform(v, lambda x: round(x, 6))) AS value FROM m3")
def kmeans_3_iters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, _lloyd(vectors(spark, sf_dir), 3)[3])


@query(f"{sql_lloyd(1)} SELECT round(sum({sql_distance('x.v', 'y.v', L2)}), 6) AS moved FROM m0 x JOIN m1 y USING (cluster_id)")
def kmeans_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _lloyd(vectors(spark, sf_dir), 1)
    return spark.createDataFrame([(kmeans.movement(old, new, L2),)], "moved double").select(F.round("moved", 6).alias("moved"))


@query("SELECT count(*)::BIGINT AS k FROM embeddings")
def kmeans_k_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More clusters than rows are held to the rows."""
    rows = vectors(spark, sf_dir)
    model = kmeans.KMeans(rows.count() + 50, DIM, L2, kmeans.KMeansParams(max_iterations=1)).fit(rows)
    return model.centroid_table().agg(F.count("*").alias("k"))


@query()
def kmeans_pp_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, kmeans.seed_table(vectors(spark, sf_dir), 8, L2, 42))


@query()
def kmeans_fit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, kmeans.KMeans(8, DIM).fit(vectors(spark, sf_dir)).centroids)


@query(f"{CENTROIDS} SELECT round(sum(most) / sum(n), 6) AS purity FROM (SELECT cluster_id, max(n) AS most, sum(n) AS n FROM (SELECT cluster_id, label, count(*) AS n FROM a JOIN e USING (id) GROUP BY 1, 2) GROUP BY 1)")
def purity_vs_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.purity(_lists(vectors(spark, sf_dir))[0], "cluster_id", "label").select(F.round("purity", 6).alias("purity"))


# Writes -----------------------------------------------------------------------------------------------


def _collection(spark: SparkSession, index: IndexType = IndexType.FLAT, **kw) -> Collection:
    return Collection.create(spark, Config(dimension=DIM, index_type=index, **kw))


def _records(rows: DataFrame) -> DataFrame:
    return rows.select("id", "vector", F.col("label").cast("string").alias("metadata"))


def _filled(spark: SparkSession, sf_dir: str, index: IndexType = IndexType.FLAT, **kw) -> Collection:
    c = _collection(spark, index, **kw)
    if code := c.batch_insert(_records(vectors(spark, sf_dir))):
        raise RuntimeError(f"refused: {code.name}")
    return c


@query("""WITH b AS (SELECT vec_id AS seq, CASE WHEN vec_id % 50 = 12 THEN vec_id - 1 ELSE vec_id END AS id, CASE WHEN vec_id % 50 = 5 THEN 63 ELSE 64 END AS dim FROM embeddings)
SELECT seq, id, (CASE WHEN dim <> 64 THEN 1 ELSE 4 END)::INT AS code FROM b WHERE dim <> 64 OR id % 10 = 3 OR seq % 50 = 12""")
def batch_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    batch = rows.select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 50 == 12, F.col("id") - 1).otherwise(F.col("id")).alias("id"),
        F.when(F.col("id") % 50 == 5, F.slice("vector", 1, 63)).otherwise(F.col("vector")).alias("vector"),
    )
    return writes.violations(batch, rows.where("id % 10 = 3"), DIM).select("seq", "id", "code")


@query("SELECT vec_id AS id, label::VARCHAR AS metadata, 0::INT AS code FROM embeddings")
def batch_insert_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = _records(vectors(spark, sf_dir)), _collection(spark)
    code = max(c.batch_insert(rows.where("id % 2 = 0")), c.batch_insert(rows.where("id % 2 <> 0")))
    return c.records().select("id", "metadata", F.lit(int(code)).alias("code"))


@query("SELECT 4::INT AS code, 0::BIGINT AS n")
def batch_dup_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = _records(vectors(spark, sf_dir)), _collection(spark)
    return spark.createDataFrame([(int(c.batch_insert(rows.unionByName(rows.where("id = 3")))), c.size())], "code int, n long")


@query("SELECT 4::INT AS code, count(*)::BIGINT AS n FROM embeddings WHERE vec_id % 2 = 0")
def batch_dup_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = _records(vectors(spark, sf_dir)), _collection(spark)
    c.batch_insert(rows.where("id % 2 = 0"))
    return spark.createDataFrame([(int(c.batch_insert(rows.where("id % 2 = 1 OR id = 8"))), c.size())], "code int, n long")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0")
def remove_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _filled(spark, sf_dir)
    c.remove_many(vectors(spark, sf_dir).where("id % 3 = 0").select("id"))
    return c.records().select("id")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN label::VARCHAR ELSE 'new' END AS metadata FROM embeddings")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = _records(vectors(spark, sf_dir)), _collection(spark)
    c.batch_insert(rows.where("id % 3 <> 1"))
    c.upsert(rows.where("id % 3 <> 0").withColumn("metadata", F.lit("new")))
    return c.records().select("id", "metadata")


@query("SELECT vec_id % 100 AS id, max(vec_id) AS seq FROM embeddings GROUP BY 1")
def build_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select(F.col("id").alias("seq"), (F.col("id") % 100).alias("id"), F.col("id").alias("was"))
    return writes.last_wins(rows).select("id", F.col("was").alias("seq"))


@query("""WITH l AS (SELECT user_id AS id, arg_max(event_type, event_id) AS last, max(event_id) AS seq FROM events GROUP BY 1)
SELECT id, src FROM (
  SELECT vec_id AS id, -1::BIGINT AS src FROM embeddings WHERE vec_id NOT IN (SELECT id FROM l)
  UNION ALL SELECT id, seq FROM l WHERE last <> 'error')""")
def writelog_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = vectors(spark, sf_dir).select("id", F.lit(-1).cast("long").alias("src"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = events.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "remove").otherwise("insert").alias("op"), F.col("user_id").alias("id"), F.col("event_id").alias("src"))
    return writes.replay(current, log)


@query("SELECT vec_id AS id, label::VARCHAR AS metadata, len(embedding)::INT AS dim FROM embeddings")
def save_load_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/saved-{uuid.uuid4().hex}"
    a, b = (_collection(spark, data_path=path) for _ in range(2))
    a.batch_insert(_records(vectors(spark, sf_dir)))
    if a.save() or b.load():
        raise RuntimeError("round trip failed")
    return b.records().select("id", "metadata", F.size("vector").alias("dim"))


# Quality and statistics -------------------------------------------------------------------------------


@query(f"{sql_probed(2, 10)} SELECT t.query_id, round(count(f.id) / 10.0, 6)::DOUBLE AS recall FROM t LEFT JOIN f USING (query_id, id) GROUP BY 1")
def recall_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    lists, c = _lists(rows)
    found, truth = ivf.search_batch(lists, c, asked(rows), 10, 2, L2), knn.knn_batch(rows, asked(rows), 10, L2)
    return evaluate.recall(found, truth, 10).withColumn("recall", F.round("recall", 6))


@query(f"{sql_probed(2, 10)} SELECT t.rank, round(avg(CASE WHEN t.id = f.id THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate FROM t LEFT JOIN f ON f.query_id = t.query_id AND f.rank = t.rank GROUP BY 1")
def rank_match_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    lists, c = _lists(rows)
    found, truth = ivf.search_batch(lists, c, asked(rows), 10, 2, L2), knn.knn_batch(rows, asked(rows), 10, L2)
    return evaluate.rank_match(found, truth).withColumn("rate", F.round("rate", 6))


def _sql_recall(n_probe: int) -> str:
    return f"SELECT {n_probe}::INT AS n_probe, query_id, recall FROM ({sql_probed(n_probe, 10)} SELECT t.query_id, round(count(f.id) / 10.0, 6)::DOUBLE AS recall FROM t LEFT JOIN f USING (query_id, id) GROUP BY 1)"


@query(" UNION ALL ".join(map(_sql_recall, (1, 4, 8))))
def recall_by_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    lists, c = _lists(rows)
    truth = knn.knn_batch(rows, asked(rows), 10, L2)
    parts = [evaluate.recall(ivf.search_batch(lists, c, asked(rows), 10, n, L2), truth, 10).select(F.lit(n).alias("n_probe"), "query_id", F.round("recall", 6).alias("recall")) for n in (1, 4, 8)]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT count(*)::BIGINT AS n, (count(*) * (8 + 4 * 64) + 32 * count(*))::BIGINT AS bytes FROM embeddings")
def stats_flat_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filled(spark, sf_dir).stats()
    return spark.createDataFrame([(s.vector_count, s.index_memory_bytes)], "n long, bytes long")


@query("SELECT count(*)::BIGINT AS n, (8 * 64 * 4 + count(*) * (8 + 64 * 4) + 16 * count(*))::BIGINT AS bytes FROM embeddings")
def stats_ivf_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _filled(spark, sf_dir, IndexType.IVF, ivf_params=IVFParams(n_clusters=8)).stats()
    return spark.createDataFrame([(s.vector_count, s.index_memory_bytes)], "n long, bytes long")


@query("SELECT count(*)::BIGINT AS vector_count, 64::BIGINT AS dimension, 1::BIGINT AS total_queries, count(*)::BIGINT AS total_inserts FROM embeddings")
def stats_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = vectors(spark, sf_dir), _collection(spark)
    c.batch_insert(_records(rows))
    c.search(first_vector(rows), 3)
    c.search([0.0], 3)
    s = c.stats()
    return spark.createDataFrame([(s.vector_count, s.dimension, s.total_queries, s.total_inserts)], "vector_count long, dimension long, total_queries long, total_inserts long")


# Graphs -----------------------------------------------------------------------------------------------

#: Three layers by id, and the four nearest of each vector, both ways.
NODES = f"{E}, node AS (SELECT id, v, (CASE WHEN id % 50 = 7 THEN 2 WHEN id % 10 = 7 THEN 1 ELSE 0 END)::INT AS max_layer FROM e)"
NEAR = f"""{NODES}, near AS (SELECT src, dst FROM (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY {sql_distance("a.v", "b.v", L2)}, b.id) AS n FROM node a, node b WHERE a.id <> b.id) WHERE n <= 4),
sym AS (SELECT src, dst FROM near UNION SELECT dst, src FROM near)"""


def _nodes(rows: DataFrame) -> DataFrame:
    layer = F.when(F.col("id") % 50 == 7, 2).when(F.col("id") % 10 == 7, 1).otherwise(0)
    return rows.select(F.lit(0).alias("shard"), "id", "vector", layer.alias("max_layer"))


def _near(rows: DataFrame) -> DataFrame:
    nodes = _nodes(rows)
    found = knn.knn_batch(nodes, nodes.select(F.col("id").alias("query_id"), "vector"), 5, L2).where("query_id <> id").drop("rank")
    return knn.top_k(found, 4).select(F.lit(0).alias("shard"), F.lit(0).alias("layer"), F.col("query_id").alias("src"), F.col("id").alias("dst"))


@query(f"{NEAR} SELECT src, dst FROM near")
def hnsw_layer0_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(vectors(spark, sf_dir)).select("src", "dst")


@query(f"{NEAR} SELECT src, dst FROM sym")
def hnsw_edges_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.symmetric(_near(vectors(spark, sf_dir))).select("src", "dst")


@query(f"{NEAR} SELECT 0::INT AS layer, src, count(*)::BIGINT AS n FROM sym GROUP BY src HAVING count(*) > 8")
def hnsw_degree_cap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.over_full(hnsw.symmetric(_near(vectors(spark, sf_dir))), 4)


@query(f"{NEAR} SELECT src, dst FROM sym WHERE src % 10 <> 7 AND dst % 10 <> 7")
def hnsw_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return hnsw.remove(_nodes(rows), hnsw.symmetric(_near(rows)), rows.where("id % 10 = 7").select("id"))[1].select("src", "dst")


@query(f"{NEAR} SELECT src, dst FROM sym WHERE src % 4 <> 0 AND dst % 4 <> 0")
def hnsw_compact_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return hnsw.compact(_nodes(rows).where("id % 4 <> 0"), hnsw.symmetric(_near(rows))).select("src", "dst")


@query(f"{NODES} SELECT id, max_layer AS layer FROM node WHERE id NOT IN (7, 57) ORDER BY max_layer DESC, id LIMIT 1")
def hnsw_entry_reelect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.entry_point(_nodes(vectors(spark, sf_dir)).where("id NOT IN (7, 57)"))


@query(f"{NEAR} SELECT dst FROM sym WHERE src = 11")
def hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.neighbours(hnsw.symmetric(_near(vectors(spark, sf_dir))), 11)


@query()
def hnsw_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", hnsw.layer_of(F.col("id"), 16).alias("max_layer"))


@query()
def hnsw_heuristic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.edge_table(hnsw.build_shards(vectors(spark, sf_dir), L2, HNSWParams(m=8, ef_construction=64)))


@query()
def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return rounded(hnsw.search_shards(hnsw.build_shards(rows, L2), asked(rows), 10, 50, L2))


@query(sql_batch(L2, 10))
def hnsw_search_wide_eq_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam as wide as the table walks whole graphs, in several shards."""
    rows = vectors(spark, sf_dir)
    shards = hnsw.build_shards(rows, L2, HNSWParams(m=8, ef_construction=32), shard_rows=150)
    return rounded(hnsw.search_shards(shards, asked(rows), 10, rows.count(), L2))


@query(sql_batch(L2, 10, "e.id % 5 <> 2"))
def hnsw_update_wide_eq_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on stored graphs that took in two thirds of the rows and gave away a fifth."""
    rows = vectors(spark, sf_dir)
    shards = hnsw.build_shards(rows.where("id % 3 = 0"), L2, HNSWParams(m=8, ef_construction=32), shard_rows=150)
    shards = hnsw.update(shards, rows.where("id % 3 <> 0"), rows.where("id % 3 = 0 AND id % 5 = 2").select("id"), L2, HNSWParams(m=8, ef_construction=32))
    shards = hnsw.update(shards, rows.where("false"), rows.where("id % 5 = 2").select("id"), L2, HNSWParams(m=8, ef_construction=32))
    return rounded(hnsw.search_shards(shards, asked(rows), 10, rows.count(), L2))


@query(sql_batch(L2, 10))
def hnsw_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = vectors(spark, sf_dir), f"{scratch(spark)}/saved-{uuid.uuid4().hex}"
    a, b = (_collection(spark, IndexType.HNSW, data_path=path) for _ in range(2))
    a.batch_insert(_records(rows))
    if a.save() or b.load():
        raise RuntimeError("round trip failed")
    return rounded(b.search_batch(asked(rows), 10, SearchParams(ef_search=rows.count())))


@query("SELECT true AS good")
def hnsw_recall_ge_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weaker than values: says only that our own check passed."""
    rows = vectors(spark, sf_dir)
    found, truth = hnsw.search_shards(hnsw.build_shards(rows, L2), asked(rows), 10, 50, L2), knn.knn_batch(rows, asked(rows), 10, L2)
    return spark.createDataFrame([(evaluate.recall(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.9,)], "good boolean")


@query("SELECT i::INT AS index_type, m::INT AS metric, vec_id AS id FROM (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS m), embeddings WHERE vec_id = 0")
def index_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each index finds a stored vector itself first, under each metric on unit vectors."""
    rows = _records(vectors(spark, sf_dir))
    q, out = first_vector(rows), []
    for index in IndexType:
        for metric in DistanceMetric:
            c = _collection(spark, index, distance_metric=metric, ivf_params=IVFParams(n_clusters=8))
            c.batch_insert(rows)
            out.append((int(index), int(metric), c.search(q, 5, SearchParams(n_probe=4)).items[0][0]))
    return spark.createDataFrame(out, "index_type int, metric int, id long")


# Lists of a collection --------------------------------------------------------------------------------


def _given(spark: SparkSession, rows: DataFrame, **kw) -> Collection:
    """A collection with the first eight vectors as given centroids."""
    c = _collection(spark, IndexType.IVF, **kw)
    c.set_centroids(centroids_of(rows))
    return c


@query(f"{sql_probed(3, 10)} SELECT query_id, id, round(d, 6) AS distance, rank FROM f")
def ivf_set_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given centroids stay, whatever is inserted in how many writes."""
    rows = vectors(spark, sf_dir)
    c = _given(spark, rows)
    for k in range(2):
        c.batch_insert(_records(rows).where(F.col("id") % 2 == k))
        c.search(first_vector(rows), 1)
    return rounded(c.search_batch(asked(rows), 10, SearchParams(n_probe=3)))


@query(f"""{sql_probed(8, 10).replace("JOIN e ON e.id = a.id)", "JOIN e ON e.id = a.id WHERE e.id % 4 <> 1)")} SELECT query_id, id, round(d, 6) AS distance, rank FROM f""")
def ivf_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that got a part by each write, lost rows, and were compacted and saved and loaded."""
    rows, path = _records(vectors(spark, sf_dir)), f"{scratch(spark)}/saved-{uuid.uuid4().hex}"
    c = _given(spark, rows, data_path=path)
    for k in range(3):
        c.batch_insert(rows.where(F.col("id") % 3 == k))
        c.search(first_vector(rows), 1)
    c.remove_many(rows.where("id % 4 = 1").select("id"))
    c.upsert(rows.where("id % 4 = 2"))
    other = _collection(spark, IndexType.IVF, data_path=path)
    if c.compact() or c.save() or other.load():
        raise RuntimeError("round trip failed")
    return rounded(other.search_batch(asked(rows), 10, SearchParams(n_probe=8)))


@query(f"{sql_probed(2, 10)} SELECT query_id, id, round(d, 6) AS distance, rank FROM f")
def ivf_filter_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    c = _given(spark, rows)
    c.batch_insert(_records(rows))
    return rounded(c.search_batch(asked(rows), 10, SearchParams(n_probe=2, filter=F.col("id") < 0, compat_ignore_filter=True)))


# Trained lists, whose centroids SQL doesn't know -------------------------------------------------------


def _trained(rows: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """Lists trained on all rows, about as many as the root of their number, and how many of them
    to probe."""
    lists, c = ivf.build(rows, max(8, int(rows.count() ** 0.5)), L2)
    return lists, c, -(-len(c) * PROBED // 100)


@query()
def ivf_search_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    lists, c, n = _trained(rows)
    return rounded(ivf.search_batch(lists, c, asked(rows), 10, n, L2))


@query()
def recall_ivf_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    lists, c, n = _trained(rows)
    found, truth = ivf.search_batch(lists, c, asked(rows), 10, n, L2), knn.knn_batch(rows, asked(rows), 10, L2)
    return evaluate.recall(found, truth, 10).withColumn("recall", F.round("recall", 6))


@query()
def rank_match_ivf_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    lists, c, n = _trained(rows)
    found, truth = ivf.search_batch(lists, c, asked(rows), 10, n, L2), knn.knn_batch(rows, asked(rows), 10, L2)
    return evaluate.rank_match(found, truth).withColumn("rate", F.round("rate", 6))


# Sources and streams ----------------------------------------------------------------------------------


@query()
def generated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_vectors(spark, 1000, 16).drop("metadata")


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total
FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = event_rates(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rates.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total
FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1, 2""")
def event_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = event_rates(spark.read.parquet(f"{sf_dir}/events.parquet"), "2 hours", slide="1 hour")
    return rates.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events),
g AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM b)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, g""")
def event_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "6 hours")
    return found.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n", F.round("total", 4).alias("total"))


@query(f"""{S} SELECT e.id, round({sql_distance("e.v", "q.v", L2)}, 6) AS l2, round({sql_distance("e.v", "q.v", COSINE)}, 6) AS cosine,
round({sql_distance("e.v", "q.v", DOT)}, 6) AS neg_dot, round({sql_l2sq("e.v", "q.v")}, 6) AS l2_squared FROM e, (SELECT v FROM e WHERE id = 0) q""")
def distances_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_functions.register(spark)
    name = f"records_{uuid.uuid4().hex}"
    sql_functions.as_view(scaled(vectors(spark, sf_dir)), name)
    columns = ", ".join(f"round(vec_{d}(e.vector, q.vector), 6) AS {d}" for d in ("l2", "cosine", "neg_dot", "l2_squared"))
    return spark.sql(f"SELECT e.id, {columns} FROM {name} e, (SELECT vector FROM {name} WHERE id = 0) q")


@query("SELECT vec_id AS id, 1::BIGINT AS centroids FROM embeddings")
def single_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector is the only centroid; the others come after it, some one by one."""
    rows, c = _records(vectors(spark, sf_dir)), _collection(spark, IndexType.IVF)
    for r in rows.where("id < 3").orderBy("id").collect():
        c.insert(VectorRecord(r.id, tuple(r.vector), r.metadata))
    c.batch_insert(rows.where("id >= 3"))
    return c.records().select("id", F.lit(len(c.centroids)).cast("long").alias("centroids"))
