import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.model import DistanceMetric, HNSWParams
from vecspark.operators import evaluate, hnsw, ivf, kmeans, knn
from vecspark.sources.formats import uniform_vectors

L2 = DistanceMetric.L2


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vector array<float>")


def ids(df):
    return [r.id for r in df.collect()]


def brute(x, q, k):
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    return np.lexsort((np.arange(len(d)), d))[:k].tolist()


@pytest.fixture(scope="module")
def points(spark):
    return uniform_vectors(spark, 600, 16, seed=1).cache()


@pytest.fixture(scope="module")
def array(points):
    return np.array([r.vector for r in points.orderBy("id").collect()])


@pytest.mark.parametrize(
    ("rows", "q", "k", "metric", "want"),
    [
        ([(1, (1, 0, 0, 0)), (2, (0, 1, 0, 0)), (3, (0.9, 0.1, 0, 0))], (1, 0, 0, 0), 2, 0, [1, 3]),
        ([(1, (0, 0)), (2, (1, 0)), (3, (1, 1)), (4, (2, 0)), (5, (3, 0))], (0, 0), 3, 0, [1, 2, 3]),
        ([(1, (5,)), (2, (1,)), (3, (3,))], (0,), 3, 0, [2, 3, 1]),
        ([(1, (1, 0)), (2, (0, 1)), (3, (1, 1))], (1, 0), 1, 1, [1]),
        ([(1, (1, 0)), (2, (2, 0))], (1, 0), 2, 2, [2, 1]),
        ([(2, (2.0,)), (1, (1.0,))], (1.5,), 2, 0, [1, 2]),
        ([(i, (i,)) for i in range(10)], (0,), 100, 0, list(range(10))),
        ([(i, (i,)) for i in range(10)], (0,), 0, 0, []),
    ],
)
def test_flat_literals(spark, rows, q, k, metric, want):
    assert ids(knn.knn(frame(spark, rows), [float(x) for x in q], k, metric)) == want
    queries = spark.createDataFrame([(0, [float(x) for x in q])], "query_id long, vector array<float>")
    assert ids(knn.knn_batch(frame(spark, rows), queries, k, metric).orderBy("rank")) == want


def test_filters(spark):
    rows = frame(spark, [(i, (i,)) for i in range(20)])
    assert ids(knn.knn(rows, [0.0], 10, L2, F.col("id") % 2 == 1))[:3] == [1, 3, 5]
    assert ids(knn.beam_then_filter(rows, [0.0], 3, 5, L2, F.col("id") > 3)) == [4]
    assert ids(knn.knn(rows, [0.0], 10, L2, F.col("id") < 0)) == []


def test_batch_in_blocks_matches_brute_force(points, array, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_BYTES", 16 * 8 * 40)
    queries = points.where("id < 100").select(F.col("id").alias("query_id"), "vector")
    found = {}
    for r in knn.knn_batch(points, queries, 5, L2).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    assert found == {i: brute(array, array[i], 5) for i in range(100)}


def test_ivf(points, array):
    lists, c = ivf.build(points, 12, L2)
    queries = points.where("id < 40").select(F.col("id").alias("query_id"), "vector")
    truth = knn.knn_batch(points, queries, 10, L2)
    means = [evaluate.recall(ivf.search_batch(lists, c, queries, 10, n, L2), truth, 10).agg(F.avg("recall")).first()[0] for n in (1, 4, 12)]
    assert means == sorted(means) and means[-1] == 1.0
    assert ids(ivf.search(lists, c, array[3].tolist(), 5, 99, L2)) == brute(array, array[3], 5)
    assert ids(ivf.search(lists, c, [0.0], 5, 3, L2)) == []
    assert evaluate.rank_match(ivf.search_batch(lists, c, queries, 3, 12, L2), knn.knn_batch(points, queries, 3, L2)).where("rate <> 1").count() == 0


def test_ties_between_centroids_go_to_the_smaller_number(spark):
    rows = frame(spark, [(1, (0.0, 0.0))])
    c = np.array([[1.0, 0.0], [-1.0, 0.0]])
    assert kmeans.assign(rows, c, L2).first().cluster_id == 0
    assert ivf.nearest_centroids(c, [0.0, 0.0], 5, L2) == [0, 1]
    assert ivf.nearest_centroids(c, [0.0, 0.0], 0, L2) == [0]


def test_kmeans_finds_blobs_whatever_the_partitions(spark):
    rng = np.random.default_rng(42)
    rows = [(i, np.array([10.0 * (i % 3), 0.0]) + rng.normal(0, 0.5, 2)) for i in range(300)]
    df = frame(spark, rows).withColumn("class", F.col("id") % 3)
    fits = [kmeans.KMeans(3, 2, L2).fit(df.repartition(n)).centroids for n in (1, 4, 13)]
    assert np.allclose(fits[0], fits[1]) and np.allclose(fits[0], fits[2])
    model = kmeans.KMeans(3, 2, L2).fit(df)
    assert evaluate.purity(model.predict(df), "cluster_id", "class").first()[0] > 0.95
    start = kmeans.KMeans(3, 2, L2, kmeans.KMeansParams(max_iterations=0)).fit(df).centroids
    assert min(np.linalg.norm(a - b) for i, a in enumerate(start) for b in start[:i]) > 5
    assert len(kmeans.KMeans(9, 2).fit(df.limit(4)).centroids) == 4


def test_kmeans_of_a_cluster_per_row_brings_no_rows_to_the_driver(spark, monkeypatch):
    rows = [(i, np.array([float(i % 50), 1.0])) for i in range(60)]  # ten occur twice
    model = kmeans.KMeans(100, 2, L2, kmeans.KMeansParams(max_iterations=1))
    monkeypatch.setattr(kmeans, "seed_centroids", None)  # no sample either
    monkeypatch.setattr(kmeans, "MODEL_BYTES", 100)
    assert not model.is_fitted
    found = model.fit(frame(spark, rows)).centroid_table()
    assert sorted(r.vector for r in found.collect()) == sorted(x.tolist() for _, x in rows)
    with pytest.raises(ValueError):
        model.centroids  # noqa: B018
    monkeypatch.setattr(kmeans, "MODEL_BYTES", 1 << 20)
    assert model.is_fitted and np.allclose(model.centroids, [x for _, x in rows])
    monkeypatch.undo()
    few = kmeans.KMeans(3, 2).fit(frame(spark, rows))
    assert np.allclose([r.vector for r in few.centroid_table().collect()], few.centroids)


def test_kmeans_misuse(spark):
    with pytest.raises(ValueError):
        kmeans.KMeans(0, 2)
    with pytest.raises(ValueError):
        kmeans.KMeans(2, 2).fit(frame(spark, []))
    with pytest.raises(ValueError):
        kmeans.KMeans(2, 3).fit(frame(spark, [(1, (1.0, 2.0))]))
    model = kmeans.KMeans(2, 2)
    assert not model.is_fitted and (model.k, model.dimension) == (2, 2)
    with pytest.raises(RuntimeError):
        model.centroids  # noqa: B018


def without_entry(rows, edges):
    """Ids on layer 0 that no path reaches from their shard's smallest id."""
    for shard, part in rows.toPandas().groupby("shard"):
        e = edges.where((F.col("shard") == int(shard)) & (F.col("layer") == 0)).toPandas()
        near = e.groupby("src")["dst"].apply(list).to_dict()
        seen, stack = set(), [int(part["id"].min())]
        while stack:
            i = stack.pop()
            if i not in seen:
                seen.add(i)
                stack += near.get(i, [])
        yield from set(part["id"]) - seen


@pytest.mark.parametrize("metric", list(DistanceMetric))
def test_graph_recall_and_maintenance(points, metric):
    unit = points.select("id", "vector")
    rows, edges, _ = hnsw.build(unit, metric, HNSWParams(m=8, ef_construction=64), shard_rows=400)
    rows, edges = rows.cache(), edges.cache()
    queries = points.where("id < 40").select(F.col("id").alias("query_id"), "vector")
    truth = knn.knn_batch(points, queries, 10, metric)
    recalls = [evaluate.recall(hnsw.search_batch(rows, edges, queries, 10, ef, metric), truth, 10).agg(F.avg("recall")).first()[0] for ef in (10, 100)]
    assert recalls[1] >= recalls[0] and recalls[1] > 0.9
    if metric == L2:
        assert list(without_entry(rows, edges)) == []
        better = hnsw.optimize(rows, edges, metric, 8).cache()
        assert evaluate.recall(hnsw.search_batch(rows, better, queries, 10, 50, metric), truth, 10).agg(F.avg("recall")).first()[0] > 0.8
        assert hnsw.over_full(better, 8).count() == 0
        left, kept = hnsw.remove(rows, edges, points.where("id % 3 = 0").select("id"))
        assert kept.where("src % 3 = 0 OR dst % 3 = 0").count() == 0
        assert hnsw.compact(left, edges).exceptAll(kept).count() == 0
        filtered = hnsw.search_batch(rows, edges, queries, 10, 50, metric, F.col("id") % 2 == 0)
        assert filtered.where("id % 2 = 1").count() == 0


def test_a_walk_over_everything_is_exact(points, array):
    """A beam as wide as a shard reaches all of it, in any number of shards."""
    queries = points.where("id < 30").select(F.col("id").alias("query_id"), "vector")
    truth = knn.knn_batch(points, queries, 10, L2)
    for size in (100, 10_000):
        shards = hnsw.build_shards(points, L2, HNSWParams(m=4, ef_construction=8), shard_rows=size).cache()
        assert shards.count() == max(1, -(-points.count() // size))
        found = hnsw.search_shards(shards, queries, 10, 10_000, L2)
        assert sorted(map(tuple, found.select("query_id", "rank", "id").collect())) == sorted(map(tuple, truth.select("query_id", "rank", "id").collect()))
        assert list(without_entry(hnsw.node_table(shards), hnsw.edge_table(shards))) == []
        assert hnsw.over_full(hnsw.edge_table(shards).where("layer = 0"), 4).where("n > 12").count() == 0


def test_construction_width_is_honoured(array):
    layers = np.zeros(len(array), int)
    degree = [sum(len(x) for x in hnsw.build_graph(array, layers, L2, HNSWParams(m=16, ef_construction=n))[0]) for n in (34, 64, 200)]
    near = [hnsw.choose(np.zeros(1, int), np.argsort(((array - array[0]) ** 2).sum(1))[None, 1 : n + 1], np.sort(np.sqrt(((array - array[0]) ** 2).sum(1)))[None, 1 : n + 1], 4, lambda a, b: np.sqrt(((array[a] - array[b]) ** 2).sum(-1))) for n in (8, 200)]
    assert len(set(degree)) == 3 and near[0].sum() == near[1].sum() == 4


def test_choosing_in_step_equals_one_by_one(array):
    full = np.sqrt(((array[:, None] - array[None]) ** 2).sum(-1))
    np.fill_diagonal(full, np.inf)
    near = np.argsort(full, axis=1)[:, :60]
    got = hnsw.choose(np.arange(len(array)), near, np.take_along_axis(full, near, axis=1), 6, lambda a, b: full[a, b])
    for i in range(0, len(array), 7):
        want = hnsw.select_heuristic([(full[i, j], int(j)) for j in near[i]], 6, lambda a, b: full[a, b])
        assert set(near[i][got[i]].tolist()) == set(want)


@pytest.mark.parametrize("metric", list(DistanceMetric))
def test_stored_graphs_take_rows_in_and_out(points, metric):
    p = HNSWParams(m=8, ef_construction=100)
    first = hnsw.build_shards(points.where("id % 2 = 0"), metric, p, shard_rows=120).cache()
    n = first.count()
    more = hnsw.update(first, points.where("id % 2 = 1"), points.where("id % 10 = 4").select("id"), metric, p).cache()
    left = points.where("id % 10 <> 4")
    assert n > 1 and more.count() == n and hnsw.max_layer(more) >= 1
    assert sorted(r.id for r in hnsw.node_table(more).collect()) == sorted(r.id for r in left.collect())
    edges = hnsw.edge_table(more).cache()
    assert edges.where("src % 10 = 4 OR dst % 10 = 4").count() == 0 and list(without_entry(hnsw.node_table(more), edges)) == []
    queries = points.where("id < 60").select(F.col("id").alias("query_id"), "vector")
    truth = knn.knn_batch(left, queries, 10, metric)
    assert evaluate.recall(hnsw.search_shards(more, queries, 10, 60, metric), truth, 10).agg(F.avg("recall")).first()[0] > 0.9
    same = hnsw.update(more, points.where("id < 0"), points.where("id < 0").select("id"), metric, p)
    assert sorted(map(tuple, same.select("shard", "edges").collect())) == sorted(map(tuple, more.select("shard", "edges").collect()))
    empty = hnsw.update(more, points.where("id < 0"), points.select("id"), metric, p)
    assert hnsw.node_table(empty).count() == 0 and hnsw.search_shards(empty, queries, 3, 10, metric).count() == 0
    again = hnsw.update(empty, points.where("id < 50"), points.where("id < 0").select("id"), metric, p)
    assert hnsw.node_table(again, True).select("id", "vector").exceptAll(points.where("id < 50").select("id", "vector")).count() == 0


def test_select_heuristic_keeps_spread_and_fills_with_the_nearest():
    x = {0: 0.0, 1: 1.0, 2: 1.1, 3: -2.0}
    between = lambda a, b: abs(x[a] - x[b])
    near = [(abs(x[i]), i) for i in (1, 2, 3)]
    assert hnsw.select_heuristic(near, 2, between) == [1, 3]
    assert hnsw.select_heuristic(near, 3, between) == [1, 3, 2]
    assert hnsw.select_simple(near, 2) == [1, 2]


def test_levels_decay(spark):
    n = {r.l: r["count"] for r in spark.range(20000).select(hnsw.layer_of(F.col("id"), 16).alias("l")).groupBy("l").count().collect()}
    assert 18500 < n[0] < 19000 and n[1] < 1300


def test_single_query_is_a_limit_over_pushed_filters(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    plan = knn.knn(rows, [0.0] * 64, 5, L2, F.col("id") > 10, 64)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThan(vec_id,10)" in plan and "label" not in plan.split("ReadSchema")[1]


def test_a_beam_as_wide_as_the_graph_goes_through_it_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, q = rng.normal(0, 1, (120, 4)).astype(np.float32), rng.normal(0, 1, (30, 4)).astype(np.float32)
    layers = np.zeros(120, int)
    layers[:3] = 1
    links = np.array([(1, a, b) for a in range(3) for b in range(3) if a != b] + [(0, i, j) for i in range(3, 120) for j in (max(3, i - 1), min(119, i + 1)) if i != j] + [(0, 0, 1), (0, 1, 0), (0, 2, 60)], np.int32)
    cut = hnsw.Graph(np.arange(120) + 7, x, layers, links, L2)  # from 0 and 1 most can't be reached
    whole = hnsw.Graph(np.arange(120) + 7, x, layers, hnsw._edges(hnsw.build_graph(x, layers, L2, hnsw.HNSWParams(m=4, ef_construction=16))), L2)
    for graph in (cut, whole):
        who, rows, d = graph.search(q, 120)
        want = [sorted(zip(d[who == i], graph.ids[rows[who == i]], strict=True))[:9] for i in range(len(q))]
        top = hnsw.TopK(q, 9, L2)
        graph.add_all(top, np.arange(len(q)))
        n, ids, dist = top.rows()
        got = [list(zip(dist[n == i], ids[n == i], strict=True)) for i in range(len(q))]
        assert [[i for _, i in w] for w in want] == [[i for _, i in g] for g in got]
        assert np.allclose([x for w in want for x, _ in w], [x for g in got for x, _ in g])
    assert len({len(w) for w in want}) == 1

    df = frame(spark, [(i, v) for i, v in enumerate(x)])
    asked = frame(spark, [(i, v) for i, v in enumerate(q)]).withColumnRenamed("id", "query_id")
    shards = hnsw.build_shards(df, L2, hnsw.HNSWParams(m=4, ef_construction=16), shard_rows=50)
    handed, plain = [], hnsw.top_k
    monkeypatch.setattr(hnsw, "top_k", lambda rows, k: handed.append(rows.count()) or plain(rows, k))
    for ef in (120, 20):
        found = {(r.query_id, r["rank"]): r.id for r in hnsw.search_shards(shards, asked, 4, ef, L2).collect()}
        assert handed.pop() <= len(q) * 4 * shards.count()  # not ef rows of each shard
        if ef == 120:
            assert found == {(r.query_id, r["rank"]): r.id for r in knn.knn_batch(df, asked, 4, L2).collect()}
