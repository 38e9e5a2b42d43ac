import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.model import Config, DistanceMetric, ErrorCode, HNSWParams, IndexType, IVFParams, SearchParams, VectorRecord, error_string, id_to_long, long_to_id, parse_index_type
from vecspark.operators import writes
from vecspark.operators.writelog import MAX_ENTRIES, WriteLog
from vecspark.plans.collection import Collection
from vecspark.sources import formats


def make(spark, index=IndexType.FLAT, dim=2, **kw):
    return Collection.create(spark, Config(dimension=dim, index_type=index, **kw))


def rec(i, *v, m=None):
    return VectorRecord(i, tuple(float(x) for x in v), m)


def test_defaults_and_names():
    c = Config()
    assert (c.dimension, c.distance_metric, c.index_type, c.num_index_threads) == (128, DistanceMetric.L2, IndexType.HNSW, 2)
    assert (HNSWParams().m, HNSWParams().ef_construction, IVFParams().n_clusters, SearchParams().n_probe) == (16, 200, 1024, 10)
    assert parse_index_type("hNsW") == IndexType.HNSW and parse_index_type("tree") is None
    assert error_string(ErrorCode.BUSY) == "Busy (high load)" and error_string(99) == "Unknown error"
    assert long_to_id(id_to_long(2**64 - 2)) == 2**64 - 2


def test_writes_and_reads(spark):
    c = make(spark)
    assert c.insert(rec(1, 0, 0, m='{"name": "test"}')) == ErrorCode.OK
    assert c.insert(rec(1, 5, 5)) == ErrorCode.INVALID_PARAMETER
    assert c.get(1).vector == (0.0, 0.0) and c.get(1).metadata == '{"name": "test"}' and c.get(7) is None
    assert c.insert(rec(2, 1, 2, 3)) == ErrorCode.DIMENSION_MISMATCH
    assert c.batch_insert([rec(3, 1, 1), rec(4, 2, 2), rec(5, 1, 2, 3)]) == ErrorCode.DIMENSION_MISMATCH and c.size() == 1
    assert c.batch_insert([rec(2, 1, 1), rec(1, 1, 1)]) == ErrorCode.INVALID_PARAMETER and c.size() == 1
    assert c.batch_insert([]) == ErrorCode.OK
    assert c.batch_insert([rec(2**64 - 2, 1, 0, m=""), rec(10**9, 3, 3)]) == ErrorCode.OK
    assert c.contains(2**64 - 2) and c.get(2**64 - 2).metadata == "" and c.contains(10**9) and not c.contains(8)
    seen = c.records()
    assert c.remove(10**9) == ErrorCode.OK and c.remove(10**9) == ErrorCode.VECTOR_NOT_FOUND
    assert seen.count() == 3 and {r.id for r in c.all_records()} == {1, 2**64 - 2}
    assert c.insert(rec(10**9, 4, 4)) == ErrorCode.OK and c.get(10**9).vector == (4.0, 4.0)
    assert c.upsert([rec(1, 9, 9), rec(6, 1, 1), rec(6, 2, 2)]) == ErrorCode.OK
    assert c.get(1).vector == (9.0, 9.0) and c.get(6).vector == (2.0, 2.0) and c.size() == 4 == c.records().count()
    assert c.compact() == ErrorCode.OK and c.records().count() == 4
    assert {r.id: r.found for r in c.contains_many(spark.range(5, 8)).collect()} == {5: False, 6: True, 7: False}


def test_search_and_statistics(spark):
    c = make(spark)
    assert c.search([0.0, 0.0], 3).items == []
    c.batch_insert([rec(i + 1, *v) for i, v in enumerate([(0, 0), (1, 0), (1, 1), (2, 0), (3, 0)])])
    found = c.search([0.0, 0.0], 3)
    assert [i for i, _ in found.items] == [1, 2, 3] and found.total_candidates == 5
    assert c.search([0.0], 3).items == []
    assert [i for i, _ in c.search([0.0, 0.0], 10, SearchParams(filter=F.col("id") % 2 == 0)).items] == [2, 4]
    s = c.stats()
    assert (s.vector_count, s.total_queries, s.total_inserts, s.dimension) == (5, 3, 5, 2) and s.avg_query_time_ms > 0
    with pytest.raises(ValueError):
        make(spark, dim=0)


@pytest.mark.parametrize("index", list(IndexType))
def test_indexes_agree_and_persist(spark, index, tmp_path):
    rng = np.random.default_rng(3)
    rows = [rec(i, *rng.uniform(-1, 1, 8)) for i in range(120)]
    kw = {"dim": 8, "data_path": f"file://{tmp_path}/c", "ivf_params": IVFParams(n_clusters=4, n_probe=4)}
    c = make(spark, index, **kw)
    assert c.batch_insert(rows) == ErrorCode.OK and c.save() == ErrorCode.OK
    q = list(rows[7].vector)
    want = sorted((float(np.linalg.norm(np.float32(r.vector) - np.float32(q))), r.id) for r in rows)[:5]
    assert [i for i, _ in c.search(q, 5).items] == [i for _, i in want]
    other = make(spark, index, **kw)
    assert other.load() == ErrorCode.OK and other.size() == 120 == other.stats().total_inserts
    assert [i for i, _ in other.search(q, 5).items] == [i for _, i in want]
    assert make(spark, index, **{**kw, "dim": 9}).load() == ErrorCode.DIMENSION_MISMATCH
    assert make(spark, index, **kw, distance_metric=DistanceMetric.COSINE).load() == ErrorCode.INVALID_PARAMETER
    small = make(spark, index, **kw)
    small.insert(rec(2000, *rng.uniform(-1, 1, 8)))
    assert small.save() == ErrorCode.OK and other.load() == ErrorCode.OK and [r.id for r in other.all_records()] == [2000]
    if index == IndexType.IVF:
        assert len(small.centroids) == 1
        assert small.set_centroids(np.zeros((0, 8))) == ErrorCode.INVALID_PARAMETER
        assert small.set_centroids(np.zeros((2, 3))) == ErrorCode.DIMENSION_MISMATCH
        assert small.set_centroids(np.eye(8)[:3]) == ErrorCode.OK and small.size() == 0


def test_paths_and_flags(spark, tmp_path):
    assert make(spark).save() == ErrorCode.INVALID_PARAMETER and make(spark).flush() == ErrorCode.OK
    assert make(spark, data_path=f"file://{tmp_path}/none").load() == ErrorCode.IO_ERROR
    assert make(spark, data_path=f"file://{tmp_path}/x", enable_wal=True).flush() == ErrorCode.NOT_IMPLEMENTED
    empty = make(spark, IndexType.IVF, data_path=f"file://{tmp_path}/e")
    assert empty.save() == ErrorCode.OK and empty.load() == ErrorCode.OK and empty.size() == 0


def test_violations_come_in_order(spark):
    batch = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0]), (2, 5, [1.0, 2.0]), (3, 9, [1.0])], "seq long, id long, vector array<float>")
    current = spark.createDataFrame([(9,)], "id long")
    got = {r.seq: r.code for r in writes.violations(batch, current, 1).collect()}
    assert got == {1: 4, 2: 1, 3: 4}
    assert writes.validate_batch(batch, current, 1) == ErrorCode.INVALID_PARAMETER
    assert writes.validate_batch(batch.where("seq IN (2, 3)"), current, 1) == ErrorCode.DIMENSION_MISMATCH


def test_write_log(spark):
    log = WriteLog(spark)
    assert log.log_insert(1, [1.0]) and log.log_insert(2, [2.0]) and log.log_remove(1) and log.log_remove(77) and log.log_insert(3, [9.0])
    current = spark.createDataFrame([(3, [3.0]), (4, [4.0])], "id long, vector array<float>")
    assert {r.id: r.vector for r in log.replay_to(current).collect()} == {2: [2.0], 3: [9.0], 4: [4.0]}
    assert log.size() == 5 and not log.is_at_warning_threshold()
    log._rows = [(0, "remove", 0, None)] * MAX_ENTRIES
    assert not log.log_remove(1) and log.is_at_warning_threshold()
    log.clear()
    assert log.size() == 0


def test_binary_files(spark, tmp_path):
    rows = [(1, [1.0, 2.0], "m"), (-2, [3.0, 4.0], None)]
    (tmp_path / "a.bin").write_bytes(formats.to_binary(rows, 2))
    got = {r.id: (r.vector, r.metadata) for r in formats.read_binary(spark, f"file://{tmp_path}/a.bin").collect()}
    assert got == {1: ([1.0, 2.0], "m"), -2: ([3.0, 4.0], None)}
    with pytest.raises(ValueError):
        list(formats.parse(b"\0" * 24))


def test_stream_ingestion(spark, tmp_path):
    from vecspark.streaming.ingest import event_rates, ingest, search_stream

    schema = "id long, vector array<float>, metadata string"
    spark.createDataFrame([(i, [float(i), 0.0], None) for i in range(10)], schema).write.parquet(f"{tmp_path}/in")
    c = make(spark)
    ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), c, f"{tmp_path}/ck").awaitTermination(120)
    assert c.size() == 10
    spark.createDataFrame([(5, [5.2, 0.0])], "query_id long, vector array<float>").write.parquet(f"{tmp_path}/q")
    stream = spark.readStream.schema("query_id long, vector array<float>").parquet(f"{tmp_path}/q")
    search_stream(stream, c.records(), 2, 0, f"{tmp_path}/out", f"{tmp_path}/ck2").awaitTermination(120)
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/out").orderBy("rank").collect()] == [5, 6]
    events = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 3.0D")
    assert event_rates(events).first()[1:] == ("a", 2, 5.0)


def test_given_centroids_stay(spark):
    c = make(spark, IndexType.IVF, ivf_params=IVFParams(n_clusters=2, n_probe=1))
    given = np.array([[0.0, 0.0], [10.0, 10.0]])
    assert c.set_centroids(given) == ErrorCode.OK
    assert c.batch_insert([rec(i, 1 + i, 1) for i in range(10)]) == ErrorCode.OK
    assert np.array_equal(c.centroids, given) and [i for i, _ in c.search([9.0, 9.0], 1).items] == [9]
    assert c.retrain() == ErrorCode.OK and not np.array_equal(c.centroids, given)


@pytest.mark.parametrize("index", [IndexType.IVF, IndexType.HNSW])
def test_indexes_follow_writes_without_being_built_anew(spark, index, monkeypatch):
    from vecspark.operators import hnsw
    from vecspark.plans import collection

    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (200, 4))
    c = make(spark, index, dim=4, ivf_params=IVFParams(n_clusters=3, n_probe=3), hnsw_params=HNSWParams(m=4, ef_construction=20, ef_search=400))
    assert c.batch_insert([rec(i, *x[i]) for i in range(150)]) == ErrorCode.OK
    near = lambda q, ids: sorted(ids, key=lambda i: (np.linalg.norm(np.float32(x[i]) - np.float32(q)), i))[:5]
    assert [i for i, _ in c.search(x[3].tolist(), 5).items] == near(x[3], range(150))
    sizes = []
    if index == IndexType.HNSW:
        monkeypatch.setattr(hnsw, "build_shards", None)  # would fail
    else:
        monkeypatch.setattr(collection, "assign", lambda rows, *a, was=collection.assign: (sizes.append(rows.count()), was(rows, *a))[1])
    assert c.batch_insert([rec(i, *x[i]) for i in range(150, 200)]) == ErrorCode.OK
    assert [i for i, _ in c.search(x[170].tolist(), 5).items] == near(x[170], range(200))
    assert c.remove(170) == ErrorCode.OK and c.upsert([rec(3, *x[170])]) == ErrorCode.OK
    x[3] = x[170]
    left = [i for i in range(200) if i != 170]
    assert [i for i, _ in c.search(x[3].tolist(), 5).items] == near(x[3], left)
    assert c.compact() == ErrorCode.OK and [i for i, _ in c.search(x[3].tolist(), 5).items] == near(x[3], left)
    assert sizes in ([], [50, 1])


def test_saved_index_is_taken_over(spark, tmp_path, monkeypatch):
    from vecspark.operators import hnsw, ivf

    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, (60, 4))
    for index in (IndexType.IVF, IndexType.HNSW):
        kw = {"dim": 4, "data_path": f"file://{tmp_path}/{index.name}", "ivf_params": IVFParams(n_clusters=3, n_probe=3)}
        a, b = make(spark, index, **kw), make(spark, index, **kw)
        assert a.batch_insert([rec(i, *x[i]) for i in range(60)]) == ErrorCode.OK and a.save() == ErrorCode.OK
        with monkeypatch.context() as m:
            m.setattr(hnsw, "build_shards", None)
            m.setattr(ivf, "train", None)
            assert b.load() == ErrorCode.OK
            assert [i for i, _ in b.search(x[9].tolist(), 5).items] == [i for i, _ in a.search(x[9].tolist(), 5).items]
        if index == IndexType.IVF:
            assert np.array_equal(a.centroids, b.centroids)


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    from vecspark.sources.store import Files, StoreError

    kw = {"data_path": f"file://{tmp_path}/c"}
    c = make(spark, **kw)
    c.batch_insert([rec(1, 0, 0)])
    assert c.save() == ErrorCode.OK
    c.batch_insert([rec(2, 1, 1)])
    seen = c.records()
    other = make(spark, **kw)
    for step in ("write", "read"):  # before the manifest is there; after it, before old files go
        with monkeypatch.context() as m:
            m.setattr(Files, step, lambda *_: (_ for _ in ()).throw(StoreError("died")))
            assert c.save() == ErrorCode.IO_ERROR
            if step == "write":
                with pytest.raises(StoreError):
                    c.batch_insert([rec(3, 2, 2)])
        assert other.load() == ErrorCode.OK
        assert [r.id for r in other.all_records()] == ([1] if step == "write" else [1, 2]) or step == "read"
        assert c.size() == 2 == c.records().count() == seen.count()
    assert c.save() == ErrorCode.OK and other.load() == ErrorCode.OK and other.size() == 2
    files = Files(spark, f"file://{tmp_path}/c")
    with pytest.raises(StoreError):  # no file is replaced
        files.write(next(n for n in files.names() if n.startswith("manifest")), "{}")


def test_a_log_is_applied_in_one_step(spark):
    c, log = make(spark), WriteLog(spark)
    c.batch_insert([rec(1, 0, 0, m="a"), rec(2, 1, 1), rec(3, 2, 2)])
    log.log_insert(4, [4.0, 4.0])
    log.log_remove(2)
    log.log_insert(3, [9.0, 9.0])
    log.log_remove(77)
    version = c._manifest.version
    assert c.apply(log) == ErrorCode.OK and log.size() == 0 and c._manifest.version == version + 1
    assert {r.id: r.vector for r in c.all_records()} == {1: (0.0, 0.0), 3: (9.0, 9.0), 4: (4.0, 4.0)} and c.size() == 3
    log.log_insert(5, [1.0])
    assert c.apply(log) == ErrorCode.DIMENSION_MISMATCH and c.size() == 3


def test_readers_keep_their_version_beside_a_writer(spark):
    from concurrent.futures import ThreadPoolExecutor

    c = make(spark)
    c.batch_insert([rec(i, i, 0) for i in range(20)])

    def read(_):
        found = c.records()
        n = found.count()
        return n, found.select("id").distinct().count(), [i for i, _ in c.search([0.0, 0.0], 3).items]

    def write(k):
        return c.batch_insert([rec(100 + 10 * k + j, 100 + k, j) for j in range(10)])

    with ThreadPoolExecutor(6) as pool:
        reads, writes_ = [pool.submit(read, k) for k in range(8)], [pool.submit(write, k) for k in range(4)]
        assert all(w.result() == ErrorCode.OK for w in writes_)
        for r in reads:
            n, different, found = r.result()
            assert n == different and (n - 20) % 10 == 0 and found == [0, 1, 2]
    assert c.size() == 60 == c.records().count() and c.stats().total_queries == 8


def test_filter_can_be_ignored_by_lists(spark):
    c = make(spark, IndexType.IVF, ivf_params=IVFParams(n_clusters=1, n_probe=1))
    c.batch_insert([rec(i, i, 0) for i in range(5)])
    found = lambda **kw: [i for i, _ in c.search([0.0, 0.0], 2, SearchParams(n_probe=1, filter=F.col("id") > 2, **kw)).items]
    assert found() == [3, 4] and found(compat_ignore_filter=True) == [0, 1]


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from vecspark.sources.store import scratch

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        scratch(cluster)
    cluster.conf.get = lambda *_: "hdfs:///shared/"
    assert scratch(cluster) == "hdfs:///shared"


@pytest.mark.parametrize("index", list(IndexType))
def test_tour(spark, index):
    from vecspark.plans.tour import tour

    said = []
    assert tour(spark, index, said.append, n=60, dim=4).size() == 60 and len(said) > 14


def test_comparison_of_indexes(spark):
    from vecspark.plans.tour import compare

    got = {r["index"]: r for r in compare(spark, formats.uniform_vectors(spark, 900, 8).select("id", "vector").cache()).collect()}
    assert got["FLAT"].recall == got["FLAT"].rank_match == 1.0
    assert all(got[i].recall >= 0.9 and got[i].search_s > 0 for i in ("HNSW", "IVF"))


def test_late_events_are_left_out(spark, tmp_path):
    from vecspark.streaming.ingest import event_rates, event_sessions

    at = lambda h, m: f"timestamp'2024-01-01 {h:02}:{m:02}:00'"
    # 10:45 comes when 12:00 is over; a batch's late rows are those behind the watermark of the batch before it.
    batches = [[(10, 5), (10, 30)], [(14, 0)], [(14, 5)], [(10, 45), (13, 30)], [(18, 0)], [(23, 0)], [(23, 30)]]
    for k, rows in enumerate(batches):
        spark.sql(" UNION ALL ".join(f"SELECT {at(*t)} AS ts, 'a' AS event_type, 1.0D AS value, 7 AS user_id" for t in rows)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema = "ts timestamp, event_type string, value double, user_id int"
    for name, run in (("rates", lambda s: event_rates(s, "1 hour", "2 hours")), ("sessions", lambda s: event_sessions(s, "40 minutes", "2 hours"))):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        run(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-ck").trigger(availableNow=True).start().awaitTermination(180)
    rates = {r.window_start.hour: r.n for r in spark.read.parquet(f"{tmp_path}/rates").collect()}
    assert rates[10] == 2 and rates[13] == 1 and rates[14] == 2
    sessions = {r.session_start.hour: (r.session_start.minute, r.n) for r in spark.read.parquet(f"{tmp_path}/sessions").collect()}
    assert sessions[10] == (5, 2) and sessions[13] == (30, 3)
