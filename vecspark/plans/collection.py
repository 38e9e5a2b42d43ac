"""A collection of vectors: validated writes, search by the configured index, statistics, storage.

State is a version in a store; searches read the version that was current when they began, and one
writer at a time moves it on. Without a data path the versions live in the shared checkpoint folder.
Indexes are tables derived from a version, made on first use and brought up to date by what came and
went since: inverted lists are trained by the first batch into an empty collection, unless centroids
were given, and get a part for each write that a search has followed; graphs take rows in and out of
the shards that they fall into, and are built anew only where most rows have changed. Saving writes
the index beside the records, and loading takes it over.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import vecspark
from vecspark.model import RECORD_SCHEMA, Config, DatabaseStats, ErrorCode, IndexType, SearchParams, SearchResult, VectorRecord, id_to_long, long_to_id
from vecspark.operators import evaluate, hnsw, ivf, knn, writes
from vecspark.operators.kmeans import assign
from vecspark.operators.writelog import WriteLog
from vecspark.sources.store import Manifest, Store, StoreError, scratch


#: A stored part of inverted lists.
LISTS = "id long, vector array<float>, metadata string, cluster_id int"


@dataclass(frozen=True)
class _Index:
    """What is stored of an index: folders with the version at which each was up to date."""

    version: int
    parts: list[list]
    shards: int = 0


class Collection:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self._spark, self._config = spark, config or Config()
        if self._config.dimension <= 0:
            raise ValueError("dimension must be positive")
        self._lock = threading.RLock()
        self._queries, self._query_ms, self._inserts = 0, 0.0, 0
        self._store = Store(spark, f"{scratch(spark)}/collection-{uuid.uuid4().hex}")
        self._manifest = self._empty()
        self._centroids: np.ndarray | None = None
        self._given = False  # centroids were set, so they aren't trained
        self._index: _Index | None = None

    @classmethod
    def create(cls, spark: SparkSession, config: Config | None = None) -> Collection:
        return cls(spark, config)

    def _empty(self) -> Manifest:
        c = self._config
        return Manifest(0, c.dimension, int(c.distance_metric), int(c.index_type), 0)

    # Reading ---------------------------------------------------------------------------------------

    def records(self) -> DataFrame:
        """The current version (id, vector, metadata); later writes don't change it."""
        return self._store.records(self._manifest)

    def all_records(self) -> Iterator[VectorRecord]:
        for r in self.records().toLocalIterator():
            yield VectorRecord(long_to_id(r.id), tuple(r.vector), r.metadata)

    def get(self, id_: int) -> VectorRecord | None:
        r = self.records().where(F.col("id") == id_to_long(id_)).first()
        return r and VectorRecord(id_, tuple(r.vector), r.metadata)

    def contains(self, id_: int) -> bool:
        return self.records().where(F.col("id") == id_to_long(id_)).limit(1).count() > 0

    def contains_many(self, ids: DataFrame) -> DataFrame:
        """(id, found) for the given ids."""
        there = self.records().select("id", F.lit(True).alias("__f"))
        return ids.select("id").join(there, "id", "left").select("id", F.coalesce("__f", F.lit(False)).alias("found"))

    def size(self) -> int:
        return self._manifest.count

    @property
    def dimension(self) -> int:
        return self._config.dimension

    @property
    def config(self) -> Config:
        return self._config

    @staticmethod
    def version() -> str:
        return vecspark.__version__

    # Writing ---------------------------------------------------------------------------------------

    def _frame(self, records: Iterable[VectorRecord]) -> DataFrame:
        rows = [(i, id_to_long(r.id), [float(x) for x in r.vector], r.metadata) for i, r in enumerate(records)]
        return self._spark.createDataFrame(rows, "seq long, id long, vector array<float>, metadata string")

    def insert(self, record: VectorRecord) -> ErrorCode:
        return self.batch_insert([record])

    def batch_insert(self, records: Iterable[VectorRecord] | DataFrame) -> ErrorCode:
        """All or nothing. A DataFrame has (id, vector, metadata) and may have seq, the order."""
        batch = records if isinstance(records, DataFrame) else self._frame(records)
        if "seq" not in batch.columns:
            batch = batch.withColumn("seq", F.monotonically_increasing_id())
        with self._lock:
            code = writes.validate_batch(batch, self.records() if self._manifest.count else None, self._config.dimension)
            if code != ErrorCode.OK:
                return code
            n = batch.count()
            return self._add(batch.drop("seq"), n) if n else ErrorCode.OK

    def upsert(self, records: Iterable[VectorRecord] | DataFrame) -> ErrorCode:
        """Inserts, replacing records with the same ids; the last of each id in the batch counts."""
        batch = records if isinstance(records, DataFrame) else self._frame(records)
        if "seq" not in batch.columns:
            batch = batch.withColumn("seq", F.monotonically_increasing_id())
        if batch.where(F.size("vector") != self._config.dimension).limit(1).count():
            return ErrorCode.DIMENSION_MISMATCH
        new = writes.last_wins(batch)
        with self._lock:
            old = self.records().join(new.select("id"), "id", "left_semi").select("id")
            n_old, n = old.count(), new.count()
            return self._add(new, n, old if n_old else None, n_old) if n else ErrorCode.OK

    def _add(self, new: DataFrame, n: int, old: DataFrame | None = None, n_old: int = 0) -> ErrorCode:
        m = self._manifest
        new = new.select(*(F.col(f.name).cast(f.dataType) for f in RECORD_SCHEMA.fields))
        removals = [*m.removals, [m.version, self._store.write_folder(old, "del")]] if old is not None else m.removals
        folder = self._store.write_folder(new, "add")
        train = not m.count and self._config.index_type == IndexType.IVF and not self._given
        self._commit(Manifest(m.version + 1, m.dimension, m.metric, m.index, m.count + n - n_old, [*m.adds, [m.version + 1, folder]], removals, m.facts))
        self._inserts += n
        if train:
            self._train(n)
        return ErrorCode.OK

    def _train(self, n: int) -> None:
        p = self._config.ivf_params
        rows = self.records()
        # A single first vector is its own only centroid.
        self._centroids = np.array([rows.first().vector]) if n == 1 else ivf.train(rows, min(p.n_clusters, n), self._config.distance_metric, p.seed)
        self._index = None

    def retrain(self) -> ErrorCode:
        """Trains the clusters anew on all records."""
        if self._config.index_type != IndexType.IVF or not self._manifest.count:
            return ErrorCode.INVALID_STATE
        with self._lock:
            self._given = False
            self._train(self._manifest.count)
        return ErrorCode.OK

    def apply(self, log: WriteLog) -> ErrorCode:
        """Replays a log onto the current version and swaps in the result, all in one step; readers
        see all of it or nothing. The log is cleared once that is done."""
        with self._lock:
            rows = log.frame()
            if rows.where((F.col("op") == "insert") & (F.size("vector") != self._config.dimension)).limit(1).count():
                return ErrorCode.DIMENSION_MISMATCH
            last = writes.last_wins(rows)
            old = self.records().select("id").join(last.select("id"), "id", "left_semi")
            new = last.where("op = 'insert'").select("id", "vector", F.lit(None).cast("string").alias("metadata"))
            n_old, n = old.count(), new.count()
            if n or n_old:
                self._add(new, n, old if n_old else None, n_old)
            log.clear()
        return ErrorCode.OK

    def _commit(self, manifest: Manifest) -> None:
        self._store.commit(manifest)
        self._manifest = manifest

    def remove(self, id_: int) -> ErrorCode:
        ids = self._spark.createDataFrame([(id_to_long(id_),)], "id long")
        return ErrorCode.OK if self.remove_many(ids) else ErrorCode.VECTOR_NOT_FOUND

    def remove_many(self, ids: DataFrame) -> int:
        """Removes the records with these ids; how many there were."""
        with self._lock:
            there = self.records().select("id").join(ids.select("id").distinct(), "id", "left_semi")
            n = there.count()
            if n:
                m = self._manifest
                folder = self._store.write_folder(there, "del")
                self._commit(Manifest(m.version + 1, m.dimension, m.metric, m.index, m.count - n, m.adds, [*m.removals, [m.version, folder]], m.facts))
            return n

    def compact(self) -> ErrorCode:
        """Merges what was added and removed into one folder, and the index's parts likewise."""
        with self._lock:
            m = self._manifest
            folder = self._store.write_folder(self.records(), "add")
            index = self._index and self._up_to_date()
            if index and self._config.index_type == IndexType.IVF and len(index.parts) + len(m.removals) > 1:
                index = _Index(m.version, [[m.version, self._store.write_folder(self._lists(index, m), "lists", "cluster_id")]])
            self._commit(Manifest(m.version + 1, m.dimension, m.metric, m.index, m.count, [[m.version + 1, folder]], [], m.facts))
            self._index = index and _Index(m.version + 1, [[m.version + 1, f] for _, f in index.parts], index.shards)
        return ErrorCode.OK

    # Searching -------------------------------------------------------------------------------------

    def _lists(self, index: _Index, m: Manifest) -> DataFrame:
        return self._store.alive(self._store.union(index.parts, LISTS, "__v"), m.removals)

    def _up_to_date(self) -> _Index:
        """The index at the current version; only what changed since is worked into it."""
        with self._lock:
            m, metric, p = self._manifest, self._config.distance_metric, self._config.hnsw_params
            old = self._index
            if old is not None and old.version == m.version:
                return old
            if self._config.index_type == IndexType.IVF:
                added, _ = self._store.changes(m, old.version if old else -1)
                folder = self._store.write_folder(assign(added, self._centroids, metric), "lists", "cluster_id")
                self._index = _Index(m.version, [*(old.parts if old else []), [m.version, folder]])
                return self._index
            if old is not None:
                added, removed = self._store.changes(m, old.version)
                if 2 * (added.count() + removed.count()) <= m.count <= 2 * hnsw.SHARD_ROWS * old.shards:
                    shards = hnsw.update(self._store.table(old.parts[0][1]), added, removed, metric, p, old.shards)
                    self._index = _Index(m.version, [[m.version, self._store.write_folder(shards, "graph")]], old.shards)
                    return self._index
            folder = self._store.write_folder(hnsw.build_shards(self.records(), metric, p), "graph")
            self._index = _Index(m.version, [[m.version, folder]], max(1, -(-m.count // hnsw.SHARD_ROWS)))
            return self._index

    def _table(self) -> DataFrame:
        """The index's table: rows with their cluster, or packed shards."""
        with self._lock:
            index, m = self._up_to_date(), self._manifest
            return self._lists(index, m) if self._config.index_type == IndexType.IVF else self._store.table(index.parts[0][1])

    def optimize(self) -> ErrorCode:
        """Chooses over-full neighbour lists of the graph anew."""
        if self._config.index_type != IndexType.HNSW or not self._manifest.count:
            return ErrorCode.INVALID_STATE
        with self._lock:
            shards = self._table()
            nodes, edges = hnsw.node_table(shards, True), hnsw.edge_table(shards)
            new = hnsw.compact(nodes, hnsw.optimize(nodes, edges, self._config.distance_metric, self._config.hnsw_params.m))
            folder = self._store.write_folder(hnsw.pack(nodes, new), "graph")
            self._index = _Index(self._manifest.version, [[self._manifest.version, folder]], self._index.shards)
        return ErrorCode.OK

    def _params(self, params: SearchParams | None) -> SearchParams:
        c = self._config
        return params or SearchParams(ef_search=c.hnsw_params.ef_search, n_probe=c.ivf_params.n_probe)

    def search(self, query: list[float], k: int, params: SearchParams | None = None) -> SearchResult:
        """The k nearest. A query of another dimension finds nothing and isn't counted."""
        if len(query) != self._config.dimension:
            return SearchResult([])
        began = time.perf_counter()
        p, c, n = self._params(params), self._config, self._manifest.count
        if not n:
            rows = []
        elif c.index_type == IndexType.FLAT:
            rows = knn.knn(self.records(), query, k, c.distance_metric, p.filter).collect()
        elif c.index_type == IndexType.IVF:
            rows = ivf.search(self._table(), self._centroids, query, k, p.n_probe, c.distance_metric, None if p.compat_ignore_filter else p.filter).collect()
        else:
            one = self._spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, vector array<float>")
            rows = sorted(self.search_batch(one, k, params).collect(), key=lambda r: r.rank)
        ms = (time.perf_counter() - began) * 1000
        with self._lock:
            self._queries, self._query_ms = self._queries + 1, self._query_ms + ms
        return SearchResult([(long_to_id(r.id), r.distance) for r in rows], n, ms)

    def search_batch(self, queries: DataFrame, k: int, params: SearchParams | None = None) -> DataFrame:
        """(query_id, id, distance, rank) for queries (query_id, vector)."""
        p, c = self._params(params), self._config
        queries = queries.where(F.size("vector") == c.dimension)
        if not self._manifest.count or c.index_type == IndexType.FLAT:
            return knn.knn_batch(self.records(), queries, k, c.distance_metric, p.filter)
        if c.index_type == IndexType.IVF:
            return ivf.search_batch(self._table(), self._centroids, queries, k, p.n_probe, c.distance_metric, None if p.compat_ignore_filter else p.filter)
        return hnsw.search_shards(self._table(), queries, k, p.ef_search, c.distance_metric, p.filter, c.hnsw_params)

    # Statistics and storage ------------------------------------------------------------------------

    def stats(self) -> DatabaseStats:
        c, n = self._config, self._manifest.count
        if c.index_type == IndexType.FLAT:
            index = evaluate.flat_memory(n, c.dimension)
        elif c.index_type == IndexType.IVF:
            index = evaluate.clustered_memory(n, 0 if self._centroids is None else len(self._centroids), c.dimension)
        else:
            index = evaluate.graph_memory(n, c.dimension, hnsw.edge_table(self._table()).count() if n else 0)
        mean = self._query_ms / self._queries if self._queries else 0.0
        return DatabaseStats(n, c.dimension, n * (64 + 4 * c.dimension) + index, index, mean, self._queries, self._inserts)

    def flush(self) -> ErrorCode:
        if self._config.enable_wal:
            return ErrorCode.NOT_IMPLEMENTED
        return self.save() if self._config.data_path else ErrorCode.OK

    def save(self) -> ErrorCode:
        """Writes the collection to the data path, replacing what is there."""
        if not self._config.data_path:
            return ErrorCode.INVALID_PARAMETER
        try:
            with self._lock:
                target, m = Store(self._spark, self._config.data_path), self._manifest
                before = target.current()
                folder = target.write_folder(self.records(), "add")
                facts = {} if self._centroids is None else {"centroids": np.asarray(self._centroids, float).tolist(), "given": self._given}
                if m.count and self._config.index_type != IndexType.FLAT:
                    kind, by = ("lists", "cluster_id") if self._config.index_type == IndexType.IVF else ("graph", None)
                    facts |= {"part": target.write_folder(self._table(), kind, by), "shards": self._index.shards}
                target.commit(Manifest((before.version if before else 0) + 1, m.dimension, m.metric, m.index, m.count, [[0, folder]], [], facts))
                target.prune()
            return ErrorCode.OK
        except Exception as e:  # any failure of the file system is one kind of error to callers
            if isinstance(e, StoreError) or "Exception" in type(e).__name__ or "Py4J" in type(e).__name__:
                return ErrorCode.IO_ERROR
            raise

    def load(self) -> ErrorCode:
        """Replaces the contents by those at the data path, which are read before anything changes."""
        if not self._config.data_path:
            return ErrorCode.INVALID_PARAMETER
        source = Store(self._spark, self._config.data_path)
        try:
            m = source.current()
        except StoreError:
            return ErrorCode.IO_ERROR
        if m is None:
            return ErrorCode.IO_ERROR
        if m.dimension != self._config.dimension:
            return ErrorCode.DIMENSION_MISMATCH
        if m.metric != int(self._config.distance_metric):
            return ErrorCode.INVALID_PARAMETER
        with self._lock:
            folder, version = self._store.write_folder(source.records(m), "add"), self._manifest.version + 1
            part, index = m.facts.get("part") if m.index == int(self._config.index_type) else None, None
            if part:
                kind, by = ("lists", "cluster_id") if self._config.index_type == IndexType.IVF else ("graph", None)
                index = _Index(version, [[version, self._store.write_folder(source.table(part), kind, by)]], m.facts.get("shards", 0))
            self._commit(Manifest(version, m.dimension, m.metric, int(self._config.index_type), m.count, [[version, folder]]))
            self._centroids = np.array(m.facts["centroids"]) if m.facts.get("centroids") else None
            self._given = bool(m.facts.get("given"))
            if self._centroids is None and self._config.index_type == IndexType.IVF and m.count:
                self._train(m.count)
            self._index, self._inserts = index, m.count
        return ErrorCode.OK

    def set_centroids(self, centroids: np.ndarray) -> ErrorCode:
        """Replaces the clusters' centroids and drops all vectors; what comes next falls into these
        clusters, until :meth:`retrain`."""
        c = np.asarray(centroids, float)
        if not len(c):
            return ErrorCode.INVALID_PARAMETER
        if c.ndim != 2 or c.shape[1] != self._config.dimension:
            return ErrorCode.DIMENSION_MISMATCH
        with self._lock:
            self._commit(Manifest(self._manifest.version + 1, self._manifest.dimension, self._manifest.metric, self._manifest.index, 0))
            self._centroids, self._given, self._index = c, True, None
        return ErrorCode.OK

    @property
    def centroids(self) -> np.ndarray | None:
        return self._centroids
