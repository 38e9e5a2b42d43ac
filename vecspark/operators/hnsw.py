"""Layered proximity graphs, one per shard of bounded size.

Vectors are dealt into shards by a hash of the id. A shard with its graph is one row of arrays
(``PACKED``), so stored shards are searched without a shuffle: queries are broadcast in blocks, each
task walks its shards for many queries in step, and only k rows per query and shard are shuffled.
More data means more shards, not larger graphs. Where there are fewer shards than tasks, the queries
of a block are dealt to copies of the shards.

:func:`build_shards` chooses neighbours among exact nearest ones, so a graph depends on its vectors
only, not on their order. :func:`update` takes rows into stored graphs and out of them: new rows look
for neighbours by a search of the graph, nodes that lose a neighbour take over some of its others.
The same graphs exist as tables ``nodes`` (shard, id, max_layer) and ``edges`` (shard, layer, src,
dst), for maintenance by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.model import DistanceMetric, HNSWParams
from vecspark.operators.kernel import TopK, exact, table
from vecspark.operators.knn import RESULT, query_blocks, top_k

SHARD_ROWS = 4_000
MAX_LAYER = 16
NODES = "shard int, id long, max_layer int"
EDGES = "shard int, layer int, src long, dst long"
#: Ids, layers, vectors and edges (layer, source, target, over row numbers) as little-endian arrays
#: of 64-bit integers, bytes, 32-bit floats and 32-bit integers.
PACKED = "shard int, dim int, ids binary, layers binary, vectors binary, edges binary"
#: Cells of a table of visited nodes; queries are walked in groups that keep to it.
VISITED = 1 << 23


def layer_of(id_col: Column, m: int, seed: int = 42) -> Column:
    """floor(-ln(u) / ln(m)), at most 16, with u from a hash of the id: the same on any cluster."""
    u = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11) + 1) / float(1 << 53)
    return F.least(F.lit(MAX_LAYER), F.floor(-F.ln(u) / F.ln(F.lit(float(max(m, 2)))))).cast("int")


def with_shards(vectors: DataFrame, n_rows: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    n = max(1, -(-n_rows // shard_rows))
    return vectors.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n)).cast("int"))


def select_heuristic(candidates: list[tuple[float, int]], m: int, between) -> list[int]:
    """Up to m of the candidates (distance, number), nearest first: one is taken if no taken one is
    nearer to it than the base is; free places go to the nearest of those left out."""
    taken: list[int] = []
    left: list[int] = []
    for d, c in sorted(candidates):
        if len(taken) == m:
            break
        (taken if all(between(c, t) >= d for t in taken) else left).append(c)
    return taken + left[: m - len(taken)]


def select_simple(candidates: list[tuple[float, int]], m: int) -> list[int]:
    return [c for _, c in sorted(candidates)[:m]]


#: Neighbours of each node: layer -> a set per row (None below the layer).
Links = list[list["set[int] | None"]]


def choose(base: np.ndarray, candidates: np.ndarray, far: np.ndarray, m: int, between) -> np.ndarray:
    """Which candidates (a row per base, nearest first, -1 for none) are taken: like
    :func:`select_heuristic`, for many bases in step. ``far`` holds the candidates' distances."""
    n, width = candidates.shape
    taken, kept, rows = np.zeros((n, width), bool), np.full((n, m), -1), np.arange(n)
    count = np.zeros(n, np.int64)
    for c in range(width):
        j = candidates[:, c]
        ok = (j >= 0) & (count < m)
        if not ok.any():
            continue
        most = int(count[ok].max())
        if most:
            at = np.nonzero(ok)[0]
            other = kept[at, :most]
            d = between(np.repeat(j[at], most), np.maximum(other, 0).ravel()).reshape(-1, most)
            ok[at] = ((d >= far[at, c][:, None]) | (other < 0)).all(axis=1)
        at = rows[ok]
        kept[at, count[at]] = j[at]
        taken[at, c] = True
        count[at] += 1
    left = (candidates >= 0) & ~taken
    return taken | (left & (np.cumsum(left, axis=1) <= (m - count)[:, None]))


def _nearest_first(rows: list[int], links: list[set[int]], far) -> tuple[np.ndarray, np.ndarray]:
    """The rows' links, padded, and their distances, nearest first."""
    width = max((len(links[i]) for i in rows), default=0)
    near, d = np.full((len(rows), width), -1), np.full((len(rows), width), np.inf)
    for k, i in enumerate(rows):
        own = np.fromiter(links[i], np.int64, len(links[i]))
        dist = far(np.full(len(own), i), own)
        order = np.lexsort((own, dist))
        near[k, : len(own)], d[k, : len(own)] = own[order], dist[order]
    return near, d


def _prune(links: list[set[int]], rows: list[int], most: int, between) -> None:
    """Rows with more links than a layer allows keep those that the heuristic chooses."""
    rows = [i for i in rows if len(links[i]) > most]
    if rows:
        near, d = _nearest_first(rows, links, between)
        for i, own, ok in zip(rows, near, choose(np.array(rows), near, d, most, between), strict=True):
            links[i] = set(own[ok].tolist())


def build_graph(x: np.ndarray, layers: np.ndarray, metric: int, p: HNSWParams) -> Links:
    out: Links = []
    for layer in range(int(layers.max(initial=0)) + 1):
        at = np.nonzero(layers >= layer)[0]
        sub, most = x[at], 2 * p.m if layer == 0 else p.m
        links: list[set[int]] = [set() for _ in at]
        if len(at) > 1:
            n_near = min(len(at) - 1, max(p.ef_construction, most))
            full = table(sub, sub, metric)  # a shard's size squared at most
            np.fill_diagonal(full, np.inf)
            between = lambda a, b, full=full: full[a, b]
            near = np.argpartition(full, n_near - 1, axis=1)[:, :n_near] if n_near < len(at) - 1 else np.argsort(full, axis=1)[:, :n_near]
            d = np.take_along_axis(full, near, axis=1)
            order = np.lexsort((near, d), axis=1)
            near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
            for i, j in zip(*np.nonzero(ok := choose(np.arange(len(at)), near, d, p.m, between)), strict=True):
                links[i].add(int(near[i, j]))
                links[near[i, j]].add(int(i))
            del ok
            _prune(links, list(range(len(at))), most, between)
            _connect(links, sub, metric)
        own: list[set[int] | None] = [None] * len(x)
        for i, near_ in zip(at.tolist(), links, strict=True):
            own[i] = {int(at[j]) for j in near_}
        out.append(own)
    return out


def _connect(links: list[set[int]], x: np.ndarray, metric: int) -> None:
    """Links every part that isn't reachable from row 0 to the nearest reachable row."""
    seen = np.zeros(len(links), bool)
    stack = [0]
    while True:
        while stack:
            i = stack.pop()
            if not seen[i]:
                seen[i] = True
                stack += [j for j in links[i] if not seen[j]]
        left = np.nonzero(~seen)[0]
        if not len(left):
            return
        reached = np.nonzero(seen)[0]
        best = (np.inf, 0, 0)
        for s in range(0, len(left), 512):  # bounded tables
            near = table(x[left[s : s + 512]], x[reached], metric)
            a, b = np.unravel_index(near.argmin(), near.shape)
            best = min(best, (float(near[a, b]), int(left[s + a]), int(reached[b])))
        _, a, b = best
        links[a].add(b)
        links[b].add(a)
        stack = [a]


def _edges(links: Links) -> np.ndarray:
    found = [(layer, i, j) for layer, own in enumerate(links) for i, near in enumerate(own) if near for j in sorted(near)]
    return np.array(found, np.int32).reshape(-1, 3)


class Graph:
    """One shard in memory."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, layers: np.ndarray, edges: np.ndarray, metric: int):
        self.ids, self.layers, self.edges, self.metric = np.asarray(ids, np.int64), np.asarray(layers), edges, metric
        n = len(self.ids)
        self.x = np.asarray(x, np.float32)
        # A row past the end stands for no neighbour.
        self.padded = np.concatenate([self.x, np.zeros((1, self.x.shape[1]), np.float32)])
        if metric == DistanceMetric.COSINE:
            norm = np.sqrt(np.einsum("ij,ij->i", self.padded, self.padded))
            self.scale = np.where(norm < 1e-10, 0, 1 / np.maximum(norm, 1e-10)).astype(np.float32)
        self.squares = np.einsum("ij,ij->i", self.padded, self.padded)
        self.links = []
        for layer in range(int(self.layers.max(initial=0)) + 1):
            own = edges[edges[:, 0] == layer]
            own = own[np.argsort(own[:, 1], kind="stable")]
            count = np.bincount(own[:, 1], minlength=n + 1)
            at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            links = np.full((n + 1, max(1, int(count.max(initial=0)))), n, np.int32)
            links[own[:, 1], at] = own[:, 2]
            self.links.append(links)
        # The entry: the highest node, the smallest id among these.
        self.entry = int(np.lexsort((self.ids, -self.layers))[0]) if n else None

    @classmethod
    def of(cls, r: dict, metric: int) -> Graph:
        ids = np.frombuffer(r["ids"], "<i8")
        return cls(ids, np.frombuffer(r["vectors"], "<f4").reshape(len(ids), r["dim"]), np.frombuffer(r["layers"], np.int8), np.frombuffer(r["edges"], "<i4").reshape(-1, 3), metric)

    def row(self, shard: int) -> dict:
        return {"shard": shard, "dim": self.x.shape[1], "ids": self.ids.astype("<i8").tobytes(), "layers": self.layers.astype(np.int8).tobytes(), "vectors": self.x.astype("<f4").tobytes(), "edges": np.ascontiguousarray(self.edges, "<i4").tobytes()}

    def link_sets(self) -> Links:
        out: Links = [[set() if top >= layer else None for top in self.layers] for layer in range(len(self.links))]
        for layer, a, b in self.edges.tolist():
            out[layer][a].add(b)
        return out

    def _far(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rough distances of each query (A, d) to its rows (A, W): what orders the walk."""
        dots = np.matmul(self.padded[rows], q[:, :, None])[:, :, 0]
        if self.metric == DistanceMetric.DOT_PRODUCT:
            d = -dots
        elif self.metric == DistanceMetric.COSINE:
            d = -dots * self.scale[rows]
        else:
            d = self.squares[rows] - 2 * dots
        d[rows == len(self.ids)] = np.inf
        return d

    def _walk(self, q: np.ndarray, start: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest found for each query from its starting row: rows and rough distances,
        nearest first. All queries take a step at a time: the nearest node that hasn't been looked
        at is, until the ef nearest have all been."""
        n, links, each = len(self.ids), self.links[layer], np.arange(len(q))
        rows, d = np.full((len(q), ef), n, np.int32), np.full((len(q), ef), np.inf, np.float32)
        done = np.zeros((len(q), ef), bool)
        seen = np.zeros((len(q), n + 1), bool)
        rows[:, 0], d[:, 0] = start, self._far(q, start[:, None])[:, 0]
        seen[each, start] = seen[:, n] = True
        live = each
        while len(live):
            at = ((~done[live]) & (rows[live] < n)).argmax(axis=1)
            more = ~done[live, at] & (rows[live, at] < n)
            live, at = live[more], at[more]
            if not len(live):
                break
            done[live, at] = True
            new = links[rows[live, at]]
            fresh = ~seen[live[:, None], new]
            new = np.where(fresh, new, n)
            seen[live[:, None], new] = True
            dn = self._far(q[live], new)
            useful = (dn < d[live, -1][:, None]).any(axis=1)
            who, dn, new = live[useful], dn[useful], new[useful]
            if len(who):
                all_d = np.concatenate([d[who], dn], axis=1)
                order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
                d[who] = np.take_along_axis(all_d, order, axis=1)
                rows[who] = np.take_along_axis(np.concatenate([rows[who], new], axis=1), order, axis=1)
                done[who] = np.take_along_axis(np.concatenate([done[who], np.zeros_like(new, bool)], axis=1), order, axis=1)
        return rows, d

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, rows and exact distances of the ef nearest that the walks find."""
        q = np.asarray(q, np.float32)
        if self.entry is None or not len(q):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        ef, out = min(ef, len(self.ids)), []
        size = max(1, VISITED // (len(self.ids) + 1))
        for s in range(0, len(q), size):
            part = q[s : s + size]
            out.append(self._walk(part, self._starts(part), ef, 0)[0])
        rows = np.concatenate(out)
        who, place = np.nonzero(rows < len(self.ids))
        found = rows[who, place].astype(np.int64)
        return who, found, exact(q[who], self.x[found], self.metric)

    def _starts(self, q: np.ndarray) -> np.ndarray:
        """Where each query's walk of layer 0 starts, down from the entry."""
        at = np.full(len(q), self.entry)
        for layer in range(int(self.layers[self.entry]), 0, -1):
            at = self._walk(q, at, 1, layer)[0][:, 0]
        return at

    def _reached(self, start: int, back: bool = False) -> np.ndarray:
        """Which nodes layer 0 leads to from a node, or which it leads from to it."""
        own = self.edges[self.edges[:, 0] == 0]
        a, b = (own[:, 2], own[:, 1]) if back else (own[:, 1], own[:, 2])
        seen = np.zeros(len(self.ids), bool)
        seen[start] = True
        while len(new := b[seen[a] & ~seen[b]]):
            seen[new] = True
        return seen

    def add_all(self, top: TopK, mine: np.ndarray) -> None:
        """Hands ``top`` what walks with a beam as wide as the graph find for its queries numbered in
        ``mine``. Such a beam turns no node away, so a walk finds what can be reached from where it
        starts, in whatever order, and that is gone through once and not for each query."""
        if self._reached(self.entry).all() and self._reached(self.entry, back=True).all():
            top.add(self.ids, self.x, mine)  # wherever it starts
            return
        size = max(1, VISITED // (len(self.ids) + 1))
        starts = np.concatenate([self._starts(np.asarray(top.q[mine[s : s + size]], np.float32)) for s in range(0, len(mine), size)])
        for start in np.unique(starts).tolist():
            there = self._reached(start)
            top.add(self.ids[there], self.x[there], mine[starts == start])

    # Rows that come and go ---------------------------------------------------------------------

    def _between(self, x: np.ndarray):
        return lambda a, b: exact(x[a], x[b], self.metric)

    def without(self, gone: set[int], p: HNSWParams) -> Graph:
        """Without the nodes with these ids. Who loses a neighbour may take over its others."""
        out = np.isin(self.ids, list(gone))
        if not out.any():
            return self
        number = np.where(out, -1, np.cumsum(~out) - 1)
        x, kept = self.x[~out], []
        for layer, own in enumerate(self.link_sets()):
            links: list[set[int] | None] = [None if near is None else set() for near in (own[i] for i in np.nonzero(~out)[0])]
            hurt = []
            for i in np.nonzero(~out)[0].tolist():
                if own[i] is None:
                    continue
                lost = [j for j in own[i] if out[j]]
                near = {j for j in own[i] if not out[j]} | {k for j in lost for k in own[j] if not out[k] and k != i}
                links[number[i]] = {int(number[j]) for j in near}
                if lost:
                    hurt.append(int(number[i]))
            for i in hurt:
                for j in links[i]:
                    links[j].add(i)
            members = [i for i, near in enumerate(links) if near is not None]
            _prune(links, members, 2 * p.m if layer == 0 else p.m, self._between(x))
            kept.append(links)
        return self._settled(self.ids[~out], x, self.layers[~out], kept)

    def _settled(self, ids: np.ndarray, x: np.ndarray, layers: np.ndarray, links: Links) -> Graph:
        """With every layer in one piece, and no layers without nodes."""
        links = links[: int(layers.max(initial=0)) + 1] if len(layers) else []
        for own in links:
            members = [i for i, near in enumerate(own) if near is not None]
            place = {i: k for k, i in enumerate(members)}
            local = [{place[j] for j in own[i]} for i in members]
            if len(members) > 1:
                _connect(local, x[members], self.metric)
            for i, near in zip(members, local, strict=True):
                own[i] = {members[j] for j in near}
        return Graph(ids, x, layers, _edges(links), self.metric)

    def with_rows(self, ids: np.ndarray, x: np.ndarray, layers: np.ndarray, p: HNSWParams, step: int = 256) -> Graph:
        """With new nodes, which find their neighbours by searching the graph, a few at a time."""
        graph = self
        for s in range(0, len(ids), step):
            graph = graph._with(ids[s : s + step], np.asarray(x[s : s + step], np.float32), layers[s : s + step], p)
        return graph

    def _with(self, ids: np.ndarray, x: np.ndarray, layers: np.ndarray, p: HNSWParams) -> Graph:
        n, ef = len(self.ids), max(p.ef_construction, 2 * p.m)
        if not n:
            return Graph(ids, x, layers, _edges(build_graph(x, layers, self.metric, p)), self.metric)
        all_x, all_layers = np.concatenate([self.x, x]), np.concatenate([self.layers, layers])
        links, between = self.link_sets(), self._between(all_x)
        while len(links) <= int(all_layers.max()):
            links.append([None] * n)
        top = int(self.layers[self.entry])
        at = np.full(len(x), self.entry)
        own = table(x, x, self.metric)
        if self.metric == DistanceMetric.L2:
            own = np.sqrt(own)
        np.fill_diagonal(own, np.inf)
        for layer in range(len(links) - 1, -1, -1):
            new = np.nonzero(layers >= layer)[0]
            links[layer] += [set() if y >= layer else None for y in layers]
            if layer <= top:
                rows, _ = self._walk(x, at, ef, layer) if len(new) or layer == 0 else self._walk(x, at, 1, layer)
                at = rows[:, 0]
            else:
                rows = np.full((len(x), 0), n, np.int32)
            if not len(new):
                continue
            rows = np.where(rows < n, rows, -1)[new]
            near = np.concatenate([rows, np.broadcast_to(n + new, (len(new), len(new)))], axis=1)
            d = np.full(near.shape, np.inf)
            a, b = np.nonzero(rows >= 0)
            d[a, b] = between(n + new[a], rows[a, b])
            d[:, rows.shape[1] :] = own[np.ix_(new, new)]
            near = np.where(np.isfinite(d), near, -1)
            order = np.lexsort((near, d), axis=1)[:, :ef]
            near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
            touched = set()
            for i, j in zip(*np.nonzero(choose(n + new, near, d, p.m, between)), strict=True):
                a, b = int(n + new[i]), int(near[i, j])
                links[layer][a].add(b)
                links[layer][b].add(a)
                touched |= {a, b}
            _prune(links[layer], sorted(touched), 2 * p.m if layer == 0 else p.m, between)
        return self._settled(np.concatenate([self.ids, ids]), all_x, all_layers, links)


# Shards as rows ------------------------------------------------------------------------------------


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "dim": pa.int32()} | dict.fromkeys(("ids", "layers", "vectors", "edges"), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], names=list(kinds))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _leveled(vectors: DataFrame, p: HNSWParams) -> DataFrame:
    return vectors.select("shard", "id", "vector", layer_of(F.col("id"), p.m, p.random_seed or 42).alias("max_layer"))


def _sorted(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("id")
    return pdf["id"].to_numpy(), np.array(pdf["vector"].tolist(), np.float32), pdf["max_layer"].to_numpy()


def build_shards(vectors: DataFrame, metric: int, params: HNSWParams | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The vectors (id, vector) as packed shards."""
    p = params or HNSWParams()
    rows = _leveled(with_shards(vectors.select("id", "vector"), vectors.count(), shard_rows), p)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, layers = _sorted(pdf)
        graph = Graph(ids, x, layers, _edges(build_graph(x, layers, metric, p)), metric)
        return pd.DataFrame([graph.row(int(pdf["shard"].iloc[0]))])

    return rows.groupBy("shard").applyInPandas(run, PACKED)


def update(shards: DataFrame, added: DataFrame, removed: DataFrame, metric: int, params: HNSWParams | None = None, n_shards: int | None = None) -> DataFrame:
    """Packed shards without the removed (id) and with the added rows (id, vector). Shards that
    neither touches are passed on as they are."""
    p = params or HNSWParams()
    n = n_shards or max(1, shards.count())
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n)).cast("int")
    rows = _leveled(added.select("id", "vector").withColumn("shard", place), p).withColumn("new", F.lit(True))
    gone = removed.select(place.alias("shard"), "id").distinct()
    kind = rows.schema["vector"].dataType.simpleString()
    rows = rows.unionByName(gone.select("shard", "id", F.lit(None).cast(kind).alias("vector"), F.lit(0).alias("max_layer"), F.lit(False).alias("new")))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return left
        new = right[right["new"]]
        ids, x, layers = _sorted(new) if len(new) else (np.empty(0, np.int64), np.empty((0, 1), np.float32), np.empty(0, int))
        graph = Graph.of(left.iloc[0], metric) if len(left) else Graph(ids[:0], x[:0], layers[:0], np.empty((0, 3), np.int32), metric)
        graph = graph.without(set(right.loc[~right["new"], "id"]) | set(ids.tolist()), p)
        graph = graph.with_rows(ids, x, layers, p)
        return pd.DataFrame([graph.row(int(key[0]))])

    return shards.groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(run, PACKED)


def pack(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Packed shards of the tables (shard, id, vector, max_layer) and edges."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=["shard", "dim", "ids", "layers", "vectors", "edges"])
        ids, x, layers = _sorted(left)
        right = right[right["src"].isin(ids) & right["dst"].isin(ids)]
        found = np.stack([right["layer"].to_numpy(), np.searchsorted(ids, right["src"]), np.searchsorted(ids, right["dst"])], axis=1).astype(np.int32) if len(right) else np.empty((0, 3), np.int32)
        found = found[found[:, 0] <= layers.max(initial=0)]
        return pd.DataFrame([Graph(ids, x, layers, found, 0).row(int(left["shard"].iloc[0]))])

    return rows.groupBy("shard").cogroup(edges.groupBy("shard")).applyInPandas(run, PACKED)


def edge_table(shards: DataFrame) -> DataFrame:
    """Edges (shard, layer, src, dst) of packed shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _rows(b):
                ids, e = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["edges"], "<i4").reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), r["shard"], np.int32)), pa.array(e[:, 0]), pa.array(ids[e[:, 1]]), pa.array(ids[e[:, 2]])], names=["shard", "layer", "src", "dst"])

    return shards.mapInArrow(run, EDGES)


def node_table(shards: DataFrame, with_vectors: bool = False) -> DataFrame:
    """Nodes (shard, id, max_layer) of packed shards, on demand with their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _rows(b):
                ids = np.frombuffer(r["ids"], "<i8")
                columns = [pa.array(np.full(len(ids), r["shard"], np.int32)), pa.array(ids), pa.array(np.frombuffer(r["layers"], np.int8).astype(np.int32))]
                if with_vectors:
                    ends = pa.array(np.arange(0, r["dim"] * len(ids) + 1, max(1, r["dim"]), dtype=np.int32)[: len(ids) + 1])
                    columns.insert(2, pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(r["vectors"], "<f4"))))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "id", *(["vector"] if with_vectors else []), "max_layer"])

    return shards.mapInArrow(run, "shard int, id long, vector array<float>, max_layer int" if with_vectors else NODES)


def max_layer(shards: DataFrame) -> int:
    """The highest layer of any node; -1 without nodes."""
    found = node_table(shards).agg(F.max("max_layer")).first()[0]
    return -1 if found is None else found


def build(vectors: DataFrame, metric: int, params: HNSWParams | None = None, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors with shard and max_layer, edges, nodes) as tables."""
    p = params or HNSWParams()
    rows = _leveled(with_shards(vectors.select("id", "vector"), vectors.count(), shard_rows), p)
    return rows.select("id", "vector", "shard", "max_layer"), edge_table(build_shards(vectors, metric, p, shard_rows)), rows.select("shard", "id", "max_layer")


def search_shards(shards: DataFrame, queries: DataFrame, k: int, ef_search: int, metric: int, predicate: Column | None = None, params: HNSWParams | None = None) -> DataFrame:
    """(query_id, id, distance, rank); the predicate holds for what the walks found, so fewer than
    k can come back. An ef_search of 0 stands for the index's own. Without a predicate a shard hands
    on k rows per query, and all shards of a task together those whose beam is as wide as they are."""
    spark, ef = shards.sparkSession, max(ef_search or (params or HNSWParams()).ef_search, k)
    n, tasks, found, plain = max(1, shards.count()), spark.sparkContext.defaultParallelism, [], predicate is None
    for ids, q in query_blocks(queries):
        block = spark.sparkContext.broadcast((ids, q))
        parts = max(1, min(tasks // n, len(ids) // 64))

        def run(batches: Iterator[pa.RecordBatch], block=block, parts=parts) -> Iterator[pa.RecordBatch]:
            ids, q = block.value
            names, top = ["query_id", "id", "distance"], TopK(q, k, metric)
            for b in batches:
                for r in _rows(b):
                    graph, mine = Graph.of(r, metric), np.arange(r["part"], len(q), parts)
                    if not len(graph.ids) or q.shape[1] != graph.x.shape[1]:
                        continue
                    if plain and ef >= len(graph.ids):
                        graph.add_all(top, mine)
                        continue
                    who, rows, d = graph.search(q[mine], ef)
                    near = graph.ids[rows]
                    if plain:
                        order = np.lexsort((near, d, who))
                        who, near, d = who[order], near[order], d[order]
                        first = np.arange(len(who)) - np.searchsorted(who, who) < k
                        who, near, d = who[first], near[first], d[first]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[mine][who]), pa.array(near), pa.array(d)], names=names)
            who, near, d = top.rows()
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(near, pa.int64()), pa.array(d, pa.float64())], names=names)

        rows = shards.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        found.append((rows.repartition(parts * n, "shard", "part") if parts > 1 else rows).mapInArrow(run, RESULT))
    if not found or k <= 0:
        return spark.createDataFrame([], RESULT + ", rank long")
    walks = reduce(DataFrame.unionByName, found)
    if plain:
        return top_k(walks, k)
    return top_k(top_k(walks, ef).drop("rank").where(predicate), k)


def search_batch(rows: DataFrame, edges: DataFrame, queries: DataFrame, k: int, ef_search: int, metric: int, predicate: Column | None = None, params: HNSWParams | None = None) -> DataFrame:
    """:func:`search_shards` on a graph that is held as tables."""
    return search_shards(pack(rows, edges), queries, k, ef_search, metric, predicate, params)


# Maintenance, on the tables ------------------------------------------------------------------------


def symmetric(edges: DataFrame) -> DataFrame:
    """All edges in both directions, once."""
    back = edges.select(*(F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns))
    return edges.union(back).distinct()


def neighbours(edges: DataFrame, id_: int, layer: int = 0) -> DataFrame:
    return edges.where((F.col("src") == id_) & (F.col("layer") == layer)).select("dst")


def over_full(edges: DataFrame, m: int) -> DataFrame:
    """(layer, src, n) of nodes with more edges than a layer allows: 2m below, else m."""
    n = edges.groupBy("layer", "src").agg(F.count("*").alias("n"))
    return n.where(F.col("n") > F.when(F.col("layer") == 0, 2 * m).otherwise(m))


def remove(rows: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes and all edges at either end."""
    gone = ids.select(F.col("id").alias("gone")).distinct()
    out = edges.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti"), out


def compact(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends exist and reach the layer."""
    node = rows.select(F.col("id").alias("node"), "max_layer")
    for end in ("src", "dst"):
        edges = edges.join(node, (F.col(end) == F.col("node")) & (F.col("layer") <= F.col("max_layer")), "left_semi")
    return edges


def entry_point(rows: DataFrame) -> DataFrame:
    """(id, layer): the highest node, the smallest id among these."""
    best = rows.agg(F.max(F.struct(F.col("max_layer").alias("layer"), (-F.col("id")).alias("back"))).alias("e"))
    return best.where("e IS NOT NULL").select((-F.col("e.back")).alias("id"), F.col("e.layer").alias("layer"))


def optimize(rows: DataFrame, edges: DataFrame, metric: int, m: int) -> DataFrame:
    """Over-full lists are chosen anew by the heuristic; others stay. Under ten nodes nothing changes."""
    if rows.limit(10).count() < 10:
        return edges

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("id")
        x, number = np.array(left["vector"].tolist(), float), {int(i): n for n, i in enumerate(left["id"])}
        out = []
        for (layer, src), part in right.groupby(["layer", "src"]):
            most, dst = (2 * m if layer == 0 else m), [int(d) for d in part["dst"] if int(d) in number]
            if len(dst) > most and int(src) in number:
                at = number[int(src)]
                d = lambda a, b: float(exact(x[a], x[b], metric))
                dst = [int(left["id"].iloc[c]) for c in select_heuristic([(d(at, number[t]), number[t]) for t in dst], most, d)]
            out += [(int(part["shard"].iloc[0]), int(layer), int(src), t) for t in dst]
        return pd.DataFrame(out, columns=["shard", "layer", "src", "dst"])

    return rows.groupBy("shard").cogroup(edges.groupBy("shard")).applyInPandas(run, EDGES)
