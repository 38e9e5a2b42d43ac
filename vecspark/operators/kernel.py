"""Distances of blocks of vectors in numpy, with exact double precision for what is returned."""

from __future__ import annotations

import numpy as np

from vecspark.functions.distance import TINY_NORM
from vecspark.model import DistanceMetric


def exact(a: np.ndarray, b: np.ndarray, metric: int) -> np.ndarray:
    """Distances of paired rows, in double."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if metric == DistanceMetric.L2:
        d = a - b
        return np.sqrt(np.einsum("...i,...i->...", d, d))
    dots = np.einsum("...i,...i->...", a, b)
    if metric == DistanceMetric.DOT_PRODUCT:
        return -dots
    na, nb = np.sqrt(np.einsum("...i,...i->...", a, a)), np.sqrt(np.einsum("...i,...i->...", b, b))
    small = (na < TINY_NORM) | (nb < TINY_NORM)
    return np.where(small, 1.0, 1 - np.clip(dots / np.where(small, 1.0, na * nb), -1, 1))


def table(q: np.ndarray, x: np.ndarray, metric: int) -> np.ndarray:
    """Distances of all rows of q to all rows of x, by one matrix product, in double. Squared for L2.

    Near neighbours lose digits to cancellation here, so what is returned is worked out anew.
    """
    q, x = np.asarray(q, float), np.asarray(x, float)
    dots = q @ x.T
    if metric == DistanceMetric.DOT_PRODUCT:
        return -dots
    qq, xx = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", x, x)
    if metric == DistanceMetric.L2:
        return np.maximum(qq[:, None] + xx[None, :] - 2 * dots, 0)
    nq, nx = np.sqrt(qq), np.sqrt(xx)
    small = (nq < TINY_NORM)[:, None] | (nx < TINY_NORM)[None, :]
    scale = np.where(small, 1.0, nq[:, None] * nx[None, :])
    return np.where(small, 1.0, 1 - np.clip(dots / scale, -1, 1))


class TopK:
    """The k nearest rows of each query over a stream of blocks; ties go to the smaller id."""

    #: Rows beyond k whose exact distances are looked at, in case rounding has put them there.
    SPARE = 8

    def __init__(self, queries: np.ndarray, k: int, metric: int):
        self.q, self.k, self.metric = np.asarray(queries, float), k, metric
        # Nearest first; NaN, which sorts last, where there are fewer.
        self.ids = np.empty((len(self.q), 0), np.int64)
        self.dist = np.empty((len(self.q), 0))
        self.count = np.zeros(len(self.q), np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray, only: np.ndarray | None = None) -> None:
        """Rows for all queries, or for those numbered in ``only``."""
        rows = np.arange(len(self.q)) if only is None else only
        if not len(rows) or not len(ids) or not self.k:
            return
        for s in range(0, len(ids), 1 << 15):  # bounded tables
            own, part_x = np.asarray(ids[s : s + (1 << 15)], np.int64), x[s : s + (1 << 15)]
            for t in range(0, len(rows), 512):
                self._merge(rows[t : t + 512], own, part_x)

    def _merge(self, part: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        rough = table(self.q[part], x, self.metric)
        n, width = len(ids), min(len(ids), self.k + self.SPARE)
        near = np.argpartition(rough, width - 1, axis=1)[:, :width] if width < n else np.broadcast_to(np.arange(n), rough.shape)
        if width < n:
            least = np.take_along_axis(rough, near, axis=1)
            kth = np.partition(least, self.k - 1, axis=1)[:, self.k - 1]
            # Where more rows than the spare ones are tied with the k-th within rounding, all count.
            close = np.nonzero(~(least.max(axis=1) > kth + 1e-9 * (1 + np.abs(rough).max())))[0]
            if len(close):
                self._place(part[close], np.broadcast_to(ids, (len(close), n)), exact(self.q[part[close]][:, None], x[None], self.metric))
                keep = np.setdiff1d(np.arange(len(part)), close)
                part, near = part[keep], near[keep]
        self._place(part, ids[near], exact(self.q[part][:, None], x[near], self.metric))

    def _place(self, part: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        have = self.dist.shape[1]
        ids, dist = np.concatenate([self.ids[part], ids], axis=1), np.concatenate([self.dist[part], dist], axis=1)
        order = np.lexsort((ids, dist), axis=1)[:, : self.k]
        if order.shape[1] > have:
            more = ((0, 0), (0, order.shape[1] - have))
            self.ids = np.pad(self.ids, more, constant_values=np.iinfo(np.int64).max)
            self.dist = np.pad(self.dist, more, constant_values=np.nan)
        self.ids[part], self.dist[part] = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
        self.count[part] = np.minimum(self.count[part] + (dist.shape[1] - have), self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and distances."""
        there = np.arange(self.dist.shape[1]) < self.count[:, None]
        who, place = np.nonzero(there)
        return who, self.ids[who, place], self.dist[who, place]
