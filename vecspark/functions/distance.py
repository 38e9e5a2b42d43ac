"""Distances between vector columns, as expressions that stay in the JVM.

Distances are computed in double. With a known dimension up to 64 the sum is written out element by
element, which generated code runs fast; beyond that the generated method would be too large to be
compiled, and higher-order functions do the same sum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecspark.model import DistanceMetric

UNROLLED = 64
#: Norms below this make a cosine distance 1.
TINY_NORM = 1e-10
MISMATCH = -1.0


def literal(values: list[float]) -> Column:
    """A query vector as an array of doubles that hold the values of floats."""
    import numpy as np

    return F.array(*(F.lit(float(np.float32(v))) for v in values)) if len(values) else F.array().cast("array<double>")


def _sum(a: Column, b: Column, term, dim: int | None) -> Column:
    if dim is not None and 0 < dim <= UNROLLED:
        terms = (term(F.get(a, F.lit(i)).cast("double"), F.get(b, F.lit(i)).cast("double")) for i in range(dim))
        return reduce(lambda x, y: x + y, terms)
    pairs = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def _guarded(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.lit(MISMATCH)).otherwise(value)


def l2_squared(a: Column, b: Column, dim: int | None = None) -> Column:
    return _guarded(a, b, _sum(a, b, lambda x, y: (x - y) * (x - y), dim))


def l2(a: Column, b: Column, dim: int | None = None) -> Column:
    return _guarded(a, b, F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y), dim)))


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    return _sum(a, b, lambda x, y: x * y, dim)


def neg_dot(a: Column, b: Column, dim: int | None = None) -> Column:
    return _guarded(a, b, -dot(a, b, dim))


def norm(a: Column, dim: int | None = None) -> Column:
    return F.sqrt(dot(a, a, dim))


def cosine(a: Column, b: Column, dim: int | None = None) -> Column:
    """1 - similarity; 1 if either vector is (nearly) zero."""
    na, nb = norm(a, dim), norm(b, dim)
    similarity = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b, dim) / (na * nb)))
    return _guarded(a, b, F.when((na < TINY_NORM) | (nb < TINY_NORM), F.lit(1.0)).otherwise(1 - similarity))


_BY_METRIC = {DistanceMetric.L2: l2, DistanceMetric.COSINE: cosine, DistanceMetric.DOT_PRODUCT: neg_dot}


def distance(a: Column, b: Column, metric: int, dim: int | None = None) -> Column:
    """The distance by metric; -1 for an unknown metric."""
    known = _BY_METRIC.get(metric)
    return known(a, b, dim) if known else F.lit(MISMATCH)


def distance_by(a: Column, b: Column, metric: Column, dim: int | None = None) -> Column:
    """The distance by a column of metric numbers."""
    out = F.lit(MISMATCH)
    for number, f in _BY_METRIC.items():
        out = F.when(metric == int(number), f(a, b, dim)).otherwise(out)
    return out


def normalize(a: Column, dim: int | None = None) -> Column:
    """The vector over its norm; a zero vector as it is."""
    doubles = a.cast("array<double>")
    n = norm(a, dim)
    # One-element array: the norm is worked out once, not once for each element.
    scaled = F.get(F.transform(F.array(n), lambda m: F.transform(doubles, lambda x: x / m)), F.lit(0))
    return F.when(n > 0, scaled).otherwise(doubles)


def dimension_code(a: Column, dim: int) -> Column:
    """0 if the vector has the dimension, else the number of the dimension error."""
    return F.when(F.size(a) == dim, F.lit(0)).otherwise(F.lit(1))
