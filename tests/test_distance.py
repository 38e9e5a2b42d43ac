import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecspark.functions import distance as d
from vecspark.model import DistanceMetric
from vecspark.operators import kernel

L2, COSINE, DOT = DistanceMetric.L2, DistanceMetric.COSINE, DistanceMetric.DOT_PRODUCT
R3 = 1 / math.sqrt(3)

CASES = [
    (d.l2, [0, 0, 0], [3, 4, 0], 5.0),
    (d.l2_squared, [0, 0, 0], [3, 4, 0], 25.0),
    (d.l2, [1.0] * 128, [2.0] * 128, math.sqrt(128)),
    (d.l2, [], [], 0.0),
    (d.l2, [1, 2, 3], [1, 2], -1.0),
    (d.l2_squared, [1, 2, 3], [1, 2], -1.0),
    (d.cosine, [1, 2, 3], [1, 2], -1.0),
    (d.neg_dot, [1, 2, 3], [1, 2], -1.0),
    (d.cosine, [1, 2, 3], [1, 2, 3], 0.0),
    (d.cosine, [1, 0], [0, 1], 1.0),
    (d.cosine, [1, 0], [-1, 0], 2.0),
    (d.cosine, [1, 2], [10, 20], 0.0),
    (d.cosine, [0, 0], [1, 2], 1.0),
    (d.cosine, [0, 0], [0, 0], 1.0),
    (d.cosine, [R3, R3, R3], [1, 0, 0], 1 - R3),
    (d.neg_dot, [1, 2, 3], [1, 2, 3], -14.0),
    (d.neg_dot, [1, 2, 3], [4, 5, 6], -32.0),
    (d.neg_dot, [1, -2, 3], [-1, 2, -3], 14.0),
    (d.neg_dot, [1.0] * 128, [2.0] * 128, -256.0),
    (d.l2, [-1, 2, -3, 4], [1, -2, 3, -4], math.sqrt(120)),
    (d.neg_dot, [-1, 2, -3, 4], [1, -2, 3, -4], 30.0),
]


def test_literals_with_and_without_known_dimension(spark):
    rows = spark.createDataFrame([(i, [float(x) for x in a], [float(x) for x in b]) for i, (_, a, b, _) in enumerate(CASES)], "n int, a array<float>, b array<float>")
    for i, (f, a, b, want) in enumerate(CASES):
        dims = [None, len(a)] if len(a) == len(b) else [None]
        for dim in dims:
            got = rows.where(F.col("n") == i).select(f(F.col("a"), F.col("b"), dim)).first()[0]
            assert got == pytest.approx(want, abs=1e-6), (f.__name__, a, b, dim)


def test_dispatch_and_normalize(spark):
    rows = spark.createDataFrame([(m, [3.0, 4.0], [1.0, 0.0]) for m in (0, 1, 2, 9)], "m int, a array<float>, b array<float>")
    got = [r[0] for r in rows.select(d.distance_by(F.col("a"), F.col("b"), F.col("m"))).collect()]
    assert got == pytest.approx([math.sqrt(20), 0.4, -3.0, -1.0])
    assert [rows.select(d.distance(F.col("a"), F.col("b"), m)).first()[0] for m in (0, 1, 2, 9)] == pytest.approx(got)
    assert rows.select(d.normalize(F.col("a"))).first()[0] == pytest.approx([0.6, 0.8])
    assert rows.select(d.normalize(F.lit([0.0, 0.0]))).first()[0] == [0.0, 0.0]
    assert rows.select(d.dimension_code(F.col("a"), 2), d.dimension_code(F.col("a"), 3)).first()[:] == (0, 1)


floats = st.lists(st.floats(-100, 100, width=32), min_size=3, max_size=3)


@settings(max_examples=60, deadline=None)
@given(a=floats, b=floats)
def test_kernel_table_agrees_with_exact(a, b):
    import numpy as np

    for metric in DistanceMetric:
        exact = float(kernel.exact(np.array(a), np.array(b), metric))
        rough = float(kernel.table(np.array([a]), np.array([b]), metric)[0, 0])
        assert (math.sqrt(rough) if metric == L2 else rough) == pytest.approx(exact, abs=1e-3)
