"""The distances as SQL functions, and collections as views, for callers who write SQL.

The functions are SQL expressions, so the optimiser sees through them; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecspark.functions.distance import TINY_NORM

_DOT = "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)"
_SQUARES = "aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, x) -> s + x)"
_NORM = "sqrt(aggregate(transform({0}, x -> double(x) * double(x)), 0D, (s, x) -> s + x))"
_COSINE = f"""CASE WHEN {_NORM.format("a")} < {TINY_NORM!r}D OR {_NORM.format("b")} < {TINY_NORM!r}D THEN 1D
    ELSE 1 - greatest(-1D, least(1D, {_DOT} / ({_NORM.format("a")} * {_NORM.format("b")}))) END"""

#: Name -> body over vectors a and b; -1 stands for vectors of different lengths.
FUNCTIONS = {"vec_l2_squared": _SQUARES, "vec_l2": f"sqrt({_SQUARES})", "vec_cosine": _COSINE, "vec_neg_dot": f"-({_DOT})"}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session: ``SELECT vec_l2(a.vector, b.vector) ...``."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN CASE WHEN size(a) <> size(b) THEN -1D ELSE {body} END")


def as_view(records: DataFrame, name: str) -> DataFrame:
    """The records under a name that SQL can use; they stay those of the version they were read at."""
    records.createOrReplaceTempView(name)
    return records
