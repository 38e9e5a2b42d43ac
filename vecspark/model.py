"""Enumerations, parameters and schemas of vector collections."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


class IndexType(IntEnum):
    FLAT = 0
    HNSW = 1
    IVF = 2


class DistanceMetric(IntEnum):
    L2 = 0
    COSINE = 1
    DOT_PRODUCT = 2


class ErrorCode(IntEnum):
    OK = 0
    DIMENSION_MISMATCH = 1
    VECTOR_NOT_FOUND = 2
    INDEX_NOT_BUILT = 3
    INVALID_PARAMETER = 4
    INVALID_STATE = 5
    OUT_OF_MEMORY = 6
    IO_ERROR = 7
    NOT_IMPLEMENTED = 8
    BUSY = 9


# Texts that callers compare with.
ERROR_STRINGS = {
    ErrorCode.OK: "Ok",
    ErrorCode.DIMENSION_MISMATCH: "Dimension mismatch",
    ErrorCode.VECTOR_NOT_FOUND: "Vector not found",
    ErrorCode.INDEX_NOT_BUILT: "Index not built",
    ErrorCode.INVALID_PARAMETER: "Invalid parameter",
    ErrorCode.INVALID_STATE: "Invalid state",
    ErrorCode.OUT_OF_MEMORY: "Out of memory",
    ErrorCode.IO_ERROR: "I/O error",
    ErrorCode.NOT_IMPLEMENTED: "Not implemented",
    ErrorCode.BUSY: "Busy (high load)",
}
INDEX_TYPE_STRINGS = {IndexType.FLAT: "Flat", IndexType.HNSW: "HNSW", IndexType.IVF: "IVF"}
DISTANCE_METRIC_STRINGS = {DistanceMetric.L2: "L2 (Euclidean)", DistanceMetric.COSINE: "Cosine", DistanceMetric.DOT_PRODUCT: "Dot Product"}


def error_string(code: int) -> str:
    return ERROR_STRINGS.get(code, "Unknown error")


def index_type_string(kind: int) -> str:
    return INDEX_TYPE_STRINGS.get(kind, "Unknown")


def distance_metric_string(metric: int) -> str:
    return DISTANCE_METRIC_STRINGS.get(metric, "Unknown")


def parse_index_type(text: str) -> IndexType | None:
    """The index type of that name in any case, or None."""
    return IndexType.__members__.get(text.upper())


RECORD_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType()), False),
        T.StructField("metadata", T.StringType(), True),
    ]
)


def id_to_long(value: int) -> int:
    """An unsigned 64-bit id as the long with the same bits."""
    if not 0 <= value < 1 << 64:
        raise ValueError(f"not an unsigned 64-bit id: {value}")
    return value - (1 << 64) if value >= 1 << 63 else value


def long_to_id(value: int) -> int:
    return value + (1 << 64) if value < 0 else value


@dataclass(frozen=True)
class VectorRecord:
    id: int
    vector: tuple[float, ...]
    metadata: str | None = None


@dataclass(frozen=True)
class SearchParams:
    """``filter`` is a condition on the column ``id``. Giving parameters replaces the configured
    ones as a whole."""

    ef_search: int = 50
    n_probe: int = 10
    filter: Column | None = None
    #: Inverted lists leave the filter out, as callers of engines without filters there may expect.
    compat_ignore_filter: bool = False


@dataclass(frozen=True)
class HNSWParams:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    max_elements: int = 1_000_000
    random_seed: int | None = None


@dataclass(frozen=True)
class IVFParams:
    n_clusters: int = 1024
    n_probe: int = 10
    use_pq: bool = False
    pq_subvectors: int = 8
    seed: int = 42


@dataclass(frozen=True)
class Config:
    dimension: int = 128
    distance_metric: DistanceMetric = DistanceMetric.L2
    index_type: IndexType = IndexType.HNSW
    hnsw_params: HNSWParams = field(default_factory=HNSWParams)
    ivf_params: IVFParams = field(default_factory=IVFParams)
    num_query_threads: int = 0
    num_index_threads: int = 2
    data_path: str = ""
    enable_wal: bool = False
    enable_mmap: bool = False


@dataclass(frozen=True)
class SearchResult:
    """``items`` are (id, distance), nearest first; total_candidates is the collection's size."""

    items: list[tuple[int, float]]
    total_candidates: int = 0
    query_time_ms: float = 0.0


@dataclass(frozen=True)
class DatabaseStats:
    vector_count: int = 0
    dimension: int = 0
    memory_usage_bytes: int = 0
    index_memory_bytes: int = 0
    avg_query_time_ms: float = 0.0
    total_queries: int = 0
    total_inserts: int = 0


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
