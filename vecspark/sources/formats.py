"""A binary collection file, and generated vectors.

The file is little-endian: a 32-bit mark, a 32-bit version, counts of records and dimensions in 64
bits, then for each record its 64-bit id, its floats, a 32-bit length and as many bytes of metadata.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.model import RECORD_SCHEMA

# Fixed values of the format.
MARK = 0x4C594E58
VERSION = 1
_HEAD = struct.Struct("<IIQQ")


def parse(data: bytes) -> Iterator[tuple[int, list[float], str | None]]:
    mark, version, count, dim = _HEAD.unpack_from(data)
    if mark != MARK or version != VERSION:
        raise ValueError("not a collection file of a known version")
    at = _HEAD.size
    for _ in range(count):
        id_ = struct.unpack_from("<q", data, at)[0]
        vector = np.frombuffer(data, "<f4", dim, at + 8)
        at += 8 + 4 * dim
        n = struct.unpack_from("<I", data, at)[0]
        yield id_, vector.tolist(), data[at + 4 : at + 4 + n].decode() if n else None
        at += 4 + n


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Records of collection files; each file is read by one task, so large collections should be
    many files. The format can't tell empty metadata from none; both come back as NULL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = list(parse(bytes(content)))
                for s in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[s : s + 10_000], columns=["id", "vector", "metadata"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD_SCHEMA)


def to_binary(rows: list[tuple[int, list[float], str | None]], dim: int) -> bytes:
    out = [_HEAD.pack(MARK, VERSION, len(rows), dim)]
    for id_, vector, metadata in rows:
        meta = (metadata or "").encode()
        out.append(struct.pack("<q", id_) + np.asarray(vector, "<f4").tobytes() + struct.pack("<I", len(meta)) + meta)
    return b"".join(out)


def uniform_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """n records with uniform elements from a hash of id, place and seed: the same on any cluster."""
    unit = lambda i: F.shiftrightunsigned(F.xxhash64("id", i, F.lit(seed)), 11) / float(1 << 53)
    vector = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.lit(low) + unit(i) * (high - low)).cast("float"))
    return spark.range(n).select("id", vector.alias("vector"), F.lit(None).cast("string").alias("metadata"))
