"""Versioned storage of a collection in any Hadoop file system.

A version is a manifest that lists Parquet folders of added records and of removed ids, each with
the version that brought it. Writers add folders, then rename a finished manifest into its place,
which is the only step that shows: the current version is the manifest with the highest number that
is there. Nothing that a reader may need is deleted before, so a write that dies between any two
steps leaves the old version current. Readers of an older version keep a consistent view. Small
writes cost what they write; ``compact`` merges the folders.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.model import RECORD_SCHEMA


class StoreError(Exception):
    """The stored collection can't be read or written."""


@dataclass
class Manifest:
    version: int
    dimension: int
    metric: int
    index: int
    count: int
    adds: list[list] = field(default_factory=list)  # [version, folder]
    removals: list[list] = field(default_factory=list)
    facts: dict = field(default_factory=dict)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's settings. In local mode, where
    there is one machine, a temporary folder stands in for it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vecspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Files:
    """Small files through Hadoop, so that a path means the same to driver and executors."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self) -> list[str]:
        root = self.path("")
        return [x.getPath().getName() for x in self.fs.listStatus(root)] if self.fs.exists(root) else []

    def write(self, name: str, text: str) -> None:
        """A new file, whole or not at all: written beside, then renamed. Nothing is replaced."""
        beside = self.path(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.exists(name) or not self.fs.rename(beside, self.path(name)):
            self.fs.delete(beside, False)
            raise StoreError(f"could not write {name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _manifests(self) -> list[tuple[int, str]]:
        """(number, name), oldest first."""
        return sorted((int(m[1]), m[0]) for m in map(re.compile(r"manifest-(\d+)\.json").fullmatch, self.files.names()) if m)

    def current(self) -> Manifest | None:
        found = self._manifests()
        if not found:
            return None
        try:
            return Manifest(**json.loads(self.files.read(found[-1][1])))
        except (ValueError, TypeError) as e:
            raise StoreError(f"unreadable manifest: {e}") from e

    def commit(self, manifest: Manifest) -> None:
        """Makes the manifest current. Of two writers that take one number the second one fails."""
        found = self._manifests()
        number = found[-1][0] + 1 if found else 0
        self.files.write(f"manifest-{number:012d}.json", json.dumps(manifest.__dict__))

    def prune(self) -> None:
        """Deletes older manifests and the folders that only they name."""
        *old, last = self._manifests() or [None]
        if last is None:
            return
        needed = self.files.read(last[1])
        for _, name in old:
            self.files.delete(name)
        for name in self.files.names():
            if re.fullmatch(r"[a-z]+-[0-9a-f]{32}", name) and name not in needed:
                self.files.delete(name)

    def write_folder(self, df: DataFrame, kind: str, by: str | None = None) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        writer = df.write if by is None else df.write.partitionBy(by)
        writer.parquet(f"{self.root}/{name}")
        return name

    def _read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def union(self, folders: list[list], schema, column: str) -> DataFrame | None:
        """Rows of the folders [version, folder] with the version that brought them."""
        parts = [self._read(n, schema).withColumn(column, F.lit(v)) for v, n in folders]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def alive(self, rows: DataFrame, removals: list[list]) -> DataFrame:
        """Rows (id, __v, ...) that no removal of their version or a later one covers."""
        gone = self.union(removals, "id long", "__r")
        if gone is None:
            return rows.drop("__v")
        gone = gone.groupBy(F.col("id").alias("__id")).agg(F.max("__r").alias("__r"))
        return rows.join(gone, (F.col("id") == F.col("__id")) & (F.col("__r") >= F.col("__v")), "left_anti").drop("__v")

    def records(self, manifest: Manifest) -> DataFrame:
        """The collection at a version. A removal covers what was added before it."""
        rows = self.union(manifest.adds, RECORD_SCHEMA, "__v")
        return self.spark.createDataFrame([], RECORD_SCHEMA) if rows is None else self.alive(rows, manifest.removals)

    def changes(self, manifest: Manifest, since: int) -> tuple[DataFrame, DataFrame]:
        """What came after version ``since`` and is still there, and the ids (id) that went."""
        adds, removals = [x for x in manifest.adds if x[0] > since], [x for x in manifest.removals if x[0] >= since]
        rows, gone = self.union(adds, RECORD_SCHEMA, "__v"), self.union(removals, "id long", "__r")
        rows = self.spark.createDataFrame([], RECORD_SCHEMA) if rows is None else self.alive(rows, removals)
        return rows, self.spark.createDataFrame([], "id long") if gone is None else gone.select("id").distinct()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")
