"""What the operators share: table access, durable cuts of lineage, splits by crc32."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.sources.store import scratch

#: Words of the near-duplicate and language-model contracts: ASCII white space separates.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Rows are handed to Python in batches of so many bytes, so that long texts don't add up.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(_BATCH[0]) != _BATCH[1]:
        spark.conf.set(*_BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _written(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        where, files = _written(df.sparkSession, path)
        if where.getName().startswith("vecspark-"):
            files.delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and a lost
    executor costs a re-read, not a recomputation. The files go when the session ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/vecspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _written(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files that nothing refers to any more. It does so when the driver
    collects its garbage, which a driver with little to do hardly ever does by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; NULL for a NULL id."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n)).cast("int")


def held_out(column: str, n: int, remainder: int) -> Column:
    """True where the crc32 remainder marks the row as held out; a NULL id is never held out."""
    return F.coalesce(crc_mod(column, n) == remainder, F.lit(False))


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
