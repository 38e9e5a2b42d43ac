"""Checks and set operations behind inserts, removals and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions.distance import dimension_code
from vecspark.model import ErrorCode


def violations(batch: DataFrame, current: DataFrame | None, dim: int) -> DataFrame:
    """(seq, id, code) of records (seq, id, vector) that can't be inserted, with the first check
    each fails: dimension, then an id that an earlier record of the batch has, then an existing id."""
    earlier = F.row_number().over(Window.partitionBy("id").orderBy("seq")) > 1
    rows = batch.select("seq", "id", dimension_code(F.col("vector"), dim).alias("d"), earlier.alias("again"))
    if current is None:
        rows = rows.withColumn("known", F.lit(False))
    else:
        there = current.select(F.col("id").alias("there")).distinct()
        rows = rows.join(there, F.col("id") == F.col("there"), "left").withColumn("known", F.col("there").isNotNull())
    # Existing ids are looked for only after the whole batch has passed the other checks.
    code = F.when(F.col("d") > 0, F.lit(int(ErrorCode.DIMENSION_MISMATCH))).when(F.col("again") | F.col("known"), F.lit(int(ErrorCode.INVALID_PARAMETER)))
    stage = F.when((F.col("d") > 0) | F.col("again"), F.lit(0)).otherwise(F.lit(1))
    return rows.withColumn("code", code).where("code IS NOT NULL").select("seq", "id", "code", stage.alias("stage"))


def validate_batch(batch: DataFrame, current: DataFrame | None, dim: int) -> ErrorCode:
    """The code of the first failing record, or OK; one job."""
    first = violations(batch, current, dim).agg(F.min(F.struct("stage", "seq", "code")).alias("v")).first().v
    return ErrorCode.OK if first is None else ErrorCode(first.code)


def remove_ids(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.join(ids.select("id").distinct(), "id", "left_anti")


def upsert(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's records, the last of each id, in place of or beside the current ones."""
    return remove_ids(current, batch).unionByName(last_wins(batch))


def last_wins(batch: DataFrame) -> DataFrame:
    """Of records (seq, ...) with one id the last; without seq."""
    order = Window.partitionBy("id").orderBy(F.col("seq").desc())
    return batch.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "seq")


def replay(current: DataFrame, log: DataFrame) -> DataFrame:
    """Current records (id, vector, ...) after the log (seq, op, id, vector): an insert replaces, a
    removal of a missing id is ignored. Only the last entry of each id matters."""
    order = Window.partitionBy("id").orderBy(F.col("seq").desc())
    last = log.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    rest = current.join(last.select("id"), "id", "left_anti")
    new = last.where(F.col("op") == "insert").select(*(F.col(c) if c in log.columns else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in current.columns))
    return rest.unionByName(new)
