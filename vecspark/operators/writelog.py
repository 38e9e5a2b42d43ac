"""An ordered log of inserts and removals beside a snapshot, replayed onto the next one."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from vecspark.operators.writes import replay

MAX_ENTRIES = 100_000
WARNING_ENTRIES = 50_000
LOG_SCHEMA = "seq long, op string, id long, vector array<float>"


class WriteLog:
    """Entries in order; bounded, so it may live on the driver."""

    def __init__(self, spark: SparkSession):
        self._spark, self._lock, self._rows = spark, threading.Lock(), []

    def _log(self, op: str, id_: int, vector: list[float] | None) -> bool:
        with self._lock:
            if len(self._rows) >= MAX_ENTRIES:
                return False
            self._rows.append((len(self._rows), op, id_, vector))
            return True

    def log_insert(self, id_: int, vector: list[float]) -> bool:
        return self._log("insert", id_, [float(x) for x in vector])

    def log_remove(self, id_: int) -> bool:
        return self._log("remove", id_, None)

    def frame(self) -> DataFrame:
        with self._lock:
            return self._spark.createDataFrame(list(self._rows), LOG_SCHEMA)

    def replay_to(self, current: DataFrame) -> DataFrame:
        return replay(current, self.frame())

    def clear(self) -> None:
        with self._lock:
            self._rows.clear()

    def size(self) -> int:
        return len(self._rows)

    def is_at_warning_threshold(self) -> bool:
        return len(self._rows) > WARNING_ENTRIES
