"""Streams of vectors: ingestion by micro-batch, searches of a stream, log replay, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecspark.operators.knn import knn_batch
from vecspark.plans.collection import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str) -> StreamingQuery:
    """Upserts a stream (id, vector, metadata) batch by batch; a batch that is run again after a
    failure writes the same records again."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            code = collection.upsert(batch)
            if code:
                raise ValueError(f"batch refused: {code.name}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search_stream(queries: DataFrame, vectors: DataFrame, k: int, metric: int, path: str, checkpoint: str) -> StreamingQuery:
    """Answers a stream of queries (query_id, vector) into Parquet, one folder per batch."""

    def write(batch: DataFrame, number: int) -> None:
        knn_batch(vectors, batch, k, metric).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window, tumbling or sliding; works on
    streams and tables. In a stream, events that come more than ``late`` behind are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", key: str = "user_id") -> DataFrame:
    """Sessions of events (ts, value) per key: a session ends where none follows within the gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n", "total")
