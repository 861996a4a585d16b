"""Structured Streaming forms that agree with the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store


def ingest(stream: DataFrame, store: Store, as_of: str, checkpoint: str) -> StreamingQuery:
    """Stores each micro-batch of rows(content, project, ...) as Store.add does; a batch that was stored before is told by its number."""

    def one(batch: DataFrame, number: int) -> None:
        key = f"stream:{checkpoint}"
        if int(store.setting(key) or -1) >= number:
            return
        if not batch.isEmpty():
            store.add(batch, as_of, setting=(key, str(number)))  # one commit: a crash leaves both or neither

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tool_counts(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start, tool_name, n of calls(tool_name, called_at), by tumbling windows with a watermark."""
    counts = calls.withWatermark("called_at", late).groupBy(F.window("called_at", width), "tool_name").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "tool_name", "n")


def useful_retrievals(log: DataFrame, reads: DataFrame, hours: int = 24) -> DataFrame:
    """memory_id, retrieved_at, read_at: reads within `hours` after a retrieval, as an interval join of two streams."""
    left = log.withWatermark("retrieved_at", f"{hours} hours").alias("l")
    right = reads.select(F.col("memory_id").alias("read_id"), "read_at").withWatermark("read_at", "1 hour").alias("r")
    near = (F.col("memory_id") == F.col("read_id")) & (F.col("read_at") >= F.col("retrieved_at")) & (F.col("read_at") <= F.col("retrieved_at") + F.expr(f"INTERVAL {hours} HOURS"))
    return left.join(right, near).select("memory_id", "retrieved_at", "read_at")


def new_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that a run hasn't seen yet: the checkpoint of its query is the last run."""
    return spark.readStream.schema(schema).parquet(path)
