"""A codebook that follows a stream: each micro-batch assigns its points and moves the centres, with the same functions as in batch.

The state is a table in versions, one for each batch, so that a batch that is run again after a failure starts from the same state and writes the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillon.operators import codebook as C


def _version(folder: str, k: int) -> str:
    return f"{folder.rstrip('/')}/version={k}"


def start(codebook: DataFrame, folder: str) -> None:
    """Writes the state that the first batch starts from."""
    C.start_state(codebook).write.mode("overwrite").parquet(_version(folder, -1))


def state(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The state after a batch (-1: before the first)."""
    return spark.read.parquet(_version(folder, version))


def follow(points: DataFrame, folder: str, checkpoint: str, key: str, vector: str, gamma: float = 0.8, available_now: bool = True) -> StreamingQuery:
    """Starts the query over a streaming table of points."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = state(spark, folder, number - 1)
        sums = C.batch_sums(C.assign(batch, before, key, vector), key, vector)
        C.ema_step(before, sums, key, gamma, epoch=number).write.mode("overwrite").parquet(_version(folder, number))

    writer = points.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and kind, with a watermark; works on tables and on streams."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
