"""Windowed counts over streams, and scoring of each micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenads.operators.anomaly import score_band
from lumenads.streaming.ingest import Batches

WINDOW = "5 minutes"
LATENESS = "10 minutes"
# Where the last windows of a stream go, beside its batches.
FLUSH = "stream=flush/run=end/batch=0"


def tumbling_sum(
    stream: DataFrame,
    time: str,
    amount: Column,
    name: str = "total",
    width: str = WINDOW,
    lateness: str = LATENESS,
) -> DataFrame:
    """Sum per tumbling window. Rows within ``lateness`` merge into their
    window, later ones are dropped; a closed window is emitted once."""
    return (
        stream.withWatermark(time, lateness)
        .groupBy(F.window(time, width).alias("_w"))
        .agg(F.sum(amount).alias(name))
        .select(F.col("_w.start").alias("window_start"), name)
    )


def drain_to_parquet(df: DataFrame, path: str, checkpoint: str, stream: str = "windows") -> StreamingQuery:
    """Process what is available, append closed windows, stop."""
    batches = Batches(stream)
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, batch_id: batches.append(batch, path, batch_id))
    return batches.start(writer.trigger(availableNow=True))


def drained(spark: SparkSession, path: str, schema) -> DataFrame:
    """Windows of all batches and of the flush."""
    names = schema.fieldNames()
    return spark.read.schema(schema).parquet(path).select(*names)


def flush_open_windows(
    rows: DataFrame, path: str, time: str, amount: Column, name: str = "total", width: str = WINDOW, lateness: str = LATENESS
) -> None:
    """End of a drained stream: append the windows its watermark has not passed.

    ``rows`` are the stream's source rows as a batch. No row of such a window was
    late, so all of them count; windows already closed, and what came too late for
    them, stay as they are. Running it twice appends once.
    """
    end = rows.agg(F.date_trunc("millisecond", F.max(time)).alias("_last"))
    windows = (
        rows.groupBy(F.window(time, width).alias("_w"))
        .agg(F.sum(amount).alias(name))
        .crossJoin(F.broadcast(end))
        .where(F.col("_w.end") > F.col("_last") - F.expr(f"INTERVAL {lateness}"))
        .select(F.col("_w.start").alias("window_start"), name)
    )
    spark, end_folder = rows.sparkSession, f"{path.rstrip('/')}/{FLUSH}"
    emitted = drained(spark, path, windows.schema).select("window_start")
    windows.join(emitted, "window_start", "left_anti").write.mode("append").parquet(end_folder)


def score_stream(
    windows: DataFrame,
    load_model,
    time: str,
    value: str,
    sink: str,
    checkpoint: str,
    slot_seconds: int = 300,
    available_now: bool = True,
    stream: str = "windows",
) -> StreamingQuery:
    """Score closed windows of each micro-batch and append JSON lines.

    ``load_model`` is called per batch, so a refitted model takes effect with
    the next batch and no restart.
    """
    batches = Batches(stream)

    def score(batch: DataFrame, batch_id: int) -> None:
        scored = score_band(batch, load_model(), time, value, slot_seconds)
        folders = "/".join(f"{k}={v}" for k, v in batches.folders(batch_id).items())
        scored.write.mode("overwrite").json(f"{sink.rstrip('/')}/{folders}")

    writer = windows.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "5 minutes"}
    return batches.start(writer.outputMode("append").trigger(**trigger))
