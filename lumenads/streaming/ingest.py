"""Structured Streaming ingest: JSON lines in, partitioned Parquet and rejects out."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lumenads.functions.dates import epoch_normalise
from lumenads.operators.quality import event_type_of
from lumenads.schemas import CLICKS, CONVERSIONS, HOUR_PARTITION, IMPRESSIONS
from lumenads.sources.files import write_raw

TRIGGER = "60 seconds"
CORRUPT = "_corrupt"


def read_lines(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Raw text lines as a stream; all new files per micro-batch, or about ``max_bytes``."""
    reader = spark.readStream
    return (reader if max_bytes is None else reader.option("maxBytesPerTrigger", max_bytes)).text(path)


def parse_json(lines: DataFrame, schema, column: str = "value", time: str = "timestamp") -> DataFrame:
    """Typed record and, for a line that is blank, does not parse or has no usable event
    time, the line itself."""
    shape = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(
        F.col(column), shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    rows = lines.select(F.col(column).alias("_line"), parsed.alias("_r"))
    unusable = F.col("_r").isNull()
    if time in schema.fieldNames():
        unusable = unusable | epoch_normalise(F.col(f"_r.{time}").try_cast("bigint")).isNull()
    failed = F.coalesce(f"_r.{CORRUPT}", F.when(unusable, F.coalesce("_line", F.lit(""))))
    return rows.select("_line", *(F.col(f"_r.{f.name}") for f in schema.fields), failed.alias(CORRUPT))


def good(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_line")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(CORRUPT).isNotNull()).select(F.col("_line").alias("line"))


def with_hour_partition(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Zero-padded partition strings of the event time, UTC."""
    time = epoch_normalise(column)
    return df.withColumns(
        {
            "year": F.date_format(time, "yyyy"),
            "month": F.date_format(time, "MM"),
            "day": F.date_format(time, "dd"),
            "hour": F.date_format(time, "HH"),
        }
    )


BATCH_FOLDERS = ("stream", "run", "batch")


class Batches:
    """Writes the micro-batches of one stream, each into folders of its own.

    A folder carries the stream's name, the id of its query, which lasts as long as
    its checkpoint, and the batch number. A batch replayed after a failure replaces
    what it left half done; other streams into the same sink, and the same stream
    on a new checkpoint, never meet it.
    """

    def __init__(self, stream: str):
        self.stream, self._run, self._started = stream, "", threading.Event()

    def start(self, writer) -> StreamingQuery:
        query = writer.start()
        self._run = str(query.id)
        self._started.set()
        return query

    def folders(self, batch_id: int) -> dict[str, str]:
        self._started.wait()
        return dict(zip(BATCH_FOLDERS, (self.stream, self._run, str(batch_id))))

    def append(self, df: DataFrame, root: str, batch_id: int, partitions=()) -> None:
        if partitions:
            df = df.hint("rebalance", *partitions)
        (
            df.withColumns({k: F.lit(v) for k, v in self.folders(batch_id).items()})
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partitions, *BATCH_FOLDERS)
            .parquet(root)
        )


def ndjson_ingest(
    lines: DataFrame, schema, sink: str, errors: str, checkpoint: str, available_now: bool = False,
    partitions=HOUR_PARTITION, stream: str = "events",
) -> StreamingQuery:
    """Land JSON lines as Parquet by event hour; lines that fail go to ``errors``."""
    batches = Batches(stream)

    def land(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_json(batch, schema).persist()
        try:
            batches.append(with_hour_partition(good(parsed)), sink, batch_id, partitions)
            batches.append(rejected(parsed), errors, batch_id)
        finally:
            parsed.unpersist()

    writer = lines.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": TRIGGER}
    return batches.start(writer.trigger(**trigger))


def compact(landed: DataFrame, raw_root: str) -> None:
    """Landed batches as the raw table of the hourly job: one folder per hour, replaced as a
    whole, so batch folders need not be read again and small files are merged.

    ``landed`` is the ingest sink, limited to the hours to rewrite.
    """
    write_raw(landed.drop(*BATCH_FOLDERS), raw_root)


_SHAPES = {"impression": IMPRESSIONS, "click": CLICKS, "conversion": CONVERSIONS}


def route(records: DataFrame) -> dict[str, DataFrame]:
    """Split mixed records by kind; fields a kind does not own are dropped."""
    typed = records.withColumn("_kind", event_type_of())
    return {
        kind: typed.where(F.col("_kind") == kind).select(
            *[f.name for f in schema if f.name in records.columns]
        )
        for kind, schema in _SHAPES.items()
    }


def event_router(
    records: DataFrame, sinks: dict[str, str], checkpoint: str, available_now: bool = False, stream: str = "events"
) -> StreamingQuery:
    """One stream of mixed records to one Parquet sink per kind."""
    batches = Batches(stream)

    def send(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for kind, part in route(batch).items():
                batches.append(part, sinks[kind], batch_id)
        finally:
            batch.unpersist()

    writer = records.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": TRIGGER}
    return batches.start(writer.trigger(**trigger))
