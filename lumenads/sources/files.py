"""Reading and writing the ad tables: partitioned Parquet, CSV series, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenads.functions.dates import tuple_range
from lumenads.schemas import HOUR_PARTITION, with_partitions
from lumenads.session import shared_dir


def scan_hive_parquet(
    spark: SparkSession,
    root: str,
    schema,
    partitions=HOUR_PARTITION,
    where: Column | None = None,
    period=None,
) -> DataFrame:
    """Partitioned table read with its declared schema.

    The schema names the partition columns as strings, so ``'03'`` stays
    ``'03'``. Filters on them prune folders before any file is opened.
    """
    df = spark.read.schema(with_partitions(schema, partitions)).parquet(root)
    if period is not None:
        df = df.where(tuple_range(*period))
    return df if where is None else df.where(where)


def write_partitioned(
    df: DataFrame, root: str, partitions=HOUR_PARTITION, codec: str = "snappy", cluster: bool = True
) -> None:
    """Replace exactly the partitions present in ``df``; others keep their files.

    An empty result therefore leaves old data alone. Rows are clustered by the
    partition columns first; the rebalance lets adaptive execution split a
    partition that is far larger than the rest and merge the small ones. A job
    that writes a single partition passes ``cluster=False`` and saves the shuffle.
    """
    rows = df.hint("rebalance", *partitions) if cluster else df
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", codec)
        .partitionBy(*partitions)
        .parquet(root)
    )


def write_raw(df: DataFrame, root: str) -> None:
    """Raw events: hour partitions, zstd."""
    write_partitioned(df, root, HOUR_PARTITION, "zstd")


def csv_series_read(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``timestamp,value`` series, one row per timestamp, in time order.

    Of rows with the same timestamp the smallest value is kept, so a rerun
    gives the same series whatever the file order.
    """
    rows = spark.read.csv(path, header=True, schema=f"timestamp timestamp, {value} bigint")
    return rows.groupBy("timestamp").agg(F.min(value).alias(value)).orderBy("timestamp")


def csv_write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def jsonl_sink(df: DataFrame, path: str) -> None:
    """Append scored windows as JSON lines."""
    df.write.mode("append").json(path)


def json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def retention_filter(df: DataFrame, column: str, now: str, days: int = 90) -> DataFrame:
    """Rows not older than ``days`` at ``now``."""
    kind = dict(df.dtypes)[column]
    cutoff = F.lit(now).cast(kind) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(F.col(column) >= cutoff)


def ttl_filter(df: DataFrame, now_epoch: int, column: str = "ttl") -> DataFrame:
    """Key-value rows whose expiry second lies ahead or is not set."""
    return df.where(F.col(column).isNull() | (F.col(column) > F.lit(now_epoch)))


def expire_before(spark: SparkSession, root: str, schema, cutoff: str, time: str = "timestamp", partitions=HOUR_PARTITION) -> dict[str, int]:
    """Drop what lies before ``cutoff`` (UTC, ``time`` in epoch milliseconds) from a partitioned table.

    Partitions that end before it go as folders, by their names; only the one that the cutoff
    falls into is read, and written again without its old rows. Returns how many went
    (``dropped``) and whether one was written again (``border``). A second run changes nothing.
    Partition names come from year, month, day and, if there, hour; names of other
    shapes are left alone. A row without a time is as old as its partition.
    """
    fs, top = _file_system(spark, root)
    stamp = cutoff.replace("T", " ").replace("-", " ").replace(":", " ").split()
    border = tuple(f"{name}={part}" for name, part in zip(partitions, stamp))
    dropped, on_border = 0, False
    pattern = top.suffix("/" + "/".join(f"{p}=*" for p in partitions))
    for status in fs.globStatus(pattern) or ():
        path = status.getPath()
        names = tuple(path.toString().rstrip("/").split("/")[-len(partitions):])
        if len(stamp) < len(partitions) or not all(n.split("=")[-1].isdigit() for n in names):
            continue
        if names < border:
            dropped += bool(fs.delete(path, True))
        on_border = on_border or names == border
    if on_border:
        one = F.lit(True)
        for name, part in zip(partitions, stamp):
            one = one & (F.col(name) == part)
        limit = F.unix_millis(F.to_utc_timestamp(F.lit(cutoff), F.current_timezone()))
        rows = scan_hive_parquet(spark, root, schema, partitions, one)
        staged = shared_dir(spark, "expiry")
        rows.where(F.col(time) >= limit).write.parquet(staged)
        kept = spark.read.schema(rows.schema).parquet(staged)
        if kept.isEmpty():
            fs.delete(_file_system(spark, f"{root}/{'/'.join(border)}")[1], True)
        else:
            write_partitioned(kept, root, partitions, cluster=False)
    return {"dropped": dropped, "border": int(on_border)}


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place
