"""Partitioned tables whose partitions are split into buckets of one key.

Rows of a key lie in the same bucket of every partition, sorted by it, so joins
and groupings by the key read the table as it lies: the layout stands in for the
shuffle that each of them would need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenads.schemas import with_partitions
from lumenads.session import folder_bytes

# Raw log bytes that one bucket stands for; a task holds a whole bucket of all partitions.
BUCKET_BYTES = 32 << 20
# A bucket this many times heavier than the mean, and larger than this, is not joined in one task.
HEAVY, HEAVY_BYTES = 4.0, 256 << 20

# With this, a side that lies by a part of the join keys is not dealt again by all of them.
CO_PARTITIONED = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the plans that run inside the block."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def buckets_for(spark: SparkSession, raw_root: str, least: int = 1) -> int:
    """Buckets that keep a task's share the same whatever the size of the raw logs."""
    return max(least, -(-folder_bytes(spark, raw_root) // BUCKET_BYTES))


@dataclass(frozen=True)
class BucketedTable:
    """A table of the session's catalog over files below ``root``."""

    name: str
    root: str
    schema: T.StructType
    partitions: Sequence[str]
    key: str = "impression_id"
    buckets: int = 8

    def declare(self, spark: SparkSession) -> None:
        """Make the catalog know the table; files that are there become its rows."""
        fields = with_partitions(self.schema, self.partitions).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet "
            f"PARTITIONED BY ({', '.join(self.partitions)}) "
            f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.root}'"
        )

    def overwrite(self, df: DataFrame) -> None:
        """Replace the partitions present in ``df``, others stay.

        Rows are dealt by partition and bucket first, so each bucket of a partition is
        one file, or a few if it is far larger than the rest."""
        spark = df.sparkSession
        self.declare(spark)
        columns = with_partitions(self.schema, self.partitions).fieldNames()
        bucket = F.pmod(F.hash(self.key), F.lit(self.buckets))
        dealt = df.select(*columns, bucket.alias("_bucket")).hint("rebalance", *self.partitions, "_bucket")
        with settings(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            dealt.select(*columns).write.mode("overwrite").insertInto(self.name)
        spark.catalog.refreshTable(self.name)

    def scan(self, spark: SparkSession, where: Column | None = None) -> DataFrame:
        self.declare(spark)
        df = spark.table(self.name)
        return df if where is None else df.where(where)

    def weights(self, spark: SparkSession, where: Column | None = None) -> DataFrame:
        """(bucket, bytes) of the chosen partitions, from file names and sizes alone."""
        files = self.scan(spark, where).select("_metadata.file_path", "_metadata.file_size").distinct()
        bucket = F.regexp_extract("file_path", r"_(\d+)\.c\d+[^/]*$", 1).cast("int")
        return files.groupBy(bucket.alias("bucket")).agg(F.sum("file_size").alias("bytes"))

    def is_even(self, spark: SparkSession, where: Column | None = None) -> bool:
        """Whether no bucket is so heavy that its task would hold up the rest."""
        most, total = self.weights(spark, where).agg(F.max("bytes"), F.sum("bytes")).first()
        return not most or most <= max(HEAVY_BYTES, HEAVY * total / self.buckets)
