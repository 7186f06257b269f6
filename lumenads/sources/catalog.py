"""Catalog work: external tables, partition discovery, date view, rollup table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenads.functions.dates import partition_date
from lumenads.functions.metrics import distinct_rollup
from lumenads.schemas import with_partitions


def create_external_table(
    spark: SparkSession, name: str, schema, location: str, partitions=()
) -> None:
    """Typed external Parquet table over existing files."""
    columns = with_partitions(schema, partitions)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    parted = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet{parted} LOCATION '{location}'"
    )


def repair_partitions(spark: SparkSession, name: str) -> None:
    spark.sql(f"MSCK REPAIR TABLE {name}")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def list_partitions(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"SHOW PARTITIONS {name}")


def dt_view(df: DataFrame, name: str | None = None) -> DataFrame:
    """Add the real date ``dt``; optionally expose it as a temp view."""
    dated = df.withColumn("dt", partition_date())
    if name is not None:
        dated.createOrReplaceTempView(name)
    return dated


ROLLUP_KEYS = ("campaign_id", "device_type")


def hourly_rollup(facts: DataFrame, keys=ROLLUP_KEYS) -> DataFrame:
    """Campaign by device counts; impression and click ids count once."""
    return distinct_rollup(facts, keys)


def save_rollup(facts: DataFrame, name: str, location: str, keys=ROLLUP_KEYS) -> None:
    """Store the rollup as its own snappy Parquet table."""
    (
        hourly_rollup(facts, keys)
        .write.mode("overwrite")
        .option("path", location)
        .option("compression", "snappy")
        .saveAsTable(name, format="parquet")
    )


def distinct_partitions(df: DataFrame, partitions=("year", "month", "day")) -> DataFrame:
    return df.select(*partitions).distinct()


def recent_partitions(df: DataFrame, since: str) -> DataFrame:
    """Rows per day from ``since`` on, newest first."""
    return (
        df.where(F.col("dt") >= F.lit(since).cast("date"))
        .groupBy("dt")
        .agg(F.count(F.lit(1)).alias("record_count"))
        .orderBy(F.desc("dt"))
    )
