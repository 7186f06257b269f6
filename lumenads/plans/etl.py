"""Hourly and daily fact jobs, for one partition or a whole range in one plan."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenads.functions.dates import tuple_range
from lumenads.operators.joins import attach_clicks, attach_conversions, plain_left_join
from lumenads.operators.quality import hour_completeness, validate_daily, validate_hourly
from lumenads.schemas import (
    CLICKS,
    CONVERSIONS,
    DAILY_FACT,
    DAY_PARTITION,
    HOUR_PARTITION,
    HOURLY_FACT,
    IMPRESSIONS,
)
from lumenads.sources.buckets import CO_PARTITIONED, BucketedTable, settings
from lumenads.sources.files import scan_hive_parquet, write_partitioned


def one_hour(moment: datetime) -> Column:
    parts = {"year": "%Y", "month": "%m", "day": "%d", "hour": "%H"}
    out = F.lit(True)
    for name, fmt in parts.items():
        out = out & (F.col(name) == moment.strftime(fmt))
    return out


def hours_between(start: str, end: str, first: int = 0, last: int = 23, now: datetime | None = None) -> Column:
    """Hours of the range, within a daily hour span, that do not lie ahead of ``now``."""
    out = tuple_range(start, end) & F.col("hour").between(f"{first:02d}", f"{last:02d}")
    if now is not None:
        stamp = F.concat_ws("-", "year", "month", "day", "hour")
        out = out & (stamp <= now.strftime("%Y-%m-%d-%H"))
    return out


def build_hourly(raw: dict[str, DataFrame], where: Column) -> DataFrame:
    """Hourly fact rows of the chosen partitions."""
    joined = attach_clicks(raw["impressions"].where(where), raw["clicks"].where(where))
    return _shaped(joined, HOURLY_FACT, HOUR_PARTITION)


def build_daily(hourly: DataFrame, conversions: DataFrame, where: Column) -> DataFrame:
    """Daily fact rows of the chosen partitions."""
    joined = attach_conversions(hourly.where(where).drop("hour"), conversions.where(where).drop("hour"))
    return _shaped(joined, DAILY_FACT, DAY_PARTITION)


def _shaped(df: DataFrame, schema, partitions) -> DataFrame:
    """Declared columns in order; values that do not fit their type become null."""
    columns = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*columns, *partitions)


def raw_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    shapes = {"impressions": IMPRESSIONS, "clicks": CLICKS, "conversions": CONVERSIONS}
    return {
        name: scan_hive_parquet(spark, f"{root}/{name}", schema)
        for name, schema in shapes.items()
    }


def run_hour(spark: SparkSession, raw_root: str, fact_root: str, moment: datetime) -> DataFrame:
    """Scheduled hourly job: join, replace the partition, return its check row."""
    where = one_hour(moment)
    facts = build_hourly(raw_tables(spark, raw_root), where)
    write_partitioned(facts, f"{fact_root}/hourly", HOUR_PARTITION, cluster=False)
    stored = scan_hive_parquet(spark, f"{fact_root}/hourly", HOURLY_FACT)
    return validate_hourly(stored.where(where))


def run_day(spark: SparkSession, raw_root: str, fact_root: str, day: date) -> DataFrame:
    """Scheduled daily job over the stored hours: join, replace, return its check row.

    Missing hours do not stop it; ``hours`` says how many were there.
    """
    where = tuple_range(day.isoformat(), day.isoformat())
    hourly = scan_hive_parquet(spark, f"{fact_root}/hourly", HOURLY_FACT)
    conversions = raw_tables(spark, raw_root)["conversions"]
    facts = build_daily(hourly, conversions, where)
    write_partitioned(facts, f"{fact_root}/daily", DAY_PARTITION, cluster=False)
    stored = scan_hive_parquet(spark, f"{fact_root}/daily", DAILY_FACT, DAY_PARTITION)
    hours = hourly.where(where).agg(F.count_distinct("hour").alias("hours"))
    return validate_daily(stored.where(where)).crossJoin(F.broadcast(hours))


def backfill_hours(
    spark: SparkSession, raw_root: str, fact_root: str, start: str, end: str,
    first: int = 0, last: int = 23, now: datetime | None = None,
) -> None:
    """Every hour of the range in one job: the partition columns are join keys,
    so no loop over hours is needed, and only partitions with rows are replaced."""
    where = hours_between(start, end, first, last, now)
    facts = build_hourly(raw_tables(spark, raw_root), where)
    write_partitioned(facts, f"{fact_root}/hourly", HOUR_PARTITION)


def backfill_days(
    spark: SparkSession, raw_root: str, fact_root: str, start: str, end: str,
    now: datetime | None = None,
) -> DataFrame:
    """Hours first, then days. Returns the days with fewer than 24 hours."""
    backfill_hours(spark, raw_root, fact_root, start, end, now=now)
    hourly = scan_hive_parquet(spark, f"{fact_root}/hourly", HOURLY_FACT)
    conversions = raw_tables(spark, raw_root)["conversions"]
    where = tuple_range(start, end)
    write_partitioned(build_daily(hourly, conversions, where), f"{fact_root}/daily", DAY_PARTITION)
    return hour_completeness(hourly.where(where)).where(~F.col("complete"))


def hourly_table(name: str, fact_root: str, buckets: int = 8) -> BucketedTable:
    return BucketedTable(name, f"{fact_root}/hourly", HOURLY_FACT, HOUR_PARTITION, buckets=buckets)


def daily_table(name: str, fact_root: str, buckets: int = 8) -> BucketedTable:
    return BucketedTable(name, f"{fact_root}/daily", DAILY_FACT, DAY_PARTITION, buckets=buckets)


def fill_hours(
    spark: SparkSession, raw_root: str, hourly: BucketedTable, start: str, end: str,
    first: int = 0, last: int = 23, now: datetime | None = None,
) -> None:
    """As ``backfill_hours``, into a table that lies in buckets of the impression."""
    hourly.overwrite(build_hourly(raw_tables(spark, raw_root), hours_between(start, end, first, last, now)))


def daily_rows(spark: SparkSession, hourly: BucketedTable, conversions: DataFrame, where: Column) -> DataFrame:
    """Daily fact rows from stored hours.

    Conversions are dealt to the buckets of the hourly table, which is read as it
    lies; plan and run this inside ``settings(spark, CO_PARTITIONED)``. Should one
    impression fill a bucket, both sides are joined by ``build_daily``."""
    stored = hourly.scan(spark)
    if not hourly.is_even(spark, where):
        return build_daily(stored, conversions, where)
    joined = attach_conversions(
        stored.where(where).drop("hour"), conversions.where(where).drop("hour"), join=plain_left_join
    )
    return _shaped(joined, DAILY_FACT, DAY_PARTITION)


def fill_days(
    spark: SparkSession, raw_root: str, hourly: BucketedTable, daily: BucketedTable, start: str, end: str,
    now: datetime | None = None,
) -> DataFrame:
    """Hours first, then days. Returns the days with fewer than 24 hours."""
    fill_hours(spark, raw_root, hourly, start, end, now=now)
    where = tuple_range(start, end)
    with settings(spark, CO_PARTITIONED):
        daily.overwrite(daily_rows(spark, hourly, raw_tables(spark, raw_root)["conversions"], where))
    return hour_completeness(hourly.scan(spark, where)).where(~F.col("complete"))


def backfill_outcome(spark: SparkSession, facts: DataFrame, start: str, end: str, now: date | None = None) -> DataFrame:
    """Per planned partition: done, missing, or ahead of ``now``; counted by outcome."""
    hours = (date.fromisoformat(end) - date.fromisoformat(start)).days * 24 + 24
    begin = F.lit(f"{start} 00:00:00").cast("timestamp_ntz")
    planned = spark.range(hours).select(
        (begin + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("_t")
    )
    planned = planned.select(
        "_t",
        F.date_format("_t", "yyyy").alias("year"),
        F.date_format("_t", "MM").alias("month"),
        F.date_format("_t", "dd").alias("day"),
        F.date_format("_t", "HH").alias("hour"),
    )
    present = facts.where(tuple_range(start, end)).groupBy(*HOUR_PARTITION).agg(F.count(F.lit(1)).alias("_n"))
    limit = F.lit(f"{(now or date.max) + (timedelta(days=1) if now else timedelta())} 00:00:00")
    outcome = (
        F.when(F.col("_t") >= limit.cast("timestamp_ntz"), "future")
        .when(F.col("_n").isNotNull(), "done")
        .otherwise("missing")
    )
    return (
        planned.join(present, list(HOUR_PARTITION), "left")
        .groupBy(outcome.alias("outcome"))
        .agg(F.count(F.lit(1)).alias("hours"))
    )
