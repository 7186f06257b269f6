"""Count series: windows, zero filling, alignment, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenads.functions.dates import DEFAULT_ZONE


def tumbling(df: DataFrame, time: str, width: str, *aggregates: Column, keys=()) -> DataFrame:
    """Aggregates per tumbling window, ``window_start`` first."""
    grouped = df.groupBy(F.window(time, width).alias("_w"), *keys).agg(*aggregates)
    rest = [c for c in grouped.columns if c != "_w"]
    return grouped.select(F.col("_w.start").alias("window_start"), *rest)


def floor_bucket(epoch_seconds, width: int = 300) -> Column:
    """Start second of the bucket an epoch second falls into."""
    value = F.col(epoch_seconds) if isinstance(epoch_seconds, str) else epoch_seconds
    return (F.floor(value / width) * width).cast("bigint")


def hours_by_event_time(
    df: DataFrame, time: str, start: str, end: str, zone: str = DEFAULT_ZONE
) -> DataFrame:
    """Rows per local hour of [start, end) by event time.

    The caller reads partitions beyond the range, for late arrivals; the event
    time decides.
    """
    local = F.date_trunc("hour", F.from_utc_timestamp(F.col(time), zone))
    return (
        df.withColumn("hour_start", local)
        .where(F.col("hour_start") >= F.lit(start).cast("timestamp"))
        .where(F.col("hour_start") < F.lit(end).cast("timestamp"))
        .groupBy("hour_start")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def zero_fill(series: DataFrame, time: str, values, step: str, by_day: bool = False) -> DataFrame:
    """Complete grid from the first to the last step; missing counts are 0.

    With ``by_day`` the grid covers whole days.
    """
    kind = dict(series.dtypes)[time]
    low, high = F.min(time), F.max(time)
    if by_day:
        low = F.date_trunc("day", low)
        high = F.date_trunc("day", high) + F.expr("INTERVAL 1 DAY") - F.expr(f"INTERVAL {step}")
    ends = series.agg(low.cast(kind).alias("a"), high.cast(kind).alias("b"))
    grid = ends.where(F.col("a").isNotNull()).select(
        F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias(time)
    )
    return grid.join(series, time, "left").na.fill(0, list(values))


def series_profile(series: DataFrame, value: str) -> DataFrame:
    return series.agg(
        F.count(value).alias("points"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
    )


def profile_by(series: DataFrame, value: str, **keys: Column) -> DataFrame:
    named = [column.alias(name) for name, column in keys.items()]
    return series.groupBy(*named).agg(
        F.avg(value).alias("mean_value"), F.count(value).alias("points")
    )


def align(time: str, **series: DataFrame) -> DataFrame:
    """Several count series on one time axis; zeros become null for display.

    Each frame has ``time`` and a column with the keyword's name.
    """
    joined = reduce(lambda a, b: a.join(b, time, "full_outer"), series.values())
    return joined.select(time, *[F.nullif(F.col(n), F.lit(0)).alias(n) for n in series])


def last_span(df: DataFrame, time: str, span: str = "24 HOURS") -> DataFrame:
    """Rows younger than ``span`` before the newest row."""
    newest = df.agg(F.max(time).alias("_newest"))
    return (
        df.crossJoin(F.broadcast(newest))
        .where(F.col(time) > F.col("_newest") - F.expr(f"INTERVAL {span}"))
        .drop("_newest")
    )


def low_traffic_alarm(series: DataFrame, time: str, value: str, limit: int = 10, periods: int = 2) -> DataFrame:
    """Windows that end ``periods`` consecutive readings below ``limit``.

    A missing window is no reading and breaks no run of its neighbours' times:
    consecutive means adjacent rows of the series.
    """
    w = W.orderBy(time).rowsBetween(-(periods - 1), 0)
    low = (F.col(value) < limit).cast("int")
    return series.select(
        "*",
        ((F.sum(low).over(w) == periods) & (F.count(F.lit(1)).over(w) == periods)).alias("alarm"),
    )


def freshness_alarm(
    rows: DataFrame, event_time: str, ingest_time: str, width: str = "5 minutes", limit: int = 900
) -> DataFrame:
    """Largest ingest lag in seconds per window and whether it is over the limit."""
    lag = F.unix_micros(F.col(ingest_time)) - F.unix_micros(F.col(event_time))
    return (
        rows.groupBy(F.window(ingest_time, width).alias("_w"))
        .agg((F.max(lag) / 1000000).alias("max_lag_seconds"))
        .select(
            F.col("_w.start").alias("window_start"),
            "max_lag_seconds",
            (F.col("max_lag_seconds") > limit).alias("alarm"),
        )
    )
