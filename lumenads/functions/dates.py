"""Dates, partitions, epochs and report periods. Today is always an argument."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_ZONE = "Asia/Seoul"


def partition_date(year="year", month="month", day="day") -> Column:
    """Real date of zero-padded string partitions; Spark prunes on it."""
    return F.make_date(*[F.col(c).cast("int") for c in (year, month, day)])


def partition_values(day) -> dict[str, str]:
    return {"year": f"{day:%Y}", "month": f"{day:%m}", "day": f"{day:%d}"}


def tuple_range(start: str, end: str) -> Column:
    """(year, month, day) within [start, end] by comparing the padded strings."""
    low, high = date.fromisoformat(start), date.fromisoformat(end)
    if low == high:
        clauses = [F.col(k) == v for k, v in partition_values(low).items()]
        return clauses[0] & clauses[1] & clauses[2]
    key = F.struct("year", "month", "day")
    literal = lambda d: F.struct(*[F.lit(v) for v in partition_values(d).values()])
    years = F.col("year").between(f"{low:%Y}", f"{high:%Y}")
    return years & (key >= literal(low)) & (key <= literal(high))


def date_between(start: str, end: str, column: Column | None = None) -> Column:
    value = partition_date() if column is None else column
    return value.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def yyyymmdd(year="year", month="month", day="day") -> Column:
    return (
        F.col(year).cast("int") * 10000 + F.col(month).cast("int") * 100 + F.col(day).cast("int")
    )


def iso_weekday(column) -> Column:
    """1 = Monday .. 7 = Sunday."""
    return F.weekday(column) + 1


def day_type(column) -> Column:
    return F.when(iso_weekday(column) >= 6, "weekend").otherwise("weekday")


def epoch_normalise(column) -> Column:
    """Epoch in seconds, milli-, micro- or nanoseconds, told apart by magnitude, as a timestamp."""
    value = F.col(column) if isinstance(column, str) else column
    size = F.abs(value)
    micros = (
        F.when(size >= 10**17, F.call_function("div", value, F.lit(1000)))
        .when(size >= 10**14, value)
        .when(size >= 10**11, value * 1000)
        .otherwise(value * 1000000)
    )
    return F.timestamp_micros(micros.cast("bigint"))


def to_zone(column, zone: str = DEFAULT_ZONE) -> Column:
    return F.from_utc_timestamp(column, zone)


def time_breakdown(df: DataFrame, epoch_ms: str, zone: str = DEFAULT_ZONE) -> DataFrame:
    """Epoch milliseconds as seconds and as UTC and local text forms."""
    utc = F.timestamp_millis(F.col(epoch_ms).cast("bigint"))
    local = F.from_utc_timestamp(utc, zone)
    stamp = "yyyy-MM-dd HH:mm:ss.SSS"
    minutes = ((F.unix_seconds(local) - F.unix_seconds(utc)) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    hours = F.floor(F.abs(minutes) / 60).cast("int")
    offset = F.format_string("%s%02d:%02d", sign, hours, F.abs(minutes) % 60)

    def iso(time, zone_offset):
        whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
        rest = F.date_format(time, ".SSSSSS")
        return F.concat(whole, F.when(rest == ".000000", "").otherwise(rest), zone_offset)

    return df.select(
        "*",
        F.floor(F.col(epoch_ms) / 1000).alias("timestamp_seconds"),
        F.date_format(utc, stamp).alias("utc"),
        iso(utc, F.lit("+00:00")).alias("utc_iso"),
        F.date_format(local, stamp).alias("local"),
        iso(local, offset).alias("local_iso"),
        F.lit(zone).alias("timezone"),
        F.date_format(local, "yyyy-MM-dd").alias("date"),
        F.date_format(local, "HH:mm:ss").alias("time"),
        F.date_format(local, "EEEE").alias("weekday"),
        F.date_format(local, "yyyy'년' MM'월' dd'일' HH'시' mm'분' ss'초'").alias("readable"),
    )


# ------------------------------------------------------------------- periods


def _iso(day: date) -> str:
    return day.isoformat()


def month_bounds(day: date) -> tuple[date, date]:
    last = calendar.monthrange(day.year, day.month)[1]
    return day.replace(day=1), day.replace(day=last)


def previous_month(day: date) -> tuple[date, date]:
    return month_bounds(day.replace(day=1) - timedelta(days=1))


def same_range_previous_month(start: str, end: str) -> tuple[str, str]:
    """The range moved one month back, days clamped to that month's length."""
    out = []
    for text in (start, end):
        day = date.fromisoformat(text)
        first, last = previous_month(day)
        out.append(_iso(first.replace(day=min(day.day, last.day))))
    return out[0], out[1]


def previous_week(start: str, end: str) -> tuple[str, str]:
    week = timedelta(days=7)
    return _iso(date.fromisoformat(start) - week), _iso(date.fromisoformat(end) - week)


def recent_days(today: str, n: int, include_today: bool = False) -> tuple[str, str]:
    end = date.fromisoformat(today) - timedelta(days=0 if include_today else 1)
    return _iso(end - timedelta(days=n - 1)), _iso(end)


def resolve_period(name: str, today: str) -> tuple[str, str]:
    """``previous_day``, ``last_7_days`` or ``previous_month`` as a date range."""
    day = date.fromisoformat(today)
    if name == "previous_day":
        return recent_days(today, 1)
    if name == "last_7_days":
        return recent_days(today, 7)
    if name == "previous_month":
        first, last = previous_month(day)
        return _iso(first), _iso(last)
    raise ValueError(f"unknown period {name!r}")


def report_period(kind: str, today: str) -> tuple[str, str]:
    """Daily = month to yesterday, weekly = previous Monday to Sunday, monthly = previous month."""
    day = date.fromisoformat(today)
    if kind == "daily":
        yesterday = day - timedelta(days=1)
        return _iso(yesterday.replace(day=1)), _iso(yesterday)
    if kind == "weekly":
        monday = day - timedelta(days=day.weekday() + 7)
        return _iso(monday), _iso(monday + timedelta(days=6))
    if kind == "monthly":
        return resolve_period("previous_month", today)
    raise ValueError(f"unknown report {kind!r}")


def day_grid(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day of the range."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("dt")
    )


def week_calendar(days: DataFrame, start: str, end: str, strict_month: bool = True) -> DataFrame:
    """Monday-to-Sunday weeks of the range, one row per (week, day).

    With ``strict_month`` the first and last weeks are clipped to the range.
    Otherwise the first week starts on its Monday, before the range, and is
    left out when its Sunday falls after the end.
    """
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    monday = F.date_trunc("week", F.col("dt")).cast("date")
    weeks = (
        days.where(F.col("dt").between(low, high))
        .select(monday.alias("week_monday"))
        .distinct()
        .withColumn("week_end", F.least(F.date_add("week_monday", 6), high))
    )
    if strict_month:
        weeks = weeks.withColumn("week_start", F.greatest("week_monday", low))
    else:
        partial_lost = (F.col("week_monday") < low) & (F.date_add("week_monday", 6) > high)
        weeks = weeks.where(~partial_lost).withColumn("week_start", F.col("week_monday"))
    return weeks.select(
        "week_start",
        "week_end",
        F.explode(F.sequence("week_start", "week_end")).alias("dt"),
    )


def date_or_default(text, default: str, fmt: str = "yyyy-MM-dd") -> Column:
    """Parsed date, or ``default`` when the text is empty or no date."""
    value = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.try_to_date(value, fmt), F.lit(default).cast("date"))
