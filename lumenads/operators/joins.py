"""Joins of the event tables and of the facts made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenads.schemas import DAY_PARTITION, HOUR_PARTITION

# Left rows without a key are dealt over this many partitions of the anti join.
SPREAD = 1_024


def spread_left_join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Left join that survives a hot key on either side and rows without a key.

    An inner join, of which adaptive execution splits skewed partitions on both
    sides, united with the left rows that have no partner. Those are found
    against the different right keys, which are reduced inside each task, so no
    key is hot there; left rows with a null key match nothing and are dealt out
    by their other columns.
    """
    keys = list(keys)
    matched = left.join(right, keys, "inner")
    present = _all_present(keys)
    deal = F.when(present, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*left.columns), F.lit(SPREAD)).cast("int"))
    known = right.where(present).select(*keys).distinct().withColumn("_deal", F.lit(-1))
    lone = left.withColumn("_deal", deal).join(known, [*keys, "_deal"], "left_anti").drop("_deal")
    nothing = {c: F.lit(None).cast(right.schema[c].dataType) for c in right.columns if c not in keys}
    return matched.unionByName(lone.withColumns(nothing).select(*matched.columns))


def plain_left_join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Left join of sides that already lie by their keys."""
    return left.join(right, list(keys), "left")


def _all_present(keys) -> Column:
    out = F.lit(True)
    for key in keys:
        out = out & F.col(key).isNotNull()
    return out


def attach_clicks(
    impressions: DataFrame,
    clicks: DataFrame,
    partition=HOUR_PARTITION,
) -> DataFrame:
    """Hourly fact: impressions with the clicks of the same partition."""
    side = clicks.withColumnRenamed("timestamp", "click_timestamp")
    kept = [
        c
        for c in (
            "click_id",
            "click_position_x",
            "click_position_y",
            "landing_page_url",
            "cost_per_click",
            "click_timestamp",
        )
        if c in side.columns
    ]
    side = side.select("impression_id", *partition, *kept)
    joined = spread_left_join(
        impressions.withColumnRenamed("timestamp", "impression_timestamp"),
        side,
        ["impression_id", *partition],
    )
    return joined.withColumn("is_click", F.col("click_id").isNotNull())


def attach_conversions(
    facts: DataFrame,
    conversions: DataFrame,
    partition=DAY_PARTITION,
    join=spread_left_join,
) -> DataFrame:
    """Daily fact: the hourly fact with the conversions of the same partition."""
    side = conversions.withColumnRenamed("timestamp", "conversion_timestamp")
    kept = [
        c
        for c in (
            "conversion_id",
            "conversion_type",
            "conversion_value",
            "product_id",
            "quantity",
            "attribution_window",
            "conversion_timestamp",
        )
        if c in side.columns
    ]
    side = side.select("impression_id", *partition, *kept)
    joined = join(facts, side, ["impression_id", *partition])
    return joined.withColumn("is_conversion", F.col("conversion_id").isNotNull())


def journey(
    impressions: DataFrame, clicks: DataFrame, conversions: DataFrame, partition=()
) -> DataFrame:
    """Impression, its clicks, and conversions by click id; ``partition`` bounds both joins."""
    click_side = clicks.select("impression_id", "click_id", *partition)
    conversion_side = conversions.select(
        "click_id", "conversion_id", "conversion_type", *partition
    )
    reached = spread_left_join(impressions, click_side, ["impression_id", *partition])
    return spread_left_join(reached, conversion_side, ["click_id", *partition])


def _window_days(column="attribution_window") -> Column:
    return F.regexp_extract(F.col(column), r"^(\d+)", 1).try_cast("bigint")


def attribute_within_window(facts: DataFrame, conversions: DataFrame) -> DataFrame:
    """Attach a conversion to its impression only inside its own window.

    ``facts`` has ``impression_timestamp`` in epoch milliseconds. Conversions
    outside the window attach to nothing; the impression row stays.
    """
    day_ms = 86_400_000
    conv = conversions.select(
        F.col("impression_id").alias("_impression"),
        "conversion_id",
        "conversion_type",
        "conversion_value",
        "attribution_window",
        F.col("timestamp").alias("conversion_timestamp"),
    )
    lag = F.col("conversion_timestamp") - F.col("impression_timestamp")
    inside = (lag >= 0) & (lag <= _window_days() * F.lit(day_ms))
    joined = facts.join(conv, (F.col("impression_id") == F.col("_impression")) & inside, "left").drop("_impression")
    return joined.withColumn("is_conversion", F.col("conversion_id").isNotNull())


def hour_of_daily(hourly: DataFrame, daily: DataFrame, keys=("impression_id",)) -> DataFrame:
    """Daily rows with the hour that only the hourly fact carries.

    The hour is looked up once per key, so click fan-out in the hourly fact
    does not multiply the daily rows.
    """
    hours = hourly.groupBy(*keys).agg(F.min("hour").alias("hour"))
    return daily.join(hours, list(keys), "inner")


def scalar_cross_join(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row beside a single parameter or total row."""
    return df.crossJoin(F.broadcast(one_row))


def with_previous(current: DataFrame, previous: DataFrame, keys, values) -> DataFrame:
    """Current period beside the previous one by key, absent values as 0."""
    before = previous.select(*keys, *[F.col(v).alias(f"prev_{v}") for v in values])
    joined = current.join(before, list(keys), "left")
    filled = [
        F.coalesce(F.col(f"prev_{v}"), F.lit(0).cast(dict(previous.dtypes)[v])).alias(f"prev_{v}")
        for v in values
    ]
    return joined.select(*current.columns, *filled)


def newcomers(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows of the period whose key never appears before it."""
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    before = rows.where((F.col("dt") < low) & F.col(key).isNotNull()).select(key).distinct()
    return rows.where(F.col("dt").between(low, high)).join(before, key, "left_anti")


def outer_merge(frames, keys) -> DataFrame:
    """Full outer merge of grouped frames; what one side lacks is 0."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.join(frame, list(keys), "full_outer")
    return merged.na.fill(0, [c for c in merged.columns if c not in keys])


def keep_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed.select(key), key, "left_semi")
