"""Checks on the facts, duplicates, and reconciliation of the two fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenads.functions.metrics import ratio
from lumenads.functions.text import sql_hash
from lumenads.operators.performance import shared_rows


def hour_completeness(hourly: DataFrame, day=("year", "month", "day"), expected: int = 24) -> DataFrame:
    """Hours present per day; ``complete`` is false below ``expected``."""
    return (
        hourly.groupBy(*day)
        .agg(F.count_distinct("hour").alias("hours"))
        .withColumn("complete", F.col("hours") >= expected)
    )


def validate_hourly(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count(F.lit(1)).alias("impressions"),
        F.count_if("is_click").alias("clicks"),
        F.count_distinct("click_id").alias("unique_clicks"),
    ).withColumn("ctr", ratio("clicks", "impressions", 100, None, 0.0))


def validate_daily(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count_distinct("impression_id").alias("impressions"),
        F.count_if("is_click").alias("clicks"),
        F.count_if("is_conversion").alias("conversions"),
        F.count_distinct("campaign_id").alias("campaigns"),
    ).withColumn("ctr", ratio("clicks", "impressions", 100, None, 0.0))


def reconcile(hourly: DataFrame, daily: DataFrame, key: str = "dt") -> DataFrame:
    """Row totals of the two facts by date, their difference and percent."""
    left = hourly.groupBy(key).agg(F.count(F.lit(1)).alias("hourly_total"))
    right = daily.groupBy(key).agg(F.count(F.lit(1)).alias("daily_total"))
    gap = F.col("hourly_total") - F.col("daily_total")
    return (
        left.join(right, key, "inner")
        .withColumn("difference", gap)
        .withColumn("diff_percent", ratio("difference", "daily_total", 100))
    )


def require_table(spark: SparkSession, name: str) -> None:
    """Stop a daily run whose hourly table is missing."""
    if not spark.catalog.tableExists(name):
        raise LookupError(f"table {name} does not exist; run the hourly job first")


def dedup_by_key(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first by ``order``, which makes reruns agree.

    An aggregate rather than a window: equal keys are already reduced to one
    row inside each task, so a key with very many copies costs no more.
    """
    names = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*names), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in names])


def first_per_hash(df: DataFrame, hash_column: str, order) -> DataFrame:
    """Every row with the flag whether it is the first of its hash.

    The winner is found by an aggregate and joined back, so no task holds all
    copies of one text; order columns must make rows distinct.
    """
    winner = df.groupBy(hash_column).agg(F.min(F.struct(*order)).alias("_first"))
    return (
        df.join(winner, hash_column, "left")
        .withColumn("is_first", F.struct(*order) == F.col("_first"))
        .drop("_first")
    )


def feedback_dedup(feedback: DataFrame) -> DataFrame:
    """Pending feedback with its new status: the first of each SQL hash stays
    pending, later ones are duplicates.

    The hash is computed once per row; the first rows and the flags both come from the
    same shuffle of slim rows, and no SQL text is shuffled. ``feedback_id`` names a row.
    Returned are feedback_id, sql_hash, created_at and status.
    """
    hashed = feedback.where(F.col("status") == "pending").select(
        "feedback_id", "created_at", F.coalesce("sql_hash", sql_hash("sql")).alias("sql_hash")
    )
    slim = shared_rows(hashed, ("feedback_id",))
    flagged = first_per_hash(slim, "sql_hash", ["created_at", "feedback_id"])
    return flagged.withColumn(
        "status", F.when(F.col("is_first"), F.lit("pending")).otherwise(F.lit("duplicate"))
    ).drop("is_first")


def event_type_of() -> Column:
    """Kind of a raw record by the most specific id it carries."""
    return (
        F.when(F.col("conversion_id").isNotNull(), "conversion")
        .when(F.col("click_id").isNotNull(), "click")
        .otherwise("impression")
    )


def session_tail(turns: DataFrame, n: int = 5, session: str = "session_id", turn: str = "turn_number") -> DataFrame:
    """Last ``n`` turns of each session and the number of its next turn."""
    w = W.partitionBy(session).orderBy(F.desc(turn))
    last = turns.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    return last.withColumn("next_turn", F.max(turn).over(W.partitionBy(session)) + 1)
