"""Query history and feedback as append-only tables with latest-per-key views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenads.functions.text import id_hash, sql_hash

# Length of the short form of an answer.
ANSWER_LENGTH = 500
HISTORY_DAYS = 90


def history_rows(runs: DataFrame, days: int = HISTORY_DAYS) -> DataFrame:
    """Run records as stored: hashed user, expiry second, the answer whole."""
    expiry = F.unix_timestamp(F.col("timestamp")) + F.lit(days * 86400)
    return runs.withColumn("user_hash", id_hash("user_id")).withColumn("ttl", expiry).drop("user_id")


def short_answer(history: DataFrame, length: int = ANSWER_LENGTH) -> DataFrame:
    """History with answers cut for display."""
    return history.withColumn("answer", F.substring("answer", 1, length))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest_per_key(rows: DataFrame, key: str, order) -> DataFrame:
    """Newest row per key by an aggregate that combines inside each task."""
    names = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*names), F.struct(*order)).alias("_row")
    return rows.groupBy(key).agg(newest).select(key, *[F.col(f"_row.{c}").alias(c) for c in names])


def with_feedback(history: DataFrame, feedback: DataFrame) -> DataFrame:
    """History with the newest feedback of each run."""
    newest = latest_per_key(
        feedback.select("history_id", "feedback", "feedback_at", "trained"),
        "history_id",
        ["feedback_at", "feedback", "trained"],
    )
    kept = [c for c in history.columns if c not in ("feedback", "feedback_at", "trained")]
    return history.select(*kept).join(newest, "history_id", "left")


def lookup(history: DataFrame, history_id: str) -> DataFrame:
    return history.where(F.col("history_id") == history_id)


def recent(history: DataFrame, limit: int = 50, time: str = "timestamp", key: str = "history_id") -> DataFrame:
    return history.orderBy(F.desc(time), F.desc(key)).limit(limit)


def pending_feedback(runs: DataFrame, days: int = HISTORY_DAYS) -> DataFrame:
    """New pending rows with the hash of their SQL and an expiry second."""
    return runs.select(
        "feedback_id",
        "history_id",
        "question",
        "sql",
        sql_hash("sql").alias("sql_hash"),
        F.lit("pending").alias("status"),
        "created_at",
        (F.unix_timestamp("created_at") + F.lit(days * 86400)).alias("ttl"),
    )


def current_status(feedback: DataFrame, transitions: DataFrame) -> DataFrame:
    """Feedback with the status of its newest transition, else its own."""
    newest = latest_per_key(
        transitions.select("feedback_id", "status", "changed_at"),
        "feedback_id",
        ["changed_at", "status"],
    ).select("feedback_id", F.col("status").alias("_new"))
    return (
        feedback.join(newest, "feedback_id", "left")
        .withColumn("status", F.coalesce("_new", "status"))
        .drop("_new")
    )


def by_index(rows: DataFrame, key: str, value, order, descending: bool = True) -> DataFrame:
    """Rows of one index key in index order."""
    direction = F.desc if descending else F.asc
    return rows.where(F.col(key) == value).orderBy(*[direction(c) for c in order])
