"""Daily states that add up: distinct users and quantiles of any range from stored days.

A day is reduced once to a bitmap (exact), a HyperLogLog sketch or a KLL sketch per
key and stored by month. A range reads its days and merges them; the facts are not
read again. Replacing a day replaces the month it lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenads.sources.files import scan_hive_parquet, write_partitioned

MONTH_PARTITION = ("year", "month")
# Bits of a HyperLogLog register number (error about 1.04 / sqrt(2 ** bits)), and size of a KLL sketch.
HLL_BITS, KLL_SIZE = 14, 400


def number_users(users: DataFrame, path: str, user: str = "user_id", batch: int = 0) -> None:
    """Give every user that has none yet a number: (user, number) below ``path``, a folder a batch.

    Numbers stay as they are, so bitmaps of different days go together. Within a
    batch and task they are consecutive, which keeps bitmaps full; a rerun of a
    batch replaces it."""
    spark = users.sparkSession
    new = users.select(F.col(user).cast("string").alias("user")).where("user is not null").distinct()
    if batch:
        new = new.join(numbers(spark, path).where(F.col("batch") < batch), "user", "left_anti")
    numbered = new.select("user", (F.lit(batch << 48) + F.monotonically_increasing_id()).alias("number"))
    numbered.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def numbers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user string, number long, batch int").parquet(path)


def _by_month(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.date_format("dt", "yyyy"), "month": F.date_format("dt", "MM")})


def _save(df: DataFrame, path: str) -> None:
    write_partitioned(_by_month(df), path, MONTH_PARTITION, "zstd")


def _read(spark: SparkSession, path: str, schema: str, start: str, end: str) -> DataFrame:
    """Days of the range; whole months outside it are not listed."""
    first, last = (F.lit(x[:4] + x[5:7]) for x in (start, end))
    df = scan_hive_parquet(spark, path, StructType.fromDDL(schema), MONTH_PARTITION)
    inside = F.concat("year", "month").between(first, last)
    return df.where(inside & F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


# ------------------------------------------------------------ distinct users


def save_day_bitmaps(facts: DataFrame, numbered: DataFrame, path: str, keys=(), user: str = "user_id") -> None:
    """(dt, keys, bucket, users): the users of a day as bits, a bitmap for each 32 768 numbers.

    Rows without a user or day count nobody. Users are reduced to one row per day
    before their numbers are looked up."""
    daily = facts.where(F.col(user).isNotNull() & F.col("dt").isNotNull()).select("dt", *keys, F.col(user).cast("string").alias("user")).distinct()
    placed = daily.join(numbered.select("user", "number"), "user")
    bits = placed.groupBy("dt", *keys, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("users")
    )
    _save(bits, path)


def users_in(spark: SparkSession, path: str, start: str, end: str, by: dict[str, Column] | None = None, keys: str = "") -> DataFrame:
    """Exact distinct users of the range, per group of ``by``: bitmaps are united, then counted.

    ``keys`` is the schema of the key columns that the bitmaps were saved with."""
    days = _read(spark, path, "dt date, " + (f"{keys}, " if keys else "") + "bucket long, users binary", start, end)
    groups = [column.alias(name) for name, column in (by or {}).items()]
    united = days.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return united.groupBy(*(by or {})).agg(F.sum(F.bitmap_count("users")).alias("users"))


def save_day_sketches(facts: DataFrame, path: str, keys=(), user: str = "user_id", bits: int = HLL_BITS) -> None:
    """(dt, keys, users): a HyperLogLog sketch of the users of a day."""
    rows = facts.where(F.col("dt").isNotNull())
    _save(rows.groupBy("dt", *keys).agg(F.hll_sketch_agg(F.col(user).cast("string"), bits).alias("users")), path)


def about_users_in(spark: SparkSession, path: str, start: str, end: str, by: dict[str, Column] | None = None, keys: str = "") -> DataFrame:
    """Estimated distinct users of the range, per group of ``by``."""
    days = _read(spark, path, "dt date, " + (f"{keys}, " if keys else "") + "users binary", start, end)
    groups = [column.alias(name) for name, column in (by or {}).items()]
    return days.groupBy(*groups).agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"))


# ----------------------------------------------------------------- quantiles


def save_day_quantiles(facts: DataFrame, path: str, keys, value: str, size: int = KLL_SIZE) -> None:
    """(dt, keys, values): a KLL sketch of the values of a day. Rows without one do not count."""
    rows = facts.where(F.col(value).isNotNull() & F.col("dt").isNotNull())
    _save(rows.groupBy("dt", *keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("values")), path)


def quantile_in(spark: SparkSession, path: str, start: str, end: str, share: float, by, keys: str) -> DataFrame:
    """Quantile of the range per group of ``by``, from the merged sketches, and the number of values."""
    days = _read(spark, path, f"dt date, {keys}, values binary", start, end)
    merged = days.groupBy(*by).agg(F.kll_merge_agg_double("values").alias("_s"))
    return merged.select(
        *by, F.kll_sketch_get_quantile_double("_s", F.lit(share)).alias("quantile"), F.kll_sketch_get_n_double("_s").alias("n")
    )


def rank_within(rows: DataFrame, quantiles: DataFrame, by, value: str, share: float, error: float = 0.01) -> DataFrame:
    """Per group, whether the rank of its quantile among ``rows`` is off by ``error`` at most.

    Of equal values the quantile may be any, so it has a range of ranks."""
    joined = rows.where(F.col(value).isNotNull()).join(quantiles, list(by))
    ranks = joined.groupBy(*by).agg(
        (F.count_if(F.col(value) < F.col("quantile")) / F.count(F.lit(1))).alias("_low"),
        (F.count_if(F.col(value) <= F.col("quantile")) / F.count(F.lit(1))).alias("_high"),
        F.first("n").alias("n"),
    )
    within = (F.col("_low") <= share + error) & (F.col("_high") >= share - error)
    return ranks.select(*by, "n", within.alias("within"))
