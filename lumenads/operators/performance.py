"""Grouped performance tables: one shape, many dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenads.functions.metrics import half_up, ratio, summarise, with_rates


def shared_rows(df: DataFrame, keys) -> DataFrame:
    """``df``, which has one row per ``keys``, for a plan that reads it in several branches.

    The row is packed by an aggregate, below which neither a branch's filter nor its
    choice of columns gets. So all branches need the very same shuffle by ``keys``, and
    Spark runs it, with all that lies before it, once.
    """
    packed = df.groupBy(*keys).agg(F.max(F.struct(*df.columns)).alias("_row"))
    return packed.select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def performance(
    df: DataFrame,
    dims=(),
    measures=(),
    rates=(),
    empty: float | None = None,
    having: Column | None = None,
    order=(),
    n: int | None = None,
) -> DataFrame:
    """Measures and rates by ``dims``; filtered, ordered and cut after aggregation.

    ``order`` must end in a unique key when ``n`` is given, so that the rows
    kept do not depend on how ties were read.
    """
    out = with_rates(summarise(df, dims, measures), rates, empty)
    if having is not None:
        out = out.where(having)
    if order:
        out = out.orderBy(*order)
    return out if n is None else out.limit(n)


def with_share(df: DataFrame, digits: int = 1, many_by=(), many_groups: bool = False, **shares: str) -> DataFrame:
    """Percent of the column total; ``shares`` maps output name to column.

    With few groups a window over the aggregate reads the facts once. With very
    many (``many_groups``) no task may hold them all, so the totals are a one-row
    aggregate beside the rows; with one row per ``many_by`` both read the same shuffled groups.
    """
    columns = list(dict.fromkeys(shares.values()))
    if many_by or many_groups:
        df = shared_rows(df, many_by) if many_by else df
        totals = df.agg(*[F.sum(c).alias(f"_total_{c}") for c in columns])
        joined = df.crossJoin(F.broadcast(totals))
    else:
        every = W.partitionBy()
        joined = df.select("*", *[F.sum(c).over(every).alias(f"_total_{c}") for c in columns])
    out = [
        ratio(column, f"_total_{column}", 100, digits).alias(name)
        for name, column in shares.items()
    ]
    return joined.select(*df.columns, *out)


def vs_average(df: DataFrame, column: str, name: str, digits: int = 1) -> DataFrame:
    """Percent above or below the mean of the column; for aggregates with few rows."""
    every = W.partitionBy()
    total = F.sum(column).over(every).cast("double")
    relative = F.col(column).cast("double") * 100.0 * F.count(column).over(every).cast("double")
    return df.select(
        "*", half_up(relative / F.nullif(total, F.lit(0.0)) - 100.0, digits).alias(name)
    )


def ranked_top(df: DataFrame, order, n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows with their rank; only those n rows meet in one task."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn(name, F.row_number().over(W.orderBy(*order)))


def nth_row(df: DataFrame, order, n: int) -> DataFrame:
    return ranked_top(df, order, n, "rn").where(F.col("rn") == n)


def best_per_key(df: DataFrame, key, order, n: int = 1) -> DataFrame:
    """First ``n`` rows per key. The rank filter is applied before the shuffle
    as well, so a hot key ships at most ``n`` rows per task."""
    keys = [key] if isinstance(key, str) else list(key)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def moving_average(df: DataFrame, order: str, rows: int = 7, digits: int = 2, **columns) -> DataFrame:
    """Mean over the current and the preceding rows; for series already one row per step."""
    w = W.orderBy(order).rowsBetween(-(rows - 1), 0)
    out = [
        half_up(
            F.sum(column).over(w).cast("double") / F.count(column).over(w).cast("double"), digits
        ).alias(name)
        for name, column in columns.items()
    ]
    return df.select("*", *out)


def running_total(df: DataFrame, order: str, **columns) -> DataFrame:
    w = W.orderBy(order)
    return df.select("*", *[F.sum(c).over(w).alias(name) for name, c in columns.items()])


def daypart(hour: Column) -> Column:
    """Night, morning, afternoon or evening of an hour."""
    return (
        F.when(hour <= 5, "night")
        .when(hour <= 11, "morning")
        .when(hour <= 17, "afternoon")
        .otherwise("evening")
    )


def rank_of_label(column, labels) -> Column:
    """Position of a label in a fixed order; labels not listed come last."""
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), column)
    return F.when(position == 0, len(labels) + 1).otherwise(position)


def bucket(value: Column, steps, last: str, strict: bool = False) -> Column:
    """Label of the first (limit, label) step the value fits under."""
    out = None
    for limit, label in steps:
        fits = value < limit if strict else value <= limit
        out = F.when(fits, label) if out is None else out.when(fits, label)
    return out.otherwise(last)
