"""Metric dictionary: every measure and rate under one unambiguous name.

Money is summed exactly, so totals do not depend on the order in which
partitions are merged; rates divide doubles once and round last. Amounts become
whole ten-thousandths first: a long turns into a decimal far faster than a
double does, and the decimal sum cannot overflow.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(28,4)"
UNITS = 10_000


def units(value) -> Column:
    """Amount in whole ten-thousandths, as a long."""
    return F.rint(_as_column(value) * F.lit(float(UNITS))).cast("bigint")


def units_sum(amount: Column) -> Column:
    """Exact total of an amount given in units."""
    total = F.sum(amount.cast("decimal(18,0)"))
    return (total * F.lit(Decimal(1) / UNITS)).cast(MONEY)


def money_sum(value) -> Column:
    """Exact total of a money column."""
    return units_sum(units(value))


def _as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _purchase() -> Column:
    return (F.col("conversion_type") == "purchase") & F.col("is_click")


def _sum_if(condition: Column, name: str) -> Column:
    return units_sum(F.when(condition, units(name)).otherwise(F.lit(0).cast("bigint")))


def measure(name: str) -> Column:
    """Aggregate expression of one named measure over fact rows."""
    return _MEASURES[name]().alias(name)


_MEASURES = {
    "impressions": lambda: F.count(F.lit(1)),
    "impressions_distinct": lambda: F.count_distinct("impression_id"),
    "clicks": lambda: F.count_if(F.col("is_click")),
    "conversions": lambda: F.count_if(F.col("is_conversion")),
    "conversions_purchase": lambda: F.count_if(_purchase()),
    "revenue": lambda: _sum_if(F.col("is_conversion"), "conversion_value"),
    "revenue_purchase": lambda: _sum_if(_purchase(), "conversion_value"),
    "cost_click": lambda: units_sum(F.coalesce(units("cost_per_click"), F.lit(0).cast("bigint"))),
    "cost_impression": lambda: money_sum("cost_per_impression"),
    "cost_clicked": lambda: _sum_if(F.col("is_click"), "cost_per_click"),
    "cost_full": lambda: money_sum("cost_per_impression")
    + _sum_if(F.col("is_click"), "cost_per_click"),
    "cost_null_trap": lambda: units_sum(units("cost_per_impression") + units("cost_per_click")),
    "users": lambda: F.count_distinct("user_id"),
    "advertisers": lambda: F.count_distinct("advertiser_id"),
    "campaigns": lambda: F.count_distinct("campaign_id"),
    "ads": lambda: F.count_distinct("ad_id"),
    "active_days": lambda: F.count_distinct("dt"),
}

# Fact columns each measure reads, so that a plan can ask for no others.
NEEDS = {
    "impressions": (),
    "impressions_distinct": ("impression_id",),
    "clicks": ("is_click",),
    "conversions": ("is_conversion",),
    "conversions_purchase": ("conversion_type", "is_click"),
    "revenue": ("is_conversion", "conversion_value"),
    "revenue_purchase": ("conversion_type", "is_click", "conversion_value"),
    "cost_click": ("cost_per_click",),
    "cost_impression": ("cost_per_impression",),
    "cost_clicked": ("is_click", "cost_per_click"),
    "cost_full": ("cost_per_impression", "cost_per_click", "is_click"),
    "cost_null_trap": ("cost_per_impression", "cost_per_click"),
    "users": ("user_id",),
    "advertisers": ("advertiser_id",),
    "campaigns": ("campaign_id",),
    "ads": ("ad_id",),
    "active_days": ("dt",),
}


def half_up(value: Column, digits: int) -> Column:
    """Half-up rounding of a double. Going through a decimal with four more
    places keeps a last-bit error of the division from tipping a tie."""
    return F.round(value.cast(f"decimal(38,{digits + 4})"), digits).cast("double")


def ratio(num, den, factor: float = 1.0, digits: int | None = 2, empty: float | None = None) -> Column:
    """``num * factor / den``; ``empty`` is the value for a zero denominator.

    Reports and question answering leave it null, dashboards use 0.
    """
    top = _as_column(num).cast("double")
    if factor != 1.0:
        top = top * F.lit(float(factor))
    value = top / F.nullif(_as_column(den).cast("double"), F.lit(0.0))
    if digits is not None:
        value = half_up(value, digits)
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


# name -> (numerator, denominator, factor, digits)
_RATES = {
    "ctr_percent": ("clicks", "impressions", 100, 2),
    "ctr_distinct": ("clicks", "impressions_distinct", 100, 2),
    "cvr_percent": ("conversions", "clicks", 100, 2),
    "cvr_purchase": ("conversions_purchase", "clicks", 100, 2),
    "cvr_on_impressions": ("conversions", "impressions", 100, 4),
    "roas_report": ("revenue_purchase", "cost_click", 100, 2),
    "roas_dash": ("revenue", "cost_full", 1, 2),
    "roas_qa": ("revenue", "cost_null_trap", 1, None),
    "cpc": ("cost_click", "clicks", 1, 2),
    "cpc_full": ("cost_full", "clicks", 1, 2),
    "cpa_qa": ("cost_null_trap", "conversions", 1, None),
    "cpa_full": ("cost_full", "conversions", 1, 2),
    "cpm_full": ("cost_full", "impressions", 1000, 2),
    "cpm_impression": ("cost_impression", "impressions", 1000, 2),
    "cpc_clicked": ("cost_clicked", "clicks", 1, 2),
    "conversions_per_1k": ("conversions", "impressions", 1000, 2),
}


def rate(name: str, empty: float | None = None) -> Column:
    num, den, factor, digits = _RATES[name]
    return ratio(num, den, factor, digits, empty).alias(name)


def summarise(df: DataFrame, keys=(), measures=()) -> DataFrame:
    """Aggregate fact rows by ``keys`` into named measures."""
    return df.groupBy(*keys).agg(*[measure(m) for m in measures])


def with_rates(df: DataFrame, rates=(), empty: float | None = None) -> DataFrame:
    return df.select("*", *[rate(r, empty) for r in rates])


def net_profit(revenue="revenue", cost="cost_full") -> Column:
    return F.col(revenue) - F.col(cost)


def change_rate(current, previous, digits: int = 2) -> Column:
    """Percent change; null where the previous value is zero or missing."""
    cur, prev = _as_column(current).cast("double"), _as_column(previous).cast("double")
    return half_up((cur - prev) * F.lit(100.0) / F.nullif(prev, F.lit(0.0)), digits)


def distinct_rollup(df: DataFrame, keys) -> DataFrame:
    """Distinct impressions, distinct clicks and CTR by ``keys``."""
    return (
        df.groupBy(*keys)
        .agg(
            F.count_distinct("impression_id").alias("impressions"),
            F.count_distinct("click_id").alias("clicks"),
        )
        .withColumn("ctr", ratio("clicks", "impressions", 100, None, empty=0.0))
    )


def performance_needs(measures, extra=()) -> tuple[str, ...]:
    """Fact columns that a set of measures reads."""
    out = list(extra)
    for name in measures:
        out.extend(NEEDS[name])
    return tuple(dict.fromkeys(out))
