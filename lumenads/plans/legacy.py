"""Reports over the event log with one row per event and a type column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenads.functions.metrics import half_up, money_sum, ratio, units, units_sum
from lumenads.operators.joins import outer_merge
from lumenads.operators.performance import best_per_key


def _n(kind: str):
    return F.count_if(F.col("event_type") == kind)


def _counts(spend: bool = True):
    out = [
        _n("impression").alias("impressions"),
        _n("click").alias("clicks"),
        _n("conversion").alias("conversions"),
    ]
    if spend:
        paid = F.when(F.col("event_type") == "impression", units("bid_price"))
        out.append(units_sum(F.coalesce(paid, F.lit(0).cast("bigint"))).alias("cost"))
    return out


def event_kpis(events: DataFrame, keys=(), spend: bool = True) -> DataFrame:
    """Counts by event type and bid spend, by any keys."""
    return events.groupBy(*keys).agg(*_counts(spend))


def event_rates(df: DataFrame, cvr: bool = False) -> DataFrame:
    out = df.withColumn("ctr", ratio("clicks", "impressions", 100))
    return out.withColumn("cvr", ratio("conversions", "clicks", 100)) if cvr else out


def day_stats(events: DataFrame) -> DataFrame:
    """Impressions, clicks and the bids of all events."""
    return events.groupBy("date").agg(
        _n("impression").alias("impressions"), _n("click").alias("clicks"),
        money_sum("bid_price").alias("total_revenue"),
    )


def ad_day_metrics(events: DataFrame) -> DataFrame:
    """Ad by day: counts, mean click cost, CTR and conversion rate as fractions."""
    used = events.where(
        F.col("event_type").isin("impression", "click", "conversion") | F.col("cpc_cost").isNotNull()
    )
    mean = ratio(money_sum("cpc_cost"), F.count("cpc_cost"), 1, None)
    out = used.groupBy("ad_id", "date").agg(
        *_counts(spend=False), F.coalesce(mean, F.lit(0.0)).alias("avg_cpc")
    )
    return out.withColumn("ctr", ratio("clicks", "impressions", 1, None, 0.0)).withColumn(
        "conversion_rate", ratio("conversions", "clicks", 1, None, 0.0)
    )


def ad_day_metrics_merged(events: DataFrame) -> DataFrame:
    """The counts and mean cost as four grouped frames, merged outer."""
    keys = ("ad_id", "date")
    frames = [
        events.where(F.col("event_type") == kind).groupBy(*keys).agg(F.count("event_id").alias(name))
        for kind, name in (("impression", "impressions"), ("click", "clicks"), ("conversion", "conversions"))
    ]
    costs = events.where(F.col("cpc_cost").isNotNull()).groupBy(*keys).agg(
        ratio(money_sum("cpc_cost"), F.count("cpc_cost"), 1, None).alias("avg_cpc")
    )
    return outer_merge([*frames, costs], keys)


def top_ads(metrics: DataFrame, min_impressions: int = 10, n: int = 20) -> DataFrame:
    """Best CTR among ad days with enough impressions."""
    return metrics.where(F.col("impressions") >= min_impressions).orderBy(
        F.desc("ctr"), "ad_id", "date"
    ).limit(n)


def mean_ctr_by_day(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("date").agg(half_up(F.avg("ctr"), 9).alias("mean_ctr"))


def latest_top_ads(metrics: DataFrame, n: int = 5) -> DataFrame:
    """Newest row of each ad, the best ``n`` of them by CTR."""
    newest = best_per_key(metrics, "ad_id", (F.desc("date"),))
    return newest.orderBy(F.desc("ctr"), "ad_id").limit(n)
