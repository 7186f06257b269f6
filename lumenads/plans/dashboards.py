"""Dashboard queries over the facts. Empty denominators give 0 here."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenads.functions.dates import day_type, iso_weekday, month_bounds
from lumenads.functions.metrics import half_up, measure, money_sum, performance_needs, rate, ratio, summarise, with_rates
from lumenads.operators.performance import (
    best_per_key,
    bucket,
    daypart,
    moving_average,
    performance,
    rank_of_label,
    ranked_top,
    running_total,
    vs_average,
    with_share,
    shared_rows,
)
from lumenads.plans.reports import down, within

BASE = ("impressions", "clicks", "cost_full", "revenue", "conversions")
BASE_COLUMNS = performance_needs(BASE, ("dt",))


def days_in(start: str, end: str) -> int:
    return (date.fromisoformat(end) - date.fromisoformat(start)).days + 1


def labelled(df: DataFrame, start: str, end: str) -> DataFrame:
    """Put the chosen period beside every row."""
    return df.withColumn("period", F.lit(f"{start} ~ {end}"))


def mean_per_day(total: str, days, digits: int = 0) -> Column:
    return ratio(total, days if isinstance(days, Column) else F.lit(days), 1, digits, 0.0)


# ----------------------------------------------------------- period overviews


def range_kpi_daily(facts: DataFrame, start: str, end: str) -> DataFrame:
    out = performance(
        within(facts, start, end), ("dt",), (*BASE, "advertisers", "campaigns", "ads"),
        ("ctr_percent", "cpc_full", "cvr_percent", "roas_dash"), 0.0, order=("dt",),
    )
    return labelled(out, start, end)


def range_daily_trend(facts: DataFrame, start: str, end: str) -> DataFrame:
    out = performance(
        within(facts, start, end), ("dt",), BASE, ("ctr_percent", "roas_dash"), 0.0, order=("dt",)
    )
    return out.withColumn("weekday", iso_weekday("dt"))


def period_summary(facts: DataFrame, start: str, end: str) -> DataFrame:
    days = days_in(start, end)
    out = performance(
        within(facts, start, end), (), (*BASE, "users", "advertisers", "campaigns"),
        ("roas_dash",), 0.0,
    )
    return labelled(
        out.withColumns(
            {
                "days": F.lit(days),
                "daily_revenue": mean_per_day("revenue", days),
                "daily_cost": mean_per_day("cost_full", days),
            }
        ),
        start, end,
    )


def unit_costs_period(facts: DataFrame, start: str, end: str) -> DataFrame:
    """CPM, CPC and CPA of the period; CPM needs at least 1000 impressions."""
    out = summarise(
        within(facts, start, end), (),
        ("impressions", "clicks", "cost_full", "conversions", "active_days"),
    )
    return labelled(
        out.withColumns(
            {
                "daily_impressions": mean_per_day("impressions", F.col("active_days")),
                "daily_clicks": mean_per_day("clicks", F.col("active_days")),
                "cpm": F.when(
                    F.col("impressions") >= 1000, rate("cpm_full", 0.0)
                ).otherwise(0.0),
                "cpc": rate("cpc_full", 0.0),
                "cpa": rate("cpa_full", 0.0),
            }
        ),
        start, end,
    )


def unit_costs_daily(facts: DataFrame, start: str, end: str) -> DataFrame:
    """The same by day; CPM from impression cost, CPC from click cost."""
    return performance(
        within(facts, start, end), ("dt",),
        ("impressions", "clicks", "conversions", "revenue", "cost_impression", "cost_clicked", "cost_full"),
        ("cpm_impression", "cpc_clicked", "cpa_full", "ctr_percent", "cvr_percent", "roas_dash"),
        0.0, order=("dt",),
    )


def target_attainment(
    facts: DataFrame, start: str, end: str,
    daily_revenue: float = 100_000_000, daily_cost: float = 50_000_000, daily_conversions: float = 10_000,
) -> DataFrame:
    """Actual against daily target times days."""
    days = days_in(start, end)
    out = performance(
        within(facts, start, end), (), (*BASE, "advertisers", "campaigns", "users"), ("roas_dash",), 0.0
    )
    goals = {"revenue": daily_revenue, "cost_full": daily_cost, "conversions": daily_conversions}
    for name, goal in goals.items():
        out = out.withColumn(f"{name}_target", F.lit(float(goal * days))).withColumn(
            f"{name}_percent", ratio(name, f"{name}_target", 100, 1)
        )
    return labelled(out.withColumn("days", F.lit(days)), start, end)


def month_projection(
    facts: DataFrame, today: str,
    target_revenue: float = 3_000_000_000, target_cost: float = 1_500_000_000,
    target_conversions: float = 400_000,
) -> DataFrame:
    """Month to date, percent of the monthly targets and run-rate landing."""
    day = date.fromisoformat(today)
    first, last = month_bounds(day)
    elapsed, total = day.day, last.day
    out = performance(
        within(facts, first.isoformat(), today), (),
        ("revenue", "cost_full", "conversions", "users", "advertisers"), ("roas_dash",), 0.0,
    )
    return out.withColumns(
        {
            "month": F.lit(f"{day:%Y-%m}"),
            "days_elapsed": F.lit(elapsed),
            "days_in_month": F.lit(total),
            "month_percent": half_up(F.lit(elapsed * 100.0 / total), 1),
            "revenue_percent": ratio("revenue", F.lit(target_revenue), 100, 1),
            "cost_percent": ratio("cost_full", F.lit(target_cost), 100, 1),
            "conversions_percent": ratio("conversions", F.lit(target_conversions), 100, 1),
            "revenue_landing": half_up(F.col("revenue").cast("double") * total / F.lit(float(elapsed)), 0),
        }
    )


# ----------------------------------------------------------------- dimensions


def dimension_performance(
    facts: DataFrame, dims, start: str, end: str, measures=BASE,
    rates=("ctr_percent", "cvr_percent", "roas_dash"), having: Column | None = None,
    order=(), n: int | None = None,
) -> DataFrame:
    """Counts, cost, revenue and rates of any dimensions over a period."""
    return performance(within(facts, start, end), dims, measures, rates, 0.0, having, order, n)


def advertiser_perf(facts: DataFrame, start: str, end: str, n: int = 20) -> DataFrame:
    days = days_in(start, end)
    out = dimension_performance(
        facts, ("advertiser_id",), start, end, (*BASE, "active_days"),
        order=(down("revenue"), "advertiser_id"), n=n,
    )
    return out.withColumn("daily_revenue", mean_per_day("revenue", days)).withColumn(
        "daily_cost", mean_per_day("cost_full", days)
    )


def campaign_perf(facts: DataFrame, start: str, end: str, min_cost: float = 100_000, n: int = 10) -> DataFrame:
    return dimension_performance(
        facts, ("campaign_id", "advertiser_id"), start, end, (*BASE, "active_days"),
        having=F.col("cost_full") > min_cost,
        order=(down("roas_dash"), down("revenue"), "campaign_id", "advertiser_id"), n=n,
    )


def creative_perf(facts: DataFrame, start: str, end: str, min_rows: int = 100, n: int = 20) -> DataFrame:
    return dimension_performance(
        facts, ("ad_id", "campaign_id"), start, end, (*BASE, "active_days"),
        having=F.col("impressions") >= min_rows,
        order=(down("cvr_percent"), down("ctr_percent"), down("revenue"), "ad_id", "campaign_id"), n=n,
    )


def keyword_perf(facts: DataFrame, start: str, end: str, min_rows: int = 50, n: int = 30) -> DataFrame:
    return dimension_performance(
        facts, ("keyword",), start, end, BASE, ("ctr_percent", "cpc_full", "roas_dash"),
        F.col("impressions") >= min_rows, (down("revenue"), "keyword"), n,
    )


def category_perf(facts: DataFrame, start: str, end: str) -> DataFrame:
    out = dimension_performance(facts, ("food_category",), start, end)
    return with_share(
        out, impression_share="impressions", cost_share="cost_full", revenue_share="revenue"
    )


def region_perf(facts: DataFrame, start: str, end: str) -> DataFrame:
    out = dimension_performance(facts, ("delivery_region",), start, end)
    return with_share(out, impression_share="impressions", revenue_share="revenue")


def device_perf(facts: DataFrame, start: str, end: str) -> DataFrame:
    out = dimension_performance(facts, ("device_type",), start, end, (*BASE, "users"))
    return with_share(out, impression_share="impressions", revenue_share="revenue")


# Daypart order.
DAYPARTS = ("night", "morning", "afternoon", "evening")


def daypart_perf(facts: DataFrame, start: str, end: str) -> DataFrame:
    part = daypart(F.col("hour").cast("int"))
    out = performance(
        within(facts, start, end).withColumn("daypart", part), ("daypart",), BASE,
        ("ctr_percent", "roas_dash"), 0.0,
    )
    shared = with_share(out, impression_share="impressions")
    return shared.orderBy(rank_of_label(F.col("daypart"), DAYPARTS))


def underperforming_ads(
    facts: DataFrame, start: str, end: str, min_rows: int = 100, many_rows: int = 1000,
    min_cost: float = 10_000, high_cost: float = 100_000, n: int = 50,
) -> DataFrame:
    """Ads far below the average CTR or ROAS, or with spend and nothing back."""
    keys = ("ad_id", "campaign_id", "advertiser_id")
    ads = summarise(within(facts, start, end), keys, BASE)
    c = F.col
    ctr = ratio("clicks", "impressions", 100, None, 0.0)
    roas = ratio("revenue", "cost_full", 1, None, 0.0)
    # one row per ad, read for the averages and for the comparison with them
    rated = shared_rows(ads.withColumn("_ctr", ctr).withColumn("_roas", roas), keys)
    averages = rated.where(c("impressions") >= min_rows).agg(
        half_up(F.avg("_ctr"), 6).alias("average_ctr"), half_up(F.avg("_roas"), 6).alias("average_roas")
    )
    low_ctr = c("_ctr") < c("average_ctr") * 0.5
    low_roas = (c("cost_full") > 0) & (c("_roas") < c("average_roas") * 0.5)
    no_clicks = (c("impressions") > many_rows) & (c("clicks") == 0)
    no_revenue = (c("cost_full") > high_cost) & (c("revenue") == 0)
    chosen = (
        ((c("impressions") >= min_rows) & low_ctr)
        | ((c("cost_full") >= min_cost) & low_roas)
        | no_clicks
        | no_revenue
    )
    reason = (
        F.when((c("impressions") > 0) & low_ctr, "very_low_ctr")
        .when(low_roas, "very_low_roas")
        .when(no_clicks, "no_clicks")
        .when(no_revenue, "no_conversions")
        .otherwise("other")
    )
    joined = rated.crossJoin(F.broadcast(averages)).where(chosen)
    return (
        joined.select(
            *keys, *BASE,
            half_up(F.col("_ctr"), 2).alias("ctr_percent"), "average_ctr",
            half_up(F.col("_roas"), 2).alias("roas_dash"), "average_roas",
            reason.alias("reason"),
        )
        .orderBy(down("cost_full"), *keys)
        .limit(n)
    )


# Exposure buckets as (largest count, label).
EXPOSURE_STEPS = ((10, "1-10"), (20, "11-20"), (30, "21-30"), (50, "31-50"), (100, "51-100"))
EXPOSURE_LAST = "over 100"


def exposure_fatigue(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Users by how often they saw ads, with the rates of each bucket."""
    users = summarise(within(facts, start, end), ("user_id",), ("impressions", "clicks", "conversions"))
    label = bucket(F.col("impressions"), EXPOSURE_STEPS, EXPOSURE_LAST)
    out = users.groupBy(label.alias("exposure_bucket")).agg(
        F.count(F.lit(1)).alias("users"),
        *[F.sum(m).alias(m) for m in ("impressions", "clicks", "conversions")],
    )
    out = with_rates(out, ("ctr_percent", "cvr_percent"), 0.0).withColumn(
        "mean_exposure", ratio("impressions", "users", 1, 1)
    )
    labels = [label for _, label in EXPOSURE_STEPS]
    return with_share(out, user_share="users").orderBy(rank_of_label(F.col("exposure_bucket"), labels))


def budget_burn(facts: DataFrame, start: str, end: str, daily_limit: float = 1_000_000, n: int = 20) -> DataFrame:
    """Spend against the period limit, with a status at 95, 80 and 50 percent."""
    days = days_in(start, end)
    budget = float(daily_limit * days)
    share = F.col("cost_full").cast("double") / F.lit(budget)
    status = (
        F.when(share >= 0.95, "nearly_spent")
        .when(share >= 0.8, "on_track")
        .when(share >= 0.5, "half_spent")
        .otherwise("underspent")
    )
    return performance(
        within(facts, start, end), ("advertiser_id",), ("cost_full", "revenue", "active_days"),
        ("roas_dash",), 0.0, F.col("cost_full") > 0, (down("cost_full"), "advertiser_id"), n,
    ).withColumns(
        {
            "budget": F.lit(budget),
            "burn_percent": half_up(share * 100.0, 1),
            "days_active": F.concat_ws("/", F.col("active_days").cast("string"), F.lit(str(days))),
            "daily_cost": mean_per_day("cost_full", F.col("active_days")),
            "burn_status": status,
        }
    )


# ---------------------------------------------------------------------- hours


def hourly_roas(facts: DataFrame, start: str, end: str) -> DataFrame:
    return performance(
        within(facts, start, end), ("hour",), (*BASE, "active_days", "advertisers"),
        ("ctr_percent", "roas_dash"), 0.0, order=("hour",),
    )


def hourly_activity(facts: DataFrame, start: str, end: str) -> DataFrame:
    out = summarise(
        within(facts, start, end), ("hour",),
        ("advertisers", "campaigns", "ads", "cost_full", "impressions"),
    )
    return with_share(out, cost_share="cost_full", impression_share="impressions")


def peak_hours(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Totals by hour, highest revenue first, with the mean per active day."""
    out = performance(
        within(facts, start, end), ("hour",), (*BASE, "users", "active_days"),
        ("roas_dash", "ctr_percent"), 0.0, order=(down("revenue"), "hour"),
    )
    return out.withColumn("daypart", daypart(F.col("hour").cast("int"))).withColumn(
        "daily_revenue", mean_per_day("revenue", F.col("active_days"))
    )


def hourly_average(facts: DataFrame, start: str, end: str) -> DataFrame:
    out = performance(
        within(facts, start, end), ("hour",), (*BASE, "active_days"), ("ctr_percent", "roas_dash"), 0.0,
        order=("hour",),
    )
    per_day = {f"daily_{m}": mean_per_day(m, F.col("active_days"), 1) for m in ("impressions", "clicks", "conversions")}
    return out.withColumns(per_day)


def mean_rows_per_hour(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Rows by hour beside the mean of the hourly counts of the same hour.

    The counts are aggregated to one row per hour first, so the window mean
    over a one-row partition equals the count itself.
    """
    return summarise(within(facts, start, end), ("hour",), ("impressions", "clicks", "advertisers")).select(
        "*",
        F.col("impressions").cast("double").alias("mean_impressions"),
        F.col("clicks").cast("double").alias("mean_clicks"),
    )


# Commute, lunch and late-night spans as (first, last, label).
HOUR_SPANS = ((7, 9, "morning_commute"), (12, 14, "lunch"), (18, 20, "evening_commute"), (22, 23, "late_night"))


def peak_label(facts: DataFrame, day: str, value: str = "revenue") -> DataFrame:
    """Hours of one day marked PEAK, HIGH, LOW or NORMAL by ``value``."""
    hours = performance(
        within(facts, day, day), ("hour",), ("revenue", "impressions", "clicks", "conversions", "users"),
        ("ctr_percent", "cvr_percent"), 0.0,
    )
    every = W.partitionBy()
    total = F.sum(value).over(every).cast("double")
    hour = F.col("hour").cast("int")
    span = None
    for first, last, label in HOUR_SPANS:
        inside = hour.between(first, last)
        span = F.when(inside, label) if span is None else span.when(inside, label)
    x = F.col(value).cast("double") * F.count(F.lit(1)).over(every)
    status = (
        F.when(F.col(value) == F.max(value).over(every), "PEAK")
        .when(x > total * 1.2, "HIGH")
        .when(x < total * 0.8, "LOW")
        .otherwise("NORMAL")
    )
    return hours.select("*", span.otherwise("other").alias("span"), status.alias("status"))


# --------------------------------------------------------------------- trends


def moving_averages(facts: DataFrame, start: str, end: str, rows: int = 7) -> DataFrame:
    daily = performance(
        within(facts, start, end), ("dt",), BASE, ("ctr_percent", "roas_dash"), 0.0
    )
    return moving_average(
        daily, "dt", rows, 2, ctr_ma="ctr_percent", revenue_ma="revenue", cost_ma="cost_full"
    )


def cumulative_revenue(facts: DataFrame, start: str, end: str) -> DataFrame:
    daily = performance(
        within(facts, start, end), ("dt",), ("revenue", "cost_full", "users", "conversions"), ("roas_dash",), 0.0
    )
    return vs_average(running_total(daily, "dt", running_revenue="revenue"), "revenue", "vs_average_percent")


def daily_vs_average(facts: DataFrame, start: str, end: str) -> DataFrame:
    daily = performance(
        within(facts, start, end), ("dt",), ("revenue", "cost_full", "users"), ("roas_dash",), 0.0
    )
    return vs_average(daily.withColumn("weekday", iso_weekday("dt")), "revenue", "vs_average_percent")


def rank_roas(facts: DataFrame, start: str, end: str, dim: str = "campaign_id", n: int = 10) -> DataFrame:
    """Best revenue / cost, rows that cost nothing left out, with revenue share."""
    paid = within(facts, start, end).where(
        F.col("cost_per_impression") + F.when(F.col("is_click"), F.col("cost_per_click")).otherwise(0.0) > 0
    )
    groups = performance(
        paid, (dim,), BASE, ("ctr_percent", "cvr_percent"), 0.0,
        (F.col("cost_full") > 0) & (F.col("revenue") > 0),
    ).withColumn("roas", ratio("revenue", "cost_full", 1, 6))
    shared = with_share(groups, many_by=(dim,), revenue_share="revenue")
    return ranked_top(shared, (down("roas"), dim), n)


def top_and_bottom_n(facts: DataFrame, start: str, end: str, n: int = 10) -> DataFrame:
    """Advertisers with the highest and lowest revenue, ranked within their group.

    Two bounded top-n picks over one shuffle instead of two windows over every
    advertiser. With fewer than ``2 n`` of them one advertiser can be in both
    groups and is then shown as top only.
    """
    groups = performance(
        within(facts, start, end), ("advertiser_id",), (*BASE, "active_days"), ("roas_dash",), 0.0
    ).withColumn("ctr3", ratio("clicks", "impressions", 100, 3, 0.0))
    top = ranked_top(groups, (down("revenue"), "advertiser_id"), n, "group_rank")
    low = ranked_top(groups, (F.asc("revenue"), F.desc("advertiser_id")), n, "group_rank")
    both = top.withColumn("group", F.lit("top")).unionByName(low.withColumn("group", F.lit("bottom")))
    return best_per_key(both, "advertiser_id", (F.desc("group"),))


def peak_hour_per_ad(hourly: DataFrame, min_rows: int = 100, n: int = 50) -> DataFrame:
    """Best hour of each ad by CTR, then rows; the best ``n`` ads."""
    hours = performance(
        hourly, ("ad_id", "hour"), ("impressions", "clicks"), ("ctr_percent",), None,
        F.col("impressions") >= min_rows,
    )
    best = best_per_key(hours, "ad_id", (F.desc("ctr_percent"), F.desc("impressions"), "hour"))
    return best.orderBy(F.desc("ctr_percent"), "ad_id").limit(n)


# -------------------------------------------------------------------- funnels


def funnel_events_users(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Impression, click, conversion: events, users and step percentages."""
    user = F.col("user_id")
    total = within(facts, start, end).agg(
        F.count(F.lit(1)).alias("i"),
        F.count_if("is_click").alias("c"),
        F.count_if("is_conversion").alias("v"),
        F.count_distinct(user).alias("ui"),
        F.count_distinct(F.when(F.col("is_click"), user)).alias("uc"),
        F.count_distinct(F.when(F.col("is_conversion"), user)).alias("uv"),
        money_sum(F.when(F.col("is_conversion"), F.col("conversion_value"))).alias("rev"),
    )
    full, c = F.lit(100.0), F.col
    stage = lambda name, events, users, of_first, of_prev, money: F.struct(
        F.lit(name).alias("stage"), c(events).alias("events"), c(users).alias("users"),
        of_first.alias("percent_of_first"), of_prev.alias("percent_of_previous"),
        money.cast("double").alias("revenue"),
    )
    stages = F.array(
        stage("1_impression", "i", "ui", full, full, F.lit(0.0)),
        stage("2_click", "c", "uc", ratio("c", "i", 100), ratio("c", "i", 100), F.lit(0.0)),
        stage("3_conversion", "v", "uv", ratio("v", "i", 100), ratio("v", "c", 100), c("rev")),
    )
    return total.select(F.inline(stages))


def funnel_stages(journeys: DataFrame) -> DataFrame:
    """Five journey stages with their share of impressions, as stacked rows."""
    of_type = lambda t: F.count_distinct(F.when(F.col("conversion_type") == t, F.col("conversion_id")))
    total = journeys.agg(
        F.count_distinct("impression_id").alias("i"),
        F.count_distinct("click_id").alias("c"),
        of_type("view_content").alias("view"),
        of_type("add_to_cart").alias("cart"),
        of_type("purchase").alias("buy"),
    )
    names = (("Impressions", "i"), ("Clicks", "c"), ("View Content", "view"), ("Add to Cart", "cart"), ("Purchase", "buy"))
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("stage"), F.col(col).alias("n"), ratio(col, "i", 100).alias("percentage"))
            for label, col in names
        ]
    )
    return total.select(F.inline(rows))


def compare_periods(facts: DataFrame, first, second) -> DataFrame:
    """Two periods stacked, each with its totals, rates and daily means."""
    parts = []
    for label, (start, end) in (("period_1", first), ("period_2", second)):
        days = days_in(start, end)
        out = performance(
            within(facts, start, end), (), (*BASE, "advertisers", "campaigns"),
            ("roas_dash", "ctr_percent"), 0.0,
        ).withColumns(
            {
                "label": F.lit(label),
                "days": F.lit(days),
                "daily_revenue": mean_per_day("revenue", days),
                "daily_cost": mean_per_day("cost_full", days),
            }
        )
        parts.append(labelled(out, start, end))
    return parts[0].unionByName(parts[1])


def new_advertisers(rows: DataFrame) -> DataFrame:
    """Performance of first-time advertisers; ``rows`` come from the anti join."""
    out = rows.groupBy("advertiser_id").agg(
        F.min("dt").alias("first_day"), *[measure(m) for m in BASE]
    )
    return with_rates(out, ("roas_dash",), 0.0)


# ------------------------------------------------------------------ summaries


def campaign_day_trend(facts: DataFrame) -> DataFrame:
    return performance(
        facts, ("campaign_id", "dt"), ("impressions", "clicks", "conversions"),
        ("ctr_percent", "cvr_percent"), order=("campaign_id", "dt"),
    )


def _daily_rates(facts: DataFrame, keys) -> DataFrame:
    return performance(
        facts, keys, ("impressions", "clicks", "conversions"), ("ctr_percent", "cvr_percent")
    )


def advertiser_efficiency(facts: DataFrame, min_rows: int = 1000, n: int = 20) -> DataFrame:
    """Totals with the mean of daily rates, unweighted, per advertiser."""
    daily = _daily_rates(facts, ("advertiser_id", "dt"))
    out = daily.groupBy("advertiser_id").agg(
        *[F.sum(m).alias(m) for m in ("impressions", "clicks", "conversions")],
        _mean2("ctr_percent", "mean_ctr"), _mean2("cvr_percent", "mean_cvr"),
    )
    return (
        with_rates(out, ("conversions_per_1k",))
        .where(F.col("impressions") > min_rows)
        .orderBy(F.desc("conversions"), "advertiser_id")
        .limit(n)
    )


def _mean2(column: str, name: str, digits: int = 2) -> Column:
    """Mean of values already rounded to two places, summed exactly."""
    exact = F.col(column).cast("decimal(18,4)")
    return half_up(F.sum(exact).cast("double") / F.nullif(F.count(column).cast("double"), F.lit(0.0)), digits).alias(name)


def device_funnel(facts: DataFrame) -> DataFrame:
    return performance(
        facts, ("device_type",), ("impressions", "clicks", "conversions"),
        ("ctr_percent", "cvr_percent", "cvr_on_impressions"),
    )


def weekday_weekend(facts: DataFrame) -> DataFrame:
    """Mean daily counts and rates of weekdays and weekends."""
    daily = _daily_rates(facts, ("dt",)).withColumn("day_type", day_type("dt"))
    return daily.groupBy("day_type").agg(
        F.count(F.lit(1)).alias("days"),
        *[half_up(F.avg(m), 0).alias(f"mean_{m}") for m in ("impressions", "clicks", "conversions")],
        _mean2("ctr_percent", "mean_ctr"), _mean2("cvr_percent", "mean_cvr"),
    )


def weekday_weekend_ctr(facts: DataFrame) -> DataFrame:
    return performance(
        facts.withColumn("day_type", day_type("dt")), ("day_type",), ("impressions", "clicks"), ("ctr_percent",)
    )


def ad_device_top(facts: DataFrame, min_rows: int = 1000, n: int = 20) -> DataFrame:
    daily = _daily_rates(facts, ("ad_id", "device_type", "dt"))
    out = daily.groupBy("ad_id", "device_type").agg(
        *[F.sum(m).alias(m) for m in ("impressions", "clicks", "conversions")],
        _mean2("ctr_percent", "mean_ctr"), _mean2("cvr_percent", "mean_cvr"),
    )
    return (
        with_rates(out, ("conversions_per_1k",))
        .where(F.col("impressions") >= min_rows)
        .orderBy(F.desc("conversions_per_1k"), "ad_id", "device_type")
        .limit(n)
    )


def weekly_report(facts: DataFrame) -> DataFrame:
    week = F.date_trunc("week", F.col("dt")).cast("date")
    return performance(
        facts.withColumn("week_start", week), ("week_start",),
        ("impressions", "clicks", "conversions", "campaigns", "ads"), ("ctr_percent", "cvr_percent"),
    )


def weekday_hour_heatmap(hourly: DataFrame, min_rows: int = 100) -> DataFrame:
    return performance(
        hourly.withColumn("weekday", iso_weekday("dt")), ("weekday", "hour"),
        ("impressions", "clicks"), ("ctr_percent",), having=F.col("impressions") >= min_rows,
    )


def heatmap_grid(heatmap: DataFrame) -> DataFrame:
    """The heatmap with one column per weekday."""
    return heatmap.groupBy("hour").pivot("weekday", list(range(1, 8))).agg(F.first("ctr_percent")).select(
        "hour", *[F.col(str(i)).alias(f"weekday_{i}") for i in range(1, 8)]
    )


def hour_of_day_stats(rows: DataFrame) -> DataFrame:
    hours = rows.groupBy("dt", "hour").agg(F.count(F.lit(1)).alias("n"))
    return hours.groupBy("hour").agg(
        F.avg("n").alias("mean_impressions"), F.max("n").alias("max_impressions"), F.min("n").alias("min_impressions")
    )


def realtime_today(hourly: DataFrame, day: str) -> DataFrame:
    """Today so far from the hourly fact, which knows no conversions."""
    return performance(
        within(hourly, day, day), (), ("advertisers", "cost_full", "clicks", "impressions"), ("ctr_percent",), 0.0
    ).withColumn("day", F.lit(day))


def preagg_daily(summary: DataFrame) -> DataFrame:
    """Re-aggregate pre-summed rows by day; the CPC is a mean of means."""
    out = summary.groupBy("dt").agg(
        *[F.sum(m).alias(m) for m in ("impressions", "clicks", "conversions")],
        half_up(F.avg("avg_cpc"), 2).alias("avg_cpc"),
    )
    return with_rates(out, ("ctr_percent", "cvr_percent"))


def preagg_campaign(summary: DataFrame, n: int = 20) -> DataFrame:
    out = summary.groupBy("campaign_id").agg(
        *[F.sum(m).alias(m) for m in ("impressions", "clicks", "conversions", "cost_full")]
    )
    return with_rates(out, ("ctr_percent", "cvr_percent", "cpc_full", "cpa_full")).orderBy(
        F.desc("impressions"), "campaign_id"
    ).limit(n)


def distinct_values_joined(df: DataFrame, key: str, value: str, name: str = "joined") -> DataFrame:
    """Distinct values per key in one sorted text. Copies are dropped first, so
    the list gathered per key is only as long as the number of values."""
    return df.select(key, value).distinct().groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_set(value)), ",").alias(name)
    )


# Click delay buckets as (limit, label), limits excluded.
DELAY_STEPS = ((10, "under 10"), (30, "10 to 30"), (60, "30 to 60"), (300, "60 to 300"))
DELAY_LABELS = (*(label for _, label in DELAY_STEPS), "300 and over")


def click_delay_histogram(hourly: DataFrame, unit_ms: int = 1000) -> DataFrame:
    """Clicked rows by time from impression to click, in units of ``unit_ms``."""
    delay = (F.col("click_timestamp") - F.col("impression_timestamp")) / F.lit(float(unit_ms))
    label = bucket(delay, DELAY_STEPS, DELAY_LABELS[-1], strict=True)
    counts = (
        hourly.where(F.col("is_click") & F.col("click_timestamp").isNotNull())
        .groupBy(label.alias("click_delay"))
        .agg(F.count(F.lit(1)).alias("clicks"))
    )
    shared = with_share(counts, 2, percentage="clicks")
    return shared.orderBy(rank_of_label(F.col("click_delay"), DELAY_LABELS))


def _is(kind: str) -> Column:
    return F.count_if(F.col("event_type") == kind)


def five_minute_traffic(events: DataFrame, time: str = "ts") -> DataFrame:
    counts = events.groupBy(F.window(time, "5 minutes").alias("_w")).agg(
        _is("impression").alias("impressions"), _is("click").alias("clicks")
    )
    return counts.select(
        F.col("_w.start").alias("bucket"), "impressions", "clicks",
        ratio("clicks", "impressions", 100).alias("ctr"),
    )


def minute_event_counts(events: DataFrame, time: str = "ts") -> DataFrame:
    return events.groupBy(F.date_trunc("minute", time).alias("minute"), "event_type").agg(
        F.count(F.lit(1)).alias("event_count")
    )


def latest_ctr_alert(events: DataFrame, time: str = "ts", critical: float = 1.0, warning: float = 1.5) -> DataFrame:
    """CTR of the newest hour and its alert level."""
    hours = events.groupBy(F.date_trunc("hour", time).alias("hour")).agg(
        _is("impression").alias("_i"), _is("click").alias("_c")
    )
    newest = hours.orderBy(F.desc("hour")).limit(1).select("hour", ratio("_c", "_i", 100).alias("ctr"))
    level = F.when(F.col("ctr") < critical, "CRITICAL").when(F.col("ctr") < warning, "WARNING").otherwise("OK")
    return newest.withColumn("status", level)


def ordered_range_scan(rows: DataFrame, start: str, end: str, key: str, n: int | None = None) -> DataFrame:
    """Rows of the range, newest first; with ``n`` only a bounded top is gathered."""
    out = within(rows, start, end).orderBy(F.desc("timestamp"), key)
    return out if n is None else out.limit(n)


# Fixed value: rows shown when the caller names no limit.
DEFAULT_LIMIT = 1000


def default_limit(df: DataFrame, n: int | None = None) -> DataFrame:
    return df.limit(DEFAULT_LIMIT if n is None else n)
