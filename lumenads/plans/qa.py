"""Ground-truth question set over the facts. Empty denominators give null here."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenads.functions.metrics import MONEY, change_rate, half_up, performance_needs, ratio, summarise, with_rates
from lumenads.operators.performance import nth_row, performance
from lumenads.plans.reports import down, up, within


@dataclass(frozen=True)
class Question:
    """One golden query: what is grouped, measured, filtered and shown."""

    dims: tuple = ()
    measures: tuple = ()
    rates: tuple = ()
    show: tuple = ()
    where: tuple = ()
    having: str | None = None
    order: tuple = ()
    n: int | None = None
    needs: tuple = field(default=())

    def columns(self) -> tuple:
        return performance_needs(self.measures, ("dt", *self.dims, *self.needs))


def _order(name: str) -> Column:
    return down(name[1:]) if name.startswith("-") else up(name)


def ask(question: Question, facts: DataFrame, *periods) -> DataFrame:
    """Rows of the question over one period, or over several joined by OR."""
    inside = F.lit(False)
    for start, end in periods:
        inside = inside | F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    rows = facts.where(inside)
    for column, value in question.where:
        rows = rows.where(F.col(column).isNotNull() if value is None else F.col(column) == value)
    out = performance(
        rows, question.dims, question.measures, question.rates,
        having=None if question.having is None else F.expr(question.having),
    )
    out = out.orderBy(*[_order(o) for o in question.order]) if question.order else out
    out = out if question.n is None else out.limit(question.n)
    return out.select(*question.dims, *(question.show or (*question.measures, *question.rates)))


def golden(region: str, device: str) -> dict[str, Question]:
    """The question set. ``region`` and ``device`` are what it asks about by name."""
    c, conv, imp = "clicks", "conversions", "impressions"
    Q = Question
    return {
        "T001": Q(("campaign_id",), (c, imp), ("ctr_percent",), ("ctr_percent",), order=("-ctr_percent", "campaign_id")),
        "T004": Q(("campaign_id",), (c, conv), ("cvr_percent",), ("cvr_percent",), order=("-cvr_percent", "campaign_id"), n=5),
        "T007": Q(("delivery_region",), (imp,), order=("-impressions", "delivery_region")),
        "T008": Q(("device_type",), (c,), order=("-clicks", "device_type")),
        "T009": Q((), ("revenue",), where=(("is_conversion", True),)),
        "T010": Q(("hour",), (imp,), order=("hour",)),
        "T015": Q(("campaign_id",), (imp,), order=("-impressions", "campaign_id")),
        "T016": Q((), (c,), where=(("delivery_region", region),), needs=("delivery_region",)),
        "T019": Q(("hour",), (c,), order=("hour",)),
        "T021": Q((), (imp, c, conv), ("ctr_percent",)),
        "T022": Q(("campaign_id",), (imp, c, conv), ("ctr_percent", "cvr_percent"), order=("-impressions", "campaign_id")),
        "T023": Q(("food_category",), (c, imp), ("ctr_percent",), ("ctr_percent",), order=("-ctr_percent", "food_category"), n=10),
        "T026": Q(("campaign_id",), (c, conv), show=(c,), having="clicks > 0 AND conversions = 0", order=("-clicks", "campaign_id")),
        "T027": Q(("advertiser_id",), (imp, "cost_null_trap", "revenue"), ("roas_qa",), order=("-roas_qa", "advertiser_id")),
        "T031": Q(("keyword",), (c,), where=(("keyword", None),), order=("-clicks", "keyword"), n=10),
        "T032": Q(("store_id",), ("revenue",), where=(("is_conversion", True),), order=("-revenue", "store_id"), n=5),
        "T033": Q(("delivery_region",), (imp, c, conv), ("ctr_percent",), (imp, "ctr_percent", conv), order=("-impressions", "delivery_region")),
        "T035": Q(("hour",), (imp, c), order=("hour",)),
        "T036": Q(("dt",), (imp,), order=("dt",)),
        "T038": Q(("campaign_id",), (imp,), order=("-impressions", "campaign_id")),
        "T040": Q(("advertiser_id",), ("revenue",), where=(("is_conversion", True),), order=("-revenue", "advertiser_id")),
        "T042": Q(("ad_format",), (c,), order=("-clicks", "ad_format")),
        "T046": Q((), (imp, c, conv), ("ctr_percent",)),
        "T048": Q(("device_type",), (imp, c, conv), order=("-impressions", "device_type")),
        "T050": Q(("food_category",), (imp, conv), order=("-conversions", "food_category"), n=10),
        "T052": Q(("dt", "platform"), (imp,), order=("dt", "-impressions", "platform")),
        "T054": Q(("ad_position",), (conv, c), ("cvr_percent",), ("cvr_percent",), order=("-cvr_percent", "ad_position")),
        "T061": Q(("campaign_id",), (imp, c), show=(imp,), having="clicks = 0", order=("-impressions", "campaign_id")),
        "T062": Q(("campaign_id",), (c, imp, conv), ("ctr_percent",), ("ctr_percent",), having="ctr_percent > 5.0 AND conversions = 0", order=("-ctr_percent", "campaign_id")),
        "T063": Q(("advertiser_id",), ("revenue", "cost_null_trap"), ("roas_qa",), ("roas_qa", "revenue"), order=("-roas_qa", "advertiser_id"), n=5),
        "T064": Q(("year", "month"), (imp, c, conv), order=("year", "month")),
        "T065": Q(("campaign_id",), (c, imp), ("ctr_percent",), ("ctr_percent",), where=(("device_type", device),), order=("-ctr_percent", "campaign_id"), n=5, needs=("device_type",)),
        "T066": Q(("campaign_id",), ("cost_null_trap", conv), ("cpa_qa",), ("cpa_qa",), having="conversions > 0", order=("cpa_qa", "campaign_id"), n=5),
    }


def half_day_clicks(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Clicks before and from noon."""
    half = F.when(F.col("hour").cast("int") < 12, "morning").otherwise("afternoon")
    return performance(within(facts, start, end).withColumn("time_period", half), ("time_period",), ("clicks",))


def conversion_types(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Count, revenue and mean value per conversion type."""
    out = performance(within(facts, start, end).where("is_conversion"), ("conversion_type",), ("conversions", "revenue"))
    return out.withColumn("mean_value", ratio("revenue", "conversions", 1, None)).orderBy(down("revenue"), "conversion_type")


def mean_daily_ctr(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Mean of the rounded daily CTRs of each campaign."""
    daily = performance(within(facts, start, end), ("dt", "campaign_id"), ("clicks", "impressions"), ("ctr_percent",))
    exact = F.sum(F.col("ctr_percent").cast("decimal(18,4)")).cast("double")
    return daily.groupBy("campaign_id").agg(
        (exact / F.nullif(F.count("ctr_percent").cast("double"), F.lit(0.0))).alias("mean_ctr")
    )


# --------------------------------------------------------------------- seeds


def period_growth(facts: DataFrame, current, previous, measures=("impressions",), rates=()) -> DataFrame:
    """Measures of two periods on one row, from one conditional scan, and their growth."""
    now = F.col("dt").between(*[F.lit(x).cast("date") for x in current])
    before = F.col("dt").between(*[F.lit(x).cast("date") for x in previous])
    tagged = facts.where(now | before).withColumn("_p", F.when(now, "this").otherwise("last"))
    totals = with_rates(summarise(tagged, ("_p",), measures), rates)
    shown = (*measures, *rates)
    at = lambda tag, v: F.max(F.when(F.col("_p") == tag, F.col(v)))
    wide = totals.agg(
        *[at("last", v).alias(f"last_{v}") for v in shown],
        *[at("this", v).alias(f"this_{v}") for v in shown],
    )
    growth = [change_rate(f"this_{m}", f"last_{m}").alias(f"{m}_growth") for m in measures]
    gaps = [half_up(F.col(f"this_{x}") - F.col(f"last_{x}"), 2).alias(f"{x}_growth") for x in rates]
    return wide.select("*", *growth, *gaps)


def spend_growth_by_key(facts: DataFrame, key: str, current, previous) -> DataFrame:
    """Spend of this and last period by key; no spend last period counts as 0."""
    spend = lambda p: summarise(within(facts, *p), (key,), ("cost_null_trap",))
    this = spend(current).withColumnRenamed("cost_null_trap", "this_spend")
    last = spend(previous).withColumnRenamed("cost_null_trap", "last_spend")
    zero = F.lit(0).cast(MONEY)
    return this.join(last, key, "left").select(
        key, F.coalesce("last_spend", zero).alias("last_spend"), "this_spend",
        (F.col("this_spend") - F.coalesce("last_spend", zero)).alias("spend_growth"),
    )


def roas_threshold(facts: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Groups whose revenue covers their spend."""
    return performance(
        within(facts, start, end), (key,), ("revenue", "cost_null_trap"), ("roas_qa",),
        having=F.col("revenue") >= F.col("cost_null_trap"), order=(down("roas_qa"), key),
    )


def below_average(facts: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Groups whose CTR is under the unweighted mean of all groups."""
    groups = performance(within(facts, start, end), (key,), ("clicks", "impressions"), ("ctr_percent",))
    exact = F.sum(F.col("ctr_percent").cast("decimal(18,4)")).cast("double")
    mean = groups.agg(half_up(exact / F.count("ctr_percent").cast("double"), 6).alias("mean_ctr"))
    out = groups.crossJoin(F.broadcast(mean)).where(F.col("ctr_percent") < F.col("mean_ctr"))
    return out.select(key, "ctr_percent", "mean_ctr", half_up(F.col("ctr_percent") - F.col("mean_ctr"), 2).alias("ctr_gap"))


def peak_row(facts: DataFrame, key: str, measure: str, start: str, end: str) -> DataFrame:
    """The single best hour or day."""
    return performance(within(facts, start, end), (key,), (measure,), order=(down(measure), key), n=1)


def monthly_roas(facts: DataFrame, start: str, end: str) -> DataFrame:
    out = performance(within(facts, start, end), ("year", "month"), ("revenue", "cost_null_trap"), order=("year", "month"))
    return out.withColumn("roas_percent", ratio("revenue", "cost_null_trap", 100, 2))


def hour_by(facts: DataFrame, dim: str, start: str, end: str) -> DataFrame:
    return performance(
        within(facts, start, end), (dim, "hour"), ("impressions", "clicks"), ("ctr_percent",), order=(dim, "hour")
    )


def campaign_spend(facts: DataFrame, start: str, end: str, by_day: bool = False) -> DataFrame:
    dims = ("campaign_id", "dt") if by_day else ("campaign_id",)
    return performance(
        within(facts, start, end), dims, ("cost_null_trap", "cost_click", "clicks", "conversions"), ("cpa_qa", "cpc"), order=dims
    )


def nth_rank(facts: DataFrame, dim: str, start: str, end: str, n: int = 2) -> DataFrame:
    """The group with the n-th most clicks."""
    groups = summarise(within(facts, start, end), (dim,), ("clicks",))
    return nth_row(groups, (F.desc("clicks"), dim), n)
