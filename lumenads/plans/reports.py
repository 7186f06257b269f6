"""Report sections over the daily fact."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenads.functions.dates import (
    date_between,
    day_grid,
    previous_week,
    same_range_previous_month,
    week_calendar,
)
from lumenads.functions.metrics import change_rate, measure, performance_needs, ratio, summarise, with_rates
from lumenads.operators.joins import with_previous
from lumenads.operators.performance import performance, shared_rows

KPI_MEASURES = (
    "impressions_distinct",
    "clicks",
    "conversions_purchase",
    "cost_click",
    "revenue_purchase",
)
KPI_RATES = ("ctr_distinct", "cvr_purchase", "cpc", "roas_report")
KPI_COLUMNS = performance_needs(KPI_MEASURES, ("dt",))
# Purchase funnel stages in order.
FUNNEL_STAGES = ("view_content", "add_to_cart", "purchase")


def up(name: str) -> Column:
    return F.asc_nulls_last(name)


def down(name: str) -> Column:
    return F.desc_nulls_last(name)


def within(facts: DataFrame, start: str, end: str) -> DataFrame:
    return facts.where(date_between(start, end, F.col("dt")))


def monday_of(day: str) -> str:
    """First day of the week, which a calendar of weeks may reach back to."""
    found = date.fromisoformat(day)
    return (found - timedelta(days=found.weekday())).isoformat()


def kpi_summary(facts: DataFrame, start: str, end: str) -> DataFrame:
    """One row: purchase KPIs of the period."""
    return performance(within(facts, start, end), (), KPI_MEASURES, KPI_RATES)


def kpi_daily(facts: DataFrame, start: str, end: str) -> DataFrame:
    return performance(
        within(facts, start, end), ("dt",), KPI_MEASURES, ("ctr_distinct", "roas_report"), order=("dt",)
    )


def kpi_weekly(facts: DataFrame, start: str, end: str, strict_month: bool = True) -> DataFrame:
    """KPIs per calendar week of the range.

    The calendar has one row per day of the range, which bounds its broadcast.
    """
    weeks = week_calendar(day_grid(facts.sparkSession, start, end), start, end, strict_month)
    rows = within(facts, monday_of(start), end).join(F.broadcast(weeks), "dt")
    return performance(rows, ("week_start", "week_end"), KPI_MEASURES, KPI_RATES, order=("week_start",))


def kpi_weekly_days(facts: DataFrame, start: str, end: str, strict_month: bool = True) -> DataFrame:
    """The days of each calendar week of the range."""
    weeks = week_calendar(day_grid(facts.sparkSession, start, end), start, end, strict_month)
    rows = within(facts, monday_of(start), end).join(F.broadcast(weeks), "dt")
    return performance(
        rows, ("week_start", "dt"), KPI_MEASURES, ("ctr_distinct", "roas_report"), order=("week_start", "dt")
    )


def _two_periods(facts: DataFrame, current, previous) -> DataFrame:
    """Rows of either period, tagged; one scan serves both."""
    now = date_between(*current, F.col("dt"))
    before = date_between(*previous, F.col("dt"))
    return facts.where(now | before).withColumn(
        "_period", F.when(now, F.lit("current")).otherwise("previous")
    )


def _side_by_side(df: DataFrame, values) -> DataFrame:
    """Two tagged rows as one row with ``prev_`` columns."""
    at = lambda tag, v: F.max(F.when(F.col("_period") == tag, F.col(v)))
    return df.agg(
        *[at("current", v).alias(v) for v in values],
        *[at("previous", v).alias(f"prev_{v}") for v in values],
    )


def kpi_prev_month(facts: DataFrame, start: str, end: str) -> DataFrame:
    """KPIs of the range beside the same days of the month before."""
    rows = _two_periods(facts, (start, end), same_range_previous_month(start, end))
    both = with_rates(summarise(rows, ("_period",), KPI_MEASURES), KPI_RATES)
    out = _side_by_side(both, (*KPI_MEASURES, *KPI_RATES))
    return out.withColumn(
        "revenue_change", change_rate("revenue_purchase", "prev_revenue_purchase")
    ).withColumn("ctr_change", change_rate("ctr_distinct", "prev_ctr_distinct"))


def kpi_prev_week(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Each week of the range beside the week before it.

    The week before the first one is taken whole, from Monday to Sunday.
    """
    spark = facts.sparkSession
    weeks = week_calendar(day_grid(spark, start, end), start, end)
    lead_in = previous_week(start, start)[0]
    before = (
        spark.range(1)
        .select(F.date_trunc("week", F.lit(lead_in).cast("date")).cast("date").alias("week_start"))
        .withColumn("week_end", F.date_add("week_start", 6))
        .withColumn("dt", F.explode(F.sequence("week_start", "week_end")))
    )
    calendar = weeks.unionByName(before.select(*weeks.columns))
    rows = within(facts, monday_of(lead_in), end).join(F.broadcast(calendar), "dt")
    weekly = with_rates(summarise(rows, ("week_start", "week_end"), KPI_MEASURES), KPI_RATES)
    w = W.orderBy("week_start")
    shown = ("impressions_distinct", "clicks", "revenue_purchase", "roas_report")
    return (
        weekly.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in shown])
        .withColumn("revenue_change", change_rate("revenue_purchase", "prev_revenue_purchase"))
        .where(F.col("week_start") >= F.lit(start).cast("date"))
    )


def category_performance(facts: DataFrame, start: str, end: str) -> DataFrame:
    return performance(
        within(facts, start, end),
        ("food_category",),
        KPI_MEASURES,
        ("ctr_distinct", "cvr_purchase", "roas_report"),
        order=(down("revenue_purchase"), "food_category"),
    )


def category_with_previous(facts: DataFrame, current, previous) -> DataFrame:
    """Category table with the revenue of the previous period."""
    before = summarise(within(facts, *previous), ("food_category",), ("revenue_purchase",))
    return with_previous(
        category_performance(facts, *current), before, ["food_category"], ["revenue_purchase"]
    ).withColumn("revenue_change", change_rate("revenue_purchase", "prev_revenue_purchase"))


_SHOP = ("store_id", "food_category")
_SHOP_MEASURES = KPI_MEASURES
_SHOP_RATES = ("ctr_distinct", "roas_report")


def shop_top_n(facts: DataFrame, start: str, end: str, n: int = 5) -> DataFrame:
    return performance(
        within(facts, start, end), _SHOP, _SHOP_MEASURES, _SHOP_RATES,
        order=(down("revenue_purchase"), *_SHOP), n=n,
    )


def shop_bottom_n(facts: DataFrame, start: str, end: str, n: int = 5, min_impressions: int = 100) -> DataFrame:
    return performance(
        within(facts, start, end), _SHOP, _SHOP_MEASURES, _SHOP_RATES,
        having=F.col("impressions_distinct") >= min_impressions,
        order=(up("roas_report"), *_SHOP), n=n,
    )


def shop_top_with_previous(facts: DataFrame, current, previous, n: int = 5) -> DataFrame:
    before = summarise(within(facts, *previous), _SHOP, ("revenue_purchase",))
    return with_previous(shop_top_n(facts, *current, n=n), before, list(_SHOP), ["revenue_purchase"])


def funnel_counts(facts: DataFrame, start: str, end: str) -> DataFrame:
    return (
        within(facts, start, end)
        .groupBy("conversion_type")
        .agg(F.count_if("is_conversion").alias("n"))
        .orderBy(up("conversion_type"))
    )


def funnel_with_previous(facts: DataFrame, current, previous) -> DataFrame:
    before = within(facts, *previous).groupBy("conversion_type").agg(
        F.count_if("is_conversion").alias("n")
    )
    return with_previous(funnel_counts(facts, *current), before, ["conversion_type"], ["n"])


def funnel_rates(counts: DataFrame, stages=FUNNEL_STAGES) -> DataFrame:
    """Stages in order: percent of the first stage and of the previous present one.

    Without a first stage the count is compared with 1, as the reports do.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("conversion_type"))
    listed = counts.where(F.col("conversion_type").isin(*stages)).withColumn("stage_no", place)
    first = F.max(F.when(F.col("conversion_type") == stages[0], F.col("n"))).over(W.partitionBy())
    w = W.orderBy("stage_no")
    return listed.withColumns(
        {"_first": F.coalesce(first, F.lit(1)), "_prev": F.lag("n").over(w)}
    ).select(
        "stage_no",
        F.col("conversion_type").alias("stage"),
        "n",
        ratio("n", "_first", 100, 2, empty=0.0).alias("percent_of_first"),
        ratio("n", "_prev", 100, 1).alias("percent_of_previous"),
    )


def yesterday_vs_mtd(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Month-to-date KPIs beside those of the last day; a missing day is null."""
    rows = within(facts, start, end)
    total = performance(rows, (), KPI_MEASURES, KPI_RATES)
    last = performance(within(facts, end, end), ("dt",), KPI_MEASURES, ("ctr_distinct", "roas_report"))
    last = last.select(*[F.col(c).alias(f"day_{c}") for c in last.columns])
    return total.join(F.broadcast(last), F.lit(True), "left")


# ------------------------------------------------------------- rule sections

# Limits of the action rules.
ALERT_RULES = {
    "roas_stop": 100.0,
    "roas_reduce": 200.0,
    "roas_increase": 500.0,
    "ctr_drop": 10.0,
    "cvr_drop": 10.0,
    "cpc_increase": 15.0,
    "revenue_growth": 20.0,
    "funnel_drop": 5.0,
    "target_critical": 80.0,
    "min_impressions": 100,
}
ACTION_COLUMNS = performance_needs(KPI_MEASURES, ("dt", "store_id", "food_category", "is_conversion"))


class _RuleTotals:
    """All that the rules read, from one scan: measures by shop, category and conversion
    type and in all, of both periods. Facts are reduced by (key, impression) inside
    tasks first, which leaves one row per impression for the counts of distinct ones
    and a handful for the keys that need none. One row per key and period comes of
    it, shuffled once for all rules; nothing runs before the result is asked for."""

    KEYS = ("store_id", "food_category", "conversion_type")
    ALL = "all"

    def __init__(self, facts: DataFrame, current, previous, measures):
        self.measures = tuple(dict.fromkeys((*KPI_MEASURES, *measures)))
        # distinct impressions are counted by shop and category, and in all if a target asks for it
        counted = {"store_id", "food_category"} | ({self.ALL} if "impressions_distinct" in measures else set())
        nothing = F.lit(None).cast("string")
        sets = [
            F.struct(
                F.lit(key).alias("key"),
                (nothing if key == self.ALL else F.col(key)).alias("value"),
                (F.col("impression_id") if key in counted else nothing).alias("id"),
            )
            for key in (*self.KEYS, self.ALL)
        ]
        added = [m for m in self.measures if m != "impressions_distinct"]
        keys = ("_key", "_value", "_period")
        each = (
            _two_periods(facts, current, previous)
            .withColumn("_set", F.explode(F.array(*sets)))
            .groupBy(F.col("_set.key").alias("_key"), F.col("_set.value").alias("_value"), "_period", F.col("_set.id").alias("_id"))
            .agg(*[measure(m) for m in added], F.count_if("is_conversion").alias("n"))
        )
        kinds = {f.name: f.dataType for f in each.schema}
        totals = each.groupBy(*keys).agg(
            F.count("_id").alias("impressions_distinct"),
            *[F.sum(m).cast(kinds[m]).alias(m) for m in (*added, "n")],
        )
        self.rows = shared_rows(totals, keys)

    def by(self, key: str = ALL) -> DataFrame:
        return self.rows.where(F.col("_key") == key).select(
            F.col("_value").alias(key), "_period", *self.measures, "n"
        )

    def shops(self, having) -> DataFrame:
        now = self.by("store_id").where(F.col("_period") == "current")
        return with_rates(now.select("store_id", *KPI_MEASURES), ("roas_report",)).where(having)

    def categories(self) -> DataFrame:
        both = with_rates(
            self.by("food_category").select("food_category", "_period", *KPI_MEASURES),
            ("ctr_distinct", "cvr_purchase"),
        )
        shown = ("ctr_distinct", "cvr_purchase", "revenue_purchase")
        at = lambda tag, v: F.max(F.when(F.col("_period") == tag, F.col(v).cast("double")))
        wide = both.groupBy("food_category").agg(
            *[at("current", v).alias(v) for v in shown],
            *[at("previous", v).alias(f"prev_{v}") for v in shown],
        )
        return wide.select("*", *[change_rate(v, f"prev_{v}").alias(f"{v}_change") for v in shown])

    def overall(self) -> DataFrame:
        both = with_rates(self.by().select("_period", "cost_click", "clicks"), ("cpc",))
        return _side_by_side(both, ("cpc",)).withColumn("cpc_change", change_rate("cpc", "prev_cpc"))

    def funnel(self) -> DataFrame:
        counts = self.by("conversion_type")

        def rates(period: str, name: str) -> DataFrame:
            rows = counts.where((F.col("_period") == period) & F.col("conversion_type").isNotNull())
            return funnel_rates(rows.select("conversion_type", "n")).select(
                "stage", F.col("percent_of_previous").alias(name)
            )

        return rates("current", "now").join(rates("previous", "before"), "stage", "inner")

    def goals(self, targets: dict[str, float]) -> DataFrame:
        now = self.by().where(F.col("_period") == "current")
        return _attained(now.agg(*[F.max(name).alias(name) for name in targets]), targets)


def attainment(facts: DataFrame, start: str, end: str, targets: dict[str, float]) -> DataFrame:
    """Actual, target and percent per named KPI of the period."""
    return _attained(summarise(within(facts, start, end), (), tuple(targets)), targets)


def _attained(total: DataFrame, targets: dict[str, float]) -> DataFrame:
    """One row per target from the one row of actual values."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("kpi"),
                F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias("actual"),
                F.lit(float(goal)).alias("target"),
            )
            for name, goal in targets.items()
        ]
    )
    return total.select(F.explode(entries).alias("_e")).select(
        "_e.*", ratio("_e.actual", "_e.target", 100, 1).alias("percent")
    )


def action_items(
    facts: DataFrame, current, previous, targets: dict[str, float], rules: dict | None = None
) -> DataFrame:
    """Rule table: what to do, for what, and the numbers it rests on."""
    limit = {**ALERT_RULES, **(rules or {})}
    totals = _RuleTotals(facts, current, previous, targets)
    shops = totals.shops(F.col("impressions_distinct") >= limit["min_impressions"])
    categories, overall, funnel = totals.categories(), totals.overall(), totals.funnel()
    goals = totals.goals(targets)

    c = F.col
    roas = c("roas_report")
    parts = [
        _emit(
            shops,
            (roas < limit["roas_stop"], "urgent", "pause_campaign", c("store_id"), roas, None),
            (
                (roas >= limit["roas_stop"]) & (roas <= limit["roas_reduce"]),
                "high", "lower_bid", c("store_id"), roas, None,
            ),
            (roas > limit["roas_increase"], "medium", "raise_budget", c("store_id"), roas, None),
        ),
        _emit(
            overall,
            (
                c("cpc_change") >= limit["cpc_increase"],
                "medium", "watch_cpc", F.lit("all"), c("cpc"), c("prev_cpc"),
            ),
        ),
        _emit(
            categories,
            (
                c("ctr_distinct_change") <= -limit["ctr_drop"],
                "high", "check_creative", c("food_category"), c("ctr_distinct"), c("prev_ctr_distinct"),
            ),
            (
                c("cvr_purchase_change") <= -limit["cvr_drop"],
                "medium", "check_landing", c("food_category"), c("cvr_purchase"), c("prev_cvr_purchase"),
            ),
            (
                c("revenue_purchase_change") >= limit["revenue_growth"],
                "info", "extend_budget", c("food_category"), c("revenue_purchase"), c("prev_revenue_purchase"),
            ),
        ),
        _emit(
            funnel,
            (
                c("now") - c("before") <= -limit["funnel_drop"],
                "medium", "check_funnel", c("stage"), c("now"), c("before"),
            ),
        ),
        _emit(
            goals,
            (
                c("percent") < limit["target_critical"],
                "urgent", "target_missed", c("kpi"), c("actual"), c("target"),
            ),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def _emit(df: DataFrame, *rules) -> DataFrame:
    """One row per rule that holds; all rules of a frame share its single pass."""
    items = [
        F.when(
            condition,
            F.struct(
                F.lit(priority).alias("priority"),
                F.lit(rule).alias("rule"),
                target.alias("target"),
                now.cast("double").alias("current_value"),
                (F.lit(None) if before is None else before).cast("double").alias("previous_value"),
            ),
        )
        for condition, priority, rule, target, now, before in rules
    ]
    held = F.filter(F.array(*items), lambda item: item.isNotNull())
    return df.select(F.explode(held).alias("_i")).select("_i.*")


def highlights(
    facts: DataFrame, current, previous, targets: dict[str, float], rules: dict | None = None
) -> DataFrame:
    """Best and worst of the period: one row per kind that has a candidate."""
    limit = {**ALERT_RULES, **(rules or {})}
    c = F.col
    totals = _RuleTotals(facts, current, previous, targets)
    categories = totals.categories()
    shops = totals.shops(
        (c("impressions_distinct") >= limit["min_impressions"]) & (c("roas_report") <= limit["roas_stop"])
    )

    def best(kind, name, value, highest: bool, eligible=None):
        """First by value, ties by name, of the rows that qualify."""
        order = F.struct((-value if highest else value).alias("v"), name.alias("n"))
        able = value.isNotNull() if eligible is None else value.isNotNull() & eligible
        row = F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"))
        return F.min_by(F.when(able, row), F.when(able, order))

    def picked(df, *bests):
        held = F.filter(F.array(*bests), lambda item: item.isNotNull())
        return df.agg(held.alias("_b")).select(F.explode("_b").alias("_i")).select("_i.*")

    drop = F.least("ctr_distinct_change", "cvr_purchase_change")
    category, shop = c("food_category"), c("store_id")
    parts = [
        picked(
            categories,
            best("best_growth", category, c("revenue_purchase_change"), True),
            best("worst_drop", category, drop, False, drop <= -min(limit["ctr_drop"], limit["cvr_drop"])),
        ),
        picked(totals.goals(targets), best("best_target", c("kpi"), c("percent"), True)),
        picked(shops, best("worst_shop", shop, c("roas_report"), False)),
    ]
    return reduce(DataFrame.unionByName, parts)
