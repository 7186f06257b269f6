"""Golden questions and seed queries."""

from __future__ import annotations

from lumenads.functions.metrics import performance_needs
from lumenads.plans import qa
from lumenads.plans.testbed import ad_facts
from lumenads.registry.core import FACTS, WHOLE, between, div, grouped, pick, r, rates, register

DAY = ("1999-12-01", "1999-12-01")
WEEK = ("1999-11-29", "1999-12-05")
MONTH = ("1999-12-01", "1999-12-31")
BEFORE = ("1999-11-01", "1999-11-30")
REGION, DEVICE = "NATION_3", "1-URGENT"
QUESTIONS = qa.golden(REGION, DEVICE)

# key -> (name, periods, SQL text)
_c, _v, _i = "clicks", "conversions", "impressions"


def _sql(dims, measures, period, show=None, extra="TRUE", rate_names=(), having="TRUE", tail=""):
    where = f"({' OR '.join(between(p) for p in period)}) AND {extra}"
    shown = ", ".join((*dims, *(show or (*measures, *rate_names))))
    return f"SELECT {shown} FROM ({grouped(dims, measures, where, rate_names, having=having, tail=tail)})"


_SET = {
    "T001": ("campaign_ctr", [DAY], dict(dims=("campaign_id",), measures=(_c, _i), rate_names=("ctr_percent",), show=("ctr_percent",))),
    "T004": ("campaign_cvr_top5", [DAY], dict(dims=("campaign_id",), measures=(_c, _v), rate_names=("cvr_percent",), show=("cvr_percent",), tail="ORDER BY cvr_percent DESC, campaign_id LIMIT 5")),
    "T007": ("region_impressions", [DAY], dict(dims=("delivery_region",), measures=(_i,))),
    "T008": ("device_clicks", [DAY], dict(dims=("device_type",), measures=(_c,))),
    "T009": ("total_revenue", [DAY], dict(dims=(), measures=("revenue",), extra="is_conversion")),
    "T010": ("hourly_impressions", [DAY], dict(dims=("hour",), measures=(_i,))),
    "T015": ("campaign_impressions_month", [MONTH], dict(dims=("campaign_id",), measures=(_i,))),
    "T016": ("region_clicks", [MONTH], dict(dims=(), measures=(_c,), extra=f"delivery_region = '{REGION}'")),
    "T019": ("hourly_clicks", [DAY], dict(dims=("hour",), measures=(_c,))),
    "T021": ("day_totals", [DAY], dict(dims=(), measures=(_i, _c, _v), rate_names=("ctr_percent",))),
    "T022": ("campaign_detail", [DAY], dict(dims=("campaign_id",), measures=(_i, _c, _v), rate_names=("ctr_percent", "cvr_percent"))),
    "T023": ("category_ctr_top10", [DAY], dict(dims=("food_category",), measures=(_c, _i), rate_names=("ctr_percent",), show=("ctr_percent",), tail="ORDER BY ctr_percent DESC, food_category LIMIT 10")),
    "T026": ("clicks_no_conversion", [DAY], dict(dims=("campaign_id",), measures=(_c, _v), show=(_c,), having="clicks > 0 AND conversions = 0")),
    "T027": ("advertiser_roas", [MONTH], dict(dims=("advertiser_id",), measures=(_i, "cost_null_trap", "revenue"), rate_names=("roas_qa",))),
    "T031": ("keyword_clicks_top10", [MONTH], dict(dims=("keyword",), measures=(_c,), extra="keyword IS NOT NULL", tail="ORDER BY clicks DESC, keyword LIMIT 10")),
    "T032": ("store_revenue_top5", [DAY], dict(dims=("store_id",), measures=("revenue",), extra="is_conversion", tail="ORDER BY revenue DESC, store_id LIMIT 5")),
    "T033": ("region_detail", [DAY], dict(dims=("delivery_region",), measures=(_i, _c, _v), rate_names=("ctr_percent",), show=(_i, "ctr_percent", _v))),
    "T035": ("hourly_both", [DAY], dict(dims=("hour",), measures=(_i, _c))),
    "T036": ("daily_rows_week", [WEEK], dict(dims=("dt",), measures=(_i,))),
    "T038": ("campaign_impressions_week", [WEEK], dict(dims=("campaign_id",), measures=(_i,))),
    "T040": ("advertiser_revenue_week", [WEEK], dict(dims=("advertiser_id",), measures=("revenue",), extra="is_conversion")),
    "T042": ("format_clicks_week", [WEEK], dict(dims=("ad_format",), measures=(_c,))),
    "T046": ("month_totals", [MONTH], dict(dims=(), measures=(_i, _c, _v), rate_names=("ctr_percent",))),
    "T048": ("device_detail_month", [MONTH], dict(dims=("device_type",), measures=(_i, _c, _v))),
    "T050": ("category_conversions_top10", [MONTH], dict(dims=("food_category",), measures=(_i, _v), tail="ORDER BY conversions DESC, food_category LIMIT 10")),
    "T052": ("day_platform_month", [MONTH], dict(dims=("dt", "platform"), measures=(_i,))),
    "T054": ("position_cvr_month", [MONTH], dict(dims=("ad_position",), measures=(_v, _c), rate_names=("cvr_percent",), show=("cvr_percent",))),
    "T061": ("no_clicks", [DAY], dict(dims=("campaign_id",), measures=(_i, _c), show=(_i,), having="clicks = 0")),
    "T062": ("high_ctr_no_conversion", [DAY], dict(dims=("campaign_id",), measures=(_c, _i, _v), rate_names=("ctr_percent",), show=("ctr_percent",), having="ctr_percent > 5.0 AND conversions = 0")),
    "T063": ("advertiser_roas_top5", [MONTH], dict(dims=("advertiser_id",), measures=("revenue", "cost_null_trap"), rate_names=("roas_qa",), show=("roas_qa", "revenue"), tail="ORDER BY roas_qa DESC, advertiser_id LIMIT 5")),
    "T064": ("two_months", [BEFORE, MONTH], dict(dims=("year", "month"), measures=(_i, _c, _v))),
    "T065": ("device_campaign_ctr_top5", [MONTH], dict(dims=("campaign_id",), measures=(_c, _i), rate_names=("ctr_percent",), show=("ctr_percent",), extra=f"device_type = '{DEVICE}'", tail="ORDER BY ctr_percent DESC, campaign_id LIMIT 5")),
    "T066": ("campaign_cpa_lowest5", [DAY], dict(dims=("campaign_id",), measures=("cost_null_trap", _v), rate_names=("cpa_qa",), show=("cpa_qa",), having="conversions > 0", tail="ORDER BY cpa_qa, campaign_id LIMIT 5")),
}


def _asker(key, periods):
    question = QUESTIONS[key]

    def run(spark, d):
        span = (min(p[0] for p in periods), max(p[1] for p in periods))
        return qa.ask(question, ad_facts(spark, d, question.columns(), span), *periods)

    return run


for _key, (_name, _periods, _spec) in _SET.items():
    register(f"{_key}_{_name}", _sql(period=_periods, **_spec))(_asker(_key, _periods))


def _facts(spark, d, measures, *more, period=WHOLE):
    return ad_facts(spark, d, performance_needs(measures, ("dt", *more)), period)


@register("T029_half_day_clicks", f"""WITH {FACTS} SELECT CASE WHEN hour::INT < 12 THEN 'morning' ELSE 'afternoon' END AS time_period, {pick('clicks')}
FROM facts WHERE {between(DAY)} GROUP BY 1""")
def _(spark, d):
    return qa.half_day_clicks(_facts(spark, d, ("clicks",), "hour", period=DAY), *DAY)


@register("T030_conversion_types", f"""WITH {FACTS}, g AS (SELECT conversion_type, {pick('conversions', 'revenue')} FROM facts WHERE {between(MONTH)} AND is_conversion GROUP BY 1)
SELECT *, {div('revenue', 'conversions', 1, None)} AS mean_value FROM g""")
def _(spark, d):
    return qa.conversion_types(_facts(spark, d, ("conversions", "revenue"), "conversion_type", period=MONTH), *MONTH)


@register("T044_mean_daily_ctr", f"""WITH {FACTS}, g AS (SELECT dt, campaign_id, {pick('clicks', 'impressions')} FROM facts WHERE {between(WEEK)} GROUP BY 1, 2),
 h AS (SELECT campaign_id, {rates('ctr_percent')} FROM g)
SELECT campaign_id, CAST(SUM(CAST(ctr_percent AS DECIMAL(18,4))) AS DOUBLE) / COUNT(ctr_percent) AS mean_ctr FROM h GROUP BY 1""")
def _(spark, d):
    return qa.mean_daily_ctr(_facts(spark, d, ("clicks",), "campaign_id", period=WEEK), *WEEK)


# --- seeds ------------------------------------------------------------------
def _growth(measures, rate_names, cur, prev):
    shown = (*measures, *rate_names)
    both = ", ".join(f"p.{m} AS last_{m}, c.{m} AS this_{m}" for m in shown)
    grow = [f"{r(f'(c.{m} - p.{m}) * 100.0::DOUBLE / NULLIF(p.{m}, 0)')} AS {m}_growth" for m in measures]
    gaps = [f"{r(f'c.{x} - p.{x}')} AS {x}_growth" for x in rate_names]
    tops = "," + rates(*rate_names) if rate_names else ""
    return f"""WITH {FACTS}, p0 AS (SELECT {pick(*measures)} FROM facts WHERE {between(prev)}), c0 AS (SELECT {pick(*measures)} FROM facts WHERE {between(cur)}),
 p AS (SELECT *{tops} FROM p0), c AS (SELECT *{tops} FROM c0) SELECT {both}, {', '.join(grow + gaps)} FROM p CROSS JOIN c"""


_THIS, _LAST = ("1998-07-01", "2001-12-31"), ("1995-01-01", "1998-06-30")


@register("SD1_period_growth_scalar", _growth(("impressions",), (), _THIS, _LAST))
def _(spark, d):
    return qa.period_growth(_facts(spark, d, ()), _THIS, _LAST)


_GM = ("clicks", "impressions", "conversions", "revenue", "cost_null_trap")


@register("SD1_period_growth_rates", _growth(_GM, ("ctr_percent", "cvr_percent", "roas_qa"), _THIS, _LAST))
def _(spark, d):
    return qa.period_growth(_facts(spark, d, _GM), _THIS, _LAST, _GM, ("ctr_percent", "cvr_percent", "roas_qa"))


@register("SD2_period_growth_by_key", f"""WITH {FACTS}, c AS (SELECT advertiser_id, SUM(cpi + cpc) AS s FROM facts WHERE {between(MONTH)} GROUP BY 1),
 p AS (SELECT advertiser_id, SUM(cpi + cpc) AS s FROM facts WHERE {between(BEFORE)} GROUP BY 1)
SELECT advertiser_id, CAST(COALESCE(p.s, 0) AS DOUBLE) AS last_spend, CAST(c.s AS DOUBLE) AS this_spend, CAST(c.s - COALESCE(p.s, 0) AS DOUBLE) AS spend_growth
FROM c LEFT JOIN p USING (advertiser_id)""")
def _(spark, d):
    return qa.spend_growth_by_key(_facts(spark, d, ("cost_null_trap",), "advertiser_id"), "advertiser_id", MONTH, BEFORE)


@register("SD3_roas_threshold", grouped(("advertiser_id",), ("revenue", "cost_null_trap"), between(WHOLE), ("roas_qa",), having="revenue >= cost_null_trap"))
def _(spark, d):
    return qa.roas_threshold(_facts(spark, d, ("revenue", "cost_null_trap"), "advertiser_id"), "advertiser_id", *WHOLE)


@register("SD4_below_average", f"""WITH {FACTS}, g AS (SELECT campaign_id, {pick('clicks', 'impressions')} FROM facts WHERE {between(WHOLE)} GROUP BY 1),
 h AS (SELECT campaign_id, {rates('ctr_percent')} FROM g), m AS (SELECT {r('CAST(SUM(CAST(ctr_percent AS DECIMAL(18,4))) AS DOUBLE) / COUNT(ctr_percent)', 6)} AS mean_ctr FROM h)
SELECT campaign_id, ctr_percent, mean_ctr, {r('ctr_percent - mean_ctr')} AS ctr_gap FROM h CROSS JOIN m WHERE ctr_percent < mean_ctr""")
def _(spark, d):
    return qa.below_average(_facts(spark, d, ("clicks",), "campaign_id"), "campaign_id", *WHOLE)


@register("SD5_peak_row", grouped(("hour",), ("impressions",), between(WHOLE), tail="ORDER BY impressions DESC, hour LIMIT 1"))
def _(spark, d):
    return qa.peak_row(_facts(spark, d, (), "hour"), "hour", "impressions", *WHOLE)


@register("SD5_peak_day", grouped(("dt",), ("cost_impression",), between(WHOLE), tail="ORDER BY cost_impression DESC, dt LIMIT 1"))
def _(spark, d):
    return qa.peak_row(_facts(spark, d, ("cost_impression",)), "dt", "cost_impression", *WHOLE)


@register("SD6_three_month_trend", f"""WITH {FACTS}, g AS (SELECT year, month, {pick('revenue', 'cost_null_trap')} FROM facts WHERE {between(WHOLE)} GROUP BY 1, 2)
SELECT *, {div('revenue', 'cost_null_trap', 100, 2)} AS roas_percent FROM g""")
def _(spark, d):
    return qa.monthly_roas(_facts(spark, d, ("revenue", "cost_null_trap"), "year", "month"), *WHOLE)


for _dim, _name in (("device_type", "device_hour"), ("ad_format", "format_hour"), ("dt", "day_hour")):

    def _run(spark, d, dim=_dim):
        return qa.hour_by(_facts(spark, d, ("clicks",), "hour", dim), dim, *WHOLE)

    register(f"SD7_{_name}", grouped((_dim, "hour"), ("impressions", "clicks"), between(WHOLE), ("ctr_percent",)))(_run)


_SPEND = ("cost_null_trap", "cost_click", "clicks", "conversions")


@register("SD8_campaign_spend", grouped(("campaign_id",), _SPEND, between(WHOLE), ("cpa_qa", "cpc")))
def _(spark, d):
    return qa.campaign_spend(_facts(spark, d, _SPEND, "campaign_id"), *WHOLE)


@register("SD8_campaign_spend_daily", grouped(("campaign_id", "dt"), _SPEND, between(WHOLE), ("cpa_qa", "cpc")))
def _(spark, d):
    return qa.campaign_spend(_facts(spark, d, _SPEND, "campaign_id"), *WHOLE, by_day=True)


@register("SD9_nth_rank", f"""WITH {FACTS}, g AS (SELECT device_type, {pick('clicks')} FROM facts WHERE {between(WHOLE)} GROUP BY 1)
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY clicks DESC, device_type) AS rn FROM g) WHERE rn = 2""")
def _(spark, d):
    return qa.nth_rank(_facts(spark, d, ("clicks",), "device_type"), "device_type", *WHOLE)
