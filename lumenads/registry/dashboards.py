"""Dashboard and period queries over the facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenads.functions.metrics import measure, performance_needs, summarise
from lumenads.operators import sketches as K
from lumenads.operators.performance import performance, with_share
from lumenads.plans import dashboards as D
from lumenads.plans.testbed import ad_facts
from lumenads.registry.core import (
    DAY, FACTS, SQL, WHOLE, between, div, grouped, pick, r, rates, register,
)
from lumenads.session import shared_dir

BASE = D.BASE
W1, W2 = WHOLE
PERIOD = f"'{W1} ~ {W2}' AS period"
DAYS = D.days_in(*WHOLE)
P1, P2 = ("1997-01-01", "1997-12-31"), ("1998-01-01", "1998-12-31")


def facts(spark, d, measures, *more, period=WHOLE):
    return ad_facts(spark, d, performance_needs(measures, ("dt", *more)), period)


def per_day(expr, days=DAYS, digits=0):
    return div(expr, str(days), 1, digits, True)


# --- overviews --------------------------------------------------------------
_ACTIVE = (*BASE, "advertisers", "campaigns", "ads")


@register("G29_range_kpi_daily", grouped(("dt",), _ACTIVE, between(WHOLE), ("ctr_percent", "cpc_full", "cvr_percent", "roas_dash"), True, extra=PERIOD))
def _(spark, d):
    return D.range_kpi_daily(facts(spark, d, _ACTIVE), *WHOLE)


@register("G49_range_daily_trend", grouped(("dt",), BASE, between(WHOLE), ("ctr_percent", "roas_dash"), True, extra="CAST(isodow(dt) AS BIGINT) AS weekday"))
def _(spark, d):
    return D.range_daily_trend(facts(spark, d, BASE), *WHOLE)


_SUMMARY = (*BASE, "users", "advertisers", "campaigns")


@register("G48_period_summary", grouped((), _SUMMARY, between(WHOLE), ("roas_dash",), True,
          extra=f"{PERIOD}, {DAYS}::BIGINT AS days, {per_day('revenue')} AS daily_revenue, {per_day('cost_full')} AS daily_cost"))
def _(spark, d):
    return D.period_summary(facts(spark, d, _SUMMARY), *WHOLE)


_UNIT = ("impressions", "clicks", "cost_full", "conversions", "active_days")


@register("G34_unit_costs_period", grouped((), _UNIT, between(WHOLE),
          extra=f"{PERIOD}, {per_day('impressions', 'active_days')} AS daily_impressions, {per_day('clicks', 'active_days')} AS daily_clicks,"
                f" CASE WHEN impressions >= 1000 THEN {div('cost_full', 'impressions', 1000, 2, True)} ELSE 0.0::DOUBLE END AS cpm,"
                f" {div('cost_full', 'clicks', 1, 2, True)} AS cpc, {div('cost_full', 'conversions', 1, 2, True)} AS cpa"))
def _(spark, d):
    return D.unit_costs_period(facts(spark, d, _UNIT), *WHOLE)


_UNIT_DAY = ("impressions", "clicks", "conversions", "revenue", "cost_impression", "cost_clicked", "cost_full")


@register("G34_unit_costs_daily", grouped(("dt",), _UNIT_DAY, between(WHOLE),
          ("cpm_impression", "cpc_clicked", "cpa_full", "ctr_percent", "cvr_percent", "roas_dash"), True))
def _(spark, d):
    return D.unit_costs_daily(facts(spark, d, _UNIT_DAY), *WHOLE)


_TARGET = (*BASE, "advertisers", "campaigns", "users")
_GOALS = {"revenue": 450_000.0, "cost_full": 2.0, "conversions": 10.0}


@register("G33_target_attainment", grouped((), _TARGET, between(WHOLE), ("roas_dash",), True,
          extra=f"{PERIOD}, {DAYS}::BIGINT AS days, " + ", ".join(
              f"{g * DAYS}::DOUBLE AS {n}_target, {div(n, str(g * DAYS) + '::DOUBLE', 100, 1)} AS {n}_percent" for n, g in _GOALS.items())))
def _(spark, d):
    return D.target_attainment(
        facts(spark, d, _TARGET), *WHOLE,
        daily_revenue=_GOALS["revenue"], daily_cost=_GOALS["cost_full"], daily_conversions=_GOALS["conversions"],
    )


_MTD = ("revenue", "cost_full", "conversions", "users", "advertisers")
_TODAY = "2000-02-17"


@register("G41_month_projection", grouped((), _MTD, "dt BETWEEN DATE '2000-02-01' AND DATE '2000-02-17'", ("roas_dash",), True,
          extra=f"'2000-02' AS month, 17::BIGINT AS days_elapsed, 29::BIGINT AS days_in_month, 58.6::DOUBLE AS month_percent,"
                f" {div('revenue', '15000000', 100, 1)} AS revenue_percent, {div('cost_full', '60', 100, 1)} AS cost_percent,"
                f" {div('conversions', '300', 100, 1)} AS conversions_percent, {r('revenue * 29 / 17.0::DOUBLE', 0)} AS revenue_landing"))
def _(spark, d):
    return D.month_projection(facts(spark, d, _MTD, period=("2000-02-01", _TODAY)), _TODAY, 15_000_000, 60, 300)


# --- dimensions -------------------------------------------------------------
_RATES = ("ctr_percent", "cvr_percent", "roas_dash")
_BASE_DAYS = (*BASE, "active_days")


@register("G31_advertiser_perf", grouped(("advertiser_id",), _BASE_DAYS, between(WHOLE), _RATES, True,
          tail="ORDER BY revenue DESC, advertiser_id LIMIT 20",
          extra=f"{per_day('revenue')} AS daily_revenue, {per_day('cost_full')} AS daily_cost"))
def _(spark, d):
    return D.advertiser_perf(facts(spark, d, _BASE_DAYS, "advertiser_id"), *WHOLE)


@register("G31_campaign_perf", grouped(("campaign_id", "advertiser_id"), _BASE_DAYS, between(WHOLE), _RATES, True,
          having="cost_full > 8", tail="ORDER BY roas_dash DESC, revenue DESC, campaign_id, advertiser_id LIMIT 10"))
def _(spark, d):
    return D.campaign_perf(facts(spark, d, _BASE_DAYS, "campaign_id", "advertiser_id"), *WHOLE, min_cost=8)


@register("G31_creative_perf", grouped(("ad_id", "campaign_id"), _BASE_DAYS, between(WHOLE), _RATES, True, having="impressions >= 5",
          tail="ORDER BY cvr_percent DESC, ctr_percent DESC, revenue DESC, ad_id, campaign_id LIMIT 20"))
def _(spark, d):
    return D.creative_perf(facts(spark, d, _BASE_DAYS, "ad_id", "campaign_id"), *WHOLE, min_rows=5)


@register("G31_keyword_perf", grouped(("keyword",), BASE, between(WHOLE), ("ctr_percent", "cpc_full", "roas_dash"), True,
          having="impressions >= 50", tail="ORDER BY revenue DESC, keyword LIMIT 30"))
def _(spark, d):
    return D.keyword_perf(facts(spark, d, BASE, "keyword"), *WHOLE)


def _share(column, digits=1):
    return div(column, f"SUM({column}) OVER ()", 100, digits)


def _exact_share(column):
    """Share of an exact decimal total, so the order of summing cannot matter."""
    return div(column, f"CAST(SUM(CAST({column} AS DECIMAL(28,4))) OVER () AS DOUBLE)", 100, 1)


def _shares(**names):
    return ", ".join(f"{_exact_share(c)} AS {n}" for n, c in names.items())


@register("G31_category_perf", grouped(("food_category",), BASE, between(WHOLE), _RATES, True,
          extra=_shares(impression_share="impressions", cost_share="cost_full", revenue_share="revenue")))
def _(spark, d):
    return D.category_perf(facts(spark, d, BASE, "food_category"), *WHOLE)


@register("G31_region_perf", grouped(("delivery_region",), BASE, between(WHOLE), _RATES, True,
          extra=_shares(impression_share="impressions", revenue_share="revenue")))
def _(spark, d):
    return D.region_perf(facts(spark, d, BASE, "delivery_region"), *WHOLE)


@register("G31_device_perf", grouped(("device_type",), (*BASE, "users"), between(WHOLE), _RATES, True,
          extra=_shares(impression_share="impressions", revenue_share="revenue")))
def _(spark, d):
    return D.device_perf(facts(spark, d, (*BASE, "users"), "device_type"), *WHOLE)


_DAYPART = "CASE WHEN hour::INT <= 5 THEN 'night' WHEN hour::INT <= 11 THEN 'morning' WHEN hour::INT <= 17 THEN 'afternoon' ELSE 'evening' END"


@register("G32_daypart_perf", f"""WITH {FACTS}, g AS (SELECT {_DAYPART} AS daypart, {pick(*BASE)} FROM facts WHERE {between(WHOLE)} GROUP BY 1)
SELECT *, {rates('ctr_percent', 'roas_dash', zero=True)}, {_shares(impression_share='impressions')} FROM g""")
def _(spark, d):
    return D.daypart_perf(facts(spark, d, BASE, "hour"), *WHOLE)


_ADS = ("ad_id", "campaign_id", "advertiser_id")


@register("G35_underperforming_ads", f"""WITH {FACTS},
 a AS (SELECT {', '.join(_ADS)}, {pick(*BASE)} FROM facts WHERE {between(WHOLE)} GROUP BY ALL),
 b AS (SELECT *, {div('clicks', 'impressions', 100, None, True)} AS x, {div('revenue', 'cost_full', 1, None, True)} AS y FROM a),
 m AS (SELECT {r('AVG(x)', 6)} AS average_ctr, {r('AVG(y)', 6)} AS average_roas FROM b WHERE impressions >= 1)
SELECT {', '.join(_ADS)}, {', '.join(BASE)}, {r('x')} AS ctr_percent, average_ctr, {r('y')} AS roas_dash, average_roas,
 CASE WHEN impressions > 0 AND x < average_ctr * 0.5 THEN 'very_low_ctr'
  WHEN cost_full > 0 AND y < average_roas * 0.5 THEN 'very_low_roas'
  WHEN impressions > 1 AND clicks = 0 THEN 'no_clicks' WHEN cost_full > 0.1 AND revenue = 0 THEN 'no_conversions' ELSE 'other' END AS reason
FROM b CROSS JOIN m
WHERE (impressions >= 1 AND x < average_ctr * 0.5) OR (cost_full >= 0.05 AND y < average_roas * 0.5)
 OR (impressions > 1 AND clicks = 0) OR (cost_full > 0.1 AND revenue = 0)
ORDER BY cost_full DESC, {', '.join(_ADS)} LIMIT 50""")
def _(spark, d):
    return D.underperforming_ads(
        facts(spark, d, BASE, *_ADS), *WHOLE, min_rows=1, many_rows=1, min_cost=0.05, high_cost=0.1
    )


@register("G37_exposure_fatigue", f"""WITH {FACTS},
 u AS (SELECT user_id, COUNT(*) AS i, {SQL['clicks']} AS c, {SQL['conversions']} AS v FROM facts WHERE {between(WHOLE)} GROUP BY 1),
 g AS (SELECT CASE WHEN i <= 10 THEN '1-10' WHEN i <= 20 THEN '11-20' WHEN i <= 30 THEN '21-30' WHEN i <= 50 THEN '31-50'
   WHEN i <= 100 THEN '51-100' ELSE 'over 100' END AS exposure_bucket, COUNT(*) AS users, SUM(i)::BIGINT AS impressions,
   SUM(c)::BIGINT AS clicks, SUM(v)::BIGINT AS conversions FROM u GROUP BY 1)
SELECT *, {rates('ctr_percent', 'cvr_percent', zero=True)}, {div('impressions', 'users', 1, 1)} AS mean_exposure, {_share('users')} AS user_share FROM g""")
def _(spark, d):
    return D.exposure_fatigue(facts(spark, d, ("impressions", "clicks", "conversions"), "user_id"), *WHOLE)


_BURN = ("cost_full", "revenue", "active_days")
_LIMIT = 0.018


@register("G38_budget_burn", grouped(("advertiser_id",), _BURN, between(WHOLE), ("roas_dash",), True, having="cost_full > 0",
          tail="ORDER BY cost_full DESC, advertiser_id LIMIT 20",
          extra=f"{_LIMIT * DAYS!r}::DOUBLE AS budget, {r(f'cost_full / {_LIMIT * DAYS!r}::DOUBLE * 100', 1)} AS burn_percent,"
                f" active_days || '/{DAYS}' AS days_active, {per_day('cost_full', 'active_days')} AS daily_cost,"
                f" CASE WHEN cost_full / {_LIMIT * DAYS!r}::DOUBLE >= 0.95 THEN 'nearly_spent' WHEN cost_full / {_LIMIT * DAYS!r}::DOUBLE >= 0.8 THEN 'on_track'"
                f" WHEN cost_full / {_LIMIT * DAYS!r}::DOUBLE >= 0.5 THEN 'half_spent' ELSE 'underspent' END AS burn_status"))
def _(spark, d):
    return D.budget_burn(facts(spark, d, _BURN, "advertiser_id"), *WHOLE, daily_limit=_LIMIT)


# --- hours ------------------------------------------------------------------
_HOUR = (*BASE, "active_days", "advertisers")


@register("G30_hourly_roas", grouped(("hour",), _HOUR, between(WHOLE), ("ctr_percent", "roas_dash"), True))
def _(spark, d):
    return D.hourly_roas(facts(spark, d, _HOUR, "hour"), *WHOLE)


_ACTIVITY = ("advertisers", "campaigns", "ads", "cost_full", "impressions")


@register("G36_hourly_activity", grouped(("hour",), _ACTIVITY, between(WHOLE), extra=_shares(cost_share="cost_full", impression_share="impressions")))
def _(spark, d):
    return D.hourly_activity(facts(spark, d, _ACTIVITY, "hour"), *WHOLE)


_PEAK = (*BASE, "users", "active_days")


@register("G39_peak_hours", grouped(("hour",), _PEAK, between(WHOLE), ("roas_dash", "ctr_percent"), True,
          extra=f"{_DAYPART} AS daypart, {per_day('revenue', 'active_days')} AS daily_revenue"))
def _(spark, d):
    return D.peak_hours(facts(spark, d, _PEAK, "hour"), *WHOLE)


@register("G39_hourly_average", grouped(("hour",), _BASE_DAYS, between(WHOLE), ("ctr_percent", "roas_dash"), True,
          extra=", ".join(f"{per_day(m, 'active_days', 1)} AS daily_{m}" for m in ("impressions", "clicks", "conversions"))))
def _(spark, d):
    return D.hourly_average(facts(spark, d, _BASE_DAYS, "hour"), *WHOLE)


@register("W9_agg_over_agg", f"""WITH {FACTS} SELECT hour, COUNT(*) AS impressions, {SQL['clicks']} AS clicks, {SQL['advertisers']} AS advertisers,
 AVG(COUNT(*)) OVER (PARTITION BY hour) AS mean_impressions, AVG({SQL['clicks']}) OVER (PARTITION BY hour) AS mean_clicks
FROM facts WHERE {between(WHOLE)} GROUP BY hour""")
def _(spark, d):
    return D.mean_rows_per_hour(facts(spark, d, ("clicks", "advertisers"), "hour"), *WHOLE)


_PEAK_LABEL = ("revenue", "impressions", "clicks", "conversions", "users")


@register("W6_peak_label", grouped(("hour",), _PEAK_LABEL, f"dt = DATE '{DAY}'", ("ctr_percent", "cvr_percent"), True,
          extra="CASE WHEN hour::INT BETWEEN 7 AND 9 THEN 'morning_commute' WHEN hour::INT BETWEEN 12 AND 14 THEN 'lunch'"
                " WHEN hour::INT BETWEEN 18 AND 20 THEN 'evening_commute' WHEN hour::INT BETWEEN 22 AND 23 THEN 'late_night' ELSE 'other' END AS span,"
                " CASE WHEN revenue = MAX(revenue) OVER () THEN 'PEAK' WHEN revenue > AVG(revenue) OVER () * 1.2 THEN 'HIGH'"
                " WHEN revenue < AVG(revenue) OVER () * 0.8 THEN 'LOW' ELSE 'NORMAL' END AS status"))
def _(spark, d):
    return D.peak_label(facts(spark, d, _PEAK_LABEL, "hour", period=(DAY, DAY)), DAY)


# --- trends -----------------------------------------------------------------
def _ma(column):
    return r(f"CAST(SUM(CAST({column} AS DECIMAL(28,4))) OVER w AS DOUBLE) / COUNT({column}) OVER w")


@register("W2_moving_avg_7", f"""WITH {FACTS}, g AS (SELECT dt, {pick(*BASE)} FROM facts WHERE {between(WHOLE)} GROUP BY 1),
 h AS (SELECT *, {rates('ctr_percent', 'roas_dash', zero=True)} FROM g)
SELECT *, {_ma('ctr_percent')} AS ctr_ma, {_ma('revenue')} AS revenue_ma, {_ma('cost_full')} AS cost_ma
FROM h WINDOW w AS (ORDER BY dt ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return D.moving_averages(facts(spark, d, BASE), *WHOLE)


_CUM = ("revenue", "cost_full", "users", "conversions")
_VS = r("revenue * 100.0 * COUNT(*) OVER () / NULLIF(CAST(SUM(CAST(revenue AS DECIMAL(28,4))) OVER () AS DOUBLE), 0) - 100.0", 1)


@register("W3_running_total", grouped(("dt",), _CUM, between(WHOLE), ("roas_dash",), True,
          extra=f"CAST(SUM(CAST(revenue AS DECIMAL(28,4))) OVER (ORDER BY dt) AS DOUBLE) AS running_revenue, {_VS} AS vs_average_percent"))
def _(spark, d):
    return D.cumulative_revenue(facts(spark, d, _CUM), *WHOLE)


_VSM = ("revenue", "cost_full", "users")


@register("W5_vs_average", grouped(("dt",), _VSM, between(WHOLE), ("roas_dash",), True,
          extra=f"CAST(isodow(dt) AS BIGINT) AS weekday, {_VS} AS vs_average_percent"))
def _(spark, d):
    return D.daily_vs_average(facts(spark, d, _VSM), *WHOLE)


_PAID = "cpi + CASE WHEN is_click THEN cpc ELSE 0 END > 0"


def _rank_sql(dim, n):
    return f"""WITH {FACTS}, g AS (SELECT {dim}, {pick(*BASE)} FROM facts WHERE {between(WHOLE)} AND {_PAID} GROUP BY 1),
 h AS (SELECT *, {rates('ctr_percent', 'cvr_percent', zero=True)}, {div('revenue', 'cost_full', 1, 6)} AS roas,
  {_exact_share('revenue')} AS revenue_share FROM g WHERE cost_full > 0 AND revenue > 0)
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY roas DESC, {dim}) AS rank FROM h) WHERE rank <= {n}"""


@register("W7_rank_roas", _rank_sql("campaign_id", 10))
def _(spark, d):
    return D.rank_roas(facts(spark, d, BASE, "campaign_id"), *WHOLE)


@register("W7_rank_roas_advertiser", _rank_sql("advertiser_id", 5))
def _(spark, d):
    return D.rank_roas(facts(spark, d, BASE, "advertiser_id"), *WHOLE, dim="advertiser_id", n=5)


@register("W4_share_of_total", f"""WITH {FACTS}, g AS (SELECT device_type, {pick('impressions', 'cost_full', 'revenue')} FROM facts WHERE {between(WHOLE)} GROUP BY 1)
SELECT *, {_shares(impression_share='impressions', cost_share='cost_full', revenue_share='revenue')} FROM g""")
def _(spark, d):
    m = ("impressions", "cost_full", "revenue")
    return with_share(
        summarise(facts(spark, d, m, "device_type"), ("device_type",), m),
        impression_share="impressions", cost_share="cost_full", revenue_share="revenue",
    )


@register("W8_top_and_bottom_n", f"""WITH {FACTS}, g AS (SELECT advertiser_id, {pick(*_BASE_DAYS)} FROM facts WHERE {between(WHOLE)} GROUP BY 1),
 h AS (SELECT *, {rates('roas_dash', zero=True)}, {div('clicks', 'impressions', 100, 3, True)} AS ctr3,
  ROW_NUMBER() OVER (ORDER BY revenue DESC, advertiser_id) AS revenue_rank,
  ROW_NUMBER() OVER (ORDER BY revenue ASC, advertiser_id DESC) AS back FROM g)
SELECT * EXCLUDE (revenue_rank, back), CASE WHEN revenue_rank <= 10 THEN revenue_rank ELSE back END AS group_rank,
 CASE WHEN revenue_rank <= 10 THEN 'top' ELSE 'bottom' END AS "group" FROM h WHERE revenue_rank <= 10 OR back <= 10""")
def _(spark, d):
    return D.top_and_bottom_n(facts(spark, d, _BASE_DAYS, "advertiser_id"), *WHOLE)


@register("W1_peak_hour_per_ad", f"""WITH {FACTS}, g AS (SELECT ad_id, hour, {pick('impressions', 'clicks')} FROM facts GROUP BY 1, 2),
 h AS (SELECT *, {rates('ctr_percent')} FROM g WHERE impressions >= 2),
 k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ad_id ORDER BY ctr_percent DESC, impressions DESC, hour) AS rn FROM h)
SELECT * EXCLUDE (rn) FROM k WHERE rn = 1 ORDER BY ctr_percent DESC, ad_id LIMIT 50""")
def _(spark, d):
    return D.peak_hour_per_ad(ad_facts(spark, d, ("ad_id", "hour", "is_click")), min_rows=2)


# --- funnels, periods -------------------------------------------------------
@register("G40_funnel_events_users", f"""WITH {FACTS}, t AS (SELECT COUNT(*) AS i, {SQL['clicks']} AS c, {SQL['conversions']} AS v,
 COUNT(DISTINCT user_id) AS ui, COUNT(DISTINCT CASE WHEN is_click THEN user_id END) AS uc,
 COUNT(DISTINCT CASE WHEN is_conversion THEN user_id END) AS uv, {SQL['revenue']} AS rev FROM facts WHERE {between(WHOLE)})
SELECT '1_impression' AS stage, i AS events, ui AS users, 100.0::DOUBLE AS percent_of_first, 100.0::DOUBLE AS percent_of_previous, 0.0::DOUBLE AS revenue FROM t
UNION ALL SELECT '2_click', c, uc, {div('c', 'i', 100)}, {div('c', 'i', 100)}, 0.0 FROM t
UNION ALL SELECT '3_conversion', v, uv, {div('v', 'i', 100)}, {div('v', 'c', 100)}, rev FROM t""")
def _(spark, d):
    return D.funnel_events_users(facts(spark, d, ("clicks", "conversions", "users", "revenue")), *WHOLE)


_CMP = (*BASE, "advertisers", "campaigns")


def _period_sql(label, p):
    n = D.days_in(*p)
    return (f"SELECT g.*, {rates('roas_dash', 'ctr_percent', zero=True)}, '{label}' AS label, {n}::BIGINT AS days, {per_day('revenue', n)} AS daily_revenue,"
            f" {per_day('cost_full', n)} AS daily_cost, '{p[0]} ~ {p[1]}' AS period FROM (SELECT {pick(*_CMP)} FROM facts WHERE {between(p)}) g")


@register("U1_union_periods", f"WITH {FACTS} {_period_sql('period_1', P1)} UNION ALL {_period_sql('period_2', P2)}")
def _(spark, d):
    return D.compare_periods(facts(spark, d, _CMP), P1, P2)


# --- summaries --------------------------------------------------------------
_ICV = ("impressions", "clicks", "conversions")


@register("G16_hourly_ctr", grouped(("dt", "hour"), ("impressions", "clicks"), between(WHOLE), ("ctr_percent",)))
def _(spark, d):
    return performance(facts(spark, d, ("clicks",), "hour"), ("dt", "hour"), ("impressions", "clicks"), ("ctr_percent",))


@register("G16_platform_hour_ctr", grouped(("hour", "platform"), ("impressions", "clicks"), between(WHOLE), ("ctr_percent",)))
def _(spark, d):
    return performance(facts(spark, d, ("clicks",), "hour", "platform"), ("hour", "platform"), ("impressions", "clicks"), ("ctr_percent",))


@register("G16_platform_ctr", grouped(("platform",), ("impressions", "clicks"), between(WHOLE), ("ctr_percent",)))
def _(spark, d):
    return performance(facts(spark, d, ("clicks",), "platform"), ("platform",), ("impressions", "clicks"), ("ctr_percent",))


@register("G19_campaign_day_trend", grouped(("campaign_id", "dt"), _ICV, between(WHOLE), ("ctr_percent", "cvr_percent")))
def _(spark, d):
    return D.campaign_day_trend(facts(spark, d, _ICV, "campaign_id"))


def _mean2(c):
    return r(f"CAST(SUM(CAST({c} AS DECIMAL(18,4))) AS DOUBLE) / NULLIF(COUNT({c}), 0)")


def _two_level(keys, having, tail):
    cols = ", ".join(keys)
    return f"""WITH {FACTS}, g AS (SELECT {cols}, dt, {pick(*_ICV)} FROM facts GROUP BY ALL),
 h AS (SELECT *, {rates('ctr_percent', 'cvr_percent')} FROM g),
 k AS (SELECT {cols}, SUM(impressions)::BIGINT AS impressions, SUM(clicks)::BIGINT AS clicks, SUM(conversions)::BIGINT AS conversions,
  {_mean2('ctr_percent')} AS mean_ctr, {_mean2('cvr_percent')} AS mean_cvr FROM h GROUP BY ALL)
SELECT *, {rates('conversions_per_1k')} FROM k WHERE {having} {tail}"""


@register("G20_advertiser_efficiency", _two_level(("advertiser_id",), "impressions > 500", "ORDER BY conversions DESC, advertiser_id LIMIT 20"))
def _(spark, d):
    return D.advertiser_efficiency(facts(spark, d, _ICV, "advertiser_id"), min_rows=500)


@register("G21_device_funnel", grouped(("device_type",), _ICV, "TRUE", ("ctr_percent", "cvr_percent", "cvr_on_impressions")))
def _(spark, d):
    return D.device_funnel(facts(spark, d, _ICV, "device_type"))


_DAYTYPE = "CASE WHEN isodow(dt) >= 6 THEN 'weekend' ELSE 'weekday' END"


@register("G22_weekday_weekend", f"""WITH {FACTS}, g AS (SELECT dt, {pick(*_ICV)} FROM facts GROUP BY 1),
 h AS (SELECT *, {rates('ctr_percent', 'cvr_percent')}, {_DAYTYPE} AS day_type FROM g)
SELECT day_type, COUNT(*) AS days, {', '.join(f"{r(f'AVG({m})', 0)} AS mean_{m}" for m in _ICV)},
 {_mean2('ctr_percent')} AS mean_ctr, {_mean2('cvr_percent')} AS mean_cvr FROM h GROUP BY 1""")
def _(spark, d):
    return D.weekday_weekend(facts(spark, d, _ICV))


@register("G22_weekday_weekend_ctr", f"""WITH {FACTS}, g AS (SELECT {_DAYTYPE} AS day_type, {pick('impressions', 'clicks')} FROM facts GROUP BY 1)
SELECT *, {rates('ctr_percent')} FROM g""")
def _(spark, d):
    return D.weekday_weekend_ctr(facts(spark, d, ("clicks",)))


@register("G23_ad_device_top", _two_level(("ad_id", "device_type"), "impressions >= 5", "ORDER BY conversions_per_1k DESC, ad_id, device_type LIMIT 20"))
def _(spark, d):
    return D.ad_device_top(facts(spark, d, _ICV, "ad_id", "device_type"), min_rows=5)


@register("G24_weekly_report", f"""WITH {FACTS}, g AS (SELECT date_trunc('week', dt)::DATE AS week_start, {pick(*_ICV, 'campaigns', 'ads')} FROM facts GROUP BY 1)
SELECT *, {rates('ctr_percent', 'cvr_percent')} FROM g""")
def _(spark, d):
    return D.weekly_report(facts(spark, d, (*_ICV, "campaigns", "ads")))


_HEAT = f"""g AS (SELECT CAST(isodow(dt) AS BIGINT) AS weekday, hour, {pick('impressions', 'clicks')} FROM facts GROUP BY 1, 2),
 h AS (SELECT *, {rates('ctr_percent')} FROM g WHERE impressions >= 100)"""


@register("G25_weekday_hour_heatmap", f"WITH {FACTS}, {_HEAT} SELECT * FROM h")
def _(spark, d):
    return D.weekday_hour_heatmap(facts(spark, d, ("clicks",), "hour"))


@register("G25_heatmap_grid", f"WITH {FACTS}, {_HEAT} SELECT hour, "
          + ", ".join(f"MAX(ctr_percent) FILTER (WHERE weekday = {i}) AS weekday_{i}" for i in range(1, 8)) + " FROM h GROUP BY hour")
def _(spark, d):
    return D.heatmap_grid(D.weekday_hour_heatmap(facts(spark, d, ("clicks",), "hour")))


@register("G43_distinct_users_month", f"WITH {FACTS} SELECT COUNT(DISTINCT user_id) AS users, COUNT(*) AS impressions FROM facts WHERE {between(WHOLE)}")
def _(spark, d):
    return summarise(facts(spark, d, ("users",)), (), ("users", "impressions"))


@register("G43_distinct_users_approx")
def _(spark, d):
    rows = facts(spark, d, ("users",))
    return rows.agg(F.approx_count_distinct("user_id", 0.01).alias("users"), F.count(F.lit(1)).alias("impressions"))


_MONTH_USERS = f"WITH {FACTS} SELECT month, COUNT(DISTINCT user_id) AS users{{0}} FROM facts WHERE year = '1997' GROUP BY 1"


def _user_days(spark, d):
    """Bitmaps and sketches of the users of every day, stored."""
    root = shared_dir(spark, "user-days")
    rows = ad_facts(spark, d, ("dt", "user_id"))
    K.number_users(rows, f"{root}/numbers")
    K.save_day_bitmaps(rows, K.numbers(spark, f"{root}/numbers"), f"{root}/bitmaps")
    K.save_day_sketches(rows, f"{root}/sketches")
    return f"{root}/bitmaps", f"{root}/sketches"


@register("G43_bitmap_users", _MONTH_USERS.format(""))
def _(spark, d):
    """Months as unions of their stored days: exact."""
    bitmaps, _sketches = _user_days(spark, d)
    return K.users_in(spark, bitmaps, *P1, by={"month": F.date_format("dt", "MM")})


@register("G43_sketch_users", _MONTH_USERS.format(", TRUE AS within_3_percent"))
def _(spark, d):
    """The same from merged sketches, held against the exact number."""
    bitmaps, sketches = _user_days(spark, d)
    month = {"month": F.date_format("dt", "MM")}
    exact = K.users_in(spark, bitmaps, *P1, by=month)
    about = K.about_users_in(spark, sketches, *P1, by=month).withColumnRenamed("users", "about")
    near = F.abs(F.col("about") - F.col("users")) <= F.col("users") * 0.03
    return exact.join(about, "month").select("month", "users", near.alias("within_3_percent"))


@register("G44_quantile_days", f"""WITH {FACTS} SELECT campaign_id, COUNT(*) AS n, TRUE AS within FROM facts
 WHERE cpc IS NOT NULL AND {between(P1)} GROUP BY 1""")
def _(spark, d):
    """Median of a year from stored days; its rank is off by one percent at most."""
    path = shared_dir(spark, "cost-days")
    rows = ad_facts(spark, d, ("dt", "campaign_id", "cost_per_click"))
    K.save_day_quantiles(rows, path, ("campaign_id",), "cost_per_click")
    median = K.quantile_in(spark, path, *P1, 0.5, ("campaign_id",), "campaign_id string")
    year = ad_facts(spark, d, ("campaign_id", "cost_per_click"), P1)
    return K.rank_within(year, median, ("campaign_id",), "cost_per_click", 0.5)


@register("G44_median_cost", f"WITH {FACTS} SELECT campaign_id, CAST(quantile_disc(cpc, 0.5) AS DOUBLE) AS median_cost FROM facts WHERE cpc IS NOT NULL GROUP BY 1")
def _(spark, d):
    rows = ad_facts(spark, d, ("campaign_id", "cost_per_click"))
    return rows.where(F.col("cost_per_click").isNotNull()).groupBy("campaign_id").agg(
        F.percentile_approx("cost_per_click", 0.5).alias("median_cost")
    )


@register("G45_array_agg_join", f"""WITH {FACTS}, g AS (SELECT DISTINCT campaign_id, device_type FROM facts)
SELECT campaign_id, string_agg(device_type, ',' ORDER BY device_type) AS joined FROM g GROUP BY 1""")
def _(spark, d):
    return D.distinct_values_joined(ad_facts(spark, d, ("campaign_id", "device_type")), "campaign_id", "device_type")


# --- pre-aggregated input ---------------------------------------------------
_PRE = """pre AS (SELECT campaign_id, dt, COUNT(*) AS impressions, COUNT(*) FILTER (WHERE is_click) AS clicks,
 COUNT(*) FILTER (WHERE is_conversion) AS conversions, CAST(SUM(cpi) + SUM(CASE WHEN is_click THEN cpc ELSE 0 END) AS DOUBLE) AS cost_full,
 CAST(CAST(SUM(cpc) AS DOUBLE) / NULLIF(COUNT(cpc), 0) AS DECIMAL(18,4)) AS avg_cpc FROM facts GROUP BY 1, 2)"""


def _summary(spark, d):
    rows = facts(spark, d, (*_ICV, "cost_full"), "campaign_id", "cost_per_click")
    mean = F.sum(F.col("cost_per_click").cast("decimal(18,4)")).cast("double") / F.nullif(F.count("cost_per_click").cast("double"), F.lit(0.0))
    measures = [measure(m).alias(m) for m in (*_ICV, "cost_full")]
    return rows.groupBy("campaign_id", "dt").agg(*measures, mean.cast("decimal(18,4)").alias("avg_cpc"))


@register("G50_preagg_daily", f"""WITH {FACTS}, {_PRE}, g AS (SELECT dt, SUM(impressions)::BIGINT AS impressions, SUM(clicks)::BIGINT AS clicks,
 SUM(conversions)::BIGINT AS conversions, {r('CAST(SUM(avg_cpc) AS DOUBLE) / COUNT(avg_cpc)')} AS avg_cpc FROM pre GROUP BY 1)
SELECT *, {rates('ctr_percent', 'cvr_percent')} FROM g""")
def _(spark, d):
    return D.preagg_daily(_summary(spark, d))


@register("G50_preagg_campaign", f"""WITH {FACTS}, {_PRE}, g AS (SELECT campaign_id, SUM(impressions)::BIGINT AS impressions, SUM(clicks)::BIGINT AS clicks,
 SUM(conversions)::BIGINT AS conversions, CAST(SUM(CAST(cost_full AS DECIMAL(28,4))) AS DOUBLE) AS cost_full FROM pre GROUP BY 1)
SELECT *, {rates('ctr_percent', 'cvr_percent', 'cpc_full', 'cpa_full')} FROM g ORDER BY impressions DESC, campaign_id LIMIT 20""")
def _(spark, d):
    return D.preagg_campaign(_summary(spark, d))


_REAL = ("advertisers", "cost_full", "clicks", "impressions")


@register("G42_realtime_today", grouped((), _REAL, f"dt = DATE '{DAY}'", ("ctr_percent",), True, extra=f"'{DAY}' AS day"))
def _(spark, d):
    return D.realtime_today(facts(spark, d, _REAL, period=(DAY, DAY)), DAY)
