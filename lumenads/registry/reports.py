"""KPI and report queries."""

from __future__ import annotations


from lumenads.functions.metrics import distinct_rollup
from lumenads.operators.quality import validate_daily, validate_hourly
from lumenads.plans import reports as R
from lumenads.plans.testbed import ad_facts
from lumenads.registry.core import FACTS, SQL, WHOLE, between, div, grouped, pick, r, rates, register

MEASURES = R.KPI_MEASURES
RATES = R.KPI_RATES
HALF = ("1998-07-01", "2001-12-31")
HALF_BEFORE = ("1995-01-01", "1998-06-30")
QUARTER = ("1999-05-04", "1999-12-31")


def _facts(spark, d, *more, period=WHOLE, columns=R.KPI_COLUMNS):
    return ad_facts(spark, d, (*columns, *more), period)


@register("G1_kpi_summary", grouped((), MEASURES, between(WHOLE), RATES))
def _(spark, d):
    return R.kpi_summary(_facts(spark, d), *WHOLE)


@register("G2_kpi_daily", grouped(("dt",), MEASURES, between(WHOLE), ("ctr_distinct", "roas_report")))
def _(spark, d):
    return R.kpi_daily(_facts(spark, d), *WHOLE)


_WEEK = f"""WITH {FACTS}, g AS (SELECT
 GREATEST(date_trunc('week', dt)::DATE, DATE '{QUARTER[0]}') AS week_start,
 LEAST(date_trunc('week', dt)::DATE + 6, DATE '{QUARTER[1]}')::DATE AS week_end,
 {pick(*MEASURES)} FROM facts WHERE {between(QUARTER)} GROUP BY 1, 2)
SELECT *, {rates(*RATES)} FROM g"""


@register("G3_kpi_weekly", _WEEK)
def _(spark, d):
    return R.kpi_weekly(_facts(spark, d), *QUARTER)


_LOOSE = f"""WITH {FACTS}, g AS (SELECT date_trunc('week', dt)::DATE AS week_start,
 LEAST(date_trunc('week', dt)::DATE + 6, DATE '{QUARTER[1]}')::DATE AS week_end,
 {pick(*MEASURES)} FROM facts
 WHERE dt BETWEEN date_trunc('week', DATE '{QUARTER[0]}')::DATE AND DATE '{QUARTER[1]}' GROUP BY 1, 2)
SELECT *, {rates(*RATES)} FROM g"""


@register("G3_kpi_weekly_loose", _LOOSE)
def _(spark, d):
    return R.kpi_weekly(_facts(spark, d), *QUARTER, strict_month=False)


@register("G3_kpi_weekly_days", f"""WITH {FACTS}, g AS (SELECT GREATEST(date_trunc('week', dt)::DATE, DATE '{QUARTER[0]}') AS week_start, dt,
 {pick(*MEASURES)} FROM facts WHERE {between(QUARTER)} GROUP BY 1, 2) SELECT *, {rates('ctr_distinct', 'roas_report')} FROM g""")
def _(spark, d):
    return R.kpi_weekly_days(_facts(spark, d), *QUARTER)


_MTD = ("1999-03-01", "1999-03-30")
_MTD_BEFORE = ("1999-02-01", "1999-02-28")


def _pair(columns):
    cur = ", ".join(f"c.{x}" for x in columns)
    prev = ", ".join(f"p.{x} AS prev_{x}" for x in columns)
    return f"{cur}, {prev}"


@register(
    "G4_kpi_prev_month",
    f"""WITH {FACTS},
 g AS (SELECT CASE WHEN {between(_MTD)} THEN 'c' ELSE 'p' END AS k, {pick(*MEASURES)} FROM facts
  WHERE {between(_MTD)} OR {between(_MTD_BEFORE)} GROUP BY 1),
 h AS (SELECT *, {rates(*RATES)} FROM g)
SELECT {_pair((*MEASURES, *RATES))},
 {r('(c.revenue_purchase - p.revenue_purchase) * 100.0 / NULLIF(p.revenue_purchase, 0)')} AS revenue_change,
 {r('(c.ctr_distinct - p.ctr_distinct) * 100.0 / NULLIF(p.ctr_distinct, 0)')} AS ctr_change
FROM (SELECT * FROM h WHERE k = 'c') c CROSS JOIN (SELECT * FROM h WHERE k = 'p') p""",
)
def _(spark, d):
    return R.kpi_prev_month(_facts(spark, d, period=None), *_MTD)


@register(
    "G5_kpi_prev_week",
    f"""WITH {FACTS}, lead_in AS (SELECT (date_trunc('week', DATE '{QUARTER[0]}') - INTERVAL 7 DAY)::DATE AS a),
 days AS (SELECT *, CASE WHEN dt < DATE '{QUARTER[0]}' THEN a ELSE GREATEST(date_trunc('week', dt)::DATE, DATE '{QUARTER[0]}') END AS week_start,
  CASE WHEN dt < DATE '{QUARTER[0]}' THEN a + 6 ELSE LEAST(date_trunc('week', dt)::DATE + 6, DATE '{QUARTER[1]}') END AS week_end
  FROM facts CROSS JOIN lead_in WHERE {between(QUARTER)} OR dt BETWEEN a AND a + 6),
 g AS (SELECT week_start, week_end, {pick(*MEASURES)} FROM days GROUP BY 1, 2),
 h AS (SELECT *, {rates(*RATES)} FROM g),
 l AS (SELECT *, LAG(impressions_distinct) OVER w AS prev_impressions_distinct, LAG(clicks) OVER w AS prev_clicks,
  LAG(revenue_purchase) OVER w AS prev_revenue_purchase, LAG(roas_report) OVER w AS prev_roas_report
  FROM h WINDOW w AS (ORDER BY week_start))
SELECT *, {r('(revenue_purchase - prev_revenue_purchase) * 100.0 / NULLIF(prev_revenue_purchase, 0)')} AS revenue_change
FROM l WHERE week_start >= DATE '{QUARTER[0]}'""",
)
def _(spark, d):
    return R.kpi_prev_week(_facts(spark, d, period=None), *QUARTER)


@register(
    "G6_category_performance",
    grouped(("food_category",), MEASURES, between(WHOLE), ("ctr_distinct", "cvr_purchase", "roas_report")),
)
def _(spark, d):
    return R.category_performance(_facts(spark, d, "food_category"), *WHOLE)


@register(
    "G7_shop_top_n",
    grouped(("store_id", "food_category"), MEASURES, between(WHOLE), ("ctr_distinct", "roas_report"),
            tail="ORDER BY revenue_purchase DESC, store_id, food_category LIMIT 5"),
)
def _(spark, d):
    return R.shop_top_n(_facts(spark, d, "store_id", "food_category"), *WHOLE)


@register(
    "G8_shop_bottom_n",
    grouped(("store_id", "food_category"), MEASURES, between(WHOLE), ("ctr_distinct", "roas_report"),
            having="impressions_distinct >= 100",
            tail="ORDER BY roas_report, store_id, food_category LIMIT 5"),
)
def _(spark, d):
    return R.shop_bottom_n(_facts(spark, d, "store_id", "food_category"), *WHOLE)


_FUNNEL = f"SELECT conversion_type, {SQL['conversions']} AS n FROM facts WHERE {{}} GROUP BY 1"
_FUNNEL_COLUMNS = ("dt", "conversion_type", "is_conversion")


@register("G9_funnel_counts", f"WITH {FACTS} {_FUNNEL.format(between(WHOLE))}")
def _(spark, d):
    return R.funnel_counts(ad_facts(spark, d, _FUNNEL_COLUMNS, WHOLE), *WHOLE)


def _stage_sql(name, period):
    return f"""{name}_c AS ({_FUNNEL.format(between(period))}),
 {name}_s AS (SELECT CASE conversion_type WHEN 'view_content' THEN 1 WHEN 'add_to_cart' THEN 2 ELSE 3 END AS stage_no,
  conversion_type AS stage, n FROM {name}_c WHERE conversion_type IN ('view_content', 'add_to_cart', 'purchase')),
 {name} AS (SELECT *, {div('n', "(SELECT MAX(n) FROM " + name + "_c WHERE conversion_type = 'view_content')", 100, 2)} AS percent_of_first,
  {div('n', 'LAG(n) OVER (ORDER BY stage_no)', 100, 1)} AS percent_of_previous FROM {name}_s)"""


@register("G10_funnel_rates", f"WITH {FACTS}, {_stage_sql('f', WHOLE)} SELECT * FROM f")
def _(spark, d):
    return R.funnel_rates(R.funnel_counts(ad_facts(spark, d, _FUNNEL_COLUMNS, WHOLE), *WHOLE))


@register(
    "G11_etl_validate_hourly",
    f"""WITH {FACTS} SELECT COUNT(*) AS impressions, {SQL['clicks']} AS clicks,
 COUNT(DISTINCT click_id) AS unique_clicks, {div(SQL['clicks'], 'COUNT(*)', 100, None, True)} AS ctr FROM facts""",
)
def _(spark, d):
    return validate_hourly(ad_facts(spark, d, ("is_click", "click_id")))


@register(
    "G12_etl_validate_daily",
    f"""WITH {FACTS} SELECT {SQL['impressions_distinct']} AS impressions, {SQL['clicks']} AS clicks,
 {SQL['conversions']} AS conversions, {SQL['campaigns']} AS campaigns,
 {div(SQL['clicks'], SQL['impressions_distinct'], 100, None, True)} AS ctr FROM facts""",
)
def _(spark, d):
    return validate_daily(ad_facts(spark, d, ("impression_id", "is_click", "is_conversion", "campaign_id")))


_ROLLUP = f"""WITH {FACTS} SELECT campaign_id, device_type, COUNT(DISTINCT impression_id) AS impressions,
 COUNT(DISTINCT click_id) AS clicks,
 {div('COUNT(DISTINCT click_id)', 'COUNT(DISTINCT impression_id)', 100, None, True)} AS ctr
FROM facts GROUP BY 1, 2"""


@register("G13_rollup_campaign_device", _ROLLUP)
def _(spark, d):
    return distinct_rollup(
        ad_facts(spark, d, ("campaign_id", "device_type", "impression_id", "click_id")),
        ("campaign_id", "device_type"),
    )


# --- comparisons ------------------------------------------------------------
@register(
    "J9_prev_period_left_join",
    f"""WITH {FACTS}, c AS (SELECT food_category, {pick(*MEASURES)} FROM facts WHERE {between(HALF)} GROUP BY 1),
 p AS (SELECT food_category, {SQL['revenue_purchase']} AS v FROM facts WHERE {between(HALF_BEFORE)} GROUP BY 1)
SELECT c.*, {rates('ctr_distinct', 'cvr_purchase', 'roas_report')}, COALESCE(v, 0.0) AS prev_revenue_purchase,
 {r('(revenue_purchase - COALESCE(v, 0)) * 100.0 / NULLIF(COALESCE(v, 0), 0)')} AS revenue_change
FROM c LEFT JOIN p USING (food_category)""",
)
def _(spark, d):
    facts = _facts(spark, d, "food_category")
    return R.category_with_previous(facts, HALF, HALF_BEFORE)


@register(
    "J9_shop_prev_period",
    f"""WITH {FACTS}, c AS (SELECT store_id, food_category, {pick(*MEASURES)} FROM facts WHERE {between(HALF)} GROUP BY 1, 2),
 p AS (SELECT store_id, food_category, {SQL['revenue_purchase']} AS v FROM facts WHERE {between(HALF_BEFORE)} GROUP BY 1, 2)
SELECT c.*, {rates('ctr_distinct', 'roas_report')}, COALESCE(v, 0.0) AS prev_revenue_purchase
FROM c LEFT JOIN p USING (store_id, food_category) ORDER BY revenue_purchase DESC, store_id, food_category LIMIT 5""",
)
def _(spark, d):
    return R.shop_top_with_previous(_facts(spark, d, "store_id", "food_category"), HALF, HALF_BEFORE)


@register(
    "J9_funnel_prev_period",
    f"""WITH {FACTS}, c AS ({_FUNNEL.format(between(HALF))}), p AS ({_FUNNEL.format(between(HALF_BEFORE))})
SELECT c.conversion_type, c.n, COALESCE(p.n, 0) AS prev_n FROM c LEFT JOIN p ON c.conversion_type = p.conversion_type""",
)
def _(spark, d):
    return R.funnel_with_previous(ad_facts(spark, d, _FUNNEL_COLUMNS, WHOLE), HALF, HALF_BEFORE)


@register(
    "G51_yesterday_vs_mtd",
    f"""WITH {FACTS}, t AS (SELECT {pick(*MEASURES)} FROM facts WHERE {between(_MTD)}),
 u AS (SELECT *, {rates(*RATES)} FROM t),
 g AS (SELECT dt, {pick(*MEASURES)} FROM facts WHERE dt = DATE '{_MTD[1]}' GROUP BY 1),
 h AS (SELECT *, {rates('ctr_distinct', 'roas_report')} FROM g)
SELECT u.*, h.dt AS day_dt, {', '.join(f'h.{m} AS day_{m}' for m in (*MEASURES, 'ctr_distinct', 'roas_report'))}
FROM u LEFT JOIN h ON TRUE""",
)
def _(spark, d):
    return R.yesterday_vs_mtd(_facts(spark, d, period=_MTD), *_MTD)


# --- rules ------------------------------------------------------------------
# Limits scaled to the money of the test tables.
_RULES = {
    "roas_stop": 1.6e7, "roas_reduce": 1.8e7, "roas_increase": 2.2e7,
    "ctr_drop": 0.5, "cvr_drop": 0.5, "cpc_increase": 0.01, "revenue_growth": 1.0, "funnel_drop": 0.1,
}
_TARGETS = {"revenue_purchase": 1e9, "cost_click": 1000.0, "conversions_purchase": 1000}
_ACTION = ("store_id", "food_category", "is_conversion", "conversion_type")

_CHANGES = f"""cat AS (SELECT food_category, CASE WHEN {between(HALF)} THEN 'c' ELSE 'p' END AS k, {pick(*MEASURES)}
  FROM facts WHERE {between(HALF)} OR {between(HALF_BEFORE)} GROUP BY 1, 2),
 cat2 AS (SELECT *, {rates('ctr_distinct', 'cvr_purchase')} FROM cat),
 cat3 AS (SELECT food_category, c.ctr_distinct AS ctr, p.ctr_distinct AS pctr, c.cvr_purchase AS cvr, p.cvr_purchase AS pcvr,
  c.revenue_purchase AS rev, p.revenue_purchase AS prev,
  {r('(c.ctr_distinct - p.ctr_distinct) * 100.0 / NULLIF(p.ctr_distinct, 0)')} AS ctr_ch,
  {r('(c.cvr_purchase - p.cvr_purchase) * 100.0 / NULLIF(p.cvr_purchase, 0)')} AS cvr_ch,
  {r('(c.revenue_purchase - p.revenue_purchase) * 100.0 / NULLIF(p.revenue_purchase, 0)')} AS rev_ch
  FROM (SELECT * FROM cat2 WHERE k = 'c') c FULL JOIN (SELECT * FROM cat2 WHERE k = 'p') p USING (food_category)),
 shop AS (SELECT store_id, {pick(*MEASURES)} FROM facts WHERE {between(HALF)} GROUP BY 1),
 shop2 AS (SELECT *, {rates('roas_report')} FROM shop WHERE impressions_distinct >= 100),
 tot AS (SELECT {pick('revenue_purchase', 'cost_click', 'conversions_purchase')} FROM facts WHERE {between(HALF)}),
 goal AS (SELECT 'revenue_purchase' AS kpi, revenue_purchase AS actual, {_TARGETS['revenue_purchase']}::DOUBLE AS target FROM tot
  UNION ALL SELECT 'cost_click', cost_click, {_TARGETS['cost_click']}::DOUBLE FROM tot
  UNION ALL SELECT 'conversions_purchase', conversions_purchase::DOUBLE, {_TARGETS['conversions_purchase']}::DOUBLE FROM tot),
 goal2 AS (SELECT *, {div('actual', 'target', 100, 1)} AS pct FROM goal)"""


@register(
    "G46_action_items",
    f"""WITH {FACTS}, {_CHANGES}, {_stage_sql('fc', HALF)}, {_stage_sql('fp', HALF_BEFORE)},
 ov AS (SELECT {div('SUM(CASE WHEN ' + between(HALF) + ' THEN COALESCE(cpc, 0) ELSE 0 END)', 'COUNT(*) FILTER (WHERE is_click AND ' + between(HALF) + ')')} AS c,
  {div('SUM(CASE WHEN ' + between(HALF_BEFORE) + ' THEN COALESCE(cpc, 0) ELSE 0 END)', 'COUNT(*) FILTER (WHERE is_click AND ' + between(HALF_BEFORE) + ')')} AS p FROM facts)
SELECT 'urgent' AS priority, 'pause_campaign' AS rule, store_id AS target, roas_report AS current_value, NULL::DOUBLE AS previous_value
 FROM shop2 WHERE roas_report < {_RULES['roas_stop']}
UNION ALL SELECT 'high', 'lower_bid', store_id, roas_report, NULL FROM shop2 WHERE roas_report BETWEEN {_RULES['roas_stop']} AND {_RULES['roas_reduce']}
UNION ALL SELECT 'medium', 'raise_budget', store_id, roas_report, NULL FROM shop2 WHERE roas_report > {_RULES['roas_increase']}
UNION ALL SELECT 'medium', 'watch_cpc', 'all', c, p FROM ov WHERE {r('(c - p) * 100.0 / NULLIF(p, 0)')} >= {_RULES['cpc_increase']}
UNION ALL SELECT 'high', 'check_creative', food_category, ctr, pctr FROM cat3 WHERE ctr_ch <= -{_RULES['ctr_drop']}
UNION ALL SELECT 'medium', 'check_landing', food_category, cvr, pcvr FROM cat3 WHERE cvr_ch <= -{_RULES['cvr_drop']}
UNION ALL SELECT 'medium', 'check_funnel', fc.stage, fc.percent_of_previous, fp.percent_of_previous FROM fc JOIN fp ON fc.stage = fp.stage
 WHERE fc.percent_of_previous - fp.percent_of_previous <= -{_RULES['funnel_drop']}
UNION ALL SELECT 'info', 'extend_budget', food_category, rev, prev FROM cat3 WHERE rev_ch >= {_RULES['revenue_growth']}
UNION ALL SELECT 'urgent', 'target_missed', kpi, actual, target FROM goal2 WHERE pct < 80""",
)
def _(spark, d):
    facts = _facts(spark, d, *_ACTION)
    return R.action_items(facts, HALF, HALF_BEFORE, _TARGETS, _RULES)


@register(
    "G47_highlights",
    f"""WITH {FACTS}, {_CHANGES}
SELECT 'best_growth' AS kind, name, value FROM (SELECT food_category AS name, rev_ch AS value FROM cat3 WHERE rev_ch IS NOT NULL ORDER BY value DESC, name LIMIT 1)
UNION ALL SELECT 'best_target', name, value FROM (SELECT kpi AS name, pct AS value FROM goal2 ORDER BY value DESC, name LIMIT 1)
UNION ALL SELECT 'worst_drop', name, value FROM (SELECT food_category AS name, LEAST(ctr_ch, cvr_ch) AS value FROM cat3
  WHERE LEAST(ctr_ch, cvr_ch) <= -{_RULES['ctr_drop']} ORDER BY value, name LIMIT 1)
UNION ALL SELECT 'worst_shop', name, value FROM (SELECT store_id AS name, roas_report AS value FROM shop2
  WHERE roas_report <= {_RULES['roas_stop']} ORDER BY value, name LIMIT 1)""",
)
def _(spark, d):
    return R.highlights(_facts(spark, d, *_ACTION), HALF, HALF_BEFORE, _TARGETS, _RULES)
