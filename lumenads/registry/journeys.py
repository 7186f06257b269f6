"""ETL joins, journeys, backfill and reconciliation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenads.functions.metrics import distinct_rollup, half_up, measure, money_sum, performance_needs, ratio
from lumenads.functions.text import partition_hash
from lumenads.operators import joins as J
from lumenads.operators import quality as Q
from lumenads.operators.performance import performance, rank_of_label, ranked_top
from lumenads.plans import dashboards as D
from lumenads.plans import legacy as L
from lumenads.plans.reports import within
from lumenads.plans.testbed import (
    ad_events, ad_facts, clicks, conversions, impressions, events, table,
)
from lumenads.registry.core import FACTS, SQL, WHOLE, between, div, pick, r, rates, register
from lumenads.session import shared_dir
from lumenads.sources import catalog as C
from lumenads.sources import files as S

YEAR = ("year",)

# Raw tables in SQL: orders as impressions, lines as clicks and conversions.
RAW = """imp AS (SELECT o_orderkey::VARCHAR AS impression_id, o_custkey::VARCHAR AS user_id, o_orderpriority AS device_type,
  o_orderstatus AS ad_format, o_totalprice AS cost_per_impression, epoch_ms(o_orderdate) AS ts, o_orderdate::DATE AS dt,
  strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%d') AS day,
  lpad((o_orderkey % 24)::VARCHAR, 2, '0') AS hour FROM orders),
 line AS (SELECT *, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS lid, l_orderkey::VARCHAR AS impression_id, epoch_ms(l_shipdate) AS ts,
  strftime(l_shipdate, '%Y') AS year, strftime(l_shipdate, '%m') AS month, strftime(l_shipdate, '%d') AS day FROM lineitem),
 clk AS (SELECT 'c' || lid AS click_id, impression_id, l_discount AS cost_per_click, ts, year, month, day FROM line WHERE l_returnflag <> 'N'),
 cnv AS (SELECT 'v' || lid AS conversion_id, 'c' || lid AS click_id, impression_id,
  ['purchase','signup','download','view_content','add_to_cart'][l_linenumber % 5 + 1] AS conversion_type,
  l_extendedprice AS conversion_value, ['1day','7day','30day'][l_linenumber % 3 + 1] AS attribution_window,
  ts, year, month, day FROM line WHERE l_returnflag = 'R')"""
HOURLY = """hourly AS (SELECT i.*, c.click_id, c.cost_per_click, c.ts AS click_ts, c.click_id IS NOT NULL AS is_click
 FROM imp i LEFT JOIN clk c ON i.impression_id = c.impression_id AND i.year = c.year)"""
DAILY = """daily AS (SELECT h.*, v.conversion_id, v.conversion_type, v.conversion_value, v.conversion_id IS NOT NULL AS is_conversion
 FROM hourly h LEFT JOIN cnv v ON h.impression_id = v.impression_id AND h.year = v.year)"""


def hourly(spark, d):
    return J.attach_clicks(impressions(spark, d), clicks(spark, d).drop("month", "day", "hour"), YEAR)


def daily(spark, d):
    return J.attach_conversions(hourly(spark, d), conversions(spark, d).drop("month", "day", "hour"), YEAR)


@register("J1_hourly_click_join", f"""WITH {RAW}, {HOURLY} SELECT impression_id, user_id, device_type, year, hour, click_id, cost_per_click, is_click,
 cost_per_impression, ts AS impression_timestamp, click_ts AS click_timestamp FROM hourly""")
def _(spark, d):
    return hourly(spark, d).select(
        "impression_id", "user_id", "device_type", "year", "hour", "click_id", "cost_per_click",
        "is_click", "cost_per_impression", "impression_timestamp", "click_timestamp",
    )


@register("J2_daily_conversion_join", f"""WITH {RAW}, {HOURLY}, {DAILY} SELECT impression_id, user_id, year, click_id, is_click,
 conversion_id, conversion_type, conversion_value, is_conversion FROM daily""")
def _(spark, d):
    return daily(spark, d).select(
        "impression_id", "user_id", "year", "click_id", "is_click",
        "conversion_id", "conversion_type", "conversion_value", "is_conversion",
    )


_STATS = f"""SELECT {{keys}}COUNT(DISTINCT i.impression_id) AS impressions, COUNT(DISTINCT c.click_id) AS clicks, COUNT(DISTINCT v.conversion_id) AS conversions
 FROM imp i LEFT JOIN clk c ON i.impression_id = c.impression_id{{a}} LEFT JOIN cnv v ON c.click_id = v.click_id{{b}}"""


def _counts(journeys, keys):
    return journeys.groupBy(*keys).agg(
        F.count_distinct("impression_id").alias("impressions"),
        F.count_distinct("click_id").alias("clicks"),
        F.count_distinct("conversion_id").alias("conversions"),
    )


@register("J3_three_way_journey", f"""WITH {RAW}, g AS ({_STATS.format(keys='i.year, ', a=' AND i.year = c.year', b=' AND c.year = v.year')} GROUP BY 1)
SELECT *, {div('clicks', 'impressions', 100)} AS ctr, {div('conversions', 'impressions', 100, 4)} AS cvr_on_impressions FROM g""")
def _(spark, d):
    rows = J.journey(impressions(spark, d).select("impression_id", "year"), clicks(spark, d), conversions(spark, d), YEAR)
    return _counts(rows, YEAR).select(
        "*", ratio("clicks", "impressions", 100).alias("ctr"),
        ratio("conversions", "impressions", 100, 4).alias("cvr_on_impressions"),
    )


@register("J4_journey_unbounded", f"WITH {RAW} {_STATS.format(keys='i.year, i.month, ', a='', b='')} GROUP BY 1, 2")
def _(spark, d):
    rows = J.journey(impressions(spark, d).select("impression_id", "year", "month"), clicks(spark, d), conversions(spark, d))
    return _counts(rows, ("year", "month"))


@register("J5_attribution_window_join", f"""WITH {RAW}
SELECT i.impression_id, i.user_id, v.conversion_id, v.conversion_type, v.conversion_value, v.attribution_window, v.conversion_id IS NOT NULL AS is_conversion
FROM imp i LEFT JOIN cnv v ON i.impression_id = v.impression_id AND v.ts >= i.ts
 AND v.ts - i.ts <= 86400000 * regexp_extract(v.attribution_window, '^(\\d+)', 1)::BIGINT""")
def _(spark, d):
    base = impressions(spark, d).withColumnRenamed("timestamp", "impression_timestamp")
    return J.attribute_within_window(base, conversions(spark, d)).select(
        "impression_id", "user_id", "conversion_id", "conversion_type", "conversion_value",
        "attribution_window", "is_conversion",
    )


@register("J6_hourly_x_daily_join", f"""WITH {RAW}, {HOURLY}, {DAILY}, h AS (SELECT impression_id, MIN(hour) AS hour FROM hourly GROUP BY 1)
SELECT h.hour, COUNT(*) AS impressions, COUNT(*) FILTER (WHERE is_conversion) AS conversions,
 CAST(SUM(CAST(conversion_value AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM daily d JOIN h ON d.impression_id = h.impression_id GROUP BY 1""")
def _(spark, d):
    joined = J.hour_of_daily(hourly(spark, d), daily(spark, d).drop("hour"))
    return joined.groupBy("hour").agg(
        F.count(F.lit(1)).alias("impressions"), F.count_if("is_conversion").alias("conversions"),
        money_sum("conversion_value").alias("revenue"),
    )


_RECON = f"""WITH {RAW}, {HOURLY}, {DAILY}, a AS (SELECT dt, COUNT(*) AS hourly_total FROM hourly GROUP BY 1), b AS (SELECT dt, COUNT(*) AS daily_total FROM daily GROUP BY 1)
SELECT dt, hourly_total, daily_total, hourly_total - daily_total AS difference, {div('hourly_total - daily_total', 'daily_total', 100)} AS diff_percent
FROM a JOIN b USING (dt)"""


@register("J7_recon_inner_join", _RECON)
def _(spark, d):
    return Q.reconcile(hourly(spark, d), daily(spark, d))


@register("Q2_recon_hourly_daily", f"""WITH {RAW}, {HOURLY}, {DAILY}, a AS (SELECT year, COUNT(*) AS hourly_total FROM hourly GROUP BY 1), b AS (SELECT year, COUNT(*) AS daily_total FROM daily GROUP BY 1)
SELECT year, hourly_total, daily_total, hourly_total - daily_total AS difference, {div('hourly_total - daily_total', 'daily_total', 100)} AS diff_percent
FROM a JOIN b USING (year)""")
def _(spark, d):
    return Q.reconcile(hourly(spark, d), daily(spark, d), "year")


@register("J8_param_cross_join", f"""WITH {FACTS}, p AS (SELECT DATE '{WHOLE[0]}' AS start_date, DATE '{WHOLE[1]}' AS end_date),
 g AS (SELECT dt, start_date, end_date, {pick('impressions', 'clicks')} FROM facts CROSS JOIN p WHERE dt BETWEEN start_date AND end_date GROUP BY ALL)
SELECT * FROM g""")
def _(spark, d):
    params = spark.range(1).select(
        F.lit(WHOLE[0]).cast("date").alias("start_date"), F.lit(WHOLE[1]).cast("date").alias("end_date")
    )
    rows = J.scalar_cross_join(ad_facts(spark, d, ("dt", "is_click")), params)
    return performance(
        rows.where(F.col("dt").between(F.col("start_date"), F.col("end_date"))),
        ("dt", "start_date", "end_date"), ("impressions", "clicks"),
    )


_NEW = ("1995-01-03", "2001-12-31")


@register("J10_new_entity_anti_join", f"""WITH {FACTS}, g AS (SELECT advertiser_id, MIN(dt) AS first_day, {pick(*D.BASE)} FROM facts
 WHERE {between(_NEW)} AND advertiser_id NOT IN (SELECT advertiser_id FROM facts WHERE dt < DATE '{_NEW[0]}') GROUP BY 1)
SELECT *, {rates('roas_dash', zero=True)} FROM g""")
def _(spark, d):
    rows = ad_facts(spark, d, performance_needs(D.BASE, ("dt", "advertiser_id")))
    return D.new_advertisers(J.newcomers(rows, "advertiser_id", *_NEW))


# --- event log --------------------------------------------------------------
EV = """ev AS (SELECT event_id, ts, ts::DATE AS date, json_extract_string(props, '$.k') AS ad_id, user_id::VARCHAR AS user_id,
 CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'conversion' WHEN 'signup' THEN 'conversion' ELSE 'other' END AS event_type,
 CAST(value AS DECIMAL(18,4)) AS bid_price, CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,4)) END AS cpc_cost FROM events)"""
_N = lambda k: f"COUNT(*) FILTER (WHERE event_type = '{k}')"
_EVC = f"{_N('impression')} AS impressions, {_N('click')} AS clicks, {_N('conversion')} AS conversions"
_COST = "CAST(SUM(CASE WHEN event_type = 'impression' THEN bid_price ELSE 0 END) AS DOUBLE) AS cost"
_CTR = f"{div('clicks', 'impressions', 100)} AS ctr"


@register("G15_legacy_daily", f"WITH {EV} SELECT date, {_EVC}, {_COST} FROM ev GROUP BY 1")
def _(spark, d):
    return L.event_kpis(ad_events(spark, d), ("date",))


@register("G15_legacy_kpi", f"WITH {EV}, g AS (SELECT {_EVC}, {_COST} FROM ev) SELECT *, {_CTR}, {div('conversions', 'clicks', 100)} AS cvr FROM g")
def _(spark, d):
    return L.event_rates(L.event_kpis(ad_events(spark, d)), cvr=True)


@register("G15_legacy_by_campaign", f"WITH {EV}, g AS (SELECT ad_id AS campaign_id, {_EVC}, {_COST} FROM ev GROUP BY 1) SELECT *, {_CTR} FROM g")
def _(spark, d):
    rows = ad_events(spark, d).withColumn("campaign_id", F.col("ad_id"))
    return L.event_rates(L.event_kpis(rows, ("campaign_id",)))


@register("G15_legacy_by_user", f"WITH {EV}, g AS (SELECT user_id, {_EVC}, {_COST} FROM ev GROUP BY 1) SELECT *, {_CTR} FROM g")
def _(spark, d):
    return L.event_rates(L.event_kpis(ad_events(spark, d), ("user_id",)))


@register("G15_legacy_campaign_counts", f"WITH {EV} SELECT date, ad_id AS campaign_id, {_EVC} FROM ev GROUP BY 1, 2")
def _(spark, d):
    rows = ad_events(spark, d).withColumn("campaign_id", F.col("ad_id"))
    return L.event_kpis(rows, ("date", "campaign_id"), spend=False)


@register("G15_legacy_day_stats", f"WITH {EV} SELECT date, {_N('impression')} AS impressions, {_N('click')} AS clicks, CAST(SUM(bid_price) AS DOUBLE) AS total_revenue FROM ev GROUP BY 1")
def _(spark, d):
    return L.day_stats(ad_events(spark, d))


ADDAY = f"""adday AS (SELECT *, {div('clicks', 'impressions', 1, None, True)} AS ctr, {div('conversions', 'clicks', 1, None, True)} AS conversion_rate FROM (
 SELECT ad_id, date, {_EVC}, COALESCE(CAST(SUM(cpc_cost) AS DOUBLE) / NULLIF(COUNT(cpc_cost), 0), 0) AS avg_cpc FROM ev WHERE event_type <> 'other' GROUP BY 1, 2))"""


@register("G14_ad_day_metrics", f"WITH {EV}, {ADDAY} SELECT * FROM adday")
def _(spark, d):
    return L.ad_day_metrics(ad_events(spark, d))


@register("J11_metrics_outer_merge", f"WITH {EV}, {ADDAY} SELECT ad_id, date, impressions, clicks, conversions, avg_cpc FROM adday")
def _(spark, d):
    return L.ad_day_metrics_merged(ad_events(spark, d))


@register("G52_mean_ctr_by_day", f"WITH {EV}, {ADDAY} SELECT date, {r('AVG(ctr)', 9)} AS mean_ctr FROM adday GROUP BY 1")
def _(spark, d):
    return L.mean_ctr_by_day(L.ad_day_metrics(ad_events(spark, d)))


@register("O1_top_n_with_min", f"WITH {EV}, {ADDAY} SELECT * FROM adday WHERE impressions >= 2 ORDER BY ctr DESC, ad_id, date LIMIT 20")
def _(spark, d):
    return L.top_ads(L.ad_day_metrics(ad_events(spark, d)), min_impressions=2)


_LATEST = """newest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ad_id ORDER BY date DESC) AS rn FROM adday) WHERE rn = 1
 ORDER BY ctr DESC, ad_id LIMIT 5)"""


@register("W10_latest_per_key", f"WITH {EV}, {ADDAY}, {_LATEST} SELECT * FROM newest")
def _(spark, d):
    return L.latest_top_ads(L.ad_day_metrics(ad_events(spark, d)))


@register("J12_semi_filter", f"WITH {EV}, {ADDAY}, {_LATEST} SELECT ad_id, date, ctr FROM adday WHERE ad_id IN (SELECT ad_id FROM newest)")
def _(spark, d):
    metrics = L.ad_day_metrics(ad_events(spark, d))
    return J.keep_listed(metrics, L.latest_top_ads(metrics), "ad_id").select("ad_id", "date", "ctr")


# --- latency, traffic, overviews -------------------------------------------
_DELAY = ("under 10", "10 to 30", "30 to 60", "60 to 300", "300 and over")


@register("G17_click_delay_histogram", f"""WITH {RAW}, j AS (SELECT (c.ts - i.ts) / 86400000.0 AS x FROM imp i JOIN clk c ON i.impression_id = c.impression_id),
 g AS (SELECT CASE WHEN x < 10 THEN 'under 10' WHEN x < 30 THEN '10 to 30' WHEN x < 60 THEN '30 to 60' WHEN x < 300 THEN '60 to 300' ELSE '300 and over' END AS click_delay,
 COUNT(*) AS clicks FROM j GROUP BY 1) SELECT *, {div('clicks', 'SUM(clicks) OVER ()', 100)} AS percentage FROM g""")
def _(spark, d):
    rows = J.attach_clicks(impressions(spark, d), clicks(spark, d).drop(*("year", "month", "day", "hour")), ())
    return D.click_delay_histogram(rows, unit_ms=86_400_000)


@register("O2_custom_order", f"""WITH {RAW}, j AS (SELECT (c.ts - i.ts) / 86400000.0 AS x FROM imp i JOIN clk c ON i.impression_id = c.impression_id AND i.year = c.year),
 g AS (SELECT CASE WHEN x < 10 THEN 'under 10' WHEN x < 30 THEN '10 to 30' WHEN x < 60 THEN '30 to 60' WHEN x < 300 THEN '60 to 300' ELSE '300 and over' END AS click_delay,
 COUNT(*) AS clicks FROM j GROUP BY 1) SELECT click_delay, clicks,
 ROW_NUMBER() OVER (ORDER BY CASE click_delay WHEN 'under 10' THEN 1 WHEN '10 to 30' THEN 2 WHEN '30 to 60' THEN 3 WHEN '60 to 300' THEN 4 ELSE 5 END) AS position FROM g""")
def _(spark, d):
    rows = D.click_delay_histogram(hourly(spark, d), unit_ms=86_400_000)
    order = (rank_of_label(F.col("click_delay"), D.DELAY_LABELS),)
    return ranked_top(rows, order, len(D.DELAY_LABELS), "position").select("click_delay", "clicks", "position")


@register("G18_five_minute_traffic", f"""WITH {EV}, g AS (SELECT to_timestamp(floor(epoch(ts) / 300) * 300)::TIMESTAMP AS bucket, {_N('impression')} AS impressions, {_N('click')} AS clicks FROM ev GROUP BY 1)
SELECT *, {div('clicks', 'impressions', 100)} AS ctr FROM g""")
def _(spark, d):
    return D.five_minute_traffic(ad_events(spark, d))


@register("G42_minute_event_counts", f"WITH {EV} SELECT date_trunc('minute', ts) AS minute, event_type, COUNT(*) AS event_count FROM ev GROUP BY 1, 2")
def _(spark, d):
    return D.minute_event_counts(ad_events(spark, d))


@register("G42_latest_ctr_alert", f"""WITH {EV}, g AS (SELECT date_trunc('hour', ts) AS hour, {_N('impression')} AS i, {_N('click')} AS c FROM ev GROUP BY 1 ORDER BY 1 DESC LIMIT 1)
SELECT hour, {div('c', 'i', 100)} AS ctr, CASE WHEN {div('c', 'i', 100)} < 1.0 THEN 'CRITICAL' WHEN {div('c', 'i', 100)} < 1.5 THEN 'WARNING' ELSE 'OK' END AS status FROM g""")
def _(spark, d):
    return D.latest_ctr_alert(ad_events(spark, d))


@register("G26_daily_counts", f"WITH {RAW} SELECT year, month, day, COUNT(*) AS n FROM imp GROUP BY 1, 2, 3")
def _(spark, d):
    return impressions(spark, d).groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n"))


_IMPCOST = "CAST(SUM(CAST(cost_per_impression AS DECIMAL(18,4))) AS DOUBLE)"


def _impression_cost():
    return money_sum("cost_per_impression")


def _mean_cost(digits=4):
    return half_up(_impression_cost().cast("double") / F.count("cost_per_impression").cast("double"), digits)


@register("G26_hourly_trend_cost", f"WITH {RAW} SELECT year || '-' || month || '-' || day || ' ' || hour || ':00' AS datetime, COUNT(*) AS impressions, {_IMPCOST} AS total_cost FROM imp GROUP BY 1")
def _(spark, d):
    stamp = F.format_string("%s-%s-%s %s:00", "year", "month", "day", "hour")
    return impressions(spark, d).groupBy(stamp.alias("datetime")).agg(
        F.count(F.lit(1)).alias("impressions"), _impression_cost().alias("total_cost")
    )


@register("G26_month_compare", f"""WITH {RAW} SELECT year, month, COUNT(DISTINCT impression_id) AS impressions, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT device_type) AS devices,
 {_IMPCOST} AS total_cost, {r(f'{_IMPCOST} / COUNT(*)', 4)} AS mean_cost FROM imp GROUP BY 1, 2""")
def _(spark, d):
    return impressions(spark, d).groupBy("year", "month").agg(
        F.count_distinct("impression_id").alias("impressions"), F.count_distinct("user_id").alias("users"),
        F.count_distinct("device_type").alias("devices"), _impression_cost().alias("total_cost"),
        _mean_cost().alias("mean_cost"),
    )


@register("G26_period_overview", f"WITH {RAW} SELECT COUNT(*) AS impressions, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT ad_format) AS formats, MIN(ts) AS first_impression, MAX(ts) AS last_impression FROM imp")
def _(spark, d):
    return impressions(spark, d).agg(
        F.count(F.lit(1)).alias("impressions"), F.count_distinct("user_id").alias("users"),
        F.count_distinct("ad_format").alias("formats"), F.min("timestamp").alias("first_impression"),
        F.max("timestamp").alias("last_impression"),
    )


@register("G26_table_freshness", f"WITH {FACTS} SELECT dt, COUNT(*) AS record_count FROM facts WHERE dt >= DATE '1995-01-01' GROUP BY 1")
def _(spark, d):
    return C.recent_partitions(ad_facts(spark, d, ("dt",)), WHOLE[0])


@register("G27_advertiser_top10_reach", f"""WITH {FACTS} SELECT advertiser_id, COUNT(DISTINCT impression_id) AS impressions, COUNT(DISTINCT user_id) AS reach, {SQL['cost_impression']} AS spend,
 {r(SQL['cost_impression'] + ' / COUNT(*)', 6)} AS mean_cost FROM facts GROUP BY 1 ORDER BY impressions DESC, advertiser_id LIMIT 10""")
def _(spark, d):
    rows = ad_facts(spark, d, ("advertiser_id", "impression_id", "user_id", "cost_per_impression"))
    out = rows.groupBy("advertiser_id").agg(
        measure("impressions_distinct").alias("impressions"), measure("users").alias("reach"),
        measure("cost_impression").alias("spend"), F.count("cost_per_impression").alias("_n"),
    )
    mean = half_up(F.col("spend").cast("double") / F.col("_n").cast("double"), 6)
    return out.withColumn("mean_cost", mean).drop("_n").orderBy(F.desc("impressions"), "advertiser_id").limit(10)


@register("G28_hour_of_day_stats", f"""WITH {RAW}, g AS (SELECT dt, hour, COUNT(*) AS n FROM imp GROUP BY 1, 2)
SELECT hour, AVG(n) AS mean_impressions, MAX(n) AS max_impressions, MIN(n) AS min_impressions FROM g GROUP BY 1""")
def _(spark, d):
    return D.hour_of_day_stats(impressions(spark, d))


@register("U2_union_funnel_stages", f"""WITH {RAW}, t AS (SELECT COUNT(DISTINCT i.impression_id) AS i, COUNT(DISTINCT c.click_id) AS c,
 COUNT(DISTINCT CASE WHEN v.conversion_type = 'view_content' THEN v.conversion_id END) AS vc,
 COUNT(DISTINCT CASE WHEN v.conversion_type = 'add_to_cart' THEN v.conversion_id END) AS ac,
 COUNT(DISTINCT CASE WHEN v.conversion_type = 'purchase' THEN v.conversion_id END) AS p
 FROM imp i LEFT JOIN clk c ON i.impression_id = c.impression_id LEFT JOIN cnv v ON c.click_id = v.click_id)
SELECT 'Impressions' AS stage, i AS n, {div('i', 'i', 100)} AS percentage FROM t UNION ALL SELECT 'Clicks', c, {div('c', 'i', 100)} FROM t
UNION ALL SELECT 'View Content', vc, {div('vc', 'i', 100)} FROM t UNION ALL SELECT 'Add to Cart', ac, {div('ac', 'i', 100)} FROM t
UNION ALL SELECT 'Purchase', p, {div('p', 'i', 100)} FROM t""")
def _(spark, d):
    return D.funnel_stages(J.journey(impressions(spark, d).select("impression_id"), clicks(spark, d), conversions(spark, d)))


@register("U3_union_months", f"WITH {FACTS} SELECT dt, {pick('impressions', 'clicks')} FROM facts WHERE dt BETWEEN DATE '1997-06-20' AND DATE '1999-07-11' GROUP BY 1")
def _(spark, d):
    rows = ad_facts(spark, d, ("dt", "is_click"))
    parts = [within(rows, "1997-06-20", "1998-06-30"), within(rows, "1998-07-01", "1999-07-11")]
    return performance(parts[0].unionByName(parts[1]), ("dt",), ("impressions", "clicks"))


@register("U4_distinct_partitions", f"WITH {RAW} SELECT DISTINCT year, month, day FROM imp")
def _(spark, d):
    return C.distinct_partitions(impressions(spark, d))


_SCAN_TOP = 100


@register("O4_ordered_range_scan", f"WITH {RAW} SELECT impression_id, ts AS timestamp, device_type FROM imp WHERE {between(WHOLE)} ORDER BY ts DESC, impression_id LIMIT {_SCAN_TOP}")
def _(spark, d):
    rows = impressions(spark, d).select("impression_id", "timestamp", "device_type", "dt")
    return D.ordered_range_scan(rows, *WHOLE, key="impression_id", n=_SCAN_TOP).drop("dt")


@register("O3_default_limit", f"WITH {RAW} SELECT impression_id, device_type FROM imp ORDER BY impression_id LIMIT 1000")
def _(spark, d):
    return D.default_limit(impressions(spark, d).select("impression_id", "device_type").orderBy("impression_id"))


# --- data quality -----------------------------------------------------------
def _rewritten(spark, rows, label):
    """The whole range written by one job and read back."""
    root = shared_dir(spark, label)
    S.write_partitioned(rows, root, YEAR)
    return S.scan_hive_parquet(spark, root, StructType([f for f in rows.schema if f.name != "year"]), YEAR)


@register("Q1_backfill_hours", f"WITH {RAW}, {HOURLY} SELECT year, month, day, COUNT(*) AS impressions, COUNT(*) FILTER (WHERE is_click) AS clicks FROM hourly GROUP BY 1, 2, 3")
def _(spark, d):
    rows = hourly(spark, d).select("impression_id", "month", "day", "is_click", "year")
    return _rewritten(spark, rows, "q1-hours").groupBy("year", "month", "day").agg(
        F.count(F.lit(1)).alias("impressions"), F.count_if("is_click").alias("clicks")
    )


@register("Q1_backfill_days", f"""WITH {RAW}, {HOURLY}, {DAILY} SELECT year, month, day, COUNT(*) AS impressions, COUNT(*) FILTER (WHERE is_click) AS clicks,
 COUNT(*) FILTER (WHERE is_conversion) AS conversions FROM daily GROUP BY 1, 2, 3""")
def _(spark, d):
    rows = daily(spark, d).select("impression_id", "month", "day", "is_click", "is_conversion", "year")
    return _rewritten(spark, rows, "q1-days").groupBy("year", "month", "day").agg(
        F.count(F.lit(1)).alias("impressions"), F.count_if("is_click").alias("clicks"),
        F.count_if("is_conversion").alias("conversions"),
    )


@register("Q3_hour_completeness", f"WITH {RAW} SELECT year, month, day, COUNT(DISTINCT hour) AS hours, COUNT(DISTINCT hour) >= 24 AS complete FROM imp GROUP BY 1, 2, 3")
def _(spark, d):
    return Q.hour_completeness(impressions(spark, d))


# --- sources ----------------------------------------------------------------
_SLIM = ("impression_id string, user_id string, device_type string, cost_per_impression double, timestamp bigint")
_SLIM_COLUMNS = ("impression_id", "user_id", "device_type", "cost_per_impression", "timestamp")


def _stored(spark, d, label, codec="snappy"):
    """Impressions written by year and month into the shared folder."""
    root = shared_dir(spark, label)
    S.write_partitioned(impressions(spark, d).select(*_SLIM_COLUMNS, "year", "month"), root, ("year", "month"), codec)
    return S.scan_hive_parquet(spark, root, StructType.fromDDL(_SLIM), ("year", "month")), root


@register("A1_scan_hive_parquet", f"WITH {RAW} SELECT year, month, COUNT(*) AS impressions, {_IMPCOST} AS total_cost FROM imp WHERE (year, month) >= ('1996', '03') GROUP BY 1, 2")
def _(spark, d):
    rows, _root = _stored(spark, d, "a1")
    kept = rows.where(F.struct("year", "month") >= F.struct(F.lit("1996"), F.lit("03")))
    return kept.groupBy("year", "month").agg(F.count(F.lit(1)).alias("impressions"), _impression_cost().alias("total_cost"))


@register("A5_partition_overwrite", f"""WITH {RAW} SELECT year, CASE WHEN year = '1998' THEN 'rewritten' ELSE 'kept' END AS state, COUNT(*) AS impressions FROM imp GROUP BY 1, 2""")
def _(spark, d):
    root = shared_dir(spark, "a5")
    rows = impressions(spark, d).select("impression_id", F.lit("kept").alias("state"), "year")
    S.write_partitioned(rows, root, YEAR)
    again = rows.where(F.col("year") == "1998").withColumn("state", F.lit("rewritten"))
    S.write_partitioned(again, root, YEAR)
    S.write_partitioned(again, root, YEAR)
    S.write_partitioned(again.where(F.lit(False)), root, YEAR)
    stored = S.scan_hive_parquet(spark, root, StructType.fromDDL("impression_id string, state string"), YEAR)
    return stored.groupBy("year", "state").agg(F.count(F.lit(1)).alias("impressions"))


@register("A6_raw_writer", f"WITH {RAW} SELECT year, COUNT(*) AS impressions, MIN(ts) AS first_ms, MAX(ts) AS last_ms FROM imp GROUP BY 1")
def _(spark, d):
    rows, _root = _stored(spark, d, "a6", "zstd")
    return rows.groupBy("year").agg(
        F.count(F.lit(1)).alias("impressions"), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms")
    )


_DAYSERIES = f"WITH {RAW} SELECT dt::TIMESTAMP AS timestamp, COUNT(*) AS impression_count FROM imp GROUP BY 1"


def _day_series(spark, d):
    return impressions(spark, d).groupBy(F.col("dt").cast("timestamp").alias("timestamp")).agg(
        F.count(F.lit(1)).alias("impression_count")
    )


@register("A2_csv_series_read", _DAYSERIES)
def _(spark, d):
    path = shared_dir(spark, "a2")
    series = _day_series(spark, d)
    S.csv_write(series.unionByName(series), path)
    return S.csv_series_read(spark, path, "impression_count")


@register("A3_csv_write", _DAYSERIES)
def _(spark, d):
    path = shared_dir(spark, "a3")
    S.csv_write(_day_series(spark, d), path)
    return spark.read.csv(path, header=True, schema="timestamp timestamp, impression_count bigint")


@register("A4_jsonl_sink", _DAYSERIES)
def _(spark, d):
    path = shared_dir(spark, "a4")
    S.jsonl_sink(_day_series(spark, d), path)
    return S.json_lines(spark, path, "timestamp timestamp, impression_count bigint")


@register("A10_dt_view", f"WITH {FACTS} SELECT dt, year, month, day, COUNT(*) AS n FROM facts GROUP BY ALL")
def _(spark, d):
    return C.dt_view(ad_facts(spark, d, ("year", "month", "day"))).groupBy("dt", "year", "month", "day").agg(F.count(F.lit(1)).alias("n"))


@register("A11_ctas_hourly_rollup", f"""WITH {FACTS} SELECT campaign_id, device_type, hour, COUNT(DISTINCT impression_id) AS impressions, COUNT(DISTINCT click_id) AS clicks,
 {div('COUNT(DISTINCT click_id)', 'COUNT(DISTINCT impression_id)', 100, None, True)} AS ctr FROM facts GROUP BY 1, 2, 3""")
def _(spark, d):
    keys, name = ("campaign_id", "device_type", "hour"), f"lumenads_{uuid.uuid4().hex}"
    path = shared_dir(spark, "a11")
    C.save_rollup(ad_facts(spark, d, (*keys, "impression_id", "click_id")), name, path, keys)
    stored = spark.table(name)
    # the files stay where they are; only the entry in the catalog goes
    C.drop_table(spark, name)
    return spark.read.schema(stored.schema).parquet(path)


@register("A14_partition_key_hash", f"WITH {RAW} SELECT impression_id, md5(coalesce(user_id, impression_id)) AS partition_key FROM imp")
def _(spark, d):
    none = F.lit(None).cast("string")
    return impressions(spark, d).select("impression_id", partition_hash(none, "user_id", "impression_id").alias("partition_key"))


@register("A15_retention_filter", "SELECT event_id, event_type FROM events WHERE ts >= (SELECT TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY)")
def _(spark, d):
    return S.retention_filter(ad_events_raw(spark, d), "ts", "2024-01-31 00:00:00", 20).select("event_id", "event_type")


def ad_events_raw(spark, d):
    return events(spark, d)


@register("D1_dedup_by_key", """WITH g AS (SELECT l_orderkey, l_linenumber, MIN((l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)) AS m FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, m[1] AS l_partkey, m[2] AS l_suppkey FROM g""")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    order = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return Q.dedup_by_key(lines, ["l_orderkey", "l_linenumber"], order).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
