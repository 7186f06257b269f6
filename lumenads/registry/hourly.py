"""Hour and day jobs on real partitions: joins, backfill, stored facts in buckets."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from lumenads.functions.dates import tuple_range
from lumenads.functions.metrics import money_sum
from lumenads.operators import joins as J
from lumenads.operators import quality as Q
from lumenads.plans import etl
from lumenads.plans.testbed import log_tables
from lumenads.registry.core import div, register
from lumenads.schemas import DAY_PARTITION, struct_of
from lumenads.session import shared_dir
from lumenads.sources.buckets import buckets_for
from lumenads.sources.files import expire_before, scan_hive_parquet, write_partitioned, write_raw

WEEK = ("2026-03-01", "2026-03-08")
SPAN = (6, 20)
NOW = datetime(2026, 3, 6, 13)
BUCKETS = 2  # at least; larger logs get more
# Raw logs, and facts with the days they lack hours for: made once per session and test set.
_LANDED: dict[tuple[str, str], str] = {}
_FILLED: dict[tuple[str, str], tuple] = {}

# The same week in SQL. A partition is named by its stamp.
LOGS = """lt AS (SELECT *, TIMESTAMP '2026-03-01' + to_seconds(l_orderkey * 7919 % 604800) + to_seconds(CAST(l_quantity * 120 AS BIGINT)) AS ct,
  l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS lid FROM lineitem),
 imp AS (SELECT o_orderkey::VARCHAR AS impression_id, o_custkey::VARCHAR AS user_id, o_totalprice AS cost_per_impression,
  TIMESTAMP '2026-03-01' + to_seconds(o_orderkey * 7919 % 604800) AS t FROM orders),
 clk AS (SELECT l_orderkey::VARCHAR AS impression_id, 'c' || lid AS click_id, l_discount AS cost_per_click, ct AS t FROM lt WHERE l_returnflag <> 'N'),
 cnv AS (SELECT l_orderkey::VARCHAR AS impression_id, 'v' || lid AS conversion_id, l_extendedprice AS conversion_value,
  ct + to_seconds(l_linenumber * 10800) AS t FROM lt WHERE l_returnflag = 'R'),
 hourly AS (SELECT i.*, c.click_id, c.cost_per_click, c.t AS click_t, c.click_id IS NOT NULL AS is_click
  FROM imp i LEFT JOIN clk c ON i.impression_id = c.impression_id AND date_trunc('hour', i.t) = date_trunc('hour', c.t))"""
STAMP = "strftime({0}, '%Y') AS year, strftime({0}, '%m') AS month, strftime({0}, '%d') AS day"
_HOUR = STAMP.format("t") + ", strftime(t, '%H') AS hour"
_UNTIL = f"t < TIMESTAMP '{NOW:%Y-%m-%d %H}:00:00' + INTERVAL 1 HOUR"
_IN_SPAN = f"hour(t) BETWEEN {SPAN[0]} AND {SPAN[1]} AND {_UNTIL}"
_DAILY = """daily AS (SELECT h.*, v.conversion_id, v.conversion_value, v.t AS conversion_t, v.conversion_id IS NOT NULL AS is_conversion
  FROM stored h LEFT JOIN cnv v ON h.impression_id = v.impression_id AND h.t::DATE = v.t::DATE)"""
_STORED = f"WITH {LOGS}, stored AS (SELECT * FROM hourly WHERE {_UNTIL}), {_DAILY}"


def landed(spark, d) -> str:
    """Raw logs in hour partitions."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LANDED:
        root = shared_dir(spark, "raw-logs")
        for name, rows in log_tables(spark, d).items():
            write_raw(rows, f"{root}/{name}")
        _LANDED[key] = root
    return _LANDED[key]


def fact_tables(spark, d):
    root, tag = shared_dir(spark, "facts"), uuid.uuid4().hex
    n = buckets_for(spark, landed(spark, d), BUCKETS)
    return etl.hourly_table(f"hourly_{tag}", root, n), etl.daily_table(f"daily_{tag}", root, n)


def filled(spark, d):
    """Stored hourly facts, stored daily facts, and the days that lack hours."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FILLED:
        hourly, daily = fact_tables(spark, d)
        _FILLED[key] = hourly, daily, etl.fill_days(spark, landed(spark, d), hourly, daily, *WEEK, now=NOW)
    return _FILLED[key]


@register("J1_hour_partition_join", f"""WITH {LOGS} SELECT impression_id, user_id, {_HOUR}, click_id, cost_per_click, is_click,
 epoch_ms(t) AS impression_timestamp, epoch_ms(click_t) AS click_timestamp FROM hourly WHERE {_IN_SPAN}""")
def _(spark, d):
    raw = etl.raw_tables(spark, landed(spark, d))
    return etl.build_hourly(raw, etl.hours_between(*WEEK, *SPAN, now=NOW)).select(
        "impression_id", "user_id", "year", "month", "day", "hour", "click_id", "cost_per_click", "is_click",
        "impression_timestamp", "click_timestamp",
    )


@register("Q1_backfill_hour_partitions", f"""WITH {LOGS} SELECT {_HOUR}, COUNT(*) AS impressions, COUNT(*) FILTER (WHERE is_click) AS clicks,
 COUNT(DISTINCT click_id) AS unique_clicks FROM hourly WHERE {_IN_SPAN} GROUP BY ALL""")
def _(spark, d):
    hourly, _daily = fact_tables(spark, d)
    for _ in range(2):  # a second run replaces what the first wrote
        etl.fill_hours(spark, landed(spark, d), hourly, *WEEK, *SPAN, now=NOW)
    return hourly.scan(spark).groupBy("year", "month", "day", "hour").agg(
        F.count(F.lit(1)).alias("impressions"), F.count_if("is_click").alias("clicks"),
        F.count_distinct("click_id").alias("unique_clicks"),
    )


@register("J2_day_partition_join", f"""{_STORED} SELECT impression_id, {STAMP.format('t')}, click_id, is_click, conversion_id, conversion_value, is_conversion,
 epoch_ms(conversion_t) AS conversion_timestamp FROM daily""")
def _(spark, d):
    _hourly, daily, _lacking = filled(spark, d)
    return daily.scan(spark).select(
        "impression_id", "year", "month", "day", "click_id", "is_click", "conversion_id", "conversion_value",
        "is_conversion", "conversion_timestamp",
    )


@register("Q1_backfill_day_partitions", f"""{_STORED} SELECT {STAMP.format('t')}, COUNT(DISTINCT hour(t)) AS hours, COUNT(DISTINCT hour(t)) >= 24 AS complete
 FROM stored GROUP BY ALL HAVING COUNT(DISTINCT hour(t)) < 24""")
def _(spark, d):
    return filled(spark, d)[2]


@register("J6_stored_hour_of_daily", f"""{_STORED}, h AS (SELECT impression_id, MIN(strftime(t, '%H')) AS hour FROM stored GROUP BY 1)
SELECT h.hour, COUNT(*) AS impressions, COUNT(*) FILTER (WHERE is_conversion) AS conversions,
 CAST(SUM(CAST(conversion_value AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM daily d JOIN h ON d.impression_id = h.impression_id GROUP BY 1""")
def _(spark, d):
    hourly, daily, _lacking = filled(spark, d)
    joined = J.hour_of_daily(hourly.scan(spark), daily.scan(spark))
    return joined.groupBy("hour").agg(
        F.count(F.lit(1)).alias("impressions"), F.count_if("is_conversion").alias("conversions"),
        money_sum("conversion_value").alias("revenue"),
    )


@register("Q2_recon_stored_facts", f"""{_STORED}, a AS (SELECT t::DATE AS dt, COUNT(*) AS hourly_total FROM stored GROUP BY 1),
 b AS (SELECT t::DATE AS dt, COUNT(*) AS daily_total FROM daily GROUP BY 1)
SELECT strftime(dt, '%d') AS day, hourly_total, daily_total, hourly_total - daily_total AS difference,
 {div('hourly_total - daily_total', 'daily_total', 100)} AS diff_percent FROM a JOIN b USING (dt)""")
def _(spark, d):
    hourly, daily, _lacking = filled(spark, d)
    where = tuple_range(*WEEK)
    return Q.reconcile(hourly.scan(spark, where), daily.scan(spark, where), "day")


_CUTOFF = "2026-03-04 13:20:00"


@register("A15_expire_partitions", f"""WITH {LOGS} SELECT {STAMP.format('t')}, COUNT(*) AS impressions, MIN(strftime(t, '%H')) AS first_hour
 FROM imp WHERE t >= TIMESTAMP '{_CUTOFF}' GROUP BY ALL""")
def _(spark, d):
    root = shared_dir(spark, "expiring")
    rows = log_tables(spark, d)["impressions"]
    write_partitioned(rows.select("impression_id", "timestamp", "hour", *DAY_PARTITION), root, DAY_PARTITION)
    shape = struct_of("impression_id string, timestamp bigint, hour string")
    for _ in range(2):  # a second run changes nothing
        expire_before(spark, root, shape, _CUTOFF, partitions=DAY_PARTITION)
    return scan_hive_parquet(spark, root, shape, DAY_PARTITION).groupBy(*DAY_PARTITION).agg(
        F.count(F.lit(1)).alias("impressions"), F.min("hour").alias("first_hour")
    )
