"""Query registry: a Spark plan per key and, where SQL can say it, a SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenads.session import configure, fit_to_input

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Period of the test tables, a month and a day inside it.
WHOLE = ("1995-01-01", "2001-12-31")
MONTH = ("1998-06-01", "1998-06-30")
DAY = "1998-06-15"


def present(df: DataFrame) -> DataFrame:
    """Exact decimals leave as doubles, narrow integers as longs, times without zone."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.FloatType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        out.append(column.alias(field.name))
    return df.select(*out)


def register(key: str, sql: str | None = None):
    """Decorator: ``fn(spark, sf_dir) -> DataFrame`` under ``key``."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            fit_to_input(configure(spark), sf_dir)
            return present(fn(spark, sf_dir))

        if key in QUERIES:
            raise KeyError(f"query {key} registered twice")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return wrap


# ---------------------------------------------------------------- SQL pieces

FACTS = """facts AS (
 SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS impression_id,
  CASE WHEN l_returnflag <> 'N' THEN 'c' || l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR END AS click_id,
  o_custkey::VARCHAR AS user_id, l_partkey::VARCHAR AS ad_id, c_mktsegment AS campaign_id,
  l_suppkey::VARCHAR AS advertiser_id, 'p' || (l_linenumber % 5)::VARCHAR AS platform,
  o_orderpriority AS device_type, n_name AS delivery_region, p_brand AS store_id,
  p_type AS food_category, l_linestatus AS ad_position, o_orderstatus AS ad_format,
  p_name AS keyword, lpad((l_orderkey % 24)::VARCHAR, 2, '0') AS hour,
  l_shipdate::DATE AS dt, strftime(l_shipdate, '%Y') AS year, strftime(l_shipdate, '%m') AS month,
  strftime(l_shipdate, '%d') AS day, l_returnflag <> 'N' AS is_click, l_returnflag = 'R' AS is_conversion,
  CASE WHEN l_returnflag = 'R' THEN ['purchase','signup','download','view_content','add_to_cart'][p_size % 5 + 1] END AS conversion_type,
  CAST(l_tax AS DECIMAL(18,4)) AS cpi,
  CASE WHEN l_returnflag <> 'N' THEN CAST(l_discount AS DECIMAL(18,4)) END AS cpc,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,4)) END AS val
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

# Measures as SQL text; names follow the metric dictionary.
SQL = {
    "impressions": "COUNT(*)",
    "impressions_distinct": "COUNT(DISTINCT impression_id)",
    "clicks": "COUNT(*) FILTER (WHERE is_click)",
    "conversions": "COUNT(*) FILTER (WHERE is_conversion)",
    "conversions_purchase": "COUNT(*) FILTER (WHERE conversion_type = 'purchase' AND is_click)",
    "revenue": "CAST(SUM(CASE WHEN is_conversion THEN val ELSE 0 END) AS DOUBLE)",
    "revenue_purchase": "CAST(SUM(CASE WHEN conversion_type = 'purchase' AND is_click THEN val ELSE 0 END) AS DOUBLE)",
    "cost_click": "CAST(SUM(COALESCE(cpc, 0)) AS DOUBLE)",
    "cost_impression": "CAST(SUM(cpi) AS DOUBLE)",
    "cost_clicked": "CAST(SUM(CASE WHEN is_click THEN cpc ELSE 0 END) AS DOUBLE)",
    "cost_full": "CAST(SUM(cpi) + SUM(CASE WHEN is_click THEN cpc ELSE 0 END) AS DOUBLE)",
    "cost_null_trap": "CAST(SUM(cpi + cpc) AS DOUBLE)",
    "users": "COUNT(DISTINCT user_id)",
    "advertisers": "COUNT(DISTINCT advertiser_id)",
    "campaigns": "COUNT(DISTINCT campaign_id)",
    "ads": "COUNT(DISTINCT ad_id)",
    "active_days": "COUNT(DISTINCT dt)",
}


def pick(*names: str) -> str:
    return ", ".join(f"{SQL[n]} AS {n}" for n in names)


def r(expr: str, digits: int = 2) -> str:
    """Half-up rounding of a double, as Spark does it."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,{digits + 4})), {digits}) AS DOUBLE)"


def div(num: str, den: str, factor: float = 1, digits: int | None = 2, zero: bool = False) -> str:
    top = f"CAST({num} AS DOUBLE)" + (f" * {float(factor)}" if factor != 1 else "")
    value = f"({top} / NULLIF(CAST({den} AS DOUBLE), 0))"
    if digits is not None:
        value = r(value, digits)
    return f"COALESCE({value}, 0.0)" if zero else value


# rate name -> (numerator, denominator, factor, digits), written out for SQL
SQL_RATES = {
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


def rates(*names: str, zero: bool = False) -> str:
    return ", ".join(f"{div(*SQL_RATES[n], zero=zero)} AS {n}" for n in names)


def between(period, column: str = "dt") -> str:
    return f"{column} BETWEEN DATE '{period[0]}' AND DATE '{period[1]}'"


def grouped(keys, measures, where="TRUE", rate_names=(), zero=False, having="TRUE", tail="", extra=""):
    """SELECT keys, measures, rates over facts, the shape most reports share."""
    cols = ", ".join(keys)
    head = f"{cols}, " if cols else ""
    group = f" GROUP BY {cols}" if cols else ""
    tops = ("," + rates(*rate_names, zero=zero)) if rate_names else ""
    more = f", {extra}" if extra else ""
    return (
        f"WITH {FACTS}, g AS (SELECT {head}{pick(*measures)} FROM facts WHERE {where}{group}) "
        f"SELECT *{tops}{more} FROM g WHERE {having} {tail}"
    )
