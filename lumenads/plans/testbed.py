"""Ad tables derived from the star-schema test tables.

A fact row is a line item; only the tables that the requested columns need are
joined, and a period is pushed to the scan as a range on the raw timestamp.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Conversion types, picked by the part size.
CONVERSION_TYPES = ("purchase", "signup", "download", "view_content", "add_to_cart")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_click():
    return F.col("l_returnflag") != "N"


def _is_conversion():
    return F.col("l_returnflag") == "R"


def _line_id():
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))


def _two(column):
    return F.lpad(column.cast("string"), 2, "0")


_LINE = {
    "impression_id": _line_id,
    "click_id": lambda: F.when(_is_click(), F.concat(F.lit("c"), _line_id())),
    "conversion_id": lambda: F.when(_is_conversion(), F.concat(F.lit("v"), _line_id())),
    "ad_id": lambda: F.col("l_partkey").cast("string"),
    "advertiser_id": lambda: F.col("l_suppkey").cast("string"),
    "platform": lambda: F.concat(F.lit("p"), (F.col("l_linenumber") % 5).cast("string")),
    "ad_position": lambda: F.col("l_linestatus"),
    "hour": lambda: _two(F.col("l_orderkey") % 24),
    "dt": lambda: F.col("l_shipdate").cast("date"),
    "year": lambda: F.year("l_shipdate").cast("string"),
    "month": lambda: _two(F.month("l_shipdate")),
    "day": lambda: _two(F.dayofmonth("l_shipdate")),
    "is_click": _is_click,
    "is_conversion": _is_conversion,
    "cost_per_impression": lambda: F.col("l_tax"),
    "cost_per_click": lambda: F.when(_is_click(), F.col("l_discount")),
    "conversion_value": lambda: F.when(_is_conversion(), F.col("l_extendedprice")),
    "quantity": lambda: F.col("l_quantity").cast("int"),
}
_ORDERS = {
    "user_id": lambda: F.col("o_custkey").cast("string"),
    "device_type": lambda: F.col("o_orderpriority"),
    "ad_format": lambda: F.col("o_orderstatus"),
}
_CUSTOMER = {"campaign_id": lambda: F.col("c_mktsegment")}
_NATION = {"delivery_region": lambda: F.col("n_name")}
_PART = {
    "food_category": lambda: F.col("p_type"),
    "store_id": lambda: F.col("p_brand"),
    "keyword": lambda: F.col("p_name"),
    "conversion_type": lambda: F.when(
        _is_conversion(),
        F.element_at(F.array(*map(F.lit, CONVERSION_TYPES)), (F.col("p_size") % 5 + 1).cast("int")),
    ),
}
_ALL = {**_LINE, **_ORDERS, **_CUSTOMER, **_NATION, **_PART}
FACT_COLUMNS = tuple(_ALL)


def in_period(column: str, start: str, end: str):
    """Range on a raw zone-less timestamp, both days included; reaches the scan."""
    after = (date.fromisoformat(end) + timedelta(days=1)).isoformat()
    stamp = lambda day: F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    return (F.col(column) >= stamp(start)) & (F.col(column) < stamp(after))


def ad_facts(spark: SparkSession, sf_dir: str, columns, period=None) -> DataFrame:
    """Daily-fact rows with just ``columns``, optionally within ``period``."""
    wanted = list(dict.fromkeys(columns)) or ["is_click"]
    rows = table(spark, sf_dir, "lineitem")
    if period is not None:
        rows = rows.where(in_period("l_shipdate", *period))
    need = set(wanted)
    customer = need & (set(_CUSTOMER) | set(_NATION))
    if need & set(_ORDERS) or customer:
        rows = rows.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if customer:
        rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if need & set(_NATION):
        rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    if need & set(_PART):
        rows = rows.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(*[_ALL[c]().alias(c) for c in wanted])


def _date_parts(column: str, key: str):
    return [
        F.year(column).cast("string").alias("year"),
        _two(F.month(column)).alias("month"),
        _two(F.dayofmonth(column)).alias("day"),
        _two(F.col(key) % 24).alias("hour"),
    ]


def _epoch_ms(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) / 1000


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One impression per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("impression_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderpriority").alias("device_type"),
        F.col("o_orderstatus").alias("ad_format"),
        F.col("o_totalprice").alias("cost_per_impression"),
        _epoch_ms("o_orderdate").cast("long").alias("timestamp"),
        F.col("o_orderdate").cast("date").alias("dt"),
        *_date_parts("o_orderdate", "o_orderkey"),
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One click per returned or accepted line."""
    return table(spark, sf_dir, "lineitem").where(_is_click()).select(
        F.concat(F.lit("c"), _line_id()).alias("click_id"),
        F.col("l_orderkey").cast("string").alias("impression_id"),
        F.col("l_linenumber").alias("click_position_x"),
        F.col("l_quantity").cast("int").alias("click_position_y"),
        F.concat(F.lit("/ad/"), F.col("l_partkey").cast("string")).alias("landing_page_url"),
        F.col("l_discount").alias("cost_per_click"),
        _epoch_ms("l_shipdate").cast("long").alias("timestamp"),
        *_date_parts("l_shipdate", "l_orderkey"),
    )


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One conversion per returned line; the window is 1, 7 or 30 days."""
    return table(spark, sf_dir, "lineitem").where(_is_conversion()).select(
        F.concat(F.lit("v"), _line_id()).alias("conversion_id"),
        F.concat(F.lit("c"), _line_id()).alias("click_id"),
        F.col("l_orderkey").cast("string").alias("impression_id"),
        F.element_at(
            F.array(*map(F.lit, CONVERSION_TYPES)), (F.col("l_linenumber") % 5 + 1).cast("int")
        ).alias("conversion_type"),
        F.col("l_extendedprice").alias("conversion_value"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.element_at(
            F.array(F.lit("1day"), F.lit("7day"), F.lit("30day")),
            (F.col("l_linenumber") % 3 + 1).cast("int"),
        ).alias("attribution_window"),
        _epoch_ms("l_shipdate").cast("long").alias("timestamp"),
        *_date_parts("l_shipdate", "l_orderkey"),
    )


# First second of the test week, and how orders and lines are spread over it.
LOG_START = "2026-03-01 00:00:00"
LOG_SECONDS, LOG_STRIDE = 7 * 86_400, 7_919
CLICK_DELAY, CONVERSION_DELAY = 120, 3 * 3_600


def _log_time(order: str, delay=None):
    """Second of the week; clicks follow by minutes, conversions by hours."""
    second = F.unix_seconds(F.lit(LOG_START).cast("timestamp")) + F.col(order) * LOG_STRIDE % LOG_SECONDS
    return F.timestamp_seconds(second if delay is None else second + delay)


def _log(rows: DataFrame, time, *columns) -> DataFrame:
    stamped = rows.withColumn("_t", time)
    parts = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}
    return stamped.select(
        F.unix_millis("_t").alias("timestamp"), *columns, *(F.date_format("_t", f).alias(n) for n, f in parts.items())
    )


def log_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A week of raw logs. A click comes 2 to 100 minutes after its impression, often in the
    next hour; a conversion 3 to 21 hours after its click, often on the next day."""
    lines = table(spark, sf_dir, "lineitem")
    click = (F.col("l_quantity") * CLICK_DELAY).cast("bigint")
    order = F.col("l_orderkey").cast("string").alias("impression_id")
    return {
        "impressions": _log(
            table(spark, sf_dir, "orders"), _log_time("o_orderkey"),
            F.col("o_orderkey").cast("string").alias("impression_id"), F.col("o_custkey").cast("string").alias("user_id"),
            F.col("o_orderpriority").alias("device_type"), F.col("o_totalprice").alias("cost_per_impression"),
        ),
        "clicks": _log(
            lines.where(_is_click()), _log_time("l_orderkey", click), order,
            F.concat(F.lit("c"), _line_id()).alias("click_id"), F.col("l_discount").alias("cost_per_click"),
        ),
        "conversions": _log(
            lines.where(_is_conversion()), _log_time("l_orderkey", click + F.col("l_linenumber") * CONVERSION_DELAY), order,
            F.concat(F.lit("v"), _line_id()).alias("conversion_id"), F.concat(F.lit("c"), _line_id()).alias("click_id"),
            F.col("l_extendedprice").alias("conversion_value"),
        ),
    }


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log with a zoned event time (the stored one has no zone)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# How the event log stands in for ad events.
EVENT_KINDS = {"view": "impression", "click": "click", "purchase": "conversion", "signup": "conversion"}


def ad_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log in ad terms: ``props.k`` is the ad, ``value`` the bid or click cost."""
    kind = F.col("event_type")
    named = None
    for raw, name in EVENT_KINDS.items():
        named = F.when(kind == raw, name) if named is None else named.when(kind == raw, name)
    return events(spark, sf_dir).select(
        "event_id",
        "ts",
        F.col("ts").cast("date").alias("date"),
        F.get_json_object("props", "$.k").alias("ad_id"),
        F.col("user_id").cast("string").alias("user_id"),
        named.otherwise("other").alias("event_type"),
        F.col("value").alias("bid_price"),
        F.when(kind == "click", F.col("value")).alias("cpc_cost"),
    )
