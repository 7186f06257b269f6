"""Schemas of the ad tables. Tables are always read with these, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def struct_of(text: str) -> T.StructType:
    """``name type, ...`` as a schema; unlike a DDL string it needs no live session."""
    pairs = (entry.split() for entry in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Column names and types of the stored tables.
IMPRESSIONS = struct_of(
    "event_id string, timestamp bigint, impression_id string, user_id string, ad_id string, "
    "campaign_id string, advertiser_id string, platform string, device_type string, os string, "
    "delivery_region string, user_lat double, user_long double, store_id string, "
    "food_category string, ad_position string, ad_format string, user_agent string, "
    "ip_address string, session_id string, keyword string, cost_per_impression double"
)
CLICKS = struct_of(
    "event_id string, timestamp bigint, click_id string, impression_id string, user_id string, "
    "ad_id string, campaign_id string, advertiser_id string, platform string, device_type string, "
    "click_position_x int, click_position_y int, landing_page_url string, cost_per_click double"
)
CONVERSIONS = struct_of(
    "event_id string, timestamp bigint, conversion_id string, click_id string, "
    "impression_id string, user_id string, ad_id string, campaign_id string, "
    "advertiser_id string, conversion_type string, conversion_value double, product_id string, "
    "quantity int, store_id string, delivery_region string, attribution_window string"
)
HOUR_PARTITION = ("year", "month", "day", "hour")
DAY_PARTITION = ("year", "month", "day")

CLICK_COLUMNS = (
    "click_id",
    "click_position_x",
    "click_position_y",
    "landing_page_url",
    "cost_per_click",
    "click_timestamp",
)
CONVERSION_COLUMNS = (
    "conversion_id",
    "conversion_type",
    "conversion_value",
    "product_id",
    "quantity",
    "attribution_window",
    "conversion_timestamp",
)
HOURLY_FACT = struct_of(
    "impression_id string, user_id string, ad_id string, campaign_id string, "
    "advertiser_id string, platform string, device_type string, os string, "
    "delivery_region string, user_lat double, user_long double, store_id string, "
    "food_category string, ad_position string, ad_format string, user_agent string, "
    "ip_address string, session_id string, keyword string, cost_per_impression double, "
    "impression_timestamp bigint, click_id string, click_position_x int, click_position_y int, "
    "landing_page_url string, cost_per_click double, click_timestamp bigint, is_click boolean"
)
DAILY_FACT = T.StructType(
    HOURLY_FACT.fields
    + struct_of(
        "conversion_id string, conversion_type string, conversion_value double, "
        "product_id string, quantity int, attribution_window string, "
        "conversion_timestamp bigint, is_conversion boolean"
    ).fields
)
HISTORY = struct_of(
    "history_id string, timestamp timestamp, user_hash string, channel string, "
    "original_question string, refined_question string, intent string, keywords array<string>, "
    "generated_sql string, sql_validated boolean, row_count bigint, query_id string, "
    "query_url string, feedback string, feedback_at timestamp, trained boolean, ttl bigint, "
    "session_id string, turn_number int, answer string"
)
PENDING_FEEDBACK = struct_of(
    "feedback_id string, history_id string, question string, sql string, sql_hash string, "
    "status string, created_at timestamp, ttl bigint"
)


def with_partitions(schema: T.StructType, partitions) -> T.StructType:
    """Schema plus its zero-padded string partition columns."""
    return T.StructType(
        schema.fields + [T.StructField(name, T.StringType()) for name in partitions]
    )
