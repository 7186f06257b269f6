"""Hand-made cases for the hourly and daily joins."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenads.functions.dates import date_between, tuple_range
from lumenads.operators.joins import (
    attach_clicks,
    attribute_within_window,
    newcomers,
    outer_merge,
    spread_left_join,
)
from lumenads.operators.quality import hour_completeness, reconcile, require_table
from lumenads.plans import etl
from lumenads.schemas import (
    CLICKS,
    CONVERSIONS,
    DAILY_FACT,
    DAY_PARTITION,
    HOUR_PARTITION,
    HOURLY_FACT,
    IMPRESSIONS,
    with_partitions,
)
from lumenads.sources.files import scan_hive_parquet, write_partitioned, write_raw

H9, H10 = ("2026", "03", "14", "09"), ("2026", "03", "14", "10")
NEXT = ("2026", "03", "15", "00")


def frame(spark, schema, rows, partitions=HOUR_PARTITION):
    """Rows given as dicts; columns not named are null."""
    shape = with_partitions(schema, partitions)
    return spark.createDataFrame([tuple(r.get(f.name) for f in shape) for r in rows], shape)


def at(part, **values):
    return {**dict(zip(HOUR_PARTITION, part)), **values}


@pytest.fixture(scope="module")
def raw(spark):
    imps = [
        at(H9, impression_id="i1", timestamp=1000, campaign_id="a", cost_per_impression=1.0),
        at(H9, impression_id="i2", timestamp=1000, campaign_id="a", cost_per_impression=2.0),
        at(H9, impression_id="i3", timestamp=1000, campaign_id="b", cost_per_impression=3.0),
        at(H10, impression_id="i4", timestamp=2000, campaign_id="b", cost_per_impression=4.0),
    ]
    clks = [
        at(H9, click_id="c1", impression_id="i1", timestamp=1500, cost_per_click=0.5),
        at(H9, click_id="c2", impression_id="i1", timestamp=1600, cost_per_click=0.5),
        at(H10, click_id="c3", impression_id="i2", timestamp=2500, cost_per_click=0.5),
    ]
    convs = [
        at(H10, conversion_id="v1", click_id="c1", impression_id="i1", conversion_type="purchase", conversion_value=10.0),
        at(NEXT, conversion_id="v2", click_id="c3", impression_id="i2", conversion_type="purchase", conversion_value=20.0),
    ]
    return {
        "impressions": frame(spark, IMPRESSIONS, imps),
        "clicks": frame(spark, CLICKS, clks),
        "conversions": frame(spark, CONVERSIONS, convs),
    }


def test_hourly_join_same_hour_only_and_fan_out(raw):
    out = etl.build_hourly(raw, etl.one_hour(datetime(2026, 3, 14, 9)))
    got = sorted((r.impression_id, r.click_id, r.is_click) for r in out.collect())
    assert got == [("i1", "c1", True), ("i1", "c2", True), ("i2", None, False), ("i3", None, False)]
    assert [f.name for f in out.schema] == [f.name for f in HOURLY_FACT] + list(HOUR_PARTITION)


def test_daily_join_same_day_only(raw):
    hourly = etl.build_hourly(raw, tuple_range("2026-03-14", "2026-03-14"))
    out = etl.build_daily(hourly, raw["conversions"], tuple_range("2026-03-14", "2026-03-14"))
    rows = out.collect()
    assert [f.name for f in out.schema] == [f.name for f in DAILY_FACT] + list(DAY_PARTITION)
    assert len(rows) == 5
    assert {r.impression_id for r in rows if r.is_conversion} == {"i1"}


def test_backfill_end_to_end_and_rerun(spark, raw, tmp_path):
    raw_root, fact_root = str(tmp_path / "raw"), str(tmp_path / "facts")
    for name, df in raw.items():
        write_raw(df, f"{raw_root}/{name}")
    for _ in range(2):
        warnings = etl.backfill_days(spark, raw_root, fact_root, "2026-03-14", "2026-03-15")
    daily = scan_hive_parquet(spark, f"{fact_root}/daily", DAILY_FACT, DAY_PARTITION)
    assert daily.count() == 5
    assert {r.month for r in daily.collect()} == {"03"}
    assert [(r.day, r.hours) for r in warnings.collect()] == [("14", 2)]
    outcome = etl.backfill_outcome(
        spark, scan_hive_parquet(spark, f"{fact_root}/hourly", HOURLY_FACT), "2026-03-14", "2026-03-16",
        datetime(2026, 3, 15).date(),
    )
    assert {r.outcome: r.hours for r in outcome.collect()} == {"done": 2, "missing": 46, "future": 24}


def test_scheduled_jobs_return_check_rows(spark, raw, tmp_path):
    raw_root, fact_root = str(tmp_path / "raw"), str(tmp_path / "facts")
    for name, df in raw.items():
        write_raw(df, f"{raw_root}/{name}")
    for hour, expected in ((9, (4, 2, 2, 50.0)), (10, (1, 0, 0, 0.0))):
        row = etl.run_hour(spark, raw_root, fact_root, datetime(2026, 3, 14, hour)).first()
        assert (row.impressions, row.clicks, row.unique_clicks, row.ctr) == expected
    row = etl.run_day(spark, raw_root, fact_root, datetime(2026, 3, 14).date()).first()
    assert (row.impressions, row.clicks, row.conversions, row.campaigns, row.hours) == (4, 2, 2, 2, 2)


def test_empty_rerun_keeps_old_partition(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "2026"), ("b", "2027")], "x string, year string")
    write_partitioned(df, root, ("year",))
    write_partitioned(df.where(F.lit(False)), root, ("year",))
    write_partitioned(spark.createDataFrame([("c", "2027")], "x string, year string"), root, ("year",))
    rows = spark.read.schema("x string, year string").parquet(root).collect()
    assert sorted((r.x, r.year) for r in rows) == [("a", "2026"), ("c", "2027")]


def test_partition_filters_prune_and_stay_strings(spark, tmp_path):
    root = str(tmp_path / "p")
    days = ("2026-02-26", "2026-02-27", "2026-02-28", "2026-03-01", "2026-03-02", "2026-03-03", "2025-03-01")
    rows = [("i", *d.split("-")) for d in days]
    df = spark.createDataFrame(rows, "impression_id string, year string, month string, day string")
    write_partitioned(df, root, DAY_PARTITION)
    table = spark.read.schema(df.schema).parquet(root)
    for condition in (tuple_range("2026-02-27", "2026-03-02"), date_between("2026-02-27", "2026-03-02")):
        kept = table.where(condition)
        got = sorted(f"{r.year}-{r.month}-{r.day}" for r in kept.collect())
        assert got == ["2026-02-27", "2026-02-28", "2026-03-01", "2026-03-02"]
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: []" not in plan
        assert len(kept.inputFiles()) <= len(days)
    assert table.where(tuple_range("2026-03-01", "2026-03-01")).count() == 1


def test_spread_join_equals_plain_left_join(spark):
    left = spark.range(300).select(
        F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 40).cast("string")).alias("k"),
        F.lit("p").alias("p"), F.col("id").alias("l"),
    )
    right = spark.range(900).select(
        F.when(F.col("id") < 300, "3").when(F.col("id") % 11 == 0, None)
        .otherwise((F.col("id") % 60).cast("string")).alias("k"),
        F.lit("p").alias("p"), F.col("id").alias("r"),
    )
    plain = left.join(right, ["k", "p"], "left")
    spread = spread_left_join(left, right, ["k", "p"]).select(*plain.columns)
    assert plain.exceptAll(spread).count() == 0
    assert spread.exceptAll(plain).count() == 0
    copies = left.unionByName(left).unionByName(left.where("k IS NULL"))
    twice, plain = spread_left_join(copies, right, ["k", "p"]), copies.join(right, ["k", "p"], "left")
    assert plain.exceptAll(twice.select(*plain.columns)).count() == twice.count() - plain.count() == 0


def test_attribution_window(spark):
    day = 86_400_000
    facts = spark.createDataFrame([("i", 0), ("j", 0)], "impression_id string, impression_timestamp long")
    convs = spark.createDataFrame(
        [
            ("v1", "i", "purchase", 1.0, "1day", day), ("v2", "i", "purchase", 1.0, "1day", day + 1),
            ("v3", "i", "signup", 1.0, "30day", 29 * day), ("v4", "j", "signup", 1.0, "7day", -1),
        ],
        "conversion_id string, impression_id string, conversion_type string, conversion_value double, attribution_window string, timestamp long",
    )
    got = {(r.impression_id, r.conversion_id) for r in attribute_within_window(facts, convs).collect()}
    assert got == {("i", "v1"), ("i", "v3"), ("j", None)}


def test_newcomers_ignore_null_keys(spark):
    rows = spark.createDataFrame(
        [("a", "2026-01-01"), ("a", "2026-02-01"), ("b", "2026-02-01"), (None, "2026-01-01")], "k string, d string"
    ).withColumn("dt", F.col("d").cast("date"))
    assert [r.k for r in newcomers(rows, "k", "2026-02-01", "2026-02-28").collect()] == ["b"]


def test_outer_merge_fills_zero(spark):
    a = spark.createDataFrame([("x", 1)], "k string, a long")
    b = spark.createDataFrame([("y", 2)], "k string, b long")
    assert sorted(map(tuple, outer_merge([a, b], ["k"]).collect())) == [("x", 1, 0), ("y", 0, 2)]


def test_completeness_and_reconcile(spark):
    hours = spark.createDataFrame(
        [("2026", "03", "14", f"{h:02d}") for h in range(23)] + [("2026", "03", "15", f"{h:02d}") for h in range(24)],
        "year string, month string, day string, hour string",
    )
    assert {r.day: (r.hours, r.complete) for r in hour_completeness(hours).collect()} == {
        "14": (23, False), "15": (24, True)
    }
    row = reconcile(hours.withColumn("dt", F.col("day")), hours.where("hour < '12'").withColumn("dt", F.col("day"))).where("dt = '15'").first()
    assert (row.hourly_total, row.daily_total, row.difference, row.diff_percent) == (24, 12, 12, 100.0)


def test_missing_dependency(spark):
    with pytest.raises(LookupError):
        require_table(spark, "no_such_table")


def test_click_join_keeps_unmatched_columns(spark, raw):
    out = attach_clicks(raw["impressions"], raw["clicks"])
    assert out.where("click_id IS NULL").where("is_click").count() == 0
