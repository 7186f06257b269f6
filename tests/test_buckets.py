"""Facts in hour and day partitions that lie in buckets of the impression."""

import re
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenads import session
from lumenads.functions.dates import tuple_range
from lumenads.operators.joins import hour_of_daily
from lumenads.plans import etl
from lumenads.schemas import CLICKS, CONVERSIONS, IMPRESSIONS
from lumenads.sources import buckets
from lumenads.sources.buckets import CO_PARTITIONED, settings
from lumenads.sources.files import write_raw
from tests.test_etl import at, frame

DAY = ("2026", "03", "14")
NOON = [(*DAY, f"{h:02d}") for h in range(9, 14)]
NEXT_DAY = ("2026", "03", "15", "00")


def both():
    return tuple_range("2026-03-14", "2026-03-15")



@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """Impressions of five hours; each clicked in its hour, the next hour, or the next day."""
    root = str(tmp_path_factory.mktemp("raw"))
    imps, clks, convs = [], [], []
    for n in range(100):
        hour = NOON[n % 5]
        later = (hour, NOON[min(n % 5 + 1, 4)], NEXT_DAY)[n % 3]
        imps.append(at(hour, impression_id=f"i{n}", timestamp=n))
        clks.append(at(later, click_id=f"c{n}", impression_id=f"i{n}", timestamp=n))
        convs.append(at((hour, NEXT_DAY)[n % 2], conversion_id=f"v{n}", impression_id=f"i{n}", conversion_value=1.0))
    imps += [at(NOON[0], timestamp=1)] * 5  # without an id
    clks += [at(NOON[0], click_id="lost")]
    imps.append(at(NEXT_DAY, impression_id="late", timestamp=1))
    for name, schema, rows in (("impressions", IMPRESSIONS, imps), ("clicks", CLICKS, clks), ("conversions", CONVERSIONS, convs)):
        write_raw(frame(spark, schema, rows), f"{root}/{name}")
    return root


def tables(tmp_path, n=4):
    tag = uuid.uuid4().hex
    return etl.hourly_table(f"h_{tag}", str(tmp_path), n), etl.daily_table(f"d_{tag}", str(tmp_path), n)


def clicked(n):
    """Whether the click falls into the hour of its impression."""
    return n % 3 == 0 or (n % 3 == 1 and n % 5 == 4)


def test_clicks_of_the_next_hour_do_not_attach(spark, logs, tmp_path):
    hourly, _ = tables(tmp_path)
    etl.fill_hours(spark, logs, hourly, "2026-03-14", "2026-03-15")
    rows = hourly.scan(spark).collect()
    assert len(rows) == 106
    assert {r.impression_id for r in rows if r.is_click} == {f"i{n}" for n in range(100) if clicked(n)}
    assert sum(r.impression_id is None for r in rows) == 5


def test_hour_span_and_now(spark, logs, tmp_path):
    hourly, _ = tables(tmp_path)
    etl.fill_hours(spark, logs, hourly, "2026-03-14", "2026-03-14", 10, 12, now=datetime(2026, 3, 14, 11))
    assert {r.hour for r in hourly.scan(spark).collect()} == {"10", "11"}


def test_rerun_replaces_its_partitions_only(spark, logs, tmp_path):
    hourly, _ = tables(tmp_path)
    etl.fill_hours(spark, logs, hourly, "2026-03-14", "2026-03-15")
    before = hourly.scan(spark).count()
    kept = set(hourly.scan(spark, F.col("hour") != "09").inputFiles())
    etl.fill_hours(spark, logs, hourly, "2026-03-14", "2026-03-14", 9, 9)
    assert hourly.scan(spark).count() == before
    assert set(hourly.scan(spark, F.col("hour") != "09").inputFiles()) == kept


def test_days_equal_the_shuffled_join_and_lack_hours(spark, logs, tmp_path):
    hourly, daily = tables(tmp_path)
    lacking = etl.fill_days(spark, logs, hourly, daily, "2026-03-14", "2026-03-15")
    assert sorted((r.day, r.hours) for r in lacking.collect()) == [("14", 5), ("15", 1)]
    names = sorted(daily.scan(spark).columns)
    got = sorted(map(str, daily.scan(spark).select(names).collect()))
    conversions = etl.raw_tables(spark, logs)["conversions"]
    wanted = etl.build_daily(hourly.scan(spark), conversions, both())
    assert got == sorted(map(str, wanted.select(names).collect()))
    assert sum("conversion_id='v" in r for r in got) == 50


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if re.search(r"\bExchange\b", line)], plan


def test_daily_join_reads_the_stored_side_as_it_lies(spark, logs, tmp_path):
    hourly, _ = tables(tmp_path)
    etl.fill_hours(spark, logs, hourly, "2026-03-14", "2026-03-15")
    conversions = etl.raw_tables(spark, logs)["conversions"]
    with settings(spark, {**CO_PARTITIONED, "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        found, plan = exchanges(etl.daily_rows(spark, hourly, conversions, both()))
    assert len(found) == 1 and "SortMergeJoin" in plan  # of the conversions
    assert "SelectedBucketsCount: 4 out of 4" in plan


def test_stored_facts_join_bucket_to_bucket(spark, logs, tmp_path):
    hourly, daily = tables(tmp_path)
    etl.fill_days(spark, logs, hourly, daily, "2026-03-14", "2026-03-15")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        found, plan = exchanges(hour_of_daily(hourly.scan(spark), daily.scan(spark)))
    assert not found and "SortMergeJoin" in plan


def test_heavy_bucket_falls_back_to_the_spread_join(spark, logs, tmp_path, monkeypatch):
    hourly, _ = tables(tmp_path)
    etl.fill_hours(spark, logs, hourly, "2026-03-14", "2026-03-15")
    assert hourly.is_even(spark, both())
    assert {r.bucket for r in hourly.weights(spark).collect()} == {0, 1, 2, 3}
    conversions = etl.raw_tables(spark, logs)["conversions"]
    with settings(spark, CO_PARTITIONED):
        even = sorted(map(str, etl.daily_rows(spark, hourly, conversions, both()).collect()))
        monkeypatch.setattr(buckets, "HEAVY_BYTES", 1)
        monkeypatch.setattr(buckets, "HEAVY", 0.5)
        assert not hourly.is_even(spark, both())
        assert sorted(map(str, etl.daily_rows(spark, hourly, conversions, both()).collect())) == even


def test_empty_range_leaves_stored_rows(spark, logs, tmp_path):
    hourly, daily = tables(tmp_path)
    etl.fill_days(spark, logs, hourly, daily, "2026-03-14", "2026-03-15")
    before = daily.scan(spark).count()
    assert etl.fill_days(spark, logs, hourly, daily, "2027-01-01", "2027-01-02").count() == 0
    assert daily.scan(spark).count() == before


def test_buckets_grow_with_the_logs(spark, logs, monkeypatch):
    total = session.folder_bytes(spark, logs)
    assert total > 1000 and buckets.buckets_for(spark, logs, 2) == 2
    monkeypatch.setattr(buckets, "BUCKET_BYTES", total // 5)
    assert buckets.buckets_for(spark, logs, 2) in (5, 6)


def test_shuffles_grow_with_the_input(spark, tmp_path, monkeypatch):
    """A task's share stays the same; small partitions are merged again."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    path = str(tmp_path / "rows.parquet")
    spark.range(1000).write.parquet(path)
    try:
        session.fit_to_input(spark, str(tmp_path))
        assert spark.conf.get(key) == spark.conf.get("spark.sql.shuffle.partitions")
        monkeypatch.setattr(session, "SHARE_BYTES", session.folder_bytes(spark, str(tmp_path)) // 60)
        session.fit_to_input(spark, str(tmp_path))
        n = int(spark.conf.get(key))
        found, _ = exchanges(spark.read.parquet(path).groupBy("id").count())
        assert n >= 60 and f", {n})" in found[0]
    finally:
        spark.conf.unset(key)
