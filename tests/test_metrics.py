"""Metric definitions, empty denominators, rounding and report rules."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lumenads.functions import dates as D
from lumenads.functions.metrics import change_rate, half_up, rate, ratio, summarise, with_rates
from lumenads.operators.performance import best_per_key, nth_row, with_share
from lumenads.plans import reports as R
from lumenads.plans.dashboards import top_and_bottom_n

FACT = (
    "impression_id string, is_click boolean, is_conversion boolean, conversion_type string, "
    "cost_per_impression double, cost_per_click double, conversion_value double"
)


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(
        [
            ("i1", True, True, "purchase", 1.0, 2.0, 30.0),
            ("i1", True, True, "signup", 1.0, 2.0, 5.0),
            ("i2", False, False, None, 4.0, None, None),
        ],
        FACT,
    )


def test_names_stay_distinct(facts):
    names = (
        "impressions", "impressions_distinct", "clicks", "conversions", "conversions_purchase", "revenue",
        "revenue_purchase", "cost_click", "cost_full", "cost_null_trap",
    )
    row = summarise(facts, (), names).first().asDict()
    assert {k: float(v) for k, v in row.items()} == {
        "impressions": 3, "impressions_distinct": 2, "clicks": 2, "conversions": 2, "conversions_purchase": 1,
        "revenue": 35, "revenue_purchase": 30, "cost_click": 4, "cost_full": 10, "cost_null_trap": 6,
    }
    roas = with_rates(
        summarise(facts, (), ("revenue", "revenue_purchase", "cost_click", "cost_full", "cost_null_trap")),
        ("roas_report", "roas_dash", "roas_qa"),
    ).first()
    assert (roas.roas_report, roas.roas_dash, round(roas.roas_qa, 6)) == (750.0, 3.5, 5.833333)


def test_empty_denominator_is_null_or_zero(facts):
    empty = summarise(facts.where("false"), (), ("impressions", "clicks"))
    assert empty.select(rate("ctr_percent")).first()[0] is None
    assert empty.select(rate("ctr_percent", 0.0)).first()[0] == 0.0


def test_half_up_survives_division_noise(spark):
    one = spark.range(1)
    assert one.select(half_up(F.lit(1.14) / 12, 2)).first()[0] == 0.1
    assert one.select(half_up(F.lit(113106.68) / 0.32, 2)).first()[0] == 353458.38
    assert one.select(ratio(F.lit(1), F.lit(8), 100, 1)).first()[0] == 12.5
    assert one.select(change_rate(F.lit(3.0), F.lit(0.0))).first()[0] is None


def test_periods():
    assert D.resolve_period("previous_month", "2026-03-01") == ("2026-02-01", "2026-02-28")
    assert D.resolve_period("last_7_days", "2026-03-03") == ("2026-02-24", "2026-03-02")
    assert D.report_period("daily", "2026-03-01") == ("2026-02-01", "2026-02-28")
    assert D.report_period("weekly", "2026-03-04") == ("2026-02-23", "2026-03-01")
    assert D.same_range_previous_month("2026-03-01", "2026-03-31") == ("2026-02-01", "2026-02-28")
    assert D.same_range_previous_month("2026-01-01", "2026-01-31") == ("2025-12-01", "2025-12-31")
    assert D.recent_days("2026-01-01", 1) == ("2025-12-31", "2025-12-31")
    with pytest.raises(ValueError):
        D.resolve_period("tomorrow", "2026-01-01")


def weeks(spark, start, end, strict):
    days = D.day_grid(spark, start, end)
    rows = D.week_calendar(days, start, end, strict).select("week_start", "week_end").distinct().collect()
    return sorted((str(r.week_start), str(r.week_end)) for r in rows)


def test_week_calendar(spark):
    assert weeks(spark, "2026-03-01", "2026-03-10", True) == [
        ("2026-03-01", "2026-03-01"), ("2026-03-02", "2026-03-08"), ("2026-03-09", "2026-03-10"),
    ]
    assert weeks(spark, "2026-03-01", "2026-03-10", False)[0] == ("2026-02-23", "2026-03-01")
    # the first week is lost when its Sunday lies after the end
    assert weeks(spark, "2026-04-01", "2026-04-03", False) == []
    assert weeks(spark, "2026-04-01", "2026-04-03", True) == [("2026-04-01", "2026-04-03")]


def test_epoch_units(spark):
    values = spark.createDataFrame([(1772336400,), (1772336400123,), (1772336400123456789,)], "v long")
    got = [r[0] for r in values.select(F.unix_micros(D.epoch_normalise("v"))).collect()]
    assert got == [1772336400000000, 1772336400123000, 1772336400123456]


def test_iso_weekday(spark):
    days = spark.createDataFrame([(date(2026, 3, 1),), (date(2026, 3, 2),), (date(2026, 3, 7),)], "d date")
    rows = days.select(D.iso_weekday("d"), D.day_type("d")).collect()
    assert [tuple(r) for r in rows] == [(7, "weekend"), (1, "weekday"), (6, "weekend")]


def test_funnel_skips_missing_stage(spark):
    counts = spark.createDataFrame([("view_content", 100), ("purchase", 25), (None, 0)], "conversion_type string, n long")
    rows = R.funnel_rates(counts).orderBy("stage_no").collect()
    assert [(r.stage, r.percent_of_first, r.percent_of_previous) for r in rows] == [
        ("view_content", 100.0, None), ("purchase", 25.0, 25.0),
    ]


def test_share_best_and_nth(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "k string, v long")
    for many in (False, True):
        shares = with_share(df, many_groups=many, s="v").collect()
        assert {r.k: r.s for r in shares} == {"a": 12.5, "b": 37.5, "c": 50.0}
    assert nth_row(df, (F.desc("v"), "k"), 2).first().k == "b"
    groups = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v long")
    assert sorted((r.k, r.v) for r in best_per_key(groups, "k", (F.desc("v"),)).collect()) == [("x", 2), ("y", 3)]


def test_top_and_bottom_overlap_is_shown_once(spark):
    rows = spark.createDataFrame(
        [(f"a{i}", True, True, 1.0, 1.0, float(i), date(2026, 1, 1)) for i in range(15)],
        "advertiser_id string, is_click boolean, is_conversion boolean, cost_per_impression double, "
        "cost_per_click double, conversion_value double, dt date",
    )
    out = top_and_bottom_n(rows, "2026-01-01", "2026-01-01").collect()
    assert sorted(r.group_rank for r in out if r.group == "top") == list(range(1, 11))
    assert [r.advertiser_id for r in sorted(out, key=lambda r: r.group_rank) if r.group == "bottom"] == [
        "a0", "a1", "a2", "a3", "a4"
    ]
