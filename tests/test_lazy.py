"""Reports are plans: building one runs nothing, and branches share their shuffle."""

import re

import pytest

import __spark_entry__ as entry
from lumenads.operators.performance import shared_rows, with_share
from tests.conftest import SF_DIR

LAZY = ("G35_underperforming_ads", "G46_action_items", "G47_highlights", "W7_rank_roas", "D2_feedback_dedup")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("key", LAZY)
def test_building_runs_no_job(spark, key):
    spark.sparkContext.setJobGroup(f"build-{key}", key)
    try:
        df = entry.queries()[key](spark, SF_DIR)
        # reading a Parquet footer is the only job that naming a table may need
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"build-{key}")
        stages = [s for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
        names = {spark.sparkContext.statusTracker().getStageInfo(s).name for s in stages}
        assert all(n.startswith("parquet at") for n in names), names
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert df.columns


@pytest.mark.parametrize("key", ("G35_underperforming_ads", "G46_action_items", "G47_highlights", "W7_rank_roas"))
def test_facts_are_scanned_once(spark, key):
    plan = final_plan(entry.queries()[key](spark, SF_DIR))
    assert len(re.findall(r"FileScan parquet.*lineitem\.parquet", plan)) == 1, plan
    assert "ReusedExchange" in plan


def test_shared_rows_keep_nulls_and_types(spark):
    df = spark.createDataFrame([(None, 1, 2.5), ("a", None, None)], "k string, n long, x double")
    assert sorted(map(str, shared_rows(df, ("k",)).collect())) == sorted(map(str, df.collect()))
    shares = with_share(df, many_by=("k",), part="n").collect()
    assert {r.k: r.part for r in shares} == {None: 100.0, "a": None}
