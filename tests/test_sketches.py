"""Distinct users and quantiles from stored days."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lumenads.operators import sketches as K

DAYS = [date(2026, 1, 25) + timedelta(days=i) for i in range(20)]


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(d, f"u{(i * 7 + k * k) % 5000}", ("x", "y")[k % 2], float((i * 31 + k) % 97)) for i, d in enumerate(DAYS) for k in range(600)]
    rows += [(DAYS[0], None, "x", None), (None, "nobody", "x", 1.0)]
    return spark.createDataFrame(rows, "dt date, user_id string, k string, v double").persist()


def test_any_range_equals_count_distinct(spark, facts, tmp_path):
    K.number_users(facts, f"{tmp_path}/n")
    K.save_day_bitmaps(facts, K.numbers(spark, f"{tmp_path}/n"), f"{tmp_path}/b", ("k",))
    for start, end in ((DAYS[0], DAYS[-1]), (DAYS[3], DAYS[9]), (DAYS[10], DAYS[10])):
        got = {r.k: r.users for r in K.users_in(spark, f"{tmp_path}/b", str(start), str(end), {"k": F.col("k")}, "k string").collect()}
        wanted = facts.where(F.col("dt").between(start, end)).groupBy("k").agg(F.count_distinct("user_id").alias("n")).collect()
        assert got == {r.k: r.n for r in wanted}
    assert K.users_in(spark, f"{tmp_path}/b", "2027-01-01", "2027-02-01", keys="k string").first().users is None


def test_new_users_keep_old_numbers(spark, facts, tmp_path):
    early, path = facts.where(F.col("dt") <= DAYS[9]), f"{tmp_path}/n"
    K.number_users(early, path)
    before = {r.user: r.number for r in K.numbers(spark, path).collect()}
    for _ in range(2):  # a rerun of a batch changes no one else
        K.number_users(facts, path, batch=1)
    after = {r.user: r.number for r in K.numbers(spark, path).collect()}
    assert before.items() <= after.items() and len(after) == len(set(after.values())) > len(before)
    # days stored before and after the new users came go together
    K.save_day_bitmaps(early, K.numbers(spark, path), f"{tmp_path}/b")
    K.save_day_bitmaps(facts.where(F.col("dt") >= DAYS[7]), K.numbers(spark, path), f"{tmp_path}/b")
    got = K.users_in(spark, f"{tmp_path}/b", str(DAYS[7]), str(DAYS[-1])).first().users
    assert got == facts.where(F.col("dt") >= DAYS[7]).agg(F.count_distinct("user_id")).first()[0]


def test_sketches_are_near(spark, facts, tmp_path):
    K.save_day_sketches(facts, str(tmp_path))
    about = K.about_users_in(spark, str(tmp_path), str(DAYS[0]), str(DAYS[-1])).first().users
    exact = facts.where("dt is not null").agg(F.count_distinct("user_id")).first()[0]
    assert abs(about - exact) <= 0.03 * exact


def test_merged_quantiles(spark, facts, tmp_path):
    K.save_day_quantiles(facts, str(tmp_path), ("k",), "v")
    for share in (0.1, 0.5, 0.95):
        found = K.quantile_in(spark, str(tmp_path), str(DAYS[0]), str(DAYS[-1]), share, ("k",), "k string")
        checked = K.rank_within(facts.where("dt is not null"), found, ("k",), "v", share).collect()
        assert {r.k: r.within for r in checked} == {"x": True, "y": True}
        assert sum(r.n for r in checked) == facts.where("dt is not null and v is not null").count()
    wrong = found.withColumn("quantile", F.col("quantile") + 20)
    assert not any(r.within for r in K.rank_within(facts, wrong, ("k",), "v", 0.5).collect())


def test_a_range_lists_its_months_only(spark, facts, tmp_path):
    K.save_day_sketches(facts, str(tmp_path))
    plan = K.about_users_in(spark, str(tmp_path), "2026-02-01", "2026-02-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "concat(year" in plan
