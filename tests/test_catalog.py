"""External tables, partition discovery, date view, rollup table."""

import pytest
from pyspark.sql import functions as F

from lumenads.operators import history as H
from lumenads.schemas import struct_of
from lumenads.sources import catalog as C
from lumenads.sources.files import write_partitioned

SHAPE = struct_of("campaign_id string, device_type string, impression_id string, click_id string")


@pytest.fixture
def facts(spark):
    return spark.createDataFrame(
        [
            ("a", "m", "i1", "c1", "2026", "03", "01"), ("a", "m", "i1", "c2", "2026", "03", "01"),
            ("a", "w", "i2", None, "2026", "03", "02"), ("b", "m", "i3", None, "2025", "12", "31"),
        ],
        "campaign_id string, device_type string, impression_id string, click_id string, year string, month string, day string",
    )


def test_external_table_lifecycle(spark, facts, tmp_path):
    root, days = str(tmp_path / "t"), ("year", "month", "day")
    write_partitioned(facts, root, days)
    C.drop_table(spark, "ad_test")
    C.create_external_table(spark, "ad_test", SHAPE, root, days)
    C.repair_partitions(spark, "ad_test")
    assert C.table_exists(spark, "ad_test")
    assert {r[0] for r in C.list_partitions(spark, "ad_test").collect()} == {
        "year=2026/month=03/day=01", "year=2026/month=03/day=02", "year=2025/month=12/day=31"
    }
    assert spark.table("ad_test").where("year = '2026'").count() == 3
    C.drop_table(spark, "ad_test")
    assert not C.table_exists(spark, "ad_test")
    assert spark.read.parquet(root).count() == 4


def test_dt_view_and_rollup(spark, facts, tmp_path):
    C.dt_view(facts, "facts_v")
    assert str(spark.sql("SELECT MAX(dt) FROM facts_v").first()[0]) == "2026-03-02"
    C.drop_table(spark, "ad_rollup")
    C.save_rollup(facts, "ad_rollup", str(tmp_path / "r"))
    rows = {(r.campaign_id, r.device_type): (r.impressions, r.clicks, r.ctr) for r in spark.table("ad_rollup").collect()}
    assert rows == {("a", "m"): (1, 2, 200.0), ("a", "w"): (1, 0, 0.0), ("b", "m"): (1, 0, 0.0)}
    C.drop_table(spark, "ad_rollup")


def test_history_feedback_and_status(spark):
    runs = spark.createDataFrame(
        [("h1", "2026-03-01 00:00:00", "u", "x" * 600), ("h2", "2026-03-02 00:00:00", "", "y")],
        "history_id string, t string, user_id string, answer string",
    ).withColumn("timestamp", F.col("t").cast("timestamp")).drop("t")
    rows = H.history_rows(runs)
    first = rows.where("history_id = 'h1'").first()
    assert len(first.answer) == 600 and len(first.user_hash) == 16
    assert len(H.short_answer(rows).where("history_id = 'h1'").first().answer) == 500
    assert first.ttl == 1772323200 + 90 * 86400
    notes = spark.createDataFrame(
        [("h1", "negative", 1, False), ("h1", "positive", 2, True)], "history_id string, feedback string, feedback_at int, trained boolean"
    )
    got = {r.history_id: (r.feedback, r.trained) for r in H.with_feedback(rows, notes).collect()}
    assert got == {"h1": ("positive", True), "h2": (None, None)}
    assert [r.history_id for r in H.recent(rows, 1).collect()] == ["h2"]
    pending = spark.createDataFrame([("f", "pending"), ("g", "pending")], "feedback_id string, status string")
    moves = spark.createDataFrame([("f", "explain_failed", 1), ("f", "trained", 2)], "feedback_id string, status string, changed_at int")
    assert {r.feedback_id: r.status for r in H.current_status(pending, moves).collect()} == {"f": "trained", "g": "pending"}
