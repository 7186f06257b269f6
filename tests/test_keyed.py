"""Tables updated by key, and results compared by digests."""

import re

import pytest
from pyspark.sql import functions as F

from lumenads.operators import evaluation as E
from lumenads.schemas import struct_of
from lumenads.sources.keyed import KeyedTable

SCHEMA = struct_of("id string, body string, mark string, at bigint")


@pytest.fixture
def stored(spark, tmp_path):
    table = KeyedTable(str(tmp_path), SCHEMA, "id", 32)
    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("b").alias("body"), F.lit(None).cast("string").alias("mark"), F.lit(None).cast("long").alias("at"))
    assert len(table.update(rows, 1)) == 32
    return table


def marks(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, mark string, at long")


def test_update_rewrites_the_buckets_of_its_keys_only(spark, stored):
    before = set(stored.read(spark).inputFiles())
    touched = stored.update(marks(spark, *((str(i), "x", 5) for i in range(5))), 2, ("at",), insert=False)
    after = set(stored.read(spark).inputFiles())
    assert 1 <= len(touched) <= 5 and len(before - after) <= 5 and len(before & after) >= 27
    rows = {r.id: r for r in stored.read(spark).collect()}
    assert len(rows) == 500 and {i for i, r in rows.items() if r.mark == "x"} == {str(i) for i in range(5)}
    assert all(r.body == "b" for r in rows.values())


def test_replay_changes_nothing(spark, stored):
    stored.update(marks(spark, ("1", "x", 5)), 2, ("at",))
    files = stored.read(spark).inputFiles()
    assert stored.update(marks(spark, ("1", "other", 9), ("2", "other", 9)), 2, ("at",)) == []
    assert stored.read(spark).inputFiles() == files


def test_the_newest_counts_in_any_order(spark, stored):
    stored.update(marks(spark, ("1", "late", 9), ("1", "early", 3), (None, "lost", 1)), 2, ("at",))
    stored.update(marks(spark, ("1", "old", 4), ("2", "first", 1)), 3, ("at",))
    assert [r.mark for r in stored.lookup(spark, "1").collect()] == ["late"]
    assert [r.mark for r in stored.lookup(spark, "2").collect()] == ["first"]


def test_insert_or_not(spark, stored):
    stored.update(marks(spark, ("new", "x", 1)), 2, ("at",), insert=False)
    assert stored.lookup(spark, "new").count() == 0
    stored.update(marks(spark, ("new", "x", 1)), 3, ("at",))
    assert [(r.body, r.mark) for r in stored.lookup(spark, "new").collect()] == [(None, "x")]
    assert stored.read(spark).count() == 501


def test_lookup_reads_one_bucket(spark, stored):
    assert len(stored.lookup(spark, "77").inputFiles()) <= 2
    assert stored.lookup(spark, "nobody").count() == 0


def test_unfinished_batch_is_not_seen(spark, stored, monkeypatch):
    def broken(self, spark, batch, buckets):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", broken)
        with pytest.raises(RuntimeError):
            stored.update(marks(spark, ("1", "half", 5)), 2, ("at",))
    assert stored.lookup(spark, "1").first().mark is None
    stored.update(marks(spark, ("1", "whole", 5)), 2, ("at",))
    assert stored.lookup(spark, "1").first().mark == "whole"


def test_empty_table_and_empty_batch(spark, tmp_path):
    table = KeyedTable(str(tmp_path), SCHEMA, "id", 4)
    assert table.read(spark).count() == 0
    assert table.update(marks(spark), 1, ("at",)) == [] and table.manifest(spark)[0] == 1


def test_digests_tell_multisets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "n int, s string")
    same = spark.createDataFrame([(None, 2.0), ("x", 1.0), ("x", 1.0)], "s string, m double")
    fewer = spark.createDataFrame([(1, "x"), (2, None)], "n int, s string")
    assert E.same_result(a, same).first().equal and not E.same_result(a, fewer).first().equal
    assert not E.same_result(a, a.select("n")).first().equal
    assert E.compare_results(a, same).first().asDict() == {"equal": True, "differing_keys": 0}
    assert E.compare_results(a, fewer).first().asDict() == {"equal": False, "differing_keys": 1}
    assert E.same_result(a.limit(0), fewer.limit(0)).first().equal
    plan = E.result_digest(a)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan


def shuffled_plans(spark, monkeypatch, table, rows, batch):
    """The plan of what an update writes."""
    plans = []
    write = table._dealt(rows.withColumn("_new", F.lit(1)).limit(0)).write.__class__
    real = write.parquet

    def noted(self, path, *a, **k):
        if "/data/" in path:
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real(self, path, *a, **k)

    monkeypatch.setattr(write, "parquet", noted)
    table.update(rows, batch, ("at",))
    return plans


def test_whole_rows_are_shuffled_once(spark, monkeypatch, stored, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan, = shuffled_plans(spark, monkeypatch, stored, marks(spark, *((str(i), "x", 5) for i in range(50))), 2)
        assert len(re.findall(r"\bExchange\b", plan)) == 2 and "Join" in plan  # each side of the join once
        fresh = KeyedTable(str(tmp_path / "fresh"), SCHEMA, "id", 4)
        plan, = shuffled_plans(spark, monkeypatch, fresh, marks(spark, ("1", "x", 5)), 1)
        assert "Join" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.id for r in stored.read(spark).where("mark = 'x'").collect()} == {str(i) for i in range(50)}
