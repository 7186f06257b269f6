"""Windows with corrections and models refitted in the stream."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenads.operators.anomaly import retrain_scores
from lumenads.streaming import stateful as K

START = datetime(2026, 3, 14)
ROW = "series string, ts timestamp, value double"
MINUTE = 60_000


class Feed:
    """A folder of files, drained file after file from one checkpoint."""

    def __init__(self, spark, tmp_path):
        self.spark, self.source = spark, str(tmp_path / "in")
        self.out, self.state = str(tmp_path / "out"), str(tmp_path / "state")

    def rows(self, rows):
        return self.spark.createDataFrame([(s, START + timedelta(minutes=m), v) for s, m, v in rows], ROW)

    def send(self, *rows, horizon="1 day"):
        self.rows(rows).coalesce(1).write.mode("append").parquet(self.source)
        stream = self.spark.readStream.schema(ROW).parquet(self.source)
        totals = K.window_totals(stream, F.col("series"), "ts", F.col("value"), horizon=horizon)
        return K.drain(totals, self.out, self.state, "totals")

    def flush(self, n):
        K.flush_totals(self.spark.read.schema(ROW).parquet(self.source), self.out, F.col("series"), "ts", F.col("value"), flush=n)

    def emitted(self):
        rows = self.spark.read.schema(K.TOTALS).parquet(self.out).where("revision >= 0").collect()
        zero = int(START.timestamp() * 1000)
        return sorted((r.series, (r.window_ms - zero) // MINUTE, r.total / K.UNIT, r.revision) for r in rows)

    def totals(self):
        rows = K.latest_totals(self.spark, self.out).collect()
        return sorted((r.series, int((r.window_start - START).total_seconds() // 60), r.total) for r in rows)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_late_row_corrects_a_closed_window_once(feed):
    feed.send(("a", 1, 1.0), ("a", 2, 2.5), ("b", 1, 7.0))
    assert feed.emitted() == []
    feed.send(("a", 16, 4.0))  # more than ten minutes past the first window
    assert feed.emitted() == [("a", 0, 3.5, 0)]
    feed.send(("a", 4, 0.25), ("a", 3, 0.25))  # late, twice in one batch
    assert feed.emitted() == [("a", 0, 3.5, 0), ("a", 0, 4.0, 1)]
    feed.send(("a", 17, 1.0), ("b", 3, None))  # nothing changes
    assert feed.emitted() == [("a", 0, 3.5, 0), ("a", 0, 4.0, 1)]
    feed.flush(0)
    assert feed.totals() == [("a", 0, 4.0), ("a", 15, 5.0), ("b", 0, 7.0)]


def test_drain_flush_drain_gives_no_window_twice(feed):
    feed.send(("a", 20, 2.0))
    feed.flush(0)
    assert feed.totals() == [("a", 20, 2.0)]
    feed.send(("a", 21, 5.0))
    feed.flush(1)
    assert feed.totals() == [("a", 20, 7.0)]
    feed.send(("a", 60, 1.0))
    feed.flush(2)
    feed.flush(2)  # once more changes nothing
    assert feed.totals() == [("a", 20, 7.0), ("a", 60, 1.0)]


def test_timer_emits_and_forgets_what_the_watermark_has_passed(feed):
    feed.send(("a", 1, 1.0), ("b", 500, 1.0), horizon="30 minutes")
    feed.send(("b", 501, 1.0), horizon="30 minutes")
    assert ("a", 0, 1.0, 0) in feed.emitted()  # series a itself has not gone on
    late = feed.send(("a", 2, 9.0), horizon="30 minutes")
    assert [r for r in feed.emitted() if r[0] == "a"] == [("a", 0, 1.0, 0)]
    dropped = [s["numRowsDroppedByWatermark"] for p in late.recentProgress for s in p["stateOperators"]]
    assert sum(dropped) == 1


def test_restart_equals_one_run(spark, tmp_path):
    rows = [(("a", "b")[n % 2], (n * 37) % 300, float(n % 11)) for n in range(200)]
    steps, whole = Feed(spark, tmp_path / "steps"), Feed(spark, tmp_path / "whole")
    for k in range(4):
        steps.send(*rows[k::4])
    whole.send(*rows)
    steps.flush(0)
    whole.flush(0)
    assert steps.totals() == whole.totals() and len(steps.totals()) > 60


def test_refit_equals_the_batch_model(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    series = spark.range(300).select(
        F.timestamp_seconds(F.lit(1_770_000_000 // 300 * 300) + F.col("id") * 300).alias("t"),
        ((F.col("id") * 7919) % 31 + F.when(F.col("id") == 250, 900).otherwise(0)).alias("n"),
    )
    for k in range(3):
        series.where(F.floor(F.col("n") * 0 + (F.unix_seconds("t") - F.lit(1_770_000_000 // 300 * 300)) / 30_000) == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(series.schema).parquet(source)
        K.drain(K.refit_scores(stream, F.lit("x"), "t", "n", every=50), out, state, "refit").awaitTermination()
    got = spark.read.schema(K.SCORES + ", anomaly_type string").parquet(out)
    key = lambda r: (r[0], r[1], None if r[2] is None else round(r[2], 9), None if r[3] is None else round(r[3], 9), r[4])
    columns = ["n", "model_no", "predicted", "spread", "anomaly_type"]
    a = sorted((key(r) for r in got.select(*columns).collect()), key=str)
    b = sorted((key(r) for r in retrain_scores(series, "t", "n", every=50).select(*columns).collect()), key=str)
    assert a == b and sum(r[4] is not None for r in a) >= 1
