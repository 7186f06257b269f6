"""Windows, late data, anomaly models, streaming ingest and similarity."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenads.operators import anomaly as A
from lumenads.operators import series as S
from lumenads.operators import similarity as V
from lumenads.schemas import CLICKS, HOUR_PARTITION, IMPRESSIONS
from lumenads.sources.files import csv_series_read, csv_write, retention_filter, scan_hive_parquet, ttl_filter
from lumenads.streaming import ingest as I
from lumenads.streaming import windows as W

T0 = datetime(2026, 3, 2, 10, 0)


def minute(n):
    return T0 + timedelta(minutes=n)


def counts(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, n long")


def test_tumbling_batch(spark):
    rows = counts(spark, [(minute(0), 100), (minute(1), 50), (minute(3), 30), (minute(5), 200)])
    got = {r.window_start: r.total for r in S.tumbling(rows, "ts", "5 minutes", F.sum("n").alias("total")).collect()}
    assert got == {minute(0): 180, minute(5): 200}


def test_watermark_merges_late_rows_and_drops_too_late_ones(spark, tmp_path):
    source = str(tmp_path / "in")
    batches = [
        [(minute(0), 100), (minute(6), 10)],
        [(minute(1), 50), (minute(40), 1)],
        [(minute(2), 999), (minute(41), 1)],
        [(minute(90), 1)],
    ]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for rows in batches:
        counts(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp, n long").parquet(source)
        W.drain_to_parquet(W.tumbling_sum(stream, "ts", F.col("n")), out, state).awaitTermination()
    got = {r.window_start: r.total for r in spark.read.parquet(out).collect()}
    assert got == {minute(0): 150, minute(5): 10, minute(40): 2}


def test_zero_fill_whole_day(spark):
    rows = counts(spark, [(T0, 5), (minute(60), 7)])
    filled = S.zero_fill(rows, "ts", ["n"], "5 MINUTES", by_day=True)
    assert filled.count() == 288
    assert filled.agg(F.sum("n")).first()[0] == 12


def test_alarms(spark):
    series = counts(spark, [(minute(0), 9), (minute(5), 3), (minute(10), 20), (minute(15), 1)])
    got = [r.alarm for r in S.low_traffic_alarm(series, "ts", "n").orderBy("ts").collect()]
    assert got == [False, True, False, False]
    lag = spark.createDataFrame([(minute(0), minute(16)), (minute(20), minute(21))], "e timestamp, i timestamp")
    rows = S.freshness_alarm(lag, "e", "i").orderBy("window_start").collect()
    assert [(r.max_lag_seconds, r.alarm) for r in rows] == [(960.0, True), (60.0, False)]


def synthetic(days, hurt=()):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(days * 288):
        t = datetime(2026, 2, 2) + timedelta(minutes=5 * i)
        level = 300 + 200 * np.sin(2 * np.pi * (t.hour * 60 + t.minute) / 1440) + rng.normal(0, 8)
        rows.append((t, int(level * dict(hurt).get(t, 1.0))))
    return rows


def test_band_flags_injected_anomalies(spark):
    first = datetime(2026, 3, 2)
    hurt = {
        first + timedelta(days=0, hours=19): 0.15, first + timedelta(days=2, hours=3): 8.0,
        first + timedelta(days=11, hours=12): 0.10,
    }
    rows = synthetic(42, hurt.items())
    history = counts(spark, [r for r in rows if r[0] < first])
    live = counts(spark, [r for r in rows if r[0] >= first])
    model = A.fit_band(history, "ts", "n").cache()
    scored = {r.ts: r for r in A.score_band(live, model, "ts", "n").collect()}
    kinds = [scored[t].anomaly_type for t in hurt]
    assert kinds == ["Sudden Drop", "Sudden Spike", "Sudden Drop"]
    normal = [r for t, r in scored.items() if t not in hurt]
    assert sum(r.status == "NORMAL" for r in normal) / len(normal) > 0.9


def test_forest_isolates_extremes(spark):
    rows = [(minute(5 * i), 100 + i % 13) for i in range(600)] + [(minute(3500), 5000), (minute(3505), 0)]
    series = counts(spark, rows)
    forest = A.fit_forest(series, "ts", "n")
    trees = forest.collect()
    assert len({t.tree for t in trees}) == A.TREES
    for tree in range(A.TREES):  # intervals without gap or overlap, open at both ends
        cuts = sorted((t.low, t.high) for t in trees if t.tree == tree and t.low is not None)
        first = [t for t in trees if t.tree == tree and t.low is None]
        assert len(first) == 1 and [c[0] for c in cuts] == [first[0].high, *[c[1] for c in cuts[:-1]]] and cuts[-1][1] is None
    scored = A.score_forest(series, forest, "n")
    flagged = A.flag_outliers(scored, A.outlier_threshold(scored)).where("is_outlier").collect()
    assert {5000, 0} <= {r.n for r in flagged}
    assert len(flagged) <= 0.05 * len(rows) + 1
    again = {r.ts: r.score for r in A.score_forest(series, A.fit_forest(series, "ts", "n"), "n").collect()}
    assert again == {r.ts: r.score for r in scored.collect()}


def test_forest_scores_of_a_short_history(spark):
    series = counts(spark, [(minute(5 * i), 100 + i % 7) for i in range(60)])
    forest = A.fit_forest(series, "ts", "n")
    assert {t.rows for t in forest.collect()} == {60}
    by_tree = {}
    for t in forest.collect():
        by_tree.setdefault(t.tree, []).append(t)
    for step in A.forest_steps(forest).collect():  # the steps are the sum over the trees
        inside = step.high if step.high is not None else step.low + 1
        own = [t for rows in by_tree.values() for t in rows if (t.low is None or inside > t.low) and (t.high is None or inside <= t.high)]
        assert abs(step.depth - sum(t.path_length for t in own)) < 1e-9 and len(own) == A.TREES
    scores = [r.score for r in A.score_forest(series, forest, "n").collect()]
    assert 0.3 < min(scores) and max(scores) < 0.65


def test_ensemble_labels_and_alert(spark):
    rows = spark.createDataFrame(
        [(minute(0), "Sudden Drop", True), (minute(5), "Sudden Spike", False), (minute(10), None, True), (minute(15), None, False)],
        "ts timestamp, anomaly_type string, is_outlier boolean",
    )
    out = A.ensemble_flag(rows)
    assert [r.anomaly_label for r in out.orderBy("ts").collect()] == [
        "Sudden Drop [Prophet + IsoForest]", "Sudden Spike [Prophet]", "Outlier [IsoForest]", None
    ]
    assert not A.latest_alert(out, "ts").first().alert
    newest = A.latest_alert(out.where(F.col("ts") < F.lit(minute(15))), "ts").first()
    assert newest.alert and newest.span == "10:05 ~ 10:10"


def test_retrain_uses_the_batch_before(spark):
    rows = [(minute(5 * i), 10 if i < 288 else 20) for i in range(3 * 288)]
    scored = A.retrain_scores(counts(spark, rows), "ts", "n").collect()
    by_model = {m: {(r.predicted, r.anomaly_type) for r in scored if r.model_no == m} for m in (0, 1, 2)}
    assert by_model == {0: {(None, None)}, 1: {(10.0, "Sudden Spike")}, 2: {(20.0, None)}}


def test_ndjson_ingest_lands_good_and_rejects_bad(spark, tmp_path):
    source = tmp_path / "lines"
    source.mkdir()
    good = [{"event_id": str(i), "timestamp": 1772445600000 + i, "impression_id": "i"} for i in range(3)]
    bad = ["{broken", "", json.dumps({"event_id": "9"}), json.dumps({"event_id": "8", "timestamp": "soon"})]
    (source / "a.json").write_text("\n".join([json.dumps(x) for x in good] + bad) + "\n")
    sink, errors = str(tmp_path / "sink"), str(tmp_path / "errors")
    stream = I.read_lines(spark, str(source))
    for _ in range(2):
        I.ndjson_ingest(stream, IMPRESSIONS, sink, errors, str(tmp_path / "state"), True).awaitTermination()
    landed = spark.read.parquet(sink)
    assert landed.count() == 3 and {r.day for r in landed.select("day").collect()} == {2}
    assert sorted(r.line for r in spark.read.parquet(errors).collect()) == sorted(bad)
    # another stream, and the same one on a new checkpoint, add to both sinks and replace nothing
    I.ndjson_ingest(stream, IMPRESSIONS, sink, errors, str(tmp_path / "other"), True, stream="b").awaitTermination()
    I.ndjson_ingest(stream, IMPRESSIONS, sink, errors, str(tmp_path / "again"), True).awaitTermination()
    assert spark.read.parquet(sink).count() == 9 and spark.read.parquet(errors).count() == 3 * len(bad)
    hour = scan_hive_parquet(spark, sink, IMPRESSIONS, where=F.col("hour") == "10")
    assert hour.count() == 9 and "PartitionFilters: []" not in hour._jdf.queryExecution().executedPlan().toString()
    I.compact(scan_hive_parquet(spark, sink, IMPRESSIONS), str(tmp_path / "raw"))
    raw = scan_hive_parquet(spark, str(tmp_path / "raw"), IMPRESSIONS)
    assert raw.count() == 9 and {tuple(r) for r in raw.select(*HOUR_PARTITION).collect()} == {("2026", "03", "02", "10")}


def test_flush_adds_open_windows_once(spark, tmp_path):
    rows = [(minute(m), 1) for m in (0, 1, 12, 40, 41, 55)]
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    counts(spark, rows).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, n long").parquet(source)
    W.drain_to_parquet(W.tumbling_sum(stream, "ts", F.col("n")), path, str(tmp_path / "state")).awaitTermination()
    closed = spark.read.parquet(path).count()
    for _ in range(2):
        W.flush_open_windows(spark.read.parquet(source), path, "ts", F.col("n"))
    got = sorted((r.window_start, r.total) for r in spark.read.parquet(path).collect())
    assert closed < 4 and got == [(minute(0), 2), (minute(10), 1), (minute(40), 2), (minute(55), 1)]


def test_router_drops_fields_a_kind_does_not_own(spark):
    mixed = spark.createDataFrame(
        [("e1", "i", None, None, "z"), ("e2", "i", "c", None, "z"), ("e3", "i", "c", "v", "z")],
        "event_id string, impression_id string, click_id string, conversion_id string, _internal string",
    )
    parts = I.route(mixed)
    assert {k: [r.event_id for r in v.collect()] for k, v in parts.items()} == {
        "impression": ["e1"], "click": ["e2"], "conversion": ["e3"]
    }
    assert "_internal" not in parts["click"].columns
    assert set(parts["click"].columns) <= {f.name for f in CLICKS}


def test_score_stream_writes_each_batch(spark, tmp_path):
    history = counts(spark, synthetic(14)).cache()
    model = A.fit_band(history, "ts", "n")
    source = str(tmp_path / "w")
    counts(spark, [(datetime(2026, 2, 16, 3), 5000), (datetime(2026, 2, 16, 4), 500)]).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, n long").parquet(source)
    W.score_stream(stream, lambda: model, "ts", "n", str(tmp_path / "o"), str(tmp_path / "s")).awaitTermination()
    rows = spark.read.json(str(tmp_path / "o")).collect()
    assert sorted((r.n, r.status) for r in rows)[-1] == (5000, "ANOMALY")


def test_csv_series_and_retention(spark, tmp_path):
    path = str(tmp_path / "c")
    csv_write(spark.createDataFrame([(minute(5), 2), (minute(0), 1), (minute(5), 2)], "timestamp timestamp, n long"), path)
    assert [r.n for r in csv_series_read(spark, path, "n").collect()] == [1, 2]
    old = spark.createDataFrame([(T0,), (T0 - timedelta(days=91),)], "ts timestamp")
    assert retention_filter(old, "ts", str(T0)).count() == 1
    ttl = spark.createDataFrame([(5,), (15,), (None,)], "ttl long")
    assert ttl_filter(ttl, 10).count() == 2


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("block, slice_rows", [(3, 100), (1024, 8192)])
def test_vector_topk_equals_brute_force(spark, monkeypatch, metric, block, slice_rows):
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    monkeypatch.setattr(V, "SLICE_ROWS", slice_rows)
    rng = np.random.default_rng(1)
    corpus, queries = rng.normal(size=(500, 8)), rng.normal(size=(10, 8))
    corpus[7] = corpus[3]
    corpus_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "vec_id long, embedding array<double>").repartition(5)
    query_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, query_vector array<double>")
    got = {}
    for r in V.vector_topk(corpus_df, query_df, 6, metric).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q, vector in enumerate(queries):
        if metric == "cosine":
            scores = np.maximum(corpus @ vector / np.linalg.norm(corpus, axis=1) / np.linalg.norm(vector), 0)
        else:
            scores = 1 / (1 + ((corpus - vector) ** 2).sum(axis=1))
        best = sorted((-round(s, 6), i) for i, s in enumerate(scores))[:6]
        assert [got[q][n + 1][0] for n in range(6)] == [i for _, i in best]


def test_vector_topk_with_text_ids(spark):
    corpus = spark.createDataFrame(
        [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", None)], "vec_id string, embedding array<float>"
    )
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vector array<double>")
    got = sorted((r["rank"], r.query_id, r.vec_id, r.score) for r in V.vector_topk(corpus, asked, 2).collect())
    assert got == [(1, "q", "a", 1.0), (2, "q", "b", 1.0)]


def test_vector_topk_without_queries_and_backtrace(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    none = spark.createDataFrame([], "query_id long, query_vector array<double>")
    assert V.vector_topk(corpus, none, 3).count() == 0
    hits = spark.createDataFrame([(1, ["ad_combined_log"]), (2, None)], "query_id long, tables array<string>")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: r.tables for r in V.table_backtrace(hits, asked).collect()}
    assert got == {1: ["ad_combined_log"], 2: sorted(V.ALL_TABLES), 3: sorted(V.ALL_TABLES)}
    ranked = spark.createDataFrame([(1, 10, 1, 0.1), (1, 11, 2, 0.9), (1, 12, 3, None)], "query_id long, vec_id long, rank int, s double")
    assert [r.vec_id for r in V.rerank_topk(ranked, 2, "s").orderBy("new_rank").collect()] == [11, 10]
    assert [r.vec_id for r in V.rerank_topk(ranked, 2).orderBy("new_rank").collect()] == [10, 11]
