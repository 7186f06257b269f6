"""Trend, bends and waves by distributed least squares."""

import math
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenads.operators import trend as T

START = datetime(2024, 1, 1)


def series(spark, values, step_hours=24):
    rows = [(START + timedelta(hours=step_hours * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "t timestamp, y double").repartition(5)


def two_years():
    day = np.arange(730)
    wave = 40 * np.sin(2 * math.pi * day / 365.25) + 5 * np.sin(2 * math.pi * day / 7)
    return 200 + 0.1 * day + np.where(day > 400, 0.2 * (day - 400), 0) + wave + np.random.default_rng(1).normal(0, 3, 730)


def test_coefficients_equal_numpy(spark):
    rows = series(spark, two_years())
    model = T.fit_trend(rows, "t", "y")
    x = np.array([r.t.timestamp() for r in rows.collect()])
    y = np.array([r.y for r in rows.collect()])
    matrix = model.shape.matrix(x)
    weight = np.diag(model.shape.penalty + 1e-9 * np.trace(matrix.T @ matrix) / matrix.shape[1])
    expected = np.linalg.solve(matrix.T @ matrix + weight, matrix.T @ y)
    assert np.allclose(matrix @ np.array(model.coefficients), matrix @ expected, rtol=1e-6)
    assert model.points == 730 and {w[0] for w in model.shape.waves} == {"daily", "weekly", "yearly"}
    solved = T.normal_equations(rows, model, "t", "y").collect()
    assert len(solved) == len(model.shape.names) and all(r.solved for r in solved)


def test_two_years_stay_inside_their_band_and_hurt_days_do_not(spark):
    values = two_years()
    model = T.fit_trend(series(spark, values), "t", "y")
    hurt = values.copy()
    hurt[[100, 500]] = values[[100, 500]] + np.array([-60, 60])
    scored = {r.t: r.anomaly_type for r in T.score_trend(series(spark, hurt), model, "t", "y").collect()}
    assert scored[START + timedelta(days=100)] == "Sudden Drop" and scored[START + timedelta(days=500)] == "Sudden Spike"
    assert sum(v is None for v in scored.values()) / len(scored) > 0.92


def test_the_yearly_wave_matters(spark):
    rows = series(spark, two_years())
    without = {k: v for k, v in T.WAVES.items() if k != "yearly"}
    assert T.fit_trend(rows, "t", "y").spread * 2 < T.fit_trend(rows, "t", "y", bends=3, waves=without).spread


def test_short_history_has_no_yearly_wave(spark):
    model = T.fit_trend(series(spark, range(100)), "t", "y")
    assert "yearly" not in {w[0] for w in model.shape.waves}
    predicted = [r.predicted for r in T.score_trend(series(spark, range(100)), model, "t", "y").orderBy("t").collect()]
    assert np.allclose(predicted, range(100), atol=0.5)


def test_bend_is_found(spark):
    values = [i if i < 100 else 100 + 5 * (i - 100) for i in range(200)]
    model = T.fit_trend(series(spark, values, 1), "t", "y", bends=25, waves={})
    scored = T.score_trend(series(spark, values, 1), model, "t", "y").orderBy("t").collect()
    assert max(abs(r.predicted - r.y) for r in scored) < 8


def test_band_equals_sql_given_the_coefficients(spark):
    rows = series(spark, two_years())
    model = T.fit_trend(rows, "t", "y")
    features = pd.DataFrame(model.shape.matrix(np.array([r.t.timestamp() for r in rows.collect()])), columns=model.shape.names)
    features["t"] = [r.t for r in rows.collect()]
    sums = " + ".join(f"{b!r}::DOUBLE * {n}" for n, b in zip(model.shape.names, model.coefficients))
    con = duckdb.connect()
    con.register("features", features)
    expected = dict(con.execute(f"SELECT t, {sums} FROM features").fetchall())
    for r in T.score_trend(rows, model, "t", "y").collect():
        assert r.predicted == pytest.approx(expected[r.t], abs=1e-7)
        assert r.upper - r.predicted == pytest.approx(T.Z_95 * model.spread)


def test_edges(spark):
    empty = spark.createDataFrame([], "t timestamp, y double")
    assert T.fit_trend(empty, "t", "y") is None
    one = spark.createDataFrame([(START, 3.0), (None, 1.0), (START, None)], "t timestamp, y double")
    model = T.fit_trend(one, "t", "y")
    assert model.points == 1
    assert T.score_trend(one.where("y = 3"), model, "t", "y").first().predicted == pytest.approx(3.0, abs=0.1)
    assert T.score_trend(one, model, "t", "y").where(F.col("t").isNull()).first().predicted is None
