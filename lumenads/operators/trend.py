"""Trend with changepoints and daily, weekly and yearly waves, by distributed least squares.

Every task turns its rows into features and adds up its part of the Gram matrix and
of the right side; the sums, a few thousand numbers, are solved once. Scoring is
column expressions. Bends of the trend carry a ridge penalty, so a bend that the
data does not ask for stays near zero.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenads.operators.anomaly import Z_95

# Task code travels by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY = 86_400.0
# Number of bends, the share of the history they lie in, and per wave its length
# in days, its number of harmonics and the days of history it takes.
BENDS, BEND_SHARE = 25, 0.8
WAVES = {"daily": (1.0, 4, 2.0), "weekly": (7.0, 3, 14.0), "yearly": (365.25, 10, 365.0)}
RIDGE = 1e-3


@dataclass(frozen=True)
class Shape:
    """Which features a model has; seconds count from ``origin``, in units of ``span``."""

    origin: float
    span: float
    bends: tuple[float, ...] = ()
    waves: tuple[tuple[str, float, int], ...] = ()

    @classmethod
    def of(cls, first: float, last: float, bends: int = BENDS, waves=WAVES) -> Shape:
        """Bends evenly over the first part of the history; waves that it is long enough for."""
        days = (last - first) / DAY
        places = tuple(BEND_SHARE * (k + 1) / (bends + 1) for k in range(bends)) if last > first else ()
        kept = tuple((name, length, order) for name, (length, order, least) in waves.items() if days >= least)
        return cls(first, max(last - first, 1.0), places, kept)

    @property
    def names(self) -> list[str]:
        out = ["level", "slope", *(f"bend{k}" for k in range(len(self.bends)))]
        for name, _length, order in self.waves:
            out += [f"{name}_{kind}{k}" for k in range(1, order + 1) for kind in ("sin", "cos")]
        return out

    def matrix(self, seconds: np.ndarray) -> np.ndarray:
        """Features of each second since the epoch, a column per name."""
        t = (seconds - self.origin) / self.span
        out = [np.ones_like(t), t, *(np.maximum(t - b, 0.0) for b in self.bends)]
        for _name, length, order in self.waves:
            angle = 2.0 * math.pi * (seconds / (length * DAY))
            for k in range(1, order + 1):
                out += [np.sin(k * angle), np.cos(k * angle)]
        return np.stack(out, axis=1)

    def columns(self, seconds: Column) -> list[Column]:
        """The same as expressions."""
        t = (seconds - F.lit(self.origin)) / F.lit(self.span)
        out = [F.lit(1.0), t, *(F.greatest(t - F.lit(b), F.lit(0.0)) for b in self.bends)]
        for _name, length, order in self.waves:
            angle = F.lit(2.0 * math.pi) * (seconds / F.lit(length * DAY))
            for k in range(1, order + 1):
                out += [F.sin(F.lit(float(k)) * angle), F.cos(F.lit(float(k)) * angle)]
        return out

    @property
    def penalty(self) -> np.ndarray:
        return np.array([RIDGE if name.startswith("bend") else 0.0 for name in self.names])


@dataclass(frozen=True)
class Trend:
    shape: Shape
    coefficients: tuple[float, ...]
    spread: float = 0.0
    points: int = field(default=0, compare=False)


def _seconds(time: str) -> Column:
    return (F.unix_micros(F.col(time)) / 1_000_000.0).cast("double")


def _points(history: DataFrame, time: str, value: str) -> DataFrame:
    return history.select(_seconds(time).alias("x"), F.col(value).cast("double").alias("y")).where("x is not null and y is not null")


def gram(points: DataFrame, shape: Shape) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and the number of points; one row of sums per task and entry meets in the shuffle."""
    size = len(shape.names)
    upper = np.triu_indices(size)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, count = np.zeros((size, size)), np.zeros(size), 0
        for frame in frames:
            x, y = shape.matrix(frame["x"].to_numpy()), frame["y"].to_numpy()
            left, right, count = left + x.T @ x, right + x.T @ y, count + len(y)
        entries = np.concatenate([left[upper], right, [count]])
        yield pd.DataFrame({"entry": np.arange(len(entries)), "part": entries})

    added = points.mapInPandas(sums, "entry long, part double").groupBy("entry").agg(F.sum("part").alias("total")).collect()
    flat = np.zeros(len(upper[0]) + size + 1)
    for row in added:
        flat[row.entry] = row.total
    matrix = np.zeros((size, size))
    matrix[upper] = flat[: len(upper[0])]
    matrix = matrix + np.triu(matrix, 1).T
    return matrix, flat[len(upper[0]) : -1], int(flat[-1])


def fit_trend(history: DataFrame, time: str, value: str, bends: int = BENDS, waves=WAVES) -> Trend | None:
    """Model of a series with one row per step; None without points.

    Rows without a time or value are no points. A wave takes part only if the history is as
    long as ``waves`` asks for. The spread is the deviation of what the model leaves."""
    points = _points(history, time, value)
    first, last = points.agg(F.min("x"), F.max("x")).first()
    if first is None:
        return None
    shape = Shape.of(first, last, bends, waves)
    matrix, right, count = gram(points, shape)
    # a small weight on all features keeps ones that the points do not tell apart solvable
    system = matrix + np.diag(shape.penalty + 1e-9 * np.trace(matrix) / len(right))
    coefficients = tuple(np.linalg.solve(system, right).tolist())
    rest = F.col("y") - _predicted(shape, coefficients, F.col("x"))
    free = max(count - len(coefficients), 1)
    squares = points.agg(F.sum(rest * rest)).first()[0] or 0.0
    return Trend(shape, coefficients, math.sqrt(squares / free), count)


def _predicted(shape: Shape, coefficients, seconds: Column) -> Column:
    """Sum of the terms as a fold over an array: one expression, however many features."""
    terms = F.array(*(F.lit(b) * x for b, x in zip(coefficients, shape.columns(seconds))))
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)


def score_trend(series: DataFrame, model: Trend, time: str, value: str, lower_bound: float = 0.0) -> DataFrame:
    """Expected value, band and Drop / Spike label per point; the band widens nothing beyond the history."""
    predicted = _predicted(model.shape, model.coefficients, _seconds(time))
    margin = F.lit(Z_95 * model.spread)
    out = series.withColumn("predicted", predicted)
    out = out.withColumns(
        {"lower": F.greatest(F.lit(float(lower_bound)), F.col("predicted") - margin), "upper": F.col("predicted") + margin}
    )
    kind = F.when(F.col(value) < F.col("lower"), "Sudden Drop").when(F.col(value) > F.col("upper"), "Sudden Spike")
    return out.withColumn("anomaly_type", kind).withColumn(
        "status", F.when(F.col("anomaly_type").isNull(), "NORMAL").otherwise("ANOMALY")
    )


def normal_equations(history: DataFrame, model: Trend, time: str, value: str) -> DataFrame:
    """(feature, solved): whether what the model leaves has nothing more of each feature.

    Least squares has one solution, the one for which X'(y - Xb) is the penalty times b;
    that is checked feature by feature over all points."""
    points = _points(history, time, value)
    rest = F.col("y") - _predicted(model.shape, model.coefficients, F.col("x"))
    # pairs (feature, feature times rest) of a point, added up per feature
    features = F.array(*model.shape.columns(F.col("x")))
    each = points.select(rest.alias("rest"), F.posexplode(features).alias("k", "value"))
    sums = each.groupBy("k").agg(
        F.sum(F.col("value") * F.col("rest")).alias("left"), F.sum(F.abs(F.col("value") * F.col("rest"))).alias("size")
    )
    wanted = F.array(*(F.lit(float(p * b)) for p, b in zip(model.shape.penalty, model.coefficients)))
    names = F.array(*(F.lit(n) for n in model.shape.names))
    gap = F.abs(F.col("left") - F.get(wanted, F.col("k")))
    return sums.select(F.get(names, F.col("k")).alias("feature"), (gap <= F.greatest(F.col("size"), F.lit(1.0)) * 1e-3).alias("solved"))
