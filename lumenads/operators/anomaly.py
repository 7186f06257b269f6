"""Anomaly scoring of count series: seasonal band, isolation forest, sigma rules."""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenads.functions.metrics import half_up
from lumenads.operators.performance import shared_rows

# Task code travels by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# 95 % interval, outlier share and size of the two detectors.
Z_95 = 1.959963984540054
CONTAMINATION = 0.05
TREES = 100
SAMPLE = 256
_EULER = 0.5772156649015329


# ------------------------------------------------------------- seasonal band


def _hours(time: str, origin: str) -> Column:
    """Hours since the first point of the history."""
    return (F.unix_seconds(F.col(time)) - F.unix_seconds(F.col(origin))) / 3600.0


def seasonal_slot(time: str, slot_seconds: int) -> list[Column]:
    second = F.hour(time) * 3600 + F.minute(time) * 60
    return [
        (F.weekday(time) + 1).alias("weekday"),
        F.floor(second / slot_seconds).cast("int").alias("slot"),
    ]


def fit_band(history: DataFrame, time: str, value: str, slot_seconds: int = 300) -> DataFrame:
    """Trend and weekly seasonality by aggregates only, one row per (weekday, slot).

    The trend is the least-squares slope within slots of the day, so the daily
    cycle cannot leak into it. What it leaves is averaged per slot of the week.
    The spread is the pooled variation around those averages in the same slot of
    the day, widened for the few weeks an average rests on; with only one week
    there is none to pool and the variation between weekdays stands in.
    """
    origin = history.agg(F.min(time).alias("origin"))
    timed = history.crossJoin(F.broadcast(origin)).select(
        *seasonal_slot(time, slot_seconds),
        "origin",
        F.col(value).cast("double").alias("_y"),
        _hours(time, "origin").alias("_x"),
    )
    moments = timed.groupBy("slot").agg(
        (F.covar_pop("_y", "_x") * F.count("_y")).alias("_xy"),
        (F.var_pop("_x") * F.count("_y")).alias("_xx"),
    )
    slope = moments.agg(
        F.coalesce(F.sum("_xy") / F.nullif(F.sum("_xx"), F.lit(0.0)), F.lit(0.0)).alias("slope")
    )
    left = timed.crossJoin(F.broadcast(slope)).withColumn("_rest", F.col("_y") - F.col("slope") * F.col("_x"))
    cells = left.groupBy("weekday", "slot").agg(
        F.first("origin").alias("origin"),
        F.first("slope").alias("slope"),
        F.avg("_rest").alias("season"),
        F.count("_rest").alias("_n"),
        (F.var_pop("_rest") * F.count("_rest")).alias("_ss"),
    )
    pooled = cells.groupBy("slot").agg(
        F.sqrt(F.sum("_ss") / F.nullif(F.sum("_n") - F.count("_n"), F.lit(0))).alias("_within")
    )
    between = left.groupBy("slot").agg(F.stddev_samp("_rest").alias("_between"))
    spread = F.coalesce("_within", "_between", F.lit(0.0)) * F.sqrt(1.0 + 1.0 / F.col("_n"))
    return cells.join(pooled, "slot").join(between, "slot").select(
        "weekday", "slot", "origin", "slope", "season", spread.alias("spread")
    )


def score_band(
    series: DataFrame,
    model: DataFrame,
    time: str,
    value: str,
    slot_seconds: int = 300,
    lower_bound: float = 0.0,
    upper_weight: float = 1.0,
) -> DataFrame:
    """Expected value, band and Drop / Spike label per point.

    A slot of the week never seen in the history has no band and stays NORMAL.
    """
    slotted = series.select("*", *seasonal_slot(time, slot_seconds))
    joined = slotted.join(model, ["weekday", "slot"], "left")
    predicted = F.col("slope") * _hours(time, "origin") + F.col("season")
    lower = F.greatest(F.lit(float(lower_bound)), predicted - F.lit(Z_95) * F.col("spread"))
    upper = (predicted + F.lit(Z_95) * F.col("spread")) * F.lit(float(upper_weight))
    out = joined.withColumns(
        {
            "predicted": predicted,
            "lower": F.when(F.col("spread").isNotNull(), lower),
            "upper": upper,
        }
    )
    kind = F.when(F.col(value) < F.col("lower"), "Sudden Drop").when(
        F.col(value) > F.col("upper"), "Sudden Spike"
    )
    return out.withColumn("anomaly_type", kind).select(
        *series.columns,
        "predicted",
        "lower",
        "upper",
        F.when(F.col("anomaly_type").isNull(), "NORMAL").otherwise("ANOMALY").alias("status"),
        "anomaly_type",
    )


# ---------------------------------------------------------- isolation forest

_TREE_SCHEMA = "tree int, rows int, low double, high double, path_length double"
# Cells that the range of the merged cut points is divided into for the range join.
CELLS = 4_096


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree over ``n`` values."""
    if n <= 2:
        return 1.0 if n == 2 else 0.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def draw(tree: int, path: str) -> float:
    """Number in [0, 1) for a node, from its place in the tree; SQL can draw the same."""
    return int(hashlib.md5(f"{tree}:{path}".encode()).hexdigest()[:8], 16) / 4294967296.0


def _grow(values: np.ndarray, tree: int) -> list[tuple]:
    """One random tree over a single feature, flattened to intervals.

    A split of one feature cuts the line, so the leaves are intervals (low, high]
    with a path length each; the outer ends are open (null).
    """
    limit = math.ceil(math.log2(max(len(values), 2)))
    leaves: list[tuple] = []

    def split(part: np.ndarray, path: str, low: float | None, high: float | None) -> None:
        if len(path) >= limit or len(part) <= 1 or part[0] == part[-1]:
            leaves.append((tree, len(values), low, high, len(path) + average_path(len(part))))
            return
        cut = float(part[0] + draw(tree, path) * (part[-1] - part[0]))
        where = int(np.searchsorted(part, cut, side="right"))
        split(part[:where], path + "0", low, cut)
        split(part[where:], path + "1", cut, high)

    split(np.sort(values), "", None, None)
    return leaves


def fit_forest(history: DataFrame, time: str, value: str, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Trees as rows (tree, rows, low, high, path_length). Every tree sees its own sample of at
    most ``sample`` rows, the method's subsample size, or the whole history if that is
    smaller; ``rows`` says.

    The sample of a tree is the rows with the smallest hash of (tree, time):
    a bounded top-k per tree that is cut inside each task before the shuffle,
    so at most ``trees * sample`` rows per task move.
    """
    ids = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    second = F.unix_seconds(time).cast("string")
    keyed = history.select(
        F.col(value).cast("double").alias("value"), second.alias("_t"), ids.alias("tree")
    ).withColumn("_h", F.md5(F.concat_ws("-", F.col("tree").cast("string"), "_t").cast("binary")))
    w = W.partitionBy("tree").orderBy("_h", "value")
    drawn = keyed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        leaves = _grow(pdf["value"].to_numpy(dtype=float), int(pdf["tree"].iloc[0]))
        return pd.DataFrame(leaves, columns=["tree", "rows", "low", "high", "path_length"])

    grown = drawn.select("tree", "value").groupBy("tree").applyInPandas(grow, _TREE_SCHEMA)
    return shared_rows(grown, ("tree", "low"))


def forest_steps(forest: DataFrame) -> DataFrame:
    """All trees as one step function: (low, high, depth), the summed path length in (low, high].

    A forest has at most ``trees * 2 * sample`` rows whatever the data size, so one
    task puts its cut points in order."""
    by_tree = W.partitionBy("tree").orderBy(F.asc_nulls_first("low"))
    change = F.col("path_length") - F.coalesce(F.lag("path_length").over(by_tree), F.lit(0.0))
    changes = forest.select("low", change.alias("_change")).groupBy("low").agg(F.sum("_change").alias("_change"))
    along = W.orderBy(F.asc_nulls_first("low"))
    return changes.select("low", F.lead("low").over(along).alias("high"), F.sum("_change").over(along).alias("depth"))


def score_forest(series: DataFrame, forest: DataFrame, value: str) -> DataFrame:
    """Score in (0, 1] per row; higher is more isolated. Path lengths are measured by the
    mean path in trees of as many rows as each was grown from.

    A range join of the different values with the steps, by cells of the cut points'
    range, so a value meets the few steps of its cell; rows take their value's score.
    """
    steps = forest_steps(forest)
    c = F.col
    paths = F.expr(
        f"CASE WHEN rows > 2 THEN 2.0D * (ln(rows - 1.0D) + {_EULER}D) - 2.0D * (rows - 1.0D) / rows "
        "WHEN rows = 2 THEN 1.0D ELSE 0.0D END"
    )
    each = forest.groupBy("tree").agg(F.first("rows").alias("rows"))
    size = each.agg(F.count("*").alias("_trees"), F.avg(paths).alias("_scale"))
    span = steps.agg(F.min("low").alias("_from"), F.max("low").alias("_to"))
    frame = span.crossJoin(size).select(
        F.coalesce("_from", F.lit(0.0)).alias("_from"),
        (F.greatest(c("_to") - c("_from"), F.lit(1e-9)) / CELLS).alias("_width"),
        "_trees", F.coalesce(F.nullif("_scale", F.lit(0.0)), F.lit(1.0)).alias("_scale"),
    )

    def cell(x):
        place = (x - c("_from")) / F.coalesce("_width", F.lit(1.0))
        return F.floor(F.least(F.greatest(place, F.lit(-1.0)), F.lit(float(CELLS)))).cast("int")

    first = F.when(c("low").isNull(), -1).otherwise(cell(c("low")))
    last = F.when(c("high").isNull(), CELLS).otherwise(cell(c("high")))
    spread = steps.crossJoin(F.broadcast(frame)).select(
        "low", "high", "depth", F.explode(F.sequence(first, last)).alias("_cell")
    )
    values = series.select(c(value).cast("double").alias("_v")).where("_v is not null").distinct()
    placed = values.crossJoin(F.broadcast(frame)).withColumn("_cell", cell(c("_v")))
    inside = (c("low").isNull() | (c("_v") > c("low"))) & (c("high").isNull() | (c("_v") <= c("high")))
    scored = placed.join(spread, "_cell").where(inside).select(
        "_v", F.round(F.pow(F.lit(2.0), -c("depth") / (c("_trees") * c("_scale"))), 9).alias("score")
    )
    rows = series.withColumn("_v", c(value).cast("double"))
    return rows.join(shared_rows(scored, ("_v",)), "_v", "left").select(*series.columns, "score")


def flag_outliers(scored: DataFrame, threshold: DataFrame) -> DataFrame:
    return scored.crossJoin(F.broadcast(threshold)).withColumn(
        "is_outlier", F.col("score") > F.col("threshold")
    )


def outlier_threshold(scored_history: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Score that only the most isolated share of the history exceeds."""
    return scored_history.agg(
        F.percentile_approx("score", 1.0 - contamination, 100000).alias("threshold")
    )


# ----------------------------------------------------------------- decisions


def ensemble_flag(df: DataFrame, band_type: str = "anomaly_type", outlier: str = "is_outlier") -> DataFrame:
    """Anomaly when either detector fires, with a label naming which."""
    by_band, by_forest = F.col(band_type).isNotNull(), F.col(outlier)
    label = (
        F.when(by_band & by_forest, F.concat(F.col(band_type), F.lit(" [Prophet + IsoForest]")))
        .when(by_band, F.concat(F.col(band_type), F.lit(" [Prophet]")))
        .when(by_forest, F.lit("Outlier [IsoForest]"))
    )
    return df.withColumns(
        {
            "status": F.when(by_band | by_forest, "ANOMALY").otherwise("NORMAL"),
            "anomaly_label": label,
        }
    )


def latest_alert(scored: DataFrame, time: str, minutes: int = 5) -> DataFrame:
    """The newest window and whether it raises an alert; only then it names the span."""
    names = [c for c in scored.columns if c != time]
    newest = scored.agg(
        F.max(time).alias(time), F.max_by(F.struct(*names), F.col(time)).alias("_r")
    ).select(time, "_r.*")
    start = F.date_format(F.col(time) - F.expr(f"INTERVAL {minutes} MINUTES"), "HH:mm")
    span = F.concat(start, F.lit(" ~ "), F.date_format(time, "HH:mm"))
    alert = F.col("status") == "ANOMALY"
    return newest.withColumns({"alert": alert, "span": F.when(alert, span)})


def retrain_scores(
    series: DataFrame, time: str, value: str, step_seconds: int = 300, every: int = 288,
    slot_seconds: int = 3600,
) -> DataFrame:
    """Scores by a model that is refitted after every ``every`` windows.

    Windows are numbered by time since the first one. Each batch of windows is
    scored by the slot means and spreads of the batch before it, the rows that
    had accumulated when the refit ran; the first batch has no model yet.
    """
    first = series.agg(F.min(time).alias("_first"))
    second = F.hour(time) * 3600 + F.minute(time) * 60
    number = (F.unix_seconds(F.col(time)) - F.unix_seconds(F.col("_first"))) / step_seconds
    placed = series.crossJoin(F.broadcast(first)).select(
        *series.columns,
        F.floor(number / every).cast("bigint").alias("model_no"),
        F.floor(second / slot_seconds).cast("int").alias("slot"),
    )
    fitted = placed.groupBy((F.col("model_no") + 1).alias("model_no"), "slot").agg(
        F.avg(value).alias("predicted"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("spread"),
    )
    joined = placed.join(fitted, ["model_no", "slot"], "left")
    margin = F.lit(Z_95) * F.col("spread")
    kind = F.when(F.col(value) < F.col("predicted") - margin, "Sudden Drop").when(
        F.col(value) > F.col("predicted") + margin, "Sudden Spike"
    )
    return joined.select(*series.columns, "model_no", "predicted", "spread", kind.alias("anomaly_type"))


def sigma_status(current: str, mean: str, sd: str, width: float = 2.0) -> Column:
    """DROP, SURGE or NORMAL against mean and standard deviation."""
    margin = F.col(sd) * width
    return (
        F.when(F.col(current) < F.col(mean) - margin, "DROP")
        .when(F.col(current) > F.col(mean) + margin, "SURGE")
        .otherwise("NORMAL")
    )


def cost_status(current: str, mean: str) -> Column:
    return (
        F.when(F.col(current) > F.col(mean) * 1.5, "OVER")
        .when(F.col(current) < F.col(mean) * 0.5, "UNDER")
        .otherwise("NORMAL")
    )


def hour_sigma_alert(hourly: DataFrame, current: DataFrame) -> DataFrame:
    """Current hours against mean and spread of the same hour on earlier days.

    ``hourly`` has one row per earlier day and hour, ``current`` one per hour,
    both with impressions, clicks and cost.
    """
    usual = hourly.groupBy("hour").agg(
        F.avg("impressions").alias("mean_impressions"),
        F.avg("clicks").alias("mean_clicks"),
        F.avg("cost").alias("mean_cost"),
        F.stddev_samp("impressions").alias("sd_impressions"),
        F.stddev_samp("clicks").alias("sd_clicks"),
    )
    return current.join(usual, "hour", "inner").select(
        "hour", "impressions", "clicks", "cost", "mean_impressions", "mean_clicks",
        sigma_status("impressions", "mean_impressions", "sd_impressions").alias("impressions_status"),
        sigma_status("clicks", "mean_clicks", "sd_clicks").alias("clicks_status"),
        cost_status("cost", "mean_cost").alias("cost_status"),
    )


def ctr_sigma_outliers(rated: DataFrame, history: Column, target: Column, min_rows: int = 100) -> DataFrame:
    """Target rows whose CTR lies more than two spreads from the history mean.

    ``rated`` has one row per group and day with impressions and ctr_percent.
    """
    stats = rated.where(history).agg(
        half_up(F.avg("ctr_percent"), 6).alias("mean_ctr"),
        half_up(F.stddev_samp("ctr_percent"), 6).alias("sd_ctr"),
    )
    joined = rated.where(target & (F.col("impressions") >= min_rows)).crossJoin(F.broadcast(stats))
    margin = 2.0 * F.col("sd_ctr")
    status = F.when(F.col("ctr_percent") > F.col("mean_ctr") + margin, "Unusually High").when(
        F.col("ctr_percent") < F.col("mean_ctr") - margin, "Unusually Low"
    )
    return (
        joined.withColumns(
            {
                "ctr_diff": half_up(F.col("ctr_percent") - F.col("mean_ctr"), 2),
                "ctr_status": status,
            }
        )
        .where(F.col("ctr_status").isNotNull())
        .drop("sd_ctr")
        .orderBy(F.desc(F.abs("ctr_diff")))
    )
