"""Windows and models kept as keyed state while a stream runs.

``window_totals`` emits a window when its series has moved past it, and again,
with a higher revision, when a late row changes it. ``refit_scores`` scores
windows by a model that is refitted from the stream's own windows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from lumenads.sources.buckets import settings
from lumenads.streaming.ingest import Batches

# Task code travels by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Z_95 = 1.959963984540054
# Rows sent to Python at once; a series with more in one batch is called again.
ROWS_AT_ONCE = 10_000
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
# Amounts are kept as whole numbers of this fraction, so sums are exact in any order.
UNIT = 10_000
FLUSHES = 1 << 20

TOTALS = "series string, window_ms long, total long, n long, revision int"
SCORES = "series string, window_ms long, n long, model_no long, predicted double, spread double"


class WindowTotals(StatefulProcessor):
    """Open and closed windows of one series.

    A window closes once the series has a row ``lag`` past its end; then it is
    emitted with revision 0. Later rows for it count too: it is emitted again, once
    a batch, with the next revision. When the watermark passes the end of a window, no row
    can reach it any more: its timer emits it if it is still open, and forgets it.
    """

    def __init__(self, width_ms: int, lag_ms: int):
        self.width, self.lag = width_ms, lag_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "window long", "total long, n long")
        self.closed = handle.getMapState("closed", "window long", "total long, n long, revision int")
        self.newest = handle.getValueState("newest", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else -(1 << 62)
        changed: dict[int, list[int]] = {}
        for frame in rows:
            newest = max(newest, int(frame["ms"].max()))
            start = frame["ms"] // self.width * self.width
            sums = frame.groupby(start)["amount"].agg(["sum", "count"])
            for window, total, n in zip(sums.index.tolist(), sums["sum"].tolist(), sums["count"].tolist()):
                old = changed.setdefault(window, [0, 0])
                old[0] += total
                old[1] += n
        self.newest.update((newest,))
        out = []
        for window, (total, n) in changed.items():
            if self.closed.containsKey((window,)):
                old = self.closed.getValue((window,))
                now = (old[0] + total, old[1] + n, old[2] + 1)
                self.closed.updateValue((window,), now)
                out.append((key[0], window, *now))
                continue
            if self.open.containsKey((window,)):
                old = self.open.getValue((window,))
                total, n = total + old[0], n + old[1]
            else:
                self.handle.registerTimer(window + self.width)
            self.open.updateValue((window,), (total, n))
        passed = [(w[0], v) for w, v in self.open.iterator() if w[0] + self.width <= newest - self.lag]
        for window, (total, n) in passed:
            self.open.removeKey((window,))
            self.closed.updateValue((window,), (total, n, 0))
            out.append((key[0], window, total, n, 0))
        yield _frame(out, TOTALS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        window, out = expiredTimerInfo.getExpiryTimeInMs() - self.width, []
        if self.open.containsKey((window,)):
            out.append((key[0], window, *self.open.getValue((window,)), 0))
            self.open.removeKey((window,))
        if self.closed.containsKey((window,)):
            self.closed.removeKey((window,))
        yield _frame(out, TOTALS)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])


def _amounts(rows: DataFrame, series: Column, time: str, amount: Column) -> DataFrame:
    """series, time, ms, and the amount in units; rows without a time or amount do not count."""
    return rows.select(
        series.cast("string").alias("series"),
        F.col(time).alias("time"),
        F.unix_millis(time).alias("ms"),
        (amount.cast("decimal(18,4)") * UNIT).cast("long").alias("amount"),
    ).where("ms is not null and amount is not null")


def window_totals(
    stream: DataFrame, series: Column, time: str, amount: Column, width_ms: int = 300_000,
    lag_ms: int = 600_000, horizon: str = "1 day",
) -> DataFrame:
    """Totals per series and tumbling window, with corrections for rows up to ``horizon`` late.

    Rows later than that are dropped; the query's progress counts them
    (numRowsDroppedByWatermark). State is bounded by the windows of a horizon.
    """
    rows = _amounts(stream, series, time, amount).withWatermark("time", horizon)
    return rows.groupBy("series").transformWithStateInPandas(WindowTotals(width_ms, lag_ms), TOTALS, "Append", "EventTime")


class RefitScores(StatefulProcessor):
    """Slot statistics of the current and the previous run of ``every`` windows of one series.

    A window is scored by the statistics of the run before its own. When a run
    begins, what lies before the previous one is cleared."""

    def __init__(self, step_ms: int, every: int, slot_ms: int):
        self.step, self.every, self.slot = step_ms, every, slot_ms

    def init(self, handle) -> None:
        self.first = handle.getValueState("first", "ms long")
        self.slots = handle.getMapState("slots", "model_no long, slot int", "n long, total long, squares decimal(38,0)")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ms", kind="stable")
        if not self.first.exists():
            self.first.update((int(frame["ms"].iloc[0]),))
        first = self.first.get()[0]
        kept = {(m, s): [int(x) for x in v] for (m, s), v in self.slots.iterator()}
        stored, out = set(kept), []
        for ms, value in zip(frame["ms"].tolist(), frame["n"].tolist()):
            number, slot = (ms - first) // self.step // self.every, ms % 86_400_000 // self.slot
            predicted, spread = _moments(kept.get((number - 1, slot)))
            out.append((key[0], ms, value, number, predicted, spread))
            own = kept.setdefault((number, slot), [0, 0, 0])
            own[0] += 1
            own[1] += value
            own[2] += value * value
        newest = out[-1][3]
        for number, slot in {*stored, *kept}:
            if number < newest - 1:
                if (number, slot) in stored:
                    self.slots.removeKey((number, slot))
            else:
                n, total, squares = kept[number, slot]
                self.slots.updateValue((number, slot), (n, total, _decimal(squares)))
        yield _frame(out, SCORES)

    def close(self) -> None:
        pass


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(value)


def _moments(stats: list[int] | None) -> tuple[float | None, float | None]:
    """Mean and sample deviation (0 for a single value) from exact sums."""
    if stats is None:
        return None, None
    n, total, squares = stats
    return total / n, math.sqrt((squares * n - total * total) / (n * (n - 1))) if n > 1 else 0.0


def refit_scores(
    windows: DataFrame, series: Column, time: str, value: str, step_ms: int = 300_000, every: int = 288,
    slot_ms: int = 3_600_000,
) -> DataFrame:
    """Scores of closed windows by a model refitted after every ``every`` windows.

    Each batch continues in time where the one before it ended; windows of one
    batch may come in any order. State is two runs of slots per series."""
    rows = windows.select(series.cast("string").alias("series"), F.unix_millis(time).alias("ms"), F.col(value).cast("long").alias("n"))
    scored = rows.groupBy("series").transformWithStateInPandas(RefitScores(step_ms, every, slot_ms), SCORES, "Append", "None")
    margin = F.lit(Z_95) * F.col("spread")
    kind = F.when(F.col("n") < F.col("predicted") - margin, "Sudden Drop").when(
        F.col("n") > F.col("predicted") + margin, "Sudden Spike"
    )
    return scored.withColumn("anomaly_type", kind)


def drain(df: DataFrame, path: str, checkpoint: str, name: str) -> StreamingQuery:
    """Process what is available with state in RocksDB, append each batch, stop."""
    batches = Batches(name)
    with settings(df.sparkSession, STATE_STORE):
        writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        writer = writer.foreachBatch(lambda batch, batch_id: batches.append(batch, path, batch_id))
        query = batches.start(writer.trigger(availableNow=True))
        query.awaitTermination()
    return query


def latest_totals(spark: SparkSession, path: str) -> DataFrame:
    """series, window_start, total, n and revision of every window: its last revision."""
    rows = spark.read.schema(TOTALS).parquet(path).select("series", "window_ms", "total", "n", "revision")
    last = rows.groupBy("series", "window_ms").agg(F.max_by(F.struct("total", "n", "revision"), "revision").alias("_l"))
    return last.select(
        "series", F.timestamp_millis("window_ms").alias("window_start"),
        (F.col("_l.total") / F.lit(float(UNIT))).alias("total"), "_l.n", "_l.revision",
    )


def flush_totals(
    rows: DataFrame, path: str, series: Column, time: str, amount: Column, width_ms: int = 300_000, lag_ms: int = 600_000,
    flush: int = 0,
) -> None:
    """Append the windows that the drained stream still holds open, with a revision below 0.

    ``rows`` are the stream's source rows as a batch. Whatever the stream emits for
    such a window later has a higher revision and takes its place, so a stream may be
    drained, flushed and drained again; each ``flush`` is numbered in order."""
    placed = _amounts(rows, series, time, amount).withColumn("window_ms", F.floor(F.col("ms") / width_ms) * width_ms)
    windows = placed.groupBy("series", "window_ms").agg(F.sum("amount").alias("total"), F.count("*").alias("n"), F.max("ms").alias("_t"))
    newest = windows.groupBy("series").agg(F.max("_t").alias("_newest"))
    still = windows.join(newest, "series").where(F.col("window_ms") + width_ms > F.col("_newest") - lag_ms)
    out = still.select("series", "window_ms", "total", "n", F.lit(flush - FLUSHES).alias("revision"))
    out.write.mode("overwrite").parquet(f"{path.rstrip('/')}/stream=flush/run=end/batch={flush}")
