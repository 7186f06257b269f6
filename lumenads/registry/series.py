"""Time series, anomaly scoring and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenads.functions.metrics import half_up, money_sum, performance_needs, summarise
from lumenads.operators import anomaly as A
from lumenads.operators import series as S
from lumenads.operators import trend as T
from lumenads.operators.performance import performance
from lumenads.plans.testbed import ad_events, ad_facts, events, impressions, table
from lumenads.registry.core import FACTS, ORACLES, SQL, WHOLE, between, pick, r, rates, register
from lumenads.registry.journeys import EV, RAW
from lumenads.session import shared_dir
from lumenads.streaming import ingest as I
from lumenads.streaming import stateful as K
from lumenads.streaming import windows as W

FIVE = "time_bucket(INTERVAL 5 MINUTE, ts)"
_SUM = "CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE)"


def _total():
    return money_sum("value").alias("total")


def _count():
    return F.count(F.lit(1)).alias("n")


def five_minute_counts(spark, d):
    return S.tumbling(events(spark, d), "ts", "5 minutes", _count())


def hourly_counts(spark, d):
    return S.tumbling(events(spark, d), "ts", "1 hour", _count())


# --- windows ----------------------------------------------------------------
@register("R1_tumbling_sum", f"SELECT {FIVE} AS window_start, {_SUM} AS total FROM events GROUP BY 1")
def _(spark, d):
    return S.tumbling(events(spark, d), "ts", "5 minutes", _total())


def _stream(spark, d):
    shape = table(spark, d, "events").schema
    rows = spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark, d, width, lateness):
    amount = F.col("value").cast("decimal(18,4)")
    out = W.tumbling_sum(_stream(spark, d), "ts", amount, width=width, lateness=lateness)
    path = shared_dir(spark, "stream")
    W.drain_to_parquet(out, path, shared_dir(spark, "stream-state")).awaitTermination()
    W.flush_open_windows(events(spark, d), path, "ts", amount, width=width, lateness=lateness)
    return W.drained(spark, path, out.schema)


def _windows(width_minutes):
    return f"SELECT time_bucket(INTERVAL {width_minutes} MINUTE, ts) AS window_start, {_SUM} AS total FROM events GROUP BY 1"


@register("R1_tumbling_sum_stream", _windows(5))
def _(spark, d):
    return _drained(spark, d, "5 minutes", "10 minutes")


@register("R2_late_data", _windows(60))
def _(spark, d):
    return _drained(spark, d, "60 minutes", "1440 minutes")


_KIND_WINDOWS = """SELECT event_type AS series, time_bucket(INTERVAL {0} MINUTE, ts) AS window_start,
 CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, COUNT(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2"""


def _landed_events(spark, d, files):
    """Events as several files in no order of time, one for each micro-batch."""
    path = shared_dir(spark, "event-files")
    events(spark, d).select("event_id", "ts", "event_type", "value").repartition(files, "event_id").write.parquet(path)
    rows = spark.read.parquet(path)
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _totals(spark, d, files, minutes):
    rows, stream = _landed_events(spark, d, files)
    path, key, amount, width = shared_dir(spark, "totals"), F.col("event_type"), F.col("value"), minutes * 60_000
    totals = K.window_totals(stream, key, "ts", amount, width, horizon="60 days")
    K.drain(totals, path, shared_dir(spark, "totals-state"), "totals")
    K.flush_totals(rows, path, key, "ts", amount, width)
    return K.latest_totals(spark, path).drop("revision")


@register("R1_stateful_totals", _KIND_WINDOWS.format(60))
def _(spark, d):
    return _totals(spark, d, 1, 60)


@register("R2_late_corrections", _KIND_WINDOWS.format(1440))
def _(spark, d):
    """Each file covers the whole time, so all but the first correct closed windows."""
    return _totals(spark, d, 3, 1440)


@register("R3_floor_bucket_count", "SELECT CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS bucket, COUNT(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    bucket = S.floor_bucket(F.unix_seconds(F.col("ts")))
    return events(spark, d).groupBy(bucket.alias("bucket")).agg(_count())


@register("R4_hour_bucket_event_time", f"""WITH {EV} SELECT date_trunc('hour', ts + INTERVAL 9 HOUR) AS hour_start, COUNT(*) AS n FROM ev
WHERE event_type = 'conversion' AND ts + INTERVAL 9 HOUR >= TIMESTAMP '2024-01-02' AND ts + INTERVAL 9 HOUR < TIMESTAMP '2024-01-30' GROUP BY 1""")
def _(spark, d):
    rows = ad_events(spark, d).where(F.col("event_type") == "conversion")
    return S.hours_by_event_time(rows, "ts", "2024-01-02 00:00:00", "2024-01-30 00:00:00")


@register("R5_hour_bucket_partition", f"WITH {RAW} SELECT year, month, day, hour, COUNT(*) AS n FROM imp GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return impressions(spark, d).groupBy("year", "month", "day", "hour").agg(_count())


_GRID5 = f"""c5 AS (SELECT {FIVE} AS window_start, COUNT(*) AS n FROM events GROUP BY 1),
 g5 AS (SELECT unnest(generate_series((SELECT date_trunc('day', MIN(window_start)) FROM c5), (SELECT date_trunc('day', MAX(window_start)) + INTERVAL 1435 MINUTE FROM c5), INTERVAL 5 MINUTE)) AS window_start),
 f5 AS (SELECT window_start, COALESCE(n, 0) AS n FROM g5 LEFT JOIN c5 USING (window_start))"""


def filled(spark, d):
    return S.zero_fill(five_minute_counts(spark, d), "window_start", ["n"], "5 MINUTES", by_day=True)


@register("R6_zero_fill", f"WITH {_GRID5} SELECT * FROM f5")
def _(spark, d):
    return filled(spark, d)


# --- seasonal band ----------------------------------------------------------
_BAND = """s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS t, COUNT(*) AS n FROM events GROUP BY 1),
 x AS (SELECT *, (epoch(t) - (SELECT MIN(epoch(t)) FROM s)) / 3600.0::DOUBLE AS h, isodow(t) AS wd, hour(t) AS slot FROM s),
 ms AS (SELECT slot, covar_pop(n, h) * COUNT(*) AS xy, var_pop(h) * COUNT(*) AS xx FROM x GROUP BY 1),
 e AS (SELECT x.*, slope, n - slope * h AS rest FROM x CROSS JOIN (SELECT COALESCE(SUM(xy) / NULLIF(SUM(xx), 0), 0.0) AS slope FROM ms)),
 cell AS (SELECT wd, slot, AVG(rest) AS season, COUNT(*) AS k, var_pop(rest) * COUNT(*) AS ss FROM e GROUP BY 1, 2),
 win AS (SELECT slot, sqrt(SUM(ss) / NULLIF(SUM(k) - COUNT(*), 0)) AS s FROM cell GROUP BY 1), btw AS (SELECT slot, stddev_samp(rest) AS s FROM e GROUP BY 1),
 sea AS (SELECT wd, slot, season, COALESCE(win.s, btw.s, 0.0) * sqrt(1.0 + 1.0::DOUBLE / k) AS spread FROM cell JOIN win USING (slot) JOIN btw USING (slot)),
 b AS (SELECT t, n, slope * h + season AS p, spread * 1.959963984540054 AS m FROM e JOIN sea USING (wd, slot)),
 band AS (SELECT t AS window_start, n, p AS predicted, GREATEST(0.0, p - m) AS lower, p + m AS upper,
  CASE WHEN n < GREATEST(0.0, p - m) THEN 'Sudden Drop' WHEN n > p + m THEN 'Sudden Spike' END AS anomaly_type FROM b)"""
_STATUS = "CASE WHEN anomaly_type IS NULL THEN 'NORMAL' ELSE 'ANOMALY' END AS status"
_BAND_OUT = f"SELECT window_start, n, {r('predicted', 4)} AS predicted, {r('lower', 4)} AS lower, {r('upper', 4)} AS upper, {_STATUS}, anomaly_type"


def banded(spark, d):
    series = hourly_counts(spark, d)
    model = A.fit_band(series, "window_start", "n", 3600)
    return A.score_band(series, model, "window_start", "n", 3600)


def _rounded(df, *columns):
    return df.withColumns({c: half_up(F.col(c), 4) for c in columns})


@register("R7_seasonal_band", f"WITH {_BAND} {_BAND_OUT} FROM band")
def _(spark, d):
    return _rounded(banded(spark, d), "predicted", "lower", "upper")


# What a month of hourly points tells: a trend with bends, daily and weekly waves.
_FEATURES = ["level", "slope", *(f"bend{k}" for k in range(T.BENDS))] + [
    f"{wave}_{kind}{k}" for wave in ("daily", "weekly") for k in range(1, T.WAVES[wave][1] + 1) for kind in ("sin", "cos")
]


@register("R7_trend_fit", " UNION ALL ".join(f"SELECT '{name}' AS feature, COUNT(*) > 0 AS solved FROM events" for name in _FEATURES))
def _(spark, d):
    """Least squares is its normal equations: they are checked over all points."""
    series = hourly_counts(spark, d)
    return T.normal_equations(series, T.fit_trend(series, "window_start", "n"), "window_start", "n")


@register("R10_latest_alert", f"""WITH {_BAND}, o AS ({_BAND_OUT} FROM band ORDER BY window_start DESC LIMIT 1)
SELECT *, status = 'ANOMALY' AS alert, CASE WHEN status = 'ANOMALY' THEN strftime(window_start - INTERVAL 60 MINUTE, '%H:%M') || ' ~ ' || strftime(window_start, '%H:%M') END AS span FROM o""")
def _(spark, d):
    return A.latest_alert(_rounded(banded(spark, d), "predicted", "lower", "upper"), "window_start", 60)


@register("R12_sliding_24h", f"WITH {_BAND}, o AS ({_BAND_OUT} FROM band) SELECT * FROM o WHERE window_start > (SELECT MAX(window_start) - INTERVAL 24 HOUR FROM o)")
def _(spark, d):
    return S.last_span(_rounded(banded(spark, d), "predicted", "lower", "upper"), "window_start")


# --- isolation forest -------------------------------------------------------
def forest_scored(spark, d, series):
    forest = A.fit_forest(series, "window_start", "n")
    scored = A.score_forest(series, forest, "n")
    return A.flag_outliers(scored, A.outlier_threshold(scored))


def _mean_path(n):
    return f"CASE WHEN {n} > 2 THEN 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n} WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _forest_sql():
    """The trees level by level: a node is cut at a place that its name draws."""
    parts = [f"""s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS t, COUNT(*) AS n FROM events GROUP BY 1),
 k AS (SELECT i AS tree, n::DOUBLE AS v, ROW_NUMBER() OVER (PARTITION BY i ORDER BY md5(i::VARCHAR || '-' || epoch(t)::BIGINT::VARCHAR), n) AS rn FROM s, range(0, {A.TREES}) r(i)),
 l0 AS (SELECT tree, '' AS path, v, COUNT(*) OVER (PARTITION BY tree) AS size, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM k WHERE rn <= {A.SAMPLE})"""]
    for level in range(9):
        draw = "('0x' || substr(md5(tree::VARCHAR || ':' || path), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
        parts.append(f"""n{level} AS (SELECT tree, path, size, low, high, COUNT(*) AS c, MIN(v) + {draw} * (MAX(v) - MIN(v)) AS cut,
  {level} < ceil(log2(greatest(size, 2))) AND COUNT(*) > 1 AND MIN(v) < MAX(v) AS split FROM l{level} GROUP BY tree, path, size, low, high)""")
        parts.append(f"""l{level + 1} AS (SELECT l.tree, l.path || CASE WHEN v <= cut THEN '0' ELSE '1' END AS path, v, l.size,
  CASE WHEN v <= cut THEN l.low ELSE cut END AS low, CASE WHEN v <= cut THEN cut ELSE l.high END AS high
  FROM l{level} l JOIN n{level} n ON l.tree = n.tree AND l.path = n.path WHERE split)""")
    leaves = " UNION ALL ".join(f"SELECT tree, size, low, high, {k} + {_mean_path('c')} AS length FROM n{k} WHERE NOT split" for k in range(9))
    return ",\n ".join(parts) + f""",
 leaf AS ({leaves}),
 scale AS (SELECT COUNT(*) AS trees, AVG({_mean_path('size')}) AS scale FROM (SELECT tree, MIN(size) AS size FROM leaf GROUP BY 1)),
 depth AS (SELECT n, SUM(length) AS depth FROM (SELECT DISTINCT n FROM s) JOIN leaf ON (low IS NULL OR n > low) AND (high IS NULL OR n <= high) GROUP BY 1),
 sc AS (SELECT t AS window_start, n, round(pow(2.0::DOUBLE, -depth / (trees * COALESCE(NULLIF(scale, 0.0), 1.0))), 9) AS score FROM s JOIN depth USING (n) CROSS JOIN scale),
 iso AS (SELECT *, score > threshold AS is_outlier FROM sc CROSS JOIN (SELECT quantile_disc(score, {1 - A.CONTAMINATION}) AS threshold FROM sc))"""


_FOREST = _forest_sql()


@register("R8_isolation_score", f"WITH {_FOREST} SELECT * FROM iso")
def _(spark, d):
    return forest_scored(spark, d, hourly_counts(spark, d))


# Both detectors start from the same hourly series.
_BOTH = _FOREST + ",\n" + _BAND.split("\n", 1)[1]


@register("R9_ensemble_flag", f"""WITH {_BOTH}
SELECT window_start, iso.n, CASE WHEN anomaly_type IS NOT NULL OR is_outlier THEN 'ANOMALY' ELSE 'NORMAL' END AS status,
 CASE WHEN anomaly_type IS NOT NULL AND is_outlier THEN anomaly_type || ' [Prophet + IsoForest]' WHEN anomaly_type IS NOT NULL THEN anomaly_type || ' [Prophet]'
  WHEN is_outlier THEN 'Outlier [IsoForest]' END AS anomaly_label FROM iso JOIN band USING (window_start)""")
def _(spark, d):
    series = hourly_counts(spark, d)
    model = A.fit_band(series, "window_start", "n", 3600)
    both = forest_scored(spark, d, series)
    scored = A.score_band(both, model, "window_start", "n", 3600)
    return A.ensemble_flag(scored).select("window_start", "n", "status", "anomaly_label")


@register("R11_retrain_schedule", f"""WITH {_GRID5}, p AS (SELECT *, CAST(floor((epoch(window_start) - (SELECT MIN(epoch(window_start)) FROM f5)) / 300 / 288) AS BIGINT) AS model_no,
 hour(window_start) AS slot FROM f5), m AS (SELECT model_no + 1 AS model_no, slot, AVG(n) AS predicted, COALESCE(stddev_samp(n), 0.0) AS spread FROM p GROUP BY 1, 2)
SELECT window_start, n, model_no, {r('predicted', 4)} AS predicted, {r('spread', 4)} AS spread,
 CASE WHEN n < predicted - 1.959963984540054 * spread THEN 'Sudden Drop' WHEN n > predicted + 1.959963984540054 * spread THEN 'Sudden Spike' END AS anomaly_type
FROM p LEFT JOIN m USING (model_no, slot)""")
def _(spark, d):
    return _rounded(A.retrain_scores(filled(spark, d), "window_start", "n"), "predicted", "spread")


@register("R11_refit_stream", ORACLES["R11_retrain_schedule"])
def _(spark, d):
    """Four stretches of time arrive one after the other; the stream restarts for each."""
    source, path, state = (shared_dir(spark, x) for x in ("refit-windows", "refit-scores", "refit-state"))
    series = spark.read.parquet(_written(filled(spark, d), shared_dir(spark, "refit-series")))
    first, last = series.agg(F.min(F.unix_seconds("window_start")), F.max(F.unix_seconds("window_start"))).first()
    step = (last - first) // 4 + 1
    for k in range(4):
        part = series.where(F.floor((F.unix_seconds("window_start") - first) / step) == k)
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(series.schema).parquet(source)
        K.drain(K.refit_scores(stream, F.lit("all"), "window_start", "n"), path, state, "refit")
    scored = spark.read.schema(K.SCORES + ", anomaly_type string").parquet(path)
    return _rounded(scored, "predicted", "spread").select(
        F.timestamp_millis("window_ms").alias("window_start"), "n", "model_no", "predicted", "spread", "anomaly_type"
    )


def _written(df, path):
    df.write.parquet(path)
    return path


# --- rules ------------------------------------------------------------------
_NOW = ("2000-01-01", "2001-12-31")
_THEN = ("1995-01-01", "1999-12-31")
_COST = "CAST(SUM(cpi) + SUM(CASE WHEN is_click THEN cpc ELSE 0 END) AS DOUBLE)"
_SIGMA = lambda c: f"CASE WHEN {c} < m_{c} - 2 * s_{c} THEN 'DROP' WHEN {c} > m_{c} + 2 * s_{c} THEN 'SURGE' ELSE 'NORMAL' END AS {c}_status"


@register("R13_sql_sigma_alert", f"""WITH {FACTS}, a AS (SELECT hour, dt, COUNT(*) AS impressions, {SQL['clicks']} AS clicks, {_COST} AS cost FROM facts WHERE {between(WHOLE)} GROUP BY 1, 2),
 u AS (SELECT hour, AVG(impressions) AS m_impressions, AVG(clicks) AS m_clicks, AVG(cost) AS m_cost, stddev_samp(impressions) AS s_impressions, stddev_samp(clicks) AS s_clicks
  FROM a WHERE dt < DATE '1999-12-01' GROUP BY 1)
SELECT hour, impressions, clicks, cost, {r('m_impressions', 4)} AS mean_impressions, {r('m_clicks', 4)} AS mean_clicks, {_SIGMA('impressions')}, {_SIGMA('clicks')},
 CASE WHEN cost > m_cost * 1.5 THEN 'OVER' WHEN cost < m_cost * 0.5 THEN 'UNDER' ELSE 'NORMAL' END AS cost_status
FROM a JOIN u USING (hour) WHERE dt = DATE '1999-12-01'""")
def _(spark, d):
    rows = ad_facts(spark, d, performance_needs(("clicks", "cost_full"), ("dt", "hour")))
    per_hour = summarise(rows, ("hour", "dt"), ("impressions", "clicks", "cost_full")).withColumn(
        "cost", F.col("cost_full").cast("double")
    )
    day = F.lit("1999-12-01").cast("date")
    out = A.hour_sigma_alert(per_hour.where(F.col("dt") < day), per_hour.where(F.col("dt") == day))
    return _rounded(out, "mean_impressions", "mean_clicks")


@register("R14_ctr_sigma_outliers", f"""WITH {FACTS}, g AS (SELECT campaign_id, dt, {pick('impressions', 'clicks')} FROM facts GROUP BY 1, 2),
 h AS (SELECT *, {rates('ctr_percent')} FROM g), s AS (SELECT {r('AVG(ctr_percent)', 6)} AS mean_ctr, {r('stddev_samp(ctr_percent)', 6)} AS sd FROM h WHERE {between(_THEN)})
SELECT campaign_id, dt, impressions, clicks, ctr_percent, mean_ctr, {r('ctr_percent - mean_ctr')} AS ctr_diff,
 CASE WHEN ctr_percent > mean_ctr + 2.0 * sd THEN 'Unusually High' ELSE 'Unusually Low' END AS ctr_status
FROM h CROSS JOIN s WHERE {between(_NOW)} AND impressions >= 5 AND (ctr_percent > mean_ctr + 2.0 * sd OR ctr_percent < mean_ctr - 2.0 * sd)""")
def _(spark, d):
    rows = ad_facts(spark, d, ("campaign_id", "dt", "is_click"))
    rated = performance(rows, ("campaign_id", "dt"), ("impressions", "clicks"), ("ctr_percent",))
    inside = lambda p: F.col("dt").between(*[F.lit(x).cast("date") for x in p])
    return A.ctr_sigma_outliers(rated, inside(_THEN), inside(_NOW), min_rows=5)


@register("R15_low_traffic_alarm", f"""WITH c AS (SELECT {FIVE} AS window_start, COUNT(*) AS n FROM events GROUP BY 1)
SELECT window_start, n, COALESCE(n < 2 AND LAG(n) OVER (ORDER BY window_start) < 2, FALSE) AS alarm FROM c""")
def _(spark, d):
    return S.low_traffic_alarm(five_minute_counts(spark, d), "window_start", "n", limit=2)


@register("R16_freshness_alarm", """WITH e AS (SELECT ts, ts + INTERVAL 1 SECOND * (20 * CAST(json_extract_string(props, '$.k') AS INTEGER)) AS ingest FROM events)
SELECT time_bucket(INTERVAL 5 MINUTE, ingest) AS window_start, MAX(epoch_us(ingest) - epoch_us(ts)) / 1000000 AS max_lag_seconds,
 MAX(epoch_us(ingest) - epoch_us(ts)) / 1000000 > 900 AS alarm FROM e GROUP BY 1""")
def _(spark, d):
    lag = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.get_json_object("props", "$.k").cast("int") * 20)
    rows = events(spark, d).withColumn("ingest_ts", F.col("ts") + lag)
    return S.freshness_alarm(rows, "ts", "ingest_ts")


# --- profiles ---------------------------------------------------------------
@register("R17_series_profile", f"WITH {_GRID5} SELECT COUNT(n) AS points, MIN(n) AS min_value, MAX(n) AS max_value, AVG(n) AS mean_value FROM f5")
def _(spark, d):
    return S.series_profile(filled(spark, d), "n")


@register("R17_profile_by_hour", f"WITH {_GRID5} SELECT CAST(hour(window_start) AS BIGINT) AS hour, AVG(n) AS mean_value, COUNT(n) AS points FROM f5 GROUP BY 1")
def _(spark, d):
    return S.profile_by(filled(spark, d), "n", hour=F.hour("window_start"))


@register("R17_profile_by_date", f"WITH {_GRID5} SELECT window_start::DATE AS date, CAST(isodow(window_start) AS BIGINT) AS weekday, AVG(n) AS mean_value, COUNT(n) AS points FROM f5 GROUP BY 1, 2")
def _(spark, d):
    t = F.col("window_start")
    return S.profile_by(filled(spark, d), "n", date=t.cast("date"), weekday=F.weekday(t) + 1)


_K = lambda k: f"NULLIF(COUNT(*) FILTER (WHERE event_type = '{k}'), 0) AS {k}s"


@register("R18_multi_series_align", f"""WITH {EV} SELECT {FIVE} AS window_start, {_K('impression')}, {_K('click')}, {_K('conversion')} FROM ev
WHERE event_type <> 'other' GROUP BY 1""")
def _(spark, d):
    rows = ad_events(spark, d)
    one = lambda kind, name: S.tumbling(
        rows.where(F.col("event_type") == kind), "ts", "5 minutes", F.count(F.lit(1)).alias(name)
    )
    return S.align(
        "window_start", impressions=one("impression", "impressions"),
        clicks=one("click", "clicks"), conversions=one("conversion", "conversions"),
    )


# --- stream ingest ----------------------------------------------------------
_INGEST_SHAPE = "event_id string, timestamp bigint, user_id string, bid_price double"


def _as_lines(spark, d, broken):
    """Events as JSON lines. If ``broken``, conversions arrive cut off, clicks leave a blank
    line and a record without a time behind."""
    rows = ad_events(spark, d)
    record = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("event_id"),
            F.unix_millis("ts").alias("timestamp"), "user_id", "bid_price",
        )
    )
    cut = F.when(F.col("event_type") == "conversion", F.substring(record, 1, 20)).otherwise(record)
    path = shared_dir(spark, "lines")
    lines = F.array(record)
    if broken:
        timeless = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "user_id"))
        lines = F.when(F.col("event_type") == "click", F.array(cut, F.lit(""), timeless)).otherwise(F.array(cut))
    rows.select(F.explode(lines).alias("value")).write.text(path)
    return path


@register("A12_ndjson_ingest", f"""WITH {EV} SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day,
 COUNT(*) AS n, CAST(SUM(bid_price) AS DOUBLE) AS bids, (SELECT COUNT(*) FILTER (WHERE event_type = 'conversion') + 2 * COUNT(*) FILTER (WHERE event_type = 'click') FROM ev) AS rejects FROM ev WHERE event_type <> 'conversion' GROUP BY 1, 2, 3""")
def _(spark, d):
    sink, errors = shared_dir(spark, "landed"), shared_dir(spark, "rejected")
    lines = I.read_lines(spark, _as_lines(spark, d, True))
    I.ndjson_ingest(lines, StructType.fromDDL(_INGEST_SHAPE), sink, errors, shared_dir(spark, "state"), True).awaitTermination()
    batch = "stream string, run string, batch string"
    parts = f"year string, month string, day string, hour string, {batch}"
    landed = spark.read.schema(f"{_INGEST_SHAPE}, {parts}").parquet(sink)
    rejects = spark.read.schema(f"line string, {batch}").parquet(errors).agg(F.count(F.lit(1)).alias("rejects"))
    return landed.groupBy("year", "month", "day").agg(
        F.count(F.lit(1)).alias("n"), money_sum("bid_price").alias("bids")
    ).crossJoin(F.broadcast(rejects))


_MIXED = "event_id string, timestamp bigint, impression_id string, click_id string, conversion_id string, user_id string, internal string"


@register("A13_event_router", f"""WITH {EV} SELECT CASE event_type WHEN 'conversion' THEN 'conversion' WHEN 'click' THEN 'click' ELSE 'impression' END AS kind,
 COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM ev GROUP BY 1""")
def _(spark, d):
    kind = F.col("event_type")
    ident = F.col("event_id").cast("string")
    rows = ad_events(spark, d).select(
        ident.alias("event_id"), F.unix_millis("ts").alias("timestamp"), ident.alias("impression_id"),
        F.when(kind.isin("click", "conversion"), ident).alias("click_id"),
        F.when(kind == "conversion", ident).alias("conversion_id"),
        "user_id", F.lit("x").alias("internal"),
    )
    source = shared_dir(spark, "mixed")
    rows.write.json(source)
    sinks = {k: shared_dir(spark, k) for k in ("impression", "click", "conversion")}
    stream = spark.readStream.schema(_MIXED).json(source)
    I.event_router(stream, sinks, shared_dir(spark, "router-state"), True).awaitTermination()
    out = None
    for name, path in sinks.items():
        part = spark.read.schema("event_id string, user_id string").parquet(path).agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")
        ).withColumn("kind", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
