"""Filters, parameters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from lumenads.functions import dates as D
from lumenads.functions import text as X
from lumenads.functions.metrics import change_rate, half_up, summarise
from lumenads.plans.testbed import ad_events, ad_facts, events, impressions, table, clicks
from lumenads.registry.core import FACTS, between, r, register
from lumenads.registry.journeys import EV, RAW

_COUNT = "COUNT(*) AS impressions, COUNT(*) FILTER (WHERE is_click) AS clicks"
_PARTS = ("year", "month", "day", "is_click")


def _monthly(rows):
    return summarise(rows, ("year", "month"), ("impressions", "clicks"))


def _month_sql(where):
    return f"WITH {FACTS} SELECT year, month, {_COUNT} FROM facts WHERE {where} GROUP BY 1, 2"


SPAN = ("1996-11-20", "2000-02-10")


@register("P1_date_range_filter", _month_sql(between(SPAN)))
def _(spark, d):
    return _monthly(ad_facts(spark, d, _PARTS).where(D.tuple_range(*SPAN)))


@register("P2_partition_date_between", _month_sql(between(SPAN)))
def _(spark, d):
    return _monthly(ad_facts(spark, d, _PARTS).where(D.date_between(*SPAN)))


@register("P3_yyyymmdd_range", _month_sql("CAST(strftime(dt, '%Y%m%d') AS INTEGER) BETWEEN 19961120 AND 20000210"))
def _(spark, d):
    return _monthly(ad_facts(spark, d, _PARTS).where(D.yyyymmdd().between(19961120, 20000210)))


_DTH = "year || '-' || month || '-' || day || '-' || hour"


@register("P4_prefix_filter", f"WITH {FACTS}, t AS (SELECT *, {_DTH} AS dth FROM facts) SELECT substr(dth, 12, 2) AS hour, {_COUNT} FROM t WHERE dth LIKE '1998-%' GROUP BY 1")
def _(spark, d):
    rows = ad_facts(spark, d, (*_PARTS, "hour")).withColumn("dth", F.concat_ws("-", "year", "month", "day", "hour"))
    return summarise(
        rows.where(F.col("dth").startswith("1998-")).withColumn("hour", F.substring("dth", 12, 2)),
        ("hour",), ("impressions", "clicks"),
    )


@register("P5_hour_range_filter", f"WITH {FACTS} SELECT dt, hour, {_COUNT} FROM facts WHERE hour::INT BETWEEN 11 AND 14 GROUP BY 1, 2")
def _(spark, d):
    rows = ad_facts(spark, d, ("dt", "hour", "is_click")).where(F.col("hour").between("11", "14"))
    return summarise(rows, ("dt", "hour"), ("impressions", "clicks"))


@register("P5_weekday_filter", f"WITH {FACTS} SELECT dt, {_COUNT} FROM facts WHERE isodow(dt) IN (6, 7) GROUP BY 1")
def _(spark, d):
    rows = ad_facts(spark, d, ("dt", "is_click")).where(D.iso_weekday("dt") >= 6)
    return summarise(rows, ("dt",), ("impressions", "clicks"))


TODAY = "1999-03-01"


def _recent(spark, d, period):
    rows = ad_facts(spark, d, ("dt", "is_click"), period)
    return summarise(rows, ("dt",), ("impressions", "clicks"))


def _recent_sql(low, high):
    return f"WITH {FACTS} SELECT dt, {_COUNT} FROM facts WHERE dt BETWEEN {low} AND {high} GROUP BY 1"


_T = f"DATE '{TODAY}'"


@register("P6_recent_n_days", _recent_sql(f"{_T} - 90", f"{_T} - 1"))
def _(spark, d):
    return _recent(spark, d, D.recent_days(TODAY, 90))


@register("P6_yesterday", _recent_sql(f"{_T} - 1", f"{_T} - 1"))
def _(spark, d):
    return _recent(spark, d, D.recent_days(TODAY, 1))


@register("P6_last_month", _recent_sql(f"({_T} - INTERVAL 1 MONTH)::DATE", f"{_T} - 1"))
def _(spark, d):
    return _recent(spark, d, D.resolve_period("previous_month", TODAY))


@register("P7_period_selector", " UNION ALL ".join(
    f"SELECT '{n}' AS period, {_COUNT} FROM (WITH {FACTS} SELECT * FROM facts WHERE dt BETWEEN {a} AND {b})"
    for n, a, b in (("previous_day", f"{_T} - 1", f"{_T} - 1"), ("last_7_days", f"{_T} - 7", f"{_T} - 1"), ("previous_month", "DATE '1999-02-01'", "DATE '1999-02-28'"))))
def _(spark, d):
    parts = []
    for name in ("previous_day", "last_7_days", "previous_month"):
        rows = ad_facts(spark, d, ("dt", "is_click"), D.resolve_period(name, TODAY))
        parts.append(summarise(rows, (), ("impressions", "clicks")).withColumn("period", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("P8_param_default", """SELECT o_orderkey, COALESCE(TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE), DATE '1999-01-01') AS chosen FROM orders""")
def _(spark, d):
    given = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", D.date_or_default(given, "1999-01-01").alias("chosen"))


@register("P10_report_calendar", f"""WITH {FACTS}, k AS (SELECT 'daily' AS report, DATE '1999-02-01' AS a, DATE '1999-02-28' AS b
 UNION ALL SELECT 'weekly', DATE '1999-02-22', DATE '1999-02-28' UNION ALL SELECT 'monthly', DATE '1999-02-01', DATE '1999-02-28'
 UNION ALL SELECT 'same_range_previous_month', DATE '1999-01-01', DATE '1999-01-28')
SELECT report, a AS start_date, b AS end_date, {_COUNT} FROM facts JOIN k ON dt BETWEEN a AND b GROUP BY 1, 2, 3""")
def _(spark, d):
    ranges = {k: D.report_period(k, TODAY) for k in ("daily", "weekly", "monthly")}
    ranges["same_range_previous_month"] = D.same_range_previous_month(*ranges["daily"])
    parts = None
    for name, (start, end) in ranges.items():
        days = D.day_grid(spark, start, end).select(
            F.lit(name).alias("report"), F.lit(start).cast("date").alias("start_date"),
            F.lit(end).cast("date").alias("end_date"), "dt",
        )
        parts = days if parts is None else parts.unionByName(days)
    rows = ad_facts(spark, d, ("dt", "is_click"), ("1999-01-01", "1999-02-28"))
    return summarise(rows.join(F.broadcast(parts), "dt"), ("report", "start_date", "end_date"), ("impressions", "clicks"))


@register("P10_week_list", f"""WITH {FACTS}, w AS (SELECT DISTINCT GREATEST(date_trunc('week', dt)::DATE, DATE '{SPAN[0]}') AS week_start, LEAST(date_trunc('week', dt)::DATE + 6, DATE '{SPAN[1]}')::DATE AS week_end FROM facts WHERE {between(SPAN)})
SELECT week_start, week_end, COUNT(*) AS impressions FROM w JOIN facts ON dt BETWEEN week_start AND week_end GROUP BY 1, 2""")
def _(spark, d):
    weeks = D.week_calendar(D.day_grid(spark, *SPAN), *SPAN)
    rows = ad_facts(spark, d, ("dt",), SPAN).join(F.broadcast(weeks), "dt")
    return summarise(rows, ("week_start", "week_end"), ("impressions",))


# --- text -------------------------------------------------------------------
@register("P11_pii_mask", """SELECT c_custkey, '****' || right(c_name, 4) AS user_id, '10.' || c_nationkey || '.7.*' AS ip_address,
 substr(sha256(c_custkey::VARCHAR), 1, 12) AS device_id, '[REDACTED]' AS advertiser_id, c_mktsegment FROM customer""")
def _(spark, d):
    rows = table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("user_id"),
        F.format_string("10.%d.7.%d", F.col("c_nationkey"), F.col("c_custkey")).alias("ip_address"),
        F.col("c_custkey").cast("string").alias("device_id"),
        F.col("c_mktsegment").alias("advertiser_id"), "c_mktsegment",
    )
    return X.pii_mask(rows)


@register("P12_id_hash", "SELECT c_custkey, substr(sha256(c_name), 1, 16) AS user_hash FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.id_hash("c_name").alias("user_hash"))


@register("P13_id_abbrev", "SELECT c_custkey, substr(c_name, 1, 4) || '..' || right(c_name, 4) AS short_name, substr(c_custkey::VARCHAR, 1, 4) || '..' || CASE WHEN length(c_custkey::VARCHAR) >= 4 THEN right(c_custkey::VARCHAR, 4) ELSE '' END AS short_key FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", X.id_abbrev("c_name").alias("short_name"),
        X.id_abbrev(F.col("c_custkey").cast("string")).alias("short_key"),
    )


_PATTERN_SQL = " OR ".join(f"regexp_matches(t, '(?i){p}')" for p in X.INJECTION_PATTERNS)


def _guard_sql(source):
    return f"""WITH q AS ({source}) SELECT id, CASE WHEN t = '' THEN 'QUESTION_EMPTY' WHEN length(t) > 500 THEN 'QUESTION_TOO_LONG'
 WHEN {_PATTERN_SQL} THEN 'PROMPT_INJECTION_DETECTED' END AS code FROM q"""


_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@register("P14_text_guard", _guard_sql(f"SELECT conv_id * 100 + turn AS id, {_STRIP('text')} AS t FROM conversations UNION ALL SELECT 1000000 + item_id, {_STRIP('text')} FROM benchmark UNION ALL SELECT 2000000 + doc_id, {_STRIP('text')} FROM documents"))
def _(spark, d):
    talk = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    bench = table(spark, d, "benchmark").select((F.col("item_id") + 1000000).alias("id"), "text")
    docs = table(spark, d, "documents").select((F.col("doc_id") + 2000000).alias("id"), "text")
    return talk.unionByName(bench).unionByName(docs).select("id", X.text_guard("text").alias("code"))


_ALLOWED = "[" + ", ".join(f"'{w.lower()}'" for w in X.ALLOWED_KEYWORDS) + "]"


@register("P15_keyword_allowlist", f"""WITH q AS (SELECT event_id, [event_type, upper(event_type), ' Hour ', props, 'clicks'] AS words FROM events)
SELECT event_id, array_to_string(list_filter(words, lambda w: list_contains({_ALLOWED}, lower(trim(w)))), ',') AS kept FROM q""")
def _(spark, d):
    kind = F.col("event_type")
    words = F.array(kind, F.upper(kind), F.lit(" Hour "), F.col("props"), F.lit("clicks"))
    return table(spark, d, "events").select("event_id", F.array_join(X.keyword_allowlist(words), ",").alias("kept"))


# --- scalars ----------------------------------------------------------------
@register("S1_casts", """SELECT l_returnflag, CAST(SUM(CAST(l_returnflag <> 'N' AS INTEGER)) AS BIGINT) AS clicks, CAST(SUM(CAST(strftime(l_shipdate, '%m') AS INTEGER)) AS BIGINT) AS month_sum,
 COUNT(TRY_CAST(l_returnflag AS DOUBLE)) AS numbers, COUNT(TRY_CAST(l_linenumber::VARCHAR AS DOUBLE)) AS line_numbers FROM lineitem GROUP BY 1""")
def _(spark, d):
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.sum((flag != "N").cast("int")).alias("clicks"),
        F.sum(F.date_format("l_shipdate", "MM").cast("int")).alias("month_sum"),
        F.count(flag.try_cast("double")).alias("numbers"),
        F.count(F.col("l_linenumber").cast("string").try_cast("double")).alias("line_numbers"),
    )


@register("S2_null_handling", """SELECT l_orderkey, l_linenumber, l_partkey, NULLIF(l_discount, 0) AS discount, COALESCE(NULLIF(l_tax, 0), -1.0) AS tax,
 l_extendedprice / NULLIF(l_discount, 0) AS ratio, CASE WHEN l_quantity > 25 THEN 'high' ELSE 'low' END AS size FROM lineitem""")
def _(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.coalesce(F.nullif("l_tax", F.lit(0.0)), F.lit(-1.0)).alias("tax"),
        F.try_divide("l_extendedprice", "l_discount").alias("ratio"),
        F.when(F.col("l_quantity") > 25, "high").otherwise("low").alias("size"),
    )


@register("S3_rounding", f"""SELECT event_id, {r('value', 1)} AS rounded, CAST(floor(value) AS BIGINT) AS floored, abs(value - 50) AS distance, user_id % 400 AS left_over FROM events""")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", half_up(F.col("value"), 1).alias("rounded"), F.floor("value").alias("floored"),
        F.abs(F.col("value") - 50).alias("distance"), (F.col("user_id") % 400).alias("left_over"),
    )


@register("S4_strings", """SELECT p_partkey, p_brand || '/' || p_type AS label, lpad(p_size::VARCHAR, 3, '0') AS padded, right(p_brand, 2) AS tail, p_name LIKE '%ring' AS is_ring,
 lower(p_type) LIKE lower('%PROM%') AS is_promo FROM part""")
def _(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("label"),
        F.lpad(F.col("p_size").cast("string"), 3, "0").alias("padded"),
        F.substring("p_brand", -2, 2).alias("tail"), F.col("p_name").like("%ring").alias("is_ring"),
        F.lower("p_type").like("%prom%").alias("is_promo"),
    )


@register("S5_date_text", """SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%Y/%m/%d'), '%Y/%m/%d') AS DATE) AS parsed, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%H:%M') AS clock FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", F.to_date(F.date_format("o_orderdate", "yyyy/MM/dd"), "yyyy/MM/dd").alias("parsed"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "HH:mm").alias("clock"),
    )


@register("S6_date_math", """SELECT o_orderkey, o_orderdate::DATE - 7 AS week_before, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS month_after,
 date_diff('day', o_orderdate::DATE, DATE '2002-01-01') + 1 AS days, last_day(o_orderdate::DATE) AS month_end, day(last_day(o_orderdate::DATE)) AS days_in_month FROM orders""")
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_sub(day, 7).alias("week_before"), F.add_months(day, 1).alias("month_after"),
        (F.datediff(F.lit("2002-01-01").cast("date"), day) + 1).alias("days"), F.last_day(day).alias("month_end"),
        F.dayofmonth(F.last_day(day)).alias("days_in_month"),
    )


@register("S7_date_trunc", """SELECT event_id, date_trunc('week', ts)::DATE AS week, date_trunc('month', ts)::DATE AS month, date_trunc('hour', ts) AS hour FROM events""")
def _(spark, d):
    return events(spark, d).select(
        "event_id", F.date_trunc("week", "ts").cast("date").alias("week"),
        F.date_trunc("month", "ts").cast("date").alias("month"), F.date_trunc("hour", "ts").alias("hour"),
    )


@register("S8_date_parts", """SELECT event_id, CAST(isodow(ts) AS BIGINT) AS weekday, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day, CAST(hour(ts) AS BIGINT) AS hour FROM events""")
def _(spark, d):
    return events(spark, d).select(
        "event_id", D.iso_weekday("ts").alias("weekday"), F.year("ts").alias("year"), F.month("ts").alias("month"),
        F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour"),
    )


@register("S9_zone_shift", "SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS utc, make_timestamp(epoch_us(ts) // 1000 * 1000) + INTERVAL 9 HOUR AS local FROM events")
def _(spark, d):
    stamp = F.timestamp_millis(F.unix_millis("ts"))
    return events(spark, d).select("event_id", stamp.alias("utc"), D.to_zone(stamp).alias("local"))


_MS = "make_timestamp(epoch_us(ts) // 1000 * 1000)"


@register("S10_time_breakdown", f"""WITH q AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, {_MS} AS u, {_MS} + INTERVAL 9 HOUR AS l FROM events)
SELECT event_id, ms, CAST(floor(ms / 1000) AS BIGINT) AS timestamp_seconds, replace(strftime(u, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') || '+00:00' AS utc_iso,
 replace(strftime(l, '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') || '+09:00' AS local_iso, strftime(u, '%Y-%m-%d %H:%M:%S.%g') AS utc, strftime(l, '%Y-%m-%d %H:%M:%S.%g') AS "local",
 'Asia/Seoul' AS timezone, strftime(l, '%Y-%m-%d') AS date, strftime(l, '%H:%M:%S') AS time, dayname(l) AS weekday, strftime(l, '%Y년 %m월 %d일 %H시 %M분 %S초') AS readable FROM q""")
def _(spark, d):
    rows = events(spark, d).select("event_id", F.unix_millis("ts").alias("ms"))
    return D.time_breakdown(rows, "ms")


@register("S11_click_latency", f"""WITH {RAW} SELECT c.click_id, (c.ts - i.ts) // 1000 AS seconds, date_diff('second', make_timestamp(i.ts * 1000), make_timestamp(c.ts * 1000)) AS diff_seconds FROM imp i JOIN clk c USING (impression_id)""")
def _(spark, d):
    joined = clicks(spark, d).select("click_id", "impression_id", F.col("timestamp").alias("c")).join(
        impressions(spark, d).select("impression_id", F.col("timestamp").alias("i")), "impression_id"
    )
    return joined.select(
        "click_id", F.floor((F.col("c") - F.col("i")) / 1000).alias("seconds"),
        F.timestamp_diff("SECOND", F.timestamp_millis("i"), F.timestamp_millis("c")).alias("diff_seconds"),
    )


@register("S12_epoch_normalise", "SELECT event_id, CASE event_type WHEN 'view' THEN date_trunc('second', ts) WHEN 'click' THEN make_timestamp(epoch_us(ts) // 1000 * 1000) ELSE ts END AS time FROM events")
def _(spark, d):
    kind = F.col("event_type")
    micros = F.unix_micros("ts")
    raw = F.when(kind == "view", F.unix_seconds("ts")).when(kind == "click", F.unix_millis("ts")).otherwise(micros * 1000)
    return events(spark, d).select("event_id", D.epoch_normalise(raw).alias("time"))


@register("S13_list_text", """WITH t AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 3 = 0 THEN [p_type] WHEN p_size % 3 = 1 THEN [p_brand, p_type] ELSE [p_brand, p_type, p_name] END AS items FROM part)
SELECT p_partkey, len(items)::BIGINT AS n, list_contains(items, p_brand) AS has_brand, '[' || chr(39) || array_to_string(items, chr(39) || ', ' || chr(39)) || chr(39) || ']' AS again FROM t""")
def _(spark, d):
    third = F.col("p_size") % 3
    listed = F.when(third == 0, F.array("p_type")).when(third == 1, F.array("p_brand", "p_type")).otherwise(
        F.array("p_brand", "p_type", "p_name")
    )
    items = X.parse_list_text(X.list_to_text(listed))
    return table(spark, d, "part").select(
        "p_partkey", F.size(items).alias("n"), F.array_contains(items, F.col("p_brand")).alias("has_brand"),
        X.list_to_text(items).alias("again"),
    )


@register("S14_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"event_id":' || event_id || ',"kind":"' || event_type || '"}' AS encoded FROM events""")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.from_json("props", "k bigint")["k"].alias("k"),
        F.to_json(F.struct("event_id", F.col("event_type").alias("kind"))).alias("encoded"),
    )


@register("S15_hashes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md"))


_NORM = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(q, '--[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '\s+', ' ', 'g')))"


@register("S16_sql_text_normalise", f"""WITH t AS (SELECT doc_id, '/* note' || chr(10) || ' two */ ' || text || ' -- end' || chr(10) || ' LIMIT 10;' AS q FROM documents)
SELECT doc_id, sha256({_NORM}) AS sql_hash, length({_NORM}) AS n_chars, sha256(trim(text)) AS no_limit FROM (SELECT t.*, d.text FROM t JOIN documents d USING (doc_id))""")
def _(spark, d):
    text = F.concat(F.lit("/* note\n two */ "), F.col("text"), F.lit(" -- end\n LIMIT 10;"))
    return table(spark, d, "documents").select(
        "doc_id", X.sql_hash(text).alias("sql_hash"), F.length(X.sql_text_normalise(text)).alias("n_chars"),
        F.sha2(X.strip_limit(F.concat(F.col("text"), F.lit(" LIMIT 10;"))), 256).alias("no_limit"),
    )


_SQLTEXT = """CASE event_type WHEN 'view' THEN 'SELECT 1 FROM ad_combined_log WHERE k = ' || props WHEN 'click' THEN 'SELECT 1 FROM ad_combined_log_summary s'
 WHEN 'error' THEN 'SELECT 1 FROM ad_combined_log_summary s JOIN ad_combined_log l ON s.id = l.id' ELSE props END"""


def sql_texts():
    """Query texts by event type, as the history would hold them."""
    kind, props = F.col("event_type"), F.col("props")
    return (
        F.when(kind == "view", F.concat(F.lit("SELECT 1 FROM ad_combined_log WHERE k = "), props))
        .when(kind == "click", F.lit("SELECT 1 FROM ad_combined_log_summary s"))
        .when(kind == "error", F.lit("SELECT 1 FROM ad_combined_log_summary s JOIN ad_combined_log l ON s.id = l.id"))
        .otherwise(props)
    )


@register("S17_tables_in_sql", f"""WITH t AS (SELECT event_id, {_SQLTEXT} AS q FROM events)
SELECT event_id, CASE WHEN contains(q, 'ad_combined_log_summary') AND regexp_matches(replace(q, 'ad_combined_log_summary', ''), 'ad_combined_log') THEN 'ad_combined_log_summary,ad_combined_log'
 WHEN regexp_matches(replace(q, 'ad_combined_log_summary', ''), 'ad_combined_log') THEN 'ad_combined_log' ELSE 'ad_combined_log_summary' END AS tables FROM t""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(X.tables_in_sql(sql_texts()), ",").alias("tables"))


@register("S18_safe_number", """SELECT event_id, COALESCE(TRY_CAST(x AS DOUBLE), 0.0) AS number, COALESCE(CAST(trunc(TRY_CAST(x AS DOUBLE)) AS BIGINT), 0) AS whole
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN NULL WHEN 'error' THEN props ELSE value::VARCHAR END AS x FROM events)""")
def _(spark, d):
    kind = F.col("event_type")
    raw = F.when(kind == "view", "").when(kind == "click", F.lit(None)).when(kind == "error", F.col("props")).otherwise(
        F.col("value").cast("string")
    )
    return table(spark, d, "events").select(
        "event_id", X.safe_number(raw).alias("number"), X.safe_int(raw).alias("whole")
    )


@register("S19_change_rate", f"""WITH {EV}, g AS (SELECT ad_id, date, COUNT(*) FILTER (WHERE event_type = 'impression') AS n FROM ev GROUP BY 1, 2),
 l AS (SELECT *, LAG(n) OVER (PARTITION BY ad_id ORDER BY date) AS p FROM g) SELECT ad_id, date, n, p, {r('(n::DOUBLE - p) * 100.0 / NULLIF(p, 0)')} AS change FROM l""")
def _(spark, d):
    counts = ad_events(spark, d).groupBy("ad_id", "date").agg(F.count_if(F.col("event_type") == "impression").alias("n"))
    before = counts.withColumn("p", F.lag("n").over(W.partitionBy("ad_id").orderBy("date")))
    return before.withColumn("change", change_rate("n", "p"))
