"""History, feedback, similarity search and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenads.functions.text import deterministic_id, exact_match, parse_list_text, strip_limit
from lumenads.operators import evaluation as E
from lumenads.operators import history as H
from lumenads.operators import quality as Q
from lumenads.operators import similarity as V
from lumenads.plans.testbed import table
from lumenads.registry.core import register
from lumenads.session import shared_dir
from lumenads.sources.keyed import KeyedTable

# --- history ----------------------------------------------------------------
# A run per order, feedback per accepted or returned line.
HIST = """hist AS (SELECT o_orderkey::VARCHAR AS history_id, o_orderdate AS timestamp, substr(sha256(o_custkey::VARCHAR), 1, 16) AS user_hash,
 o_orderpriority AS channel, o_orderstatus AS original_question, epoch_ms(o_orderdate) // 1000 + 7776000 AS ttl, repeat(o_orderpriority || ' ', 80) AS answer FROM orders),
 fb AS (SELECT l_orderkey::VARCHAR AS history_id, CASE WHEN l_returnflag = 'R' THEN 'negative' ELSE 'positive' END AS feedback, l_shipdate AS feedback_at,
 l_linestatus = 'F' AS trained FROM lineitem WHERE l_returnflag <> 'N')"""


def history(spark, d):
    runs = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("history_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_orderstatus").alias("original_question"),
        F.repeat(F.concat("o_orderpriority", F.lit(" ")), 80).alias("answer"),
    )
    return H.history_rows(runs)


def feedback(spark, d):
    lines = table(spark, d, "lineitem").where(F.col("l_returnflag") != "N")
    return lines.select(
        F.col("l_orderkey").cast("string").alias("history_id"),
        F.when(F.col("l_returnflag") == "R", "negative").otherwise("positive").alias("feedback"),
        F.col("l_shipdate").cast("timestamp").alias("feedback_at"),
        (F.col("l_linestatus") == "F").alias("trained"),
    )


@register("H1_history_append", f"WITH {HIST} SELECT * FROM hist")
def _(spark, d):
    path = shared_dir(spark, "history")
    rows = history(spark, d)
    split = F.lit("1998-01-01").cast("timestamp")
    H.append(rows.where(F.col("timestamp") < split), path)
    H.append(rows.where(F.col("timestamp") >= split), path)
    return spark.read.schema(rows.schema).parquet(path)


@register("H2_history_feedback_update", f"""WITH {HIST}, n AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY history_id ORDER BY feedback_at DESC, feedback DESC, trained DESC) AS rn FROM fb) WHERE rn = 1)
SELECT h.*, n.feedback, n.feedback_at, n.trained FROM hist h LEFT JOIN n USING (history_id)""")
def _(spark, d):
    return H.with_feedback(history(spark, d), feedback(spark, d))


@register("H2_history_update_in_place", f"""WITH {HIST}, n AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY history_id ORDER BY feedback_at DESC, feedback DESC, trained DESC) AS rn FROM fb) WHERE rn = 1)
SELECT h.*, n.feedback, n.feedback_at, n.trained FROM hist h LEFT JOIN n USING (history_id)""")
def _(spark, d):
    """Feedback arrives in three batches, the newest first; the second one is replayed."""
    rows = history(spark, d)
    given = feedback(spark, d)
    empty = [F.lit(None).cast(given.schema[c].dataType).alias(c) for c in ("feedback", "feedback_at", "trained")]
    whole = rows.select(*[c for c in rows.columns if c not in given.columns or c == "history_id"], *empty)
    stored = KeyedTable(shared_dir(spark, "history-keyed"), whole.schema, "history_id", 16)
    stored.update(whole, 1)
    year = F.year("feedback_at")
    parts = (year >= 1998, (year >= 1996) & (year < 1998), year < 1996)
    for batch, part in ((2, parts[0]), (3, parts[1]), (3, parts[0]), (4, parts[2])):
        stored.update(given.where(part), batch, ("feedback_at", "feedback", "trained"), insert=False)
    return stored.read(spark)


@register("H3_history_lookup", f"WITH {HIST} SELECT * FROM hist WHERE history_id = '1234'")
def _(spark, d):
    return H.lookup(history(spark, d), "1234")


@register("H3_history_recent", f"WITH {HIST} SELECT * FROM hist ORDER BY timestamp DESC, history_id DESC LIMIT 50")
def _(spark, d):
    return H.recent(history(spark, d))


def _runs(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("feedback_id"), F.col("doc_id").cast("string").alias("history_id"),
        F.col("source").alias("question"), F.col("text").alias("sql"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("created_at"),
    )


_NORM = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '--[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '\s+', ' ', 'g')))"
PEND = f"""pend AS (SELECT doc_id::VARCHAR AS feedback_id, doc_id::VARCHAR AS history_id, source AS question, sha256({_NORM}) AS sql_hash,
 TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id AS created_at, 1704067200 + doc_id * 60 + 7776000 AS ttl FROM documents)"""


@register("H4_feedback_pending_insert", f"WITH {PEND} SELECT *, 'pending' AS status FROM pend")
def _(spark, d):
    return H.pending_feedback(_runs(spark, d)).drop("sql")


@register("H4_feedback_status", f"""WITH {PEND}, t AS (SELECT doc_id::VARCHAR AS feedback_id, 'seen' AS status, 1 AS step FROM documents WHERE lang <> 'en'
 UNION ALL SELECT doc_id::VARCHAR, CASE WHEN quality = 1 THEN 'trained' ELSE 'rejected' END, 2 FROM labels),
 n AS (SELECT feedback_id, arg_max(status, step) AS s FROM t GROUP BY 1)
SELECT feedback_id, COALESCE(s, 'pending') AS status FROM pend LEFT JOIN n USING (feedback_id)""")
def _(spark, d):
    seen = table(spark, d, "documents").where(F.col("lang") != "en").select(
        F.col("doc_id").cast("string").alias("feedback_id"), F.lit("seen").alias("status"), F.lit(1).alias("changed_at")
    )
    judged = table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("feedback_id"),
        F.when(F.col("quality") == 1, "trained").otherwise("rejected").alias("status"), F.lit(2).alias("changed_at"),
    )
    return H.current_status(H.pending_feedback(_runs(spark, d)), seen.unionByName(judged)).select("feedback_id", "status")


@register("H5_index_queries", f"WITH {HIST} SELECT * FROM hist WHERE channel = '1-URGENT'")
def _(spark, d):
    return H.by_index(history(spark, d), "channel", "1-URGENT", ("timestamp",))


@register("H5_index_session", "SELECT conv_id AS session_id, turn AS turn_number, role, text FROM conversations WHERE conv_id = 7")
def _(spark, d):
    return H.by_index(_turns(spark, d), "session_id", 7, ("turn_number",), descending=False)


@register("H5_index_feedback", f"""WITH {HIST}, n AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY history_id ORDER BY feedback_at DESC, feedback DESC, trained DESC) AS rn FROM fb) WHERE rn = 1)
SELECT h.*, n.feedback, n.feedback_at, n.trained FROM hist h JOIN n USING (history_id) WHERE n.feedback = 'negative'""")
def _(spark, d):
    return H.by_index(H.with_feedback(history(spark, d), feedback(spark, d)), "feedback", "negative", ("feedback_at",))


def _turns(spark, d):
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_number"), "role", "text"
    )


@register("W11_session_last_n", """WITH t AS (SELECT conv_id AS session_id, turn AS turn_number, role, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn,
 MAX(turn) OVER (PARTITION BY conv_id) + 1 AS next_turn FROM conversations) SELECT * EXCLUDE (rn) FROM t WHERE rn <= 5""")
def _(spark, d):
    return Q.session_tail(_turns(spark, d))


@register("D2_feedback_dedup", f"""WITH {PEND} SELECT feedback_id, sql_hash, CASE WHEN ROW_NUMBER() OVER (PARTITION BY sql_hash ORDER BY created_at, feedback_id) = 1 THEN 'pending' ELSE 'duplicate' END AS status FROM pend""")
def _(spark, d):
    return Q.feedback_dedup(H.pending_feedback(_runs(spark, d))).select("feedback_id", "sql_hash", "status")


@register("D3_deterministic_id", "SELECT doc_id, sha256(source || chr(1) || text) AS id FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", deterministic_id("source", "text").alias("id"))


# --- similarity -------------------------------------------------------------
# The questions are the mean vectors of the labels; the corpus is every vector.
_QUERY = """parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
 means AS (SELECT label, pos, AVG(x) AS x FROM parts GROUP BY 1, 2), q AS (SELECT label::BIGINT AS query_id, list(x ORDER BY pos) AS v FROM means GROUP BY 1),
 c AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"""
_COS = "greatest(CAST(ROUND(CAST(list_cosine_similarity(e, v) AS DECIMAL(38,12)), 6) AS DOUBLE), 0.0)"
_L2 = "CAST(ROUND(CAST(1.0 / (1.0 + list_distance(e, v) * list_distance(e, v)) AS DECIMAL(38,12)), 6) AS DOUBLE)"


def _top(score, k, name="hits", where=""):
    return f"""{name} AS (SELECT * FROM (SELECT query_id, vec_id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT query_id, vec_id, {score} AS score FROM q CROSS JOIN c {where})) WHERE rank <= {k})"""


def _search(spark, d, k, metric="cosine", corpus=None):
    vectors = table(spark, d, "embeddings")
    return V.vector_topk(vectors if corpus is None else corpus, V.group_centroids(vectors, "label"), k, metric)


@register("V1_cosine_topk", f"WITH {_QUERY}, {_top(_COS, 20)} SELECT * FROM hits")
def _(spark, d):
    return _search(spark, d, 20)


@register("V2_l2_topk", f"WITH {_QUERY}, {_top(_L2, 10)} SELECT * FROM hits")
def _(spark, d):
    return _search(spark, d, 10, "l2")


@register("V3_doc_topk", f"""WITH {_QUERY}, {_top(_COS, 10, where='WHERE vec_id IN (SELECT doc_id FROM documents)')} SELECT query_id, vec_id AS doc_id, score, rank, lang, n_chars, md5(text) AS text_md5 FROM hits JOIN documents ON vec_id = doc_id""")
def _(spark, d):
    docs = table(spark, d, "documents")
    corpus = table(spark, d, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    hits = _search(spark, d, 10, corpus=corpus)
    return hits.withColumnRenamed("vec_id", "doc_id").join(docs, "doc_id").select(
        "query_id", "doc_id", "score", "rank", "lang", "n_chars", F.md5("text").alias("text_md5")
    )


@register("V4_rerank_topk", f"""WITH {_QUERY}, {_top(_COS, 20)}, s AS (SELECT h.*, n_chars FROM hits h LEFT JOIN documents ON vec_id = doc_id)
SELECT * FROM (SELECT query_id, vec_id, score, rank, n_chars, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY COALESCE(n_chars, 0) DESC, rank) AS new_rank FROM s) WHERE new_rank <= 5""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars")
    return V.rerank_topk(_search(spark, d, 20).join(docs, "vec_id", "left"), 5, "n_chars")


@register("V4_rerank_no_scorer", f"WITH {_QUERY}, {_top(_COS, 20)} SELECT *, rank AS new_rank FROM hits WHERE rank <= 5")
def _(spark, d):
    return V.rerank_topk(_search(spark, d, 20), 5)


_TABLE_TEXT = "CASE WHEN label < 3 THEN 'ad_combined_log' WHEN label < 5 THEN 'ad_combined_log_summary' END"


@register("V5_table_backtrace", f"""WITH {_QUERY}, {_top(_COS, 20)}, t AS (SELECT DISTINCT query_id, {_TABLE_TEXT} AS name FROM hits JOIN c USING (vec_id)),
 g AS (SELECT query_id, string_agg(name, ',' ORDER BY name) AS names FROM t WHERE name IS NOT NULL GROUP BY 1)
SELECT query_id, COALESCE(names, 'ad_combined_log,ad_combined_log_summary') AS tables FROM q LEFT JOIN g USING (query_id)""")
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    label = F.col("label")
    listed = F.when(label < 3, "['ad_combined_log']").when(label < 5, "['ad_combined_log_summary']")
    named = vectors.select("vec_id", parse_list_text(listed).alias("tables"))
    queries = V.group_centroids(vectors, "label")
    hits = V.vector_topk(vectors, queries, 20).join(named, "vec_id")
    return V.table_backtrace(hits, queries).select("query_id", F.array_join("tables", ",").alias("tables"))


# --- evaluation -------------------------------------------------------------
def _canonical(text):
    bare = f"regexp_replace(regexp_replace({text}, '--[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g')"
    return f"trim(regexp_replace(upper(trim(regexp_replace({bare}, '\\s+', ' ', 'g'))), ',\\s*', ', ', 'g'))"


@register("E1_exact_match", f"""WITH t AS (SELECT doc_id, text, '-- head' || chr(10) || '  ' || upper(text) || CASE WHEN doc_id % 3 = 0 THEN ' x' ELSE '' END || '  /* tail */' AS noisy,
 text || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '-- ' ELSE '' END || ' LIMIT 1000 ;' AS limited FROM documents)
SELECT doc_id, {_canonical('text')} = {_canonical('noisy')} AS same, {_canonical('text')} = {_canonical('limited')} AS longer,
 {_canonical('text')} = {_canonical("trim(regexp_replace(trim(limited), '(?i)\\s+LIMIT\\s+\\d+\\s*;?\\s*$', ''))")} AS without_limit FROM t""")
def _(spark, d):
    text = F.col("text")
    odd = F.when(F.col("doc_id") % 3 == 0, " x").otherwise("")
    noisy = F.concat(F.lit("-- head\n  "), F.upper(text), odd, F.lit("  /* tail */"))
    limited = F.concat(text, F.lit("\n"), F.when(F.col("doc_id") % 5 == 0, "-- ").otherwise(""), F.lit(" LIMIT 1000 ;"))
    return table(spark, d, "documents").select(
        "doc_id", exact_match(text, noisy).alias("same"), exact_match(text, limited).alias("longer"),
        exact_match(text, strip_limit(limited)).alias("without_limit"),
    )


_SIDE = "SELECT o_orderpriority AS a, l_returnflag <> 'N' AS b, l_quantity AS c, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = '{}' GROUP BY 1, 2, 3"


def _side(spark, d, status):
    rows = table(spark, d, "lineitem").where(F.col("l_linestatus") == status)
    return rows.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


@register("E2_result_equal", f"""WITH f AS ({_SIDE.format('F')}), o AS ({_SIDE.format('O')}), j AS (SELECT f.n AS x, o.n AS y FROM f FULL JOIN o USING (a, b, c))
SELECT COUNT(*) = 0 AS equal, COUNT(*) AS differing_keys FROM j WHERE COALESCE(x, 0) <> COALESCE(y, 0)""")
def _(spark, d):
    click = F.col("l_returnflag") != "N"
    left = _side(spark, d, "F").select("o_orderpriority", click.alias("clicked"), "l_quantity")
    quantity = F.format_string("%.2f", "l_quantity")
    right = _side(spark, d, "O").select(quantity.alias("q"), "o_orderpriority", click.alias("was_clicked"))
    return E.result_equal(left, right)


@register("E2_result_equal_same", """WITH l AS (SELECT l_discount AS x, CAST(l_quantity AS INTEGER) AS y, l_returnflag AS z, COUNT(*) AS n FROM lineitem GROUP BY 1, 2, 3),
 o AS (SELECT CAST(CAST(l_discount AS VARCHAR) AS DOUBLE) AS x, l_quantity AS y, l_returnflag AS z, COUNT(*) AS n FROM lineitem GROUP BY 1, 2, 3),
 j AS (SELECT l.n AS a, o.n AS b FROM l FULL JOIN o ON l.x = o.x AND l.y = o.y AND l.z = o.z)
SELECT COUNT(*) = 0 AS equal, COUNT(*) AS differing_keys FROM j WHERE COALESCE(a, 0) <> COALESCE(b, 0)""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    shuffled = rows.select(
        F.col("l_discount").cast("string").alias("x"), F.col("l_quantity").cast("int").alias("y"), F.col("l_returnflag").alias("z")
    )
    return E.result_equal(rows, shuffled)


@register("E2_result_digest", f"""WITH f AS ({_SIDE.format('F')}), o AS ({_SIDE.format('O')}), j AS (SELECT f.n AS x, o.n AS y FROM f FULL JOIN o USING (a, b, c))
SELECT 'sides' AS compared, COUNT(*) = 0 AS equal FROM j WHERE COALESCE(x, 0) <> COALESCE(y, 0) UNION ALL SELECT 'itself', COUNT(*) >= 0 FROM j""")
def _(spark, d):
    """Two different results, and one beside itself with other column names, order and types."""
    click = F.col("l_returnflag") != "N"
    left = _side(spark, d, "F").select("o_orderpriority", click.alias("clicked"), "l_quantity")
    right = _side(spark, d, "O").select(F.format_string("%.2f", "l_quantity").alias("q"), "o_orderpriority", click.alias("was_clicked"))
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    other = rows.select(F.col("l_discount").cast("string").alias("x"), F.col("l_quantity").cast("int").alias("y"), F.col("l_returnflag").alias("z"))
    named = [(E.same_result(left, right), "sides"), (E.same_result(rows, other), "itself")]
    both = [df.select(F.lit(name).alias("compared"), "equal") for df, name in named]
    return both[0].unionByName(both[1])


CASES = """cases AS (SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN '' ELSE text END AS gen, CASE WHEN turn > 3 THEN 0 ELSE turn + 1 END AS g,
 CASE WHEN role = 'assistant' AND turn > 3 THEN 1 WHEN turn > 3 THEN 0 ELSE turn END AS t, role = 'user' AS eq FROM conversations),
 judged AS (SELECT *, CASE WHEN trim(gen) = '' THEN 'no_sql' WHEN g = 0 AND t = 0 THEN 'both_empty' WHEN g = 0 THEN 'empty_result' WHEN eq THEN 'equal' ELSE 'mismatch' END AS reason FROM cases)"""


def _cases(spark, d):
    turn, role = F.col("turn"), F.col("role")
    late = turn > 3
    return table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("test_id"),
        F.when(role == "system", "").otherwise(F.col("text")).alias("generated_sql"), F.col("text").alias("ground_truth_sql"),
        F.when(late, 0).otherwise(turn + 1).alias("generated_rows"),
        F.when((role == "assistant") & late, 1).when(late, 0).otherwise(turn).alias("truth_rows"),
        (role == "user").alias("results_equal"),
    )


@register("E3_eval_report", f"WITH {CASES} SELECT COUNT(*) AS total_cases, COUNT(*) FILTER (WHERE reason IN ('equal', 'both_empty')) AS passed, COUNT(*) FILTER (WHERE reason IN ('equal', 'both_empty'))::DOUBLE / COUNT(*) AS accuracy FROM judged")
def _(spark, d):
    return E.eval_report(E.judge_cases(_cases(spark, d)))


@register("E3_eval_reasons", f"WITH {CASES} SELECT reason, COUNT(*) AS cases FROM judged GROUP BY 1")
def _(spark, d):
    return E.reason_counts(E.judge_cases(_cases(spark, d), "similar"))
