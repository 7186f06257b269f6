"""Comparison of query results and the accuracy report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenads.functions.text import normalised_scalar, sql_text_canonical

SIMILAR_ENOUGH = 0.6


def row_key(df: DataFrame, ordered: bool = False) -> Column:
    """Row as text, blind to column names and, unless ``ordered``, to column order.

    Lengths in front of the values keep ('a', 'b') and ('ab', '') apart.
    """
    values = F.array(
        *[
            F.coalesce(normalised_scalar(f"`{name}`", kind), F.lit("\u0000null"))
            for name, kind in df.dtypes
        ]
    )
    if not ordered:
        values = F.sort_array(values)
    sized = F.transform(values, lambda v: F.concat(F.length(v).cast("string"), F.lit(":"), v))
    return F.array_join(sized, "|")


def result_diff(left: DataFrame, right: DataFrame, ordered: bool = False) -> DataFrame:
    """Row keys whose number of copies differs between two results."""
    if len(left.columns) != len(right.columns):
        raise ValueError("results have different numbers of columns")
    count = F.count(F.lit(1))
    a = left.select(row_key(left, ordered).alias("row_key")).groupBy("row_key")
    b = right.select(row_key(right, ordered).alias("row_key")).groupBy("row_key")
    both = a.agg(count.alias("left_rows")).join(
        b.agg(count.alias("right_rows")), "row_key", "full_outer"
    )
    return both.na.fill(0, ["left_rows", "right_rows"]).where(
        F.col("left_rows") != F.col("right_rows")
    )


def result_digest(df: DataFrame, ordered: bool = False) -> DataFrame:
    """One row that is the same for the same multiset of rows: their number and two independent
    sums of row hashes. Tasks add up their own rows; no row is shuffled."""
    key = row_key(df, ordered)
    half = lambda first: F.conv(F.substring(F.col("_h"), first, 15), 16, 10).cast("decimal(38,0)")
    hashed = df.select(F.sha2(key, 256).alias("_h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(half(1)), F.lit(0).cast("decimal(38,0)")).alias("one"),
        F.coalesce(F.sum(half(20)), F.lit(0).cast("decimal(38,0)")).alias("two"),
    )


def same_result(left: DataFrame, right: DataFrame, ordered: bool = False) -> DataFrame:
    """One row, ``equal``: by digests alone, for results of any size."""
    if len(left.columns) != len(right.columns):
        return left.sparkSession.createDataFrame([(False,)], "equal boolean")
    a, b = (result_digest(x, ordered).withColumn("side", F.lit(1)) for x in (left, right))
    both = a.alias("a").join(b.alias("b"), "side")
    return both.select(
        ((F.col("a.rows") == F.col("b.rows")) & (F.col("a.one") == F.col("b.one")) & (F.col("a.two") == F.col("b.two"))).alias("equal")
    )


def compare_results(left: DataFrame, right: DataFrame, ordered: bool = False) -> DataFrame:
    """As ``result_equal``, in two steps: digests are compared first, by a job that shuffles no
    rows, and rows are grouped and joined only where the digests differ."""
    if same_result(left, right, ordered).first().equal:
        return left.sparkSession.createDataFrame([(True, 0)], "equal boolean, differing_keys bigint")
    return result_equal(left, right, ordered)


def result_equal(left: DataFrame, right: DataFrame, ordered: bool = False) -> DataFrame:
    """One row: are the two results the same multiset of rows?"""
    if len(left.columns) != len(right.columns):
        return left.sparkSession.createDataFrame(
            [(False, None)], "equal boolean, differing_keys bigint"
        )
    return result_diff(left, right, ordered).agg(
        (F.count(F.lit(1)) == 0).alias("equal"), F.count(F.lit(1)).alias("differing_keys")
    )


def text_similarity(left: Column, right: Column) -> Column:
    """1 minus the edit distance over the longer length."""
    longest = F.greatest(F.length(left), F.length(right))
    distance = F.levenshtein(left, right)
    return F.when(longest == 0, 1.0).otherwise(1.0 - distance / longest)


def judge_cases(cases: DataFrame, empty_rule: str = "pass") -> DataFrame:
    """Score and reason per case.

    ``cases`` has test_id, generated_sql, ground_truth_sql, generated_rows,
    truth_rows and results_equal. Two empty results pass under the ``pass``
    rule; under ``similar`` they pass when the SQL texts are alike enough.
    """
    no_sql = F.coalesce(F.trim("generated_sql"), F.lit("")) == ""
    both_empty = (F.col("generated_rows") == 0) & (F.col("truth_rows") == 0)
    if empty_rule == "pass":
        empty_ok = F.lit(True)
    else:
        empty_ok = (
            text_similarity(
                sql_text_canonical("generated_sql"), sql_text_canonical("ground_truth_sql")
            )
            >= SIMILAR_ENOUGH
        )
    reason = (
        F.when(no_sql, "no_sql")
        .when(both_empty & empty_ok, "both_empty")
        .when(both_empty, "both_empty_dissimilar")
        .when(F.col("generated_rows") == 0, "empty_result")
        .when(F.col("truth_rows").isNull(), "truth_failed")
        .when(F.col("results_equal"), "equal")
        .otherwise("mismatch")
    )
    passed = F.col("reason").isin("equal", "both_empty")
    return cases.withColumn("reason", reason).withColumn(
        "exec_score", F.when(passed, 1.0).otherwise(0.0)
    )


def eval_report(judged: DataFrame) -> DataFrame:
    """Total, passed and accuracy over the judged cases."""
    return judged.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("exec_score") == 1.0).alias("passed"),
    ).withColumn(
        "accuracy",
        F.coalesce(
            F.col("passed").cast("double") / F.nullif(F.col("total_cases").cast("double"), F.lit(0.0)),
            F.lit(0.0),
        ),
    )


def reason_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("cases"))
