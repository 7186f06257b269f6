"""Nearest-neighbour search, reranking and table back-trace."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenads.functions.text import DAILY_TABLE, HOURLY_TABLE

# Task code travels by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Queries of one block and corpus rows of one slice; a task scores a block against a slice.
QUERY_BLOCK = 1024
SLICE_ROWS = 8192
# Corpus rows scored at once inside a task.
CHUNK = 2048
ALL_TABLES = (HOURLY_TABLE, DAILY_TABLE)


def _cosine(corpus: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Similarity, not below 0; a zero vector is similar to nothing."""
    left = np.linalg.norm(corpus, axis=1, keepdims=True)
    right = np.linalg.norm(queries, axis=1, keepdims=True)
    scale = left @ right.T
    dots = corpus @ queries.T
    return np.maximum(np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0), 0.0)


def _l2(corpus: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """1 / (1 + squared distance), the distance vector stores report for L2."""
    squares = (
        (corpus**2).sum(axis=1, keepdims=True)
        + (queries**2).sum(axis=1)
        - 2.0 * corpus @ queries.T
    )
    return 1.0 / (1.0 + np.maximum(squares, 0.0))


_SCORES = {"cosine": _cosine, "l2": _l2}


def vector_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "cosine",
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    digits: int = 6,
) -> DataFrame:
    """The ``k`` best corpus rows per query vector, ties by smaller id.

    ``queries`` has ``query_id`` and ``query_vector``; ids may be of any type that
    sorts. Queries are packed into blocks and corpus rows into slices, both of
    bounded size, and every block meets every slice in one join of packed rows.
    A task keeps the best ``k`` per query of its slice, so it never emits all pairs;
    one window over those partial winners finishes the job. The corpus is read
    once, whatever the number of queries, and nothing passes through the driver
    but the two counts. Scores are rounded before ranking so that a different
    summation order cannot swap rows.
    """
    rows = corpus.where(F.col(vector_column).isNotNull() & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    asked = queries.where(F.col("query_vector").isNotNull() & F.col("query_id").isNotNull()).select(
        F.col("query_id").alias("id"), F.col("query_vector").cast("array<double>").alias("vector")
    )
    slices, slice_count = _packed(rows, "slice", SLICE_ROWS)
    blocks, _ = _packed(asked, "block", QUERY_BLOCK)
    tasks = (
        blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slice_count - 1))))
        .withColumnsRenamed({"ids": "query_ids", "vectors": "query_vectors"})
        .join(slices, "slice")
        .repartition("slice", "block")
    )
    shape = T.StructType(
        [
            T.StructField("query_id", asked.schema["id"].dataType),
            T.StructField(id_column, rows.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    merged = tasks.mapInPandas(_best_of_slices(k, metric, digits, id_column), shape)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), id_column)
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _packed(rows: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
    """Rows dealt by a hash of their id into groups of about ``size``, one row each."""
    groups = max(1, -(-rows.count() // size))
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    packed = dealt.groupBy(name).agg(F.collect_list("id").alias("ids"), F.collect_list("vector").alias("vectors"))
    return packed, groups


def _best_of_slices(k: int, metric: str, digits: int, id_column: str):
    score_of = _SCORES[metric]

    def matrix(vectors) -> np.ndarray:
        return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, vectors, queries = np.asarray(row.ids), matrix(row.vectors), matrix(row.query_vectors)
                order = np.argsort(ids, kind="stable")
                ids, vectors = ids[order], vectors[order]
                # the place in id order stands for the id, so ids need not be numbers
                places, scores = np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0))
                for start in range(0, len(ids), CHUNK):
                    piece = np.arange(start, min(start + CHUNK, len(ids)))
                    places = np.concatenate([places, np.broadcast_to(piece, (len(queries), len(piece)))], axis=1)
                    new = np.round(score_of(vectors[piece], queries), digits).T
                    scores = np.concatenate([scores, new], axis=1)
                    kept = np.lexsort((places, -scores), axis=1)[:, :k]
                    places, scores = np.take_along_axis(places, kept, axis=1), np.take_along_axis(scores, kept, axis=1)
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(np.asarray(row.query_ids), places.shape[1]),
                        id_column: ids[places.ravel()],
                        "score": scores.ravel(),
                    }
                )

    return best


def group_centroids(corpus: DataFrame, group: str, vector_column: str = "embedding") -> DataFrame:
    """Mean vector per group: element sums are combined inside each task."""
    parts = corpus.select(group, F.posexplode(vector_column).alias("pos", "x"))
    means = parts.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    gathered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(group).agg(
        F.transform(gathered, lambda e: e["x"]).alias("query_vector")
    ).select(F.col(group).cast("bigint").alias("query_id"), "query_vector")


def rerank_topk(candidates: DataFrame, k: int = 5, score: str | None = None) -> DataFrame:
    """Best ``k`` per query by a second score, equal scores in old order.

    Without a scorer the old order stands. A missing score counts as 0.
    """
    order = [F.col("rank")]
    if score is not None:
        order = [F.desc(F.coalesce(F.col(score), F.lit(0.0))), F.col("rank")]
    w = W.partitionBy("query_id").orderBy(*order)
    return candidates.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k)


def table_backtrace(hits: DataFrame, queries: DataFrame, tables: str = "tables") -> DataFrame:
    """Tables named by the hits of each query; all tables when none is named."""
    named = (
        hits.select("query_id", F.explode(tables).alias("_table"))
        .distinct()
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_set("_table")).alias("tables"))
    )
    everything = F.array(*[F.lit(t) for t in sorted(ALL_TABLES)])
    return queries.select("query_id").join(named, "query_id", "left").select(
        "query_id", F.coalesce("tables", everything).alias("tables")
    )
