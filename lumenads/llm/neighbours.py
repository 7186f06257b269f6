"""Nearest neighbours by collision counting over single projections.

Vectors are dealt to shards of bounded size. Each shard keeps, for every one of
``PROJECTIONS`` random directions, its vectors' projections as one sorted array.
A query opens a window around its own projection in all arrays and widens them
step by step (radius times ``RATIO``); no array is built again for a new radius. The
first radius is a part of the k-th distance among the vectors next to the query in
the arrays, which bounds the radius in the end. A vector that lies in at least ``THRESHOLD`` of the windows is verified by its
exact distance. The search of a shard ends when its k-th verified distance is
within the radius: a vector within the radius reaches the threshold with a
probability of at least 0.95, by the choice of both numbers. Nothing is capped.

Queries go in blocks; a task holds one shard and one block. The best of each
shard are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenads.llm.tables import stored, table

PROJECTIONS = 48
# Half a window, in radii: a direction keeps 68 % of the vectors at one radius in it.
HALF_WINDOW = 1.0
THRESHOLD = 28
RATIO = 1.25
# The first radius, in those of the pilot vectors; how many on either side of the query are looked at.
FIRST = 0.64
BESIDE = 6
SEED = 7
SHARD_ROWS = 8_192
BLOCK_QUERIES = 512
SHARD = "shard long, rows long, width long, ids binary, vectors binary, values binary, order binary"


@cache
def directions(width: int) -> np.ndarray:
    return np.random.default_rng((SEED, width)).standard_normal((width, PROJECTIONS))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector, width): vectors that are null, empty, zero, or hold null or non-finite
    components take no part, nor do rows without an id."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(
            F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")
        )
        .where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
        .withColumn("width", F.size("vector").cast("long"))
    )


def _index(key, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id", kind="stable")
    data = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    values = data @ directions(data.shape[1])
    order = values.argsort(axis=0, kind="stable")
    blobs = (
        rows["vec_id"].to_numpy(np.int64),
        data,
        np.take_along_axis(values, order, axis=0).T.astype(np.float32),
        order.T.astype(np.int32),
    )
    columns = [c.split()[0] for c in SHARD.split(", ")]
    return pd.DataFrame([[key[0], len(data), key[1], *(np.ascontiguousarray(b).tobytes() for b in blobs)]], columns=columns)


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard and width; every usable vector lies in exactly one. Shards are drawn
    by a hash of id and vector, about ``shard_rows`` each, so equal ids or vectors do not
    fill one."""
    count = vectors.count()
    shards = max(1, -(-count // shard_rows))
    keyed = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)))
    return stored(keyed.groupBy("shard", "width").applyInPandas(_index, SHARD), "neighbour-index")


class Shard:
    def __init__(self, row):
        n, width = row.rows, row.width
        self.ids = np.frombuffer(row.ids, np.int64)
        self.vectors = np.frombuffer(row.vectors, np.float64).reshape(n, width)
        self.values = np.frombuffer(row.values, np.float32).reshape(PROJECTIONS, n)
        self.order = np.frombuffer(row.order, np.int32).reshape(PROJECTIONS, n)

    def nearest(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest verified, nearest first, ties by id."""
        n = len(self.ids)
        centre = (query @ directions(len(query))).astype(np.float32)
        own = self.ids == query_id
        wanted = min(k, n - int(own.sum()))
        if wanted <= 0:
            return self.ids[:0], np.zeros(0)
        distances = np.full(n, np.inf)
        verified = own.copy()

        def verify(new: np.ndarray) -> None:
            verified[new] = True
            difference = self.vectors[new] - query
            distances[new] = np.sqrt((difference * difference).sum(axis=1))

        lows = np.array([np.searchsorted(v, c) for v, c in zip(self.values, centre)])
        near = np.clip(lows[:, None] + np.arange(-BESIDE, BESIDE), 0, n - 1)
        pilot = np.unique(np.take_along_axis(self.order, near, axis=1))
        pilot = pilot[~own[pilot]]
        if len(pilot) < wanted:
            pilot = np.flatnonzero(~own)
        verify(pilot)
        kth = np.partition(distances, wanted - 1)[wanted - 1]
        radius, highs, counts = FIRST * kth, lows.copy(), np.zeros(n, np.int16)
        # bounds are rounded outwards, since the arrays hold single precision
        slack = 1e-5 * float(np.abs(centre).max()) + 1e-30
        while True:
            reach = np.float32(radius * HALF_WINDOW + slack)
            for j, (values, order, c) in enumerate(zip(self.values, self.order, centre)):
                low, high = np.searchsorted(values, c - reach, "left"), np.searchsorted(values, c + reach, "right")
                # a vector stands once in each array, so plain increments count right
                counts[order[low : lows[j]]] += 1
                counts[order[highs[j] : high]] += 1
                lows[j], highs[j] = min(low, lows[j]), max(high, highs[j])
            verify(np.flatnonzero((counts >= THRESHOLD) & ~verified))
            kth = np.partition(distances, wanted - 1)[wanted - 1]
            if kth <= radius or verified.all():
                break
            radius = min(radius * RATIO, kth)
        best = np.flatnonzero(distances <= kth)
        best = best[np.lexsort((self.ids[best], distances[best]))][:wanted]
        return self.ids[best], distances[best]


def _searched(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            shard = Shard(row)
            queries = np.frombuffer(row.query_vectors, np.float64).reshape(-1, row.width)
            parts = []
            for query_id, query in zip(np.frombuffer(row.query_ids, np.int64), queries):
                ids, distances = shard.nearest(int(query_id), query, k)
                parts.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": distances}))
            yield pd.concat(parts)


def _block(key, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id", kind="stable")
    ids, data = rows["vec_id"].to_numpy(np.int64), np.stack(rows["vector"].to_numpy()).astype(np.float64)
    columns = ["block", "width", "query_ids", "query_vectors"]
    return pd.DataFrame([[key[0], key[1], ids.tobytes(), data.tobytes()]], columns=columns)


def search(shards: DataFrame, queries: DataFrame, k: int, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row of ``queries``
    (vec_id, vector, width) among indexed vectors of its width but those of its own id.

    Ties go to the smaller vec_id. Repeated query ids count once, by their least vector.
    No queries or no shards give no rows; fewer candidates than ``k`` are all returned.
    """
    single = queries.groupBy("vec_id").agg(F.min(F.struct("vector", "width")).alias("v")).select("vec_id", "v.*")
    blocks = max(1, -(-single.count() // block_queries))
    packed = (
        single.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        .groupBy("block", "width")
        .applyInPandas(_block, "block long, width long, query_ids binary, query_vectors binary")
    )
    # every block of queries meets every shard of its width; rows are blocks and shards
    keys = shards.select("shard", "width")
    tasks = packed.join(keys, "width").repartition("shard", "block")
    found = tasks.join(shards, ["shard", "width"]).mapInPandas(
        lambda batches: _searched(batches, k), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "neighbour-vectors")
    return search(index(vectors), vectors.where(F.col("vec_id") % 100 == 0), 10)
