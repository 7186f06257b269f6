"""Near-duplicates by 64-bit SimHash fingerprints.

A fingerprint becomes a vector of bit counts, one for each ``2``-bit segment.
The Manhattan distance of two such vectors never exceeds the number of differing
bits. Counts are written in unary (00, 01, 11), so that distance is again a
number of differing bits, of the unary words. The segments form two halves: two
fingerprints within 4 bits are within Manhattan distance 2 on one half at least,
and then some grid point is within 1 of both. Each fingerprint goes to its own
grid point and those within 1 of it, on each half; what meets at a grid point is
filtered by the Manhattan distance of all segments and verified on the bits.

Copies share one fingerprint row. A grid point with many fingerprints yields a
spanning forest, not its pairs; one with more than ``TILE`` is split into pairs
of tiles that are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenads.llm.components import components
from lumenads.llm.tables import stored, table

SHINGLE = 4
MOST_BITS = 4
SEED = 42
BLOCK_WORDS = 16_384
TILE = 4_096
NEAR_ROWS = 16
LOW_BITS = np.uint64(0x5555555555555555)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """The 8 bytes of the fingerprint, most significant first; zero without words."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    total = max(len(words) - shingle + 1, min(len(words), 1))
    counts = np.zeros(64, np.int64)
    for first in range(0, total, BLOCK_WORDS):
        block = words[first : first + BLOCK_WORDS + shingle - 1]
        joined = b" ".join(block)
        ends = list(accumulate(len(w) + 1 for w in block))
        spans = zip([0, *ends], (e - 1 for e in ends[min(shingle, len(ends)) - 1 :]))
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in spans])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > total).tobytes()


def _fingerprinted(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = b"".join(fingerprint(x.as_py(), shingle) for x in batch.column("text"))
        values = np.frombuffer(prints, ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print) of every row; the fingerprint as a signed 64-bit integer."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda batches: _fingerprinted(batches, shingle), "doc_id long, print long")


def unary_counts(prints: np.ndarray) -> np.ndarray:
    """Bit counts of all 2-bit segments, each as 00, 01 or 11, in one word."""
    low, high = prints & LOW_BITS, (prints >> np.uint64(1)) & LOW_BITS
    return (low | high) | ((low & high) << np.uint64(1))


def grid_points(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, grid point) for each fingerprint: on either half, its own point and those
    where one segment's count is one more or one less."""
    counts = unary_counts(prints)
    rows, points = [], []
    for half in (0, 1):
        word = (counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        mark = np.uint64(half << 32)
        rows.append(np.arange(len(word)))
        points.append(word | mark)
        for segment in range(16):
            value = (word >> np.uint64(2 * segment)) & np.uint64(3)
            low, high = np.uint64(1 << (2 * segment)), np.uint64(2 << (2 * segment))
            for allowed, flip in ((value != 3, low), (value != 0, high)):
                which = np.flatnonzero(allowed)
                rows.append(which)
                points.append((word[which] ^ flip) | mark)
    return np.concatenate(rows), np.concatenate(points)


def _gridded(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column("node").to_numpy(zero_copy_only=False)
        for k, name in enumerate(columns):
            prints = batch.column(name).to_numpy()
            for first in range(0, len(prints), 2_000):
                some, their = prints[first : first + 2_000], nodes[first : first + 2_000]
                rows, points = grid_points(some.view(np.uint64))
                # each fingerprint has a grid of its own
                points |= np.uint64(k << 33)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(points.view(np.int64)), pa.array(some[rows]), pa.array(their[rows])],
                    names=["point", "print", "node"],
                )


def _close(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, most: int) -> np.ndarray:
    """Manhattan distance of the counts first, then the exact number of differing bits."""
    near = np.bitwise_count(ca ^ cb) <= most
    near[near] = np.bitwise_count((a ^ b)[near]) <= most
    return near


def forest(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect the same rows as all links within ``most`` bits do:
    a search from row to row, in which every row is compared once with those not
    reached so far."""
    counts = unary_counts(prints)
    waiting = np.arange(len(prints))
    queue: list[int] = []
    left, right = [], []
    while len(waiting):
        if not queue:
            queue.append(int(waiting[0]))
            waiting = waiting[1:]
            continue
        i = queue.pop()
        near = _close(prints[i], prints[waiting], counts[i], counts[waiting], most)
        if near.any():
            found = waiting[near]
            waiting = waiting[~near]
            left.append(np.full(len(found), i))
            right.append(found)
            queue.extend(found.tolist())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def spanning(i: np.ndarray, j: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Places of the links (i, j) that join what those before them have not, least nodes first."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    low, high = np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])
    for place in np.lexsort((high, low)).tolist():
        a, b = root(int(i[place])), root(int(j[place]))
        if a != b:
            parent[b] = a
            kept.append(place)
    return np.array(kept, np.int64)


def _linked(batches: Iterator[pa.RecordBatch], keys: list[str], most: int, tile: int) -> Iterator[pa.RecordBatch]:
    """Links within each key of sorted rows. Rows of a key that has more than ``tile``
    come back as they are (``a`` null), in pieces, and nothing of it is compared here."""
    held: list[np.ndarray] = []
    flooded = None

    def columns(batch: pa.RecordBatch) -> np.ndarray:
        data = np.empty((batch.num_rows, len(keys) + 2), np.int64)
        for i, name in enumerate([*keys, "print", "node"]):
            data[:, i] = batch.column(name).to_numpy(zero_copy_only=False)
        return data

    def output(a=(), b=(), rows=None) -> pa.RecordBatch:
        size = len(a) if rows is None else len(rows)
        nulls = pa.nulls(size, pa.int64())
        links = [nulls, nulls] if rows is not None else [pa.array(a, pa.int64()), pa.array(b, pa.int64())]
        kept = [nulls] * 3 if rows is None else [pa.array(rows[:, i]) for i in (0, -2, -1)]
        return pa.RecordBatch.from_arrays([*links, *kept], names=["a", "b", "point", "print", "node"])

    def links(data: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal flooded
        key = data[:, : len(keys)]
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        sizes = np.diff(np.concatenate([starts, [len(data)]]))
        group = np.repeat(np.arange(len(starts)), sizes)
        prints, nodes = np.ascontiguousarray(data[:, -2]).view(np.uint64), data[:, -1]
        small = np.repeat(sizes <= NEAR_ROWS, sizes)
        counts = unary_counts(prints)
        left, right = [], []
        for shift in range(1, min(NEAR_ROWS, len(data))):
            i = np.flatnonzero((group[shift:] == group[:-shift]) & small[shift:])
            if not len(i):
                break
            i = i[_close(prints[i], prints[i + shift], counts[i], counts[i + shift], most)]
            left.append(i)
            right.append(i + shift)
        if left:
            # several links at one grid point: those that connect the same are enough
            i, j = np.concatenate(left), np.concatenate(right)
            several = np.bincount(group[i], minlength=len(sizes))[group[i]] > 1
            kept = np.flatnonzero(several)
            kept = np.concatenate([np.flatnonzero(~several), kept[spanning(i[kept], j[kept], nodes)]])
            left, right = [i[kept]], [j[kept]]
        for g in np.flatnonzero(sizes > NEAR_ROWS):
            first, size = starts[g], sizes[g]
            if size > tile:
                flooded = tuple(key[first])
                yield output(rows=data[first : first + size])
                continue
            order = first + np.argsort(nodes[first : first + size], kind="stable")
            i, j = forest(prints[order], most)
            left.append(order[i])
            right.append(order[j])
        i, j = np.concatenate([[], *left]).astype(np.int64), np.concatenate([[], *right]).astype(np.int64)
        if len(i):
            yield output(nodes[i], nodes[j])

    for batch in batches:
        if not batch.num_rows:
            continue
        data = columns(batch)
        if flooded is not None:
            same = (data[:, : len(keys)] == np.array(flooded)).all(axis=1)
            if same.any():
                yield output(rows=data[same])
                data = data[~same]
            if not len(data):
                continue
            flooded = None
        data = np.concatenate([*held, data])
        last = int(np.flatnonzero((data[:, : len(keys)] != data[-1, : len(keys)]).any(axis=1)).max(initial=-1)) + 1
        if last:
            yield from links(data[:last])
            flooded = None
        held = [data[last:]]
        if len(data) - last > tile:
            flooded = tuple(data[-1, : len(keys)])
            yield output(rows=data[last:])
            held = []
    if held:
        yield from links(held[0])


LINKS = "a long, b long, point long, print long, node long"


def links(nodes: DataFrame, most: int = MOST_BITS, tile: int = TILE) -> DataFrame:
    """(a, b) between nodes (node, and one or more fingerprint columns) so that those within
    ``most`` bits, at most 4, in any one fingerprint are connected; every link is verified."""
    if most > 4:
        raise ValueError("two halves and steps of one find up to 4 differing bits")
    columns = [c for c in nodes.columns if c != "node"]
    gridded = nodes.mapInArrow(lambda batches: _gridded(batches, columns), "point long, print long, node long")
    met = stored(
        gridded.repartition("point")
        .sortWithinPartitions("point")
        .mapInArrow(lambda batches: _linked(batches, ["point"], most, tile), LINKS),
        "simhash-links",
    )
    crowded = met.where("a is null").select("point", "print", "node")
    sizes = crowded.groupBy("point").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    tiled = (
        crowded.join(sizes, "point")
        .withColumn("tile", F.pmod(F.xxhash64("print"), F.col("tiles")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "point", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "print", "node"
        )
    )
    keys = ["point", "i", "j"]
    more = (
        tiled.repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(lambda batches: _linked(batches, keys, most, 1 << 62), LINKS)
    )
    return met.where("a is not null").select("a", "b").unionByName(more.select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) per row.

    Null and empty texts have fingerprint zero and link like any other; repeated
    rows come back repeated; rows whose doc_id is null get a fingerprint and the
    component of the documents they link to, null if there are none. Columns
    other than doc_id and text are not read. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    nodes = stored(
        prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node")), "simhash-nodes"
    )
    found = components(links(nodes, most), "a", "b")
    classes = nodes.join(found, "node", "left").select(
        "print", F.coalesce("component", "node").alias("component_id")
    )
    return prints.join(classes, "print", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component (doc_id,
    component_id) is kept: the one with the least doc_id, once. Rows without a doc_id
    stay."""
    keep = stored(components.where("doc_id = component_id").select("doc_id").distinct(), "simhash-kept")
    first = Window.partitionBy("doc_id").orderBy(*[c for c in docs.columns if c != "doc_id"])
    kept = (
        docs.join(keep, "doc_id", "left_semi")
        .withColumn("__place", F.row_number().over(first))
        .where("__place = 1")
        .select(*docs.columns)
    )
    return kept.unionByName(docs.where("doc_id is null"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
