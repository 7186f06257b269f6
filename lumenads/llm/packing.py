"""Packing of documents into fixed windows by non-negative least squares.

Every document gives whole windows and one rest shorter than a window. Rests are
counted in length steps of ``GRAIN`` ids. All ways to fill a window with at most
``DEPTH`` steps are enumerated; non-negative least squares finds how often to
repeat each so that the sum comes closest to the counts. Repeats are rounded
down; the rests left over are packed greedily, next-fit, cut where a window is
full. The solver sees the histogram only (``window / GRAIN`` numbers), whatever
the number of documents; assignment of rests to windows is by joins and sums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenads.llm.tables import stored, table
from lumenads.llm.tokens import encoder

WINDOW = 1024
GRAIN = 4
DEPTH = 3
# Input tasks whose leftovers are packed together.
TASKS_A_GROUP = 32


def combinations(steps: int, depth: int = DEPTH) -> np.ndarray:
    """All multisets of at most ``depth`` lengths that add up to ``steps``; rows padded with 0."""
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(chosen + (0,) * (depth - len(chosen)))
        elif len(chosen) == depth - 1:
            if left <= (chosen[-1] if chosen else left):
                found.append(chosen + (left,))
        else:
            for length in range(min(left, chosen[-1] if chosen else left), 0, -1):
                if length * (depth - len(chosen)) >= left:
                    extend(chosen + (length,), left - length)

    extend((), steps)
    return np.array(found, np.int64).reshape(-1, depth)


def repeats(histogram: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """Non-negative least squares: repeats of each way so that the lengths used come
    closest to ``histogram`` (index: length). Active-set method; columns are read
    from ``ways`` when needed, since each has at most ``DEPTH`` entries."""
    size = len(histogram)
    x = np.zeros(len(ways))
    chosen: list[int] = []
    target = histogram.astype(float)
    tolerance = 1e-9 * max(1.0, target.max(initial=0.0))

    def columns(which: list[int]) -> np.ndarray:
        matrix = np.zeros((size, len(which)))
        np.add.at(matrix, (ways[which].T, np.arange(len(which))), 1.0)
        matrix[0] = 0.0
        return matrix

    def gradient() -> np.ndarray:
        left = target - (columns(chosen) @ x[chosen] if chosen else 0.0)
        left[0] = 0.0
        return left[ways].sum(axis=1)

    for _ in range(4 * size):
        slope = gradient()
        slope[chosen] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        chosen.append(best)
        while chosen:
            matrix = columns(chosen)
            try:
                solution = np.linalg.solve(matrix.T @ matrix, matrix.T @ target)
            except np.linalg.LinAlgError:  # ways that depend on each other
                solution = np.linalg.lstsq(matrix, target, rcond=None)[0]
            if solution.min() > tolerance:
                x[:] = 0.0
                x[chosen] = solution
                break
            old = x[chosen]
            falling = solution <= tolerance
            step = np.min(old[falling] / np.maximum(old[falling] - solution[falling], 1e-300))
            moved = old + step * (solution - old)
            x[:] = 0.0
            x[chosen] = moved
            chosen = [c for c, v in zip(chosen, moved) if v > tolerance]
    return x


def rounded(histogram: np.ndarray, ways: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole repeats that never ask for more of a length than there is."""
    whole = np.floor(x + 1e-6).astype(np.int64)
    need = np.bincount(ways.ravel(), weights=np.repeat(whole, ways.shape[1]), minlength=len(histogram))
    for way in np.argsort(x - whole, kind="stable"):
        over = [length for length in ways[way] if length and need[length] > histogram[length]]
        if over and whole[way]:
            most = max(need[length] - histogram[length] for length in over)
            cut = min(whole[way], int(most))
            whole[way] -= cut
            for length in ways[way]:
                need[length] -= cut
    return whole


def tokenised(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, window: int, grain: int):
    """Ids of each document and where its task stands: rests of the same step and whole
    windows that the task has seen before."""
    encode, part = encoder(tokenizer).ids, TaskContext.get().partitionId()
    end = int(end_id).to_bytes(4, "little")
    seen = np.zeros(window // grain + 1, np.int64)
    rows = windows = 0
    for batch in batches:
        out = {name: [] for name in TOKEN_COLUMNS}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = encode(text.as_py()) + end
            count = len(ids) // 4
            full, rest = divmod(count, window)
            step = -(-rest // grain)
            size = 4 * window
            values = (
                (part << 33) + rows, doc_id, part, count, rest, step, int(seen[step]), windows,
                [zlib.crc32(ids[i * size : (i + 1) * size]) for i in range(full)],
                zlib.crc32(ids[full * size :]), ids,
            )
            for name, value in zip(TOKEN_COLUMNS, values):
                out[name].append(value)
            rows, windows = rows + 1, windows + full
            seen[step] += 1
        yield pa.RecordBatch.from_pydict(out, TOKEN_ARROW)


TOKEN_COLUMNS = {
    "row": T.LongType(), "doc_id": T.LongType(), "part": T.LongType(), "doc_tokens": T.LongType(),
    "rest": T.LongType(), "step": T.LongType(), "step_rank": T.LongType(), "windows_before": T.LongType(),
    "window_crcs": T.ArrayType(T.LongType()), "rest_crc": T.LongType(), "ids": T.BinaryType(),
}
TOKEN_ARROW = pa.schema(
    [
        (name, pa.binary() if name == "ids" else pa.list_(pa.int64()) if name == "window_crcs" else pa.int64())
        for name in TOKEN_COLUMNS
    ]
)
TOKENS = T.StructType([T.StructField(name, kind) for name, kind in TOKEN_COLUMNS.items()])


def token_table(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """Written once, one row per input row. Repeated rows and ids stay apart by ``row``;
    a null text is empty; columns other than doc_id and text are not read."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(
        texts.mapInArrow(lambda batches: tokenised(batches, tokenizer, end_id, window, grain), TOKENS),
        "packing-tokens",
    )


def _before(counts: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the tasks before; ``counts`` has one row per task (and key)."""
    over = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(value).over(over), F.lit(0)))


def plan(spark: SparkSession, steps: DataFrame, window: int, grain: int) -> tuple[DataFrame, int]:
    """Slots (step, first, last, way_sequence): the rests of a step with ranks first to
    last - 1 go to the sequences from ``way_sequence`` on. And the number of sequences."""
    size = window // grain
    histogram = np.zeros(size + 1, np.int64)
    for step, count in steps.groupBy("step").count().where("step > 0").collect():
        histogram[step] = count
    ways = combinations(size)
    whole = rounded(histogram, ways, repeats(histogram, ways))
    used = np.zeros(size + 1, np.int64)
    slots, sequences = [], 0
    for way in np.flatnonzero(whole):
        times = int(whole[way])
        for length in ways[way][ways[way] > 0]:
            first = int(used[length])
            slots.append((int(length), first, first + times, sequences))
            used[length] += times
        sequences += times
    schema = "step long, first long, last long, way_sequence long"
    return spark.createDataFrame(slots, schema), sequences


def pack(tokens: DataFrame, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """Pieces of all rows of a ``token_table``: row, doc_id, start, length, doc_tokens,
    sequence_id, offset, and crc (null where a rest was cut).

    Offsets within a sequence have no gaps. A document is cut at whole windows and,
    if its rest was left over, where a sequence is full. Equal lengths go by task and
    place in it; a rerun over the same token table gives the same pieces. An empty
    table gives no pieces.
    """
    spark = tokens.sparkSession
    slim = tokens.drop("ids", "window_crcs")
    by_task = _before(
        slim.groupBy("part").agg(F.sum(F.floor(F.col("doc_tokens") / window)).alias("windows")), [], "windows", "base"
    )
    full = (
        tokens.where(F.col("doc_tokens") >= window)
        .select("row", "doc_id", "part", "doc_tokens", "windows_before", F.posexplode("window_crcs").alias("i", "crc"))
        .join(by_task.select("part", "base"), "part")
        .select(
            "row",
            "doc_id",
            (F.col("i").cast("long") * window).alias("start"),
            F.lit(window).cast("long").alias("length"),
            "doc_tokens",
            (F.col("base") + F.col("windows_before") + F.col("i")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
            "crc",
        )
    )
    windows = by_task.agg(F.sum("windows")).first()[0] or 0

    rests = slim.where("rest > 0")
    slots, sequences = plan(spark, rests, window, grain)
    ranks = _before(rests.groupBy("part", "step").agg(F.count("*").alias("rows")), ["step"], "rows", "base")
    placed = stored(
        rests.join(ranks.select("part", "step", "base"), ["part", "step"])
        .withColumn("rank", F.col("base") + F.col("step_rank"))
        .alias("r")
        .join(
            F.broadcast(slots).alias("s"),
            (F.col("r.step") == F.col("s.step")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")),
            "left",
        )
        .select(
            *("row", "doc_id", "part", "r.step", "doc_tokens", "rest", "rest_crc"),
            (F.col("way_sequence") + F.col("rank") - F.col("first")).alias("in_way"),
        ),
        "packing-rests",
    )
    ends = Window.partitionBy("in_way").orderBy(F.desc("rest"), "row")
    solved = placed.where("in_way is not null").select(
        "row",
        "doc_id",
        (F.col("doc_tokens") - F.col("rest")).alias("start"),
        F.col("rest").alias("length"),
        "doc_tokens",
        (F.lit(windows) + F.col("in_way")).alias("sequence_id"),
        (F.sum("rest").over(ends.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rest")).alias("offset"),
        F.col("rest_crc").alias("crc"),
    )

    left = placed.where("in_way is null").withColumn("part", F.floor(F.col("part") / TASKS_A_GROUP))
    along = Window.partitionBy("part").orderBy(F.desc("step"), "row").rowsBetween(Window.unboundedPreceding, 0)
    groups = _before(
        left.groupBy("part").agg(F.ceil(F.sum("rest") / window).alias("windows")), [], "windows", "base"
    ).select("part", "base")
    spread = left.withColumn("end", F.sum("rest").over(along)).withColumn("begin", F.col("end") - F.col("rest"))
    greedy = (
        spread.join(groups, "part")
        .withColumn(
            "k", F.explode(F.sequence(F.floor(F.col("begin") / window), F.floor((F.col("end") - 1) / window)))
        )
        .withColumn("from", F.greatest("begin", F.col("k") * window))
        .withColumn("length", F.least("end", (F.col("k") + 1) * window) - F.col("from"))
        .select(
            "row",
            "doc_id",
            (F.col("doc_tokens") - F.col("rest") + F.col("from") - F.col("begin")).alias("start"),
            "length",
            "doc_tokens",
            (F.lit(windows + sequences) + F.col("base") + F.col("k")).alias("sequence_id"),
            (F.col("from") - F.col("k") * window).alias("offset"),
            F.when(F.col("length") == F.col("rest"), F.col("rest_crc")).alias("crc"),
        )
    )
    return full.unionByName(solved).unionByName(greedy)


def _piece_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n != "ids"]
        sums = [
            zlib.crc32(ids.as_buffer()[4 * a : 4 * (a + n)])
            for ids, a, n in zip(batch.column("ids"), batch.column("start").to_pylist(), batch.column("length").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(sums, pa.int64())], names=[*names, "crc"])


def with_checksums(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """Checksums of all pieces; only rests that were cut go back to the ids."""
    pieces = stored(pieces, "packing-pieces")
    cut = stored(pieces.where("crc is null").drop("crc"), "packing-cut")
    joined = cut.join(tokens.select("row", "ids"), "row")
    schema = T.StructType([*cut.schema.fields, T.StructField("crc", T.LongType())])
    summed = joined.select(*cut.columns, "ids").mapInArrow(_piece_sums, schema)
    return pieces.where("crc is not null").unionByName(summed)


def sequences(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """The packed id sequences: sequence_id, ids (little-endian unsigned 32-bit)."""
    joined = pieces.join(tokens.select("row", "ids"), "row")
    cut = F.substring("ids", F.col("start") * 4 + 1, F.col("length") * 4)
    parts = F.array_sort(F.collect_list(F.struct("offset", cut.alias("ids"))))
    return joined.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids")
    )


def packed(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    tokens = token_table(docs, tokenizer, end_id)
    return with_checksums(pack(tokens), tokens).select(
        "doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
