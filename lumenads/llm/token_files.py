"""Token-ID files: Parquet list columns in document order.

``write_tokens`` encodes whole texts and writes one row per document with its
ids as a list of ints. The list is dictionary encoded (``encoding="dictionary"``)
or delta encoded (``"delta"``), row groups and pages have a stated size, and the
writer adds page indexes, so ``read_tokens`` can skip row groups and pages by
``doc_id`` and leave the ids unread where only metadata is asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenads.llm.tables import table
from lumenads.llm.tokens import encoder
from lumenads.session import shared_dir

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
ROWS_A_PAGE = 500
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_1_0"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}
SCHEMA = "doc_id long, part int, part_start long, n_tokens int, ids array<int>"


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, part, start = encoder(tokenizer).ids, TaskContext.get().partitionId(), 0
    end = int(end_id).to_bytes(4, "little")
    for batch in batches:
        texts = batch.column("text")
        rows = [encode(x.as_py()) + end for x in texts]
        counts = np.fromiter((len(x) // 4 for x in rows), np.int32, len(rows))
        ends = np.cumsum(counts, dtype=np.int64)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join(rows), "<i4"))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.full(len(rows), part, np.int32)),
                pa.array(start + ends - counts),
                pa.array(counts),
                pa.ListArray.from_arrays(pa.array(offsets), flat),
            ],
            names=["doc_id", "part", "part_start", "n_tokens", "ids"],
        )
        start += int(ends[-1]) if len(rows) else 0


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    rows_a_page: int = ROWS_A_PAGE,
) -> None:
    """Encode ``docs`` (doc_id, text, any other columns) and write the files.

    Rows are range-partitioned and sorted by ``doc_id`` (nulls first, equal ids
    by text), so file order is document order; one task writes one file. A null
    text counts as empty; every document ends in ``end_id``. Other columns,
    whatever their names, are left out. An empty table gives files without rows.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    tokens = ordered.mapInArrow(lambda batches: _encoded(batches, tokenizer, end_id), SCHEMA)
    options = ENCODINGS[encoding] | {
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(rows_a_page),
        "compression": "zstd",
        "maxRecordsPerFile": "0",
    }
    tokens.write.options(**options).parquet(path)


def read_tokens(
    spark: SparkSession,
    path: str,
    columns: Iterable[str] = ("doc_id", "n_tokens", "ids"),
    first_doc: int | None = None,
    last_doc: int | None = None,
) -> DataFrame:
    """Chosen columns of the documents ``first_doc`` to ``last_doc`` (both included).

    Both bounds reach the scan, where row-group statistics and page indexes
    skip what lies outside; without ``ids`` only metadata pages are read.
    """
    df = spark.read.schema(SCHEMA).parquet(path)
    if first_doc is not None:
        df = df.where(F.col("doc_id") >= first_doc)
    if last_doc is not None:
        df = df.where(F.col("doc_id") <= last_doc)
    return df.select(*columns)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each file; one row per file, from metadata columns only."""
    totals = read_tokens(spark, path, ("part", "n_tokens")).groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy().astype("<u4", copy=False)
        sums = [zlib.crc32(flat[a:b].data) for a, b in zip(offsets[:-1], offsets[1:])]
        counts = np.diff(offsets).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "part", "part_start")), pa.array(counts), pa.array(sums, pa.int64())],
            names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
        )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ids before it, number of ids, crc32 of the ids."""
    read = read_tokens(spark, path, ("doc_id", "part", "part_start", "ids"))
    sums = read.mapInArrow(
        _summed, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"
    )
    return sums.join(part_starts(spark, path), "part").select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", end_id=1)
    return token_digests(spark, path)
