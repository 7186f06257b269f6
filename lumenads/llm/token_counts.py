"""Token counts kept up to date by signed deltas.

A ledger holds three kinds of Parquet folders below one path: per batch the
signed changes of documents, per batch their sums by source, language and
tokenizer version, and a commit mark. Totals add up the sums of marked batches,
so no document is counted again. A batch is written under its own number and
marked last: a batch that broke off is overwritten when it runs again, one that
is marked is left alone when it comes again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenads.llm.tables import stored, table
from lumenads.llm.tokens import counter
from lumenads.session import shared_dir

KEYS = ("source", "lang", "tokenizer_version")
CHANGE = "doc_id long, tokenizer_version string, source string, lang string, tokens long, action string, step long"
SIGNED = "doc_id long, tokenizer_version string, source string, lang string, tokens long, documents long, step long"
SUMS = "source string, lang string, tokenizer_version string, documents long, tokens long"
ACTIONS = ("insert", "revise", "delete")


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        # batch -1 marks that the ledger exists
        self._write(spark.createDataFrame([], SIGNED), "changes", -1)
        self._write(spark.createDataFrame([], SUMS), "sums", -1)
        self._mark(-1)

    def _write(self, df: DataFrame, kind: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")

    def _mark(self, batch: int) -> None:
        self._write(self.spark.range(1), "commits", batch)

    def _read(self, kind: str, schema: str) -> DataFrame:
        """Rows of marked batches only; one mark per batch is all the driver sees."""
        df = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{kind}")
        return df.where(F.col("batch").isin(self.batches()))

    def batches(self) -> list[int]:
        marks = self.spark.read.schema("id long, batch long").parquet(f"{self.path}/commits")
        return sorted(r.batch for r in marks.select("batch").distinct().collect())

    def live(self) -> DataFrame:
        """The count that holds for each document and version now, with its keys."""
        last = F.max_by(F.struct("source", "lang", "tokens", "documents"), F.struct("batch", "step", "documents"))
        state = self._read("changes", SIGNED).groupBy("doc_id", "tokenizer_version").agg(last.alias("s"))
        return state.where("s.documents > 0").select("doc_id", "tokenizer_version", "s.source", "s.lang", "s.tokens")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` (``CHANGE``): inserts, revised counts and deletes of documents.

        Of several changes of a document and version the one with the largest step
        counts (then the later action and larger count). A new count takes back the one
        before, under the keys it had; an insert of a known document is a revision, a
        revision of an unknown one an insert, a delete of an unknown one nothing, and so
        is a row without doc_id or version or with another action. A null count is 0,
        null sources and languages are groups of their own. False if ``batch`` was
        committed before: nothing is written then.
        """
        if batch in self.batches():
            return False
        columns = [f.split()[0] for f in CHANGE.split(", ")]
        changes = changes.select(*columns).fillna(0, ["step"]).where(
            F.col("doc_id").isNotNull() & F.col("tokenizer_version").isNotNull() & F.col("action").isin(*ACTIONS)
        )
        rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
        latest = (
            changes.groupBy("doc_id", "tokenizer_version")
            .agg(
                F.max_by(
                    F.struct("source", "lang", F.coalesce("tokens", F.lit(0)).alias("tokens"), "action", "step"),
                    F.struct("step", rank, "tokens"),
                ).alias("new")
            )
        )
        old = self.live().select(
            F.col("doc_id"), F.col("tokenizer_version"), F.struct("source", "lang", "tokens").alias("old")
        )
        both = latest.join(old, ["doc_id", "tokenizer_version"], "left")
        # taking back comes before the new count: equal step, fewer documents
        parts = F.array(
            F.when(F.col("old").isNotNull(), F.struct("old.*", F.lit(-1).alias("sign"))),
            F.when(
                F.col("new.action") != "delete",
                F.struct("new.source", "new.lang", "new.tokens", F.lit(1).alias("sign")),
            ),
        )
        signed = both.select(
            "doc_id", "tokenizer_version", "new.step", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("p")
        ).select(
            "doc_id",
            "tokenizer_version",
            "p.source",
            "p.lang",
            (F.col("p.tokens") * F.col("p.sign")).alias("tokens"),
            F.col("p.sign").cast("long").alias("documents"),
            "step",
        )
        self._write(signed, "changes", batch)
        written = self.spark.read.schema(SIGNED).parquet(f"{self.path}/changes/batch={batch}")
        sums = written.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        self._write(sums, "sums", batch)
        self._mark(batch)
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version; groups that came to
        nothing are left out."""
        sums = self._read("sums", SUMS).groupBy(*KEYS)
        return sums.agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where(
            "documents <> 0 or tokens <> 0"
        )


COUNTED = "doc_id long, source string, lang string, digest binary, tokens array<long>, once array<long>"


def _without_repeats(text: str) -> str:
    return "\n".join(dict.fromkeys(text.split("\n")))


def _counted(batches: Iterator[pa.RecordBatch], tokenizers: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    count = counter(tokenizers).counts
    for batch in batches:
        digests, tokens, once = [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            digests.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
            tokens.append(count(text))
            single = _without_repeats(text)
            once.append(None if len(single) == len(text) else count(single))
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_id", "source", "lang")),
                pa.array(digests, pa.binary()),
                pa.array(tokens, lists),
                pa.array(once, lists),
            ],
            names=["doc_id", "source", "lang", "digest", "tokens", "once"],
        )


def counted(docs: DataFrame, tokenizers: tuple[str, ...]) -> DataFrame:
    """Ids of each whole text by each tokenizer, and of the text without its repeated lines
    where there are any. Null texts count 0; other columns are not read."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text"))
    )
    return stored(texts.mapInArrow(lambda batches: _counted(batches, tokenizers), COUNTED), "token-counts")


def changes_of(counts: DataFrame, tokenizers: tuple[str, ...], action: str, column: str = "tokens") -> DataFrame:
    """One change per document and tokenizer."""
    names = F.array(*(F.lit(t.removesuffix(".json")) for t in tokenizers))
    pairs = F.explode(F.arrays_zip(names.alias("version"), F.col(column).alias("number"))).alias("c")
    return counts.select("doc_id", "source", "lang", pairs).select(
        "doc_id",
        F.col("c.version").alias("tokenizer_version"),
        "source",
        "lang",
        F.col("c.number").alias("tokens"),
        F.lit(action).alias("action"),
        F.lit(0).cast("long").alias("step"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: counts by the first tokenizer; by the second; copies
    of a text but the first withdrawn; texts with repeated lines counted without them.
    Every batch comes twice, as after a lost answer."""
    tokenizers = ("byte_bpe_50k.json", "word_bpe_49k.json")
    counts = counted(table(spark, sf_dir, "documents"), tokenizers)
    first = counts.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = counts.join(first.select(F.col("first").alias("doc_id")), "doc_id", "left_anti")
    version = F.col("tokenizer_version") == tokenizers[0].removesuffix(".json")
    inserts = changes_of(counts, tokenizers, "insert")
    repeats = counts.where("once is not null").join(copies.select("doc_id"), "doc_id", "left_anti")
    ledger = Ledger(spark, shared_dir(spark, "token-ledger"))
    for batch, changes in enumerate(
        (
            inserts.where(version),
            inserts.where(~version),
            changes_of(copies, tokenizers, "delete"),
            changes_of(repeats, tokenizers, "revise", "once"),
        )
    ):
        ledger.commit(batch, changes)
        ledger.commit(batch, changes)
    return ledger.totals()
