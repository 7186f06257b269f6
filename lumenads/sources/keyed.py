"""Tables that are updated in place by key.

Rows lie in buckets of the key's hash. An update rewrites the buckets that hold its
keys and no others, into new folders; then a manifest that names the folder of
every bucket takes effect by one rename. Readers see the table before or after
a batch, never half of it, and a batch that was committed does nothing when it runs again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenads.session import shared_dir
from lumenads.sources.buckets import CO_PARTITIONED, settings


@dataclass(frozen=True)
class KeyedTable:
    root: str
    schema: T.StructType
    key: str
    buckets: int = 64

    # A manifest is a few numbers per bucket, whatever the table's size.
    def manifest(self, spark: SparkSession) -> tuple[int, dict[int, int]]:
        """Number of the last committed batch, and the batch that wrote each bucket."""
        fs, folder = self._fs(spark, f"{self.root}/manifests")
        if not fs.exists(folder):
            return 0, {}
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        done = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not done:
            return 0, {}
        text = spark.read.text(f"{self.root}/manifests/{done[-1]}").first()[0]
        return int(done[-1].split(".")[0]), {int(k): v for k, v in json.loads(text).items()}

    def _fs(self, spark: SparkSession, path: str):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(conf), place

    def _commit(self, spark: SparkSession, batch: int, buckets: dict[int, int]) -> None:
        name = f"{self.root}/manifests/{batch:012d}.json"
        fs, final = self._fs(spark, name)
        _, draft = self._fs(spark, f"{self.root}/manifests/.{batch:012d}.draft")
        fs.mkdirs(final.getParent())
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(buckets).encode()))
        out.close()
        if not fs.rename(draft, final):
            raise RuntimeError(f"batch {batch} of {self.root} was committed by another writer")

    def _bucket(self):
        return F.pmod(F.hash(self.key), F.lit(self.buckets))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows, at most one per key, with their bucket and a share of it, dealt by both."""
        conf = rows.sparkSession.conf
        tasks = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions")
        shares = F.lit(-(-int(tasks) // self.buckets))
        placed = rows.withColumns({"bucket": self._bucket(), "_share": F.pmod(F.xxhash64(self.key), shares)})
        return placed.repartition("bucket", "_share")

    def _folder(self, bucket: int, batch: int) -> str:
        return f"{self.root}/data/batch={batch}/bucket={bucket}"

    def _rows(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*folders)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, [self._folder(b, n) for b, n in sorted(self.manifest(spark)[1].items())])

    def lookup(self, spark: SparkSession, value) -> DataFrame:
        """Rows of one key, from its bucket alone."""
        kind = self.schema[self.key].dataType
        wanted = F.lit(value).cast(kind)
        bucket = spark.range(1).select(F.pmod(F.hash(wanted), F.lit(self.buckets))).first()[0]
        written = self.manifest(spark)[1].get(bucket)
        folders = [] if written is None else [self._folder(bucket, written)]
        return self._rows(spark, folders).where(F.col(self.key) == wanted)

    def update(self, changes: DataFrame, batch: int, newest: tuple[str, ...] = (), insert: bool = True) -> list[int]:
        """Apply ``changes``, which have the key and any of the other columns; returns the buckets
        that were rewritten, none if the batch was committed before.

        Of several changes of a key, and of a change and the stored row, the one with the greatest
        ``newest`` columns counts (among equals the change); columns that changes lack stay.
        A key that is not stored becomes a row if ``insert``. Changes without a key are
        left out."""
        spark = changes.sparkSession
        last, written = self.manifest(spark)
        if batch <= last:
            return []
        given = [c for c in changes.columns if c != self.key]
        order = [F.col(c) for c in newest] + [F.col(c) for c in sorted(given) if c not in newest]
        one = (
            changes.where(F.col(self.key).isNotNull())
            .groupBy(self.key)
            .agg(F.max_by(F.struct(*given), F.struct(*order)).alias("_new"))
            .withColumn("_bucket", self._bucket())
        )
        path = shared_dir(spark, "keyed-changes")
        one.write.parquet(path)
        one = spark.read.schema(one.schema).parquet(path)
        touched = sorted(r[0] for r in one.select("_bucket").distinct().collect())  # at most one per bucket
        if not insert:
            touched = [b for b in touched if b in written]
        before = [self._folder(b, written[b]) for b in touched if b in written]
        # Both sides are dealt by bucket and a share of its keys, which is how rows are written too:
        # a whole row is shuffled once.
        one = self._dealt(one.drop("_bucket"))
        if before:
            how = "full_outer" if insert else "left"
            joined = self._dealt(self._rows(spark, before)).join(one, ["bucket", "_share", self.key], how)
        else:  # all keys are new: nothing to join
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != self.key]
            joined = one.select("bucket", self.key, *nothing, "_new")
        # a stored row that is newer than the change keeps its values
        stays = F.lit(False)
        if newest:
            stored = F.struct(*(F.col(c) for c in newest))
            stays = F.coalesce(F.struct(*(F.col(f"_new.{c}") for c in newest)) < stored, F.lit(False))
        taken = F.col("_new").isNotNull() & ~stays
        values = [
            F.when(taken, F.col(f"_new.{f.name}")).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name)
            if f.name in given
            else F.col(f.name)
            for f in self.schema
        ]
        if touched:
            with settings(spark, CO_PARTITIONED):
                joined.select(*values, "bucket").write.mode("overwrite").partitionBy("bucket").option(
                    "partitionOverwriteMode", "static"
                ).parquet(f"{self.root}/data/batch={batch}")
        self._commit(spark, batch, {**written, **dict.fromkeys(touched, batch)})
        return touched
