"""Input tables and intermediate tables of the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenads.session import shared_dir

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()

# Fixed value: what separates words; the six ASCII white-space characters.
SPACE_CLASS = r"\x20\x09-\x0D"


# Rows and bytes that go to Python at once, where the session does not say; long texts make
# large batches otherwise, and each task holds some of them.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": (None, "8m"),
}


def prepared(spark: SparkSession) -> None:
    """Batch sizes for texts, and this package where tasks do not have it."""
    for key, (usual, wanted) in BATCHES.items():
        if spark.conf.get(key, None) in (usual, None):
            spark.conf.set(key, wanted)
    shipped(spark)


def shipped(spark: SparkSession) -> None:
    """In a local session, send this package to the tasks' Python, once per application, unless
    the path that they start with has it anyway. On a cluster it has to be installed."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(ROOT) in paths or not spark.sparkContext.master.startswith("local["):
        return
    archive = Path(tempfile.mkdtemp(prefix="lumenads-code-")) / "lumenads.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((ROOT / "lumenads").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str, compression: str = "zstd", **options: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: a cut in the lineage
    that outlives lost executors and is computed once."""
    prepared(df.sparkSession)
    path = shared_dir(df.sparkSession, label)
    df.write.options(compression=compression, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column, divisor: int):
    """crc32 of the id as text, modulo ``divisor``: splits rows for learning and testing."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor
