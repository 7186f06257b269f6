"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Runtime settings every job relies on; all may be set on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A task reads so much; ids made from numbers take many times their bytes in memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
}
# Shuffles are dealt over one partition per so many bytes of input; small ones are merged again.
SHARE_BYTES = 4 << 20


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder, or of one file, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def fit_to_input(spark: SparkSession, folder: str) -> None:
    """As many shuffle partitions as the input asks for, so that a task's share does not grow with it."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(usual, -(-folder_bytes(spark, folder) // SHARE_BYTES))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))


def local_session(cores: str = "8", app: str = "lumenads") -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Executors on every machine must see it, so a session with other machines has
    to name one. A local session that names none, as in a test, gets a folder of
    its own that goes when its process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = _own_folder()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="lumenads-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
