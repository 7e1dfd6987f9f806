"""Session settings the library relies on, and the few decisions that need the session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of rows that travel to Python at once.
BATCH_BYTES = 4 << 20
_BATCHES, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def build_session(master: str = "local[*]", app: str = "tallyscope", **conf: str) -> SparkSession:
    """A session with the settings used in tests and in the benchmark."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Instants are rendered and parsed in UTC; a session in another zone is switched."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a scratch folder will do on a local master alone."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder, so a lost executor loses no result."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Batches of texts are bounded by bytes, as Spark's 10,000 rows hold tens of MB on either side of the pipe.

    A session with a bound of its own, other than Spark's, keeps it.
    """
    if spark.conf.get(_BATCHES) == _SPARKS_OWN:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give costly per-row work as many tasks as there are cores when the input has few files.

    A large input already has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    context = spark.sparkContext
    if getattr(context, "_tallyscope_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tallyscope-")
    context.addPyFile(shutil.make_archive(os.path.join(folder, "tallyscope"), "zip", root, "tallyscope"))
    context._tallyscope_shipped = True
