"""Session helpers of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import BATCH_BYTES, cut_lineage, ensure_checkpoint_dir, small_batches

__all__ = ["BATCH_BYTES", "cut_lineage", "shared_folder", "small_batches"]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; whatever else the caller's table holds can't clash."""
    return df.select(*names)
