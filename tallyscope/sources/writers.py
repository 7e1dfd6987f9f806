"""Create-only sinks: an existing result is never overwritten, and inputs are never outputs."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def guard_paths(output: str, inputs: Sequence[str]) -> None:
    def plain(path: str) -> str:
        return path.removeprefix("file:").replace("//", "/").rstrip("/")

    for source in inputs:
        if plain(output) == plain(source) or plain(output).startswith(plain(source) + "/"):
            raise ValueError("output must not overwrite an input")


def write_new(
    df: DataFrame, output: str, inputs: Sequence[str] = (), partition_by: Sequence[str] = (), format: str = "parquet"
) -> None:
    """Write a table to a location that does not exist yet."""
    guard_paths(output, inputs)
    writer = df.write.mode("errorifexists").format(format)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(output)


def export_predictions(rows: DataFrame, output: str, inputs: Sequence[str] = ()) -> None:
    """Row-level predictions in long form, partitioned by cutoff and model.

    Both partition columns have a handful of values, so rows are left where they are; the writer
    sorts by partition inside each task instead of sending a whole model to one task.
    """
    write_new(rows, output, inputs, ["cutoff_seconds", "model"])


def write_reports(reports: dict[str, DataFrame], output: str, inputs: Sequence[str] = ()) -> None:
    for name, df in reports.items():
        write_new(df, f"{output.rstrip('/')}/{name}", inputs)


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """Create one object with its whole content, or raise FileExistsError; of several callers one succeeds.

    The text is written beside the target and then given its name: by a hard link on a local or mounted file
    system, elsewhere by Hadoop's rename without overwriting, which is atomic where the store's rename is.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    target = system.makeQualified(target)
    if target.toUri().getScheme() == "file":
        name = Path(target.toUri().getPath())
        name.parent.mkdir(parents=True, exist_ok=True)
        draft = name.with_name(f".{name.name}.{uuid.uuid4().hex}")
        draft.write_text(text, encoding="utf-8")
        try:
            os.link(draft, name)
        finally:
            draft.unlink()
        return
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    names = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(names, 1)
    options[0] = getattr(names, "NONE")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, options)
    except Exception as problem:
        system.delete(draft, False)
        raise FileExistsError(path) from problem
