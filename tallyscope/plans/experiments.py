"""Frozen experiment plans: code, inputs, configuration and audits are fixed before any fit, used once.

Every state of a plan is one object that is created whole or not at all (``writers.create_once``): of several
that start a plan at the same time, one does.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import create_once

PACKAGE = Path(__file__).resolve().parents[1]
PARTS = ("code", "config", "inputs", "audit")


def digest(value: object) -> str:
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


def table_digest(df: DataFrame) -> str:
    """Order-independent digest of a table: the row count and the sum of the rows' SHA-256 values.

    A value is summed in eight parts of 32 bits, so repeated rows count and don't cancel out; columns are taken by name.
    """
    columns = sorted(df.columns)
    value = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(value, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)") for k in range(8)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"h{k}") for k, p in enumerate(parts)]).first()
    types = [df.schema[c].dataType.simpleString() for c in columns]
    return digest([columns, types, int(row["n"]), [str(row[f"h{k}"]) for k in range(8)]])


def code_digest(sources: Iterable[str | Path] = (PACKAGE,)) -> str:
    """Digest of names and contents of the Python files named, or below the folders named."""
    found = []
    for source in map(Path, sources):
        files = sorted(source.rglob("*.py")) if source.is_dir() else [source]
        found += [(f.relative_to(source.parent).as_posix(), hashlib.sha256(f.read_bytes()).hexdigest()) for f in files]
    return digest(found)


class ExperimentPlan:
    """A plan directory with one create-once object per state: plan, started, models, tested.

    ``sources`` are the files and folders whose code the plan freezes, this package by default.
    """

    def __init__(self, spark: SparkSession, directory: str, sources: Iterable[str | Path] = (PACKAGE,)) -> None:
        self.spark = spark
        self.directory = directory.rstrip("/")
        self.sources = tuple(sources)

    def _write(self, state: str, record: dict) -> None:
        create_once(self.spark, f"{self.directory}/{state}.json", json.dumps(record, sort_keys=True))

    def _record(self, config: dict, inputs: dict[str, DataFrame], audit: dict) -> dict:
        tables = {name: table_digest(df) for name, df in inputs.items()}
        return {"code": code_digest(self.sources), "config": config, "inputs": tables, "audit": audit}

    def read(self, state: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.directory}/{state}.json", wholetext=True).first()[0])

    def freeze(self, config: dict, inputs: dict[str, DataFrame], audit: dict) -> dict:
        record = self._record(config, inputs, audit)
        self._write("plan", record)
        return record

    def start(self, config: dict, inputs: dict[str, DataFrame], audit: dict) -> None:
        """Consume the plan once; anything that changed since it was frozen is refused."""
        plan, now = self.read("plan"), self._record(config, inputs, audit)
        for part in PARTS:
            if digest(plan[part]) != digest(now[part]):
                raise ValueError(f"{part} changed since the plan was frozen")
        self._write("started", {"plan": digest(plan)})

    def freeze_models(self, models: dict) -> None:
        self._write("models", {"models": digest(models)})

    def open_test(self, models: dict) -> None:
        """The single test pass: only after the models were frozen, and only once."""
        if self.read("models")["models"] != digest(models):
            raise ValueError("models changed after they were frozen")
        self._write("tested", {"models": digest(models)})
