"""Mini-batch training of all candidates of a benchmark in one barrier job.

The tasks of a barrier stage run together. Each keeps its rows as arrays and takes the mini-batches of an epoch
over them; so all candidates, cutoffs and epochs read the table once and a step costs no Spark job. Up to
``ROWS_A_TASK`` rows one task holds all, and the steps are those of a plain loop over seeded batches. Beyond, the tasks
average their parameters and moments, weighted by rows, after each epoch (iterative parameter mixing): Spark's
``allGather`` takes about a second, too long for each step. A vector is parameter-sized, and tasks are
at most ``MOST_TASKS``, as each of them receives every vector.

The order of rows is seeded: in each epoch a row's hash, mixed with seed and epoch, places it in one of
n / ``BATCH`` batches. Tasks hold rows by the same hash and their number follows the number of rows, so the result does
not depend on how the table is partitioned. A lost executor fails the stage as a whole and Spark runs it again.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splits import only
from . import fitting

BATCH = 4_096
ROWS_A_TASK = 1_000_000
MOST_TASKS = 64
MODEL_SCHEMA = "candidate int, theta binary, selected_epoch int, history string"


@dataclass(frozen=True)
class Candidate:
    """One network: chosen by validation inside the training rows, and refitted on all of them if ``refit``."""

    cutoff: int
    kind: str
    seed: int
    refit: bool = False


@dataclass(frozen=True)
class _Run:
    """Training of one candidate: its rows are marked by ``use``, its scale belongs to them."""

    candidate: int
    use: str
    mean: np.ndarray
    scale: np.ndarray
    epochs: int


def batch_of(keys: np.ndarray, seed: int, epoch: int, batches: int) -> np.ndarray:
    """Batch of every row in an epoch, from its 64-bit key."""
    h = keys.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + epoch) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(batches)).astype(np.int64)


class _Trainer:
    """State of one training in every task: all tasks hold the same parameters after each epoch."""

    def __init__(self, run: _Run, spec: Candidate, rows: dict[str, np.ndarray], rate: float, batch: int):
        self.run, self.spec = run, spec
        use = rows[run.use]
        self.keys, self.target = rows["key"][use], rows["target"][use]
        self.x, self.logs = (rows["x"][use] - run.mean) / run.scale, np.log1p(self.target)
        held = rows["val"]
        self.val_x, self.val_target = (rows["x"][held] - run.mean) / run.scale, rows["target"][held]
        self.batches = max(1, -(-len(self.keys) // batch))
        self.theta, self.adam = fitting.initial_parameters(spec.kind, spec.seed), fitting.Adam(rate)
        self.size = len(self.theta)
        self.best, self.best_error, self.selected, self.history = self.theta, np.inf, run.epochs, []

    def one_epoch(self, epoch: int) -> None:
        """All mini-batches over the rows of this task."""
        place = batch_of(self.keys, self.spec.seed, epoch, self.batches)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(self.batches + 1))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[lo:hi]
            if len(own):
                loss, slope = fitting.loss_and_gradient(self.theta, self.x[own], self.logs[own], self.spec.kind)
                if not np.isfinite(loss):
                    raise ValueError("training loss is not finite")
                self.theta = self.adam.step(self.theta, slope / len(own))

    def state(self) -> np.ndarray:
        """Parameters and moments, weighted by rows, for the mean over the tasks."""
        zero = np.zeros(self.size)
        return len(self.keys) * np.concatenate([self.theta, self.adam.first + zero, self.adam.second + zero, [1.0]])

    def mix(self, total: np.ndarray) -> None:
        mean = total[:-1] / total[-1]
        self.theta, self.adam.first, self.adam.second = (x.copy() for x in np.split(mean, 3))

    def error(self) -> np.ndarray:
        if not len(self.val_target):
            return np.zeros(2)
        logs, _ = fitting.forward(self.theta, self.val_x, self.spec.kind)
        median = 0 if self.spec.kind == "count" else 1
        return np.array([np.abs(fitting.counts_from_logs(logs[:, median]) - self.val_target).sum(), len(self.val_target)])

    def judge(self, epoch: int, total: np.ndarray) -> None:
        error = total[0] / total[1] if total[1] else None
        self.history.append({"epoch": epoch, "validation_mae": error})
        if error is not None and error < self.best_error:
            self.best, self.best_error, self.selected = self.theta, error, epoch

    def chosen(self) -> np.ndarray:
        return self.best if np.isfinite(self.best_error) else self.theta


def train_together(trainers: list[_Trainer], exchange) -> None:
    """All epochs of several trainings; ``exchange`` gives the sum of a vector over all tasks, None if there is one task."""
    for epoch in range(max((t.run.epochs for t in trainers), default=0)):
        active = [t for t in trainers if epoch < t.run.epochs]
        for t in active:
            t.one_epoch(epoch)
        if exchange is not None:
            ends = np.cumsum([3 * t.size + 1 for t in active])[:-1]
            total = exchange(np.concatenate([t.state() for t in active]))
            for t, part in zip(active, np.split(total, ends), strict=True):
                t.mix(part)
        errors = np.concatenate([t.error() for t in active])
        errors = (errors if exchange is None else exchange(errors)).reshape(-1, 2)
        for t, error in zip(active, errors, strict=True):
            t.judge(epoch + 1, error)


def _loaded(frames: Iterator[pd.DataFrame]) -> dict[int, dict[str, np.ndarray]]:
    """Arrays of this task's rows by cutoff."""
    parts: dict[int, list[pd.DataFrame]] = {}
    for frame in frames:
        for cutoff, own in frame.groupby("cutoff_seconds"):
            parts.setdefault(int(cutoff), []).append(own)
    out = {}
    for cutoff, frames_of in parts.items():
        # A fixed order inside a task, so a repeated run sums alike.
        own = pd.concat(frames_of, ignore_index=True).sort_values("key")
        part = own["part"].to_numpy()
        out[cutoff] = {
            "key": own["key"].to_numpy(np.int64).view(np.uint64),
            "x": np.stack(own["x"].to_numpy()).astype(float),
            "target": own["target"].to_numpy(float),
            "fit": part == "fit",
            "val": part == "validation",
            "all": np.ones(len(own), bool),
        }
    return out


_NONE = {"key": np.zeros(0, np.uint64), "x": np.zeros((0, 5)), "target": np.zeros(0)} | {n: np.zeros(0, bool) for n in ("fit", "val", "all")}


def _task(candidates: list[Candidate], scales: dict, epochs: int, rate: float, batch: int):
    def run(frames):
        context = BarrierTaskContext.get()
        rows = _loaded(frames)
        alone = len(context.getTaskInfos()) == 1

        def gathered(vector: np.ndarray) -> np.ndarray:
            sent = context.allGather(base64.b64encode(vector.tobytes()).decode())
            return np.sum([np.frombuffer(base64.b64decode(s)) for s in sent], axis=0)

        def trainer(k: int, use: str, upto: int) -> _Trainer:
            spec = candidates[k]
            own = _Run(k, use, *scales[spec.cutoff, use], upto)
            return _Trainer(own, spec, rows.get(spec.cutoff, _NONE), rate, batch)

        exchange = None if alone else gathered
        first = [trainer(k, "fit", epochs) for k in range(len(candidates))]
        train_together(first, exchange)
        again = {k: trainer(k, "all", first[k].selected) for k, c in enumerate(candidates) if c.refit}
        train_together(list(again.values()), exchange)
        out = []
        if context.partitionId() == 0:
            for k, t in enumerate(first):
                theta = again[k].theta if k in again else t.chosen()
                out.append((k, theta.tobytes(), t.selected, json.dumps(t.history)))
        yield pd.DataFrame(out, columns=["candidate", "theta", "selected_epoch", "history"])

    return run


def fit_candidates(
    feature_rows: DataFrame,
    candidates: list[Candidate],
    epochs: int = 15,
    batch: int = BATCH,
    rate: float = 0.01,
    tasks: int | None = None,
) -> list[fitting.NetworkModel]:
    """Models of all candidates, in their order, from one job over the outer training rows.

    A candidate's epoch is that of the smallest raw-count error on its validation rows. Barrier stages need all
    their tasks at once: ``tasks`` may not be above the free slots, and dynamic allocation has to be off.
    """
    cutoffs = sorted({c.cutoff for c in candidates})
    parts = [fitting.training_rows(feature_rows, c).withColumn("cutoff_seconds", F.lit(c)) for c in cutoffs]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.select("cutoff_seconds", F.xxhash64("cascade_id").alias("key"), "x", "target", "part")
    fit = F.col("part") == "fit"
    only(rows, ~(fit & (F.col("part") == "validation")), "a row is in both the fit and the validation part")
    moments = [
        agg(F.when(use, F.col("x")[i])).alias(f"{name}_{kind}_{i}")
        for name, use in (("fit", fit), ("all", F.lit(True)))
        for kind, agg in (("mean", F.avg), ("scale", F.stddev_pop))
        for i in range(5)
    ]
    counted = rows.groupBy("cutoff_seconds").agg(F.count_if(fit).alias("fit"), F.count(F.lit(1)).alias("all"), *moments).collect()
    scales, totals = {}, {}
    for row in counted:
        for use in ("fit", "all"):
            mean, scale = (np.array([row[f"{use}_{kind}_{i}"] for i in range(5)], dtype=float) for kind in ("mean", "scale"))
            scales[row.cutoff_seconds, use] = mean, np.where(scale == 0, 1.0, scale)
            totals[row.cutoff_seconds, use] = row[use]
    for c in cutoffs:
        if not totals.get((c, "fit")):
            raise ValueError("a fit needs at least one row")
    most = min(rows.sparkSession.sparkContext.defaultParallelism, MOST_TASKS)
    tasks = tasks or min(most, max(1, -(-sum(r["all"] for r in counted) // ROWS_A_TASK)))
    run = _task(list(candidates), scales, epochs, rate, batch)
    found = {r.candidate: r for r in rows.repartition(tasks, "key").mapInPandas(run, MODEL_SCHEMA, barrier=True).collect()}
    models = []
    for k, c in enumerate(candidates):
        use = "all" if c.refit else "fit"
        row = found[k]
        theta = np.frombuffer(row.theta).copy()
        models.append(fitting.NetworkModel(c.kind, theta, *scales[c.cutoff, use], row.selected_epoch, json.loads(row.history)))
    return models
