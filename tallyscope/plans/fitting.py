"""Model fitting as Spark jobs: partition-wise gradient sums, one small update on the driver.

Only parameter-sized vectors cross the driver. Each pass computes gradients inside the tasks with
numpy, reduces them by parameter index in a shuffle, and collects one number per parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import saturation_prediction
from ..functions.text import BUCKETS, hashed_sums, lengths, ranks
from ..operators.cascades import feature_vector
from ..operators.exposure import SERIES, add_errors
from ..functions.numeric import horizon_bucket
from ..operators.metrics import TEMPERATURES
from ..operators.splits import inner_split, only
from ..session import cut_lineage, small_batches

# Fixed values of the fitting recipe.
SEED = 20261008
LOG_CAP = 20.0
WIDTHS = (5, 16, 8)
QUANTILES = (0.1, 0.5, 0.9)
OUTPUTS = {"count": 1, "quantile": 3}
CURVE_EPOCHS = 400
CURVE_MIN_POINTS = 6
CURVE_MIN_SPAN = 900.0
TAU_FLOOR_HOURS = 1 / 3600


@dataclass
class Adam:
    """Adam with the usual moments; state has the shape of the parameters."""

    rate: float
    step_count: int = 0
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0

    def step(self, params: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.step_count += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient * gradient
        mean = self.first / (1 - 0.9**self.step_count)
        spread = self.second / (1 - 0.999**self.step_count)
        return params - self.rate * mean / (np.sqrt(spread) + 1e-8)


def reduce_vector(
    rows: DataFrame, columns: list[str], part: Callable[[pd.DataFrame], np.ndarray], size: int
) -> np.ndarray:
    """Sum of ``part`` over all batches of all partitions, as a vector of ``size`` numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += part(batch)
        index = np.flatnonzero(total)
        yield pd.DataFrame({"i": index.astype(np.int64), "v": total[index]})

    sums = rows.select(*columns).mapInPandas(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for i, v in sums.collect():  # at most ``size`` rows
        out[i] = v
    return out


# --- small network ----------------------------------------------------------------------------


def softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0) + np.log1p(np.exp(-np.abs(x)))


def logistic(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 1.0 / (1.0 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1.0 + np.exp(-np.abs(x))))


def layer_shapes(kind: str) -> list[tuple[int, int]]:
    sizes = [*WIDTHS, OUTPUTS[kind]]
    return [(sizes[i + 1], sizes[i]) for i in range(3)]


def unpack(theta: np.ndarray, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for out, inner in layer_shapes(kind):
        weight = theta[at : at + out * inner].reshape(out, inner)
        at += out * inner
        layers.append((weight, theta[at : at + out]))
        at += out
    return layers


def parameter_count(kind: str) -> int:
    return sum(out * inner + out for out, inner in layer_shapes(kind))


def initial_parameters(kind: str, seed: int) -> np.ndarray:
    """Uniform in +-1/sqrt(inputs) per layer."""
    draw = np.random.default_rng(seed)
    parts = []
    for out, inner in layer_shapes(kind):
        bound = 1 / np.sqrt(inner)
        parts += [draw.uniform(-bound, bound, out * inner), draw.uniform(-bound, bound, out)]
    return np.concatenate(parts)


def forward(theta: np.ndarray, x: np.ndarray, kind: str) -> tuple[np.ndarray, tuple]:
    """Log-scale outputs and the intermediate values the gradient needs."""
    (w1, b1), (w2, b2), (w3, b3) = unpack(theta, kind)
    a1 = x @ w1.T + b1
    h1 = np.maximum(a1, 0.0)
    a2 = h1 @ w2.T + b2
    h2 = np.maximum(a2, 0.0)
    raw = h2 @ w3.T + b3
    if kind == "count":
        logs = softplus(raw)
    else:
        logs = np.cumsum(np.column_stack([np.maximum(raw[:, 0], 0.0), softplus(raw[:, 1]), softplus(raw[:, 2])]), axis=1)
    return logs, (a1, h1, a2, h2, raw)


def loss_and_gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, kind: str) -> tuple[float, np.ndarray]:
    """Summed loss and gradient over the batch (smooth L1 or mean pinball of log counts)."""
    logs, (a1, h1, a2, h2, raw) = forward(theta, x, kind)
    if kind == "count":
        d = logs[:, 0] - y
        loss = np.where(np.abs(d) < 1, 0.5 * d * d, np.abs(d) - 0.5).sum()
        g_raw = (np.clip(d, -1, 1) * logistic(raw[:, 0]))[:, None]
    else:
        tau = np.array(QUANTILES)
        r = y[:, None] - logs
        loss = np.maximum(tau * r, (tau - 1) * r).sum() / 3
        g = np.where(r > 0, -tau, 1 - tau) / 3
        tails = np.cumsum(g[:, ::-1], axis=1)[:, ::-1]
        g_raw = tails * np.column_stack([raw[:, 0] > 0, logistic(raw[:, 1]), logistic(raw[:, 2])])
    (_, _), (w2, _), (w3, _) = unpack(theta, kind)
    g2 = (g_raw @ w3) * (a2 > 0)
    g1 = (g2 @ w2) * (a1 > 0)
    return float(loss), np.concatenate(
        [(g1.T @ x).ravel(), g1.sum(0), (g2.T @ h1).ravel(), g2.sum(0), (g_raw.T @ h2).ravel(), g_raw.sum(0)]
    )


def counts_from_logs(logs: np.ndarray) -> np.ndarray:
    return np.expm1(np.minimum(logs, LOG_CAP))


@dataclass
class NetworkModel:
    kind: str
    theta: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    selected_epoch: int
    history: list[dict] = field(default_factory=list)

    def score_udf(self):
        """Vectorised scoring of the raw five-feature array."""
        kind, theta, mean, scale = self.kind, self.theta, self.mean, self.scale
        width = OUTPUTS[kind]

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def score(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=object)
            x = (np.stack(features.to_numpy()) - mean) / scale
            logs, _ = forward(theta, x, kind)
            return pd.Series(list(counts_from_logs(logs).reshape(-1, width)))

        return score

    def score_sql(self, features: Column) -> Column:
        """The same scores from built-in expressions only, without Python."""

        def dense(x: Column, weight: np.ndarray, bias: np.ndarray, relu: bool) -> Column:
            rows = F.array(
                *[
                    F.struct(F.array(*[F.lit(float(v)) for v in w]).alias("w"), F.lit(float(b)).alias("b"))
                    for w, b in zip(weight, bias)
                ]
            )

            def unit(row: Column) -> Column:
                total = F.aggregate(F.zip_with(row["w"], x, lambda a, v: a * v), F.lit(0.0), lambda s, v: s + v)
                value = total + row["b"]
                return F.greatest(value, F.lit(0.0)) if relu else value

            return F.transform(rows, unit)

        x = F.zip_with(
            F.zip_with(features, F.array(*[F.lit(float(v)) for v in self.mean]), lambda a, m: a - m),
            F.array(*[F.lit(float(v)) for v in self.scale]),
            lambda a, s: a / s,
        )
        layers = unpack(self.theta, self.kind)
        for i, (weight, bias) in enumerate(layers):
            x = dense(x, weight, bias, i < 2)

        def sp(v: Column) -> Column:
            return F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))

        def count(v: Column) -> Column:
            return F.expm1(F.least(v, F.lit(LOG_CAP)))

        if self.kind == "count":
            return F.transform(x, lambda v: count(sp(v)))
        first = F.greatest(x[0], F.lit(0.0))
        second = first + sp(x[1])
        return F.array(count(first), count(second), count(second + sp(x[2])))


def training_rows(feature_rows: DataFrame, cutoff: int) -> DataFrame:
    """Outer training rows of one cutoff: id, five features, target and inner part."""
    rows = feature_rows.filter(
        (F.col("cutoff_seconds") == cutoff) & (F.col("strict_label_available_split") == "train_candidate")
    )
    return rows.select(
        "cascade_id",
        "observed_retweet_count",
        feature_vector().alias("x"),
        F.col("future_retweets_to_24h").cast("double").alias("target"),
        inner_split(F.col("post_time_day")).alias("part"),
    )


def feature_scale(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the five features, zero deviation becoming one."""
    row = rows.agg(
        *[F.avg(F.col("x")[i]) for i in range(5)], *[F.stddev_pop(F.col("x")[i]) for i in range(5)]
    ).first()
    if row[0] is None:
        raise ValueError("a fit needs at least one row")
    scale = np.array(row[5:], dtype=float)
    return np.array(row[:5], dtype=float), np.where(scale == 0, 1.0, scale)


def fit_network(
    rows: DataFrame,
    kind: str,
    epochs: int = 15,
    seed: int = SEED,
    rate: float = 0.01,
    steps_per_epoch: int = 1,
    fit_part: Column | None = None,
    validation_part: Column | None = None,
) -> NetworkModel:
    """Fit on the fit rows; keep the epoch with the smallest raw-count error on the validation rows.

    With more steps per epoch each step sees one hash shard of the rows. The gradient of a step
    is an exact sum, so the result does not depend on how the rows are partitioned.
    """
    fit_part = F.col("part") == "fit" if fit_part is None else fit_part
    used = rows.withColumn("_fit", fit_part)
    used = used.withColumn("_val", validation_part if validation_part is not None else F.lit(False))
    only(used, ~(F.col("_fit") & F.col("_val")), "a row is in both the fit and the validation part")
    mean, scale = feature_scale(used.filter("_fit"))
    shard = F.pmod(F.xxhash64("cascade_id"), F.lit(steps_per_epoch)).cast("int")
    data = used.filter("_fit OR _val").select("x", "target", "_fit", "_val", shard.alias("_shard")).persist()
    size = parameter_count(kind)
    median = 0 if kind == "count" else 1
    theta, adam = initial_parameters(kind, seed), Adam(rate)

    def passes(current: np.ndarray, step: int) -> np.ndarray:
        """Gradient and loss over the shard's fit rows, absolute error over validation rows."""

        def part(batch: pd.DataFrame) -> np.ndarray:
            out = np.zeros(size + 4)
            x = (np.stack(batch["x"].to_numpy()) - mean) / scale
            target = batch["target"].to_numpy()
            fit = batch["_fit"].to_numpy() & (batch["_shard"].to_numpy() == step)
            if fit.any():
                loss, gradient = loss_and_gradient(current, x[fit], np.log1p(target[fit]), kind)
                out[:size] = gradient
                out[size] = loss
                out[size + 1] = fit.sum()
            held = batch["_val"].to_numpy()
            if step == 0 and held.any():
                logs, _ = forward(current, x[held], kind)
                out[size + 2] = np.abs(counts_from_logs(logs[:, median]) - target[held]).sum()
                out[size + 3] = held.sum()
            return out

        return reduce_vector(data, ["x", "target", "_fit", "_val", "_shard"], part, size + 4)

    best, best_error, selected, history = theta, np.inf, epochs, []
    try:
        for epoch in range(epochs + 1):
            for step in range(steps_per_epoch):
                sums = passes(theta, step)
                if step == 0 and epoch > 0:
                    # The pass that starts an epoch also scores the weights the last one ended with.
                    error = sums[size + 2] / sums[size + 3] if sums[size + 3] else None
                    history.append({"epoch": epoch, "validation_mae": error})
                    if error is not None and error < best_error:
                        best, best_error, selected = theta, error, epoch
                if epoch == epochs:
                    break
                if not np.isfinite(sums).all():
                    raise ValueError("training loss is not finite")
                if sums[size + 1]:
                    theta = adam.step(theta, sums[:size] / sums[size + 1])
    finally:
        data.unpersist()
    return NetworkModel(kind, best if np.isfinite(best_error) else theta, mean, scale, selected, history)


def fit_cascade(feature_rows: DataFrame, cutoff: int, kind: str, epochs: int = 15, steps_per_epoch: int = 1) -> NetworkModel:
    """Select the epoch on inner validation, then refit on all outer training rows."""
    rows = training_rows(feature_rows, cutoff)
    chosen = fit_network(
        rows, kind, epochs, SEED + cutoff, steps_per_epoch=steps_per_epoch, validation_part=F.col("part") == "validation"
    )
    if kind == "quantile":
        return chosen
    final = fit_network(
        rows, kind, chosen.selected_epoch, SEED + cutoff, steps_per_epoch=steps_per_epoch, fit_part=F.lit(True)
    )
    final.history = chosen.history
    final.selected_epoch = chosen.selected_epoch
    return final


def score_parity(rows: DataFrame, model: NetworkModel) -> DataFrame:
    """Largest disagreement of the two scoring paths beyond 1e-4 + 2e-5 of the larger value."""
    a, b = F.col("_a"), F.col("_b")
    pairs = rows.select(model.score_udf()(F.col("x")).alias("pa"), model.score_sql(F.col("x")).alias("pb"))
    flat = pairs.select(F.explode(F.arrays_zip("pa", "pb")).alias("z")).select(
        F.col("z.pa").alias("_a"), F.col("z.pb").alias("_b")
    )
    gap = F.abs(a - b)
    allowed = F.greatest(F.abs(a), F.abs(b)) * 2e-5 + 1e-4
    return flat.agg(
        F.count(F.lit(1)).alias("n_compared"),
        F.max(gap).alias("max_absolute_difference"),
        (F.max(gap - allowed) <= 0).alias("within_tolerance"),
    )


# --- sparse logistic --------------------------------------------------------------------------


@dataclass
class LogisticModel:
    weights: np.ndarray
    bias: float
    temperature: float
    selected_epoch: int
    validation_nll: float
    history: list[dict] = field(default_factory=list)

    def logit_udf(self):
        weights, bias = self.weights, self.bias

        @F.pandas_udf(T.DoubleType())
        def logit(indices: pd.Series, values: pd.Series) -> pd.Series:
            sizes = indices.map(len).to_numpy()
            if not sizes.sum():
                return pd.Series(np.full(len(sizes), bias))
            products = weights[np.concatenate(indices.to_list()).astype(int)] * np.concatenate(values.to_list())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            return pd.Series(bias + np.bincount(owner, weights=products, minlength=len(sizes)))

        return logit

    def text_logit_udf(self):
        """Logit of a normalised text by its hashed features, which stay in the task."""
        weights, bias = self.weights, self.bias

        @F.pandas_udf(T.DoubleType())
        def logit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cache: dict[str, int] = {}
            for texts in batches:
                logits = [np.empty(0)]
                for sizes, index, sums in hashed_sums(texts, cache):
                    owner = np.repeat(np.arange(len(sizes)), sizes)
                    products = weights[index] * (sums / lengths(sizes, sums)[owner])
                    logits.append(bias + np.bincount(owner, weights=products, minlength=len(sizes)))
                yield pd.Series(np.concatenate(logits))

        return logit


# Numbers of sparse rows in one packed block.
BLOCK_NUMBERS = 250_000
# Packed blocks that a task of an epoch reads at least, where there are tasks for all cores: each task sends a sum for
# every parameter through the shuffle.
TASK_BLOCKS = 100
PACKED = "sizes binary, indices binary, codes binary, palette binary, norms binary, label binary, train binary"


def _block(sizes: np.ndarray, index: np.ndarray, codes: np.ndarray, palette: np.ndarray, norms: np.ndarray, rows: pd.DataFrame) -> pd.DataFrame:
    train = (rows["part"] == "train").to_numpy()
    parts = (sizes.astype(np.int64), index.astype(np.int32), codes.astype(np.uint16), palette.astype(float), norms, rows["label"].to_numpy(dtype=float), train)
    return pd.DataFrame([[p.tobytes() for p in parts]], columns=PACKED.replace(" binary", "").split(", "))


def _row_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sparse rows packed into blocks of about ``BLOCK_NUMBERS`` numbers: every epoch reads all of them again.

    A value is a place in the block's table of distinct values, as counts divided by few norms repeat: two bytes for
    eight, without loss. A block with too many distinct values keeps them as they are.
    """
    for frame in frames:
        sizes = frame["indices"].map(len).to_numpy(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK_NUMBERS)) + 1
        for own in np.split(np.arange(len(frame)), cuts):
            if not len(own):
                continue
            rows, n = frame.iloc[own], sizes[own]
            index = np.concatenate(rows["indices"].to_list()) if n.sum() else np.empty(0)
            value = np.concatenate(rows["values"].to_list()) if n.sum() else np.empty(0)
            palette, codes = np.unique(value.astype(float), return_inverse=True)
            if len(palette) > 65_536:
                palette, codes = value.astype(float), np.empty(0)
            yield _block(n, index, codes, palette, np.empty(0), rows)


def _text_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of the hashed features of texts. The features are many times the size of the text, so they never leave the
    task as rows; a block keeps counts, which are few, and the length of each row that they are divided by."""
    cache: dict[str, int] = {}
    for frame in frames:
        at = 0
        for sizes, index, sums in hashed_sums(frame["text"], cache):
            low = sums.min(initial=0)
            palette, codes = ranks(sums - low, int(sums.max(initial=0) - low) + 1)
            palette = palette + low
            if len(palette) > 65_536:
                palette, codes = sums, np.empty(0)
            yield _block(sizes, index, codes, palette, lengths(sizes, sums), frame.iloc[at : at + len(sizes)])
            at += len(sizes)


def _opened(row) -> tuple:
    """Sizes of the rows of a block, index and value of every number, what the values of a row are to be divided by, label
    and training mark."""
    value, norms = np.frombuffer(row.palette), 1.0
    if len(row.codes):
        value = value[np.frombuffer(row.codes, np.uint16) if isinstance(row.codes, bytes) else row.codes]
    if len(row.norms):
        norms = np.frombuffer(row.norms)
        norms = np.where(norms > 0, norms, 1.0)
    return np.frombuffer(row.sizes, np.int64), np.frombuffer(row.indices, np.int32), value, norms, np.frombuffer(row.label), np.frombuffer(row.train, bool)


def _unpacked(row) -> tuple[np.ndarray, ...]:
    """Owner, index and value of every number, label and training mark of every row of a block."""
    sizes, index, value, norms, label, train = _opened(row)
    return np.repeat(np.arange(len(sizes)), sizes), index, value / np.repeat(norms * np.ones(len(sizes)), sizes), label, train


def _row_sums(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(sizes)), sizes > 0
    if len(numbers):
        out[some] = np.add.reduceat(numbers, (np.cumsum(sizes) - sizes)[some])
    return out


def _compressed(raw: np.ndarray) -> bytes:
    """Width of the numbers, then their bytes, those of one place together."""
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes()
    return bytes([raw.itemsize]) + pa.compress(planes, "zstd", asbytes=True) if planes else b""


def _plain(kept: bytes, n: int) -> np.ndarray:
    if not kept:
        return np.empty(0, np.uint16)
    width = kept[0]
    planes = np.frombuffer(pa.decompress(kept[1:], n * width, "zstd", asbytes=True), np.uint8)
    out = np.empty(n, f"u{width}")
    for k in range(width):
        out.view(np.uint8)[k::width] = planes[k * n : (k + 1) * n]
    return out


def _squeezed(blocks: Callable) -> Callable:
    """Blocks as they are kept: narrow numbers, steps between indices, compressed without loss."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks(frames):
            kept = {"indices": [], "codes": []}
            for row in block.itertuples(index=False):
                index, codes = np.frombuffer(row.indices, np.uint32), np.frombuffer(row.codes, np.uint16)
                index = index.astype(np.uint16) if index.max(initial=0) < 1 << 16 else index
                # Steps may fall below zero; they and their sums wrap alike.
                kept["indices"].append(_compressed(np.diff(index, prepend=index.dtype.type(0))))
                kept["codes"].append(_compressed(codes.astype(np.uint8) if codes.max(initial=0) < 1 << 8 else codes))
            yield block.assign(**kept)

    return run


def _loosened(row):
    """A squeezed block as ``_opened`` reads it."""
    n = int(np.frombuffer(row.sizes, np.int64).sum())
    steps = _plain(row.indices, n)
    return row._replace(indices=np.cumsum(steps, dtype=steps.dtype).astype(np.int32), codes=_plain(row.codes, n))


def fit_logistic(
    rows: DataFrame, width: int, epochs: int = 12, rate: float = 0.05, temperatures: tuple = TEMPERATURES
) -> LogisticModel:
    """Full-batch binary logistic on sparse rows (indices, values, label, part).

    After every epoch the validation loss is taken at every temperature; the winner is the
    smallest loss, then the earliest epoch, then the temperature nearest one.
    """
    return _fit_blocks(rows, ["indices", "values"], _row_blocks, width, epochs, rate, temperatures)


def fit_texts(rows: DataFrame, epochs: int = 12, rate: float = 0.05, temperatures: tuple = TEMPERATURES) -> LogisticModel:
    """``fit_logistic`` on the hashed features of normalised texts (text, label, part)."""
    return _fit_blocks(rows, ["text"], _text_blocks, BUCKETS, epochs, rate, temperatures)


def _fit_blocks(
    rows: DataFrame, columns: list[str], blocks: Callable, width: int, epochs: int, rate: float, temperatures: tuple
) -> LogisticModel:
    only(rows, F.col("part").isin("train", "validation"), "optimiser and selection accept train and validation rows only")
    # Kept on disk, where they don't fill the heap: an epoch reads each block once, one after the other.
    small_batches(rows.sparkSession)
    kept = rows.select(*columns, "label", "part").mapInPandas(_squeezed(blocks), PACKED).persist(StorageLevel.DISK_ONLY)
    size = width + 1
    k = len(temperatures)
    theta, adam = np.zeros(size), Adam(rate)
    context = rows.sparkSession.sparkContext

    def passes(data: DataFrame, current: np.ndarray) -> np.ndarray:
        shared = context.broadcast(current)

        def loss(z: np.ndarray, t: np.ndarray) -> np.ndarray:
            return np.maximum(z, 0) - t * z + np.log1p(np.exp(-np.abs(z)))

        def part(batch: pd.DataFrame) -> np.ndarray:
            w = shared.value
            out = np.zeros(size + 2 + k + 1)
            for row in batch.itertuples(index=False):
                sizes, index, value, norms, y, train = _opened(_loosened(row))
                logits = _row_sums(w[index] * value, sizes) / norms + w[-1]
                residual = np.where(train, logistic(logits) - y, 0.0)
                out[:width] += np.bincount(index, weights=np.repeat(residual / norms, sizes) * value, minlength=width)[:width]
                out[width] += residual.sum()
                out[size] += loss(logits[train], y[train]).sum()
                out[size + 1] += train.sum()
                held = ~train
                for j, t in enumerate(temperatures):
                    out[size + 2 + j] += loss(logits[held] / t, y[held]).sum()
                out[size + 2 + k] += held.sum()
            return out

        try:
            return reduce_vector(data, data.columns, part, size + 2 + k + 1)
        finally:
            shared.unpersist()

    best_key, best, history = None, None, []
    try:
        data = kept.coalesce(max(context.defaultParallelism, -(-kept.count() // TASK_BLOCKS)))
        for epoch in range(epochs + 1):
            sums = passes(data, theta)
            if not sums[size + 1]:
                raise ValueError("a fit needs at least one training row")
            if epoch > 0 and sums[size + 2 + k]:
                losses = sums[size + 2 : size + 2 + k] / sums[size + 2 + k]
                key, t = min(((losses[j], epoch, abs(np.log(t)), t), t) for j, t in enumerate(temperatures))
                history.append({"epoch": epoch, "validation_nll": float(key[0]), "temperature": t})
                if best_key is None or key < best_key:
                    best_key, best = key, LogisticModel(theta[:-1].copy(), float(theta[-1]), t, epoch, float(key[0]))
            if epoch < epochs:
                theta = adam.step(theta, sums[:size] / sums[size + 1])
    finally:
        kept.unpersist()
    if best is None:
        raise ValueError("selection needs at least one validation row")
    best.history = history
    return best


def length_features(rows: DataFrame, text: str = "text") -> DataFrame:
    """Standardised log length from training rows, as a one-wide sparse row."""
    size = F.log1p(F.length(text).cast("double"))
    stats = rows.filter(F.col("part") == "train").agg(F.avg(size).alias("m"), F.stddev_pop(size).alias("s"))
    scaled = rows.join(F.broadcast(stats), F.lit(True)).withColumn(
        "_x", (size - F.col("m")) / F.when(F.col("s") == 0, F.lit(1.0)).otherwise(F.col("s"))
    )
    return scaled.withColumn("indices", F.array(F.lit(0))).withColumn("values", F.array("_x")).drop("_x", "m", "s")


# --- saturation curve -------------------------------------------------------------------------

CURVE_SCHEMA = "base double, amplitude double, tau_seconds double, training_loss double, n_training_points bigint, fit_status string"


def curve_start(first_age: np.ndarray, last_age: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Start values in unconstrained form; ages are hours."""
    initial = np.column_stack(
        [
            np.maximum(first * 0.5, 0.1),
            np.maximum((last - first) * 1.5, 1.0),
            np.maximum(last_age - first_age, 0.1),
        ]
    )
    return initial + np.log(-np.expm1(-initial))


def curve_gradient(raw: np.ndarray, ages: np.ndarray, counts: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed squared log error and its gradient for many curves over one batch of points.

    ``raw`` is (curves, 3), points are (points,), ``mask`` is (curves, points).
    """
    positive = softplus(raw)
    base, amplitude, tau = positive[:, :1], positive[:, 1:2], positive[:, 2:] + TAU_FLOOR_HOURS
    decay = np.exp(-ages[None, :] / tau)
    predicted = base + amplitude * -np.expm1(-ages[None, :] / tau)
    gap = (np.log1p(predicted) - np.log1p(counts)[None, :]) * mask
    outer = 2 * gap / (1 + predicted)
    slope = np.stack(
        [outer.sum(1), (outer * (1 - decay)).sum(1), (outer * -amplitude * decay * ages[None, :] / tau**2).sum(1)], axis=1
    )
    return (gap * gap).sum(1), slope * logistic(raw)


def adam_curves(ages: np.ndarray, counts: np.ndarray, sizes: np.ndarray, epochs: int) -> np.ndarray:
    """Fit one curve per prefix size of a single ordered series; returns unconstrained parameters."""
    mask = np.arange(len(ages))[None, :] < sizes[:, None]
    raw = curve_start(np.repeat(ages[0], len(sizes)), ages[sizes - 1], np.repeat(counts[0], len(sizes)), counts[sizes - 1])
    adam = Adam(0.03)
    for _ in range(epochs):
        _, slope = curve_gradient(raw, ages, counts, mask)
        raw = adam.step(raw, slope / sizes[:, None])
    return raw


def curve_frame(raw: np.ndarray, loss: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    positive = softplus(raw)
    tau = (positive[:, 2] + TAU_FLOOR_HOURS) * 3600
    fine = np.isfinite(positive).all(1) & (positive > 0).all(1)
    return pd.DataFrame(
        {
            "base": positive[:, 0],
            "amplitude": positive[:, 1],
            "tau_seconds": tau,
            "training_loss": loss / sizes,
            "n_training_points": sizes.astype(np.int64),
            "fit_status": np.where(fine, "experimental_fit", "numerical_failure"),
        }
    )


def fit_prefixes(
    pdf: pd.DataFrame,
    epochs: int = CURVE_EPOCHS,
    last_only: bool = False,
    block: int = 64,
    after: int = 0,
    upto: int | None = None,
) -> pd.DataFrame:
    """Default curve fitter: parameters for every prefix that passes the gate, or the whole series.

    The result is indexed by the position of the prefix's last point; only prefixes that end after
    position ``after`` and at or before ``upto`` are fitted.
    """
    pdf = pdf.sort_values("age_seconds")
    ages, counts = pdf["age_seconds"].to_numpy() / 3600, pdf["value"].to_numpy(dtype=float)
    spans = (ages - ages[0]) * 3600
    ends = np.flatnonzero((np.arange(len(ages)) + 1 >= CURVE_MIN_POINTS) & (spans >= CURVE_MIN_SPAN))
    ends = ends[(ends >= after) & (ends < (len(ages) if upto is None else upto))]
    if last_only:
        ends = ends[ends == len(ages) - 1]
    parts = []
    for at in range(0, len(ends), block):
        sizes = ends[at : at + block] + 1
        top = sizes.max()
        raw = adam_curves(ages[:top], counts[:top], sizes, epochs)
        loss, _ = curve_gradient(raw, ages[:top], counts[:top], np.arange(top)[None, :] < sizes[:, None])
        part = curve_frame(raw, loss, sizes)
        part["position"] = sizes.astype(np.int64)
        parts.append(part)
    if not parts:
        return pd.DataFrame(columns=["base", "amplitude", "tau_seconds", "training_loss", "n_training_points", "fit_status", "position"])
    return pd.concat(parts, ignore_index=True)


def _fit_block(ages: np.ndarray, logs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, epochs: int) -> pd.DataFrame:
    """One fit for each stretch of ``sizes`` points from ``starts``, all in the same numpy calls; ages are hours.

    The stretches are sides of one array, so parameters need no copy for each point; those short of the longest are padded
    with their last point, whose weight is zero there. Only the slope is taken in an epoch, with terms shared by its parts.
    """
    top = int(sizes.max())
    place = starts[:, None] + np.minimum(np.arange(top)[None, :], sizes[:, None] - 1)
    weight = None if (sizes == top).all() else (np.arange(top)[None, :] < sizes[:, None]).astype(float)
    raw = curve_start(ages[starts], ages[place[:, -1]], np.expm1(logs[starts]), np.expm1(logs[place[:, -1]])).T.copy()
    # Numpy is fast along the longer side: many short curves lie side by side, few long ones one after the other.
    along = 0 if len(sizes) > top else 1
    wide = (lambda v: v[None, :]) if along == 0 else (lambda v: v[:, None])
    turned = (lambda m: np.ascontiguousarray(m.T)) if along == 0 else (lambda m: m)
    x, y = turned(ages[place]), turned(logs[place])
    weight = None if weight is None else turned(weight)
    adam, fall, gap, grown = Adam(0.03), np.empty_like(x), np.empty_like(x), np.empty_like(x)

    def gaps(base: np.ndarray, amplitude: np.ndarray, tau: np.ndarray) -> np.ndarray:
        """Log error of every point; ``fall`` is minus the risen part, ``grown`` the prediction plus one."""
        np.multiply(x, wide(-1 / tau), out=fall)
        np.expm1(fall, out=fall)
        np.multiply(fall, wide(-amplitude), out=grown)
        np.add(grown, wide(1 + base), out=grown)
        np.log(grown, out=gap)
        np.subtract(gap, y, out=gap)
        return gap if weight is None else np.multiply(gap, weight, out=gap)

    for _ in range(epochs):
        small = np.exp(-np.abs(raw))
        base, amplitude, tau = np.maximum(raw, 0.0) + np.log1p(small)
        tau = tau + TAU_FLOOR_HOURS
        outer = np.divide(gaps(base, amplitude, tau), grown, out=gap)
        level = outer.sum(along)
        aged = np.multiply(outer, x, out=grown).sum(along)
        risen = np.multiply(outer, fall, out=outer).sum(along)
        aged += np.multiply(grown, fall, out=grown).sum(along)
        slope = np.stack([level, -risen, -amplitude / tau**2 * aged])
        raw = adam.step(raw, slope * (np.where(raw >= 0, 2.0, 2.0 * small) / (1 + small) / sizes))
    base, amplitude, tau = softplus(raw)
    loss = np.square(gaps(base, amplitude, tau + TAU_FLOOR_HOURS)).sum(along)
    return curve_frame(raw.T, loss, sizes)


def _blocks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of stretches of about equal size, at most ``BATCH_POINTS`` points together where that is one at least."""
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    at = 0
    while at < len(order):
        # Up to a sixteenth is padded, or more where the block would be so small that numpy's calls outweigh the points.
        near = int(np.searchsorted(ranked, ranked[at] + max(1, ranked[at] // 16), side="right"))
        end = min(near, at + max(1, BATCH_POINTS // int(ranked[near - 1])))
        wider = np.arange(1, len(order) - end + 1) + (end - at)
        end += int(np.searchsorted(wider * ranked[end:], BATCH_POINTS // 8, side="right"))
        yield order[at:end]
        at = end


def _bundle_fitter(epochs: int, last_only: bool):
    """Fits of every series of a bundle, about ``BATCH_POINTS`` points of prefixes at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*SERIES, "position"], ignore_index=True)
        series = pdf.groupby(SERIES, sort=False, dropna=False).ngroup().to_numpy()
        first = np.searchsorted(series, series)
        seconds = pdf["age_seconds"].to_numpy(dtype=float)
        ages, logs = seconds / 3600, np.log1p(pdf["value"].to_numpy(dtype=float))
        size = np.arange(len(pdf)) - first + 1
        fitted = (size >= CURVE_MIN_POINTS) & (seconds - seconds[first] >= CURVE_MIN_SPAN)
        if last_only:
            fitted &= np.append(series[1:] != series[:-1], True)
        ends = np.flatnonzero(fitted)
        out = []
        for places in _blocks(size[ends]):
            own = ends[places]
            part = _fit_block(ages, logs, first[own], size[own], epochs)
            part["position"] = part["n_training_points"]
            for name in SERIES:
                part[name] = pdf[name].to_numpy()[own]
            out.append(part)
        return pd.concat(out, ignore_index=True)[CURVE_COLUMNS] if out else pd.DataFrame(columns=CURVE_COLUMNS)

    return run


# Points of all prefixes together in one numpy batch, of one bundle of series, and of a series that is fitted in blocks.
BATCH_POINTS = 20_000
BUNDLE_POINTS = 4_000_000
LONG_SERIES = 20_000
POINT_BLOCK, PREFIX_BLOCK = 4_096, 256
CURVE_COLUMNS = [*SERIES, "position", "base", "amplitude", "tau_seconds", "training_loss", "n_training_points", "fit_status"]


def saturation_fits(
    rows: DataFrame,
    epochs: int = CURVE_EPOCHS,
    last_only: bool = False,
    fit_fn: Callable[[pd.DataFrame, int, bool], pd.DataFrame] | None = None,
    long_series: int = LONG_SERIES,
    point_block: int = POINT_BLOCK,
    prefix_block: int = PREFIX_BLOCK,
) -> DataFrame:
    """Curve parameters per series and prefix end.

    ``rows`` carries url, source, position (1, 2, ... in a series), age_seconds and value. Series of at most
    ``long_series`` points are bundled by their work and fitted many at once; a longer one is cut into blocks of
    points and of prefix ends (``block_fits``), so no task holds it. A caller's ``fit_fn`` is called once for
    every series, whatever its length.
    """
    base = rows.select(*SERIES, "position", "age_seconds", "value")
    schema = f"url string, source string, position bigint, {CURVE_SCHEMA}"
    if fit_fn is not None:

        def whole(key, pdf):
            out = fit_fn(pdf, epochs, last_only)
            return out.assign(**dict(zip(SERIES, key[:2], strict=True)))[CURVE_COLUMNS]

        return base.groupBy(*SERIES).applyInPandas(whole, schema)
    n = F.count(F.lit(1)).cast("double")
    sizes = base.groupBy(*SERIES).agg(n.alias("_n"))
    work = F.col("_n") if last_only else F.col("_n") * F.col("_n") / 2
    small = F.col("_n") <= long_series
    known = sizes.agg(F.sum(F.when(small, work)), F.count_if(~small)).first()
    # One bundle at least for every task that may run: fits cost far more than the rows they read.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    bundles = max(4 * cores, int((known[0] or 0) // BUNDLE_POINTS))
    bundled = base.join(sizes.filter(small).select(*SERIES), SERIES) if known[1] else base
    # As many shuffle partitions as bundles: joined small ones would leave cores idle.
    bundled = bundled.withColumn("_bundle", F.pmod(F.xxhash64(*SERIES), F.lit(bundles))).repartition(bundles, "_bundle")
    fits = bundled.groupBy("_bundle").applyInPandas(_bundle_fitter(epochs, last_only), schema)
    if not known[1]:
        return fits
    long = base.join(sizes.filter(~small).select(*SERIES), SERIES)
    return fits.unionByName(block_fits(long, epochs, last_only, point_block, prefix_block))


def _packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, np.float64).tobytes()


def _point_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("position")
    row = {name: pdf[name].iloc[0] for name in [*SERIES, "_block"]}
    hours = pdf["age_seconds"].to_numpy(dtype=float) / 3600
    row |= {"ages": _packed(hours), "logs": _packed(np.log1p(pdf["value"].to_numpy(dtype=float))), "first": int(pdf["position"].iloc[0])}
    return pd.DataFrame([row])


def _start_states(pdf: pd.DataFrame) -> pd.DataFrame:
    """Start parameters and empty moments of one block of prefix ends."""
    pdf = pdf.sort_values("position")
    hours, last = pdf["age_seconds"].to_numpy(dtype=float) / 3600, pdf["value"].to_numpy(dtype=float)
    raw = curve_start(pdf["_a0"].to_numpy(dtype=float) / 3600, hours, pdf["_v0"].to_numpy(dtype=float), last)
    row = {name: pdf[name].iloc[0] for name in [*SERIES, "_prefix"]}
    none = _packed(np.zeros_like(raw))
    return pd.DataFrame([row | {"ends": pdf["position"].to_numpy(np.int64).tobytes(), "raw": _packed(raw), "first": none, "second": none}])


def _partial_gradients(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Losses and slopes of prefix blocks over the point blocks of this task, summed before they are sent."""
    sums: dict[tuple, np.ndarray] = {}
    for pdf in frames:
        for row in pdf.itertuples(index=False):
            raw = np.frombuffer(row.raw).reshape(-1, 3)
            ages, logs = np.frombuffer(row.ages), np.frombuffer(row.logs)
            reach = np.clip(np.frombuffer(row.ends, np.int64) - row.at + 1, 0, len(ages))
            loss, slope = np.zeros(len(raw)), np.zeros_like(raw)
            # Prefixes that end before this block have no point in it.
            for lo in range(0, len(raw), 16):
                part = slice(lo, lo + 16)
                top = int(reach[part].max(initial=0))
                if top:
                    mask = np.arange(top)[None, :] < reach[part][:, None]
                    loss[part], slope[part] = curve_gradient(raw[part], ages[:top], np.expm1(logs[:top]), mask)
            key = (row.url, row.source, row._asdict()["prefix"])
            sums[key] = sums.get(key, 0) + np.column_stack([loss, slope])
    rows = [(*key, _packed(total)) for key, total in sums.items()]
    yield pd.DataFrame(rows, columns=[*SERIES, "_prefix", "total"])


def _stepped(step: int):
    """One step of Adam for a prefix block from the partial sums of all tasks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf[pdf["raw"].notna()].iloc[0]
        raw, first, second = (np.frombuffer(row[c]).reshape(-1, 3) for c in ("raw", "first", "second"))
        sizes = np.frombuffer(row["ends"], np.int64)
        total = sum(np.frombuffer(t).reshape(-1, 4) for t in pdf.loc[pdf["total"].notna(), "total"])
        adam = Adam(0.03, step, first, second)
        raw = adam.step(raw, total[:, 1:] / sizes[:, None])
        out = {c: row[c] for c in [*SERIES, "_prefix", "ends"]}
        return pd.DataFrame([out | {"raw": _packed(raw), "first": _packed(adam.first), "second": _packed(adam.second)}])

    return run


def block_fits(rows: DataFrame, epochs: int, last_only: bool, point_block: int, prefix_block: int) -> DataFrame:
    """Rolling fits of series that no task should hold.

    Points lie in blocks of ``point_block``, parameters and moments of prefix ends in a table of blocks of
    ``prefix_block``. In every epoch a prefix block meets the point blocks it reaches, partial sums are combined
    inside the tasks, and one row a prefix block is stepped and written to the
    checkpoint folder. With n points an epoch costs the n * n / 2 terms that n rolling fits have.
    """
    place = lambda column, size: F.floor((F.col(column) - 1) / size)
    points = rows.withColumn("_block", place("position", point_block)).groupBy(*SERIES, "_block")
    points = cut_lineage(
        points.applyInPandas(_point_blocks, "url string, source string, _block bigint, ages binary, logs binary, first bigint")
    ).withColumnRenamed("first", "at")
    opening = rows.groupBy(*SERIES).agg(
        F.min_by("age_seconds", "position").alias("_a0"), F.min_by("value", "position").alias("_v0"), F.max("position").alias("_top")
    )
    ends = rows.join(opening, SERIES)
    ends = ends.filter((F.col("position") >= CURVE_MIN_POINTS) & (F.col("age_seconds") - F.col("_a0") >= CURVE_MIN_SPAN))
    if last_only:
        ends = ends.filter(F.col("position") == F.col("_top"))
    state_schema = "url string, source string, _prefix bigint, ends binary, raw binary, first binary, second binary"
    state = ends.withColumn("_prefix", place("position", prefix_block)).groupBy(*SERIES, "_prefix")
    state = cut_lineage(state.applyInPandas(_start_states, state_schema))
    last = F.floor(((F.col("_prefix") + 1) * prefix_block - 1) / point_block)

    def totals(state: DataFrame) -> DataFrame:
        reach = state.select(*SERIES, F.col("_prefix").alias("prefix"), "ends", "raw", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_block"))
        met = reach.join(points, [*SERIES, "_block"]).select(*SERIES, "prefix", "ends", "raw", "ages", "logs", "at")
        return met.mapInPandas(_partial_gradients, "url string, source string, _prefix bigint, total binary")

    def beside(state: DataFrame) -> DataFrame:
        return state.unionByName(totals(state), allowMissingColumns=True).groupBy(*SERIES, "_prefix")

    for step in range(epochs):
        # The next epoch reads the table twice, so it is written each time; it has one row a prefix block.
        state = cut_lineage(beside(state).applyInPandas(_stepped(step), state_schema))

    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf[pdf["raw"].notna()].iloc[0]
        sizes = np.frombuffer(row["ends"], np.int64)
        total = sum(np.frombuffer(t).reshape(-1, 4) for t in pdf.loc[pdf["total"].notna(), "total"])
        out = curve_frame(np.frombuffer(row["raw"]).reshape(-1, 3), total[:, 0], sizes)
        return out.assign(position=sizes, **{c: row[c] for c in SERIES})[CURVE_COLUMNS]

    return beside(state).applyInPandas(finished, f"url string, source string, position bigint, {CURVE_SCHEMA}")


CURVE_MODEL = "saturation_curve"


def curve_predictions(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Predict every point from the curve fitted on the points before it, anchored at the origin."""
    usable = fits.filter(F.col("fit_status") == "experimental_fit").select(
        *SERIES, (F.col("position") + 1).alias("position"), "base", "amplitude", "tau_seconds"
    )
    joined = rows.filter(F.col("last").isNotNull()).join(usable, [*SERIES, "position"])
    prediction = saturation_prediction(
        F.col("base"),
        F.col("amplitude"),
        F.col("tau_seconds"),
        F.col("last.value"),
        F.col("last.age_seconds"),
        F.col("age_seconds"),
    )
    horizon = F.col("age_seconds") - F.col("last.age_seconds")
    long = joined.select(
        *SERIES,
        F.col("last.observed_at").alias("origin_at"),
        F.col("observed_at").alias("target_at"),
        (F.col("position") - 1).alias("training_points"),
        F.col("value").alias("actual"),
        horizon.alias("forecast_horizon_seconds"),
        horizon_bucket(horizon).alias("horizon_bucket"),
        F.col("is_last").alias("latest_holdout"),
        F.lit(CURVE_MODEL).alias("model"),
        prediction.alias("prediction"),
    )
    return add_errors(long.filter(F.col("prediction").isNotNull()))
