"""A head fitted in epochs, judged after each one, and stopped when the judgement gets no better.

One pass over the rows per epoch: tasks turn their rows into sums (the loss and its slopes on the train split, hits on the eval
split, all at the same weights), as arrays over fixed blocks of features. The arrays are added up as a tree: ``FAN`` of them at a time, then
the rest, block by block, so no task adds up more than ``FAN`` arrays of a block or one per ``FAN`` tasks. The driver holds weights and slopes, a few
vectors of features times classes, and takes the step (limited-memory BFGS; a step that does not lower the loss is halved).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescore.operators.head import GRID, WEIGHT_DECAY

# Epochs without a better judgement until a fit is stopped.
PATIENCE = 5

EPOCHS, FAN, MEMORY = 50, 32, 10
# Slopes per block.
BLOCK = 4096
_SUMS = "block int, part bigint, total array<double>"


@dataclass
class EarlyHead:
    """The weights of the best epoch, and what every epoch measured."""

    weights: list[list[float]]
    bias: list[float]
    reg: float
    epoch: int
    metrics: dict[str, float]
    history: list[dict[str, float]] = field(default_factory=list)
    stopped: str = "epochs"


def _task_sums(weights: np.ndarray, bias: np.ndarray):
    """A function of Arrow batches (train, label, features) to the task's sums."""
    classes, size = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slopes = np.zeros((classes, size + 1))
        # Train rows, loss, eval rows, right ones, then per class: hits, rows, predictions.
        head = np.zeros(4 + 3 * classes)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            train = batch.column(0).to_numpy(zero_copy_only=False)
            label = batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, size)
            logits = x @ weights.T + bias
            top = logits.max(axis=1, keepdims=True)
            logs = logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))
            own = np.eye(classes)[label]
            error = (np.exp(logs) - own)[train]
            slopes[:, :size] += error.T @ x[train]
            slopes[:, size] += error.sum(axis=0)
            head[:2] += train.sum(), -(logs * own)[train].sum()
            said, true = logits.argmax(axis=1)[~train], label[~train]
            head[2:4] += len(true), (said == true).sum()
            head[4:] += np.concatenate([np.bincount(v, minlength=classes) for v in (true[said == true], true, said)])
        flat = slopes.reshape(-1)
        parts = [head, *(flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int32()), pa.array([0] * len(parts), pa.int64()), pa.array([p.tolist() for p in parts], pa.list_(pa.float64()))],
            ["block", "part", "total"],
        )

    return run


def _added(group: pa.Table) -> pa.Table:
    """One array from a group of arrays of one block."""
    total = np.sum([np.asarray(v) for v in group.column("total").to_pylist()], axis=0)
    first = group.slice(0, 1)
    return first.set_column(2, "total", pa.array([total.tolist()], pa.list_(pa.float64())))


def _evaluate(rows: DataFrame, weights: np.ndarray, bias: np.ndarray, reg: float) -> tuple[dict[str, float], np.ndarray]:
    """What an epoch measures, and the slopes of the penalised mean loss (features, then the bias, per class)."""
    sums = rows.mapInArrow(_task_sums(weights, bias), _SUMS).withColumn("part", F.spark_partition_id().cast("bigint"))
    fans = sums.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("block", "part").applyInArrow(_added, _SUMS)
    total = fans.groupBy("block").applyInArrow(_added, _SUMS).orderBy("block").collect()
    classes, size = weights.shape
    head = np.array(total[0]["total"]) if total else np.zeros(4 + 3 * classes)
    if not head[0]:
        raise ValueError("no train rows to fit a head on")
    slopes = np.concatenate([np.array(r["total"]) for r in total[1:]]).reshape(classes, size + 1) / head[0]
    slopes[:, :size] += reg * weights
    hits, true, said = head[4:].reshape(3, classes)
    f1 = np.divide(2 * hits, true + said, out=np.zeros(classes), where=true + said > 0)
    measured = {
        "loss": head[1] / head[0] + reg / 2 * float((weights**2).sum()), "n": head[2], "accuracy": head[3] / head[2] if head[2] else 0.0,
        "f1_normal": float(f1[1]), "f1_abnormal": float(f1[0]), "f1_macro": float(f1.mean()), "slope": float(np.abs(slopes).max()),
    }
    return measured, slopes


def _direction(slope: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Where to go from here, from the last steps and the changes of slope along them."""
    out, used = -slope, []
    for s, y in zip(reversed(steps), reversed(changes)):
        share = (s @ out) / (s @ y)
        out = out - share * y
        used.append(share)
    if steps:
        out = out * (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for (s, y), share in zip(zip(steps, changes), reversed(used)):
        out = out + (share - (y @ out) / (s @ y)) * s
    return out


def fit_epochs(
    rows: DataFrame, features: str = "features", label: str = "label", reg: float = WEIGHT_DECAY, epochs: int = EPOCHS,
    patience: int | None = PATIENCE, metric: str = "f1_normal", tol: float = 1e-7, classes: int = 2,
) -> EarlyHead:
    """Fit on the train split of ``rows``, judge on eval after every epoch, and keep the best epoch's weights.

    Stops after ``epochs``, after ``patience`` epochs without a better ``metric`` (None: never), or at the optimum: all slopes within
    ``tol``. Without patience the last epoch's weights are kept. ``rows`` should be a written table: it is read once per epoch. Rows without a label, or with null features, are left out.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    narrow = known.select((F.col("split") == "train").alias("train"), F.col(label).cast("bigint").alias("label"), F.col(features).cast("array<double>").alias("x"))
    first = narrow.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows to fit a head on")
    size = first["n"]
    point = np.zeros((classes, size + 1))
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    measured, slope = _evaluate(narrow, point[:, :size], point[:, size], reg)
    history, best, waited, stopped = [], None, 0, "epochs"
    for epoch in range(1, epochs + 1):
        way = _direction(slope.reshape(-1), steps, changes)
        rise = float(slope.reshape(-1) @ way)
        length = 1.0 if steps else 1.0 / max(1.0, float(np.abs(slope).sum()))
        while True:
            there = point + length * way.reshape(point.shape)
            found, next_slope = _evaluate(narrow, there[:, :size], there[:, size], reg)
            if found["loss"] <= measured["loss"] + 1e-4 * length * rise or length < 1e-8:
                break
            length /= 2
        step, change = (there - point).reshape(-1), (next_slope - slope).reshape(-1)
        if step @ change > 1e-12:
            steps, changes = [*steps, step][-MEMORY:], [*changes, change][-MEMORY:]
        point, slope, measured = there, next_slope, found
        history.append({"epoch": epoch, **measured})
        if best is None or patience is None or measured[metric] > best.metrics[metric]:
            best, waited = EarlyHead(point[:, :size].tolist(), point[:, size].tolist(), reg, epoch, measured), 0
        else:
            waited += 1
        if measured["slope"] <= tol or length < 1e-8:
            stopped = "optimum"
            break
        if patience is not None and waited >= patience:
            stopped = "patience"
            break
    best.history, best.stopped = history, stopped
    return best


def fit_best(rows: DataFrame, grid: tuple[float, ...] = GRID, metric: str = "f1_normal", **options) -> EarlyHead:
    """The best of one early-stopped fit per regularisation, by the metric of its best epoch; ties go to the first."""
    fits = [fit_epochs(rows, reg=reg, metric=metric, **options) for reg in grid]
    return max(fits, key=lambda f: f.metrics[metric])
