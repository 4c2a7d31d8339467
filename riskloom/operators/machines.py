"""Linear support vector machines, one for each fold left out, fitted together.

A machine minimises ``reg / 2 |w|^2 + mean(max(0, 1 - y (w x + b)))``; the intercept is not
penalised. The hinge has a corner, on which a quasi-Newton learner takes thousands of short
passes. Here the corner is rounded over a width ``h``, which lowers the loss by ``h / 4`` at
most; Newton steps find the minimum, and ``h`` shrinks from 2 until that bound is below the
tolerance. A pass reads each block of rows once for all machines and returns sums only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

register_pickle_by_value(sys.modules[__name__])

#: Steps along a direction whose losses a pass finds; the slopes are those of the first.
STEPS = (1.0, *(0.5**i for i in range(1, 16)))
#: The width of the corner is divided by this once its minimum is found.
SHRINK = 4.0


@dataclass
class Machine:
    """Coefficients and intercept of a fitted machine."""

    coefficients: list[float]
    intercept: float

    def margin(self, features: Column) -> Column:
        """``w x + b`` of a column of arrays."""
        weights = F.array(*[F.lit(float(w)) for w in self.coefficients])
        products = F.zip_with(features, weights, lambda x, w: x * w)
        return F.aggregate(products, F.lit(float(self.intercept)), lambda a, b: a + b)


def pack(folded: DataFrame, features: str, label: str) -> DataFrame:
    """``m``: the rows of a batch as one matrix of doubles: features, 1, label as +1 or -1, fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, fold = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
            rows = np.column_stack([x, np.ones(len(x)), 2 * y - 1, fold])
            yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], ["m"])

    return folded.select(vector_to_array(features), label, "fold").mapInArrow(run, "m binary")


def _loss(z: np.ndarray, h: float) -> np.ndarray:
    return np.where(z >= 1 + h, 0.0, np.where(z <= 1 - h, 1 - z, (1 + h - z) ** 2 / (4 * h)))


def _sums(blocks: DataFrame, at: np.ndarray, along: np.ndarray, h: np.ndarray, open_: list[int]) -> dict[int, tuple]:
    """Per open machine: losses at ``at + step * along`` for each step, exact losses at the first,
    and there the slopes and curvatures, all as sums over the rows of other folds."""
    d = at.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(open_), len(STEPS) + 1 + d + d * d))
        for batch in batches:
            for packed in batch.column(0):
                rows = np.frombuffer(packed.as_buffer(), dtype=float).reshape(-1, d + 2)
                for place, i in enumerate(open_):
                    mine = rows[rows[:, d + 1] != i]
                    x, y = mine[:, :d], mine[:, d]
                    z, change = y * (x @ at[i]), y * (x @ along[i])
                    for s, step in enumerate(STEPS):
                        total[place, s] += _loss(z + step * change, h[i]).sum()
                    z = z + change
                    total[place, len(STEPS)] += np.maximum(0.0, 1 - z).sum()
                    slope = np.clip((z - 1 - h[i]) / (2 * h[i]), -1.0, 0.0) * y
                    round_ = x[np.abs(1 - z) < h[i]]
                    total[place, len(STEPS) + 1 :] += np.concatenate([slope @ x, (round_.T @ round_ / (2 * h[i])).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["t"])

    parts = [np.frombuffer(r["t"], dtype=float) for r in blocks.mapInArrow(run, "t binary").collect()]
    whole = np.sum(parts, axis=0).reshape(len(open_), -1)
    n = len(STEPS)
    return {i: (t[:n], t[n], t[n + 1 : n + 1 + d], t[n + 1 + d :].reshape(d, d)) for i, t in zip(open_, whole)}


def fit_machines(
    blocks: DataFrame, rows: list[int], width: int, regs: list[float], max_iter: int = 10_000, tol: float = 1e-4
) -> list[Machine]:
    """The machine of each fold, fitted on the ``rows[i]`` rows of all other folds.

    ``blocks`` as from ``pack``, persisted. A loss is at most ``tol`` times itself above the least
    one, or the fit ends after ``max_iter`` passes.
    """
    k, d = len(rows), width + 1
    penalised = np.append(np.ones(width), 0.0)
    at, along, h = np.zeros((k, d)), np.zeros((k, d)), np.full(k, 2.0)  # every row starts inside the corner
    open_ = [i for i in range(k) if rows[i]]
    known = dict.fromkeys(open_, np.inf)  # the rounded loss at ``at``
    for _ in range(max_iter):
        if not open_:
            break
        found = _sums(blocks, at, along, h, open_)
        for i in list(open_):
            losses, exact, slope, curve = (t / rows[i] for t in found[i])
            tried = [at[i] + s * along[i] for s in STEPS]
            values = [loss + regs[i] / 2 * (penalised * w * w).sum() for loss, w in zip(losses, tried)]
            best = int(np.argmin(values))
            if values[best] < known[i] < np.inf and values[0] > known[i] - (known[i] - values[best]) / 2:
                # the whole step goes too far: go there, and find the slopes with the next pass
                at[i], along[i], known[i] = tried[best], 0.0, values[best]
                continue
            if along[i].any() and values[0] >= known[i]:  # no step gains: the rounding of doubles
                along[i] = 0.0
                if h[i] / 4 <= tol * known[i]:
                    open_.remove(i)
                else:
                    h[i], known[i] = h[i] / SHRINK, np.inf
                continue
            at[i], known[i] = tried[0], values[0]
            slope = slope + regs[i] * penalised * at[i]
            curve = curve + np.diag(regs[i] * penalised + 1e-12)
            along[i] = -np.linalg.lstsq(curve, slope, rcond=None)[0]
            gain = -(slope @ along[i]) / 2  # what the step would gain on a parabola
            true = exact + regs[i] / 2 * (penalised * at[i] ** 2).sum()
            if gain <= tol * max(true, 1e-12) / 100:
                along[i] = 0.0
                if h[i] / 4 <= tol * max(true, 1e-12):
                    open_.remove(i)
                else:
                    h[i], known[i] = h[i] / SHRINK, np.inf
    return [Machine([float(v) for v in w[:-1]], float(w[-1])) for w in at]
