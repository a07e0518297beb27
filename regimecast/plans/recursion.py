"""Forecasts past the end of every series, all steps of a series in one pass.

The state of a series is its last values, so series are independent: a batch of them is carried
through all steps inside a task, with the forest as arrays. No step is a plan of its own.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle

from regimecast.functions import vectors as vec
from regimecast.operators.batched import memberships, squares

# Executors get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Walker:
    """What one step needs: regimes, the names of the features in order, and the forest."""

    hard: np.ndarray
    soft: np.ndarray
    fuzziness: float
    lags: tuple[int, ...]
    features: tuple[str, ...]
    by_distance: bool
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    epsilon: float = vec.EPSILON

    def regimes(self, now: np.ndarray) -> dict[str, np.ndarray]:
        x = now[:, None]
        k = squares(x, self.hard).argmin(axis=1)
        u, far = memberships(x, self.soft, self.fuzziness)
        size = len(self.soft)
        truth = u[np.arange(len(k)), k]
        p = u + self.epsilon
        total = p.sum(axis=1)
        entropy = (np.log(total) - (p * np.log(p)).sum(axis=1) / total) / np.log(size) if size > 1 else np.zeros(len(k))
        if self.by_distance:
            near = np.sqrt(np.sort(far, axis=1))
            entropy = np.divide(near[:, 0], near[:, 1], out=np.zeros(len(k)), where=near[:, 1] > 0)
        out = {"truth": truth, "falsity": 1.0 - truth, "indeterminacy": np.clip(entropy, 0.0, 1.0)}
        for j in range(size):
            out[f"hard_{j}"], out[f"soft_{j}"] = (k == j).astype(float), u[:, j]
        return out

    def votes(self, rows: np.ndarray) -> np.ndarray:
        """The value of every tree for every row, walked from the roots by all at once."""
        at = np.tile(self.roots, (len(rows), 1))
        which = np.arange(len(rows))[:, None]
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return self.value[at]
            below = rows[which, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)

    def steps(self, recent: np.ndarray, steps: int) -> np.ndarray:
        """(series, step, [yhat, sigma, indeterminacy]) from the last values of every series, oldest first."""
        recent, out = recent.copy(), np.empty((len(recent), steps, 3))
        for step in range(steps):
            known = {"y_norm": recent[:, -1], **{f"lag_{k}": recent[:, -1 - k] for k in self.lags}}
            known |= self.regimes(recent[:, -1])
            votes = self.votes(np.column_stack([known[n] for n in self.features]))
            out[:, step, 0], out[:, step, 1] = votes.mean(axis=1), votes.std(axis=1)
            out[:, step, 2] = known["indeterminacy"]
            recent = np.column_stack([recent[:, 1:], out[:, step, 0]])
        return out


def walk(held, steps: int, block: int = 256):
    """A function of a column of last values that gives the numbers of ``Walker.steps``, flat for each series."""

    def run(column: pd.Series) -> pd.Series:
        walker, out = held.value, []
        for start in range(0, len(column), block):
            recent = np.stack(column.iloc[start : start + block].to_numpy()).astype(float)
            out += list(walker.steps(recent, steps).reshape(len(recent), -1))
        return pd.Series(out, dtype=object)

    return run
