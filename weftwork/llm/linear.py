"""Bounded training samples and logistic models in numpy, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, id_col: str, stratum: Column, most: int) -> DataFrame:
    """About ``most`` rows of each stratum at most, chosen by a hash of the id: the same rows in every run.

    Strata are counted first (their number must be small, as of labels); a row is in if its hash is
    below its stratum's share. A row without id or stratum is never in.
    """
    span = 1 << 30
    keyed = df.where(F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in keyed.groupBy(stratum.alias("s")).count().collect() if r[0] is not None}
    share = F.lit(0).cast("long")
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        share = F.when(stratum == F.lit(value), F.lit(min(span, span * most // max(1, n)))).otherwise(share)
    return keyed.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(span)) < share)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def newton(sums: Callable[[np.ndarray], np.ndarray], size: int, l2: float, rounds: int = 40, near: float = 1e-6) -> np.ndarray:
    """Weights of the least mean loss plus ``l2`` / 2 times their squares, by Newton's method from zero.

    ``sums`` gives for weights, as one vector, the number of cases, the sum of their losses, its gradient and its
    second derivatives. A step that makes the loss larger is halved.
    """
    best, step, least = np.zeros(size), np.zeros(size), np.inf
    for _ in range(rounds):
        w = best + step
        v = sums(w)
        n = max(v[0], 1e-9)
        loss = v[1] / n + l2 / 2 * w @ w
        if loss > least + 1e-12:
            step = step / 2
            continue
        best, least = w, loss
        step = -np.linalg.solve(v[2 + size :].reshape(size, size) / n + l2 * np.eye(size), v[2 : 2 + size] / n + l2 * w)
        if np.abs(step).max() < near:
            break
    return best


class Logistic:
    """Logistic regression on standardised features, one column of weights for each target; full-batch Adam from zero."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 300, rate: float = 0.05, weight: np.ndarray | None = None, intercept: bool = True, floor: float = 1e-6) -> None:
        y = y.reshape(len(x), -1).astype(np.float32)
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.scale = x.std(axis=0) + floor if len(x) else np.ones(x.shape[1])
        z = ((x - self.mean) / self.scale).astype(np.float32)
        weight = np.ones(len(x), np.float32) if weight is None else weight.astype(np.float32)
        weight = (weight / max(weight.sum(), 1e-9))[:, None]
        w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
        for t in range(1, steps + 1):
            error = weight * (sigmoid(z @ w + b) - y)
            for p, g, k in ((w, z.T @ error + l2 * w, 0), (b, error.sum(axis=0) * intercept, 2)):
                moments[k] = 0.9 * moments[k] + 0.1 * g
                moments[k + 1] = 0.999 * moments[k + 1] + 0.001 * g * g
                p -= rate * (moments[k] / (1 - 0.9**t)) / (np.sqrt(moments[k + 1] / (1 - 0.999**t)) + 1e-8)
        # standardisation folded into the weights
        self.w = (w / self.scale[:, None]).astype(np.float32)
        self.b = (b - self.mean @ self.w).astype(np.float32)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b
