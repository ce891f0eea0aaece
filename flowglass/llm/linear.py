"""Logistic regression: Newton steps on a bounded matrix, or on sums that Spark gathers over a whole table."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x], axis=1)


def parts(x, y, weight, w) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted log loss at w."""
    p = sigmoid(x @ w)
    return x.T @ (weight * (p - y)), (x * (weight * p * (1 - p))[:, None]).T @ x


def step(w, gradient, hessian, ridge) -> np.ndarray:
    """One Newton step with an L2 penalty on all but the first weight."""
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    move = np.linalg.solve(hessian + np.diag(penalty), gradient + penalty * w)
    return w - move * min(1.0, 8.0 / max(1e-12, np.abs(move).max()))


def fit(x: np.ndarray, y: np.ndarray, ridge=1.0, steps=12) -> np.ndarray:
    w = np.zeros(x.shape[1])
    one = np.ones(len(y))
    for _ in range(steps):
        new = step(w, *parts(x, y, one, w), ridge)
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def fit_table(rows: DataFrame, design, sizes: list[int], start: list[np.ndarray], ridge=1.0, steps=5) -> list[np.ndarray]:
    """Several models at once over all `rows`.  design(batch) gives one (x, y, weight) per model.

    Every task adds up its rows; Spark adds the tasks' sums by position; the driver sees the sums only."""
    w = [s.copy() for s in start]
    edges = np.cumsum([0] + [n + n * n for n in sizes])

    def sums(batches, w=None):
        total = np.zeros(edges[-1])
        for b in batches:
            for k, (x, y, weight) in enumerate(design(b)):
                g, h = parts(x, y, weight, w[k])
                total[edges[k] : edges[k + 1]] += np.concatenate([g, h.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

    for _ in range(steps):
        now = [x.copy() for x in w]
        got = rows.mapInArrow(lambda batches, now=now: sums(batches, now), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(edges[-1])
        for r in got:
            total[r["at"]] = r["value"]
        for k, n in enumerate(sizes):
            part = total[edges[k] : edges[k + 1]]
            w[k] = step(w[k], part[:n], part[n:].reshape(n, n), ridge)
        if max(np.abs(a - b).max() for a, b in zip(w, now)) < 1e-4:
            break
    return w
