"""Penalised logistic regression for a whole grid at once: one aggregate of normal equations per round serves every setting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import stored

ROUNDS, SETTLED = 200, 1e-9


@dataclass(frozen=True)
class LinearModel:
    """Intercept and one coefficient per feature."""

    features: list[str]
    intercept: float
    coefficients: list[float]

    def margin(self) -> Column:
        out = F.lit(self.intercept)
        for f, c in zip(self.features, self.coefficients):
            out = out + F.lit(c) * F.col(f)
        return out

    def score(self) -> Column:
        return C.sigmoid(self.margin())

    def rows(self, spark: SparkSession) -> DataFrame:
        """The model as a table (position, feature, coefficient); the intercept has no feature."""
        values = [(0, None, self.intercept), *((i + 1, f, c) for i, (f, c) in enumerate(zip(self.features, self.coefficients)))]
        return spark.createDataFrame(values, "position int, feature string, coefficient double")

    @staticmethod
    def from_rows(table: DataFrame) -> LinearModel:
        first, *rest = table.orderBy("position").collect()
        return LinearModel([r["feature"] for r in rest], first["coefficient"], [r["coefficient"] for r in rest])


def _sums(data: DataFrame, features: Sequence[str], weights: Sequence[tuple[float, float]], beta: np.ndarray, task: Sequence[int]
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted loss, gradient and curvature of every setting at its coefficients (settings x terms), from one pass.

    data holds the features and a label per task (y0, y1, ...); task is the one of each setting, weights are those of its
    classes. Each task of Spark adds up its rows for all settings and sends one number per cell, so what is shuffled
    depends on the settings and features only.
    """
    settings, terms = beta.shape
    i, j = np.triu_indices(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((settings, 1 + terms + len(i)))
        for batch in batches:
            x = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            every, labels = np.column_stack([np.ones(batch.num_rows), *x[: terms - 1]]), x[terms - 1 :]
            for k in sorted(set(task)):
                of, known = np.flatnonzero(np.equal(task, k)), ~np.isnan(labels[k])
                y, design = (labels[k], every) if known.all() else (labels[k][known], every[known])
                w = np.where(y == 1, weights[k][1], weights[k][0])
                eta = design @ beta[of].T
                p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                total[of, 0] += (w[:, None] * (np.logaddexp(0, eta) - y[:, None] * eta)).sum(0)
                total[of, 1 : 1 + terms] += (w[:, None] * (p - y[:, None])).T @ design
                curve = w[:, None] * p * (1 - p)
                for n, s in enumerate(of):
                    total[s, 1 + terms :] += (design.T @ (curve[:, n : n + 1] * design))[i, j]
        cells = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], ["cell", "v"])

    labels = [f"y{k}" for k in range(len(weights))]
    found = data.select(*features, *labels).mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    total = np.zeros((settings, 1 + terms + len(i)))
    for r in found.collect():
        total.flat[r["cell"]] = r["v"]
    curve = np.zeros((settings, terms, terms))
    curve[:, i, j] = curve[:, j, i] = total[:, 1 + terms :]
    return total[:, 0], total[:, 1 : 1 + terms], curve


def newton_target(kind: str, c: float, beta: np.ndarray, gradient: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """The coefficients that minimise c times the quadratic model of the loss plus the penalty; the intercept is free.

    l2: half the squared coefficients, by one solution; l1: their absolute sum, by coordinate descent.
    """
    g, h = c * gradient, c * curve
    if kind == "l2":
        free = np.append(0.0, np.ones(len(beta) - 1))
        return beta - np.linalg.lstsq(h + np.diag(free), g + free * beta, rcond=None)[0]
    out, slope = beta.copy(), g.copy()
    for _ in range(10_000):
        most = 0.0
        for k in range(len(beta)):
            if h[k, k] <= 0:
                continue
            best = out[k] - slope[k] / h[k, k]
            if k:
                best = np.sign(best) * max(abs(best) - 1 / h[k, k], 0.0)
            step = best - out[k]
            out[k], slope = best, slope + h[:, k] * step
            most = max(most, abs(step))
        if most < SETTLED / 10:
            break
    return out


def _penalty(kind: str, beta: np.ndarray) -> float:
    return float((beta[1:] ** 2).sum() / 2 if kind == "l2" else np.abs(beta[1:]).sum())


def fit_grid(train: DataFrame, features: Sequence[str], settings: Sequence[tuple[str, float]], label: str = "y",
             weights: tuple[float, float] = (1.0, 1.0), rounds: int = ROUNDS) -> list[LinearModel]:
    """A model for each (penalty, C): C times the weighted log loss plus the penalty, smallest; see `fit_grids`."""
    return fit_grids(train, features, settings, {label: weights}, rounds)[label]


def fit_grids(train: DataFrame, features: Sequence[str], settings: Sequence[tuple[str, float]],
              weights: dict[str, tuple[float, float]], rounds: int = ROUNDS) -> dict[str, list[LinearModel]]:
    """A model for each label and (penalty, C): C times the weighted log loss plus the penalty, smallest.

    Newton rounds for all labels and settings together, over rows that are written once; a step that makes a setting
    worse is halved. weights are those of the classes 0 and 1 of every label. Rows with a null feature don't count, nor
    do those with a null label for that label.
    """
    rows = train.select(*[F.col(f).cast("double").alias(f) for f in features],
                        *[F.col(c).cast("int").alias(f"y{k}") for k, c in enumerate(weights)])
    data = stored(rows.dropna(subset=list(features)), "design")
    task, grid = [k for k in range(len(weights)) for _ in settings], [*settings] * len(weights)
    beta = np.zeros((len(grid), len(features) + 1))
    held, best = beta.copy(), np.full(len(grid), np.inf)
    open_ = np.ones(len(grid), bool)
    for _ in range(rounds):
        loss, gradient, curve = _sums(data, features, list(weights.values()), beta[open_], np.array(task)[open_].tolist())
        for n, s in enumerate(np.flatnonzero(open_)):
            kind, c = grid[s]
            now = c * loss[n] + _penalty(kind, beta[s])
            if now > best[s] * (1 + 1e-12):
                beta[s] = (beta[s] + held[s]) / 2
                continue
            held[s], best[s] = beta[s], now
            beta[s] = newton_target(kind, c, held[s], gradient[n], curve[n])
            open_[s] = np.abs(beta[s] - held[s]).max() >= SETTLED * max(1.0, np.abs(beta[s]).max())
        if not open_.any():
            break
    models = [LinearModel(list(features), float(b[0]), b[1:].tolist()) for b in beta]
    return {label: models[k * len(settings) : (k + 1) * len(settings)] for k, label in enumerate(weights)}
