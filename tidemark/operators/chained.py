"""Iterative imputation by chained linear regressions, fitted from Gram matrices and stored as coefficients."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

ROUNDS = 10
#: A predictor whose variance, given those before it, is below this share of its own adds nothing and is left out.
TOLERANCE = 1e-9


@dataclass
class Chain:
    """Columns in their order, the incomplete ones in the order they are predicted, and what was fitted.

    steps[r][i] belongs to round r and the i-th target: an intercept, then a coefficient for each column (zero for the
    target itself).
    """

    columns: list[str]
    targets: list[str]
    start: dict[str, float]
    steps: list[list[list[float]]] = field(default_factory=list)

    def fill(self, x: np.ndarray) -> np.ndarray:
        """Rows with NaN for what is absent: means first, then every round's regressions in turn."""
        absent = np.isnan(x)
        x = np.where(absent, [self.start[c] for c in self.columns], x)
        at = [self.columns.index(c) for c in self.targets]
        rows = [np.flatnonzero(absent[:, j]) for j in at]
        for step in self.steps:
            for j, who, b in zip(at, rows, step):
                if len(who):
                    x[who, j] = b[0] + x[who] @ np.array(b[1:])
        return x


def sweep(a: np.ndarray, k: int) -> np.ndarray:
    """The sweep operator: regress everything on variable k, given the Gram matrix of all."""
    d = a[k, k]
    out = a - np.outer(a[:, k], a[k, :]) / d
    out[:, k] = a[:, k] / d
    out[k, :] = a[k, :] / d
    out[k, k] = -1.0 / d
    return out


def regression(gram: np.ndarray, target: int) -> np.ndarray:
    """Coefficients of the target on all other variables, from their Gram matrix with the constant first."""
    a, used = gram.copy(), []
    for k in range(len(gram)):
        if k != target and a[k, k] > TOLERANCE * max(gram[k, k], 1e-300):
            a = sweep(a, k)
            used.append(k)
    out = np.zeros(len(gram))
    out[used] = a[used, target]
    return out


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Columns as doubles; null becomes NaN, and so does what isn't finite."""
    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
    x[~np.isfinite(x)] = np.nan
    return x


def gram_cells(train: DataFrame, chain: Chain, scale: dict[str, float]) -> DataFrame:
    """target, i, j, v: sums of products of the filled and standardised columns, the constant being column 0.

    target -1 covers all rows, target t those rows in which the t-th incomplete column is absent, so their difference
    is the Gram matrix of the rows a regression learns from. Each task adds up its rows and sends one number per
    cell; cells are summed by their place, so nothing grows with the rows.
    """
    centre = np.array([chain.start[c] for c in chain.columns])
    spread = np.array([scale[c] for c in chain.columns])
    at = [chain.columns.index(c) for c in chain.targets]
    size = len(chain.columns) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(at) + 1, size, size))
        for batch in batches:
            x = _matrix(batch)
            z = np.column_stack([np.ones(len(x)), (chain.fill(x) - centre) / spread])
            total[0] += z.T @ z
            for t, j in enumerate(at):
                lost = z[np.isnan(x[:, j])]
                total[t + 1] += lost.T @ lost
        i, j = np.triu_indices(size)
        for t in range(len(at) + 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), t - 1, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 pa.array(total[t][i, j])], ["target", "i", "j", "v"])

    rows = train.select(*[F.col(c).cast("double").alias(c) for c in chain.columns])
    return rows.mapInArrow(run, "target int, i int, j int, v double").groupBy("target", "i", "j").agg(F.sum("v").alias("v"))


def fit_chain(train: DataFrame, profile: dict, columns: Sequence[str], rounds: int = ROUNDS) -> Chain:
    """The chain fitted on training rows; profile has rows, present, mean and var of each column.

    Absent values start as means. In each round every incomplete column is regressed on all the others over the rows
    in which it is present, all from the Gram matrices of one pass; then the columns with fewest gaps are filled
    first, each seeing what was filled before it. Every pass starts from the stored rows and replays the chain, so
    there is no state between passes and a lost executor costs its tasks only. A column is never a regression's
    predictor if the others determine it.
    """
    columns = list(columns)
    gaps = {c: profile[c]["rows"] - profile[c]["present"] for c in columns}
    targets = sorted((c for c in columns if gaps[c]), key=lambda c: (gaps[c], columns.index(c)))
    chain = Chain(columns, targets, {c: profile[c]["mean"] for c in columns})
    scale = {c: (profile[c]["var"] or 0.0) ** 0.5 or 1.0 for c in columns}
    size = len(columns) + 1
    for _ in range(rounds if targets else 0):
        total = np.zeros((len(targets) + 1, size, size))
        for r in gram_cells(train, chain, scale).collect():
            total[r["target"] + 1, r["i"], r["j"]] = total[r["target"] + 1, r["j"], r["i"]] = r["v"]
        step = []
        for t, c in enumerate(targets):
            at = columns.index(c) + 1
            b = regression(total[0] - total[t + 1], at)
            slopes = [float(b[k + 1] * scale[c] / scale[o]) for k, o in enumerate(columns)]
            level = chain.start[c] + b[0] * scale[c] - sum(s * chain.start[o] for s, o in zip(slopes, columns))
            step.append([float(level), *slopes])
        chain.steps.append(step)
    return chain


def filled(chain: Chain) -> Column:
    """A struct of the chain's targets, filled, from a row that has its columns."""
    columns, targets = chain.columns, chain.targets

    @F.pandas_udf(", ".join(f"t{i} double" for i in range(len(targets))))
    def fill(*values: pd.Series) -> pd.DataFrame:
        x = chain.fill(np.column_stack([v.to_numpy(float) for v in values]))
        return pd.DataFrame({f"t{i}": x[:, columns.index(c)] for i, c in enumerate(targets)})

    return fill(*[C.finite_or_null(F.col(c).cast("double")) for c in columns])
