"""Score calibration: Platt scaling and isotonic regression, fitted on validation rows only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.binning import edges_at_or_below
from ..session import stored
from .asof import last_at_or_before
from .ranking import running_totals, split_points

# A fit has settled at steps below the first, and is singular at a determinant up to the second.
SETTLED, SINGULAR = 1e-6, 1e-12


@dataclass(frozen=True)
class Platt:
    """sigmoid(B + A * logit(p))."""

    A: float
    B: float
    eps: float = C.PROB_EPS


@dataclass(frozen=True)
class Isotonic:
    """Right-continuous steps as a table (x, y): y holds from its x up to the next; the first also below it."""

    knots: DataFrame


def distinct_scores(preds: DataFrame, y: str = "y_true", score: str = "y_score") -> DataFrame:
    """Rows and positives per distinct score; all a calibrator needs."""
    return (preds.where(F.col(score).isNotNull() & F.col(y).isNotNull())
            .groupBy(F.col(score).cast("double").alias("score"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos")))


def logistic_coefficients(counts: DataFrame, columns: Sequence[str], rounds: int = 50,
                          settled: float = SETTLED) -> list[float]:
    """Maximum-likelihood coefficients, intercept first, for rows of `n` trials with `pos` successes.

    Re-weighted least squares for any number of columns: a round is one aggregate of the normal equations of the
    working response, so the driver sees k * k + k sums. Columns that no longer determine a solution (all rows
    alike, or separated classes) end the rounds with the coefficients reached so far.
    """
    terms = [F.lit(1.0), *[F.col(c) for c in columns]]
    size, beta = len(terms), np.zeros(len(terms))
    for _ in range(rounds):
        eta = reduce(add, [F.lit(float(c)) * t for c, t in zip(beta, terms)])
        fitted = C.sigmoid(eta)
        spread = F.col("n") * fitted * (F.lit(1.0) - fitted)
        response = spread * eta + F.col("pos") - F.col("n") * fitted
        sums = [F.sum(spread * p * q) for p in terms for q in terms] + [F.sum(response * p) for p in terms]
        found = counts.agg(F.array(*sums).alias("sums")).first()["sums"]
        if found[0] is None:
            break
        normal = np.reshape(found[: size * size], (size, size))
        if not np.linalg.det(normal) > SINGULAR:
            break
        last, beta = beta, np.linalg.solve(normal, found[size * size :])
        if np.abs(beta - last).max() < settled:
            break
    return beta.tolist()


def fit_platt(preds: DataFrame, y: str = "y_true", score: str = "y_score") -> Platt:
    """Logistic regression of the label on the logit of the score, over the distinct scores and their counts."""
    data = distinct_scores(preds, y, score).select(C.logit("score").alias("x"), "n", "pos").persist()
    try:
        intercept, slope = logistic_coefficients(data, ["x"])
    finally:
        data.unpersist()
    return Platt(slope, intercept)


def apply_platt(p, prm: Platt) -> Column:
    return C.sigmoid(F.lit(prm.B) + F.lit(prm.A) * C.logit(p, prm.eps))


#: Neighbouring score ranges that one task pools together.
FAN_IN = 16


def pool(x: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over ordered blocks: first x, rows and positives of blocks whose rates strictly rise.

    Rates are compared as whole numbers, so equal ones always pool.
    """
    blocks: list[tuple[float, int, int]] = []
    for first, rows, hits in zip(x.tolist(), n.tolist(), pos.tolist()):
        while blocks and blocks[-1][2] * rows >= hits * blocks[-1][1]:
            first, r, h = blocks.pop()
            rows, hits = rows + r, hits + h
        blocks.append((first, rows, hits))
    out = np.array(blocks, dtype=object).reshape(-1, 3)
    return out[:, 0].astype(float), out[:, 1].astype(np.int64), out[:, 2].astype(np.int64)


def fit_isotonic(preds: DataFrame, y: str = "y_true", score: str = "y_score", splits: Sequence[float] | None = None) -> Isotonic:
    """Isotonic regression on distinct scores with their counts as weights, as a stored table of steps.

    Each score range is pooled by itself, then neighbouring ranges' blocks are pooled together, FAN_IN at a time:
    pooling is the same whatever was pooled before. Blocks are corners of a convex chain through whole points (rows,
    positives), so the last task sees about the 2/3 power of the rows, and nothing reaches the driver.
    """
    data = stored(distinct_scores(preds, y, score), "distinct-scores")
    edges = split_points(data, "score") if splits is None else list(splits)
    blocks = edges_at_or_below(data, "score", edges, "piece").select(
        "piece", F.col("score").alias("x"), F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"))

    def merge(table: pa.Table) -> pa.Table:
        x, n, pos = (table.column(c).to_numpy() for c in ("x", "n", "pos"))
        order = np.argsort(x, kind="stable")
        x, n, pos = pool(x[order], n[order], pos[order])
        return pa.table({"piece": pa.array(np.full(len(x), table.column("piece")[0].as_py(), np.int32)), "x": x, "n": n, "pos": pos})

    ranges = len(edges) + 1
    while True:
        blocks = blocks.groupBy("piece").applyInArrow(merge, "piece int, x double, n long, pos long")
        if ranges == 1:
            break
        blocks = blocks.withColumn("piece", F.floor(F.col("piece") / FAN_IN).cast("int"))
        ranges = -(-ranges // FAN_IN)
    return Isotonic(stored(blocks.select("x", (F.col("pos") / F.col("n")).alias("y")), "knots"))


def apply_isotonic(df: DataFrame, score: str, prm: Isotonic, out: str) -> DataFrame:
    """The step at each score, by an as-of join with the table of steps."""
    return last_at_or_before(df, score, prm.knots, "x", "y", out)


def calibrated_scores(preds: DataFrame, platt: Platt | None, isotonic: Isotonic | None,
                      score: str = "y_score") -> DataFrame:
    """(subject_id, y_true, y_score_raw, y_score_platt, y_score_isotonic)."""
    keep = [c for c in preds.columns if c != score]
    out = preds.select(*keep, F.col(score).cast("double").alias("y_score_raw"))
    if platt is not None:
        out = out.withColumn("y_score_platt", apply_platt("y_score_raw", platt))
    if isotonic is not None:
        out = apply_isotonic(out, "y_score_raw", isotonic, "y_score_isotonic")
    return out


def best_variant(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The variant with the lowest Brier score (name order on ties)."""
    return metrics.groupBy(*(keys or [])).agg(
        F.min_by("variant", F.struct("brier", "variant")).alias("variant"), F.min("brier").alias("brier"))


def parameter_rows(spark: SparkSession, platt: Platt | None, isotonic: Isotonic | None) -> DataFrame:
    """Calibrator parameters as a table (method, position, x, y); Platt holds A in x and B in y."""
    schema = "method string, position long, x double, y double"
    rows = spark.createDataFrame([("platt", 0, platt.A, platt.B)] if platt is not None else [], schema)
    if isotonic is None:
        return rows
    placed = running_totals(isotonic.knots, [], "x", {"n": F.lit(1), "y": F.col("y")})
    return rows.unionByName(placed.select(F.lit("isotonic").alias("method"), (F.col("n_to") - 1).alias("position"), "x", "y"))


def from_parameter_rows(table: DataFrame) -> tuple[Platt | None, Isotonic | None]:
    """The calibrators of a stored parameter table; None for a method that it lacks."""
    found = table.where("method = 'platt'").select("x", "y").first()
    knots = table.where("method = 'isotonic'").select("x", "y")
    return None if found is None else Platt(found["x"], found["y"]), None if knots.isEmpty() else Isotonic(knots)


def is_finite(prm: Platt) -> bool:
    return math.isfinite(prm.A) and math.isfinite(prm.B)
