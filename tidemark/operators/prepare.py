"""Imputation and scaling, fitted on the training fold and applied to every fold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from .chained import ROUNDS, Chain, filled, fit_chain
from .ranking import first_rows, quantiles

# Limits of the quantile scaler's normal output, the normal quantiles of 1e-7 and 1 - 1e-7.
NORMAL_LIMIT = 5.199337582605575


@dataclass
class Preparation:
    """Everything fitted on the training fold; a few numbers per column."""

    columns: list[str]
    indicators: list[str]
    dropped_empty: list[str]
    dropped_constant: list[str]
    binary: list[str]
    fill: dict[str, float]
    scaler: str = "none"
    centre: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    knots: dict[str, list[float]] = field(default_factory=dict)
    chain: Chain | None = None

    @property
    def output(self) -> list[str]:
        return [c for c in [*self.columns, *self.indicators]
                if c not in self.dropped_empty and c not in self.dropped_constant]


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value) rows of the given columns; infinities and NaN count as absent."""
    return df.select(*[C.finite_or_null(F.col(c).cast("double")).alias(c) for c in columns]) \
        .unpivot([], list(columns), "feature", "value")


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, values, range, mean, population variance, and whether only 0 and 1 occur.

    One aggregate over an unpivot; a row per column crosses the shuffle from each task.
    """
    v = F.col("value")
    return long_values(df, columns).groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("present"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.avg(v).alias("mean"), F.var_pop(v).alias("var"),
        F.coalesce(F.bool_and(F.when(v.isNotNull(), v.isin(0.0, 1.0))), F.lit(False)).alias("binary"))


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("*", *[
        C.finite_or_null(F.col(c).cast("double")).isNull().cast("double").alias(f"{c}__mis") for c in columns])


def medians(train: DataFrame, columns: Sequence[str], splits=None) -> DataFrame:
    """(feature, fill): exact median of each column."""
    q = quantiles(long_values(train, columns), ["feature"], "value", [0.5], splits)
    return q.select("feature", F.col("q")[0].alias("fill"))


def modes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, fill): most frequent value of each column, the smallest on ties."""
    counts = long_values(train, columns).where("value is not null").groupBy("feature", "value").count()
    best = first_rows(counts, ["feature"], [-F.col("count"), F.col("value")])
    return best.select("feature", F.col("value").alias("fill"))


def fit(train: DataFrame, columns: Sequence[str], imputer: str = "median", scaler: str = "standard",
        add_indicators: bool = True, keep_binary: bool = True, splits=None, rounds: int = ROUNDS) -> Preparation:
    """Fit imputer and scaler on training rows. Per pass, one short row per column is collected; the iterative imputer
    also collects one number per pair of columns and incomplete column in each of its rounds."""
    columns = list(columns)
    prof = {r["feature"]: r for r in column_profile(train, columns).collect()}
    with_null = [c for c in columns if prof[c]["present"] < prof[c]["rows"]] if add_indicators else []
    empty = [c for c in columns if prof[c]["present"] == 0]
    constant = [c for c in columns if prof[c]["present"] > 0 and prof[c]["low"] == prof[c]["high"]]
    constant += [f"{c}__mis" for c in with_null if c in empty]
    used = [c for c in columns if c not in empty and c not in constant]
    chain = None
    if imputer == "median":
        fill = {r["feature"]: r["fill"] for r in medians(train, used, splits).collect()}
    elif imputer == "most_frequent":
        fill = {r["feature"]: r["fill"] for r in modes(train, used).collect()}
    elif imputer == "iterative":
        chain = fit_chain(train, prof, used, rounds)
        fill = dict(chain.start)
    else:
        raise ValueError(f"unknown imputer {imputer!r}")
    prep = Preparation(columns, [f"{c}__mis" for c in with_null], empty, constant,
                       [c for c in used if prof[c]["binary"]] if keep_binary else [], fill, chain=chain)
    fit_scaler(prep, train, prof, scaler, splits)
    return prep


def fit_scaler(prep: Preparation, train: DataFrame, prof: dict, scaler: str, splits=None) -> None:
    """Centre and scale of the imputed training columns."""
    prep.scaler = scaler
    todo = [c for c in prep.output if c not in prep.binary]
    if scaler == "none" or not todo:
        return
    if scaler == "standard" and prep.chain:
        for r in column_profile(impute(train, prep), todo).collect():
            prep.centre[r["feature"]], prep.scale[r["feature"]] = r["mean"], r["var"] ** 0.5 or 1.0
        return
    if scaler == "standard":
        # the mean and variance after filling follow from those before it: no second pass
        for c in todo:
            src = c.removesuffix("__mis") if c in prep.indicators else c
            p = prof[src]
            n, k = p["rows"], p["rows"] - p["present"]
            if c in prep.indicators:
                mean = k / n
                var = mean * (1.0 - mean)
            else:
                f = prep.fill[c]
                mean = (p["present"] * p["mean"] + k * f) / n
                var = (p["present"] * (p["var"] + (p["mean"] - mean) ** 2) + k * (f - mean) ** 2) / n
            prep.centre[c], prep.scale[c] = mean, var ** 0.5 or 1.0
        return
    filled = long_values(impute(train, prep), todo)
    if scaler == "robust":
        for r in quantiles(filled, ["feature"], "value", [0.25, 0.5, 0.75], splits).collect():
            lo, mid, hi = r["q"]
            prep.centre[r["feature"]], prep.scale[r["feature"]] = mid, (hi - lo) or 1.0
        return
    if scaler == "quantile":
        rows = next(iter(prof.values()))["rows"]
        m = min(rows, 1000, max(10, rows // 2))
        probs = [i / (m - 1) for i in range(m)]
        for r in quantiles(filled, ["feature"], "value", probs, splits).collect():
            prep.knots[r["feature"]] = list(r["q"])
        return
    raise ValueError(f"unknown scaler {scaler!r}")


def impute(df: DataFrame, prep: Preparation) -> DataFrame:
    """Indicators, then fills; binary columns are rounded to 0 or 1. Other columns are kept as ids.

    A column that had no gap in training is filled with its training mean before the chain of an iterative imputer."""
    rest = [c for c in df.columns if c not in prep.columns]
    chained = prep.chain.targets if prep.chain else []
    if chained:
        df = df.withColumn("__chain", filled(prep.chain))
    out = [F.col(c) for c in rest]
    for c in prep.output:
        if c in prep.indicators:
            src = c.removesuffix("__mis")
            value = C.finite_or_null(F.col(src).cast("double")).isNull().cast("double")
        else:
            value = C.finite_or_null(F.col(c).cast("double"))
            if c in chained:
                value = F.coalesce(value, F.col("__chain")[f"t{chained.index(c)}"])
            elif c in prep.fill:
                value = F.coalesce(value, F.lit(prep.fill[c]))
            if c in prep.binary:
                value = (F.coalesce(value, F.lit(0.0)) >= 0.5).cast("double")
        out.append(value.alias(c))
    return df.select(*out)


def apply(df: DataFrame, prep: Preparation) -> DataFrame:
    """Impute and scale any fold with the fitted parameters; no shuffle, no join."""
    out = impute(df, prep)
    if prep.scaler == "quantile":
        return quantile_normal(out, prep.knots) if prep.knots else out
    return out.select(*[
        ((F.col(c) - F.lit(prep.centre[c])) / F.lit(prep.scale[c])).alias(c) if c in prep.scale else F.col(c)
        for c in out.columns])


def normal_scores(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Normal quantiles of the levels that values have among sorted knots; NaN stays.

    Between knots the level is interpolated; on a repeated knot it is the middle of its levels.
    """
    edges, first, counts = np.unique(knots, return_index=True, return_counts=True)
    lo, hi = first / (len(knots) - 1), (first + counts - 1) / (len(knots) - 1)
    k = np.clip(np.searchsorted(edges, x, side="right") - 1, 0, max(len(edges) - 2, 0))
    after = np.minimum(k + 1, len(edges) - 1)
    gap = np.where(edges[after] > edges[k], edges[after] - edges[k], 1.0)
    level = np.where(x == edges[k], (lo[k] + hi[k]) / 2, hi[k] + (x - edges[k]) / gap * (lo[after] - hi[k]))
    level = np.where(x <= edges[0], 0.0, np.where(x >= edges[-1], 1.0, level))
    z = C.inverse_normal_values(np.clip(level, 1e-7, 1 - 1e-7))
    z = np.where(level <= 1e-7, -NORMAL_LIMIT, np.where(level >= 1 - 1e-7, NORMAL_LIMIT, z))
    return np.where(np.isnan(x), np.nan, z)


def quantile_normal(df: DataFrame, knots: dict[str, Sequence[float]]) -> DataFrame:
    """Map columns through the empirical distribution of their knots to a standard normal.

    The knots, at most 1,000 a column, are sent to the tasks and looked up there, so the plan names the columns and
    nothing else.
    """
    columns = list(knots)
    held = df.sparkSession.sparkContext.broadcast({c: np.array(knots[c], float) for c in columns})

    @F.pandas_udf(", ".join(f"q{i} double" for i in range(len(columns))))
    def scores(*values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({f"q{i}": normal_scores(v.to_numpy(float), held.value[c]) for i, (c, v) in enumerate(zip(columns, values))})

    out = df.withColumn("__q", scores(*[F.col(c).cast("double") for c in columns]))
    return out.withColumns({c: F.col("__q")[f"q{i}"] for i, c in enumerate(columns)}).drop("__q")


def parameter_rows(spark: SparkSession, prep: Preparation) -> DataFrame:
    """Fitted parameters as a table, one row per input or indicator column, in column order."""
    rows = []
    for i, c in enumerate([*prep.columns, *prep.indicators]):
        state = "empty" if c in prep.dropped_empty else "constant" if c in prep.dropped_constant else "kept"
        rows.append((i, c, state, c in prep.binary, c in prep.indicators, prep.fill.get(c),
                     prep.centre.get(c), prep.scale.get(c), prep.knots.get(c), *_links(prep.chain, c)))
    return spark.createDataFrame(
        rows, "position int, feature string, state string, is_binary boolean, is_indicator boolean, "
              "fill double, centre double, scale double, knots array<double>, turn int, links array<array<double>>")


def _links(chain: Chain | None, column: str) -> tuple[int | None, list[list[float]] | None]:
    """Turn of a column in the chain (counted from 0) and its coefficients by round; -1 for a column that is only used."""
    if chain is None or column not in chain.columns:
        return None, None
    if column not in chain.targets:
        return -1, None
    turn = chain.targets.index(column)
    return turn, [step[turn] for step in chain.steps]


def _chain_of(rows: list) -> Chain | None:
    used = [r for r in rows if r["turn"] is not None]
    if not used:
        return None
    turns = sorted((r for r in used if r["turn"] >= 0), key=lambda r: r["turn"])
    steps = [[list(b) for b in step] for step in zip(*[r["links"] for r in turns])]
    return Chain([r["feature"] for r in used], [r["feature"] for r in turns], {r["feature"]: r["fill"] for r in used}, steps)


def from_parameter_rows(table: DataFrame, scaler: str) -> Preparation:
    """Rebuild the fitted object from its stored table (a row per column)."""
    rows = table.orderBy("position").collect()
    kept = [r for r in rows if r["state"] == "kept"]
    return Preparation(
        columns=[r["feature"] for r in rows if not r["is_indicator"]],
        indicators=[r["feature"] for r in rows if r["is_indicator"]],
        dropped_empty=[r["feature"] for r in rows if r["state"] == "empty"],
        dropped_constant=[r["feature"] for r in rows if r["state"] == "constant"],
        binary=[r["feature"] for r in rows if r["is_binary"]],
        fill={r["feature"]: r["fill"] for r in kept if r["fill"] is not None},
        scaler=scaler,
        centre={r["feature"]: r["centre"] for r in kept if r["centre"] is not None},
        scale={r["feature"]: r["scale"] for r in kept if r["scale"] is not None},
        knots={r["feature"]: list(r["knots"]) for r in kept if r["knots"] is not None},
        chain=_chain_of(rows),
    )
