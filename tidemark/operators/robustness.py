"""Scenario matrices, external validation and scenario result tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .calibrate import Isotonic, Platt, calibrated_scores
from .evaluate import confusion_at, metrics_with_ece
from .lookups import with_row
from ..sources.predictions import long_predictions


def ablate(df: DataFrame, features: Sequence[str], strategy: str = "mean",
           fit_on: DataFrame | None = None) -> DataFrame:
    """Listed features set to 0, or to their mean over `fit_on` (the frame itself by default)."""
    features = [f for f in features if f in df.columns and f != "subject_id"]
    if strategy == "zero":
        return df.withColumns({f: F.lit(0.0) for f in features})
    means = (fit_on if fit_on is not None else df).agg(*[F.avg(f).alias(f"__m_{f}") for f in features])
    out = with_row(df, means).withColumns({f: F.coalesce(f"__m_{f}", F.lit(0.0)) for f in features})
    return out.drop(*[f"__m_{f}" for f in features])


def add_noise(df: DataFrame, features: Sequence[str], sigma: float, seed: int = 123,
              id_col: str = "subject_id") -> DataFrame:
    """x + sigma * sd * z with z keyed by (seed, column, id); a zero sd counts as 1."""
    sds = df.agg(*[F.stddev_pop(f).alias(f"__s_{f}") for f in features])
    moved = {}
    for f in features:
        sd = F.when(F.col(f"__s_{f}") == 0, 1.0).otherwise(F.col(f"__s_{f}"))
        z = C.standard_normal(C.keyed_hash(seed, f, F.col(id_col)))
        moved[f] = F.col(f) + F.lit(float(sigma)) * sd * z
    return with_row(df, sds).withColumns(moved).drop(*[f"__s_{f}" for f in features])


def time_slice(by: str, time: str = "index_time"):
    return {"year": C.year_label, "quarter": C.quarter_label, "month": C.month_label}[by](time)


def matrix_scenarios(x: DataFrame, features: Sequence[str], ablations: Sequence[str] = (),
                     strategy: str = "mean", noise: Sequence[float] = (), seed: int = 123) -> DataFrame:
    """Base, ablated and noisy copies of the matrix, told apart by `scenario`; scored together."""
    out = x.withColumn("scenario", F.lit("base"))
    if ablations:
        name = f"ablate_{strategy}_{len(ablations)}"
        out = out.unionByName(ablate(x, ablations, strategy).withColumn("scenario", F.lit(name)))
    for s in noise:
        out = out.unionByName(add_noise(x, features, s, seed).withColumn("scenario", F.lit(f"noise_{s:g}")))
    return out


def scored_labels(scored: DataFrame, labels: DataFrame, label_cols: Sequence[str]) -> DataFrame:
    """Scores joined to several label columns, as rows (label, y_true). Join first, then evaluate."""
    cols = [C.binary_label(c).alias(c) for c in label_cols]
    rows = scored.join(labels.select("subject_id", *cols), "subject_id")
    keep = [c for c in rows.columns if c not in label_cols]
    return rows.unpivot(keep, list(label_cols), "label", "y_true")


def time_slice_rows(long: DataFrame, meta: DataFrame, by: str, time: str = "index_time") -> DataFrame:
    """Rows of each slice under the scenario name time_<by>_<slice>; one grouped run, no filter per slice."""
    name = F.concat(F.lit(f"time_{by}_"), time_slice(by, time))
    rows = long.join(meta.where(F.col(time).isNotNull()).select("subject_id", name.alias("scenario")), "subject_id")
    return rows


def scenario_rows(scored: DataFrame, labels: DataFrame, label_cols: Sequence[str], meta: DataFrame, by: str = "quarter") -> DataFrame:
    """Every scenario as rows (scenario, label, subject_id, y_true, score), to be evaluated in one run.

    scored has (scenario, subject_id, score). Matrix scenarios are judged by the first label; the base scores also by the
    other labels, and by the first label in each time slice.
    """
    rows = scored_labels(scored, labels, label_cols).where((F.col("scenario") == "base") | (F.col("label") == label_cols[0]))
    rows = rows.select("scenario", "label", "subject_id", "y_true", "score")
    base = rows.where((F.col("scenario") == "base") & (F.col("label") == label_cols[0])).drop("scenario")
    return rows.unionByName(time_slice_rows(base, meta, by).select(*rows.columns))


def scenario_results(long: DataFrame, thresholds: DataFrame | None = None, bins: int = 15,
                     splits=None) -> tuple[DataFrame, DataFrame | None]:
    """Metrics with ECE per (scenario, variant, label), and threshold rows when rules are given."""
    keys = ["scenario", "variant", "label"]
    table = metrics_with_ece(long, keys, bins, splits)
    return table, None if thresholds is None else confusion_at(long, thresholds, keys)


def external_scores(x: DataFrame, labels: DataFrame, label: str, rescore: Callable[[DataFrame], DataFrame],
                    platt: Platt | None = None, isotonic: Isotonic | None = None) -> DataFrame:
    """Score another cohort and apply stored calibrators; labels are joined before scoring."""
    y = labels.select("subject_id", C.binary_label(label).alias("y_true"))
    scored = rescore(x.join(y, "subject_id")).select("subject_id", "y_true", "y_score")
    return calibrated_scores(scored, platt, isotonic)


def external_validation(scores: DataFrame, thresholds: DataFrame | None = None, bins: int = 15, splits=None
                        ) -> tuple[DataFrame, DataFrame | None]:
    """Metrics per score variant, and confusion rows at the stored thresholds."""
    long = long_predictions(scores)
    table = metrics_with_ece(long, ["variant"], bins, splits)
    return table, None if thresholds is None else confusion_at(long, thresholds, ["variant"])
