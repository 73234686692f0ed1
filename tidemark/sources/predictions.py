"""Prediction tables in three layouts, read into one long shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _variant_name(column: str) -> str:
    return column.removeprefix("y_score_") if column != "y_score" else "y_score"


def long_predictions(df: DataFrame, task: str | None = None,
                     variants: Sequence[str] | None = None) -> DataFrame:
    """(subject_id, y_true, variant, score) from a baseline, calibrated or multi-task table.

    `variants` picks score columns; an unknown one is an error.
    """
    cols = df.columns
    if task is not None:
        y, scores = f"{task}_y_true", [f"{task}_y_score"]
    else:
        y, scores = "y_true", [c for c in cols if c.startswith("y_score")]
    if y not in cols or not scores or any(c not in cols for c in scores):
        raise KeyError(f"not a prediction table: needs {y} and {scores or 'y_score*'}")
    name_of = {c: _variant_name(c) if task is None else "y_score" for c in scores}
    if variants is not None:
        absent = [v for v in variants if v not in cols]
        if absent:
            raise KeyError(f"score columns not found: {absent}")
        scores = list(variants)
        name_of = {c: _variant_name(c) for c in scores}
    base = df.select("subject_id", F.col(y).cast("int").alias("y_true"),
                     *[F.col(c).cast("double").alias(name_of[c]) for c in scores])
    return base.unpivot(["subject_id", "y_true"], [name_of[c] for c in scores], "variant", "score")


def wide_task_predictions(scored: dict[str, DataFrame]) -> DataFrame:
    """Join per-task (subject_id, y_true, y_score) tables into the multi-task layout."""
    out = None
    for task, df in scored.items():
        one = df.select("subject_id", F.col("y_true").alias(f"{task}_y_true"),
                        F.col("y_score").alias(f"{task}_y_score"))
        out = one if out is None else out.join(one, "subject_id")
    return out
