"""MLlib classifiers: grids selected on validation rows, scoring, importances, persistence."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import stored
from .evaluate import metrics
from .logistic import LinearModel, fit_grids

# The full search grids.
LOGISTIC_GRID = [("l2", c) for c in (0.01, 0.1, 1.0, 10.0)] + [("l1", c) for c in (0.01, 0.1, 1.0)]
FOREST_GRID = [(n, d, m) for n in (500, 1000) for d in (30, 6, 10) for m in (1, 5)]
BOOSTED_GRID = [(eta, d, s, f) for eta in (0.01, 0.05, 0.1) for d in (3, 5, 7) for s in (0.8, 1.0)
                for f in (0.6, 0.8, 1.0)]


@dataclass
class Fitted:
    """A selected model, its setting and its validation score."""

    model: Model | LinearModel
    setting: tuple
    val_score: float
    features: list[str]


def packed(df: DataFrame, features: Sequence[str], label: str = "y") -> DataFrame:
    """Vector column and integer label; rows with a null feature are an error when read."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df) \
        .withColumn("label", F.col(label).cast("double"))


def class_balance(df: DataFrame, label: str = "y") -> DataFrame:
    """One row: n, positives, positive rate, balanced class weights and neg/pos ratio."""
    y = F.col(label).cast("int")
    n, pos = F.count(y), F.sum(y)
    neg = n - pos
    return df.agg(
        n.alias("n"), pos.alias("n_pos"), (pos / n).alias("pos_rate"),
        (n / (F.lit(2.0) * F.nullif(neg, F.lit(0)))).alias("weight_neg"),
        (n / (F.lit(2.0) * F.nullif(pos, F.lit(0)))).alias("weight_pos"),
        F.when(pos > 0, neg / F.greatest(F.lit(1), pos)).otherwise(1.0).alias("neg_per_pos"))


def with_balanced_weight(df: DataFrame, label: str = "y") -> tuple[DataFrame, float]:
    """Rows with their class weight `w`, and the total weight."""
    b = class_balance(df, label).first()
    w = F.when(F.col(label).cast("int") == 1, F.lit(b["weight_pos"])).otherwise(F.lit(b["weight_neg"]))
    return df.withColumn("w", w), float(b["n"])


def score(model: Model | LinearModel, df: DataFrame, features: Sequence[str], label: str = "y", ids: Sequence[str] = ("subject_id",)
          ) -> DataFrame:
    """(ids, y_true, y_score): probability of class 1. Scores of an MLlib model are written once, as what follows reads
    them several times at once."""
    if isinstance(model, LinearModel):
        return df.select(*ids, F.col(label).cast("int").alias("y_true"), model.score().alias("y_score"))
    out = model.transform(packed(df, features, label)).select(
        *ids, F.col(label).cast("int").alias("y_true"), vector_to_array("probability")[1].alias("y_score"))
    return stored(out, "scores")


def score_from_margin(df: DataFrame, margin: str) -> DataFrame:
    return df.withColumn("y_score", C.sigmoid(margin))


def validation_scores(models: Iterable[Model], val: DataFrame, features: Sequence[str], label: str = "y"
                      ) -> DataFrame:
    """AUROC and AUPRC of every candidate in one run over the validation rows."""
    long = None
    for i, m in enumerate(models):
        s = score(m, val, features, label).select("y_true", F.lit(i).alias("candidate"),
                                                  F.col("y_score").alias("score"))
        long = s if long is None else long.unionByName(s)
    return metrics(long, ["candidate"])


def pick_best(models: list[Model], settings: list[tuple], val: DataFrame, features: Sequence[str],
              metric: str = "auprc", label: str = "y") -> Fitted:
    """Highest validation metric; the first setting wins ties."""
    rows = {r["candidate"]: r[metric] for r in validation_scores(models, val, features, label).collect()}
    best = max(range(len(models)), key=lambda i: (rows[i] if rows[i] is not None else float("-inf"), -i))
    return Fitted(models[best], settings[best], rows[best], list(features))


def fit_logistic(train: DataFrame, val: DataFrame, features: Sequence[str], label: str = "y",
                 metric: str = "auprc", grid: Sequence[tuple] = tuple(LOGISTIC_GRID), max_iter: int = 200) -> Fitted:
    """Balanced logistic regression, all settings of the grid in one run of rounds."""
    return _fit_labels(train, val, features, [label], metric, grid, max_iter)[label]


def _fit_labels(train: DataFrame, val: DataFrame, features: Sequence[str], labels: Sequence[str], metric: str = "auprc",
                grid: Sequence[tuple] = tuple(LOGISTIC_GRID), max_iter: int = 200) -> dict[str, Fitted]:
    """`fit_logistic` for several labels, all in the same rounds."""
    weights = {}
    for label in labels:
        b = class_balance(train, label).first()
        weights[label] = (b["weight_neg"] or 1.0, b["weight_pos"] or 1.0)
    models = fit_grids(train, features, grid, weights, max_iter)
    return {t: pick_best(models[t], list(grid), val, features, metric, t) for t in weights}


def fit_forest(train: DataFrame, val: DataFrame, features: Sequence[str], label: str = "y",
               metric: str = "auprc", grid: Sequence[tuple] = tuple(FOREST_GRID), seed: int = 42) -> Fitted:
    """Balanced random forest; unlimited depth is MLlib's maximum of 30.

    The packed rows, read a few times a fit, are kept on disk: MLlib keeps binned rows of its own, which it reads for
    every level of the trees, and those need the memory.
    """
    weighted, _ = with_balanced_weight(train, label)
    data = packed(weighted, features, label).select("features", "label", "w").persist(StorageLevel.DISK_ONLY)
    try:
        models = [RandomForestClassifier(numTrees=n, maxDepth=d, minInstancesPerNode=m, weightCol="w", seed=seed,
                                         featureSubsetStrategy="sqrt").fit(data) for n, d, m in grid]
    finally:
        data.unpersist()
    return pick_best(models, list(grid), val, features, metric, label)


def fit_boosted(train: DataFrame, val: DataFrame, features: Sequence[str], label: str = "y",
                metric: str = "auprc", grid: Sequence[tuple] = tuple(BOOSTED_GRID), rounds: int = 1000,
                tolerance: float = 1e-4, seed: int = 42) -> Fitted:
    """Gradient-boosted trees weighted neg/pos, stopped early on the validation rows."""
    b = class_balance(train, label).first()

    def part(df: DataFrame, held_out: bool) -> DataFrame:
        w = F.when(F.col(label).cast("int") == 1, F.lit(float(b["neg_per_pos"]))).otherwise(F.lit(1.0))
        return packed(df.withColumn("w", w), features, label) \
            .select("features", "label", "w", F.lit(held_out).alias("held_out"))

    data = part(train, False).unionByName(part(val, True)).persist()
    try:
        models = [GBTClassifier(stepSize=eta, maxDepth=d, subsamplingRate=s, featureSubsetStrategy=str(f),
                                maxIter=rounds, weightCol="w", validationIndicatorCol="held_out",
                                validationTol=tolerance, seed=seed).fit(data) for eta, d, s, f in grid]
    finally:
        data.unpersist()
    return pick_best(models, list(grid), val, features, metric, label)


def native_importances(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """(feature, value, kind, derived, derived_value): coefficients with odds ratios, or tree importances."""
    m = fitted.model
    if isinstance(m, LinearModel):
        values = spark.createDataFrame(list(zip(m.features, m.coefficients)), "feature string, value double")
        return values.select("*", F.lit("coefficient").alias("kind"), F.lit("odds_ratio").alias("derived"),
                             F.exp("value").alias("derived_value"))
    kind = "boosted_importance" if "GBT" in type(m).__name__ else "gini_importance"
    values = spark.createDataFrame(
        [(f, float(v)) for f, v in zip(fitted.features, m.featureImportances.toArray())],
        "feature string, value double")
    return values.select("*", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("derived"),
                         F.lit(None).cast("double").alias("derived_value"))


def fit_two_tasks(train: DataFrame, val: DataFrame, features: Sequence[str], tasks: Sequence[str],
                  metric: str = "auprc", **kw) -> tuple[dict[str, Fitted], float]:
    """One model per task over shared features, and the mean of their validation scores."""
    fitted = _fit_labels(train, val, features, list(dict.fromkeys(tasks)), metric, **kw)
    return fitted, sum(f.val_score for f in fitted.values()) / len(fitted)


def save_model(spark: SparkSession, model: Model | LinearModel, path: str) -> None:
    if isinstance(model, LinearModel):
        model.rows(spark).write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)


def load_linear(spark: SparkSession, path: str) -> LinearModel:
    return LinearModel.from_rows(spark.read.parquet(path))
