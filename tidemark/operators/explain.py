"""Permutation importance and linear attribution."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import stored
from .evaluate import metrics
from .lookups import with_row
from .ranking import hash_positions

LOWER_IS_BETTER = {"brier", "logloss"}


def shuffled_rows(df: DataFrame, features: Sequence[str], repeats: int, seed: int = 42,
                  id_col: str = "subject_id") -> DataFrame:
    """The rows of every repeat with `shuffled`, an array of the features' values of another row.

    Each repeat puts the rows in one hashed order and turns it by a keyed number of places; a row receives the values
    of the row that many places on. So every feature is truly permuted, no row keeps its own values by position, and
    one join on (repeat, place) serves all features. The order depends on the seed and the ids only.
    """
    values = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    digest = C.keyed_hash(seed, "order", F.col("replicate"), F.col(id_col))
    placed = stored(hash_positions(rows.withColumn("__d", digest), ["replicate"], "__d", id_col).drop("__d"), "shuffled")
    turn = C.hash_word(C.keyed_hash(seed, "turn", F.col("replicate")))
    n = F.col("n_all")
    on = F.when(n > 1, 1 + turn % F.greatest(n - 1, F.lit(1))).otherwise(0)
    givers = placed.select("replicate", (F.pmod(F.col("pos") - 1 - on, n) + 1).alias("pos"), values.alias("shuffled"))
    return placed.join(givers, ["replicate", "pos"]).drop("pos", "n_all")


def permutation_importance(df: DataFrame, features: Sequence[str], rescore: Callable[[DataFrame], DataFrame],
                           metric: str = "auprc", repeats: int = 10, seed: int = 42,
                           id_col: str = "subject_id") -> DataFrame:
    """Mean and population sd of the metric drop when one column is shuffled.

    `df` holds the features, y_true and the base `score`. `rescore` turns rows carrying
    (feature, original, shuffled) into rows with a new `score`; all features and repeats go
    through it in one run, and what is shuffled after it is counts per distinct score.
    """
    df = stored(df, "scored")  # read for the order, the places, the shuffles and the base metric
    rows = shuffled_rows(df, features, repeats, seed, id_col)
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("original"),
                              F.col("shuffled")[i].alias("shuffled")) for i, f in enumerate(features)])
    swaps = rows.withColumn("__swap", F.explode(each)).drop("shuffled").select("*", "__swap.*").drop("__swap")
    changed = metrics(rescore(swaps).select("feature", "replicate", "y_true", "score"), ["feature", "replicate"])
    base = metrics(df.select("y_true", "score"), []).select(F.col(metric).alias("base"))
    sign = -1.0 if metric in LOWER_IS_BETTER else 1.0
    drop = with_row(changed, base).withColumn("drop", F.lit(sign) * (F.col("base") - F.col(metric)))
    return drop.groupBy("feature").agg(F.avg("drop").alias("perm_importance_mean"),
                                       F.stddev_pop("drop").alias("perm_importance_std"))


def linear_rescore(coefficients: dict[str, float], margin: str = "margin") -> Callable[[DataFrame], DataFrame]:
    """For a linear model a shuffle only moves the stored margin by coef * (new - old).

    The moved margin is rounded to 12 places, so rows that end with equal values tie again.
    """
    coef = F.lit(0.0)
    for f, v in coefficients.items():
        coef = F.when(F.col("feature") == f, F.lit(float(v))).otherwise(coef)
    moved = F.round(F.col(margin) + coef * (F.col("shuffled") - F.col("original")), 12)
    return lambda rows: rows.withColumn("score", C.sigmoid(moved))


def model_rescore(model, features: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """For any MLlib classifier: put the shuffled value in its column and score again."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def run(rows: DataFrame) -> DataFrame:
        swapped = rows.select("feature", "replicate", "y_true", *[
            F.when(F.col("feature") == f, F.col("shuffled")).otherwise(F.col(f)).alias(f) for f in features])
        vec = VectorAssembler(inputCols=list(features), outputCol="features").transform(swapped)
        scored = model.transform(vec).select("feature", "replicate", "y_true", vector_to_array("probability")[1].alias("score"))
        return stored(scored, "rescored")

    return run


def linear_attribution(df: DataFrame, coefficients: dict[str, float], background: DataFrame | None = None
                       ) -> DataFrame:
    """Mean |a|, mean a and sd |a| of a = coef * (x - background mean), per feature."""
    feats = list(coefficients)
    means = (background if background is not None else df).agg(*[F.avg(f).alias(f"__m_{f}") for f in feats])
    a = with_row(df.select(*feats), means).select(*[
        (F.lit(float(coefficients[f])) * (F.col(f) - F.col(f"__m_{f}"))).alias(f) for f in feats])
    return a.unpivot([], feats, "feature", "a").groupBy("feature").agg(
        F.avg(F.abs("a")).alias("shap_mean_abs"), F.avg("a").alias("shap_mean"),
        F.stddev_pop(F.abs("a")).alias("shap_std_abs"))
