"""Evaluation of scores: ranking and calibration metrics, thresholds, curves, audits, intervals.

Every function takes the long prediction shape (keys..., y_true, score) and works per key, so one
run serves all variants, groups, scenarios and replicates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.binning import edges_at_or_below, equal_width_edges, number_array, threshold_grid
from .lookups import with_row
from .ranking import null_safe_join, quantile_bins, quantiles, running_totals

RATES = ["sensitivity", "specificity", "ppv", "npv", "accuracy", "f1"]
# The rates that are compared between groups.
PARITY_METRICS = ["tpr", "fpr", "ppv", "npv", "accuracy", "f1"]


def _sums(weight: str | None) -> dict[str, Column]:
    w = F.col(weight) if weight else F.lit(1)
    return {"pos": w * F.col("y_true"), "neg": w * (F.lit(1) - F.col("y_true"))}


def sweep(long: DataFrame, keys: Sequence[str], splits=None, weight: str | None = None) -> DataFrame:
    """Per distinct score as threshold (score >= t): tp, fp and the totals; one pass over scores."""
    data = long.where(F.col("score").isNotNull() & F.col("y_true").isNotNull())
    return running_totals(data, keys, "score", _sums(weight), descending=True, splits=splits).select(
        *keys, "score", "pos", "neg", F.col("pos_to").alias("tp"), F.col("neg_to").alias("fp"),
        F.col("pos_all").alias("p_all"), F.col("neg_all").alias("n_all"))


def metrics(long: DataFrame, keys: Sequence[str], splits=None, weight: str | None = None,
            eps: float = C.METRIC_EPS) -> DataFrame:
    """AUROC, average precision, Brier, log loss, prevalence and n; undefined ones are null."""
    s = sweep(long.withColumn("score", C.clip_probability("score", eps)), keys, splits, weight)
    p, n = F.max("p_all"), F.max("n_all")
    above = F.col("tp") - F.col("pos")
    total = (p + n).cast("double")
    score = F.col("score")
    two = (p > 0) & (n > 0)
    return s.groupBy(*keys).agg(
        F.when(two, F.sum(F.col("neg") * (above + F.col("pos") / 2.0)) / (p.cast("double") * n)).alias("auroc"),
        (F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.greatest(p, F.lit(1))).alias("auprc"),
        (F.sum(F.col("pos") * F.pow(F.lit(1.0) - score, 2) + F.col("neg") * F.pow(score, 2)) / total).alias("brier"),
        F.when(two, -F.sum(F.col("pos") * F.ln(score) + F.col("neg") * F.ln(F.lit(1.0) - score)) / total)
        .alias("logloss"),
        (p / total).alias("pos_rate"),
        (p + n).alias("n"),
    )


def score_bins(long: DataFrame, keys: Sequence[str], bins: int, clip: bool) -> DataFrame:
    """Rows, positives and score total per equal-width bin (left-closed, zero-based)."""
    data = long.withColumn("score", C.clip_probability("score")) if clip else long
    cut = edges_at_or_below(data, "score", equal_width_edges(bins), "__at")
    return (cut.withColumn("bin", F.col("__at") - 1).where(F.col("bin").between(0, bins - 1))
            .groupBy(*keys, "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("pos"), F.sum("score").alias("score_sum")))


def calibration_error(long: DataFrame, keys: Sequence[str], bins: int = 15) -> DataFrame:
    """Expected calibration error: row-weighted gap between observed rate and mean score per bin."""
    gap = F.abs(F.col("pos") - F.col("score_sum"))
    return score_bins(long, keys, bins, clip=True).groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def metrics_with_ece(long: DataFrame, keys: Sequence[str], bins: int = 15, splits=None,
                     eps: float = C.METRIC_EPS) -> DataFrame:
    base = metrics(long, keys, splits, eps=eps)
    ece = calibration_error(long, keys, bins)
    return null_safe_join(base, ece, keys, "left") if keys else with_row(base, ece)


def reliability(long: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean score and observed rate per bin, scores unclipped, so a score of 1 is outside."""
    return score_bins(long, keys, bins, clip=False).select(
        *keys, "bin", "n", (F.col("score_sum") / F.col("n")).alias("mean_score"),
        (F.col("pos") / F.col("n")).alias("observed_rate"))


# --- thresholds -----------------------------------------------------------------------


def confusion_rates(tp, fp, tn, fn) -> list[Column]:
    tp, fp, tn, fn = (C.col(c) for c in (tp, fp, tn, fn))
    return [
        C.ratio(tp, tp + fn).alias("sensitivity"), C.ratio(tn, tn + fp).alias("specificity"),
        C.ratio(tp, tp + fp).alias("ppv"), C.ratio(tn, tn + fn).alias("npv"),
        C.ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        C.ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1"),
    ]


def confusion_at(long: DataFrame, thresholds: DataFrame, keys: Sequence[str],
                 on: Sequence[str] = ("variant",), weight: str | None = None) -> DataFrame:
    """Counts and rates at named thresholds (on..., rule, threshold); score >= threshold is positive.

    The threshold table has a handful of rules per variant; variants without rules are skipped.
    """
    sums = _sums(weight)
    rows = long.where(F.col("score").isNotNull() & F.col("y_true").isNotNull()) \
        .join(F.broadcast(thresholds), list(on))
    hit = F.col("score") >= F.col("threshold")
    zero = F.lit(0)
    counts = rows.groupBy(*keys, "rule", "threshold").agg(
        F.sum(F.when(hit, sums["pos"]).otherwise(zero)).alias("tp"),
        F.sum(F.when(hit, sums["neg"]).otherwise(zero)).alias("fp"),
        F.sum(F.when(hit, zero).otherwise(sums["neg"])).alias("tn"),
        F.sum(F.when(hit, zero).otherwise(sums["pos"])).alias("fn"))
    return counts.select("*", *confusion_rates("tp", "fp", "tn", "fn"))


def threshold_stats(long: DataFrame, keys: Sequence[str], splits=None) -> DataFrame:
    """Confusion rates at every distinct score and at 0 and 1."""
    data = long.where(F.col("score").isNotNull() & F.col("y_true").isNotNull()).select(
        *keys, "score", F.col("y_true").cast("bigint").alias("y_true"), F.lit(1).alias("w"))
    ends = data.groupBy(*keys).agg(F.lit(0).cast("bigint").alias("y_true"), F.lit(0).alias("w"))
    ends = ends.select(*keys, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("score"), "y_true", "w")
    s = sweep(data.unionByName(ends), keys, splits, weight="w")
    fn, tn = F.col("p_all") - F.col("tp"), F.col("n_all") - F.col("fp")
    return s.select(*keys, F.col("score").alias("threshold"), "tp", "fp", tn.alias("tn"), fn.alias("fn")) \
        .select("*", *confusion_rates("tp", "fp", "tn", "fn"))


def select_thresholds(long: DataFrame, keys: Sequence[str], sensitivities: Sequence[float] = (0.8, 0.9),
                      splits=None) -> DataFrame:
    """(keys, rule, threshold) for best F1, best Youden J, matched prevalence and fixed sensitivities.

    Ties: F1 by sensitivity then the lowest threshold; Youden and prevalence the lowest; fixed
    sensitivity by specificity then the highest, and 1.0 when no threshold reaches the target.
    """
    s = threshold_stats(long, keys, splits)
    t = F.col("threshold")
    flagged = (F.col("tp") + F.col("fp"))
    total = flagged + F.col("tn") + F.col("fn")
    off = F.abs(flagged / total - (F.col("tp") + F.col("fn")) / total)
    aggs = [
        F.max_by(t, F.struct(F.col("f1"), F.col("sensitivity"), -t)).alias("f1_max"),
        F.max_by(t, F.struct((F.col("sensitivity") + F.col("specificity") - 1.0).alias("j"), -t)).alias("youden_j"),
        F.min_by(t, F.struct(off.alias("off"), t)).alias("match_prevalence"),
    ]
    rules = ["f1_max", "youden_j", "match_prevalence"]
    for target in sensitivities:
        rule = f"fixed_sens_{round(100 * target)}"
        rules.append(rule)
        rank = F.when(F.col("sensitivity") >= target, F.struct(F.col("specificity"), t))
        aggs.append(F.coalesce(F.max_by(t, rank), F.lit(1.0)).alias(rule))
    return s.groupBy(*keys).agg(*aggs).unpivot(list(keys), rules, "rule", "threshold")


# --- curves ---------------------------------------------------------------------------


def roc_points(long: DataFrame, keys: Sequence[str], splits=None) -> DataFrame:
    s = sweep(long, keys, splits)
    return s.select(*keys, F.col("score").alias("threshold"),
                    (F.col("fp") / F.nullif("n_all", F.lit(0))).alias("fpr"),
                    (F.col("tp") / F.nullif("p_all", F.lit(0))).alias("tpr"))


def pr_points(long: DataFrame, keys: Sequence[str], splits=None) -> DataFrame:
    s = sweep(long, keys, splits)
    return s.select(*keys, F.col("score").alias("threshold"),
                    (F.col("tp") / F.nullif("p_all", F.lit(0))).alias("recall"),
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def net_benefit_columns(tp, fp, pos, n, t) -> list[Column]:
    tp, fp, pos, n, t = (C.col(c) for c in (tp, fp, pos, n, t))
    w = t / (F.lit(1.0) - t)
    model = tp / n - fp / n * w
    every = pos / n - (F.lit(1.0) - pos / n) * w
    return [model.alias("nb_model"), every.alias("nb_all"), F.lit(0.0).alias("nb_none"),
            (F.lit(100.0) * (model - every) / w).alias("nri100")]


def grid_cells(long: DataFrame, keys: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """Positives and negatives per grid cell k = number of thresholds at or below the score.

    All cells 0..len(grid) are present for every key, so at most len(grid)+1 rows per key remain.
    """
    data = long.where(F.col("score").isNotNull() & F.col("y_true").isNotNull())
    cut = edges_at_or_below(data, "score", grid, "k").groupBy(*keys, "k").agg(
        F.sum("y_true").cast("bigint").alias("pos"),
        F.sum(F.lit(1) - F.col("y_true")).cast("bigint").alias("neg"))
    empty = cut.groupBy(*keys).agg(F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    empty = empty.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(len(grid)))).alias("k"), "pos", "neg")
    return cut.unionByName(empty).groupBy(*keys, "k").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def decision_curve(long: DataFrame, keys: Sequence[str], grid: Sequence[float] | None = None) -> DataFrame:
    """Net benefit of the model, of treating all and none, and net reduction per 100, per threshold."""
    grid = list(grid) if grid is not None else threshold_grid()
    cells = grid_cells(long, keys, grid)
    per_key = Window.partitionBy(*keys)
    down = per_key.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = cells.select(
        *keys, "k", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(per_key).alias("pos"),
        (F.sum("pos").over(per_key) + F.sum("neg").over(per_key)).alias("n"),
    ).where(F.col("k") > 0)
    t = F.element_at(number_array(grid), F.col("k"))
    return rows.withColumn("threshold", t).select(
        *keys, "threshold", "n", *net_benefit_columns("tp", "fp", "pos", "n", "threshold"))


def operating_points(long: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Net benefit at named thresholds per variant (0 and 1 have no odds, so they give null)."""
    c = confusion_at(long, thresholds, keys)
    pos = F.col("tp") + F.col("fn")
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    inside = c.withColumn("__t", F.when((F.col("threshold") > 0) & (F.col("threshold") < 1), F.col("threshold")))
    return inside.select(*keys, "rule", "threshold", *net_benefit_columns("tp", "fp", pos, n, "__t"),
                         n.alias("n"))


# --- audits ---------------------------------------------------------------------------


def with_groups(long: DataFrame, meta: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Attach each group column as rows (group_col, group_val)."""
    rows = long.join(meta.select("subject_id", *group_cols), "subject_id")
    return rows.unpivot([c for c in long.columns], list(group_cols), "group_col", "group_val")


def group_labels(meta: DataFrame, group_cols: Sequence[str], numeric_bins: dict[str, int] | None = None,
                 splits=None) -> DataFrame:
    """Group columns as text: sex values mapped, numeric ones cut into equal-frequency intervals."""
    numeric_bins = numeric_bins or {}
    out = meta
    for c, bins in numeric_bins.items():
        cut = quantile_bins(out, [], c, bins, splits)
        name = F.concat(F.lit("bin"), F.col("bin").cast("string"))
        out = cut.withColumn(c, F.when(F.col("bin").isNotNull(), name)).drop("bin", "bin_lo", "bin_hi")
    return out.select("subject_id", *[
        C.group_label(c, is_sex=c.lower() in ("sex", "gender")).alias(c) for c in group_cols])


def group_metrics(grouped: DataFrame, splits=None) -> DataFrame:
    return metrics(grouped, ["variant", "group_col", "group_val"], splits) \
        .withColumnRenamed("pos_rate", "prevalence")


def group_threshold_metrics(grouped: DataFrame, thresholds: DataFrame,
                            extra: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    c = confusion_at(grouped, thresholds, [*extra, "variant", "group_col", "group_val"], weight=weight)
    return c.select(*extra, "variant", "group_col", "group_val", "rule", "threshold", "tp", "fp", "tn", "fn",
                    F.col("sensitivity").alias("tpr"), (F.lit(1.0) - F.col("specificity")).alias("fpr"),
                    "ppv", "npv", "accuracy", "f1",
                    (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"))


def thresholds_for(thresholds: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Rules under the names the scores carry; `y_score` falls back to the rules of `raw`."""
    own = thresholds.where(F.col("variant").isin(list(variants)))
    if "y_score" not in variants:
        return own
    raw = thresholds.where(F.col("variant") == "raw").withColumn("variant", F.lit("y_score"))
    have = thresholds.where(F.col("variant") == "y_score").select("variant")
    return own.unionByName(raw.join(have, "variant", "left_anti"))


def parity_gaps(group_thresholds: DataFrame) -> DataFrame:
    """max - min and min / max of each rate across the groups of a column; ratio null when max <= 0."""
    long = group_thresholds.unpivot(["variant", "rule", "group_col"], PARITY_METRICS, "metric", "value")
    hi, lo = F.max("value"), F.min("value")
    return long.groupBy("variant", "rule", "group_col", "metric").agg(
        (hi - lo).alias("gap_max_min"), F.when(hi > 0, lo / hi).alias("ratio_min_max"))


def risk_deciles(long: DataFrame, bins: int = 10, splits=None) -> DataFrame:
    """Metrics per equal-frequency score bin of each variant."""
    cut = quantile_bins(long, ["variant"], "score", bins, splits)
    return metrics(cut.withColumnRenamed("bin", "decile"), ["variant", "decile"], splits) \
        .withColumnRenamed("pos_rate", "prevalence")


def error_slices(scored: DataFrame, features: Sequence[str], bins: int = 4, threshold: float = 0.5,
                 splits=None) -> DataFrame:
    """Error rate at a threshold and prevalence per feature quantile bin, all features in one run."""
    wrong = ((F.col("score") >= threshold).cast("int") != F.col("y_true")).cast("int")
    long = scored.select(F.col("y_true"), wrong.alias("err"), *[F.col(f).cast("double") for f in features]) \
        .unpivot(["y_true", "err"], list(features), "feature", "value")
    cut = quantile_bins(long, ["feature"], "value", bins, splits).where(F.col("bin").isNotNull())
    return cut.groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("err").alias("error_rate"), F.avg("y_true").alias("prevalence"))


# --- result tables --------------------------------------------------------------------


def worst_gaps(gaps: DataFrame) -> DataFrame:
    """The largest gap per (dir, metric), with its ratio, group column and rule."""
    rank = F.struct(F.col("gap_max_min"), F.col("group_col"), F.col("rule"))
    best = gaps.groupBy("dir", "metric").agg(F.max_by(
        F.struct("gap_max_min", "ratio_min_max", "group_col", "rule"), rank).alias("b"))
    return best.select("dir", "metric", F.col("b.gap_max_min").alias("worst_gap"),
                       F.col("b.ratio_min_max").alias("worst_ratio_min_max"),
                       F.col("b.group_col").alias("at_group_col"), F.col("b.rule").alias("rule"))


def deltas_to_base(results: DataFrame, names: Sequence[str] = ("auroc", "auprc", "ece")) -> DataFrame:
    """Each scenario minus the base scenario of the same dir, variant and label, which a group's rows hand on to all."""
    on = [c for c in ("dir", "variant", "label") if c in results.columns]
    group = Window.partitionBy(*on)
    base = [F.max(F.when(F.col("scenario") == "base", F.col(m))).over(group).alias(f"base_{m}") for m in names]
    return results.select("*", *base).where(F.col("scenario") != "base").select(
        *on, "scenario", *[(F.col(m) - F.col(f"base_{m}")).alias(f"d_{m}") for m in names], "n", "pos_rate")


def top_per_group(df: DataFrame, group: Sequence[str], rank: str, k: int, tie: str) -> DataFrame:
    """The k largest rows per group; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*group).orderBy(F.col(rank).desc_nulls_last(), F.col(tie))
    return df.where(F.col(rank).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# Columns an importance table is ranked by, the first that it has.
RANK_PREFERENCE = ["shap_mean_abs", "perm_importance_mean", "value_abs", "value"]


def rank_column(df: DataFrame) -> tuple[DataFrame, str]:
    """The preferred ranking column of an importance table; plain `value` ranks by magnitude."""
    for c in RANK_PREFERENCE:
        if c in df.columns:
            if c == "value":
                return df.withColumn("value_abs", F.abs("value")), "value_abs"
            return df, c
    raise ValueError(f"no ranking column among {RANK_PREFERENCE}")


def top_features(df: DataFrame, k: int) -> list[str]:
    """Names of the k highest ranked features (k is a small argument, so they fit the driver)."""
    ranked, c = rank_column(df)
    rows = ranked.where(F.col(c).isNotNull()).orderBy(F.col(c).desc(), "feature").limit(k).select("feature")
    return [r["feature"] for r in rows.collect()]


def merge_importances(native: DataFrame, permutation: DataFrame, attribution: DataFrame | None = None) -> DataFrame:
    """Full outer merge by feature name, best first."""
    out = native.join(permutation, "feature", "full_outer")
    if attribution is not None:
        out = out.join(attribution, "feature", "full_outer")
    if "value" in out.columns:
        out = out.withColumn("value_abs", F.abs("value"))
    order = [F.col(c).desc_nulls_last() for c in RANK_PREFERENCE[:3] if c in out.columns]
    return out.orderBy(*order, "feature")


def cohort_profile(cohort: DataFrame, age: str = "age_at_admit", splits=None) -> DataFrame:
    """One row: n, distinct subjects, year span, age mean, sample sd, percentiles and range."""
    q = quantiles(cohort, [], age, [0.1, 0.25, 0.5, 0.75, 0.9], splits)
    base = cohort.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("subject_id").alias("n_subjects"),
        F.min(F.year("index_time")).alias("first_year"), F.max(F.year("index_time")).alias("last_year"),
        F.avg(age).alias("age_mean"), F.stddev_samp(age).alias("age_sd"),
        F.min(age).alias("age_min"), F.max(age).alias("age_max"))
    names = ["age_p10", "age_p25", "age_median", "age_p75", "age_p90"]
    return with_row(base, q).select("*", *[F.col("q")[i].alias(n) for i, n in enumerate(names)]).drop("q")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    text = F.upper(F.trim(F.col(column).cast("string")))
    return df.groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def id_fingerprint(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Order-insensitive fingerprint of the distinct ids: count, sum and xor of 32-bit hashes."""
    ids = df.where(F.col(key).isNotNull()).select(*by, key).distinct()
    word = C.hash_word(C.keyed_hash(F.col(key)))
    return ids.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(word).alias("hash_sum"),
                                F.bit_xor(word).alias("hash_xor"))
