"""Metrics, thresholds, calibration and intervals against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap as BS
from tidemark.operators import calibrate as K
from tidemark.operators import evaluate as E
from tidemark.functions.columns import PROB_EPS


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(5)
    y = (rng.random(900) < 0.3).astype(int)
    s = np.clip((0.25 * y + rng.random(900) * 0.7).round(2), 0, 1)
    return y, s


def long(spark, y, s, variant="v"):
    return spark.createDataFrame([(i, int(a), variant, float(b)) for i, (a, b) in enumerate(zip(y, s))],
                                 "subject_id long, y_true int, variant string, score double")


def brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    auroc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    ap, prev = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        rec = (hit & (y == 1)).sum() / (y == 1).sum()
        ap += (rec - prev) * y[hit].mean()
        prev = rec
    return auroc, ap


@pytest.mark.parametrize("splits", [[], [0.2, 0.5, 0.8]])
def test_metrics(spark, scored, splits):
    y, s = scored
    r = E.metrics(long(spark, y, s), ["variant"], splits=splits).first()
    auroc, ap = brute(y, s)
    c = np.clip(s, 1e-12, 1 - 1e-12)
    assert np.isclose(r["auroc"], auroc) and np.isclose(r["auprc"], ap)
    assert np.isclose(r["brier"], ((c - y) ** 2).mean()) and r["n"] == 900
    assert np.isclose(r["logloss"], -(y * np.log(c) + (1 - y) * np.log(1 - c)).mean())


def test_one_class_and_constant_scores(spark):
    one = E.metrics(long(spark, [1, 1], [0.2, 0.4]), ["variant"]).first()
    assert one["auroc"] is None and one["logloss"] is None and one["auprc"] == 1.0
    none = E.metrics(long(spark, [0, 0], [0.2, 0.4]), ["variant"]).first()
    assert none["auroc"] is None and none["auprc"] == 0.0
    flat = E.metrics(long(spark, [1, 0, 0, 0], [0.5] * 4), ["variant"]).first()
    assert flat["auroc"] == 0.5 and flat["auprc"] == 0.25


def test_bins_on_edges(spark):
    df = long(spark, [1, 0, 1, 0], [0.0, 0.1, 0.3, 1.0])
    got = {r["bin"]: r["n"] for r in E.reliability(df, ["variant"], 10).collect()}
    edges = np.linspace(0, 1, 11)
    want = np.digitize([0.0, 0.1, 0.3, 1.0], edges) - 1
    assert got == {int(b): 1 for b in want if b < 10}
    assert 0 <= E.calibration_error(df, ["variant"]).first()["ece"] <= 1
    p = np.clip([0.0, 0.1, 0.3, 1.0], 1e-6, 1 - 1e-6)
    idx = np.digitize(p, np.linspace(0, 1, 16)) - 1
    yy = np.array([1, 0, 1, 0])
    want_ece = sum((idx == b).mean() * abs(yy[idx == b].mean() - p[idx == b].mean()) for b in set(idx))
    assert np.isclose(E.calibration_error(df, ["variant"]).first()["ece"], want_ece)


def rates(y, s, t):
    hit = s >= t
    tp, fp = int((hit & (y == 1)).sum()), int((hit & (y == 0)).sum())
    fn, tn = int((~hit & (y == 1)).sum()), int((~hit & (y == 0)).sum())
    return dict(t=t, tp=tp, fp=fp, sens=tp / max(1, tp + fn), spec=tn / max(1, tn + fp),
                f1=2 * tp / max(1, 2 * tp + fp + fn), rate=(tp + fp) / len(y))


def test_threshold_rules(spark, scored):
    y, s = scored
    st = [rates(y, s, t) for t in sorted({*s, 0.0, 1.0})]
    want = {
        "f1_max": max(st, key=lambda d: (d["f1"], d["sens"]))["t"],
        "youden_j": max(st, key=lambda d: d["sens"] + d["spec"] - 1.0)["t"],
        "match_prevalence": min(st, key=lambda d: abs(d["rate"] - y.mean()))["t"],
        "fixed_sens_80": max((d for d in st if d["sens"] >= 0.8), key=lambda d: (d["spec"], d["t"]))["t"],
    }
    got = {r["rule"]: r["threshold"] for r in E.select_thresholds(long(spark, y, s), ["variant"], [0.8]).collect()}
    assert got == pytest.approx(want)
    none = E.select_thresholds(long(spark, [0, 0], [0.2, 0.4]), ["variant"], [0.8]).collect()
    assert {r["rule"]: r["threshold"] for r in none}["fixed_sens_80"] == 1.0


def test_decision_curve(spark, scored):
    y, s = scored
    rows = E.decision_curve(long(spark, y, s), ["variant"]).collect()
    assert len(rows) == 99 and all(r["nb_none"] == 0 for r in rows)
    for r in rows[::9]:
        t = r["threshold"]
        w = t / (1 - t)
        d = rates(y, s, t)
        nb = d["tp"] / 900 - d["fp"] / 900 * w
        every = y.mean() - (1 - y.mean()) * w
        assert np.isclose(r["nb_model"], nb) and np.isclose(r["nri100"], 100 * (nb - every) / w)
    ops = spark.createDataFrame([("v", "a", 0.3), ("v", "edge", 1.0), ("w", "b", 0.3)],
                                "variant string, rule string, threshold double")
    got = {r["rule"]: r for r in E.operating_points(long(spark, y, s), ops).collect()}
    assert set(got) == {"a", "edge"} and got["edge"]["nb_model"] is None


def test_curve_interval_matches_resampling(spark, scored):
    y, s = scored
    got = {round(r["threshold"], 2): r for r in
           BS.decision_curve_intervals(long(spark, y, s), ["variant"], 400, grid=[0.2, 0.5]).collect()}
    rng = np.random.default_rng(0)
    for t in (0.2, 0.5):
        reps = []
        for _ in range(400):
            i = rng.integers(0, 900, 900)
            d = rates(y[i], s[i], t)
            reps.append(d["tp"] / 900 - d["fp"] / 900 * t / (1 - t))
        lo, hi = np.percentile(reps, [2.5, 97.5])
        assert abs(got[t]["nb_model_lo"] - lo) < 0.008 and abs(got[t]["nb_model_hi"] - hi) < 0.008


def test_parity_gap_edges(spark):
    rows = [("v", "r", "g", 0.5, 0.0, 1.0, None, 0.2, 0.1), ("v", "r", "g", 0.25, 0.0, 1.0, 0.4, 0.2, 0.3)]
    cols = "variant string, rule string, group_col string, " + ", ".join(f"{m} double" for m in E.PARITY_METRICS)
    got = {r["metric"]: r for r in E.parity_gaps(spark.createDataFrame(rows, cols)).collect()}
    assert got["tpr"]["gap_max_min"] == 0.25 and got["tpr"]["ratio_min_max"] == 0.5
    assert got["fpr"]["ratio_min_max"] is None and got["npv"]["gap_max_min"] == 0.0


def test_threshold_fallback(spark):
    t = spark.createDataFrame([("raw", "r", 0.3)], "variant string, rule string, threshold double")
    assert [tuple(r) for r in E.thresholds_for(t, ["y_score"]).collect()] == [("y_score", "r", 0.3)]
    both = t.unionByName(t.withColumn("variant", F.lit("y_score")).withColumn("threshold", F.lit(0.7)))
    assert [r["threshold"] for r in E.thresholds_for(both, ["y_score"]).collect()] == [0.7]


def newton(y, s):
    p = np.clip(s, PROB_EPS, 1 - PROB_EPS)
    x = np.log(p / (1 - p))
    w = np.zeros(2)
    d = np.column_stack([np.ones_like(x), x])
    for _ in range(50):
        q = 1 / (1 + np.exp(-d @ w))
        step = np.linalg.solve((d * (q * (1 - q))[:, None]).T @ d, d.T @ (y - q))
        w += step
        if abs(step).max() < 1e-6:
            break
    return w


def isotonic(y, s):
    xs = np.array(sorted(set(s)))
    n = np.array([(s == x).sum() for x in xs], float)
    m = np.array([y[s == x].mean() for x in xs])
    return xs, np.array([max(min(np.average(m[j:k + 1], weights=n[j:k + 1]) for k in range(i, len(xs)))
                             for j in range(i + 1)) for i in range(len(xs))])


def test_calibrators(spark, scored):
    y, s = scored
    y, s = y[:400], s[:400]
    df = long(spark, y, s).withColumnRenamed("score", "y_score")
    platt = K.fit_platt(df)
    assert np.allclose([platt.B, platt.A], newton(y, s), atol=1e-6)
    xs, fit = isotonic(y, s)
    iso = K.fit_isotonic(df)
    probe = np.array([-0.1, *xs, *(xs + 0.005), 2.0])
    want = [fit[max(0, np.searchsorted(xs, v, side="right") - 1)] for v in probe]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(probe)], "i int, y_score double")
    got = [r["c"] for r in K.apply_isotonic(rows, "y_score", iso, "c").orderBy("i").collect()]
    assert np.allclose(got, want)
    steps = [r["y"] for r in iso.knots.orderBy("x").collect()]
    assert all(b > a for a, b in zip(steps, steps[1:]))
    split = K.fit_platt(long(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]).withColumnRenamed("score", "y_score"))
    assert K.is_finite(split)
    alike = K.fit_platt(long(spark, [0, 1], [0.3, 0.3]).withColumnRenamed("score", "y_score"))
    assert (alike.A, alike.B) == (0.0, 0.0)
    knots = K.Isotonic(spark.createDataFrame([(0.4, 0.5), (0.8, 1.0)], "x double, y double"))
    assert K.apply_isotonic(spark.createDataFrame([(0.6,)], "p double"), "p", knots, "c").first()["c"] == 0.5


def test_results_do_not_depend_on_partitioning(spark, scored):
    y, s = scored
    df = long(spark, y, s)
    one, many = df.coalesce(1), df.repartition(13)
    for f in (lambda d: E.metrics(d, ["variant"]), lambda d: E.select_thresholds(d, ["variant"]),
              lambda d: BS.replicate_metrics(d, ["variant"], 5, 1)):
        a, b = (sorted(map(str, [[round(v, 9) if isinstance(v, float) else v for v in r] for r in f(d).collect()]))
                for d in (one, many))
        assert a == b


def test_result_tables(spark):
    imp = spark.createDataFrame([("a", -3.0), ("b", 1.0), ("c", None)], "feature string, value double")
    assert E.top_features(imp, 2) == ["a", "b"]
    with pytest.raises(ValueError):
        E.rank_column(imp.select("feature"))
    perm = spark.createDataFrame([("b", 0.2), ("d", 0.1)], "feature string, perm_importance_mean double")
    assert [r["feature"] for r in E.merge_importances(imp, perm).collect()] == ["b", "d", "a", "c"]
    gaps = spark.createDataFrame([("x", "tpr", "r1", "g", 0.1, 0.9), ("x", "tpr", "r2", "g", 0.3, None)],
                                 "dir string, metric string, rule string, group_col string, gap_max_min double, ratio_min_max double")
    assert E.worst_gaps(gaps).first()["rule"] == "r2"
