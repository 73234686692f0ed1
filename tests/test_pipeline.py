"""Splits, preparation, models, explanation, scenarios and checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from statistics import NormalDist

from testdata import DATA
from tidemark.operators import calibrate as K
from tidemark.operators import evaluate as E
from tidemark.operators import explain as X
from tidemark.operators import models as M
from tidemark.operators import prepare as PR
from tidemark.operators import quality as Q
from tidemark.operators import robustness as RB
from tidemark.operators import split as SP
from tidemark.plans.bindings import Bindings


def subjects(spark, n):
    return spark.range(n).select(
        F.col("id").alias("subject_id"),
        F.timestamp_add("DAY", F.col("id"), F.lit("2020-01-01").cast("timestamp_ntz")).alias("index_time"))


@pytest.mark.parametrize("n", [3, 10, 57])
def test_time_split_sizes(spark, n):
    got = {r["fold"]: r["count"] for r in SP.split_by_time(subjects(spark, n)).groupBy("fold").count().collect()}
    i1 = max(0, min(int(0.7 * n) - 1, n - 3))
    i2 = max(i1 + 1, min(int((0.7 + 0.1) * n) - 1, n - 2))
    assert got == {"train": i1 + 1, "val": i2 - i1, "test": n - 1 - i2}


def test_random_split(spark):
    df = subjects(spark, 1000)
    a = SP.split_at_random(df)
    assert {r["fold"]: r["count"] for r in a.groupBy("fold").count().collect()} == {"train": 700, "val": 100, "test": 200}
    b = SP.split_at_random(df.repartition(7))
    assert a.select("subject_id", "fold").exceptAll(b.select("subject_id", "fold")).isEmpty()
    s = df.withColumn("s", F.when(F.col("subject_id") % 4 == 0, None).otherwise(F.col("subject_id") % 4 == 1))
    got = {(r["s"], r["fold"]): r["count"] for r in SP.split_at_random(s, stratum="s").groupBy("s", "fold").count().collect()}
    assert got[None, "test"] == 250 and got[True, "train"] == 175 and got[False, "val"] == 50
    # 0.7 * 5 = 3.5 and 0.1 * 5 = 0.5 round to even
    small = {r["fold"]: r["count"] for r in SP.split_at_random(subjects(spark, 5)).groupBy("fold").count().collect()}
    assert small == {"train": round(0.7 * 5), "test": 5 - round(0.7 * 5)}
    for bad in ((0.5, 0.5, 0.5), (1.0, 0.0, 0.0)):
        with pytest.raises(ValueError):
            SP.check_proportions(*bad)
    five = {r["fold"]: r["count"] for r in SP.split_sixty_twenty_twenty(subjects(spark, 11)).groupBy("fold").count().collect()}
    assert five == {"test": 3, "val": 2, "train": 6}
    r = SP.split_problems(a).first()
    assert r.asDict() == dict(train_empty=0, val_empty=0, test_empty=0, repeated_subjects=0, subjects_in_two_folds=0)


def test_strata_and_labels(spark):
    lab = spark.createDataFrame([(1, True, None, 1), (2, False, False, 0)],
                                "subject_id long, a_incident_365d boolean, b_incident_365d boolean, a_incident_30d int")
    assert SP.stratum_columns(lab.columns, "any_incident_365d") == ["a_incident_365d", "b_incident_365d"]
    with pytest.raises(KeyError):
        SP.stratum_columns(lab.columns, "nope")
    got = {r[0]: r[1] for r in SP.attach_stratum(subjects(spark, 4).select("subject_id"), lab, "any_incident_365d").collect()}
    assert got == {0: None, 1: True, 2: False, 3: None}
    dup = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "subject_id long, y int")
    assert SP.one_row_per_subject(dup, "y").count() == 2


def table(spark):
    rows = [(i, "train" if i < 6 else "test", a, b, c, 7.0, None, d) for i, (a, b, c, d) in enumerate([
        (1.0, 0.0, 5.0, 2.0), (2.0, None, 5.0, 2.0), (4.0, 1.0, 5.0, 3.0), (10.0, 1.0, 6.0, 3.0), (None, 0.0, 5.0, 9.0),
        (None, 1.0, 5.0, None), (3.0, None, None, 4.0), (float("inf"), 0.0, 1.0, 1.0)])]
    return spark.createDataFrame(rows, "subject_id long, fold string, a double, b double, c double, k double, e double, d double")


COLS = ["a", "b", "c", "k", "e", "d"]


def test_preparation(spark):
    df = table(spark)
    tr = df.where("fold = 'train'")
    p = PR.fit(tr, COLS)
    assert p.dropped_empty == ["e"] and p.dropped_constant == ["k", "e__mis"] and p.binary == ["b"]
    assert p.fill == {"a": 3.0, "b": 1.0, "c": 5.0, "d": 3.0}
    assert p.indicators == ["a__mis", "b__mis", "e__mis", "d__mis"]
    out = {r["subject_id"]: r for r in PR.apply(df, p).collect()}
    a = np.array([1, 2, 4, 10, 3, 3.0])
    assert np.allclose([out[i]["a"] for i in range(6)], (a - a.mean()) / a.std())
    assert np.isclose(out[7]["a"], (3 - a.mean()) / a.std()) and out[6]["b"] == 1.0 and "k" not in out[0].asDict()
    m = np.array([0, 0, 0, 0, 1, 1.0])
    assert np.isclose(out[7]["a__mis"], (1 - m.mean()) / m.std())
    mode = PR.fit(tr, COLS, imputer="most_frequent", scaler="robust")
    assert mode.fill["d"] == 2.0 and mode.fill["a"] == 1.0
    filled = np.array([1, 2, 4, 10, 1, 1.0])
    q1, q2, q3 = np.percentile(filled, [25, 50, 75])
    got = {r["subject_id"]: r["a"] for r in PR.apply(df, mode).collect()}
    assert np.isclose(got[3], (10 - q2) / (q3 - q1))
    assert PR.fit(tr, COLS, imputer="most_frequent", scaler="robust").scale["c"] == 1.0
    again = PR.from_parameter_rows(PR.parameter_rows(spark, p), "standard")
    assert again == p


def test_quantile_scaler(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.exponential(size=300).round(2), np.zeros(60)])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "subject_id long, v double")
    p = PR.fit(df, ["v"], scaler="quantile", keep_binary=False)
    m = min(len(v), 1000, max(10, len(v) // 2))
    refs = np.linspace(0, 1, m)
    q = np.quantile(v, refs)
    up = np.interp(v, q, refs)
    down = -np.interp(-v, -q[::-1], -refs[::-1])
    level = 0.5 * (up + down)
    level[v == q[0]], level[v == q[-1]] = 0.0, 1.0
    want = [NormalDist().inv_cdf(min(max(x, 1e-7), 1 - 1e-7)) for x in level]
    got = [r["v"] for r in PR.apply(df, p).orderBy("subject_id").collect()]
    assert np.allclose(got, want, atol=1e-5)


def test_models_beat_prevalence(spark):
    b = Bindings(spark, DATA)
    m = b.stored_matrix()
    f = ["f_signal", "f_price"]
    fold = lambda n: m.where(F.col("fold") == n)
    fitted = {
        "logistic": M.fit_logistic(fold("train"), fold("val"), f, grid=[("l2", 1.0), ("l1", 0.1)], max_iter=20),
        "forest": M.fit_forest(fold("train"), fold("val"), f, grid=[(5, 4, 5)]),
        "boosted": M.fit_boosted(fold("train"), fold("val"), f, grid=[(0.1, 2, 1.0, 1.0)], rounds=3),
    }
    for x in fitted.values():
        s = M.score(x.model, fold("test"), f).withColumnRenamed("y_score", "score")
        r = E.metrics(s, []).first()
        assert r["auprc"] > r["pos_rate"] and r["auroc"] > 0.6
        assert s.where("score < 0 or score > 1").isEmpty()
    imp = {r["feature"]: r for r in M.native_importances(spark, fitted["logistic"]).collect()}
    assert imp["f_signal"]["derived_value"] == pytest.approx(np.exp(imp["f_signal"]["value"]))
    rows = fold("test").select("subject_id", F.col("y").alias("y_true"), *f)
    rows = fitted["forest"].model.transform(M.packed(rows, f, "y_true")).select(
        "subject_id", "y_true", *f, F.lit(0.0).alias("margin"),
        F.expr("element_at(cast(null as array<double>), 1)").alias("score"))
    rows = rows.drop("score").join(M.score(fitted["forest"].model, fold("test"), f).select(
        "subject_id", F.col("y_score").alias("score")), "subject_id")
    drop = {r["feature"]: r["perm_importance_mean"] for r in X.permutation_importance(
        rows, f, X.model_rescore(fitted["forest"].model, f), "auroc", repeats=2).collect()}
    assert drop["f_signal"] > 0.1 > abs(drop["f_price"])


def test_shuffle_is_a_permutation(spark):
    """Each repeat moves every row's values to another row, all features together, whatever the partitioning."""
    df = subjects(spark, 200).select("subject_id", F.col("subject_id").cast("double").alias("a"),
                                     (F.col("subject_id") % 7).cast("double").alias("b"))
    rows = X.shuffled_rows(df, ["a", "b"], 3).select("subject_id", "replicate", "shuffled").collect()
    for k in range(3):
        mine = {r["subject_id"]: r["shuffled"] for r in rows if r["replicate"] == k}
        assert sorted(v[0] for v in mine.values()) == list(range(200)) and len(mine) == 200
        assert all(v[0] != i and v[1] == v[0] % 7 for i, v in mine.items())
    again = X.shuffled_rows(df.repartition(5), ["a", "b"], 3).select("subject_id", "replicate", "shuffled").collect()
    assert sorted(rows) == sorted(again) and len({str(sorted((r[0], r[2]) for r in rows if r[1] == k)) for k in range(3)}) == 3
    alone = X.shuffled_rows(df.limit(1), ["a", "b"], 2).collect()
    assert all(r["shuffled"] == [r["a"], r["b"]] for r in alone) and len(alone) == 2


def test_scenarios(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "subject_id long, a double, b double")
    assert {r["a"] for r in RB.ablate(df, ["a", "zz"]).collect()} == {3.0}
    fitted = RB.ablate(df, ["a"], fit_on=df.where("subject_id = 1"))
    assert {r["a"] for r in fitted.collect()} == {2.0}
    n1 = RB.add_noise(df, ["a", "b"], 0.5).orderBy("subject_id").collect()
    n2 = RB.add_noise(df.repartition(3), ["a", "b"], 0.5).orderBy("subject_id").collect()
    assert n1 == n2 and n1[0]["b"] != 5.0
    names = {r["scenario"] for r in RB.matrix_scenarios(df, ["a"], ["a"], "zero", [0.1]).collect()}
    assert names == {"base", "ablate_zero_1", "noise_0.1"}


def test_checks_find_planted_problems(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (1, 1.5), (None, None)], "subject_id long, p double")
    codes = {(r["code"], r["detail"]) for r in Q.key_problems(df, "subject_id", "t", ["p"]).collect()}
    assert codes == {("NOT_UNIQUE", "repeated subject_id: 1"), ("NULL_KEY", "null subject_id: 1"), ("NULL_VALUE", "null p: 1")}
    assert Q.outside_unit(df, ["p"], "t").count() == 1 and Q.negative(df, ["p"], "t").isEmpty()
    assert Q.required_columns(df, ["subject_id", "q"], "t").first()["severity"] == "ERROR"
    knots = spark.createDataFrame([("isotonic", 0, 0.5, 0.2), ("isotonic", 1, 0.4, 0.1), ("isotonic", 2, None, 0.3)],
                                  "method string, position int, x double, y double")
    assert {r["code"] for r in Q.knot_problems(knots, "k").collect()} == {"BAD_CAL_PARAMS", "CAL_NON_MONOTONE"}
    assert Q.platt_problems(spark, K.Platt(float("nan"), 0.0), "p").count() == 1
    a = spark.range(100).select(F.col("id").alias("subject_id"), F.lit(0).alias("y_true"))
    b = a.where("subject_id < 90").unionByName(a.select((F.col("subject_id") + 1000).alias("subject_id"), "y_true"))
    got = {r["code"] for r in Q.alignment_problems(a, b.withColumn("y_true", F.lit(1)), "c").collect()}
    assert got == {"MISALIGNED_YTRUE", "SUBJECT_MISMATCH"}
    assert Q.artifact_presence(spark, str(tmp_path), ["x"]).count() == 1
    curve = spark.createDataFrame([(0.0, 0.0), (0.5, 0.2)], "threshold double, nb_none double")
    issues = Q.curve_problems(curve, "c")
    assert {r["code"] for r in issues.collect()} == {"BAD_RANGE", "NB_SANITY"}
    low = spark.createDataFrame([(0.1, 0.5), (0.5, 0.5)], "auprc double, pos_rate double")
    assert Q.auprc_below_prevalence(low, "m").count() == 1
    assert not Q.run_fails(issues) and Q.run_fails(issues, strict=True)
