"""The logistic grid: optimality of every setting, storage, and agreement whatever the partitioning."""

import numpy as np
import pytest

from tidemark.operators import logistic as LG
from tidemark.operators import models as M


def table(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 2] = x[:, 0] + 0.01 * rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(int)
    rows = [(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))]
    return x, y, spark.createDataFrame(rows, "subject_id long, y int, a double, b double, c double, d double")


@pytest.mark.parametrize("weights", [(1.0, 1.0), (0.7, 1.9)])
def test_every_setting_is_optimal(spark, weights):
    """The gradient of the loss balances the penalty in every coefficient; l1 sets some to zero."""
    x, y, df = table(spark)
    w = np.where(y == 1, weights[1], weights[0])
    models = LG.fit_grid(df.repartition(3), list("abcd"), M.LOGISTIC_GRID, weights=weights)
    zeros = 0
    for (kind, c), m in zip(M.LOGISTIC_GRID, models):
        b = np.array(m.coefficients)
        r = w * (1 / (1 + np.exp(-(m.intercept + x @ b))) - y)
        assert abs(c * r.sum()) < 1e-5
        g = c * (x.T @ r)
        if kind == "l2":
            assert g == pytest.approx(-b, abs=1e-5)
        else:
            zeros += (b == 0).sum()
            assert g[b != 0] == pytest.approx(-np.sign(b[b != 0]), abs=1e-4) and (np.abs(g[b == 0]) <= 1 + 1e-6).all()
    assert zeros > 0


def test_same_models_however_dealt_out(spark):
    _, _, df = table(spark)
    one, two = (LG.fit_grid(d, ["a", "b"], M.LOGISTIC_GRID) for d in (df.coalesce(1), df.repartition(7)))
    for p, q in zip(one, two):
        assert [p.intercept, *p.coefficients] == pytest.approx([q.intercept, *q.coefficients], abs=1e-8)


def test_separated_and_single_class(spark):
    rows = [(i, int(i >= 5), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "subject_id long, y int, a double")
    for m in LG.fit_grid(df, ["a"], [("l2", 1.0), ("l1", 1.0)]):
        assert np.isfinite(m.coefficients[0]) and m.coefficients[0] > 0
    alike = LG.fit_grid(df.where("y = 1"), ["a"], [("l2", 1.0)])[0]
    assert np.isfinite(alike.intercept)
    empty = LG.fit_grid(df.limit(0), ["a"], [("l2", 1.0)])[0]
    assert (empty.intercept, empty.coefficients) == (0.0, [0.0])


def test_stored_model_and_choice(spark, tmp_path):
    x, y, df = table(spark)
    train, val = df.where("subject_id % 2 = 0"), df.where("subject_id % 2 = 1")
    fitted = M.fit_logistic(train, val, list("abcd"))
    M.save_model(spark, fitted.model, str(tmp_path / "m"))
    again = M.load_linear(spark, str(tmp_path / "m"))
    assert again == fitted.model and fitted.setting in M.LOGISTIC_GRID
    got = {r["subject_id"]: r["y_score"] for r in M.score(again, val, list("abcd")).collect()}
    want = 1 / (1 + np.exp(-(again.intercept + x @ np.array(again.coefficients))))
    assert all(got[i] == pytest.approx(want[i]) for i in got)
    scores = {r["candidate"]: r["auprc"] for r in M.validation_scores(LG.fit_grid(train, list("abcd"), M.LOGISTIC_GRID,
              weights=tuple(M.class_balance(train).first()[k] for k in ("weight_neg", "weight_pos"))), val, list("abcd")).collect()}
    assert fitted.val_score == pytest.approx(max(scores.values()))


def test_labels_share_their_rounds(spark, monkeypatch):
    """Two labels take one pass a round together and get the models they get alone; null labels don't count."""
    x, y, df = table(spark, 120)
    df = df.selectExpr("*", "case when subject_id % 7 > 0 then cast(a > 0.5 - b as int) end as z")
    passes, plain = [], LG._sums
    monkeypatch.setattr(LG, "_sums", lambda *a: passes.append(1) or plain(*a))
    weights = {"y": (0.7, 1.9), "z": (1.2, 0.8)}
    both = LG.fit_grids(df, list("abcd"), [("l2", 0.1)], weights, 3)
    assert len(passes) == 3
    for label, models in both.items():
        (m,), (n,) = models, LG.fit_grid(df, list("abcd"), [("l2", 0.1)], label, weights[label], 3)
        assert [m.intercept, *m.coefficients] == pytest.approx([n.intercept, *n.coefficients], rel=1e-9)
