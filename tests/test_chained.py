"""Chained regressions: the sweep operator, the fit against plain least squares, storage and other cohorts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import chained as CH
from tidemark.operators import prepare as PR


def test_sweep_solves_least_squares():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 5))
    full = np.column_stack([np.ones(50), x])
    for target in range(1, 6):
        others = [k for k in range(6) if k != target]
        want = np.linalg.lstsq(full[:, others], full[:, target], rcond=None)[0]
        got = CH.regression(full.T @ full, target)
        assert got[others] == pytest.approx(want) and got[target] == 0


def test_dependent_predictors_are_left_out():
    rng = np.random.default_rng(2)
    x = rng.normal(size=40)
    full = np.column_stack([np.ones(40), x, 2 * x + 1, 3 * x])
    b = CH.regression(full.T @ full, 3)
    assert full @ b == pytest.approx(3 * x) and (b[:3] == 0).any()


def table(n=300, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    x = np.column_stack([a, 2 * a + rng.normal(size=n) / 3, rng.normal(size=n) - a, rng.normal(size=n)])
    x[rng.random(n) < 0.3, 1] = np.nan
    x[rng.random(n) < 0.1, 2] = np.nan
    x[5] = [np.nan, np.nan, np.nan, 1.0]
    return x


def plain_chain(x, rounds):
    """Regressions of each incomplete column on all others, on rows where it is present; fewest gaps first."""
    absent = np.isnan(x)
    now = np.where(absent, np.nanmean(x, axis=0), x)
    order = [j for j in np.argsort(absent.sum(0), kind="stable") if absent[:, j].any()]
    for _ in range(rounds):
        fits = {}
        for j in order:
            rest = [k for k in range(x.shape[1]) if k != j]
            design = np.column_stack([np.ones(len(x)), now[:, rest]])
            fits[j] = rest, np.linalg.lstsq(design[~absent[:, j]], now[~absent[:, j], j], rcond=None)[0]
        for j in order:
            rest, b = fits[j]
            who = absent[:, j]
            now[who, j] = b[0] + now[who][:, rest] @ b[1:]
    return now


def frame(spark, x):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "subject_id long, a double, b double, c double, d double")


def values(df):
    return np.array([[r[c] for c in "abcd"] for r in df.orderBy("subject_id").collect()])


@pytest.mark.parametrize("rounds", [1, 4, 10])
def test_chain_matches_least_squares(spark, rounds):
    x = table()
    df = frame(spark, x).repartition(3)
    prep = PR.fit(df, list("abcd"), imputer="iterative", scaler="none", rounds=rounds)
    assert values(PR.impute(df, prep)) == pytest.approx(plain_chain(x, rounds), abs=1e-8)
    assert len(prep.chain.steps) == rounds and prep.chain.targets == ["a", "c", "b"]


def test_chain_is_stored_and_fills_other_cohorts(spark):
    """The stored chain gives another cohort the same values, whatever is absent there and however it is dealt out."""
    df = frame(spark, table())
    prep = PR.fit(df, list("abcd"), imputer="iterative", scaler="standard")
    again = PR.from_parameter_rows(PR.parameter_rows(spark, prep), "standard")
    assert again.chain == prep.chain
    other = table(80, 9)
    other[0] = np.nan
    other[1, 3] = np.nan
    rows = frame(spark, other)
    one, two = values(PR.apply(rows, prep)), values(PR.apply(rows.repartition(5), again))
    assert one == pytest.approx(two) and np.isfinite(one).all()
    raw = values(PR.impute(rows, again))
    assert raw[0] == pytest.approx(prep.chain.fill(other[:1])[0])
    assert raw[2:][~np.isnan(other[2:])] == pytest.approx(other[2:][~np.isnan(other[2:])])


def test_standard_scaling_follows_the_filled_values(spark):
    df = frame(spark, table())
    prep = PR.fit(df, list("abcd"), imputer="iterative", scaler="standard", add_indicators=False)
    out = values(PR.apply(df, prep))
    assert out.mean(0) == pytest.approx(np.zeros(4), abs=1e-9) and out.std(0) == pytest.approx(np.ones(4))


def test_nothing_absent_and_exact_relations(spark):
    df = spark.range(400).select(F.col("id").alias("subject_id"), (F.col("id") % 17).cast("double").alias("x"),
                                 F.when(F.col("id") % 7 != 0, 3.0 * (F.col("id") % 17) + 1.0).alias("y"))
    out = PR.impute(df, PR.fit(df, ["x", "y"], imputer="iterative", scaler="none"))
    assert out.agg(F.max(F.abs(F.col("y") - 3.0 * F.col("x") - 1.0))).first()[0] < 1e-9
    full = PR.fit(df.select("subject_id", "x"), ["x"], imputer="iterative", scaler="none")
    assert full.chain.steps == [] and full.chain.targets == []
