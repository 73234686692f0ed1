"""Ordered look-ups in pieces, and the isotonic fit from score ranges, against plain loops."""

import numpy as np
import pytest

from tidemark.operators import asof as AS
from tidemark.operators import calibrate as K


@pytest.mark.parametrize("splits", [[], [2.0, 5.0, 5.5], [-1.0, 0.0, 3.0, 99.0]])
@pytest.mark.parametrize("piece_rows", [500_000, 7])
def test_last_at_or_before(spark, splits, piece_rows):
    """Ties, values outside the table, empty pieces, hot values and null values."""
    rng = np.random.default_rng(1)
    xs = [0.5, 1.0, 2.0, 4.0, 4.5, 7.0]
    values = [*rng.integers(-2, 20, 60) / 2, *[4.0] * 40, None]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "id int, v double").repartition(3)
    table = spark.createDataFrame([(x, f"y{x}") for x in xs], "x double, y string")
    got = {r["id"]: r["s"] for r in AS.last_at_or_before(df, "v", table, "x", "y", "s", splits, piece_rows).collect()}
    want = {i: None if v is None else f"y{max([x for x in xs if x <= v], default=xs[0])}" for i, v in enumerate(values)}
    assert got == want


def test_last_at_or_before_of_nothing(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, v double")
    table = spark.createDataFrame([], "x double, y double")
    assert AS.last_at_or_before(df, "v", table, "x", "y", "s").first()["s"] is None
    assert AS.last_at_or_before(df.limit(0), "v", table, "x", "y", "s").count() == 0


@pytest.mark.parametrize("splits", [[], [3.0], [2.0, 4.0, 8.0, 30.0]])
def test_previous_rows(spark, splits):
    rows = [(k, i, float(i * i)) for k in ("a", "b", None) for i in range(0, 12, 1 + (k == "b"))]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)
    got = {(r["k"], r["i"]): None if r["previous"] is None else r["previous"]["v"]
           for r in AS.previous_rows(df, ["k"], "i", ["v"], splits).collect()}
    assert got == {(k, i): None if i == 0 else float((i - 1 - (k == "b")) ** 2) for k, i, _ in rows}


@pytest.mark.parametrize("pieces", [1, 3, 40])
def test_isotonic_from_ranges(spark, pieces):
    """Pooling ranges first and their blocks afterwards gives the steps of pooling everything at once."""
    rng = np.random.default_rng(3)
    s = np.round(rng.random(800), 2)
    y = (rng.random(800) < s**2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "y_score double, y_true int")
    splits = sorted(set(np.round(np.linspace(0, 1, pieces + 1)[1:-1], 3).tolist()))
    got = [(r["x"], r["y"]) for r in K.fit_isotonic(df, splits=splits).knots.orderBy("x").collect()]
    u, n = np.unique(s, return_counts=True)
    pos = np.array([y[s == v].sum() for v in u])
    x, n, pos = K.pool(u, n, pos)
    assert np.array(got) == pytest.approx(np.column_stack([x, pos / n]))
    assert all(b > a for (_, a), (_, b) in zip(got, got[1:]))


def test_stored_calibrators(spark):
    iso = K.Isotonic(spark.createDataFrame([(0.2, 0.1), (0.6, 0.8)], "x double, y double"))
    platt, again = K.from_parameter_rows(K.parameter_rows(spark, K.Platt(0.9, -0.1), iso))
    assert (platt.A, platt.B) == (0.9, -0.1) and sorted(again.knots.collect()) == sorted(iso.knots.collect())
    assert K.from_parameter_rows(K.parameter_rows(spark, None, None)) == (None, None)
