"""Quantiles, positions and joins against brute force, on both the one-pass and the split path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lookups as L
from tidemark.operators import ranking as R


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(3)
    hot = np.full(400, 5.0)
    return np.concatenate([rng.normal(size=600).round(2), hot])


@pytest.mark.parametrize("splits", [[], [-1.0, 0.0, 5.0], "measured"])
def test_quantiles(spark, numbers, splits):
    df = spark.createDataFrame([("a" if i % 3 else None, float(v)) for i, v in enumerate(numbers)] + [("a", None)],
                               "k string, v double")
    cuts = R.split_points(df, "v", 8) if splits == "measured" else splits
    probs = [0.0, 0.005, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["q"] for r in R.quantiles(df, ["k"], "v", probs, splits=cuts).collect()}
    for key, rows in (("a", [v for i, v in enumerate(numbers) if i % 3]), (None, numbers[::3])):
        assert np.allclose(got[key], np.quantile(rows, probs), atol=1e-12)


@pytest.mark.parametrize("splits", [[], [0.0]])
@pytest.mark.parametrize("n", [1, 2, 37, 999])
def test_many_even_quantiles(spark, numbers, splits, n):
    df = spark.createDataFrame([(float(v),) for v in numbers[:n]], "v double")
    probs = [i / 99 for i in range(100)]
    got = R.quantiles(df, [], "v", probs, splits=splits).first()["q"]
    assert list(got) == pytest.approx(list(np.quantile(numbers[:n], probs)), abs=1e-12)
    same = R.quantiles(df, [], "v", [0.5] * 40, splits=splits).first()["q"]
    assert same == pytest.approx([np.median(numbers[:n])] * 40)


def test_tied_quantiles_are_exact(spark):
    df = spark.createDataFrame([(0.23,)] * 7 + [(0.24,)], "v double")
    assert R.quantiles(df, [], "v", [0.1, 0.3, 0.77]).first()["q"] == [0.23] * 3


@pytest.mark.parametrize("splits", [[], [-0.5, 0.5]])
def test_running_totals(spark, numbers, splits):
    df = spark.createDataFrame([(float(v),) for v in numbers], "v double")
    rows = R.running_totals(df, [], "v", {"n": F.lit(1)}, descending=True, splits=splits).collect()
    assert {r["v"] for r in rows} == set(numbers) and all(r["n_all"] == len(numbers) for r in rows)
    assert all(r["n_to"] == (numbers >= r["v"]).sum() for r in rows)


def test_hash_positions_are_a_permutation(spark):
    from tidemark.functions.columns import keyed_hash

    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).alias("s")).withColumn("h", keyed_hash(1, F.col("id")))
    a = {r["id"]: (r["pos"], r["n_all"]) for r in R.hash_positions(df, ["s"], "h", "id").collect()}
    b = {r["id"]: (r["pos"], r["n_all"]) for r in R.hash_positions(df.repartition(9), ["s"], "h", "id").collect()}
    assert a == b
    assert sorted(p for i, (p, _) in a.items() if i % 3 == 0) == list(range(1, 335))


def test_bins_with_heavy_ties(spark):
    df = spark.createDataFrame([(v,) for v in [1.0] * 8 + [2.0, 3.0, None]], "v double")
    rows = R.quantile_bins(df, [], "v", 4).groupBy("bin", "bin_lo", "bin_hi").count().collect()
    got = {r["bin"]: (r["bin_lo"], r["bin_hi"], r["count"]) for r in rows}
    assert got[None][2] == 1 and sum(c for *_, c in got.values()) == 11
    assert got[1][:2] == (1.0, 3.0) or got[1][0] == 1.0
    ten = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    bins = {r["v"]: r["bin"] for r in R.quantile_bins(ten, [], "v", 5).collect()}
    assert [bins[float(i)] for i in range(1, 11)] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_first_rows_ties(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (2, None, "c"), (2, 1, "d")], "k int, o int, v string")
    got = {r["k"]: r["v"] for r in R.first_rows(df, ["k"], ["o", "v"]).collect()}
    assert got == {1: "a", 2: "c"}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_lookup(spark, large_paths, how):
    events = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50).alias("k"),
        F.lit(1).alias("same"))
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = L.lookup_join(events, dim, "k", how).groupBy("k", "v").count().collect()
    want = events.join(dim, "k", how).groupBy("k", "v").count().collect()
    key = str
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_many_uneven_quantiles(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    probs = [(i / 40) ** 2 for i in range(41)]
    assert R.quantiles(df, [], "v", probs).first()["q"] == pytest.approx([100 * p for p in probs])


def test_overlap(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "subject_id int")
    b = spark.createDataFrame([(2,), (3,)], "subject_id int")
    r = L.id_overlap(a, b).first()
    assert (r["n_a"], r["n_b"], r["n_both"], r["overlap"]) == (3, 2, 2, 1.0)
