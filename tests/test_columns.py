"""Scalar functions, code sets and binning on hand-made rows."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidemark.functions import binning as BN
from tidemark.functions import codes as CD
from tidemark.functions import columns as C


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(expr.alias("r")).first()["r"]


def test_ids_and_times(spark):
    got = [one(spark, C.to_id("v"), v=("string", v)) for v in ("12", "12.0", " 7 ", "12.5", "x", "", None)]
    assert got == [12, 12, 7, None, None, None, None]
    assert one(spark, C.to_id("v"), v=("string", "9007199254740993")) == 9007199254740993
    assert str(one(spark, C.to_time("v"), v=("string", "2020-01-02 03:04:05"))) == "2020-01-02 03:04:05"
    assert one(spark, C.to_time("v"), v=("string", "bad")) is None


def test_ages(spark):
    at = F.lit("2000-06-01 00:00:00").cast("timestamp_ntz")
    ages = [one(spark, C.age_from_anchor("a", "y", at), a=("double", a), y=("int", y))
            for a, y in ((30.0, 1990), (5.0, 2010), (90.0, 1950), (None, 1990))]
    assert ages == [40.0, 0.0, 120.0, None]
    born = [one(spark, C.age_from_birth(F.lit(d).cast("timestamp_ntz"), at))
            for d in ("1970-06-01", "2010-01-01", "1800-01-01")]
    assert born == [30.0, 0.0, 120.0]
    assert one(spark, C.age_from_birth(F.lit(None).cast("timestamp_ntz"), at)) is None


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_spans_ignore_the_session_zone(spark, zone):
    def at(text):
        return F.lit(text).cast("timestamp_ntz")

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        a, b = at("2024-03-09 12:00:00"), at("2024-03-11 12:00:00.000001")
        assert one(spark, C.micros_between(a, b)) == 2 * 86_400_000_000 + 1
        assert one(spark, C.micros_between(b, a)) == -(2 * 86_400_000_000 + 1)
        assert one(spark, C.days_between(at("2024-03-10 01:30:00"), at("2024-03-10 13:30:00"))) == 0.5
        assert str(one(spark, C.plus_days(at("2024-03-10 02:30:00"), 1))) == "2024-03-11 02:30:00"
        assert one(spark, C.micros_between(F.lit(None).cast("timestamp_ntz"), a)) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_codes(spark):
    rows = [("E11.9", 10), ("e119", 10), ("25000", 9), ("E119", 9), ("250", 10), (None, 9), ("I60", 10), ("440", 9)]
    df = spark.createDataFrame(rows, "c string, v int").select(
        CD.in_codebook("c", "v", CD.DIABETES).alias("d"), CD.in_codebook("c", "v", CD.CARDIOVASCULAR).alias("k"),
        CD.in_codebook("c", "v", CD.CARDIOVASCULAR_NARROW, normalise=False).alias("n")).collect()
    assert [r["d"] for r in df] == [True, True, True, False, False, False, False, False]
    assert [r["k"] for r in df] == [False] * 6 + [True, True]
    assert [r["n"] for r in df] == [False] * 8
    assert len(CD.CARDIOVASCULAR.v9) == 13 and len(CD.CARDIOVASCULAR.v10) == 18
    other = CD.DIABETES.override(v9=["e.1"])
    assert other.v9 == ("E1",) and other.v10 == CD.DIABETES.v10


def test_names_and_groups(spark):
    assert one(spark, C.feature_name("v"), v=("string", "  Hb A1c (%)  ")) == "hb_a1c"
    assert C.feature_name_text("  Hb A1c (%)  ") == "hb_a1c"
    eth = [one(spark, C.ethnicity_group("v"), v=("string", v)) for v in ("WHITE/African", "african", "Latino", "x", None)]
    assert eth == ["white", "black", "hispanic", "other", "other"]
    sex = [one(spark, C.group_label("v", True), v=("string", v)) for v in (" female", "MALE", "f", "NaT", "", None)]
    assert sex == ["F", "M", "F", "NAT", "MISSING", "MISSING"]


def test_probability_functions(spark):
    assert one(spark, C.clip_probability("p"), p=("double", 0.0)) == 1e-6
    assert abs(one(spark, C.sigmoid(C.logit("p")), p=("double", 0.3)) - 0.3) < 1e-12
    for p in (1e-7, 0.001, 0.02, 0.3, 0.5, 0.9, 0.999, 1 - 1e-7):
        z = one(spark, C.inverse_normal("p"), p=("double", p))
        assert abs(z - NormalDist().inv_cdf(p)) < 1e-7


def test_keyed_draws(spark):
    u = spark.range(20000).select(C.keyed_hash(7, F.col("id")).alias("h")).select(
        C.uniform(F.col("h")).alias("u"), C.standard_normal(F.col("h")).alias("z"),
        C.poisson_one(C.uniform(F.col("h"), 3)).alias("w"))
    r = u.agg(F.avg("u").alias("u"), F.avg("z").alias("z"), F.stddev_pop("z").alias("s"), F.avg("w").alias("w"),
              F.var_pop("w").alias("v")).first()
    assert abs(r["u"] - 0.5) < 0.01 and abs(r["z"]) < 0.03 and abs(r["s"] - 1) < 0.03
    assert abs(r["w"] - 1) < 0.03 and abs(r["v"] - 1) < 0.05
    again = spark.range(20000).repartition(7).select(C.keyed_hash(7, F.col("id")).alias("h"))
    assert abs(again.agg(F.avg(C.uniform(F.col("h")))).first()[0] - r["u"]) < 1e-12


def test_fill_and_align(spark):
    df = spark.createDataFrame([(1, None, None, math.inf, None)],
                               "subject_id int, a_count double, gender_f int, a_mean double, b double")
    r = C.fill_absent(df, ["_count"], ["gender_"]).first()
    assert r["a_count"] == 0 and r["gender_f"] == 0 and r["a_mean"] is None and r["b"] is None
    assert C.align_columns(df, ["b", "z"]).columns == ["subject_id", "b", "z"]
    try:
        C.align_columns(df, ["z"], strict=True)
        raise AssertionError("strict alignment must fail")
    except KeyError:
        pass


def test_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.3, 0.5, 1.0, -1.0, None)], "v double")
    got = [r["k"] for r in BN.edges_at_or_below(df, "v", [0.0, 0.3, 0.5], "k").collect()]
    assert got == [1, 2, 3, 3, 0, None]
    grid = BN.threshold_grid()
    assert len(grid) == 99 and grid[0] == 0.01 and abs(grid[-1] - 0.99) < 1e-12
    assert BN.threshold_grid(0.1, 0.5, 0.2) == [0.1, 0.1 + 0.2, 0.1 + 2 * 0.2]
    assert BN.equal_width_edges(4) == [0.0, 0.25, 0.5, 0.75, 1.0]
