"""Cohort, label and feature edges."""

from datetime import datetime, timedelta

import pytest

from tidemark.operators import events as EV
from tidemark.plans.bindings import Bindings
from testdata import DATA

T0 = datetime(2020, 1, 10)
US = timedelta(microseconds=1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def cohort(spark):
    return frame(spark, [(1, 10, T0, T0), (2, 20, T0, T0)],
                 "subject_id long, hadm_id long, index_time timestamp_ntz, feature_time_upper_bound timestamp_ntz")


def test_index_stay_ties_and_filters(spark):
    adm = frame(spark, [(1, 12, T0, T0, None), (1, 11, T0, T0, T0), (1, 9, T0, T0 - US, None),
                        (2, 20, None, T0, None), (3, 30, T0, T0, None), (4, 40, T0, T0, None)],
                "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz")
    pat = frame(spark, [(1, 40.0, 2020, "F"), (3, 10.0, 2020, "M")],
                "subject_id long, anchor_age double, anchor_year int, gender string")
    rows = EV.index_stays(adm, pat).collect()
    assert [(r["subject_id"], r["hadm_id"], r["in_hosp_mortality"]) for r in rows] == [(1, 11, True)]
    assert EV.index_stays(adm, pat, start_year=2021).count() == 0
    assert EV.index_stays(adm, pat, start_year=2020, end_year=2020).count() == 1
    with pytest.raises(KeyError):
        EV.index_stays(adm.drop("dischtime"), pat)


def test_window_edges(spark):
    lab = frame(spark, [(1, 1, 1, T0, "at index"), (1, 1, 2, T0 - US, "just before"),
                        (1, 1, 3, T0 - timedelta(days=7), "oldest"), (1, 1, 4, T0 - timedelta(days=7) - US, "too old"),
                        (9, 1, 5, T0 - US, "stranger"), (1, None, 6, T0 - US, "no stay")],
                "subject_id long, hadm_id long, event_id long, charttime timestamp_ntz, label string")
    got = {r["label"] for r in EV.events_in_window(lab, cohort(spark), "charttime", 7).collect()}
    assert got == {"just before", "oldest"}


def test_horizon_edges(spark):
    day = timedelta(days=30)
    rows = [(1, 10, T0, 10), (2, 20, T0, 99), (3, 30, T0 + day, 5), (4, 40, T0 + day + US, 5), (5, 50, T0 - US, 5),
            (6, 60, None, None)]
    df = frame(spark, [(s, h, T0, t, e) for s, h, t, e in rows],
               "subject_id long, hadm_id long, index_time timestamp_ntz, x_first_event_time timestamp_ntz, "
               "x_first_event_hadm_id long")
    got = df.select("subject_id", *EV.horizon_flags("x", [30])).orderBy("subject_id").collect()
    assert [r["x_incident_30d"] for r in got] == [True, False, True, False, False, False]
    assert [r["x_prevalent_at_index"] for r in got] == [False, False, False, False, True, False]
    strict = df.select("subject_id", *EV.horizon_flags("x", [30], count_index_stay=False)).orderBy("subject_id")
    assert [r["x_incident_30d"] for r in strict.collect()] == [False, False, True, False, False, False]


def test_last_value_rules(spark):
    rows = [(1, 1, T0 - 2 * US, 5.0, "a"), (1, 2, T0 - US, None, "a"), (1, 3, T0 - US, 7.0, "b"),
            (1, 4, T0 - US, 8.0, "b"), (1, 5, T0 - US, None, "c"), (1, 6, T0 - US, 1.0, None)]
    df = frame(spark, [(s, e, t, v, lab, T0) for s, e, t, v, lab in rows],
               "subject_id long, event_id long, charttime timestamp_ntz, valuenum double, label string, "
               "index_time timestamp_ntz")
    got = {r["label"]: r for r in EV.lab_statistics(df, "event_id").collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["last"] is None and got["a"]["count"] == 1 and got["b"]["last"] == 8.0
    assert got["c"]["min"] is None and got["c"]["count"] == 0
    skip = {r["label"]: r["last"] for r in EV.lab_statistics(df, "event_id", keep_null_last=False).collect()}
    assert skip == {"a": 5.0, "b": 8.0, "c": None}


def test_no_feature_event_at_or_after_index(spark):
    b = Bindings(spark, DATA)
    w = EV.events_in_window(b.labevents(), b.stored_lab_cohort(), "charttime", 7)
    assert w.count() > 0 and w.where("charttime >= index_time").isEmpty()


def test_winsorise_fits_elsewhere(spark):
    df = frame(spark, [("a", float(i)) for i in range(101)] + [("b", 9.0), ("a", None)], "label string, v double")
    limits = EV.winsor_limits(df.where("label = 'a'"), ["label"], "v", 0.1, 0.9)
    out = EV.winsorise(df, limits, "label", "v")
    r = {x["label"]: x for x in out.groupBy("label").agg({"v": "max"}).collect()}
    assert r["a"]["max(v)"] == 90.0 and r["b"]["max(v)"] == 9.0 and out.where("v is null").count() == 1


def test_dictionary_is_made_unique(spark):
    lab = frame(spark, [(1, 5), (2, 6)], "subject_id long, itemid long")
    d = frame(spark, [(5, "z", "u"), (5, "a", "w")], "itemid long, label string, unitname string")
    got = {r["itemid"]: (r["label"], r["unitname"]) for r in EV.with_lab_labels(lab, d).collect()}
    assert got == {5: ("a", "w"), 6: (None, None)}


def test_pivot_merges_colliding_names(spark):
    df = frame(spark, [(1, "A b", 2.0), (1, "a-B", 4.0)], "subject_id long, label string, mean double")
    r = EV.pivot_stats(df, ["A b", "a-B"], ["mean"]).first()
    assert r["lab_a_b_mean"] == 3.0
