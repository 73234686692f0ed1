"""Scans, sinks, prediction layouts and artifacts."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import artifacts as A
from tidemark.sources import predictions as P
from tidemark.sources import sinks as S
from tidemark.sources import tables as T


def test_catalogue():
    assert len(T.CATALOGUE) == 12 and T.table_spec("labevents").file_name == "labevents.csv"
    with pytest.raises(ValueError):
        T.table_spec("nothing")


def test_plain_csv_before_gzip_and_types(spark, tmp_path):
    text = "subject_id,hadm_id,admittime,dischtime,deathtime,note\n1,2.0,2020-01-01 00:00:00,bad,,x\nNA,y,NULL,,,\n"
    (tmp_path / "admissions.csv").write_text(text)
    import gzip

    (tmp_path / "admissions.csv.gz").write_bytes(gzip.compress(text.replace("1,2.0", "8,9").encode()))
    root = str(tmp_path)
    assert T.resolve(spark, root, "admissions", T.INGEST_ORDER).endswith(".csv")
    assert T.resolve(spark, root, "admissions", T.ANALYSIS_ORDER).endswith(".csv.gz")
    rows = T.scan_table(spark, root, "admissions", T.INGEST_ORDER).collect()
    assert (rows[0]["subject_id"], rows[0]["hadm_id"], rows[0]["dischtime"]) == (1, 2, None)
    assert rows[1]["subject_id"] is None and rows[1]["hadm_id"] is None
    zipped = T.scan_table(spark, root, "admissions").where("subject_id is not null").first()
    assert (zipped["subject_id"], zipped["hadm_id"]) == (8, 9)
    assert T.scan_table(spark, root, "admissions", nrows=1).count() == 1
    with pytest.raises(FileNotFoundError):
        T.resolve(spark, root, "patients")


def test_partitioned_sink_keeps_null_times(spark, tmp_path):
    df = spark.createDataFrame([(1, "2020-01-05"), (2, "2020-02-05"), (3, None)], "subject_id long, t string") \
        .select("subject_id", F.col("t").cast("timestamp_ntz").alias("charttime"))
    path = str(tmp_path / "labs")
    S.write_time_partitioned(df, path, "month")
    back = spark.read.parquet(path)
    assert {str(r["month"]) for r in back.collect()} == {"2020-01", "2020-02", "NaT"} and back.count() == 3
    only = df.where("subject_id = 1")
    S.write_time_partitioned(only, path, "month")
    assert spark.read.parquet(path).count() == 3
    prof = S.ingest(df, str(tmp_path / "dry"), "labevents", dry_run=True).first()
    assert prof["rows"] == 3 and not (tmp_path / "dry").exists()


def test_prediction_layouts(spark):
    base = spark.createDataFrame([(1, 1, 0.5)], "subject_id long, y_true int, y_score double")
    assert P.long_predictions(base).first()["variant"] == "y_score"
    cal = spark.createDataFrame([(1, 1, 0.5, 0.6)], "subject_id long, y_true int, y_score_raw double, y_score_platt double")
    assert {r["variant"] for r in P.long_predictions(cal).collect()} == {"raw", "platt"}
    assert [r["variant"] for r in P.long_predictions(cal, variants=["y_score_platt"]).collect()] == ["platt"]
    task = spark.createDataFrame([(1, 0, 0.2)], "subject_id long, a_y_true int, a_y_score double")
    assert P.long_predictions(task, task="a").first()["score"] == 0.2
    for bad in (dict(task="b"), dict(variants=["nope"]), {}):
        with pytest.raises(KeyError):
            P.long_predictions(task if "variants" not in bad else cal, **bad)


def test_artifacts_skip_bad_files(spark, tmp_path):
    for name, doc in (("good", json.dumps({"validation": {"raw": {"auroc": 0.7}}, "test": {"raw": {"auroc": 0.6}}},
                                          indent=2)), ("bad", "{not json")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metrics.json").write_text(doc)
        (tmp_path / name / "thresholds.json").write_text(json.dumps({"thresholds": {"raw": {"f1_max": 0.4}}}))
    got = {(r["split"], r["variant"]): r for r in A.calibration_metric_rows(spark, f"{tmp_path}/*/metrics.json").collect()}
    assert set(got) == {("validation", "raw"), ("test", "raw")} and got["test", "raw"]["auroc"] == 0.6
    assert got["test", "raw"]["dir"].endswith("/good") and got["test", "raw"]["ece"] is None
    assert A.threshold_rows(spark, f"{tmp_path}/*/thresholds.json").count() == 2
