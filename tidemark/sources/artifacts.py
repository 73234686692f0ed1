"""Nested JSON artifacts flattened to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import path_exists

_VALUES = "map<string,double>"


def _read(spark: SparkSession, paths, schema: str) -> DataFrame:
    """Whole-file JSON documents with their folder; unreadable files are dropped."""
    raw = (spark.read.schema(f"{schema}, _bad string").option("multiLine", True)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(paths))
    folder = F.regexp_extract("_metadata.file_path", r"^(?:file:(?://)?)?(.*)/[^/]+$", 1)
    return raw.withColumn("dir", folder).where(F.col("_bad").isNull()).drop("_bad")


def json_documents(spark: SparkSession, paths) -> DataFrame:
    """(dir, doc) of whole-file JSON documents of any shape, as variants; what is no JSON is dropped."""
    folder = F.regexp_extract("_metadata.file_path", r"^(?:file:(?://)?)?(.*)/[^/]+$", 1)
    return (spark.read.text(paths, wholetext=True).select(folder.alias("dir"), F.try_parse_json("value").alias("doc"))
            .where("doc is not null"))


def external_metric_rows(spark: SparkSession, paths) -> DataFrame:
    """(dir, family, task, variant, metric columns) from external metrics.json files of either shape: variant -> metric,
    or task -> variant -> metric where the family is mtl."""
    docs = json_documents(spark, paths).withColumn(
        "family", F.coalesce(F.try_variant_get("doc", "$.family", "string"), F.lit("baseline")))
    one = f"map<string,{_VALUES}>"
    tasks = F.when(F.col("family") == "mtl", F.try_variant_get("doc", "$.metrics", f"map<string,{one}>")).otherwise(
        F.create_map(F.lit(""), F.try_variant_get("doc", "$.metrics", one)))
    rows = docs.select("dir", "family", F.explode(tasks).alias("task", "variants")).where("variants is not null")
    return rows.select("dir", "family", F.nullif("task", F.lit("")).alias("task"), F.explode("variants").alias("variant", "m")).select(
        "dir", "family", "task", "variant", *[F.col("m")[k].alias(k) for k in ("auroc", "auprc", "brier", "logloss", "ece")])


def result_rows(spark: SparkSession, dirs: Sequence[str], name: str) -> DataFrame | None:
    """Rows of one result table from several run folders, with the folder's name as `dir`; tables may have unlike
    columns, and folders without the table are skipped. None if no folder has it."""
    out = None
    for d in dirs:
        path = f"{d.rstrip('/')}/{name}"
        if not path_exists(spark, path):
            continue
        one = spark.read.option("header", True).option("inferSchema", True).csv(path).withColumn("dir", F.lit(d.rstrip("/").split("/")[-1]))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def importance_ranks(spark: SparkSession, dirs: Sequence[str], k: int = 10, name: str = "explain_global.csv") -> DataFrame | None:
    """(dir, feature, rank_value): the k highest ranked features of every folder, each ranked by the first preferred
    column that its table has."""
    from ..operators.evaluate import rank_column, top_per_group

    out = None
    for d in dirs:
        table = result_rows(spark, [d], name)
        if table is None or "feature" not in table.columns:
            continue
        ranked, c = rank_column(table)
        rows = ranked.select("dir", "feature", F.col(c).cast("double").alias("rank_value"))
        out = rows if out is None else out.unionByName(rows)
    return None if out is None else top_per_group(out, ["dir"], "rank_value", k, "feature").drop("rank")


def calibration_metric_rows(spark: SparkSession, paths) -> DataFrame:
    """(dir, split, variant, metric columns) from metrics.json with split -> variant -> metric."""
    nested = f"map<string,{_VALUES}>"
    raw = _read(spark, paths, f"validation {nested}, test {nested}")
    both = F.map_filter(F.create_map(F.lit("validation"), F.col("validation"), F.lit("test"), F.col("test")),
                        lambda k, v: v.isNotNull())
    rows = (raw.select("dir", F.explode(both).alias("split", "variants"))
            .select("dir", "split", F.explode("variants").alias("variant", "m")))
    return rows.select("dir", "split", "variant", *[
        F.col("m")[k].alias(k) for k in ("auroc", "auprc", "brier", "logloss", "ece")])


def threshold_rows(spark: SparkSession, paths) -> DataFrame:
    """(dir, variant, rule, threshold) from thresholds.json."""
    raw = _read(spark, paths, f"thresholds map<string,{_VALUES}>")
    return (raw.select("dir", F.explode("thresholds").alias("variant", "rules"))
            .select("dir", "variant", F.explode("rules").alias("rule", "threshold")))


def baseline_metric_rows(spark: SparkSession, paths) -> DataFrame:
    """(family, label, model, select_metric, val_*, test_*, path) from one metrics.json per model."""
    raw = _read(spark, paths, f"label string, model string, select_metric string, val {_VALUES}, test {_VALUES}")
    return raw.where(F.col("test").isNotNull()).select(
        F.lit("baseline").alias("family"), "label", "model", "select_metric",
        *[F.col(s)[k].alias(f"{s}_{k}") for s in ("val", "test") for k in ("auroc", "auprc")],
        F.col("dir").alias("path"))


def task_metric_rows(spark: SparkSession, paths) -> DataFrame:
    """Same columns from a multi-task metrics.json with val/test -> task -> metric."""
    nested = f"map<string,{_VALUES}>"
    raw = _read(spark, paths, f"task_cols array<string>, variant string, select_metric string, "
                              f"val {nested}, test {nested}")
    rows = raw.where(F.col("task_cols").isNotNull()).select("*", F.explode("task_cols").alias("label"))
    return rows.select(
        F.lit("mtl").alias("family"), "label", F.coalesce("variant", F.lit("shared_bottom")).alias("model"),
        "select_metric",
        *[F.col(s)[F.col("label")][k].alias(f"{s}_{k}") for s in ("val", "test") for k in ("auroc", "auprc")],
        F.col("dir").alias("path"))


def metrics_rollup(baseline: DataFrame, tasks: DataFrame, calibration: DataFrame) -> DataFrame:
    """Unify the families to (label, method, test_auroc, test_auprc, path), sorted by label and method."""
    named = [
        t.select("label", F.concat_ws(":", "family", "model").alias("method"), "test_auroc", "test_auprc", "path")
        for t in (baseline, tasks)
    ]
    cal = calibration.where(F.col("split") == "test").select(
        F.element_at(F.split("dir", "/"), -1).alias("label"),
        F.concat(F.lit("calibration:"), F.col("variant")).alias("method"),
        F.col("auroc").alias("test_auroc"), F.col("auprc").alias("test_auprc"), F.col("dir").alias("path"))
    return named[0].unionByName(named[1]).unionByName(cal).orderBy("label", "method")
