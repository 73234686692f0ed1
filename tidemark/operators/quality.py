"""Data-quality checks; each returns rows (severity, code, where, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import path_exists
from .asof import previous_rows
from .calibrate import Platt, is_finite
from .lookups import id_overlap

SCHEMA = "severity string, code string, where string, detail string"


def _issue(severity: str, code: str, where: str | Column, detail: Column) -> list[Column]:
    where = where if isinstance(where, Column) else F.lit(where)
    return [F.lit(severity).alias("severity"), F.lit(code).alias("code"), where.alias("where"),
            detail.cast("string").alias("detail")]


def _from_counts(one_row: DataFrame, checks: Sequence[tuple[str, str, str, str]], where: str) -> DataFrame:
    """One issue per counter column that is above zero; `checks` are (counter, severity, code, text)."""
    items = F.array(*[
        F.when(F.col(c) > 0, F.struct(
            F.lit(sev).alias("severity"), F.lit(code).alias("code"), F.lit(where).alias("where"),
            F.concat(F.lit(f"{text}: "), F.col(c).cast("string")).alias("detail")))
        for c, sev, code, text in checks])
    return one_row.select(F.explode(F.filter(items, lambda x: x.isNotNull())).alias("i")).select("i.*")


def required_columns(df: DataFrame, names: Sequence[str], where: str) -> DataFrame:
    """Required columns that are missing, and those that hold no value in any row."""
    rows = [("ERROR", "BAD_SCHEMA", where, f"missing column {n}") for n in names if n not in df.columns]
    missing = df.sparkSession.createDataFrame(rows, SCHEMA)
    there = [n for n in names if n in df.columns]
    if not there:
        return missing
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(n)).alias(f"__{i}") for i, n in enumerate(there)])
    empty = F.array(*[F.when((F.col("__rows") > 0) & (F.col(f"__{i}") == 0), F.lit(n)) for i, n in enumerate(there)])
    names_ = counts.select(F.explode(F.filter(empty, lambda x: x.isNotNull())).alias("n"))
    return missing.unionByName(names_.select(*_issue("ERROR", "EMPTY_COLUMN", where, F.concat(F.lit("no values in "), F.col("n")))))


def key_problems(df: DataFrame, key: str, where: str, not_null: Sequence[str] = ()) -> DataFrame:
    """Repeated keys, null keys and nulls in required columns, counted over all rows."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("__c"), *[
        F.count_if(F.col(c).isNull()).alias(f"__n_{c}") for c in not_null])
    counts = per.agg(
        F.count_if((F.col("__c") > 1) & F.col(key).isNotNull()).alias("repeated"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("__c"))), F.lit(0)).alias("null_key"),
        *[F.coalesce(F.sum(f"__n_{c}"), F.lit(0)).alias(f"null_{c}") for c in not_null])
    checks = [("repeated", "ERROR", "NOT_UNIQUE", f"repeated {key}"),
              ("null_key", "ERROR", "NULL_KEY", f"null {key}")]
    checks += [(f"null_{c}", "ERROR", "NULL_VALUE", f"null {c}") for c in not_null]
    return _from_counts(counts, checks, where)


def outside_unit(df: DataFrame, columns: Sequence[str], where: str, severity: str = "WARN",
                 open_ends: bool = False) -> DataFrame:
    """Values outside [0,1] (or outside (0,1)), counted per column."""
    bad = {c: ((F.col(c) <= 0) | (F.col(c) >= 1)) if open_ends else ((F.col(c) < 0) | (F.col(c) > 1))
           for c in columns}
    counts = df.agg(*[F.count_if(b).alias(c) for c, b in bad.items()])
    name = "outside (0,1)" if open_ends else "outside [0,1]"
    return _from_counts(counts, [(c, severity, "BAD_RANGE", f"{c} {name}") for c in columns], where)


def negative(df: DataFrame, columns: Sequence[str], where: str) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in columns])
    return _from_counts(counts, [(c, "WARN", "BAD_RANGE", f"{c} below 0") for c in columns], where)


def auprc_below_prevalence(metrics: DataFrame, where: Column | str, margin: float = 0.05) -> DataFrame:
    low = F.col("auprc") + 1e-6 < F.greatest(F.lit(0.0), F.col("pos_rate") - margin)
    return metrics.where(low).select(*_issue("WARN", "AUPRC_BELOW_PREV", where, F.round("auprc", 4)))


def knot_problems(knots: DataFrame, where: str) -> DataFrame:
    """Knots (position, x, y): x must not fall (error), y should not fall (warning), none may be null."""
    seen = previous_rows(knots, ["method"], "position", ["x", "y"])
    counts = seen.agg(F.count_if(F.col("x") < F.col("previous.x")).alias("x_falls"),
                      F.count_if(F.col("y") < F.col("previous.y")).alias("y_falls"),
                      F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("holes"))
    return _from_counts(counts, [("holes", "ERROR", "BAD_CAL_PARAMS", "knots without x or y"),
                                 ("x_falls", "ERROR", "BAD_CAL_PARAMS", "x decreases"),
                                 ("y_falls", "WARN", "CAL_NON_MONOTONE", "y decreases")], where)


def platt_problems(spark: SparkSession, prm: Platt, where: str) -> DataFrame:
    rows = [] if is_finite(prm) else [("ERROR", "BAD_CAL_PARAMS", where, "A or B is not finite")]
    return spark.createDataFrame(rows, SCHEMA)


def alignment_problems(raw: DataFrame, calibrated: DataFrame, where: str, least: float = 0.95) -> DataFrame:
    """Labels that differ for the same subject, and id overlap below the limit; all rows are compared."""
    a = raw.select("subject_id", F.col("y_true").alias("a"))
    b = calibrated.select("subject_id", F.col("y_true").alias("b"))
    differ = a.join(b, "subject_id").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differ"))
    wrong = _from_counts(differ, [("differ", "WARN", "MISALIGNED_YTRUE", "labels differ")], where)
    short = id_overlap(raw, calibrated).where(F.col("overlap") < least).select(
        *_issue("WARN", "SUBJECT_MISMATCH", where, F.round("overlap", 4)))
    return wrong.unionByName(short)


def artifact_presence(spark: SparkSession, root: str, names: Sequence[str], tables: Sequence[str] = ()) -> DataFrame:
    """Expected files or folders below a root, looked up on its file system; tables must also hold rows."""
    root = root.rstrip("/")
    there = {n: path_exists(spark, f"{root}/{n}") for n in [*names, *tables]}
    rows = [("ERROR", "FILE_MISSING", f"{root}/{n}", f"missing {n}") for n, found in there.items() if not found]
    out = spark.createDataFrame(rows, SCHEMA)
    for n in tables:
        if there[n]:
            counts = spark.read.parquet(f"{root}/{n}").agg(F.count(F.lit(1)).alias("rows")).where("rows = 0")
            out = out.unionByName(counts.select(*_issue("ERROR", "FILE_EMPTY", f"{root}/{n}", F.lit(f"no rows in {n}"))))
    return out


def curve_problems(curve: DataFrame, where: str) -> DataFrame:
    counts = curve.agg(
        F.count_if((F.col("threshold") <= 0) | (F.col("threshold") >= 1)).alias("grid"),
        F.count_if(F.abs(F.coalesce("nb_none", F.lit(0.0))) > 1e-6).alias("none"))
    return _from_counts(counts, [("grid", "WARN", "BAD_RANGE", "thresholds outside (0,1)"),
                                 ("none", "WARN", "NB_SANITY", "treat-none net benefit is not 0")], where)


def run_fails(issues: DataFrame, strict: bool = False) -> bool:
    """True when any ERROR, or in strict mode any WARN, was found."""
    bad = ["ERROR", "WARN"] if strict else ["ERROR"]
    return not issues.where(F.col("severity").isin(bad)).isEmpty()
