"""Subject splits by time or by keyed hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .lookups import with_row
from .ranking import first_rows, hash_positions, order_statistics

FOLDS = ["train", "val", "test"]


def check_proportions(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("proportions must sum to 1")
    if min(train, val, test) <= 0:
        raise ValueError("proportions must be positive")


def fold_by_time(at, train_end, val_end) -> Column:
    at = C.col(at)
    return F.when(at <= train_end, "train").when(at <= val_end, "val").otherwise("test")


def split_by_dates(cohort: DataFrame, train_end: str, val_end: str) -> DataFrame:
    """Index time up to train_end, up to val_end, and after."""
    if not train_end < val_end:
        raise ValueError("train_end must be before val_end")
    ends = [F.lit(e).cast("timestamp_ntz") for e in (train_end, val_end)]
    return cohort.withColumn("fold", fold_by_time("index_time", *ends))


def cut_positions(n, train: float, val: float) -> tuple[Column, Column]:
    """Zero-based positions of the last train and last validation index time among n sorted ones."""
    q1 = min(max(train, 0.0), 0.98)
    q2 = min(max(train + val, 0.02), 0.999)
    n = C.col(n)
    first = F.greatest(F.lit(0), F.least(F.floor(F.lit(q1) * n) - 1, n - 3))
    second = F.greatest(first + 1, F.least(F.floor(F.lit(q2) * n) - 1, n - 2))
    return first, second


def temporal_cutpoints(cohort: DataFrame, train: float = 0.7, val: float = 0.1, splits=None) -> DataFrame:
    """One row (train_end, val_end): exact order statistics of the index time; none below three subjects."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    times = cohort.select(C.micros_between(epoch, "index_time").alias("t"))
    i1, i2 = cut_positions("n_all", train, val)
    row = order_statistics(times, "t", {"t1": i1, "t2": i2}, splits)

    def back(c: str) -> Column:
        return F.timestamp_add("MICROSECOND", F.col(c), epoch)

    return row.where(F.col("n_all") >= 3).select(back("t1").alias("train_end"), back("t2").alias("val_end"))


def split_by_time(cohort: DataFrame, train: float = 0.7, val: float = 0.1, test: float = 0.2,
                  splits=None) -> DataFrame:
    check_proportions(train, val, test)
    cuts = temporal_cutpoints(cohort, train, val, splits)
    fold = fold_by_time("index_time", F.col("train_end"), F.col("val_end"))
    return with_row(cohort, cuts).withColumn("fold", F.when(F.col("val_end").isNotNull(), fold)) \
        .drop("train_end", "val_end")


def _fold_by_position(first: Column, second: Column) -> Column:
    return F.when(F.col("pos") <= first, "train").when(F.col("pos") <= first + second, "val").otherwise("test")


def split_at_random(subjects: DataFrame, train: float = 0.7, val: float = 0.1, test: float = 0.2,
                    seed: int = 42, stratum: str | None = None) -> DataFrame:
    """Exact fold sizes round(p*n) in the order of md5(seed:subject); per stratum when one is named.

    Subjects with a null stratum go to test.
    """
    check_proportions(train, val, test)
    digest = subjects.withColumn("__digest", C.keyed_hash(seed, F.col("subject_id")))
    keys = [stratum] if stratum else []
    ranked = hash_positions(digest, keys, "__digest", "subject_id")
    fold = _fold_by_position(F.bround(F.lit(train) * F.col("n_all")), F.bround(F.lit(val) * F.col("n_all")))
    if stratum:
        fold = F.when(F.col(stratum).isNull(), "test").otherwise(fold)
    return ranked.withColumn("fold", fold).drop("pos", "n_all", "__digest")


def split_sixty_twenty_twenty(subjects: DataFrame, seed: int = 42) -> DataFrame:
    """20 % test, then 25 % of the rest validation, sizes rounded up."""
    digest = subjects.withColumn("__digest", C.keyed_hash(seed, F.col("subject_id")))
    ranked = hash_positions(digest, [], "__digest", "subject_id")
    n = F.col("n_all")
    test = F.ceil(n * F.lit(0.2))
    val = F.ceil((n - test) * F.lit(0.25))
    return ranked.withColumn("fold", _fold_by_position(n - test - val, val)).drop("pos", "n_all", "__digest")


def stratum_columns(columns: Sequence[str], name: str) -> list[str]:
    """The label columns a stratum name stands for; `any_incident_<H>d` means all of that horizon."""
    if name.startswith("any_incident_") and name.endswith("d"):
        suffix = name[len("any"):]
        found = [c for c in columns if c.endswith(suffix)]
        found = found or [c for c in columns if c.startswith(("diab_incident_", "cvd_incident_"))]
    else:
        found = [name] if name in columns else []
    if not found:
        raise KeyError(f"no label columns for stratum {name!r}")
    return found


def attach_stratum(subjects: DataFrame, labels: DataFrame, name: str, out: str = "stratum") -> DataFrame:
    """OR of the label columns behind the name; subjects without labels stay null."""
    hit = F.lit(False)
    for c in stratum_columns(labels.columns, name):
        hit = hit | F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    one = labels.groupBy("subject_id").agg(F.bool_or(hit).alias(out))
    return subjects.join(one, "subject_id", "left")


def one_row_per_subject(labels: DataFrame, column: str) -> DataFrame:
    """Label as 0/1, one row per subject; conflicting duplicates resolve to the lower value."""
    rows = labels.select("subject_id", C.binary_label(column).alias(column))
    return first_rows(rows, ["subject_id"], [column])


def fold_summary(folds: DataFrame, stratum: str | None = None) -> DataFrame:
    """Rows, distinct subjects and positives per fold."""
    pos = F.sum(F.coalesce(F.col(stratum).cast("int"), F.lit(0))) if stratum else F.lit(None).cast("bigint")
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"),
                                     F.count_distinct("subject_id").alias("n_subjects"),
                                     pos.alias("positives"))


def split_problems(folds: DataFrame) -> DataFrame:
    """Integrity of a split as one row: empty folds, subjects in more than one row."""
    per = folds.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("c"), *[F.max((F.col("fold") == f).cast("int")).alias(f) for f in FOLDS])
    return per.agg(
        *[(F.coalesce(F.sum(f), F.lit(0)) == 0).cast("int").alias(f"{f}_empty") for f in FOLDS],
        F.count_if(F.col("c") > 1).alias("repeated_subjects"),
        F.count_if(F.col("train") + F.col("val") + F.col("test") > 1).alias("subjects_in_two_folds"))
