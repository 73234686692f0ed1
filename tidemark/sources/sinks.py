"""Parquet and CSV sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import columns as C
from .tables import ingest_profile, path_exists

WRITE_MODES = {"keep": "ignore", "overwrite": "overwrite", "append": "append"}


def write_parquet(df: DataFrame, path: str, mode: str = "keep") -> None:
    df.write.mode(WRITE_MODES[mode]).parquet(path)


def with_time_partitions(df: DataFrame, by: str, time: str = "charttime") -> DataFrame:
    """Add `year`, or `year` and `month` (yyyy-MM; NaT where the time is null)."""
    if by == "none":
        return df
    df = df.withColumn("year", F.year(time))
    if by == "month":
        df = df.withColumn("month", F.coalesce(C.month_label(time), F.lit("NaT")))
    return df


def write_time_partitioned(df: DataFrame, path: str, by: str = "month", mode: str = "overwrite",
                           time: str = "charttime", rows_per_file: int = 5_000_000,
                           watch: Observation | None = None) -> None:
    """Partition folders by time; overwrite replaces only the partitions present in the data.

    watch, if given, counts the rows and the partitions as they are written.

    Rows are rebalanced by partition first: small partitions share a task, a hot one is split over
    many, and the number of files follows the data and not tasks times partitions.
    """
    parts = [c for c in ("year", "month") if by == "month" or (by == "year" and c == "year")]
    data = with_time_partitions(df, by, time)
    if watch is not None:
        data = data.observe(watch, F.count(F.lit(1)).alias("rows"),
                            F.collect_set(F.struct(*[F.col(c).cast("string").alias(c) for c in parts])).alias("parts"))
    out = ((data.hint("rebalance", *parts) if parts else data).write.mode(WRITE_MODES[mode])
           .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file))
    (out.partitionBy(*parts) if parts else out).parquet(path)


def ingest(df: DataFrame, path: str, name: str, mode: str = "keep", by: str = "none",
           dry_run: bool = False, time: str = "charttime") -> DataFrame:
    """Write one typed table (unless dry_run, or keep mode finds it written) and return its profile.

    The profile is of what was written, so the source is parsed once. Of a partitioned target that is overwritten only
    the partitions seen while writing are read again, as others may hold earlier writes; rows that are appended to such
    a target can't be told from older ones, so there the frame is profiled.
    """
    spark = df.sparkSession
    kept = mode == "keep" and path_exists(spark, path)
    if dry_run or kept:
        return ingest_profile(df, name)
    if by == "none":
        write_parquet(df, path, mode)
        return ingest_profile(spark.read.schema(df.schema).parquet(path), name)
    watch = Observation()
    write_time_partitioned(df, path, by, mode, time, watch=watch)
    if mode == "append":
        return ingest_profile(df, name)
    written = spark.read.parquet(path)
    seen = watch.get["parts"] or []
    parts = [c for c in ("year", "month") if by == "month" or c == "year"]
    here = [reduce(lambda a, b: a & b, [F.col(c).cast("string").eqNullSafe(F.lit(p[c])) for c in parts]) for p in seen]
    return ingest_profile(written.where(reduce(lambda a, b: a | b, here, F.lit(False))), name)


def write_result_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_fold(df: DataFrame, path: str) -> None:
    """Design matrices or splits with one folder per fold, so a fold filter reads only its files."""
    df.write.mode("overwrite").partitionBy("fold").parquet(path)
