"""Joins of event tables to one-row-per-key tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(events: DataFrame, dim: DataFrame, key: str | Sequence[str], how: str = "inner") -> DataFrame:
    """events inner/left join dim on the key; dim holds at most one row per key.

    A plain join: adaptive execution broadcasts a dim that turns out small once its rows are known, and splits
    the partitions of hot keys, also of identical rows and of the null key of a left join. Only the event side
    is split, since dim rows don't repeat. Sessions should set spark.sql.adaptive.forceOptimizeSkewedJoin, so
    that partitions are split even if a later step then needs a shuffle of its own.
    """
    if how not in ("inner", "left"):
        raise ValueError("lookup_join supports inner and left")
    return events.join(dim, [key] if isinstance(key, str) else list(key), how)


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate) to every row, as a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("s")).scalar()
    return df.withColumn("__row", packed).select(
        *df.columns, *[F.col("__row")[c].alias(c) for c in one_row.columns])


def id_overlap(a: DataFrame, b: DataFrame, key: str = "subject_id") -> DataFrame:
    """Distinct ids on each side, in both, and the share of the smaller side; one shuffle."""
    ids = (
        a.select(key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
        .unionByName(b.select(key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
        .where(F.col(key).isNotNull())
        .groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    )
    both = F.col("in_a") * F.col("in_b")
    return ids.agg(
        F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"), F.sum(both).alias("n_both"),
    ).select(
        "n_a", "n_b", "n_both",
        (F.col("n_both") / F.nullif(F.least("n_a", "n_b"), F.lit(0))).alias("overlap"),
    )
