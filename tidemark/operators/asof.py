"""Ordered look-ups without a single-task window: the last table row at or before a value, and the row before a row.

The value range is cut into pieces at measured quantiles; each piece is handed what the pieces before it end with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import edges_at_or_below
from .ranking import null_safe_join, split_points

#: Rows of a piece that are sorted together; a piece with more, such as one with a hot value, is dealt over several.
PIECE_ROWS = 500_000


def _carried(cut: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """keys, __piece, carry: the value in the last row of the pieces before, for pieces that have rows."""
    ends = cut.groupBy(*keys, "__piece").agg(F.max_by(value, F.col(order)).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, "__piece", F.last("__end", ignorenulls=True).over(before).alias("carry"))


def previous_rows(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str],
                  splits: Sequence[float] | None = None) -> DataFrame:
    """Adds `previous`, a struct of the columns in the row before by `order` within the keys; null for the first.

    Windows see the rows of one piece; a piece's first row takes the last row of the pieces before it. The order is a
    number without repeats within the keys.
    """
    keys = list(keys)
    edges = split_points(df, order) if splits is None else splits
    cut = edges_at_or_below(df.withColumn("__at", F.col(order).cast("double")), "__at", edges, "__piece")
    value = F.struct(*columns)
    inside = Window.partitionBy(*keys, "__piece").orderBy("__at")
    joined = null_safe_join(cut, _carried(cut, keys, "__at", value), [*keys, "__piece"])
    return joined.withColumn("previous", F.coalesce(F.lag(value).over(inside), F.col("carry"))).drop("__at", "__piece", "carry")


def last_at_or_before(df: DataFrame, value: str, table: DataFrame, x: str, y: str, out: str,
                      splits: Sequence[float] | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Adds y of the table's last row with x <= value; values below every x take the first row's y, null gives null.

    Rows and table are cut at quantiles of the value. Within a piece one sorted pass fills each row from the table row
    before it, the first of them from what the earlier pieces end with. A piece with many rows is dealt over several
    tasks, each with the piece's part of the table.
    """
    edges = split_points(df, value) if splits is None else list(splits)
    rows = edges_at_or_below(df.withColumn("__x", F.col(value).cast("double")), "__x", edges, "__piece")
    sizes = rows.groupBy("__piece").agg(F.ceil(F.count(F.lit(1)) / piece_rows).cast("int").alias("__salts"))
    salted = null_safe_join(rows, sizes, ["__piece"])
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col("__salts")).cast("int")
    steps = table.select(F.col(x).cast("double").alias("__x"), F.col(y).alias("__y")).where("__x is not null")
    steps = edges_at_or_below(steps, "__x", edges, "__piece")
    # Each piece starts with the last step of the pieces before it, or with the first step of all.
    empty = df.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("__piece"))
    known = steps.groupBy("__piece").agg(F.max_by("__y", "__x").alias("__end"), F.min_by("__y", "__x").alias("__begin"))
    by_piece = Window.orderBy("__piece")
    starts = empty.join(known, "__piece", "left").select(
        "__piece", F.lit(float("-inf")).alias("__x"),
        F.coalesce(F.last("__end", ignorenulls=True).over(by_piece.rowsBetween(Window.unboundedPreceding, -1)),
                   F.first("__begin", ignorenulls=True).over(by_piece.rowsBetween(0, Window.unboundedFollowing))).alias("__y"))
    steps = steps.select("__piece", "__x", "__y").unionByName(starts)
    steps = steps.join(sizes, "__piece").select(
        "__piece", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt"), "__x", "__y", F.lit(0).alias("__kind"))
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    asked = salted.select("__piece", spread.alias("__salt"), "__x", F.lit(1).alias("__kind"), kept.alias("__row"))
    both = asked.unionByName(steps, allowMissingColumns=True)
    upto = Window.partitionBy("__piece", "__salt").orderBy("__x", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__y", ignorenulls=True).over(upto)).where("__kind = 1")
    return found.select("__row.*", F.when(F.col("__x").isNotNull(), F.col("__found")).alias(out))
