"""Distributed running totals, exact quantiles and hash-ordered positions.

A window without a partition key, or with one hot key, would run in one task. Everything
here first groups by value, then cuts the value range into pieces, totals each piece, and
only then runs windows inside (key, piece). A piece holds a bounded share of the rows
whatever the key distribution.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import edges_at_or_below, number_array, right_closed_bin
from .lookups import lookup_join, with_row

#: A key with more distinct values than this is cut into pieces at its own quantiles, so many pieces.
PIECE_VALUES, PIECES = 100_000, 64


def split_points(df: DataFrame, value: str, pieces: int | None = None) -> list[float]:
    """Cut values for about equal pieces, from one approximate-quantile pass.

    There are as many pieces as shuffle partitions, so that setting bounds what a piece holds and the numbers
    that reach the driver. They are used as literals, so a re-run task sees the same pieces.
    """
    if pieces is None:
        pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(2, pieces)
    probs = [i / pieces for i in range(1, pieces)]
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, 20 * pieces).alias("q")).first()
    return sorted(set(row["q"] or []))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the right side's keys are dropped."""
    names = {k: f"__r_{k}" for k in keys}
    for k, n in names.items():
        right = right.withColumnRenamed(k, n)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right, cond, how).drop(*names.values())


def _pieces(grouped: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds `__piece`, the range of the key's own quantiles that a value lies in; grouped has a row per (keys, value).

    The quantiles are an aggregate in the same plan, over what is grouped already: the input is read once, every key is
    cut by its own values, and a hot key gets pieces of its own.
    """
    probs = [i / PIECES for i in range(1, PIECES)]
    x = F.col(value).cast("double")
    cuts = grouped.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) > PIECE_VALUES, F.percentile_approx(x, probs, 20 * PIECES)).alias("__cuts"))
    joined = null_safe_join(grouped, cuts, keys) if keys else with_row(grouped, cuts)
    return joined.withColumn("__piece", F.coalesce(F.size(F.filter("__cuts", lambda e: e <= x)), F.lit(0))).drop("__cuts")


def running_totals(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column],
                   descending: bool = False, splits: Sequence[float] | None = None) -> DataFrame:
    """One row per (keys, value): each sum, `<name>_to` up to and including it, `<name>_all` per key.

    splits are cut values for all keys, if the caller has them.
    """
    keys = list(keys)
    order = F.col(value).desc() if descending else F.col(value).asc()
    totals = [F.sum(c).alias(n) for n, c in sums.items()]
    grouped = df.groupBy(*keys, value).agg(*totals)
    if splits is None:
        grouped = _pieces(grouped, keys, value)
    else:
        grouped = edges_at_or_below(grouped.withColumn("__v", F.col(value).cast("double")), "__v", splits, "__piece").drop("__v")
    whole = Window.partitionBy(*keys)
    piece_order = F.col("__piece").desc() if descending else F.col("__piece").asc()
    before = whole.orderBy(piece_order).rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        grouped.groupBy(*keys, "__piece").agg(*[F.sum(n).alias(n) for n in sums])
        .select(
            *keys, "__piece",
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}_before") for n in sums],
            *[F.sum(n).over(whole).alias(f"{n}_all") for n in sums],
        )
    )
    inside = (Window.partitionBy(*keys, "__piece").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = null_safe_join(grouped, pieces, [*keys, "__piece"])
    return joined.select(
        *keys, value, *sums,
        *[(F.sum(n).over(inside) + F.col(f"__{n}_before")).alias(f"{n}_to") for n in sums],
        *[f"{n}_all" for n in sums],
    )


def _between(lo: Column, hi: Column, frac: Column) -> Column:
    """Linear interpolation that returns tied neighbours unchanged."""
    gap = hi - lo
    return F.when(lo == hi, lo).when(frac < 0.5, lo + gap * frac).otherwise(hi - gap * (F.lit(1.0) - frac))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              splits: Sequence[float] | None = None, out: str = "q") -> DataFrame:
    """Exact linear-interpolation quantiles of the non-null values, as one array per key.

    The built-in percentile keeps every distinct value of a group in one task, and it can return a
    tied value off by one unit in the last place, which moves rows across bin edges.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    ranked = running_totals(data, keys, "__x", {"n": F.lit(1)}, splits=splits)
    top = len(probs) - 1
    if top and all(abs(p - i / top) <= 1e-9 for i, p in enumerate(probs)):
        return _spaced_quantiles(ranked, keys, probs, out)
    start = F.col("n_to") - F.col("n")
    last = (F.col("n_all") - 1).cast("double")

    def at(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < F.col("n_to")), F.col("__x")))

    picked = []
    for i, p in enumerate(probs):
        pos = last * F.lit(p)
        picked += [at(F.floor(pos)).alias(f"__lo{i}"), at(F.ceil(pos)).alias(f"__hi{i}")]
    total = ranked.groupBy(*keys).agg(*picked, F.max("n_all").alias("__n"))
    parts = []
    for i, p in enumerate(probs):
        pos = (F.col("__n") - 1).cast("double") * F.lit(p)
        parts.append(_between(F.col(f"__lo{i}"), F.col(f"__hi{i}"), pos - F.floor(pos)))
    return total.select(*keys, F.array(*parts).alias(out))


def _spaced_quantiles(ranked: DataFrame, keys: list[str], probs: list[float], out: str) -> DataFrame:
    """Many evenly spaced quantiles: each ranked value finds the few probabilities that touch it."""
    top = len(probs) - 1
    start, stop = F.col("n_to") - F.col("n"), F.col("n_to")
    last = (F.col("n_all") - 1).cast("double")
    step = F.lit(float(top)) / F.greatest(last, F.lit(1.0))
    first_i = F.greatest(F.lit(0), F.floor((start - 1) * step) - 1)
    last_i = F.when(last == 0, F.lit(top)).otherwise(F.least(F.lit(top), F.ceil(stop * step) + 1))
    near = ranked.select(*keys, "__x", "n_to", "n", "n_all", F.explode(F.sequence(first_i, last_i)).alias("i"))
    pos = last * F.element_at(number_array(probs), F.col("i").cast("int") + 1)

    def touches(rank: Column) -> Column:
        return (start <= rank) & (rank < stop)

    both = near.where(touches(F.floor(pos)) | touches(F.ceil(pos))).groupBy(*keys, "i").agg(
        F.max(F.when(touches(F.floor(pos)), F.col("__x"))).alias("lo"),
        F.max(F.when(touches(F.ceil(pos)), F.col("__x"))).alias("hi"),
        F.max(pos - F.floor(pos)).alias("frac"))
    q = both.select(*keys, "i", _between(F.col("lo"), F.col("hi"), F.col("frac")).alias("v"))
    rows = q.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("__q"))
    return rows.select(*keys, F.col("__q.v").alias(out))


def order_statistics(df: DataFrame, value: str, positions: dict[str, Column],
                     splits: Sequence[float] | None = None) -> DataFrame:
    """One row with the values at zero-based sorted positions; a position may use `n_all`."""
    ranked = running_totals(df.where(F.col(value).isNotNull()), [], value, {"n": F.lit(1)}, splits=splits)
    start = F.col("n_to") - F.col("n")
    return ranked.agg(
        *[F.max(F.when((start <= p) & (p < F.col("n_to")), F.col(value))).alias(name)
          for name, p in positions.items()],
        F.max("n_all").alias("n_all"),
    )


def hash_positions(df: DataFrame, keys: Sequence[str], digest: str, tie: str,
                   out: str = "pos", total: str = "n_all", piece_rows: int = 200_000) -> DataFrame:
    """Position (1-based) of each row in the order of a hex digest, and the row count, per key.

    Leading hex digits of a digest are uniform, so 16**digits pieces balance by construction; the rows are counted to
    take as many digits as keep a piece near piece_rows.
    """
    digits = 1
    rows = df.count()
    while rows > piece_rows * 16**digits:
        digits += 1
    keys = list(keys)
    cut = df.withColumn("__piece", F.substring(digest, 1, digits))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        cut.groupBy(*keys, "__piece").agg(F.count(F.lit(1)).alias("__c"))
        .select(*keys, "__piece",
                F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"),
                F.sum("__c").over(whole).alias(total))
    )
    inside = Window.partitionBy(*keys, "__piece").orderBy(digest, tie)
    joined = null_safe_join(cut, pieces, [*keys, "__piece"])
    return (joined.withColumn(out, F.row_number().over(inside) + F.col("__before"))
            .drop("__piece", "__before"))


def quantile_bins(df: DataFrame, keys: Sequence[str], value: str, bins: int,
                  splits: Sequence[float] | None = None) -> DataFrame:
    """Equal-frequency bins: linear-interpolated edges, repeated edges merged, right-closed.

    Adds `bin` (1-based, null for null), `bin_lo` and `bin_hi`. Edges form one short row per key.
    """
    keys = list(keys)
    probs = [i / bins for i in range(bins + 1)]
    edges = quantiles(df, keys, value, probs, splits=splits, out="__edges")
    edges = edges.withColumn("__edges", F.array_distinct("__edges"))
    joined = lookup_join(df, edges, keys, "left") if keys else with_row(df, edges)
    return (
        joined.withColumn("bin", right_closed_bin(value, "__edges"))
        .withColumn("bin_lo", F.try_element_at("__edges", F.col("bin")))
        .withColumn("bin_hi", F.try_element_at("__edges", F.col("bin") + 1))
        .drop("__edges")
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in the declared order, as an aggregate with map-side combine."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


