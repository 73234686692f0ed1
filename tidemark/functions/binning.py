"""Left-closed and right-closed binning against fixed edges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col


def edges_at_or_below(df: DataFrame, value: str, edges: Sequence[float], out: str) -> DataFrame:
    """Add the number of edges <= value, by binary search in the JVM.

    `edges` must be strictly increasing; null values give null.
    """
    if not edges:
        return df.withColumn(out, F.when(F.col(value).isNotNull(), F.lit(0)))
    tmp = f"__{out}"
    cut = Bucketizer(splits=[-math.inf, *[float(e) for e in edges], math.inf], inputCol=value,
                     outputCol=tmp, handleInvalid="keep")
    return (cut.transform(df)
            .withColumn(out, F.when(F.col(value).isNotNull(), F.col(tmp).cast("int")))
            .drop(tmp))


def number_array(values: Sequence[float]) -> Column:
    """A constant double array from one text literal; folded once when the plan is optimised."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def edges_at_or_below_many(df: DataFrame, edges: dict[str, Sequence[float]], suffix: str) -> DataFrame:
    """`edges_at_or_below` for several columns in one pass; adds `<column><suffix>`."""
    cols = list(edges)
    cut = Bucketizer(splitsArray=[[-math.inf, *[float(e) for e in edges[c]], math.inf] for c in cols],
                     inputCols=cols, outputCols=[f"__k_{c}" for c in cols], handleInvalid="keep")
    return cut.transform(df).withColumns({
        c + suffix: F.when(F.col(c).isNotNull(), F.col(f"__k_{c}").cast("int")) for c in cols
    }).drop(*[f"__k_{c}" for c in cols])


def equal_width_edges(bins: int) -> list[float]:
    """Edges of `bins` equal bins on [0,1]; the last edge is exactly 1."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def threshold_grid(start: float = 0.01, end: float = 0.99, step: float = 0.01) -> list[float]:
    """Points start + i*step up to and including end, inside (0,1)."""
    if not (0.0 < start < end < 1.0) or step <= 0:
        raise ValueError("grid needs 0 < start < end < 1 and a positive step")
    count = max(0, math.ceil((end + 1e-12 - start) / step))
    return [g for g in (start + i * step for i in range(count)) if 0.0 < g < 1.0]


def right_closed_bin(value, edges) -> Column:
    """1-based index of the interval (edges[i], edges[i+1]]; the lowest edge belongs to bin 1.

    `edges` is an array column with duplicates already dropped.
    """
    value, edges = col(value), col(edges)
    below = F.size(F.filter(edges, lambda e: e < value))
    return F.when(value.isNotNull(), F.greatest(F.lit(1), below))
