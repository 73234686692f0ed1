"""Bootstrap intervals with Poisson weights: all replicates of a row are one array, drawn where the row is counted.

A replicate gives each subject a Poisson(1) weight that depends on (seed, replicate, subject) only. The weights of all
replicates are computed inside the task that adds them up, so what is shuffled is the rows themselves, once, however
many replicates there are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.binning import edges_at_or_below, number_array, threshold_grid
from ..session import stored
from .evaluate import confusion_rates, net_benefit_columns
from .ranking import null_safe_join, split_points

#: Rows that one task weighs together; a score range or cell with more is cut further.
PIECE_ROWS = 100_000
#: Rows whose weights are held at a time, few enough to stay in a core's cache, and replicates drawn in one product.
CHUNK, SPAN = 64, 1_024
#: A prime below 2**31, the draws' range, and the Poisson(1) limits within it, rounded to whole numbers.
PRIME, LEVELS = 2**31 - 1, 65_536
LIMITS = [24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535]
METRICS = ["auroc", "auprc", "brier", "logloss"]
_WEIGHT = np.searchsorted(np.array(LIMITS), np.arange(LEVELS), side="right").astype(np.uint8)


def with_seeds(df: DataFrame, seed: int, id_col: str = "subject_id") -> DataFrame:
    """Three numbers per subject, from which all of its weights follow."""
    digest = C.keyed_hash(seed, F.col(id_col))
    return df.withColumns({f"__s{i}": C.hash_word(digest, i) % PRIME for i in range(3)})


class _Draws:
    """The weights of a chunk of rows (rows x replicates), in buffers that are used again for every chunk.

    (s0 + r s1)**2 + s2 is a quadratic in the replicate r. With coefficients reduced modulo PRIME it stays below 2**52 for
    SPAN replicates, so one matrix product gives all of them exactly, and so does the floor of its quotient by PRIME.
    """

    def __init__(self, replicates: int, dtype=np.float64, chunk: int = CHUNK):
        self.weight, self.out = _WEIGHT.astype(dtype), np.empty((chunk, replicates), dtype)
        wide = min(replicates, SPAN)
        self.blocks = [(r, min(r + wide, replicates)) for r in range(0, replicates, wide)] if replicates else []
        self.powers = np.arange(wide, dtype=float) ** np.arange(3)[:, None]
        self.value, self.floor, self.at = np.empty((chunk, wide)), np.empty((chunk, wide)), np.empty((chunk, wide), np.int64)

    def __call__(self, seeds: np.ndarray) -> np.ndarray:
        n, (s0, s1, s2) = len(seeds), seeds.T
        for a, b in self.blocks:
            start = (s0 + a * s1) % PRIME
            terms = np.stack([(start * start + s2) % PRIME, 2 * start * s1 % PRIME, s1 * s1 % PRIME], axis=1).astype(float)
            value, floor, at = (x.reshape(-1)[: n * (b - a)].reshape(n, b - a) for x in (self.value, self.floor, self.at))
            np.matmul(terms, self.powers[:, : b - a], out=value)
            np.divide(value, PRIME, out=floor)
            np.floor(floor, out=floor)
            floor *= PRIME
            value -= floor
            value *= 2.0**-15
            np.copyto(at, value, casting="unsafe")
            self.out[:n, a:b] = self.weight.take(at, mode="clip") if len(self.blocks) > 1 else self.weight.take(
                at, out=self.out[:n], mode="clip")
        return self.out[:n]


def poisson_weights(seeds: np.ndarray, replicates: int) -> np.ndarray:
    """Weights (rows x replicates): a quadratic in the replicate modulo a prime, looked up in the Poisson limits."""
    return _Draws(replicates, np.uint8, max(len(seeds), 1))(seeds)


def _columns(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in names])


_SEEDS = ["__s0", "__s1", "__s2"]


def _labelled(long: DataFrame, seed: int) -> DataFrame:
    known = long.where(F.col("score").isNotNull() & F.col("y_true").isNotNull())
    return with_seeds(known.withColumn("y_true", F.col("y_true").cast("int")), seed)


def _cells(found: DataFrame) -> DataFrame:
    """The cells (keys, __salts, ...) under numbers of their own, written once: Spark then knows how few they are, and
    rows are shuffled under the number instead of the keys."""
    return stored(found.withColumn("__cell", F.monotonically_increasing_id()), "cells")


def replicate_totals(rows: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """keys, replicate, pos, neg: weighted positives and negatives of every key in every replicate.

    rows carry y_true and the seeds. A key is dealt over as many tasks as its rows need; their arrays are added up per
    replicate.
    """
    keys = list(keys)
    cells = _cells(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).alias("__salts")))
    totals = _cell_totals(null_safe_join(rows, cells, keys), replicates)
    return totals.join(cells.select("__cell", *keys), "__cell").select(*keys, "replicate", "pos", "neg")


def _cell_totals(rows: DataFrame, replicates: int) -> DataFrame:
    """__cell, replicate, pos, neg, from rows that know their cell and its __salts."""
    salted = rows.select("__cell", "y_true", *_SEEDS, F.pmod(F.xxhash64(*_SEEDS), F.col("__salts")).cast("int").alias("__salt"))

    def add(table: pa.Table) -> pa.Table:
        seeds, y = _columns(table, _SEEDS), table.column("y_true").to_numpy()
        draws, sums = _Draws(replicates, np.float32), np.zeros((2, replicates))
        of = np.stack([y > 0, np.ones(len(y), bool)]).astype(np.float32)  # whole numbers far below 2**24
        for i in range(0, len(y), CHUNK):
            sums += of[:, i : i + CHUNK] @ draws(seeds[i : i + CHUNK])
        pos, every = sums.astype(np.int64)
        return pa.table([table.column("__cell").slice(0, 1), pa.array([pos]), pa.array([every - pos])], names=["__cell", "pos", "neg"])

    arrays = salted.groupBy("__cell", "__salt").applyInArrow(add, "__cell long, pos array<long>, neg array<long>")
    each = arrays.select("__cell", F.posexplode(F.arrays_zip("pos", "neg")).alias("replicate", "w"))
    return each.groupBy("__cell", "replicate").agg(F.sum("w.pos").alias("pos"), F.sum("w.neg").alias("neg"))


def percentile_interval(values: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """2.5 and 97.5 percentile over the replicates of each key; undefined replicates are dropped."""
    q = {n: F.percentile(C.finite_or_null(F.col(n).cast("double")), [0.025, 0.975]) for n in names}
    rows = values.groupBy(*keys).agg(*[e.alias(n) for n, e in q.items()])
    return rows.select(*keys, *[x for n in names for x in (
        F.col(n)[0].alias(f"{n}_ci_lo"), F.col(n)[1].alias(f"{n}_ci_hi"))])


def _score_edges(rows: DataFrame, pieces: int) -> list[float]:
    """Cut scores for about equal pieces; a score that fills a piece by itself also gets an edge right above it."""
    if pieces <= 1:
        return []
    cuts = split_points(rows, "score", pieces)
    return sorted({*cuts, *(float(np.nextafter(c, np.inf)) for c in cuts)})


def _ranges(cut: DataFrame, keys: list[str], piece_rows: int) -> DataFrame:
    """keys, __fine, __n, __low, __high, __piece: what a key has in every range between edges, and the piece (named by
    its lowest range) it belongs to.

    Edges lie at quantiles of all keys, so one key may have few rows between two of them: neighbouring ranges are put
    together to some piece_rows rows. A range with more stays by itself.
    """
    found = cut.groupBy(*keys, "__fine").agg(
        F.count(F.lit(1)).alias("__n"), F.min("score").alias("__low"), F.max("score").alias("__high"))
    full = (F.col("__n") > piece_rows).cast("int")
    below = Window.partitionBy(*keys).orderBy("__fine").rowsBetween(Window.unboundedPreceding, -1)
    run = [F.floor(F.coalesce(F.sum("__n").over(below), F.lit(0)) / piece_rows), F.coalesce(F.sum(full).over(below), F.lit(0)), full]
    placed = found.select("*", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(run)]).alias("__run"))
    return placed.withColumn("__piece", F.min("__fine").over(Window.partitionBy(*keys, "__run"))).drop("__run")


def replicate_metrics(long: DataFrame, keys: Sequence[str], replicates: int, seed: int = 42,
                      eps: float = C.METRIC_EPS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """keys, replicate, auroc, auprc, brier, logloss, by running totals over score ranges.

    Each (key, score range) is a cell, swept in one task from its highest score, with the totals of the ranges above it
    as arrays. A range that is a single score has nothing to sweep; if it is a hot one, its rows are only counted, dealt
    over several tasks.
    """
    keys = list(keys)
    clipped = long.withColumn("score", C.clip_probability("score", eps))
    rows = stored(_labelled(clipped, seed).select(*keys, "score", "y_true", *_SEEDS), "labelled")
    cut = edges_at_or_below(rows, "score", _score_edges(rows, -(-rows.count() // piece_rows)), "__fine")
    fine = stored(_ranges(cut, keys, piece_rows), "ranges")
    n = F.sum("__n")
    cells = _cells(fine.groupBy(*keys, "__piece").agg(
        F.when((F.min("__low") == F.max("__high")) & (n > piece_rows), F.ceil(n / piece_rows)).otherwise(1).alias("__salts"),
        F.min("__low").alias("__low")))
    of = null_safe_join(fine.select(*keys, "__fine", "__piece"), cells.select(*keys, "__piece", "__cell", "__salts"), [*keys, "__piece"])
    marked = null_safe_join(cut, stored(of.drop("__piece"), "cell-of-range"), [*keys, "__fine"])
    totals = _cell_totals(marked, replicates).join(cells, "__cell")
    above = Window.partitionBy(*keys, "replicate").orderBy(F.desc("__piece")).rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(totals.select("*", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("pos", "neg")]), "placed")
    sums = ["pairs", "steps", "square", "log"]
    tp, fp, s = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg"), F.col("__low")
    single = placed.where("__salts > 1").select(
        *keys, "replicate", "pos", "neg", (F.col("neg") * (tp - F.col("pos") / 2)).alias("pairs"),
        F.coalesce(F.col("pos") * tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0)).alias("steps"),
        (F.col("pos") * F.pow(1 - s, 2) + F.col("neg") * F.pow(s, 2)).alias("square"),
        (-F.col("pos") * F.ln(s) - F.col("neg") * F.ln(1 - s)).alias("log"))
    before = placed.where("__salts = 1").groupBy("__cell").agg(
        F.sort_array(F.collect_list(F.struct("replicate", "pos_above", "neg_above"))).alias("b"))
    before = before.select("__cell", F.col("b.pos_above").alias("tp"), F.col("b.neg_above").alias("fp"))

    def sweep(rows: pa.Table, start: pa.Table) -> pa.Table:
        fields = ["__cell", "pos", "neg", *sums]
        if not rows.num_rows or not start.num_rows:
            return pa.table([pa.array([], pa.int64()), *[pa.array([], pa.list_(pa.float64()))] * 6], names=fields)
        score, y, seeds = rows.column("score").to_numpy(), rows.column("y_true").to_numpy() > 0, _columns(rows, _SEEDS)
        order = np.lexsort((seeds[:, 0], -score))
        score, y, seeds = score[order], y[order], seeds[order]
        tp, fp = (np.array(start.column(c)[0].as_py(), float) for c in ("tp", "fp"))
        tp0, fp0 = tp, fp
        found, draws = np.zeros((4, replicates)), _Draws(replicates)
        left_pos, left_all = np.zeros(replicates), np.zeros(replicates)  # of a score that goes on in the next chunk
        for i in range(0, len(score), CHUNK):
            sc, yy = score[i : i + CHUNK], y[i : i + CHUNK]
            w = draws(seeds[i : i + CHUNK])
            first = np.flatnonzero(np.append(True, sc[1:] != sc[:-1]))
            if 4 * len(first) <= len(sc):  # few scores: a product with their indicators
                in_score = np.repeat(np.eye(len(first)), np.diff(first, append=len(sc)), axis=1)
                pos, every = (in_score * yy) @ w, in_score @ w
            else:
                pos, every = (np.add.reduceat(x, first, axis=0) for x in (w * yy[:, None], w))
            pos[0] += left_pos
            every[0] += left_all
            s = sc[first]
            goes_on = i + CHUNK < len(score) and score[i + CHUNK] == sc[-1]
            left_pos, left_all = (pos[-1], every[-1]) if goes_on else (0.0, 0.0)
            if goes_on:
                pos, every, s = pos[:-1], every[:-1], s[:-1]
                if not len(s):
                    continue
            neg = every - pos
            up, down = tp + pos.cumsum(0), fp + neg.cumsum(0)
            found[0] += np.einsum("ij,ij->j", neg, up - pos / 2)
            found[1] += np.einsum("ij,ij->j", pos, up / np.maximum(up + down, 1))
            found[2] += (1 - s) ** 2 @ pos + s**2 @ neg
            found[3] -= np.log(s) @ pos + np.log1p(-s) @ neg
            tp, fp = up[-1], down[-1]
        return pa.table([start.column("__cell").slice(0, 1), *(pa.array([v]) for v in (tp - tp0, fp - fp0, *found))], names=fields)

    kind = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField("__cell", T.LongType()), *[T.StructField(c, kind) for c in ("pos", "neg", *sums)]])
    swept = marked.where("__salts = 1").select("__cell", "score", "y_true", *_SEEDS).groupBy("__cell").cogroup(
        before.groupBy("__cell")).applyInArrow(sweep, schema).join(cells.select("__cell", *keys), "__cell")
    each = swept.select(*keys, F.posexplode(F.arrays_zip("pos", "neg", *sums)).alias("replicate", "w")).select(
        *keys, "replicate", *[F.col(f"w.{c}").alias(c) for c in ("pos", "neg", *sums)])
    whole = each.unionByName(single).groupBy(*keys, "replicate").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", *sums)])
    p, q = F.col("pos").cast("double"), F.col("neg").cast("double")
    both, n_all = (p > 0) & (q > 0), F.nullif(p + q, F.lit(0.0))
    return whole.select(*keys, "replicate", F.when(both, F.col("pairs") / (p * q)).alias("auroc"),
                        F.when(n_all.isNotNull(), F.col("steps") / F.greatest(p, F.lit(1.0))).alias("auprc"),
                        (F.col("square") / n_all).alias("brier"), F.when(both, F.col("log") / n_all).alias("logloss"))


def group_metric_intervals(grouped: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """Percentile intervals of the ranking and calibration metrics of every variant and group."""
    keys = ["variant", "group_col", "group_val"]
    return percentile_interval(replicate_metrics(grouped, keys, replicates, seed), keys, METRICS)


def group_threshold_intervals(grouped: DataFrame, thresholds: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """Percentile intervals of the rates at named thresholds (variant, rule, threshold) of every variant and group."""
    keys = ["variant", "group_col", "group_val"]
    # A row is counted once, whatever the number of rules: under the number of its variant's thresholds it reaches.
    levels = thresholds.groupBy("variant").agg(F.sort_array(F.collect_set("threshold")).alias("__levels"))
    placed = _labelled(grouped, seed).join(F.broadcast(levels), "variant").withColumn(
        "__k", F.size(F.filter("__levels", lambda t: t <= F.col("score"))))
    rows = stored(placed.select(*keys, "__k", "y_true", *_SEEDS), "labelled")
    reached = F.col("__k") >= F.array_position("__levels", F.col("threshold"))
    rules = thresholds.join(levels, "variant")
    totals = replicate_totals(rows, [*keys, "__k"], replicates).join(F.broadcast(rules), "variant").withColumn("hit", reached)

    def of(hit: str, c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.expr(hit), F.col(c))), F.lit(0))

    counts = totals.groupBy(*keys, "rule", "replicate").agg(
        of("hit", "pos").alias("tp"), of("hit", "neg").alias("fp"), of("not hit", "pos").alias("fn"), of("not hit", "neg").alias("tn"))
    rates = counts.select("*", *confusion_rates("tp", "fp", "tn", "fn"))
    named = rates.select(*keys, "rule", "replicate", F.col("sensitivity").alias("tpr"), (1.0 - F.col("specificity")).alias("fpr"), "ppv", "npv", "f1")
    return percentile_interval(named, [*keys, "rule"], ["tpr", "fpr", "ppv", "npv", "f1"])


def decision_curve_intervals(long: DataFrame, keys: Sequence[str], replicates: int, seed: int = 42,
                             grid: Sequence[float] | None = None) -> DataFrame:
    """Percentile interval of the model net benefit at every threshold of the grid.

    Net benefit depends on the rows only through the grid cell they fall in, so each cell is counted once per
    replicate, and suffix sums over the cells give every threshold.
    """
    grid = list(grid) if grid is not None else threshold_grid()
    keys = list(keys)
    cut = edges_at_or_below(_labelled(long, seed), "score", grid, "k")
    totals = replicate_totals(cut, [*keys, "k"], replicates)
    ks = F.explode(F.sequence(F.lit(0), F.lit(len(grid)))).alias("k")
    none = totals.groupBy(*keys, "replicate").agg(F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    cells = totals.unionByName(none.select(*keys, "replicate", "pos", "neg", ks)).groupBy(*keys, "replicate", "k").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    each = Window.partitionBy(*keys, "replicate")
    down = each.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.nullif(F.sum(F.col("pos") + F.col("neg")).over(each), F.lit(0))
    sums = cells.select(*keys, "replicate", "k", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
                        F.sum("pos").over(each).alias("p"), n.alias("n")).where("k > 0")
    at = sums.withColumn("threshold", F.element_at(number_array(grid), F.col("k")))
    curves = at.select(*keys, "threshold", net_benefit_columns("tp", "fp", "p", "n", "threshold")[0].alias("nb_model"))
    out = percentile_interval(curves, [*keys, "threshold"], ["nb_model"])
    return out.withColumnsRenamed({"nb_model_ci_lo": "nb_model_lo", "nb_model_ci_hi": "nb_model_hi"})
