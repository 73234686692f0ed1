"""Replicate weights as arrays: their distribution, metrics against plain resampling, hot scores and keys."""

import hashlib

import numpy as np
import pytest

from tidemark.operators import bootstrap as BS
from tidemark.operators import evaluate as E
from test_evaluation import long


def seeds_of(ids, seed=1):
    words = [hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in ids]
    return np.array([[int(w[8 * k : 8 * k + 8], 16) % BS.PRIME for k in range(3)] for w in words], np.int64)


def plain_weights(ids, replicates, seed=1):
    """The same weights by whole-number arithmetic of any size, one at a time."""
    out = np.zeros((len(ids), replicates), int)
    for i, (a, b, c) in enumerate(seeds_of(ids, seed).tolist()):
        for r in range(replicates):
            u = ((((a + r * b) % BS.PRIME) ** 2 + c) % BS.PRIME) >> 15
            out[i, r] = sum(u >= limit for limit in BS.LIMITS)
    return out


def test_weights_are_poisson():
    assert BS.poisson_weights(seeds_of(range(40)), 25).tolist() == plain_weights(range(40), 25).tolist()
    w = BS.poisson_weights(seeds_of(range(4000)), 200).astype(float)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert [(w == k).mean() for k in range(4)] == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.004)
    sums = w.sum(0)
    assert sums.std() == pytest.approx(4000**0.5, rel=0.25)  # replicates differ as much as independent draws
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(sums[:-1], sums[1:])[0, 1]) < 0.25


def test_weights_over_several_spans(monkeypatch):
    """The largest seeds, and replicates beyond one product's span, are as exact as others."""
    ids = list(range(6))
    seeds = np.concatenate([seeds_of(ids), [[BS.PRIME - 1] * 3, [0, 0, 0], [1, BS.PRIME - 1, BS.PRIME - 1]]])
    want = [[sum((((int(a) + r * int(b)) ** 2 + int(c)) % BS.PRIME) >> 15 >= limit for limit in BS.LIMITS) for r in range(2500)]
            for a, b, c in seeds]
    assert BS.poisson_weights(seeds, 2500).tolist() == want
    monkeypatch.setattr(BS, "SPAN", 7)
    assert BS.poisson_weights(seeds, 2500).tolist() == want


def expected(y, s, replicates, seed=1):
    """Metrics of each replicate, its rows written out."""
    w = plain_weights(range(len(y)), replicates, seed)
    rows = []
    for r in range(replicates):
        yy, ss = np.repeat(y, w[:, r]), np.clip(np.repeat(s, w[:, r]), 1e-12, 1 - 1e-12)
        pos, neg = ss[yy == 1], ss[yy == 0]
        both = len(pos) and len(neg)
        auroc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)) if both else None
        ap = sum((yy[ss == t] == 1).sum() * (yy[ss >= t] == 1).mean() for t in set(ss)) / max(len(pos), 1)
        rows.append((auroc, ap, np.mean((ss - yy) ** 2), -np.mean(yy * np.log(ss) + (1 - yy) * np.log1p(-ss)) if both else None))
    return rows


@pytest.mark.parametrize("piece_rows", [10**6, 60, 7])
def test_metrics_match_written_out_replicates(spark, piece_rows):
    """Equal for one range, many ranges, and ranges of a single hot score dealt over tasks."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 200)
    s = np.where(rng.random(200) < 0.4, 0.5, rng.integers(1, 12, 200) / 12)
    got = BS.replicate_metrics(long(spark, y, s).repartition(3), ["variant"], 6, 1, piece_rows=piece_rows)
    rows = {r["replicate"]: [r[m] for m in BS.METRICS] for r in got.collect()}
    want = expected(y, s, 6)
    assert len(rows) == 6
    for r in range(6):
        assert rows[r] == pytest.approx(want[r], abs=1e-9)


def test_one_class_and_null_keys(spark):
    df = spark.createDataFrame([(i, 1, k, 0.1 * i) for i in range(8) for k in ("a", None)],
                               "subject_id long, y_true int, variant string, score double")
    rows = BS.replicate_metrics(df, ["variant"], 5, 1).collect()
    assert {r["variant"] for r in rows} == {"a", None}
    assert all(r["auroc"] is None and r["logloss"] is None for r in rows)
    assert BS.replicate_metrics(df.limit(0), ["variant"], 5).count() == 0


def test_totals_do_not_depend_on_salts(spark, monkeypatch):
    df = BS.with_seeds(spark.range(500).selectExpr("id as subject_id", "cast(id % 3 = 0 as int) as y_true", "'k' as key"), 1)
    one = {r["replicate"]: (r["pos"], r["neg"]) for r in BS.replicate_totals(df, ["key"], 9).collect()}
    monkeypatch.setattr(BS, "PIECE_ROWS", 40)
    many = {r["replicate"]: (r["pos"], r["neg"]) for r in BS.replicate_totals(df, ["key"], 9).collect()}
    w = plain_weights(range(500), 9)
    assert one == many == {r: (w[::3, r].sum(), w[:, r].sum() - w[::3, r].sum()) for r in range(9)}


def test_threshold_intervals_bracket_the_rates(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 400)
    s = np.clip(0.3 * y + 0.6 * rng.random(400), 0, 1)
    df = long(spark, y, s).selectExpr("*", "'g' as group_col", "'v' as group_val")
    rules = spark.createDataFrame([("v", "half", 0.5)], "variant string, rule string, threshold double")
    got = BS.group_threshold_intervals(df, rules, 300).first()
    point = E.group_threshold_metrics(df, rules).first()
    for m in ("tpr", "fpr", "ppv", "npv", "f1"):
        assert got[f"{m}_ci_lo"] < point[m] < got[f"{m}_ci_hi"]
    tpr = point["tpr"]
    assert got["tpr_ci_hi"] - got["tpr_ci_lo"] == pytest.approx(2 * 1.96 * (tpr * (1 - tpr) / y.sum()) ** 0.5, rel=0.3)


def test_a_row_is_counted_once_for_all_rules(spark, monkeypatch):
    """Rules of one variant share their rows' weights; equal thresholds, one that is null and ties with a score hold."""
    rng = np.random.default_rng(8)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 11, 300) / 10
    df = long(spark, y, s).selectExpr("*", "'g' as group_col", "cast(null as string) as group_val")
    rules = spark.createDataFrame([("v", "a", 0.5), ("v", "b", 0.5), ("v", "c", 0.8), ("v", "none", None), ("w", "x", 0.1)],
                                  "variant string, rule string, threshold double")
    seen = []
    plain = BS.replicate_totals
    monkeypatch.setattr(BS, "replicate_totals", lambda rows, *a: seen.append(rows.count()) or plain(rows, *a))
    got = {r["rule"]: r for r in BS.group_threshold_intervals(df, rules, 50, 1).collect()}
    assert seen == [300] and set(got) == {"a", "b", "c", "none"}
    w = plain_weights(range(300), 50)
    for rule, t in (("a", 0.5), ("b", 0.5), ("c", 0.8)):
        tpr = w[(y == 1) & (s >= t)].sum(0) / w[y == 1].sum(0)
        ppv = w[(y == 1) & (s >= t)].sum(0) / w[s >= t].sum(0)
        assert [got[rule][f"{m}_ci_{e}"] for m in ("tpr", "ppv") for e in ("lo", "hi")] == pytest.approx(
            [np.percentile(v, q) for v in (tpr, ppv) for q in (2.5, 97.5)], abs=1e-12)


def test_pieces_of_unequal_keys(spark):
    """A key's neighbouring ranges are put together until they hold some piece_rows rows; a fuller one stays alone."""
    rows = [("a", k, 10) for k in range(8)] + [("b", k, 100 if k == 3 else 2) for k in range(8)] + [(None, 5, 1)]
    df = spark.createDataFrame([(v, k, k / 8) for v, k, n in rows for _ in range(n)], "variant string, __fine int, score double")
    got = {(r["variant"], r["__fine"]): r["__piece"] for r in BS._ranges(df, ["variant"], 20).collect()}
    assert [got["a", k] for k in range(8)] == [0, 0, 2, 2, 4, 4, 6, 6]
    assert [got["b", k] for k in range(8)] == [0, 0, 0, 3, 4, 4, 4, 4] and got[None, 5] == 5
