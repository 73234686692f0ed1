"""Queries over splits, preparation, models, evaluation, audits and checks."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.binning import equal_width_edges, threshold_grid
from ..operators import bootstrap as BS
from ..operators import calibrate as K
from ..operators import evaluate as E
from ..operators import events as EV
from ..operators import explain as X
from ..operators import models as M
from ..operators import prepare as PR
from ..operators import quality as Q
from ..operators import robustness as RB
from ..operators import split as SP
from ..operators.logistic import fit_grid
from ..operators.ranking import running_totals
from ..session import fresh_path, stored
from ..sources import artifacts as A
from ..sources import predictions as P
from ..sources import sinks
from .bindings import MATRIX_FEATURES, Bindings, prediction_fold
from .data_queries import qcut_sql
from .registry import B, R, TS, query, rounded

def _fold(df, name):
    return df.where(F.col("fold") == name)


# --- splits ---------------------------------------------------------------------------


@query("X1", """select subject_id, case when index_time <= timestamp '1997-06-30 00:00:00' then 'train'
when index_time <= timestamp '1998-06-30 00:00:00' then 'val' else 'test' end as fold from cohort""")
def split_by_dates(b):
    return SP.split_by_dates(b.cohort(), "1997-06-30", "1998-06-30").select("subject_id", "fold")


CUTS = """cuts as (select max(index_time) filter (i = i1) as train_end, max(index_time) filter (i = i2) as val_end
from (select *, greatest(i1 + 1, least(floor((0.7::double + 0.1::double) * n) - 1, n - 2)) as i2 from
(select *, greatest(0, least(floor(0.7::double * n) - 1, n - 3)) as i1 from (select index_time,
row_number() over (order by index_time) - 1 as i, count(*) over () as n from cohort))))"""


@query("X2 W3", f"with {CUTS} select {TS('train_end')}, {TS('val_end')} from cuts")
def temporal_cutpoints(b):
    return rounded(SP.temporal_cutpoints(b.cohort()))


@query("X2", f"""with {CUTS} select subject_id, case when index_time <= train_end then 'train'
when index_time <= val_end then 'val' else 'test' end as fold from cohort, cuts""")
def split_by_time_proportions(b):
    return SP.split_by_time(b.cohort().select("subject_id", "index_time")).select("subject_id", "fold")


@query("X3", """select subject_id, case when i <= round_even(0.7::double * n, 0) then 'train'
when i <= round_even(0.7::double * n, 0) + round_even(0.1::double * n, 0) then 'val' else 'test' end as fold
from (select subject_id, count(*) over () as n,
row_number() over (order by md5('42:' || subject_id), subject_id) as i from cohort)""")
def split_at_random(b):
    return SP.split_at_random(b.cohort().select("subject_id"))


STRATA = """(select subject_id, case when subject_id % 10 <> 0 then in_hosp_mortality end as stratum from cohort)"""


@query("X4", f"""select subject_id, stratum, case when stratum is null then 'test'
when i <= round_even(0.7::double * n, 0) then 'train'
when i <= round_even(0.7::double * n, 0) + round_even(0.1::double * n, 0) then 'val' else 'test' end as fold
from (select subject_id, stratum, count(*) over (partition by stratum) as n, row_number() over
(partition by stratum order by md5('42:' || subject_id), subject_id) as i from {STRATA})""")
def split_stratified(b):
    s = b.cohort().select("subject_id", F.when(F.col("subject_id") % 10 != 0, F.col("in_hosp_mortality"))
                          .alias("stratum"))
    return SP.split_at_random(s, stratum="stratum").select("subject_id", "stratum", "fold")


@query("X5", """select subject_id, case when i <= n - t - v then 'train' when i <= n - t then 'val' else 'test' end as fold
from (select *, ceil((n - t) * 0.25::double) as v from (select subject_id, n, i, ceil(n * 0.2::double) as t from
(select subject_id, count(*) over () as n, row_number() over (order by md5('42:' || subject_id), subject_id) as i
from cohort)))""")
def split_sixty_twenty_twenty(b):
    return SP.split_sixty_twenty_twenty(b.cohort().select("subject_id"))


@query("X6", """select subject_id,
coalesce(diab_base and diab_first_event_time <= index_time + interval 365 day, false)
or coalesce(cvd_base and cvd_first_event_time <= index_time + interval 365 day, false) as stratum from incident""")
def stratum_any_incident(b):
    c = b.stored_cohort()
    labels = EV.incident_labels(c, b.diagnoses(), b.admissions())
    return SP.attach_stratum(c.select("subject_id"), labels, "any_incident_365d")


@query("X7", f"""select fold, count(*) as n, count(distinct subject_id) as n_subjects, {B('sum(y)', 'positives')}
from matrix group by 1""")
def split_fold_summary(b):
    return SP.fold_summary(b.matrix(), "y")


@query("X7", """select cast(count(*) filter (fold = 'train') = 0 as int) as train_empty,
cast(count(*) filter (fold = 'val') = 0 as int) as val_empty, cast(count(*) filter (fold = 'test') = 0 as int) as test_empty,
(select count(*) from (select o_custkey from orders group by 1 having count(*) > 1)) as repeated_subjects,
(select count(*) from (select o_custkey from orders group by 1 having count(distinct o_orderkey % 2) > 1)) as subjects_in_two_folds
from (select case when o_orderkey % 2 = 0 then 'train' else 'val' end as fold from orders)""")
def split_integrity(b):
    bad = b.table("orders").select(F.col("o_custkey").alias("subject_id"),
                                   F.when(F.col("o_orderkey") % 2 == 0, "train").otherwise("val").alias("fold"))
    return SP.split_problems(bad)


# --- preparation ------------------------------------------------------------------------


def _train(b: Bindings):
    return b.matrix().where("fold = 'train'")


@query("I1", f"""select fold, {', '.join(f'cast(count(*) filter ({c} is null) as double) as {c}__mis' for c in MATRIX_FEATURES)}
from matrix group by 1""")
def missing_indicators(b):
    out = PR.missing_indicators(b.matrix(), MATRIX_FEATURES)
    return out.groupBy("fold").agg(*[F.sum(f"{c}__mis").alias(f"{c}__mis") for c in MATRIX_FEATURES])


@query("I2 I6", " union all ".join(f"""select '{c}' as feature, case when count({c}) = 0 then 'empty'
when min({c}) = max({c}) then 'constant' else 'kept' end as state,
coalesce(bool_and({c} in (0, 1)) filter ({c} is not null), false) and min({c}) < max({c}) is true as is_binary
from matrix where fold = 'train'""".replace(f"and min({c}) < max({c}) is true", f"and coalesce(min({c}) < max({c}), false)")
                                   for c in MATRIX_FEATURES))
def dropped_and_binary_columns(b):
    prep = PR.fit(_train(b), MATRIX_FEATURES, scaler="none")
    return PR.parameter_rows(b.spark, prep).where(~F.col("is_indicator")).select("feature", "state", "is_binary")


USED = [c for c in MATRIX_FEATURES if c not in ("f_const", "f_empty")]


@query("I3", " union all ".join(f"select '{c}' as feature, {R(f'median({c})', 'fill')} from matrix where fold = 'train'"
                                for c in USED))
def impute_medians(b):
    return rounded(PR.medians(_train(b), USED))


@query("I4", " union all ".join(f"""(select '{c}' as feature, {R(c, 'fill')} from matrix where fold = 'train' and {c} is not null
group by {c} order by count(*) desc, {c} limit 1)""" for c in USED))
def impute_most_frequent(b):
    return rounded(PR.modes(_train(b), USED))


SCALED = [c for c in USED if c != "f_urgent"]
WITH_NULLS = ["f_lines", "f_qty", "f_disc", "f_tax", "f_urgent"]


def scaled_sql(centre, spread) -> str:
    mis = [f"{c}__mis" for c in WITH_NULLS]
    cols = [*SCALED, *mis]
    return f"""with med as (select {', '.join(f'median({c}) as m_{c}' for c in USED)} from matrix where fold = 'train'),
im as (select subject_id, fold, {', '.join(f'coalesce({c}, m_{c}) as {c}' for c in USED)},
{', '.join(f'cast({c} is null as double) as {c}__mis' for c in WITH_NULLS)} from matrix, med),
st as (select {', '.join(f'{centre(c)} as c_{c}, {spread(c)} as s_{c}' for c in cols)} from im where fold = 'train')
select subject_id, fold, case when f_urgent >= 0.5 then 1.0::double else 0.0::double end as f_urgent,
{', '.join(R(f'({c} - c_{c}) / case when s_{c} = 0 then 1 else s_{c} end', c) for c in cols)} from im, st"""


def _apply_prep(b, **kw):
    m = b.stored_matrix()
    prep = PR.fit(_fold(m, "train"), MATRIX_FEATURES, **kw)
    return PR.apply(m.drop("y"), prep)


@query("I3 I6 I7", scaled_sql(lambda c: f"avg({c})", lambda c: f"stddev_pop({c})"))
def scale_standard(b):
    return rounded(_apply_prep(b, scaler="standard"))


@query("I8", scaled_sql(lambda c: f"median({c})",
                        lambda c: f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def scale_robust(b):
    return rounded(_apply_prep(b, scaler="robust"))


def _poly_sql(coefs, x: str) -> str:
    out = f"({coefs[0]!r}::double)"
    for k in coefs[1:]:
        out = f"({out} * {x} + {k!r}::double)"
    return out


def quantile_normal_sql() -> str:
    """The quantile scaler over sorted lists: knots, levels, then the inverse normal."""
    cols = [*SCALED, *[f"{c}__mis" for c in WITH_NULLS]]
    tail_lo, tail_hi = "sqrt(-2 * ln(p))", "sqrt(-2 * ln(1 - p))"
    r = "((p - 0.5) * (p - 0.5))"
    low = f"{_poly_sql(C._INV_C, 't1')} / {_poly_sql(C._INV_D, 't1')}"
    high = f"-{_poly_sql(C._INV_C, 't2')} / {_poly_sql(C._INV_D, 't2')}"
    mid = f"(p - 0.5) * {_poly_sql(C._INV_A, 'r')} / {_poly_sql(C._INV_B, 'r')}"
    limit = f"{PR.NORMAL_LIMIT!r}::double"
    return f"""with med as (select {', '.join(f'median({c}) as m_{c}' for c in USED)} from matrix where fold = 'train'),
im as (select subject_id, fold, {', '.join(f'coalesce({c}, m_{c}) as {c}' for c in USED)},
{', '.join(f'cast({c} is null as double) as {c}__mis' for c in WITH_NULLS)} from matrix, med),
long as (select subject_id, fold, feature, x from im unpivot (x for feature in ({', '.join(cols)}))),
tl as (select feature, list_sort(list(x)) as s, count(*) as n, least(count(*), 1000, greatest(10, count(*) // 2)) as m
 from long where fold = 'train' group by 1),
spot as (select feature, i, m, s[cast(floor(pos) as bigint) + 1] as a, s[cast(ceil(pos) as bigint) + 1] as b, pos - floor(pos) as f
 from (select *, (n - 1)::double * (i / (m - 1)) as pos from (select *, unnest(range(m)) as i from tl))),
kn as (select feature, i, m, case when a = b then a when f < 0.5 then a + (b - a) * f else b - (b - a) * (1 - f) end as v from spot),
uk as (select feature, v, min(i) / (m - 1) as lo, max(i) / (m - 1) as hi from kn group by feature, v, m),
nx as (select *, lead(v) over w as v2, lead(lo) over w as lo2 from uk window w as (partition by feature order by v)),
ends as (select feature as ef, min(v) as vmin, max(v) as vmax from uk group by 1),
lev as (select subject_id, l.feature, case when x <= vmin then 0.0::double when x >= vmax then 1.0::double
 when x = v then (lo + hi) / 2 else hi + (x - v) / (v2 - v) * (lo2 - hi) end as p
 from long l join ends on ef = l.feature asof left join nx on l.feature = nx.feature and l.x >= nx.v),
tails as (select *, case when p > 0 then {tail_lo} end as t1, case when p < 1 then {tail_hi} end as t2, {r} as r from lev),
z as (select subject_id, feature, case when p <= 1e-7 then -{limit} when p >= 1.0::double - 1e-7 then {limit}
 when p < 0.02425::double then {low} when p > 1.0::double - 0.02425 then {high} else {mid} end as z from tails),
wide as (select subject_id, {', '.join(f"max(z) filter (feature = '{c}') as {c}" for c in cols)} from z group by 1)
select im.subject_id, im.fold, case when f_urgent >= 0.5 then 1.0::double else 0.0::double end as f_urgent,
{', '.join(R('wide.' + c, c) for c in cols)} from im join wide using (subject_id)"""


@query("I9", quantile_normal_sql())
def scale_quantile_normal(b):
    return rounded(_apply_prep(b, scaler="quantile"))


@query("I10 F6", scaled_sql(lambda c: f"avg({c})", lambda c: f"stddev_pop({c})"))
def stored_preparation(b):
    path = fresh_path(b.spark, "prep")
    m = b.stored_matrix()
    PR.parameter_rows(b.spark, PR.fit(_fold(m, "train"), MATRIX_FEATURES)).write.parquet(path)
    prep = PR.from_parameter_rows(b.spark.read.parquet(path), "standard")
    return rounded(PR.apply(m.drop("y"), prep))


CHAINED = ["f_tax", "f_urgent", "f_signal"]


def _plane(y: str, u: str, v: str) -> str:
    """Level and slopes of y on u and v over the training rows that have y, from their covariances."""
    def cov(a, b):
        return f"covar_pop({a}, {b}) filter (not no_{y} and fold = 'train')"

    det = f"({cov(u, u)} * {cov(v, v)} - {cov(u, v)} * {cov(u, v)})"
    bu = f"(({cov(u, y)} * {cov(v, v)} - {cov(v, y)} * {cov(u, v)}) / {det})"
    bv = f"(({cov(v, y)} * {cov(u, u)} - {cov(u, y)} * {cov(u, v)}) / {det})"
    mean = lambda x: f"avg({x}) filter (not no_{y} and fold = 'train')"
    return f"{mean(y)} - {bu} * {mean(u)} - {bv} * {mean(v)} as {y}0, {bu} as {y}1, {bv} as {y}2"


def chained_sql() -> str:
    """Ten rounds of two regressions on two columns each: urgent has fewer gaps, so it is filled first."""
    step = f"""select i + 1, subject_id, fold, no_f_tax, no_f_urgent, f_signal,
 case when no_f_tax then f_tax0 + f_tax1 * u2 + f_tax2 * f_signal else f_tax end, u2
 from (select *, case when no_f_urgent then f_urgent0 + f_urgent1 * f_tax + f_urgent2 * f_signal else f_urgent end as u2
 from turn, (select {_plane('f_tax', 'f_urgent', 'f_signal')}, {_plane('f_urgent', 'f_tax', 'f_signal')} from turn) where i < 10)"""
    return f"""with recursive means as (select avg(f_tax) as mt, avg(f_urgent) as mu from matrix where fold = 'train'),
gaps as (select subject_id, fold, f_tax is null as no_f_tax, f_urgent is null as no_f_urgent, f_signal,
 coalesce(f_tax, mt) as f_tax, coalesce(f_urgent, mu) as f_urgent from matrix, means),
turn(i, subject_id, fold, no_f_tax, no_f_urgent, f_signal, f_tax, f_urgent) as (select 0, * from gaps union all {step})
select subject_id, fold, {R('f_tax')}, {R('f_urgent')}, {R('f_signal')},
cast(no_f_tax as double) as f_tax__mis, cast(no_f_urgent as double) as f_urgent__mis from turn where i = 10"""


def _chained_prep(b):
    m = b.stored_matrix().select("subject_id", "fold", *CHAINED)
    return m, PR.fit(_fold(m, "train"), CHAINED, imputer="iterative", scaler="none", keep_binary=False)


@query("I5", chained_sql())
def impute_iterative(b):
    m, prep = _chained_prep(b)
    return rounded(PR.impute(m, prep))


@query("I5 I10", f"""{chained_sql().replace("where i = 10", "where i = 10 and fold <> 'train'")}""")
def impute_iterative_stored(b):
    """Fitted once, stored, read back and applied to the rows of the other folds alone."""
    m, prep = _chained_prep(b)
    path = fresh_path(b.spark, "chain")
    PR.parameter_rows(b.spark, prep).write.parquet(path)
    return rounded(PR.impute(m.where("fold <> 'train'"), PR.from_parameter_rows(b.spark.read.parquet(path), "none")))


# --- models -----------------------------------------------------------------------------

MODEL_FEATURES = ["f_price", "f_lines", "f_qty", "f_disc", "f_tax", "f_urgent", "f_signal"]


def _design(b: Bindings):
    m = b.stored_matrix()
    prep = PR.fit(_fold(m, "train"), MODEL_FEATURES, add_indicators=False)
    return PR.apply(m, prep), prep.output


def _test_metrics(b, fitted, design, features):
    s = M.score(fitted.model, _fold(design, "test"), features).withColumnRenamed("y_score", "score")
    out = E.metrics(s, [])
    return rounded(out.select(F.lit(str(fitted.setting)).alias("setting"), F.lit(fitted.val_score).alias("val_score"), "*"))


@query("M1 M4")
def train_logistic(b):
    d, f = _design(b)
    return _test_metrics(b, M.fit_logistic(_fold(d, "train"), _fold(d, "val"), f), d, f)


@query("M2 M4")
def train_forest(b):
    d, f = _design(b)
    grid = [(20, 6, 5), (20, 10, 5)]
    return _test_metrics(b, M.fit_forest(_fold(d, "train"), _fold(d, "val"), f, grid=grid), d, f)


@query("M3 M4")
def train_boosted(b):
    d, f = _design(b)
    grid = [(0.1, 3, 0.8, 0.8)]
    return _test_metrics(b, M.fit_boosted(_fold(d, "train"), _fold(d, "val"), f, grid=grid, rounds=10), d, f)


@query("M6")
def native_importances(b):
    d, f = _design(b)
    return rounded(M.native_importances(b.spark, M.fit_logistic(_fold(d, "train"), _fold(d, "val"), f)))


@query("M7")
def train_two_tasks(b):
    d, f = _design(b)
    d = d.withColumn("y_big", (F.col("f_price") > 0).cast("int"))
    fitted, _ = M.fit_two_tasks(_fold(d, "train"), _fold(d, "val"), f, ["y", "y_big"])
    return rounded(P.wide_task_predictions({t: M.score(m.model, _fold(d, "test"), f, t) for t, m in fitted.items()}))


@query("M8 M5")
def stored_model_scores(b):
    d, f = _design(b)
    fitted = M.fit_logistic(_fold(d, "train"), _fold(d, "val"), f)
    path = fresh_path(b.spark, "model")
    M.save_model(b.spark, fitted.model, path)
    return rounded(M.score(M.load_linear(b.spark, path), _fold(d, "test"), f))


COEF = {"f_signal": 4.0, "f_lines": -0.25037}
MARGIN_SQL = "(-2.0::double + 4.0::double * f_signal - 0.25037::double * f_lines)"


def _linear_rows(b: Bindings, fold: str | None = "test"):
    """Rows of the matrix with two features, label, margin and score of a fixed linear model."""
    m = b.matrix() if fold is None else _fold(b.matrix(), fold)
    m = m.select("subject_id", F.col("y").alias("y_true"), "f_signal", F.coalesce("f_lines", F.lit(0.0)).alias("f_lines"))
    return _with_margin(m)


def _with_margin(m):
    margin = F.lit(-2.0) + F.lit(4.0) * F.col("f_signal") - F.lit(0.25037) * F.col("f_lines")
    return m.withColumn("margin", margin).withColumn("score", C.sigmoid("margin"))


LINEAR = f"""lin_all as (select *, {MARGIN_SQL} as margin, 1 / (1 + exp(-{MARGIN_SQL})) as score from
(select subject_id, fold, y as y_true, f_signal, coalesce(f_lines, 0) as f_lines from matrix)),
lin as (select * exclude (fold) from lin_all where fold = 'test')"""


@query("M5", f"with {LINEAR} select subject_id, y_true, {R('score', 'y_score')} from lin")
def score_from_margin(b):
    rows = _linear_rows(b).drop("score")
    return rounded(M.score_from_margin(rows, "margin").select("subject_id", "y_true", "y_score"))


# --- metrics ------------------------------------------------------------------------------


def metrics_sql(rel: str, keys: str, eps: str = "1e-12") -> str:
    """Metrics per key by the rank-sum form, independent of the running-total form in Spark."""
    k = f"{keys}, " if keys else ""
    part = f"partition by {keys}" if keys else ""
    tie = f"partition by {k}s"
    return f"""select {k}case when p > 0 and p < n then (yr - p * (p + 1) / 2.0) / (p * (n - p)) end as auroc,
 ap / greatest(p, 1) as auprc, brier, case when p > 0 and p < n then ll end as logloss, p / n as pos_rate, n from
 (select {k}sum(y) as p, count(*) as n, sum(y * r) as yr, sum(y * tp / cnt) as ap, avg((s - y) * (s - y)) as brier,
  -avg(y * ln(s) + (1 - y) * ln(1 - s)) as ll from
  (select *, rank() over ({part} order by s) + (count(*) over ({tie}) - 1) / 2.0 as r,
   sum(y) over ({part} order by s desc) as tp, count(*) over ({part} order by s desc) as cnt from
   (select {k}y_true as y, greatest({eps}::double, least(1 - {eps}::double, score)) as s from {rel}))
  {'group by ' + keys if keys else ''})"""


METRIC_NAMES = ["auroc", "auprc", "brier", "logloss", "pos_rate"]
ROUNDED_METRICS = ", ".join(R(m) for m in METRIC_NAMES) + ", n"
EDGE_LIST = "[" + ", ".join(f"{e!r}::double" for e in equal_width_edges(15)) + "]"


def ece_sql(rel: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""select {k}sum(gap) / sum(bn) as ece from (select {k}bin, abs(sum(y_true) - sum(c)) as gap, count(*) as bn
 from (select *, len([e for e in {EDGE_LIST} if e <= c]) as bin from
 (select *, greatest(1e-6::double, least(1 - 1e-6::double, score)) as c from {rel})) group by all)
 {'group by ' + keys if keys else ''}"""


@query("E1 E2 E3 E4 E5", f"select variant, {ROUNDED_METRICS} from ({metrics_sql('long_preds', 'variant')})")
def score_metrics(b):
    return rounded(E.metrics(P.long_predictions(b.calibrated()), ["variant"]))


@query("E6", f"select variant, {R('ece')} from ({ece_sql('long_preds', 'variant')})")
def calibration_error(b):
    return rounded(E.calibration_error(P.long_predictions(b.calibrated()), ["variant"]))


@query("E7", f"""select variant, bin - 1 as bin, count(*) as n, {R('avg(score)', 'mean_score')},
{R('avg(y_true)', 'observed_rate')} from (select *, len([e for e in {"[" + ", ".join(f"{e!r}::double" for e in equal_width_edges(10)) + "]"}
if e <= score]) as bin from long_preds) where bin <= 10 group by all""")
def reliability_table(b):
    return rounded(E.reliability(P.long_predictions(b.calibrated()), ["variant"])
                   .withColumn("bin", F.col("bin").cast("bigint")))


RULES = [("raw", "low", 0.3), ("raw", "half", 0.5), ("alt", "half", 0.5), ("alt", "edge", 0.8), ("other", "x", 0.1)]
RULES_SQL = "rules as (select * from (values " + ", ".join(
    f"('{v}', '{r}', {t}::double)" for v, r, t in RULES) + ") t(variant, rule, threshold))"


def _rules(b):
    return b.spark.createDataFrame(RULES, "variant string, rule string, threshold double")


def confusion_sql(rel: str, keys: str, extra: str = "") -> str:
    return f"""select *, tp / greatest(1, tp + fn) as sens, tn / greatest(1, tn + fp) as spec, tp / greatest(1, tp + fp) as ppv,
 tn / greatest(1, tn + fn) as npv, (tp + tn) / greatest(1, tp + tn + fp + fn) as acc,
 2 * tp / greatest(1, 2 * tp + fp + fn) as f1 from (select {keys}, rule, threshold,
 count(*) filter (score >= threshold and y_true = 1) as tp, count(*) filter (score >= threshold and y_true = 0) as fp,
 count(*) filter (score < threshold and y_true = 0) as tn, count(*) filter (score < threshold and y_true = 1) as fn
 from {rel} join rules using (variant) group by {keys}, rule, threshold)"""


@query("E8", f"""with {RULES_SQL} select variant, rule, threshold, tp, fp, tn, fn, {R('sens', 'sensitivity')},
{R('spec', 'specificity')}, {R('ppv')}, {R('npv')}, {R('acc', 'accuracy')}, {R('f1')}
from ({confusion_sql('long_preds', 'variant')})""")
def confusion_at_thresholds(b):
    return rounded(E.confusion_at(P.long_predictions(b.calibrated()), _rules(b), ["variant"]))


SELECTED = """cand as (select distinct variant, score as t from long_preds union select variant, v from
(select distinct variant from long_preds), (values (0.0::double), (1.0::double)) z(v)),
tot as (select variant, sum(y_true) as p, count(*) as n from long_preds group by 1),
cum as (select c.variant, t, p, n, coalesce(sum(y_true), 0) as tp, count(y_true) - coalesce(sum(y_true), 0) as fp
 from cand c join tot using (variant) left join (select variant as lv, score, y_true from long_preds) l
 on l.lv = c.variant and l.score >= c.t group by all),
st as (select variant, t, tp / greatest(1, p) as sens, (n - p - fp) / greatest(1, n - p) as spec,
 2 * tp / greatest(1, tp + fp + p) as f1, abs((tp + fp) / n - p / n) as off from cum),
picked as (select variant, arg_max(t, (f1, sens, -t)) as f1_max, arg_max(t, (sens + spec - 1.0, -t)) as youden_j,
 arg_min(t, (off, t)) as match_prevalence,
 coalesce(arg_max(t, (spec, t)) filter (sens >= 0.8), 1.0) as fixed_sens_80,
 coalesce(arg_max(t, (spec, t)) filter (sens >= 0.9), 1.0) as fixed_sens_90 from st group by 1),
selected as (select variant, rule, threshold from picked unpivot (threshold for rule in
 (f1_max, youden_j, match_prevalence, fixed_sens_80, fixed_sens_90)))"""


@query("E9", f"with {SELECTED} select variant, rule, {R('threshold')} from selected")
def select_thresholds(b):
    return rounded(E.select_thresholds(P.long_predictions(b.calibrated()), ["variant"]))


@query("E10", f"""select variant, {R('score', 'threshold')}, {R('fp / (n - p)', 'fpr')}, {R('tp / p', 'tpr')} from
(select variant, score, sum(sum(y_true)) over w as tp, sum(sum(1 - y_true)) over w as fp,
sum(sum(y_true)) over (partition by variant) as p, sum(count(*)) over (partition by variant) as n
from long_preds group by 1, 2 window w as (partition by variant order by score desc))""")
def roc_points(b):
    return rounded(E.roc_points(P.long_predictions(b.calibrated()), ["variant"]))


@query("E10", f"""select variant, {R('score', 'threshold')}, {R('tp / p', 'recall')}, {R('tp / (tp + fp)', '"precision"')} from
(select variant, score, sum(sum(y_true)) over w as tp, sum(sum(1 - y_true)) over w as fp,
sum(sum(y_true)) over (partition by variant) as p
from long_preds group by 1, 2 window w as (partition by variant order by score desc))""")
def precision_recall_points(b):
    return rounded(E.pr_points(P.long_predictions(b.calibrated()), ["variant"]))


# --- one-feature models -------------------------------------------------------------------


def newton_sql(label: str) -> str:
    """Newton rounds of a logistic regression on one feature for every setting; the intercept is eliminated first."""
    grid = ", ".join(f"({i}, '{k}', {c!r}::double)" for i, (k, c) in enumerate(M.LOGISTIC_GRID))
    return f"""grid(nr, kind, c) as (values {grid}), tr as (select f_signal as x, {label} as y from matrix where fold = 'train'),
d as materialized (select x, sum(w) as wa, sum(w * y) as wp from (select x, y, case when y = 1 then n / (2.0 * p) else n / (2.0 * (n - p)) end as w
 from tr, (select count(*) as n, sum(y) as p from tr)) group by x),
fits(i, nr, kind, c, a, b) as (select 0, nr, kind, c, 0.0::double, 0.0::double from grid union all
 select i + 1, nr, kind, c, a - (g0 + h01 * (z - b)) / h00, z from
 (select *, case when kind = 'l2' then u * h / (h + 1) else sign(u) * greatest(abs(u) - 1 / h, 0) end as z from
 (select *, b - (g1 - g0 * h01 / h00) / h as u from (select *, h11 - h01 * h01 / h00 as h from
 (select i, nr, kind, c, a, b, c * sum(wa * q - wp) as g0, c * sum((wa * q - wp) * x) as g1, c * sum(wa * q * (1 - q)) as h00,
  c * sum(wa * q * (1 - q) * x) as h01, c * sum(wa * q * (1 - q) * x * x) as h11
  from (select *, 1 / (1 + exp(-(a + b * x))) as q from fits, d where i < 20) group by i, nr, kind, c, a, b)))))"""


def _one_feature(b):
    m = b.stored_matrix().select("subject_id", "fold", "f_signal", "y")
    return m, fit_grid(_fold(m, "train"), ["f_signal"], M.LOGISTIC_GRID, weights=_balance(_fold(m, "train")))


def _balance(train):
    w = M.class_balance(train).first()
    return w["weight_neg"], w["weight_pos"]


@query("M1 M4 A13", f"""with recursive {newton_sql('y')}, done as (select * from fits where i = 20),
vs as (select nr, y as y_true, 1 / (1 + exp(-(a + b * f_signal))) as score from matrix, done where fold = 'val'),
per as ({metrics_sql('vs', 'nr')})
select kind, c, {R('a', 'intercept')}, {R('b', 'coefficient')}, {R('auprc', 'val_auprc')}, {R('brier', 'val_brier')}
from done join per using (nr)""")
def logistic_grid(b):
    """All seven settings of the grid, fitted together, with their validation metrics."""
    m, models = _one_feature(b)
    val = M.validation_scores(models, _fold(m, "val"), ["f_signal"])
    rows = [(i, k, float(c), x.intercept, x.coefficients[0]) for i, ((k, c), x) in enumerate(zip(M.LOGISTIC_GRID, models))]
    fits = b.spark.createDataFrame(rows, "candidate int, kind string, c double, intercept double, coefficient double")
    return rounded(fits.join(val, "candidate").select("kind", "c", "intercept", "coefficient", F.col("auprc").alias("val_auprc"),
                                                      F.col("brier").alias("val_brier")))


@query("M6 M1", f"""with recursive {newton_sql('y')}
select 'f_signal' as feature, {R('b', 'value')}, 'coefficient' as kind, 'odds_ratio' as derived, {R('exp(b)', 'derived_value', 4)} from fits
where i = 20 and kind = 'l2' and c = 1""")
def logistic_importances(b):
    m = b.stored_matrix()
    fitted = M.fit_logistic(_fold(m, "train"), _fold(m, "val"), ["f_signal"], grid=[("l2", 1.0)])
    out = rounded(M.native_importances(b.spark, fitted).drop("derived_value"))
    return out.join(rounded(M.native_importances(b.spark, fitted).select("feature", "derived_value"), 4), "feature")


@query("M8 M5 M1", f"""with recursive {newton_sql('y')}
select subject_id, y as y_true, {R('1 / (1 + exp(-(a + b * f_signal)))', 'y_score')} from matrix, fits
where i = 20 and kind = 'l1' and c = 0.1 and fold = 'test'""")
def stored_logistic_scores(b):
    """A model written as a table, read back, and applied to the test fold."""
    m, models = _one_feature(b)
    path = fresh_path(b.spark, "linear-model")
    M.save_model(b.spark, models[M.LOGISTIC_GRID.index(("l1", 0.1))], path)
    return rounded(M.score(M.load_linear(b.spark, path), _fold(m, "test"), ["f_signal"]))


@query("M7 M1", f"""with recursive {newton_sql('y').replace('fits', 'fits_y').replace('grid(', 'grid_y(').replace('from grid ', 'from grid_y ').replace(' tr ', ' tr_y ').replace('from tr,', 'from tr_y,').replace('from tr)', 'from tr_y)').replace('d as materialized', 'd_y as materialized').replace('fits_y, d where', 'fits_y, d_y where')},
{newton_sql('(f_price > 250000)::int')}
select subject_id, y as y_y_true, (f_price > 250000)::int as y_big_y_true, {R('1 / (1 + exp(-(fy.a + fy.b * f_signal)))', 'y_y_score')},
{R('1 / (1 + exp(-(fb.a + fb.b * f_signal)))', 'y_big_y_score')} from matrix, fits_y fy, fits fb
where fy.i = 20 and fy.kind = 'l2' and fy.c = 1 and fb.i = 20 and fb.kind = 'l2' and fb.c = 1 and fold = 'test'""")
def two_task_scores(b):
    m = b.stored_matrix().withColumn("y_big", (F.col("f_price") > 250000).cast("int"))
    fitted, _ = M.fit_two_tasks(_fold(m, "train"), _fold(m, "val"), ["f_signal"], ["y", "y_big"], grid=[("l2", 1.0)])
    scores = {t: M.score(f.model, _fold(m, "test"), ["f_signal"], t) for t, f in fitted.items()}
    return rounded(P.wide_task_predictions(scores))


# --- calibration --------------------------------------------------------------------------


@query("E11", f"select {R('a')}, {R('b')} from platt_fit")
def platt_parameters(b):
    prm = K.fit_platt(b.folded_predictions("val"))
    return rounded(K.parameter_rows(b.spark, prm, None).select(F.col("x").alias("a"), F.col("y").alias("b")))


def _fitted(b):
    val = b.folded_predictions("val")
    return K.fit_platt(val), K.fit_isotonic(val)


@query("E11 E12", f"""select subject_id, y_true, {R('y_score_raw')}, {R('y_score_platt')}, {R('y_score_isotonic')}
from calibrated_preds where fold = 'test'""")
def calibrated_test_scores(b):
    return rounded(K.calibrated_scores(b.folded_predictions("test").drop("index_time"), *_fitted(b)))


CAL_LONG = """cal as (select fold, y_true, variant, score from (select fold, y_true, y_score_raw as raw,
y_score_platt as platt, y_score_isotonic as isotonic from calibrated_preds)
unpivot (score for variant in (raw, platt, isotonic)))"""


def _calibrated_long(b):
    platt, iso = _fitted(b)
    rows = b.predictions().withColumn("fold", prediction_fold("index_time"))
    cal = K.calibrated_scores(rows, platt, iso)
    scores = ["y_score_raw", "y_score_platt", "y_score_isotonic"]
    long = cal.unpivot(["subject_id", "y_true", "fold"], scores, "variant", "score")
    return long.withColumn("variant", F.regexp_replace("variant", "^y_score_", ""))


@query("E13 E6", f"""with {CAL_LONG} select fold, variant, {ROUNDED_METRICS}, {R('ece')} from
({metrics_sql('cal', 'fold, variant', '1e-6')}) join ({ece_sql('cal', 'fold, variant')}) using (fold, variant)""")
def calibration_comparison(b):
    return rounded(E.metrics_with_ece(_calibrated_long(b), ["fold", "variant"], eps=C.PROB_EPS))


@query("E13", f"""with {CAL_LONG} select arg_min(variant, (brier, variant)) as variant, {R('min(brier)', 'brier')} from
(select variant, avg((score - y_true) ** 2) as brier from cal where fold = 'val' group by 1)""")
def calibration_choice(b):
    m = E.metrics(_calibrated_long(b).where("fold = 'val'"), ["variant"])
    return rounded(K.best_variant(m))


# --- decision curves ------------------------------------------------------------------------

GRID_SQL = "grid as (select 0.01::double + i * 0.01::double as t from range(99) r(i))"
NB = """tp / n - fp / n * t / (1 - t)"""


@query("E14", f"""with {GRID_SQL} select variant, {R('t', 'threshold')}, n, {R('m', 'nb_model')}, {R('a', 'nb_all')},
0.0::double as nb_none, {R('100 * (m - a) / (t / (1 - t))', 'nri100')} from (select variant, t, n,
tp / n - fp / n * (t / (1 - t)) as m, p / n - (1 - p / n) * (t / (1 - t)) as a from (select variant, t, count(*) as n,
sum(y_true) as p, count(*) filter (score >= t and y_true = 1) as tp, count(*) filter (score >= t and y_true = 0) as fp
from long_preds, grid group by 1, 2))""")
def decision_curve(b):
    return rounded(E.decision_curve(P.long_predictions(b.calibrated()), ["variant"]))


@query("E15", f"""with {RULES_SQL} select variant, rule, threshold, n, {R('m', 'nb_model')}, {R('a', 'nb_all')},
0.0::double as nb_none, {R('100 * (m - a) / (threshold / (1 - threshold))', 'nri100')} from (select *,
tp / n - fp / n * (threshold / (1 - threshold)) as m, p / n - (1 - p / n) * (threshold / (1 - threshold)) as a from
(select *, tp + fn as p, tp + fp + tn + fn as n from ({confusion_sql('long_preds', 'variant')})))""")
def operating_points(b):
    return rounded(E.operating_points(P.long_predictions(b.calibrated()), _rules(b)))


# --- audits -----------------------------------------------------------------------------------


def _grouped(b):
    meta = E.group_labels(b.group_meta(), ["segment", "priority"])
    return E.with_groups(P.long_predictions(b.calibrated()), meta, ["segment", "priority"])


@query("E17 J7", f"""select variant, group_col, group_val, {', '.join(R(m) for m in METRIC_NAMES[:4])},
{R('pos_rate', 'prevalence')}, n from ({metrics_sql('grouped', 'variant, group_col, group_val')})""")
def group_metrics(b):
    return rounded(E.group_metrics(_grouped(b)))


GROUP_RATES = f"""gt as (select *, sens as tpr, 1 - spec as fpr, acc as accuracy, tp + fp + tn + fn as n from
({confusion_sql('grouped', 'variant, group_col, group_val')}))"""


@query("E18", f"""with {RULES_SQL}, {GROUP_RATES} select variant, group_col, group_val, rule, threshold, tp, fp, tn, fn,
{R('tpr')}, {R('fpr')}, {R('ppv')}, {R('npv')}, {R('accuracy')}, {R('f1')}, n from gt""")
def group_threshold_metrics(b):
    return rounded(E.group_threshold_metrics(_grouped(b), E.thresholds_for(_rules(b), ["raw", "alt"])))


GAPS = """gaps as (select variant, rule, group_col, metric, max(value) - min(value) as gap,
case when max(value) > 0 then min(value) / max(value) end as ratio
from (select variant, rule, group_col, tpr, fpr, ppv, npv, accuracy, f1 from gt)
unpivot (value for metric in (tpr, fpr, ppv, npv, accuracy, f1)) group by all)"""


@query("E19", f"""with {RULES_SQL}, {GROUP_RATES}, {GAPS} select variant, rule, group_col, metric, {R('gap', 'gap_max_min')},
{R('ratio', 'ratio_min_max')} from gaps""")
def parity_gaps(b):
    return rounded(E.parity_gaps(E.group_threshold_metrics(_grouped(b), _rules(b))))


@query("W8", f"""with {RULES_SQL}, {GROUP_RATES}, {GAPS}, best as (select variant as dir, metric,
arg_max({{'g': gap, 'r': ratio, 'c': group_col, 'u': rule}}, (gap, group_col, rule)) as x from gaps group by 1, 2)
select dir, metric, {R('x.g', 'worst_gap')}, {R('x.r', 'worst_ratio_min_max')}, x.c as at_group_col, x.u as rule from best""")
def worst_parity_gaps(b):
    g = E.parity_gaps(E.group_threshold_metrics(_grouped(b), _rules(b))).withColumnRenamed("variant", "dir")
    return rounded(E.worst_gaps(g))


@query("E20 W4", f"""with q1 as (select variant as v, list_sort(list_distinct(quantile_cont(score,
[{', '.join(str(i / 10) for i in range(11))}]))) as q from long_preds group by 1),
rows as (select variant, y_true, score, greatest(1, len([e for e in q if e < score])) as decile from long_preds join q1 on v = variant)
select variant, decile, {', '.join(R(m) for m in METRIC_NAMES[:4])}, {R('pos_rate', 'prevalence')}, n
from ({metrics_sql('rows', 'variant, decile')})""")
def risk_deciles(b):
    out = E.risk_deciles(P.long_predictions(b.calibrated()))
    return rounded(out.withColumn("decile", F.col("decile").cast("bigint")))


@query("E21", f"""with {LINEAR}, lf as (select y_true, cast((score >= 0.5) <> (y_true = 1) as int) as err, feature, value
from (select y_true, score, f_signal, f_lines from lin) unpivot (value for feature in (f_signal, f_lines))),
q1 as (select feature as f, list_sort(list_distinct(quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]))) as q from lf group by 1)
select feature, greatest(1, len([e for e in q if e < value])) as bin, count(*) as n, {R('avg(err)', 'error_rate')},
{R('avg(y_true)', 'prevalence')} from lf join q1 on f = feature group by 1, 2""")
def error_slices(b):
    out = E.error_slices(_linear_rows(b), ["f_signal", "f_lines"])
    return rounded(out.withColumn("bin", F.col("bin").cast("bigint")))


REPLICATES = 1000
DRAWN = f"""drawn as (select * from (select id, rep, list_sum([cast(u >= c as int) for c in {BS.LIMITS}])::bigint as w from
(select id, rep, ((x * x + s2) % {BS.PRIME}) >> 15 as u from (select *, (s0 + rep * s1) % {BS.PRIME} as x from
(select id, ('0x' || substr(h, 1, 8))::bigint % {BS.PRIME} as s0, ('0x' || substr(h, 9, 8))::bigint % {BS.PRIME} as s1,
('0x' || substr(h, 17, 8))::bigint % {BS.PRIME} as s2 from (select distinct subject_id as id, md5('42:' || subject_id) as h
from long_preds)), range({REPLICATES}) r(rep)))) where w > 0)"""


def replicate_metrics_sql(rel: str, keys: str) -> str:
    """Metrics per key and replicate from weighted counts per distinct score, by running sums from the top."""
    return f"""select {keys}, rep, case when p > 0 and q > 0 then pairs / (p * q) end as auroc, steps / greatest(p, 1) as auprc,
square / (p + q) as brier, case when p > 0 and q > 0 then lg / (p + q) end as logloss from
(select {keys}, rep, sum(pos)::double as p, sum(neg)::double as q, sum(neg * (tp - pos / 2.0)) as pairs,
 sum(pos * tp / (tp + fp)) as steps, sum(pos * (1 - s) * (1 - s) + neg * s * s) as square, -sum(pos * ln(s) + neg * ln(1 - s)) as lg
 from (select *, sum(pos) over w as tp, sum(neg) over w as fp from (select {keys}, rep, s, sum(w * y_true)::double as pos,
  sum(w * (1 - y_true))::double as neg from (select *, greatest(1e-12::double, least(1 - 1e-12::double, score)) as s from {rel})
  join drawn on id = subject_id group by all)
  window w as (partition by {keys}, rep order by s desc rows between unbounded preceding and current row)) group by {keys}, rep)"""


def _interval(names, label="_ci") -> str:
    return ", ".join(f"{R(f'quantile_cont({m}, 0.025)', f'{m}{label}_lo')}, {R(f'quantile_cont({m}, 0.975)', f'{m}{label}_hi')}" for m in names)


@query("E16 E17", f"""with {DRAWN}, reps as ({replicate_metrics_sql('grouped', 'variant, group_col, group_val')})
select variant, group_col, group_val, {_interval(METRIC_NAMES[:4])} from reps group by 1, 2, 3""")
def group_metric_intervals(b):
    return rounded(BS.group_metric_intervals(_grouped(b), REPLICATES))


@query("E16 E18", f"""with {RULES_SQL}, {DRAWN}, counts as (select variant, group_col, group_val, rule, rep,
coalesce(sum(w * y_true) filter (score >= threshold), 0)::double as tp, coalesce(sum(w * (1 - y_true)) filter (score >= threshold), 0)::double as fp,
coalesce(sum(w * y_true) filter (score < threshold), 0)::double as fn, coalesce(sum(w * (1 - y_true)) filter (score < threshold), 0)::double as tn
from grouped join drawn on id = subject_id join rules using (variant) group by all),
reps as (select *, case when tp + fn > 0 then tp / (tp + fn) end as tpr, case when tn + fp > 0 then 1 - tn / (tn + fp) end as fpr,
case when tp + fp > 0 then tp / (tp + fp) end as ppv, case when tn + fn > 0 then tn / (tn + fn) end as npv,
case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) end as f1 from counts)
select variant, group_col, group_val, rule, {_interval(('tpr', 'fpr', 'ppv', 'npv', 'f1'))} from reps group by 1, 2, 3, 4""")
def group_threshold_intervals(b):
    return rounded(BS.group_threshold_intervals(_grouped(b), _rules(b), REPLICATES))


@query("E16 E14", f"""with {DRAWN}, {GRID_SQL},
cells as (select variant, rep, len([g for g in (select list(t order by t) from grid) if g <= score]) as k,
sum(w * y_true)::double as pos, sum(w * (1 - y_true))::double as neg from long_preds join drawn on id = subject_id group by all),
sums as (select variant, rep, t, coalesce(sum(pos) filter (k >= i), 0) as tp, coalesce(sum(neg) filter (k >= i), 0) as fp,
sum(pos + neg) as n from cells, (select t, row_number() over (order by t) as i from grid) group by all),
reps as (select *, tp / n - fp / n * (t / (1 - t)) as nb_model from sums)
select variant, {R('t', 'threshold')}, {_interval(['nb_model'], '')} from reps group by 1, 2""")
def decision_curve_intervals(b):
    return rounded(BS.decision_curve_intervals(P.long_predictions(b.calibrated()), ["variant"], REPLICATES))


# --- explanation --------------------------------------------------------------------------------

#: A linear model over every usable feature, absent values being 0.
WIDE_COEF = {"f_price": 1.5e-6, "f_lines": -0.25037, "f_qty": 0.0102, "f_disc": 3.1, "f_tax": -2.3, "f_urgent": 0.4, "f_signal": 4.0}
WIDE_MARGIN = "round(-2.0::double + " + " + ".join(f"({c!r}::double) * {f}" for f, c in WIDE_COEF.items()) + ", 12)"


def _wide_rows(b: Bindings):
    rows = _fold(b.matrix(), "test").select("subject_id", F.col("y").alias("y_true"), *[
        F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in WIDE_COEF])
    margin = F.lit(-2.0)
    for f, c in WIDE_COEF.items():
        margin = margin + F.lit(c) * F.col(f)
    return rows.withColumn("margin", F.round(margin, 12)).withColumn("score", C.sigmoid("margin"))


PERMUTED = f"""wide as (select *, 1 / (1 + exp(-margin)) as score from (select *, {WIDE_MARGIN} as margin from
(select subject_id, y as y_true, {', '.join(f'coalesce({f}, 0) as {f}' for f in WIDE_COEF)} from matrix where fold = 'test'))),
placed as (select w.*, rep, count(*) over (partition by rep) as n, row_number() over (partition by rep
 order by md5('42:order:' || rep || ':' || subject_id), subject_id) as pos from wide w, range(10) r(rep)),
turned as (select *, (pos - 1 - (1 + ('0x' || substr(md5('42:turn:' || rep), 1, 8))::bigint % (n - 1)) + n) % n + 1 as to_pos from placed),
swaps as (select t.rep, t.y_true, t.margin, feature, old, new from
 (select rep, pos, y_true, margin, feature, old from placed unpivot (old for feature in ({', '.join(WIDE_COEF)}))) t
 join (select rep as gr, to_pos, gf, new from turned unpivot (new for gf in ({', '.join(WIDE_COEF)}))) on gr = rep and to_pos = pos and gf = feature),
moved as (select feature, rep, y_true, 1 / (1 + exp(-round(margin + case feature {' '.join(f"when '{f}' then ({c!r}::double)" for f, c in WIDE_COEF.items())}
 end * (new - old), 12))) as score from swaps)"""


@query("E22", f"""with {PERMUTED}, base as ({metrics_sql('wide', '')}), per as ({metrics_sql('moved', 'feature, rep')})
select feature, {R('avg(base.auprc - per.auprc)', 'perm_importance_mean')},
{R('stddev_pop(base.auprc - per.auprc)', 'perm_importance_std')} from per, base group by 1""")
def permutation_importance(b):
    return rounded(X.permutation_importance(_wide_rows(b), list(WIDE_COEF), X.linear_rescore(WIDE_COEF), "auprc"))


@query("E23", f"""with {LINEAR}, m as (select avg(f_signal) as ms, avg(f_lines) as ml from lin_all where fold = 'val')
select feature, {R('avg(abs(a))', 'shap_mean_abs')}, {R('avg(a)', 'shap_mean')}, {R('stddev_pop(abs(a))', 'shap_std_abs')}
from (select 'f_signal' as feature, 4.0::double * (f_signal - ms) as a from lin, m union all
select 'f_lines', -0.25037::double * (f_lines - ml) from lin, m) group by 1""")
def linear_attribution(b):
    return rounded(X.linear_attribution(_linear_rows(b), COEF, _linear_rows(b, "val")))


@query("W7", f"""with {LINEAR}, m as (select avg(f_signal) as ms, avg(f_lines) as ml from lin)
select arg_max(feature, v) as feature, max(n) as n from (select 'f_signal' as feature, count(*) as n,
avg(abs(4.0::double * (f_signal - ms))) as v from lin, m union all
select 'f_lines', count(*), avg(abs(-0.25037::double * (f_lines - ml))) from lin, m)""")
def top_feature_names(b):
    rows = _linear_rows(b)
    best = E.top_features(X.linear_attribution(rows, COEF), 1)
    return rows.agg(F.lit(best[0]).alias("feature"), F.count(F.lit(1)).alias("n"))


# --- external validation and robustness ------------------------------------------------------------

EXTERNAL = f"""{LINEAR}, ext as (select subject_id, y_true, score as raw, 1 / (1 + exp(-(b + a * ln(cl / (1 - cl))))) as platt,
coalesce(i.v, (select arg_min(v, s) from iso_fit)) as isotonic from (select *, greatest(1e-6::double, least(1 - 1e-6::double,
score)) as cl from lin) f cross join platt_fit asof left join iso_fit i on f.score >= i.s),
ext_long as (select y_true, variant, score from ext unpivot (score for variant in (raw, platt, isotonic)))"""


def _external(b):
    """Another cohort's scores under calibrators that were fitted on the validation fold, stored and read back."""
    path = fresh_path(b.spark, "calibrators")
    K.parameter_rows(b.spark, *_fitted(b)).write.parquet(path)
    platt, isotonic = K.from_parameter_rows(b.spark.read.parquet(path))
    m = _fold(b.matrix(), "test").select("subject_id", "f_signal", F.coalesce("f_lines", F.lit(0.0)).alias("f_lines"))
    labels = b.matrix().select("subject_id", "y")
    return RB.external_scores(m, labels, "y", lambda d: _with_margin(d).withColumnRenamed("score", "y_score"), platt, isotonic)


@query("E24", f"""with {EXTERNAL} select variant, {ROUNDED_METRICS}, {R('ece')} from ({metrics_sql('ext_long', 'variant')})
join ({ece_sql('ext_long', 'variant')}) using (variant)""")
def external_validation(b):
    return rounded(RB.external_validation(_external(b))[0])


@query("E24 E8", f"""with {EXTERNAL}, rules as (select 'raw' as variant, 'half' as rule, 0.5::double as threshold)
select variant, rule, threshold, tp, fp, tn, fn, {R('sens', 'sensitivity')}, {R('spec', 'specificity')}, {R('ppv')}, {R('npv')},
{R('acc', 'accuracy')}, {R('f1')} from ({confusion_sql('ext_long', 'variant')})""")
def external_thresholds(b):
    rules = b.spark.createDataFrame([("raw", "half", 0.5)], "variant string, rule string, threshold double")
    return rounded(RB.external_validation(_external(b), rules)[1])


NORMAL = """sqrt(-2.0::double * ln((('0x' || substr(h, 1, 8))::bigint + 1.0::double) / 4294967296.0::double))
 * cos(6.283185307179586::double * (('0x' || substr(h, 9, 8))::bigint / 4294967296.0::double))"""


def _scenario_sql() -> str:
    noise = lambda f: f"{f} + 0.5::double * case when sd_{f} = 0 then 1 else sd_{f} end * z_{f}"
    z = lambda f: NORMAL.replace("h,", f"md5('123:{f}:' || subject_id),") + f" as z_{f}"
    return f"""{LINEAR}, sd as (select stddev_pop(f_signal) as sd_f_signal, stddev_pop(f_lines) as sd_f_lines,
avg(f_signal) as mean_signal from lin),
scen as (select 'base' as scenario, subject_id, y_true, f_signal, f_lines from lin union all
select 'ablate_mean_1', subject_id, y_true, mean_signal, f_lines from lin, sd union all
select 'noise_0.5', subject_id, y_true, {noise('f_signal')}, {noise('f_lines')} from
(select *, {z('f_signal')}, {z('f_lines')} from lin), sd),
scored as (select scenario, subject_id, y_true, 1 / (1 + exp(-{MARGIN_SQL})) as score from scen)"""


def _scenarios(b):
    m = stored(_linear_rows(b).drop("margin", "score"), "scenario-matrix")
    return _with_margin(RB.matrix_scenarios(m, ["f_signal", "f_lines"], ["f_signal"], "mean", [0.5])) \
        .select("scenario", "subject_id", "y_true", "score")


@query("E25 E26", f"""with {_scenario_sql()} select scenario, subject_id, {R('score')} from scored""")
def scenario_scores(b):
    return rounded(_scenarios(b).select("scenario", "subject_id", "score"))


@query("E25", f"""with {LINEAR} select subject_id, 0.0::double as f_signal, {R('f_lines')} from lin""")
def ablate_to_zero(b):
    return rounded(RB.ablate(_linear_rows(b), ["f_signal", "absent"], "zero").select("subject_id", "f_signal", "f_lines"))


def _slices(b, by):
    long = P.long_predictions(b.calibrated())
    return RB.time_slice_rows(long, b.group_meta(), by)


@query("E27 P6", f"""with s as (select l.variant, y_true, score, 'time_quarter_' || year(index_time) || 'Q' || quarter(index_time) as scenario
from long_preds l join group_meta using (subject_id))
select scenario, variant, {ROUNDED_METRICS} from ({metrics_sql('s', 'scenario, variant')})""")
def time_slice_metrics(b):
    return rounded(E.metrics(_slices(b, "quarter"), ["scenario", "variant"]))


@query("E28", f"""with {LINEAR}, alt as (select 'y' as label, score, y_true from lin union all
select 'y_big', score, cast(f_price > 250000 as int) from lin join (select subject_id, f_price from matrix) using (subject_id))
select label, {ROUNDED_METRICS} from ({metrics_sql('alt', 'label')})""")
def alternative_labels(b):
    scored = _linear_rows(b).select("subject_id", "score")
    labels = b.matrix().select("subject_id", "y", (F.col("f_price") > 250000).alias("y_big"))
    return rounded(E.metrics(RB.scored_labels(scored, labels, ["y", "y_big"]), ["label"]))


RESULTS = f"""{_scenario_sql()}, rows as (select scenario, 'raw' as variant, 'y' as label, y_true, score from scored),
results as (select scenario, variant, label, auroc, auprc, brier, logloss, pos_rate, n, ece from
({metrics_sql('rows', 'scenario, variant, label')}) join ({ece_sql('rows', 'scenario, variant, label')})
using (scenario, variant, label))"""


def _results(b):
    long = _scenarios(b).select("scenario", F.lit("raw").alias("variant"), F.lit("y").alias("label"), "y_true", "score")
    return RB.scenario_results(long)[0]


@query("E29 E25 E26", f"with {RESULTS} select scenario, variant, label, {ROUNDED_METRICS}, {R('ece')} from results")
def scenario_results(b):
    return rounded(_results(b))


WHOLE = f"""{_scenario_sql()}, big as (select subject_id, cast(f_price > 250000 as int) as y_big from matrix),
whole as (select scenario, 'y' as label, subject_id, y_true, score from scored union all
select 'base', 'y_big', subject_id, y_big, score from scored join big using (subject_id) where scenario = 'base' union all
select 'time_quarter_' || year(index_time) || 'Q' || quarter(index_time), 'y', subject_id, y_true, score
from scored join (select subject_id, index_time from group_meta) using (subject_id) where scenario = 'base'),
rows as (select *, 'raw' as variant from whole)"""


def _whole_scenarios(b):
    """Base, ablation of the feature that ranks first, noise, other labels and time slices of one model's scores."""
    m = stored(_linear_rows(b).drop("margin", "score"), "scenario-matrix")
    first = E.top_features(X.linear_attribution(m, COEF), 1)
    scored = _with_margin(RB.matrix_scenarios(m, ["f_signal", "f_lines"], first, "mean", [0.5])).select("scenario", "subject_id", "score")
    labels = b.matrix().select("subject_id", "y", (F.col("f_price") > 250000).alias("y_big"))
    return RB.scenario_rows(scored, labels, ["y", "y_big"], b.group_meta()).withColumn("variant", F.lit("raw"))


def _half(b):
    return b.spark.createDataFrame([("raw", "half", 0.5), ("raw", "low", 0.2)], "variant string, rule string, threshold double")


@query("E29 E25 E26 E27 E28 W7", f"""with {WHOLE} select scenario, variant, label, {ROUNDED_METRICS}, {R('ece')} from
({metrics_sql('rows', 'scenario, variant, label')}) join ({ece_sql('rows', 'scenario, variant, label')}) using (scenario, variant, label)""")
def scenario_table(b):
    return rounded(RB.scenario_results(_whole_scenarios(b))[0])


@query("E29 E8", f"""with {WHOLE}, rules as (select 'raw' as variant, * from (values ('half', 0.5::double), ('low', 0.2::double)) t(rule, threshold))
select scenario, variant, label, rule, threshold, tp, fp, tn, fn, {R('sens', 'sensitivity')}, {R('spec', 'specificity')}, {R('ppv')}, {R('npv')},
{R('acc', 'accuracy')}, {R('f1')} from ({confusion_sql('rows', 'scenario, variant, label')})""")
def scenario_threshold_table(b):
    return rounded(RB.scenario_results(_whole_scenarios(b), _half(b))[1])


@query("J11", f"""with {RESULTS} select 'raw' as variant, 'y' as label, r.scenario, {R('r.auroc - b.auroc', 'd_auroc')},
{R('r.auprc - b.auprc', 'd_auprc')}, {R('r.ece - b.ece', 'd_ece')}, r.n, {R('r.pos_rate', 'pos_rate')}
from results r, results b where b.scenario = 'base' and r.scenario <> 'base'""")
def deltas_to_base(b):
    return rounded(E.deltas_to_base(_results(b)))


# --- artifacts ---------------------------------------------------------------------------------------

FOLD_METRICS = f"""fm as (select case when index_time < timestamp '1998-07-01' then 'validation' else 'test' end as split, variant,
y_true, score from long_preds join group_meta using (subject_id)), met as ({metrics_sql('fm', 'split, variant')}), cal as ({ece_sql('fm', 'split, variant')})"""


def _artifact_metrics(b):
    long = P.long_predictions(b.calibrated()).join(b.group_meta().select("subject_id", "index_time"), "subject_id") \
        .withColumn("split", F.when(prediction_fold("index_time") == "val", "validation").otherwise("test"))
    return E.metrics_with_ece(long, ["split", "variant"])


def _write_json(df, path):
    """One JSON document (a handful of metrics) as one text file below the path."""
    df.coalesce(1).write.text(path)


def _write_calibration_json(b):
    values = F.create_map(*[x for m in ("auroc", "auprc", "brier", "logloss", "ece") for x in (F.lit(m), F.col(m))])
    per = _artifact_metrics(b).groupBy("split").agg(
        F.map_from_entries(F.collect_list(F.struct("variant", values.alias("v")))).alias("m"))
    doc = per.agg(F.max(F.when(F.col("split") == "validation", F.to_json("m"))).alias("v"),
                  F.max(F.when(F.col("split") == "test", F.to_json("m"))).alias("t"))
    path = fresh_path(b.spark, "metrics")
    _write_json(doc.select(F.format_string('{"ece_bins": 15, "validation": %s, "test": %s}', "v", "t")), path)
    return path


@query("S10", f"""with {FOLD_METRICS} select split, variant, {', '.join(R(m) for m in METRIC_NAMES[:4])}, {R('ece')}
from met join cal using (split, variant)""")
def artifact_metric_rows(b):
    return rounded(A.calibration_metric_rows(b.spark, _write_calibration_json(b)).drop("dir"))


VAL_SELECTED = f"""fold_preds as (select variant, y_true, score, index_time < timestamp '1998-07-01' as val
from long_preds join group_meta using (subject_id)), choose_preds as (select * from fold_preds where val),
apply_preds as (select * from fold_preds where not val), {SELECTED.replace('long_preds', 'choose_preds')}"""


def _by_fold(b):
    """The long predictions of the validation fold and of the test fold."""
    meta = b.group_meta().select("subject_id", prediction_fold("index_time").alias("fold"))
    long = P.long_predictions(b.calibrated()).join(meta, "subject_id")
    return long.where(F.col("fold") == "val"), long.where(F.col("fold") != "val")


@query("E8 E9", f"""with {VAL_SELECTED}, rules as (select * from selected) select variant, rule, {R('threshold')}, tp, fp, tn,
fn, {R('sens', 'sensitivity')}, {R('spec', 'specificity')}, {R('ppv')}, {R('npv')}, {R('acc', 'accuracy')}, {R('f1')}
from ({confusion_sql('apply_preds', 'variant')})""")
def validation_thresholds_on_test(b):
    val, test = _by_fold(b)
    return rounded(E.confusion_at(test, E.select_thresholds(val, ["variant"]), ["variant"]))


@query("S10", f"with {VAL_SELECTED} select variant, rule, {R('threshold')} from selected")
def artifact_threshold_rows(b):
    t = E.select_thresholds(_by_fold(b)[0], ["variant"])
    per = t.groupBy("variant").agg(F.map_from_entries(F.collect_list(F.struct("rule", "threshold"))).alias("m"))
    doc = per.agg(F.map_from_entries(F.collect_list(F.struct("variant", "m"))).alias("m"))
    path = fresh_path(b.spark, "thresholds")
    _write_json(doc.select(F.format_string('{"selected_on": "validation", "thresholds": %s}', F.to_json("m"))), path)
    return rounded(A.threshold_rows(b.spark, path).drop("dir"))


@query("E30 S10 O2", f"""with {FOLD_METRICS} select label, method, {R('auroc', 'test_auroc')}, {R('auprc', 'test_auprc')} from
(select 'm_' || variant as label, 'baseline:logistic' as method, auroc, auprc from met where split = 'test' union all
select variant, 'mtl:shared_bottom', auroc, auprc from met where split = 'test' union all
select 'cal', 'calibration:' || variant, auroc, auprc from met where split = 'test')""")
def metrics_rollup(b):
    m = _artifact_metrics(b)
    pair = "named_struct('auroc', auroc, 'auprc', auprc)"
    per = m.groupBy("variant").agg(
        F.max(F.when(F.col("split") == "test", F.expr(f"to_json({pair})"))).alias("t"),
        F.max(F.when(F.col("split") == "validation", F.expr(f"to_json({pair})"))).alias("v"))
    root = fresh_path(b.spark, "rollup")
    per.select(F.format_string('{"label": "m_%s", "model": "logistic", "select_metric": "auprc", "val": %s, "test": %s}',
                               "variant", "v", "t")).repartition(2).write.text(f"{root}/base")
    doc = per.agg(F.array_join(F.sort_array(F.collect_list(F.format_string('"%s": %s', "variant", "t"))), ", ").alias("t"),
                  F.array_join(F.sort_array(F.collect_list(F.format_string('"%s": %s', "variant", "v"))), ", ").alias("v"))
    _write_json(doc.select(F.format_string(
        '{"task_cols": ["alt", "raw"], "select_metric": "auprc", "val": {%s}, "test": {%s}}', "v", "t")), f"{root}/tasks")
    rows = A.metrics_rollup(A.baseline_metric_rows(b.spark, f"{root}/base"), A.task_metric_rows(b.spark, f"{root}/tasks"),
                            A.calibration_metric_rows(b.spark, _write_calibration_json(b))
                            .withColumn("dir", F.lit("runs/cal")))
    return rounded(rows.drop("path"))


@query("S11 E14", f"""with {GRID_SQL} select variant, {R('t', 'threshold')}, {R('tp / n - fp / n * (t / (1 - t))', 'nb_model')} from
(select variant, t, count(*) as n, count(*) filter (score >= t and y_true = 1) as tp,
count(*) filter (score >= t and y_true = 0) as fp from long_preds, grid group by 1, 2)""")
def result_csv_sink(b):
    curve = E.decision_curve(P.long_predictions(b.calibrated()), ["variant"]).select("variant", "threshold", "nb_model")
    path = fresh_path(b.spark, "curve")
    sinks.write_result_csv(curve, path)
    return rounded(b.spark.read.schema(curve.schema).option("header", True).csv(path))


@query("S10 W7", f"""with {LINEAR}, m as (select avg(f_signal) as ms, avg(f_lines) as ml from lin), a as (
select 'attribution' as dir, 'f_signal' as feature, avg(abs(4.0::double * (f_signal - ms))) as v from lin, m union all
select 'attribution', 'f_lines', avg(abs(-0.25037::double * (f_lines - ml))) from lin, m union all
select 'native', event_type, abs(avg(value) - 50) from events group by event_type)
select dir, feature, {R('v', 'rank_value')} from a qualify row_number() over (partition by dir order by v desc, feature) <= 2""")
def stored_importance_ranks(b):
    """Importance tables with unlike columns, written to two folders, read together and ranked by what each has."""
    root = fresh_path(b.spark, "explain")
    sinks.write_result_csv(X.linear_attribution(_linear_rows(b), COEF), f"{root}/attribution/explain_global.csv")
    native = b.table("events").groupBy(F.col("event_type").alias("feature")).agg((F.avg("value") - 50).alias("value"))
    sinks.write_result_csv(native, f"{root}/native/explain_global.csv")
    return rounded(A.importance_ranks(b.spark, [f"{root}/{d}" for d in ("attribution", "native", "absent")], 2))


@query("S10 W8 E19", f"""with {RULES_SQL}, {GROUP_RATES}, {GAPS}, best as (select variant as dir, metric,
arg_max({{'g': gap, 'r': ratio, 'c': group_col, 'u': rule}}, (gap, group_col, rule)) as x from gaps group by 1, 2)
select dir, metric, {R('x.g', 'worst_gap')}, {R('x.r', 'worst_ratio_min_max')}, x.c as at_group_col, x.u as rule from best""")
def stored_worst_gaps(b):
    """Parity gaps written to one folder per variant, read back with the folder as a column."""
    root = fresh_path(b.spark, "fairness")
    gaps = stored(E.parity_gaps(E.group_threshold_metrics(_grouped(b), _rules(b))), "gaps")
    for v in ("raw", "alt"):
        sinks.write_result_csv(gaps.where(F.col("variant") == v).drop("variant"), f"{root}/{v}/parity_gaps.csv")
    return rounded(E.worst_gaps(A.result_rows(b.spark, [f"{root}/raw", f"{root}/alt"], "parity_gaps.csv")))


@query("S10 J11 E29", f"""with {RESULTS} select 'run' as dir, 'raw' as variant, 'y' as label, r.scenario, {R('r.auroc - b.auroc', 'd_auroc')},
{R('r.auprc - b.auprc', 'd_auprc')}, {R('r.ece - b.ece', 'd_ece')}, r.n, {R('r.pos_rate', 'pos_rate')}
from results r, results b where b.scenario = 'base' and r.scenario <> 'base'""")
def stored_deltas_to_base(b):
    """A scenario table written to a run folder, read back and compared with its base scenario."""
    root = fresh_path(b.spark, "robustness")
    sinks.write_result_csv(_results(b), f"{root}/run/robustness_results.csv")
    rows = A.result_rows(b.spark, [f"{root}/run", f"{root}/none"], "robustness_results.csv")
    return rounded(E.deltas_to_base(rows.withColumn("n", F.col("n").cast("bigint"))))


@query("S10 E24", f"""with {FOLD_METRICS} select case when split = 'test' then 'mtl' else 'baseline' end as family,
case when split = 'test' then 'task' end as task, variant, {', '.join(R(m) for m in METRIC_NAMES[:4])}, {R('ece')} from met join cal using (split, variant)""")
def external_metric_files(b):
    """External metrics in both shapes, written as JSON and read by one reader."""
    root = fresh_path(b.spark, "external")
    values = F.create_map(*[x for m in ("auroc", "auprc", "brier", "logloss", "ece") for x in (F.lit(m), F.col(m))])
    per = stored(_artifact_metrics(b).groupBy("split").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("variant", values)))).alias("m")), "external")
    _write_json(per.where("split = 'test'").select(F.format_string('{"family": "mtl", "metrics": {"task": %s}}', "m")), f"{root}/a")
    _write_json(per.where("split <> 'test'").select(F.format_string('{"metrics": %s, "note": [1, {"x": 2}]}', "m")), f"{root}/b")
    b.spark.range(1).select(F.lit("{broken")).write.text(f"{root}/c")
    return rounded(A.external_metric_rows(b.spark, [f"{root}/{d}" for d in "abc"]).drop("dir"))


# --- checks --------------------------------------------------------------------------------------------


@query("Q1", """select 'ERROR' as severity, code, 'matrix' as "where", detail from (
select 'BAD_SCHEMA' as code, 'missing column y_score' as detail, 1 as k union all
select 'EMPTY_COLUMN', 'no values in f_empty', (select (count(*) > 0 and count(f_empty) = 0)::int from matrix) union all
select 'EMPTY_COLUMN', 'no values in f_tax', (select (count(*) > 0 and count(f_tax) = 0)::int from matrix)) where k = 1""")
def check_required_columns(b):
    return Q.required_columns(b.matrix(), ["y", "f_price", "f_tax", "f_empty", "y_score"], "matrix")


@query("Q2", """select 'ERROR' as severity, code, 'admissions' as "where", detail from (
select 'NOT_UNIQUE' as code, 'repeated subject_id: ' || count(*) as detail, count(*) as k from
(select subject_id from admissions group by 1 having count(*) > 1) union all
select 'NULL_VALUE', 'null dischtime: ' || count(*), count(*) from admissions where dischtime is null) where k > 0""")
def check_keys(b):
    return Q.key_problems(b.admissions(), "subject_id", "admissions", ["hadm_id", "dischtime"])


@query("Q3", """select 'WARN' as severity, 'BAD_RANGE' as code, 'scores' as "where", detail from (
select 'twice outside [0,1]: ' || count(*) as detail from preds where y_score * 2 > 1 union all
select 'y_score outside (0,1): ' || count(*) from preds where y_score <= 0 or y_score >= 1 union all
select 'shifted below 0: ' || count(*) from preds where y_score - 0.5 < 0)""")
def check_ranges(b):
    p = b.predictions().withColumn("twice", F.col("y_score") * 2).withColumn("shifted", F.col("y_score") - 0.5)
    wide = Q.outside_unit(p, ["y_score", "twice"], "scores")
    return wide.unionByName(Q.outside_unit(p, ["y_score"], "scores", open_ends=True)) \
        .unionByName(Q.negative(p, ["y_score", "shifted"], "scores"))


@query("Q3 S10", f"""with {FOLD_METRICS}, stored as (select auroc + 0.4 as auroc, auprc, brier, logloss, ece - 0.01 as ece from met join cal using (split, variant))
select 'WARN' as severity, 'BAD_RANGE' as code, 'metrics.json' as "where", detail from (
select 'auroc outside [0,1]: ' || count(*) filter (auroc > 1) as detail, count(*) filter (auroc > 1) as k from stored union all
select 'ece below 0: ' || count(*) filter (ece < 0), count(*) filter (ece < 0) from stored) where k > 0""")
def check_artifact_ranges(b):
    """Ranges of metrics read from their stored file, with planted errors."""
    m = A.calibration_metric_rows(b.spark, _write_calibration_json(b))
    bad = m.withColumn("auroc", F.col("auroc") + 0.4).withColumn("ece", F.col("ece") - 0.01)
    return Q.outside_unit(bad, ["auroc", "auprc", "brier"], "metrics.json").unionByName(
        Q.negative(bad, ["logloss", "ece"], "metrics.json"))


@query("Q4", f"""with turned as (select variant, y_true, 1 - score as score from long_preds)
select 'WARN' as severity, 'AUPRC_BELOW_PREV' as code, variant as "where", printf('%.4f', auprc) as detail
from ({metrics_sql('turned', 'variant')}) where auprc + 1e-6 < greatest(0, pos_rate - 0.05)""")
def check_auprc_against_prevalence(b):
    turned = P.long_predictions(b.calibrated()).withColumn("score", F.lit(1.0) - F.col("score"))
    out = Q.auprc_below_prevalence(E.metrics(turned, ["variant"]), F.col("variant"))
    return out.withColumn("detail", F.format_string("%.4f", F.col("detail").cast("double")))


@query("Q5", """with k as (select s, v, row_number() over (order by s) as i from iso_fit),
w as (select *, case when i % 100 = 0 then 1 - v else v end as bad from k)
select 'WARN' as severity, 'CAL_NON_MONOTONE' as code, 'isotonic' as "where",
'y decreases: ' || count(*) as detail from (select bad, lag(bad) over (order by i) as pb from w) where bad < pb""")
def check_knots(b):
    iso = K.fit_isotonic(b.folded_predictions("val"))
    # every distinct validation score with its fitted value, then planted errors
    scores = b.folded_predictions("val").select("y_score").distinct()
    fitted = K.apply_isotonic(scores, "y_score", iso, "y").select(F.col("y_score").alias("x"), "y")
    placed = running_totals(fitted, [], "x", {"n": F.lit(1), "y": F.col("y")}).select(F.col("n_to").alias("position"), "x", "y")
    knots = placed.select(F.lit("isotonic").alias("method"), "position", "x",
                          F.when(F.col("position") % 100 == 0, 1 - F.col("y")).otherwise(F.col("y")).alias("y"))
    ok = Q.knot_problems(K.parameter_rows(b.spark, None, iso), "fitted")
    return Q.knot_problems(knots, "isotonic").unionByName(ok).unionByName(
        Q.platt_problems(b.spark, K.Platt(1.0, 0.0), "platt"))


@query("Q6", """select 'WARN' as severity, code, 'cal' as "where", detail from (
select 'MISALIGNED_YTRUE' as code, 'labels differ: ' || count(*) as detail from preds
where index_time >= timestamp '1996-01-01' and y_score > 0.9 union all
select 'SUBJECT_MISMATCH', 'overlap' from (select count(*) filter (index_time >= timestamp '1996-01-01') as nb, count(*) as n from preds)
where nb / least(nb, n) < 0.95)""")
def check_alignment(b):
    raw = b.predictions()
    cal = raw.where(F.col("index_time") >= F.lit("1996-01-01").cast("timestamp_ntz")).withColumn(
        "y_true", F.when(F.col("y_score") > 0.9, 1 - F.col("y_true")).otherwise(F.col("y_true")))
    return Q.alignment_problems(raw, cal, "cal")


@query("Q7", """select 'ERROR' as severity, code, detail from (
select 'FILE_MISSING' as code, 'missing absent.parquet' as detail, 1 as k union all select 'FILE_MISSING', 'missing test', 1 union all
select 'FILE_EMPTY', 'no rows in sure', (select (count(*) filter (y_score > 0.99) = 0)::int from preds) union all
select 'FILE_EMPTY', 'no rows in val', (select (count(*) = 0)::int from val_preds)) where k = 1""")
def check_artifacts(b):
    """Prediction tables written below one folder: one with rows, one that turns out empty, one never written."""
    root = fresh_path(b.spark, "artifacts")
    b.folded_predictions("val").write.parquet(f"{root}/val")
    b.predictions().where("y_score > 0.99").write.parquet(f"{root}/sure")
    found = Q.artifact_presence(b.spark, root, [], ["val", "sure", "test"])
    return found.unionByName(Q.artifact_presence(b.spark, b.root, ["orders.parquet", "absent.parquet"])).drop("where")


@query("Q8", """select 'WARN' as severity, code, 'curve' as "where", detail from (
select 'BAD_RANGE' as code, 'thresholds outside (0,1): ' || count(distinct y_score) as detail from preds where y_score <= 0 or y_score >= 1
union all select 'NB_SANITY', 'treat-none net benefit is not 0: ' || count(distinct y_score) from preds where y_score > 0.9)
where detail not like '%: 0'""")
def check_curve(b):
    curve = b.predictions().select(F.col("y_score").alias("threshold")).distinct() \
        .withColumn("nb_none", F.when(F.col("threshold") > 0.9, 0.1).otherwise(0.0))
    ok = E.decision_curve(P.long_predictions(b.predictions()), ["variant"], threshold_grid(0.1, 0.9, 0.2))
    return Q.curve_problems(curve, "curve").unionByName(Q.curve_problems(ok, "made"))
