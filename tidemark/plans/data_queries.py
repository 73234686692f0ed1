"""Queries over scans, scalar functions, joins, aggregates, cohort, labels and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.codes import FULL_CODEBOOKS, NARROW_CODEBOOKS, DIABETES, in_codebook, normalise_code
from ..operators import evaluate as E
from ..operators import events as EV
from ..operators.lookups import id_overlap, lookup_join, with_row
from ..operators.ranking import first_rows, order_statistics, quantile_bins
from ..functions.binning import edges_at_or_below, equal_width_edges
from ..session import fresh_path, stored
from ..sources import predictions as P
from ..sources import sinks, tables
from .bindings import CHART_SIGNS, EVENT_LABELS, LAB_LOOKBACK, RX_CLASSES, START_YEAR, Bindings
from .registry import B, R, TS, query, rounded

# --- scans and sinks ------------------------------------------------------------------



def _patient_text(b: Bindings):
    k = F.col("c_custkey")
    text = k.cast("string")
    return b.table("customer").select(
        F.when(k % 101 == 7, F.concat(F.lit("x"), text)).when(k % 3 == 0, F.concat(text, F.lit(".0")))
        .otherwise(text).alias("subject_id"),
        F.when(k % 7 == 0, "NA").when(k % 13 == 0, "bad").otherwise((k % 80).cast("string")).alias("anchor_age"),
        F.when(k % 5 == 0, "1950-02-30").otherwise("1950-03-01 00:00:00").alias("dob"),
        F.when(k % 9 == 0, "NULL").otherwise("F").alias("gender"))


@query("S1 S2 P1 P2", f"""
select case when c_custkey % 101 = 7 then null else cast(c_custkey as varchar) end as subject_id,
  case when c_custkey % 7 = 0 or c_custkey % 13 = 0 then null else cast(c_custkey % 80 as double) end as anchor_age,
  case when c_custkey % 5 = 0 then null else '1950-03-01 00:00:00.000000' end as dob,
  case when c_custkey % 9 = 0 then null else 'F' end as gender from customer""")
def csv_scan_typed(b):
    root = fresh_path(b.spark, "csv")
    _patient_text(b).write.option("header", True).csv(f"{root}/patients.csv")
    path = tables.resolve(b.spark, root, "patients", tables.INGEST_ORDER)
    rows = tables.scan_csv(b.spark, path, tables.table_spec("patients"))
    return rounded(rows.withColumn("subject_id", F.col("subject_id").cast("string")))


@query("S3", """select 'csv' as src, count(*) as n from customer
union all select 'parquet', count(*) from customer""")
def auto_format_scan(b):
    root = fresh_path(b.spark, "auto")
    text = _patient_text(b)
    text.withColumn("src", F.lit("csv")).write.option("header", True).csv(f"{root}/patients.csv")
    text.withColumn("src", F.lit("parquet")).write.parquet(f"{root}/patients.parquet")
    parts = [tables.scan_table(b.spark, root, "patients", order, columns=["src"])
             for order in (tables.ANALYSIS_ORDER, tables.INGEST_ORDER)]
    return parts[0].unionByName(parts[1]).groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query("S4 O1", "select subject_id, hadm_id from admissions order by subject_id, hadm_id limit 500")
def row_cap(b):
    return b.admissions().select("subject_id", "hadm_id").orderBy("subject_id", "hadm_id").limit(500)


@query("S4", "select least(500, count(*)) as capped, count(*) as n from admissions")
def row_cap_of_scan(b):
    root = fresh_path(b.spark, "cap")
    b.admissions().write.parquet(f"{root}/admissions.parquet")
    capped = tables.scan_table(b.spark, root, "admissions", columns=["hadm_id"], nrows=500).agg(
        F.count(F.lit(1)).alias("capped"))
    return with_row(tables.scan_table(b.spark, root, "admissions").agg(F.count(F.lit(1)).alias("n")), capped)


@query("S5", f"""select count(*) as n, count(dischtime) as n_disch, {B('sum(hadm_id)', 'id_sum')},
{TS('min(admittime)', 'first')}, {TS('max(admittime)', 'last')} from admissions""")
def parquet_sink_roundtrip(b):
    path = fresh_path(b.spark, "admissions")
    sinks.write_parquet(b.admissions(), path)
    return rounded(b.spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("n"), F.count("dischtime").alias("n_disch"), F.sum("hadm_id").alias("id_sum"),
        F.min("admittime").alias("first"), F.max("admittime").alias("last")))


@query("S6", f"""select year(o_orderdate) as year, strftime(o_orderdate, '%Y-%m') as month, count(*) as n,
{B('sum(o_orderkey)', 'id_sum')} from orders where year(o_orderdate) = 1999 group by all""")
def partitioned_sink_pruned(b):
    path = fresh_path(b.spark, "labs")
    rows = b.table("orders").select("o_orderkey", F.col("o_orderdate").alias("charttime"))
    sinks.write_time_partitioned(rows, path, "month")
    return (b.spark.read.parquet(path).where(F.col("year") == 1999).groupBy("year", F.col("month").cast("string")
            .alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("id_sum")))


@query("S7", """select 'keep' as mode, year(o_orderdate) as year, count(*) as n from orders
group by all union all
select 'overwrite', y, count(*) filter (y <> 1998 or m <= 6)
from (select year(o_orderdate) as y, month(o_orderdate) as m from orders) group by y
union all select 'dry_run', 0, 0""")
def write_modes(b):
    rows = b.table("orders").select("o_orderkey", F.col("o_orderdate").alias("charttime"))
    half = rows.where((F.year("charttime") == 1998) & (F.month("charttime") <= 6))
    kept, replaced, dry = (fresh_path(b.spark, m) for m in ("keep", "overwrite", "dry"))
    sinks.ingest(rows, kept, "labevents", "overwrite", "year")
    sinks.ingest(half, kept, "labevents", "keep", "year")
    sinks.ingest(rows, replaced, "labevents", "overwrite", "year")
    sinks.ingest(half, replaced, "labevents", "overwrite", "year")
    sinks.ingest(rows, dry, "labevents", "overwrite", "year", dry_run=True)
    out = None
    for mode, path in (("keep", kept), ("overwrite", replaced)):
        one = b.spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n")) \
            .select(F.lit(mode).alias("mode"), "year", "n")
        out = one if out is None else out.unionByName(one)
    written = int(tables.path_exists(b.spark, dry))
    return out.unionByName(b.table("orders").agg(F.lit("dry_run").alias("mode"), F.lit(0).alias("year"),
                                                 (F.count(F.lit(1)) * written).alias("n")))


@query("S8", f"""select 'admissions' as name, count(*) as rows, count(distinct subject_id) as unique_subjects,
cast(count(distinct hadm_id) as varchar) as unique_hadm, {TS('min(admittime)', 'date_min')}, {TS('max(admittime)', 'date_max')}
from admissions union all
select 'labevents', count(*), count(distinct subject_id), cast(count(distinct hadm_id) as varchar),
strftime(min(charttime), '%Y-%m-%d %H:%M:%S.%f'), strftime(max(charttime), '%Y-%m-%d %H:%M:%S.%f') from labevents
union all select 'patients', count(*), count(distinct subject_id), null, null, null from patients""")
def ingest_profile(b):
    out = tables.ingest_profile(b.admissions(), "admissions")
    out = out.unionByName(tables.ingest_profile(b.labevents(), "labevents"))
    out = out.unionByName(tables.ingest_profile(b.patients(), "patients", times=[]))
    return rounded(out.withColumn("unique_hadm", F.col("unique_hadm").cast("string")))


@query("S8 S6", f"""select 'labevents' as name, count(*) as rows, count(distinct subject_id) as unique_subjects,
count(distinct hadm_id) as unique_hadm, {TS('min(charttime)', 'date_min')}, {TS('max(charttime)', 'date_max')} from labevents""")
def ingest_partitioned_profile(b):
    """A table written into month folders twice, the second time over the first, and profiled from what was written."""
    path = fresh_path(b.spark, "ingest")
    events = b.labevents()
    sinks.ingest(events.withColumn("charttime", F.col("charttime") - F.make_ym_interval(F.lit(1))), path, "labevents", "overwrite", "month")
    return rounded(sinks.ingest(events, path, "labevents", "overwrite", "month"))


@query("S9", f"""select variant, count(*) as n, {B('sum(y_true)', 'pos')}, {R('sum(score)', 'total', 4)}
from long_preds group by variant""")
def predictions_calibrated_layout(b):
    long = P.long_predictions(b.calibrated())
    return rounded(long.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("pos"),
                                               F.sum("score").alias("total")), 4)


@query("S9", f"select subject_id, y_true, 'y_score' as variant, {R('y_score', 'score')} from preds")
def predictions_baseline_layout(b):
    return rounded(P.long_predictions(b.predictions()))


@query("S9 M7", f"""select subject_id, y_true, 'y_score' as variant, {R('y_score_alt', 'score')} from calibrated""")
def predictions_task_layout(b):
    c = b.calibrated()
    wide = P.wide_task_predictions({
        "first": c.select("subject_id", "y_true", F.col("y_score_raw").alias("y_score")),
        "second": c.select("subject_id", "y_true", F.col("y_score_alt").alias("y_score"))})
    return rounded(P.long_predictions(wide, task="second"))


@query("S12", """select l_returnflag, count(*) as n, cast(sum(l_quantity) as bigint) as qty from lineitem
where l_shipdate >= timestamp '1999-01-01 00:00:00' group by 1""")
def column_subset_scan(b):
    rows = tables.scan_table(b.spark, b.root, "lineitem", columns=["l_returnflag", "l_quantity", "l_shipdate"])
    return (rows.where(F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).groupBy("l_returnflag")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("qty")))


# --- scalar functions -----------------------------------------------------------------


@query("P1", """select o_orderkey as k, case when o_orderkey % 4 < 2 then cast(o_orderkey as varchar) end as id from orders""")
def nullable_id_cast(b):
    k = F.col("o_orderkey")
    t = k.cast("string")
    raw = (F.when(k % 4 == 0, t).when(k % 4 == 1, F.concat(t, F.lit(".0")))
           .when(k % 4 == 2, F.concat(t, F.lit(".5"))).otherwise(F.concat(F.lit("x"), t)))
    return b.table("orders").select(k.alias("k"), C.to_id(raw).cast("string").alias("id"))


@query("P2", f"""select o_orderkey as k, case when o_orderkey % 3 = 0
then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') end as at from orders""")
def lenient_timestamp_parse(b):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(k % 3 == 1, "bad")
    return rounded(b.table("orders").select(k.alias("k"), C.to_time(raw).alias("at")))


@query("P3 J1", f"select subject_id, hadm_id, gender, {R('age_at_admit')} from aged")
def age_from_anchor_year(b):
    return rounded(EV.stays_with_age(EV.valid_stays(b.admissions()), b.patients())
                   .select("subject_id", "hadm_id", "gender", "age_at_admit"))


@query("P4", f"""select hadm_id, {R("least(120.0, greatest(0.0, floor(date_diff('microsecond', dob, admittime) / 8.64e10 / 365.2425)))", 'age_at_admit')}
from stays left join patients_dob using (subject_id) where dob is not null
union all select hadm_id, null from stays left join patients_dob using (subject_id) where dob is null""")
def age_from_birth_date(b):
    return rounded(EV.stays_with_age(EV.valid_stays(b.admissions()), b.patients_dob())
                   .select("hadm_id", "age_at_admit"))


@query("P5", f"""select hadm_id, {R("date_diff('microsecond', admittime, dischtime) / 3.6e9", 'los_hours')},
{R("coalesce(date_diff('microsecond', admittime, dischtime) / 8.64e10, 0)", 'los_days')} from admissions""")
def length_of_stay(b):
    return rounded(b.admissions().select(
        "hadm_id", C.hours_between("admittime", "dischtime").alias("los_hours"),
        F.coalesce(C.days_between("admittime", "dischtime"), F.lit(0.0)).alias("los_days")))


@query("P6", """select year(admittime) as year, strftime(admittime, '%Y-%m') as month,
year(admittime) || 'Q' || quarter(admittime) as quarter, min(strftime(admittime, '%Y-%m-%d')) as first_day,
count(*) as n from admissions group by all""")
def calendar_parts(b):
    return b.admissions().groupBy(F.year("admittime").alias("year"), C.month_label("admittime").alias("month"),
                                  C.quarter_label("admittime").alias("quarter")).agg(
        F.min(C.iso_date("admittime")).alias("first_day"), F.count(F.lit(1)).alias("n"))


@query("P8", """select upper(regexp_replace(icd_code, '[^A-Za-z0-9]', '', 'g')) as code, icd_version, count(*) as n
from diagnoses group by all""")
def code_normalise(b):
    return b.diagnoses().groupBy(normalise_code("icd_code").alias("code"), "icd_version") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("P9 P10", """select is_diab, is_cvd, count(*) as n from dx_full group by all""")
def code_sets_full_range(b):
    return b.diagnoses().select(*[in_codebook("icd_code", "icd_version", k).alias(f"is_{n}")
                                  for n, k in FULL_CODEBOOKS.items()]) \
        .groupBy("is_diab", "is_cvd").agg(F.count(F.lit(1)).alias("n"))


@query("P11", """select is_diab, is_cvd, count(*) as n from dx_narrow group by all""")
def code_sets_narrow(b):
    return b.diagnoses().select(*[in_codebook("icd_code", "icd_version", k, normalise=False).alias(f"is_{n}")
                                  for n, k in NARROW_CODEBOOKS.items()]) \
        .groupBy("is_diab", "is_cvd").agg(F.count(F.lit(1)).alias("n"))


@query("P12", """select icd_version, count(*) as n from diagnoses where icd_version = 9 and icd_code like '3%'
or icd_version = 10 and substr(upper(icd_code), 1, 3) in ('E08','E09','E10','E11','E13') group by 1""")
def codebook_override(b):
    book = DIABETES.override(v9=["3"], v10=[])
    return b.diagnoses().where(in_codebook("icd_code", "icd_version", book)) \
        .groupBy("icd_version").agg(F.count(F.lit(1)).alias("n"))


ETH_TEXT = """case c_custkey % 7 when 0 then 'WHITE - RUSSIAN' when 1 then 'Black/Cape Verdean'
when 2 then 'ASIAN - CHINESE' when 3 then 'South African' when 4 then 'LATINO white' when 5 then 'Hispanic'
end"""


@query("P13", """select case c_custkey % 7 when 0 then 'white' when 1 then 'black' when 2 then 'asian' when 3
then 'black' when 4 then 'white' when 5 then 'hispanic' else 'other' end as eth, count(*) as n
from customer group by 1""")
def ethnicity_groups(b):
    text = F.expr(ETH_TEXT)
    return b.table("customer").groupBy(C.ethnicity_group(text).alias("eth")).agg(F.count(F.lit(1)).alias("n"))


@query("P14", """select subject_id, case when gender = 'F' then 1 else 0 end as gender_f,
case when gender = 'M' then 1 else 0 end as gender_m from cohort""")
def gender_one_hot(b):
    return EV.gender_indicators(b.cohort())


@query("P15", r"""select p_partkey as k, trim(lower(regexp_replace(trim(' ' || p_name || ' (' || p_brand || ')! '),
'[^A-Za-z0-9]+', '_', 'g')), '_') as name from part""")
def feature_name_sanitise(b):
    raw = F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_brand", F.lit(")! "))
    return b.table("part").select(F.col("p_partkey").alias("k"), C.feature_name(raw).alias("name"))


@query("P16", """select label, count(*) as n from labevents where regexp_matches(label, '(?i)(PURCH|^err)')
group by 1""")
def label_pattern_filter(b):
    return b.labevents().where(C.matches_any_pattern("label", ["PURCH", "^err"])) \
        .groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("P17", r"""select hot, ring_or_rod, fastener, count(*) as n from (select
regexp_matches(lower(drug), '\bhot\b') as hot, regexp_matches(lower(drug), 'ring|rod') as ring_or_rod,
regexp_matches(lower(drug), '\b(bolt|gear)\b') as fastener from prescriptions) group by all""")
def drug_class_flags(b):
    text = F.lower("drug")
    return b.prescriptions().select(*[text.rlike(p).alias(n) for n, p in RX_CLASSES.items()]) \
        .groupBy(*RX_CLASSES).agg(F.count(F.lit(1)).alias("n"))


#: Texts that the shipped classes and signs must sort out, dealt to the rows by their keys.
DRUG_TEXTS = ["Insulin Glargine", "metFORMIN 500 mg", "GlipiZIDE", "Atorvastatin Calcium", "Metoprolol Tartrate", "Lisinopril", "losartan",
              "Furosemide (Lasix)", "lisinoprilat", "Aspirin", "Insulinase", "Hydrochlorothiazide-Losartan", "Rosuvastatin"]
CHART_TEXTS = ["Heart Rate", "Arterial Line Systolic", "NBP Diastolic", "DBP", "SpO2 Desat Limit", "Resp Rate (Total)", "Temperature Celsius",
               "temp site", "Systolic BP Systolic", "Oxygen Saturation", "Weight", "Respiratory Rate"]


def _dealt(texts: list[str], key: str) -> str:
    return f"[{', '.join(repr(t) for t in texts)}][1 + {key} % {len(texts)}]"


def _text_of(texts: list[str], key: str):
    return F.lower(F.element_at(F.array(*map(F.lit, texts)), (F.col(key) % len(texts) + 1).cast("int")))


@query("P17 A5", rf"""with t as (select lower({_dealt(DRUG_TEXTS, 'p_partkey')}) as d from part)
select d, count(*) as n, {', '.join(f"bool_or(regexp_matches(d, '{p}')) as {n}" for n, p in EV.DRUG_CLASSES.items())} from t group by 1""")
def shipped_drug_classes(b):
    t = b.table("part").select(_text_of(DRUG_TEXTS, "p_partkey").alias("d"))
    return t.groupBy("d").agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(F.col("d").rlike(p)).alias(n) for n, p in EV.DRUG_CLASSES.items()])


@query("P18 A7", rf"""with t as (select lower({_dealt(CHART_TEXTS, 'event_id')}) as d, value from events)
select d, count(*) as n, {R('avg(value)', 'mean')}, {', '.join(f"bool_or(regexp_matches(d, '{p}')) as {n}" for n, p in EV.VITAL_SIGNS.items())}
from t group by 1""")
def shipped_vital_signs(b):
    t = b.table("events").select(_text_of(CHART_TEXTS, "event_id").alias("d"), "value")
    return rounded(t.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
                                      *[F.bool_or(F.col("d").rlike(p)).alias(n) for n, p in EV.VITAL_SIGNS.items()]))


@query("P18", """select vital, count(*) as n from (select unnest([v for v in [
case when regexp_matches(label, 'purchase|view') then 'buying' end, case when regexp_matches(label, 'err')
then 'fault' end, case when regexp_matches(label, 'sign ?up|click') then 'entry' end] if v is not null]) as vital
from labevents) group by 1""")
def vital_sign_flags(b):
    text = F.lower("label")
    named = F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in CHART_SIGNS.items()]),
                     lambda v: v.isNotNull())
    return b.labevents().select(F.explode(named).alias("vital")).groupBy("vital").agg(F.count(F.lit(1)).alias("n"))


@query("P22", f"""with p as (select subject_id, greatest(1e-6::double, least(1 - 1e-6::double, y_score_raw)) as c from calibrated)
select subject_id, {R('c', 'clipped')}, {R('ln(c / (1 - c))', 'logit')},
{R('1 / (1 + exp(-(2 * ln(c / (1 - c)))))', 'squashed')} from p""")
def clip_logit_sigmoid(b):
    p = F.col("y_score_raw")
    return rounded(b.calibrated().select("subject_id", C.clip_probability(p).alias("clipped"),
                                         C.logit(p).alias("logit"), C.sigmoid(F.lit(2.0) * C.logit(p)).alias("squashed")))


@query("P23 W2", """select subject_id, min(cast(in_hosp as int)) as in_hosp from
(select subject_id, deathtime is not null as in_hosp from admissions) group by 1""")
def label_coercion(b):
    from ..operators.split import one_row_per_subject

    rows = b.admissions().select("subject_id", F.col("deathtime").isNotNull().alias("in_hosp"))
    return one_row_per_subject(rows, "in_hosp")


@query("P24", """select case c_custkey % 6 when 0 then 'F' when 1 then 'M' when 2 then 'F' when 3 then 'MISSING'
when 4 then 'MISSING' else 'X' end as sex, case when c_custkey % 4 = 0 then 'MISSING' else c_mktsegment end as segment,
count(*) as n from customer group by all""")
def group_value_normalise(b):
    k = F.col("c_custkey")
    sex = F.expr("case c_custkey % 6 when 0 then ' female' when 1 then 'Male' when 2 then 'f' when 3 then '' "
                 "when 4 then null else 'x' end")
    meta = b.table("customer").select(k.alias("subject_id"), sex.alias("sex"),
                                      F.when(k % 4 == 0, "nan").otherwise(F.col("c_mktsegment")).alias("segment"))
    return E.group_labels(meta, ["sex", "segment"]).groupBy("sex", "segment").agg(F.count(F.lit(1)).alias("n"))


@query("P25", f"select subject_id, {R('cast(cast(f_price as float) as double)', 'f_price', 3)}, f_lines from matrix")
def float32_storage(b):
    return rounded(C.store_float32(b.matrix().select("subject_id", "f_price", "f_lines")), 3)


@query("P26 P27", f"""select subject_id, {R('f_qty')}, 0.0::double as f_absent, {R('f_price')} from (select subject_id,
coalesce(f_qty, 0) as f_qty, f_price from matrix)""")
def align_feature_columns(b):
    m = b.matrix()
    have = C.numeric_columns(m, ["subject_id", "y"])
    wanted = [c for c in ("f_qty", "f_absent", "f_price") if c in have or c == "f_absent"]
    return rounded(C.align_columns(m, wanted))


@query("P19 P20 P21 C4 A4", f"""with wide as (select subject_id,
{', '.join(f'''max("last") filter (label = '{v}') as {v}_last, max("count") filter (label = '{v}') as {v}_count,
max(per_day) filter (label = '{v}') as {v}_per_day''' for v in EVENT_LABELS)} from lab_long group by 1)
select c.subject_id, {', '.join(f'''{R(f'{v}_last', f'lab_{v}_last')}, cast(coalesce({v}_count, 0) as int) as lab_{v}_count,
{R(f'{v}_per_day', f'lab_{v}_per_day')}, case when w.subject_id is null then 0 when {v}_last is null then 1 else 0 end
as lab_{v}_missing''' for v in EVENT_LABELS)}
from (select distinct user_id as subject_id from events) c left join wide w on c.subject_id = w.subject_id""")
def lab_fill_and_missing_flags(b):
    base = b.table("events").select(F.col("user_id").alias("subject_id")).distinct() \
        .withColumn("age_at_admit", F.lit(40.0))
    out = EV.event_features(base, labs=_lab_long(b), lab_labels=EVENT_LABELS)
    keep = [f"lab_{v}_{s}" for v in EVENT_LABELS for s in ("last", "count", "per_day", "missing")]
    return rounded(out.select("subject_id", *keep))


def _lab_window(b, keep=("event_id", "label", "valuenum")):
    return EV.events_in_window(b.labevents(), b.stored_lab_cohort(), "charttime", LAB_LOOKBACK, keep)


def _lab_long(b):
    return EV.lab_statistics(_lab_window(b), "event_id").withColumn("per_day", F.col("count") / F.lit(7.0))


def _stay_ids_as_text(df):
    return df.withColumns({c: F.col(c).cast("string") for c in df.columns if c.endswith("_event_hadm_id")})


# --- filters and joins ----------------------------------------------------------------


@query("F1", f"select subject_id, hadm_id, {R('los_hours')} from stays")
def valid_stay_filter(b):
    return rounded(EV.valid_stays(b.admissions()).select("subject_id", "hadm_id", "los_hours"))


@query("F2", f"""select year(admittime) as year, count(*) as n, count(distinct subject_id) as subjects from aged
where year(admittime) between 1997 and 1999 and age_at_admit >= 40 group by 1""")
def year_and_age_filter(b):
    rows = EV.eligible_stays(EV.stays_with_age(EV.valid_stays(b.admissions()), b.patients()), 40, 1997, 1999)
    return rows.groupBy(F.year("admittime").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("subject_id").alias("subjects"))


@query("F3 F4 J4", f"""select subject_id, event_id, {TS('charttime')}, {TS('index_time')} from lab_window""")
def events_before_index(b):
    return rounded(_lab_window(b).select("subject_id", "event_id", "charttime", "index_time"))


@query("F5", """select cast(count(*) filter (diab_first_event_time = index_time) as bigint) as same_time,
count(*) filter (diab_base and diab_first_event_time <= index_time + interval 30 day) as d30,
count(*) filter (diab_first_event_time > index_time and diab_first_event_time <= index_time + interval 30 day)
as d30_later_only, count(*) filter (diab_base and diab_first_event_time <= index_time + interval 365 day) as d365
from incident""")
def horizon_predicates(b):
    c, dx, adm = b.cohort(), b.diagnoses(), b.admissions()
    first = EV.earliest_events(EV.dated_diagnoses(dx, adm, FULL_CODEBOOKS), list(FULL_CODEBOOKS))
    rows = c.select("subject_id", "hadm_id", "index_time").join(first, "subject_id", "left")
    strict = EV.horizon_flags("diab", [30], count_index_stay=False)[1].alias("later30")
    rows = rows.select("*", *EV.horizon_flags("diab", [365, 30, 30, -1]), strict)
    return rows.agg(F.count_if(F.col("diab_first_event_time") == F.col("index_time")).alias("same_time"),
                    F.count_if("diab_incident_30d").alias("d30"), F.count_if("later30").alias("d30_later_only"),
                    F.count_if("diab_incident_365d").alias("d365"))


@query("F6", f"select subject_id, {R('f_price')} from matrix where fold = 'val'")
def fold_filter(b):
    path = fresh_path(b.spark, "folds")
    sinks.write_by_fold(b.matrix().drop("f_empty"), path)
    return rounded(b.spark.read.parquet(path).where(F.col("fold") == "val").select("subject_id", "f_price"))


@query("J2", f"""select subject_id, hadm_id, {TS('dx_time')}, is_diab, is_cvd from dx_full where is_diab or is_cvd""")
def coded_diagnosis_times(b):
    rows = EV.dated_diagnoses(b.diagnoses(), b.admissions(), FULL_CODEBOOKS)
    return rounded(rows.select("subject_id", "hadm_id", "dx_time", "is_diab", "is_cvd"))


@query("J3", """select c.subject_id, coalesce(max(cast(is_diab as int)), 0) as any_diab from cohort c
left join dx_narrow d on d.subject_id = c.subject_id and (is_diab or is_cvd) group by 1""")
def cohort_left_derived(b):
    dated = EV.dated_diagnoses(b.diagnoses(), b.admissions(), NARROW_CODEBOOKS, normalise=False, match_subject=True)
    got = dated.groupBy("subject_id").agg(F.max(F.col("is_diab").cast("int")).alias("any_diab"))
    return b.cohort().select("subject_id").join(got, "subject_id", "left").na.fill(0)


@query("J5 A3", f"""select subject_id, label, {R('"last"', '"last"')}, {R('recency_days')} from lab_long""")
def last_before_index(b):
    return rounded(_lab_long(b).select("subject_id", "label", "last", "recency_days"))


@query("J6 A2 A1", f"""with d as (select itemid, min(label) as label, 'u' || itemid as unit from labevents group by itemid),
w as (select l.subject_id, d.label, d.unit, l.valuenum from lab_window l join d on d.itemid = l.itemid)
select subject_id, label, max(unit) as unit, count(valuenum) as "count", {R('min(valuenum)', '"min"')},
{R('avg(valuenum)', 'mean')} from w group by 1, 2""")
def dictionary_lookup(b):
    long = EV.lab_table(b.stored_lab_cohort(), b.labevents().drop("label"), b.lab_dictionary(), LAB_LOOKBACK)
    return rounded(long.select("subject_id", "label", "unit", "count", "min", "mean"))


@query("J7", f"""select m.fold, p.y_true, count(*) as n, {R('avg(f_price)', 'price', 4)} from matrix m join preds p
on m.subject_id = p.subject_id group by all""")
def features_with_folds_and_labels(b):
    rows = b.matrix().join(b.predictions(), "subject_id")
    return rounded(rows.groupBy("fold", "y_true").agg(F.count(F.lit(1)).alias("n"), F.avg("f_price").alias("price")), 4)


@query("J8", f"""select p.subject_id, coalesce(quality, -1) as y_true, {R('y_score')} from preds p
left join labels on doc_id = subject_id""")
def score_left_label(b):
    lab = b.table("labels").select(F.col("doc_id").alias("subject_id"), "quality")
    return rounded(b.predictions().join(lab, "subject_id", "left").select(
        "subject_id", F.coalesce("quality", F.lit(-1)).alias("y_true"), "y_score"))


@query("J9", """select subject_id, hadm_id from admissions where subject_id in (select subject_id from cohort
where in_hosp_mortality)""")
def semi_join_ids(b):
    ids = b.cohort().where("in_hosp_mortality").select("subject_id")
    return b.admissions().join(ids, "subject_id", "left_semi").select("subject_id", "hadm_id")


@query("J10 O1", f"""with a as (select event_type as feature, avg(value) as v from events where event_type < 'r' group by 1),
p as (select event_type as feature, max(value) as m from events where event_type > 'd' group by 1)
select coalesce(a.feature, p.feature) as feature, {R('v', 'value')}, {R('m', 'perm_importance_mean')},
{R('abs(v)', 'value_abs')} from a full join p on a.feature = p.feature""")
def importance_outer_merge(b):
    ev = b.table("events").withColumnRenamed("event_type", "feature")
    native = ev.where("feature < 'r'").groupBy("feature").agg(F.avg("value").alias("value"))
    perm = ev.where("feature > 'd'").groupBy("feature").agg(F.max("value").alias("perm_importance_mean"))
    return rounded(E.merge_importances(native, perm))


@query("J12 Q6", f"""with a as (select distinct subject_id from admissions where year(admittime) <= 1999),
c as (select subject_id from cohort)
select count(a.subject_id) as n_a, count(c.subject_id) as n_b, count(*) filter (a.subject_id is not null
and c.subject_id is not null) as n_both, {R('count(*) filter (a.subject_id is not null and c.subject_id is not null) / least(count(a.subject_id), count(c.subject_id))', 'overlap')}
from a full join c on a.subject_id = c.subject_id""")
def id_overlap_ratio(b):
    return rounded(id_overlap(b.admissions().where(F.year("admittime") <= 1999), b.cohort())
                   .withColumns({c: F.col(c).cast("bigint") for c in ("n_a", "n_b", "n_both")}))


# --- aggregates and windows -----------------------------------------------------------


@query("A1 P19", f"""select subject_id, label, {R('"min"', '"min"')}, {R('"max"', '"max"')}, {R('mean')}, {R('"last"', '"last"')},
"count", {R('recency_days')}, {R('per_day')} from lab_long""")
def lab_statistics(b):
    return rounded(_lab_long(b))


@query("A4", f"""select subject_id, {', '.join(f'''(round(max(mean) filter (label = '{v}'), 6)) as lab_{v}_mean,
cast(max("count") filter (label = '{v}') as double) as lab_{v}_count''' for v in EVENT_LABELS)}
from lab_long group by 1""")
def pivot_long_to_wide(b):
    return rounded(EV.pivot_stats(_lab_long(b), EVENT_LABELS, ["mean", "count"]))


@query("A5 A6", rf"""select subject_id, cast(count(*) as int) as med_any_count,
{R("date_diff('microsecond', max(starttime), max(index_time)) / 8.64e10", 'med_recency_days')},
{', '.join(f'''cast(count(*) filter (regexp_matches(d, '{p}')) as int) as med_{n}_count,
max(cast(regexp_matches(d, '{p}') as int)) as med_{n}_any,
max(cast(regexp_matches(d, '{p}') and starttime >= index_time - interval 30 day as int)) as med_{n}_recent_30d,
max(cast(regexp_matches(d, '{p}') and starttime >= index_time - interval 90 day as int)) as med_{n}_recent_90d'''
for n, p in RX_CLASSES.items())}, {R('count(*) / 365.0::double', 'med_any_per_day')} from rx_window group by 1""")
def medication_features(b):
    return rounded(EV.medication_table(b.stored_cohort(), b.prescriptions(), 365, (30, 90), RX_CLASSES))


@query("A7", f"""select subject_id, vital, {R('"min"', '"min"')}, {R('"max"', '"max"')}, {R('mean')}, {R('"last"', '"last"')}, "count",
{R('recency_days')} from vital_stats""")
def vital_statistics(b):
    return rounded(EV.vital_long(b.stored_lab_cohort(), b.labevents(), LAB_LOOKBACK, CHART_SIGNS))


@query("A7 P20", f"""select c.subject_id, {', '.join(f'''(round(max("{s}") filter (vital = '{v}'), 6)) as vital_{v}_{s}'''
for v in CHART_SIGNS for s in ('min', 'max', 'mean', 'last', 'recency_days'))},
{', '.join(f'''case when max("last") filter (vital = '{v}') is null then 1 else 0 end as vital_{v}_missing''' for v in CHART_SIGNS)}
from lab_cohort c left join vital_stats v on c.subject_id = v.subject_id group by 1""")
def vital_wide_table(b):
    return rounded(EV.vital_table(b.stored_lab_cohort(), b.labevents(), LAB_LOOKBACK, CHART_SIGNS))


@query("A8", """select c.subject_id, count(*) as prev_adm_365d from cohort c join admissions a
on a.subject_id = c.subject_id and a.admittime < c.index_time and a.admittime >= c.index_time - interval 365 day
group by 1""")
def prior_stay_count(b):
    return EV.prior_stays(b.cohort(), b.admissions())


@query("A9", """select c.subject_id, max(cast(is_diab as int)) as prior_diab, max(cast(is_cvd as int)) as prior_cvd
from cohort c join dx_narrow d on d.subject_id = c.subject_id and d.dx_time < c.index_time and (is_diab or is_cvd)
group by 1""")
def prior_history_flags(b):
    return EV.prior_history(b.cohort(), b.diagnoses(), b.admissions())


@query("A10", f"""select subject_id, {TS('diab_first_event_time')},
cast(diab_first_event_hadm_id as varchar) as diab_first_event_hadm_id, {TS('cvd_first_event_time')},
cast(cvd_first_event_hadm_id as varchar) as cvd_first_event_hadm_id from first_events""")
def earliest_coded_event(b):
    dated = EV.dated_diagnoses(b.diagnoses(), b.admissions(), FULL_CODEBOOKS)
    return rounded(_stay_ids_as_text(EV.earliest_events(dated, list(FULL_CODEBOOKS))))


@query("A11", f"""select count(*) as n, count(distinct subject_id) as n_subjects, min(year(index_time)) as first_year,
max(year(index_time)) as last_year, {R('avg(age_at_admit)', 'age_mean')}, {R('stddev_samp(age_at_admit)', 'age_sd')},
{R('min(age_at_admit)', 'age_min')}, {R('max(age_at_admit)', 'age_max')},
{', '.join(R(f'quantile_cont(age_at_admit, {p})', n) for p, n in ((.1, 'age_p10'), (.25, 'age_p25'), (.5, 'age_median'), (.75, 'age_p75'), (.9, 'age_p90')))}
from cohort""")
def cohort_profile(b):
    return rounded(E.cohort_profile(b.cohort()))


@query("A11", "select upper(gender) as value, count(*) as n from cohort group by 1")
def cohort_value_counts(b):
    return E.value_counts(b.cohort(), "gender")


WORD = "('0x' || substr(md5(cast(subject_id as varchar)), 1, 8))::bigint"


@query("A12", f"""select fold, count(*) as n, {B(f'sum({WORD})', 'hash_sum')}, bit_xor({WORD}) as hash_xor
from (select distinct fold, subject_id from matrix) group by 1""")
def id_set_fingerprint(b):
    return E.id_fingerprint(b.matrix(), "subject_id", ["fold"])


@query("A13", f"""select count(*) as n, {B('sum(y)', 'n_pos')}, {R('avg(y)', 'pos_rate')},
{R('count(*) / (2.0 * (count(*) - sum(y)))', 'weight_neg')}, {R('count(*) / (2.0 * sum(y))', 'weight_pos')},
{R('(count(*) - sum(y)) / greatest(1, sum(y))', 'neg_per_pos')} from matrix where fold = 'train'""")
def class_balance(b):
    from ..operators.models import class_balance as balance

    return rounded(balance(b.matrix().where("fold = 'train'")))


@query("W1", f"""select subject_id, hadm_id, {TS('admittime')} from stays
qualify row_number() over (partition by subject_id order by admittime, hadm_id) = 1""")
def first_stay_per_subject(b):
    return rounded(first_rows(EV.valid_stays(b.admissions()), ["subject_id"], ["admittime", "hadm_id"])
                   .select("subject_id", "hadm_id", "admittime"))


@query("W2", """select itemid, label from labevents
qualify row_number() over (partition by itemid order by label, event_id) = 1""")
def keyed_dedup(b):
    return first_rows(b.labevents(), ["itemid"], ["label", "event_id"]).select("itemid", "label")


@query("W3", """with r as (select price, row_number() over (order by price) - 1 as i, count(*) over () as n from group_meta)
select max(price) filter (i = 10) as tenth, max(price) filter (i = n // 2) as middle, max(n) as n_all from r""")
def positional_cut(b):
    return order_statistics(b.group_meta().select("price"), "price",
                            {"tenth": F.lit(10), "middle": F.floor(F.col("n_all") / 2)})




def qcut_sql(table: str, value: str, bins: int, head: str = "") -> str:
    """Edges of an equal-frequency cut as the relation `d`, with one list column `q`."""
    probs = ", ".join(f"{i / bins}" for i in range(bins + 1))
    return f"{head} d as (select list_sort(list_distinct(quantile_cont({value}, [{probs}]))) as q from {table})"


@query("W4", f"""{qcut_sql('group_meta', 'price', 7, 'with')}
select greatest(1, len([e for e in q if e < price])) as bin, count(*) as n, {R('min(price)', 'lo')},
{R('max(price)', 'hi')} from group_meta, d group by 1""")
def equal_frequency_bins(b):
    cut = quantile_bins(b.group_meta(), [], "price", 7)
    return rounded(cut.groupBy(F.col("bin").cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi")))


@query("W5", f"""with e as (select [{', '.join(repr(x) + '::double' for x in equal_width_edges(15))}] as edges)
select len([e for e in edges if e <= y_score_raw]) - 1 as bin, count(*) as n from calibrated, e group by 1""")
def equal_width_bins(b):
    cut = edges_at_or_below(b.calibrated(), "y_score_raw", equal_width_edges(15), "k")
    return cut.groupBy((F.col("k") - 1).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("W6", f"""select variant, {R('score')}, cast(sum(sum(y_true)) over w as bigint) as tp,
cast(sum(sum(1 - y_true)) over w as bigint) as fp from long_preds group by variant, score
window w as (partition by variant order by score desc)""")
def cumulative_confusion(b):
    return rounded(E.sweep(P.long_predictions(b.calibrated()), ["variant"]).select("variant", "score", "tp", "fp"))


@query("W7", f"""select subject_id, label, cast(rank as int) as rank, {R('mean')} from (select *, row_number() over
(partition by subject_id order by mean desc, label) as rank from lab_long where mean is not null) where rank <= 2""")
def top_labels_per_subject(b):
    return rounded(E.top_per_group(_lab_long(b), ["subject_id"], "mean", 2, "label")
                   .select("subject_id", "label", "rank", "mean"))


@query("O2", """select cast(year(admittime) as varchar) as year, null as gender, count(*) as n from admissions group by 1
union all select null, gender, count(*) from cohort group by 2""")
def union_of_result_tables(b):
    by_year = b.admissions().groupBy(F.year("admittime").cast("string").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    by_sex = b.cohort().groupBy("gender").agg(F.count(F.lit(1)).alias("n"))
    return by_year.unionByName(by_sex, allowMissingColumns=True)


# --- cohort, labels, features -----------------------------------------------------------


@query("C1 W1 P7 P5 P6", f"""select subject_id, hadm_id, index_hadm_id, gender, sex, {R('age_at_admit')}, {R('age')}, ethnicity,
{TS('index_time')}, index_date, index_year, {TS('discharge_time')}, {R('los_hours')}, in_hosp_mortality,
{TS('feature_time_upper_bound')}, {TS('label_time_zero')} from cohort""")
def cohort_index_stays(b):
    return rounded(b.cohort())


LABEL_COLUMNS = ", ".join(f"{n}_base and {n}_first_event_time <= index_time + interval {h} day as {n}_incident_{h}d"
                          for n in ("diab", "cvd") for h in (30, 90, 365))


@query("C2", f"""select subject_id, hadm_id, {TS('index_time')}, {TS('diab_first_event_time')},
cast(diab_first_event_hadm_id as varchar) as diab_first_event_hadm_id, {TS('cvd_first_event_time')},
cast(cvd_first_event_hadm_id as varchar) as cvd_first_event_hadm_id, diab_prevalent_at_index, cvd_prevalent_at_index,
{LABEL_COLUMNS} from incident""")
def incident_labels(b):
    return rounded(_stay_ids_as_text(EV.incident_labels(b.cohort(), b.diagnoses(), b.admissions())))


@query("C2 F5", """select condition, count(*) as subjects, count(*) filter (prev) as prevalent,
count(*) filter (base and t <= index_time + interval 30 day) as incident_30d,
count(*) filter (base and t <= index_time + interval 90 day) as incident_90d,
count(*) filter (base and t <= index_time + interval 365 day) as incident_365d from
(select 'diab' as condition, index_time, diab_prevalent_at_index as prev, diab_base as base,
 diab_first_event_time as t from incident union all
 select 'cvd', index_time, cvd_prevalent_at_index, cvd_base, cvd_first_event_time from incident) group by 1""")
def incidence_by_horizon(b):
    lab = EV.incident_labels(b.cohort(), b.diagnoses(), b.admissions())
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("condition"), F.col(f"{n}_prevalent_at_index").alias("prev"),
                 *[F.col(f"{n}_incident_{h}d").alias(f"h{h}") for h in (30, 90, 365)]) for n in ("diab", "cvd")]))
    return lab.select(rows.alias("r")).select("r.*").groupBy("condition").agg(
        F.count(F.lit(1)).alias("subjects"), F.count_if("prev").alias("prevalent"),
        *[F.count_if(f"h{h}").alias(f"incident_{h}d") for h in (30, 90, 365)])


@query("C3", """select c.subject_id, coalesce(max(cast(is_diab as int)), 0) as diab_incident_365d,
coalesce(max(cast(is_cvd as int)), 0) as cvd_incident_365d from cohort c left join dx_narrow d
on d.subject_id = c.subject_id and d.dx_time >= c.index_time and d.dx_time <= c.index_time + interval 365 day
group by 1""")
def window_labels_narrow(b):
    return EV.window_labels(b.stored_cohort(), b.diagnoses(), b.admissions())


@query("C4", rf"""with m as (select subject_id, cast(count(*) as int) as med_any_count,
{', '.join(f'''cast(count(*) filter (regexp_matches(d, '{p}')) as int) as {n}''' for n, p in RX_CLASSES.items())}
from rx_window group by 1)
select c.subject_id, {R('age_at_admit')}, case when gender = 'F' then 1 else 0 end as gender_f,
case when gender = 'M' then 1 else 0 end as gender_m, coalesce(med_any_count, 0) as med_any_count,
{', '.join(f'coalesce({n}, 0) as med_{n}_count' for n in RX_CLASSES)} from cohort c left join m
on m.subject_id = c.subject_id""")
def event_feature_table(b):
    c = b.stored_cohort()
    meds = EV.medication_table(c, b.prescriptions(), 365, (30, 90), RX_CLASSES)
    out = EV.event_features(c, meds=meds, genders=["F", "M"])
    return rounded(out.select("subject_id", "age_at_admit", "gender_f", "gender_m", "med_any_count",
                              *[f"med_{n}_count" for n in RX_CLASSES]))


LAB_COLUMNS = [(v, s) for v in EVENT_LABELS for s in ("min", "max", "mean", "last", "count", "recency_days", "per_day")]
VITAL_COLUMNS = [(v, s) for v in CHART_SIGNS for s in ("min", "max", "mean", "last", "recency_days")]
MED_COLUMNS = [f"{n}_{s}" for n in RX_CLASSES for s in ("count", "any", "recent_30d", "recent_90d")]


def _clipped_sql(prefix: str, columns: list, source: str, key: str) -> str:
    """A wide table of the statistics, the continuous ones clipped to their own quantiles."""
    wide = ", ".join(f"(max(\"{s}\") filter ({key} = '{v}'))::double as {prefix}_{v}_{s}" for v, s in columns)
    held = [f"{prefix}_{v}_{s}" for v, s in columns if s in ("min", "max", "mean", "last")]
    limits = ", ".join(f"quantile_cont({c}, 0.05) as lo_{c}, quantile_cont({c}, 0.95) as hi_{c}" for c in held)
    clip = ", ".join(f"case when {c} is not null then greatest(lo_{c}, least(hi_{c}, {c})) end as {c}" for c in held)
    return f"""{prefix}_wide as (select subject_id, {wide} from {source} group by 1), {prefix}_limits as (select {limits} from {prefix}_wide),
{prefix}_table as (select {prefix}_wide.* replace ({clip}) from {prefix}_wide, {prefix}_limits)"""


@query("C4 C7 P14 P20", rf"""with labs as (select l.* from lab_long l join full_cohort using (subject_id)),
vitals as (select v.* from vital_stats v join full_cohort using (subject_id)),
{_clipped_sql('lab', LAB_COLUMNS, 'labs', 'label')}, {_clipped_sql('vital', VITAL_COLUMNS, 'vitals', 'vital')},
m as (select subject_id, count(*) as med_any_count, date_diff('microsecond', max(starttime), max(index_time)) / 8.64e10 as med_recency_days,
count(*) / 365.0::double as med_any_per_day, {', '.join(f"""count(*) filter (regexp_matches(d, '{p}')) as med_{n}_count,
max(cast(regexp_matches(d, '{p}') as int)) as med_{n}_any,
max(cast(regexp_matches(d, '{p}') and starttime >= index_time - interval 30 day as int)) as med_{n}_recent_30d,
max(cast(regexp_matches(d, '{p}') and starttime >= index_time - interval 90 day as int)) as med_{n}_recent_90d"""
for n, p in RX_CLASSES.items())} from recent_window group by 1)
select c.subject_id, {R('age_at_admit')}, case when gender = 'F' then 1 else 0 end as gender_f, case when gender = 'M' then 1 else 0 end as gender_m,
{', '.join(f"coalesce(lab_{v}_count, 0)::int as lab_{v}_count" if s == 'count' else R(f'lab_{v}_{s}') for v, s in LAB_COLUMNS)},
{', '.join(f"case when l.subject_id is not null and lab_{v}_last is null then 1 else 0 end as lab_{v}_missing" for v in EVENT_LABELS)},
coalesce(med_any_count, 0)::int as med_any_count, {R('med_recency_days')}, {R('med_any_per_day')},
{', '.join(f'coalesce(med_{c}, 0)::int as med_{c}' for c in MED_COLUMNS)}, {', '.join(R(f'vital_{v}_{s}') for v, s in VITAL_COLUMNS)},
{', '.join(f"case when vital_{v}_last is null then 1 else 0 end as vital_{v}_missing" for v in CHART_SIGNS)}
from full_cohort c left join lab_table l using (subject_id) left join m using (subject_id) left join vital_table v using (subject_id)""")
def complete_feature_table(b):
    """Demographics, labs, medication and vitals of one cohort, statistics winsorised, in one run."""
    c = stored(b.full_cohort(), "full_cohort")
    limits = (0.05, 0.95)
    window = EV.events_in_window(b.labevents(), c, "charttime", LAB_LOOKBACK, keep=["event_id", "label", "valuenum"])
    labs = EV.lab_statistics(window, "event_id").withColumn("per_day", F.col("count") / F.lit(float(LAB_LOOKBACK)))
    meds = EV.medication_table(c, b.recent_prescriptions(), 365, (30, 90), RX_CLASSES)
    vitals = EV.vital_table(c, b.labevents(), LAB_LOOKBACK, CHART_SIGNS, winsor=limits)
    return rounded(EV.event_features(c, labs, EVENT_LABELS, meds, vitals, ["F", "M"], limits))


@query("C5 P13 P14", f"""with prev as (select c.subject_id, count(*) as k from cohort c join admissions a
on a.subject_id = c.subject_id and a.admittime < c.index_time and a.admittime >= c.index_time - interval 365 day
group by 1), hist as (select c.subject_id, max(cast(is_diab as int)) as dm, max(cast(is_cvd as int)) as cv
from cohort c join dx_narrow d on d.subject_id = c.subject_id and d.dx_time < c.index_time group by 1)
select c.subject_id, {R('age')}, case when sex = 'F' then 1 else 0 end as sex_female,
0 as eth_white, 0 as eth_black, 0 as eth_asian, 0 as eth_hispanic, 1 as eth_other,
coalesce(k, 0) as prev_adm_365d, {R('los_hours / 24.0', 'los_days_index')}, coalesce(dm, 0) as prior_diab,
coalesce(cv, 0) as prior_cvd from cohort c left join prev using (subject_id) left join hist using (subject_id)""")
def compact_feature_matrix(b):
    return rounded(EV.compact_features(b.stored_cohort(), b.admissions(), b.diagnoses()))


def _catalogue_sql() -> str:
    """Rows of the fixed features, from lists of classes, signs and statistics."""
    classes, signs = (", ".join(f"('{n}')" for n in names) for names in (RX_CLASSES, CHART_SIGNS))
    return f"""fixed as (select 'age_at_admit' as name, 'float64' as dtype, 'cohort' as source,
 'Age in years when the index stay began' as description, null as units, null::int as lookback_days, null as agg
union all select * from (values ('med_any_count', 'int32', 'prescriptions', 'Any prescriptions', null, 7, 'count'),
 ('med_recency_days', 'float64', 'prescriptions', 'Days since last prescription', 'days', 7, 'recency_days'),
 ('med_any_per_day', 'float64', 'prescriptions', 'Prescriptions per day', 'count/day', 7, 'count_per_day'))
union all select 'med_' || n || s, t, 'prescriptions', d || n || e, null, k, a from (values {classes}) c(n),
 (values ('_count', 'int32', 'Count of ', '', 7, 'count'), ('_any', 'int8', 'Any ', '', 7, 'any'),
  ('_recent_30d', 'int8', 'Any ', ' within 30 days', 30, 'recent_any'), ('_recent_90d', 'int8', 'Any ', ' within 90 days', 90, 'recent_any')) p(s, t, d, e, k, a)
union all select 'vital_' || n || '_' || s, 'float64', 'chartevents', n || ' ' || s, null, 7, s from (values {signs}) c(n),
 (values ('min'), ('max'), ('mean'), ('last')) p(s)
union all select 'vital_' || n || s, t, 'chartevents', d || n || e, u, 7, a from (values {signs}) c(n),
 (values ('_recency_days', 'float64', 'Days since last ', '', 'days', 'recency_days'), ('_missing', 'int8', 'No ', ' in window', null, 'missing_flag')) p(s, t, d, e, u, a))"""


@query("C6", f"""with l as (select label, 'u' || length(label) as unit from (select distinct label from lab_window)),
s as (select * from (values ('min'), ('max'), ('mean'), ('last'), ('count'), ('recency_days'), ('per_day'), ('missing')) t(stat)),
{_catalogue_sql()}
select * replace (lookback_days::varchar as lookback_days), 'strictly before index_time' as leakage_guard from (select * from fixed union all
select 'lab_' || label || '_' || stat, case when stat = 'missing' then 'int8' else 'float64' end, 'labevents', label || ' ' || stat,
case when stat in ('min','max','mean','last') then unit when stat = 'recency_days' then 'days' when stat = 'per_day' then 'count/day' end, 7,
case stat when 'per_day' then 'count_per_day' when 'missing' then 'missing_flag' else stat end from l, s)""")
def feature_metadata(b):
    units = _lab_window(b).select("label").distinct() \
        .withColumn("unit", F.concat(F.lit("u"), F.length("label").cast("string")))
    rows = EV.feature_catalogue(b.spark, units, list(RX_CLASSES), list(CHART_SIGNS), LAB_LOOKBACK, (30, 90))
    return rows.withColumn("lookback_days", F.col("lookback_days").cast("string"))


@query("C7", f"""with q as (select label, quantile_cont(mean, 0.05) as lo, quantile_cont(mean, 0.95) as hi from lab_long
where mean is not null group by 1)
select subject_id, l.label, {R('case when lo is null then mean when mean is null then null else greatest(lo, least(hi, mean)) end', 'mean')}
from lab_long l left join q on q.label = l.label""")
def winsorised_means(b):
    long = _lab_long(b).select("subject_id", "label", "mean")
    limits = EV.winsor_limits(long, ["label"], "mean", 0.05, 0.95)
    return rounded(EV.winsorise(long, limits, "label", "mean"))
