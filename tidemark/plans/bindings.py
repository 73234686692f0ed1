"""The entities of the engine expressed over the star-schema test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as EV
from ..operators.split import fold_by_time
from ..session import stored

START_YEAR = 1997
LAB_LOOKBACK = 7
MATRIX_FOLDS = ("1999-06-30", "2000-03-31")
PREDICTION_CUT = "1998-07-01"
RX_CLASSES = {"hot": r"\bhot\b", "ring_or_rod": r"ring|rod", "fastener": r"\b(bolt|gear)\b"}
CHART_SIGNS = {"buying": r"purchase|view", "fault": r"err", "entry": r"sign ?up|click"}
EVENT_LABELS = ["click", "error", "purchase", "signup", "view"]


def prediction_fold(at: str) -> Column:
    return F.when(F.col(at) < F.lit(PREDICTION_CUT).cast("timestamp_ntz"), "val").otherwise("test")


class Bindings:
    """Lazy entity views over one folder of tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._tables[name]

    def patients(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("subject_id"), F.when(k % 2 == 0, "F").otherwise("M").alias("gender"),
            (F.lit(10) + k % 80).cast("int").alias("anchor_age"), F.lit(1997).alias("anchor_year"),
            F.col("c_mktsegment").alias("ethnicity"))

    def patients_dob(self) -> DataFrame:
        k = F.col("c_custkey")
        born = F.make_timestamp_ntz(F.lit(1930) + k % 60, F.lit(1) + k % 12, F.lit(1) + k % 28,
                                    F.lit(0), F.lit(0), F.lit(0))
        return self.table("customer").select(
            k.alias("subject_id"), F.when(k % 2 == 0, "F").otherwise("M").alias("gender"),
            F.when(k % 11 != 0, born).alias("dob"))

    def admissions(self) -> DataFrame:
        out = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")) \
            .agg(F.max("l_shipdate").alias("dischtime"))
        return self.table("orders").join(out, "o_orderkey", "left").select(
            F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
            F.col("o_orderdate").alias("admittime"), "dischtime",
            F.when(F.col("o_orderstatus") == "F", F.col("dischtime")).alias("deathtime"))

    def _lines(self, *cols: str) -> DataFrame:
        owner = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"),
                                            F.col("o_custkey").alias("subject_id"))
        return self.table("lineitem").select("l_orderkey", *cols).join(owner, "l_orderkey")

    def diagnoses(self) -> DataFrame:
        part = F.col("l_partkey")
        nine = F.col("l_linenumber") % 2 == 1
        code = (
            F.when(nine, (F.lit(200) + part % 300).cast("string"))
            .when(part % 4 < 2, F.concat(F.lit("E"), F.lpad((part % 60).cast("string"), 2, "0"), F.lit("."),
                                         (F.col("l_suppkey") % 10).cast("string")))
            .otherwise(F.concat(F.lit("i"), F.lpad((part % 90).cast("string"), 2, "0"))))
        return self._lines("l_partkey", "l_suppkey", "l_linenumber").select(
            "subject_id", F.col("l_orderkey").alias("hadm_id"), code.alias("icd_code"),
            F.when(nine, 9).otherwise(10).alias("icd_version"))

    def prescriptions(self) -> DataFrame:
        drug = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("drug"))
        return self._lines("l_partkey", "l_shipdate").join(drug, "l_partkey").select(
            "subject_id", F.col("l_orderkey").alias("hadm_id"), "drug", F.col("l_shipdate").alias("starttime"))

    def labevents(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("subject_id"), F.col("event_id").alias("hadm_id"), "event_id",
            F.length("event_type").alias("itemid"), F.col("event_type").alias("label"),
            F.col("ts").alias("charttime"),
            F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("valuenum"))

    def lab_dictionary(self) -> DataFrame:
        return self.labevents().select("itemid", "label").distinct().withColumn(
            "unitname", F.concat(F.lit("u"), F.col("itemid").cast("string")))

    def lab_cohort(self) -> DataFrame:
        at = F.min("ts")
        return (self.table("events")
                .where((F.col("event_type") == "purchase")
                       & (F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")))
                .groupBy(F.col("user_id").alias("subject_id"))
                .agg(at.alias("index_time"), at.alias("feature_time_upper_bound")))

    def full_cohort(self) -> DataFrame:
        """Subjects with labs, vitals, prescriptions and demographics at one index time."""
        age = F.col("anchor_age").cast("double") + F.year("index_time") - F.col("anchor_year")
        return self.lab_cohort().join(self.patients(), "subject_id", "left").select(
            "subject_id", "index_time", "feature_time_upper_bound", "gender",
            F.least(F.lit(120.0), F.greatest(F.lit(0.0), age)).alias("age_at_admit"))

    def recent_prescriptions(self) -> DataFrame:
        """Prescriptions moved into the years of the lab events."""
        return self.prescriptions().withColumn("starttime", F.col("starttime") + F.make_ym_interval(F.lit(24)))

    def cohort(self) -> DataFrame:
        return EV.index_stays(self.admissions(), self.patients(), 18, START_YEAR)

    def stored_lab_cohort(self) -> DataFrame:
        return stored(self.lab_cohort(), "lab_cohort")

    def stored_cohort(self) -> DataFrame:
        """The cohort written once, for plans that use it several times."""
        return stored(self.cohort(), "cohort")

    def predictions(self) -> DataFrame:
        k, positive = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
        base = ((k * 7919) % 1000) * 7 + F.when(positive, 3000).otherwise(0)
        return self.table("orders").select(
            k.alias("subject_id"), F.when(positive, 1).otherwise(0).alias("y_true"),
            (base.cast("double") / F.lit(10000.0)).alias("y_score"), F.col("o_orderdate").alias("index_time"))

    def calibrated(self) -> DataFrame:
        """Predictions with a second score that ignores part of the signal."""
        k, positive = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
        flat = ((k * 104729) % 997) * 8 + F.when(positive, 1500).otherwise(0)
        base = ((k * 7919) % 1000) * 7 + F.when(positive, 3000).otherwise(0)
        return self.table("orders").select(
            k.alias("subject_id"), F.when(positive, 1).otherwise(0).alias("y_true"),
            (base.cast("double") / F.lit(10000.0)).alias("y_score_raw"),
            (flat.cast("double") / F.lit(10000.0)).alias("y_score_alt"))

    def folded_predictions(self, fold: str) -> DataFrame:
        """Validation before the cut date, test from it on."""
        return self.predictions().where(prediction_fold("index_time") == fold)

    def group_meta(self) -> DataFrame:
        seg = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
        return self.table("orders").join(seg, "o_custkey", "left").select(
            F.col("o_orderkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"),
            F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"),
            F.col("o_orderdate").alias("index_time"))

    def matrix(self) -> DataFrame:
        """Order-level feature matrix with nulls, a binary, a constant and an empty column, fold and label."""
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.count(F.lit(1)).cast("double").alias("f_lines"), F.sum("l_quantity").alias("f_qty"),
            F.max("l_discount").alias("f_disc"), F.max("l_tax").alias("tax"))
        k, positive = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
        signal = ((k * 7919) % 1000) * 7 + F.when(positive, 3000).otherwise(0)
        return self.table("orders").join(lines, "o_orderkey", "left").select(
            k.alias("subject_id"),
            fold_by_time("o_orderdate", *[F.lit(d).cast("timestamp_ntz") for d in MATRIX_FOLDS]).alias("fold"),
            F.when(positive, 1).otherwise(0).alias("y"),
            F.col("o_totalprice").alias("f_price"), "f_lines", "f_qty", "f_disc",
            F.when(k % 5 != 0, F.col("tax")).alias("f_tax"),
            F.when(k % 7 != 0, F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)).alias("f_urgent"),
            (signal.cast("double") / F.lit(10000.0)).alias("f_signal"),
            F.lit(1.0).alias("f_const"), F.lit(None).cast("double").alias("f_empty"))

    def stored_matrix(self) -> DataFrame:
        """The matrix written once, for fits that pass over it several times."""
        return stored(self.matrix(), "matrix")


MATRIX_FEATURES = ["f_price", "f_lines", "f_qty", "f_disc", "f_tax", "f_urgent", "f_signal", "f_const", "f_empty"]

# The same entities in SQL, for checking results with another engine.
SQL_VIEWS = {
    "patients": """select c_custkey as subject_id, case when c_custkey % 2 = 0 then 'F' else 'M' end as gender,
        cast(10 + c_custkey % 80 as int) as anchor_age, 1997 as anchor_year, c_mktsegment as ethnicity
        from customer""",
    "patients_dob": """select c_custkey as subject_id, case when c_custkey % 2 = 0 then 'F' else 'M' end as gender,
        case when c_custkey % 11 <> 0 then make_timestamp(1930 + c_custkey % 60, 1 + c_custkey % 12,
        1 + c_custkey % 28, 0, 0, 0.0) end as dob from customer""",
    "admissions": """select o.o_custkey as subject_id, o.o_orderkey as hadm_id, o.o_orderdate as admittime,
        l.dischtime, case when o.o_orderstatus = 'F' then l.dischtime end as deathtime
        from orders o left join (select l_orderkey, max(l_shipdate) as dischtime from lineitem group by 1) l
        on o.o_orderkey = l.l_orderkey""",
    "diagnoses": """select o.o_custkey as subject_id, l.l_orderkey as hadm_id,
        case when l.l_linenumber % 2 = 1 then cast(200 + l.l_partkey % 300 as varchar)
             when l.l_partkey % 4 < 2 then concat('E', lpad(cast(l.l_partkey % 60 as varchar), 2, '0'), '.',
                                                  cast(l.l_suppkey % 10 as varchar))
             else concat('i', lpad(cast(l.l_partkey % 90 as varchar), 2, '0')) end as icd_code,
        case when l.l_linenumber % 2 = 1 then 9 else 10 end as icd_version
        from lineitem l join orders o on l.l_orderkey = o.o_orderkey""",
    "prescriptions": """select o.o_custkey as subject_id, l.l_orderkey as hadm_id, p.p_name as drug,
        l.l_shipdate as starttime from lineitem l join orders o on l.l_orderkey = o.o_orderkey
        join part p on l.l_partkey = p.p_partkey""",
    "labevents": """select user_id as subject_id, event_id as hadm_id, event_id, length(event_type) as itemid,
        event_type as label, ts as charttime, case when event_id % 17 <> 0 then value end as valuenum
        from events""",
    "lab_dictionary": """select distinct itemid, label, 'u' || cast(itemid as varchar) as unitname from labevents""",
    "lab_cohort": """select user_id as subject_id, min(ts) as index_time, min(ts) as feature_time_upper_bound
        from events where event_type = 'purchase' and ts >= timestamp '2024-01-15 00:00:00' group by 1""",
    "lab_window": """select l.*, c.index_time from labevents l join lab_cohort c using (subject_id)
        where charttime < feature_time_upper_bound and charttime >= index_time - interval 7 day""",
    "lab_long": """select subject_id, label, min(valuenum) as "min", max(valuenum) as "max", avg(valuenum) as mean,
        array_agg(valuenum order by charttime desc, event_id desc)[1] as "last", count(valuenum) as "count",
        date_diff('microsecond', max(charttime), max(index_time)) / 8.64e10 as recency_days,
        count(valuenum) / 7.0::double as per_day from lab_window group by subject_id, label""",
    "chart_window": """select w.*, sign as vital from (select *, unnest([v for v in [
        case when regexp_matches(label, 'purchase|view') then 'buying' end,
        case when regexp_matches(label, 'err') then 'fault' end,
        case when regexp_matches(label, 'sign ?up|click') then 'entry' end] if v is not null]) as sign
        from lab_window) w""",
    "vital_stats": """select subject_id, vital, min(valuenum) as "min", max(valuenum) as "max", avg(valuenum) as mean,
        (array_agg(valuenum order by charttime desc, event_id desc) filter (valuenum is not null))[1] as "last",
        count(valuenum) as "count",
        date_diff('microsecond', max(charttime), max(index_time)) / 8.64e10 as recency_days
        from chart_window group by subject_id, vital""",
    "full_cohort": """select c.*, gender,
        least(120.0, greatest(0.0, cast(anchor_age as double) + year(index_time) - anchor_year)) as age_at_admit
        from lab_cohort c left join patients using (subject_id)""",
    "recent_window": """select subject_id, lower(drug) as d, starttime + interval 24 year as starttime, index_time
        from prescriptions join full_cohort using (subject_id) where starttime + interval 24 year < feature_time_upper_bound
        and starttime + interval 24 year >= index_time - interval 365 day""",
    "stays": """select a.*, date_diff('microsecond', admittime, dischtime) / 3.6e9 as los_hours
        from admissions a where subject_id is not null and hadm_id is not null and dischtime >= admittime""",
    "aged": """select s.*, p.gender, p.ethnicity,
        least(120.0, greatest(0.0, cast(p.anchor_age as double) + year(s.admittime) - p.anchor_year)) as age_at_admit
        from stays s left join patients p using (subject_id)""",
    "cohort": """select subject_id, hadm_id, hadm_id as index_hadm_id, gender, gender as sex, age_at_admit,
        age_at_admit as age, ethnicity, admittime as index_time, strftime(admittime, '%Y-%m-%d') as index_date,
        year(admittime) as index_year, dischtime as discharge_time, los_hours,
        deathtime is not null as in_hosp_mortality, admittime as feature_time_upper_bound,
        admittime as label_time_zero from aged where year(admittime) >= 1997 and age_at_admit >= 18
        qualify row_number() over (partition by subject_id order by admittime, hadm_id) = 1""",
    "rx_window": """select p.*, lower(drug) as d, c.index_time from prescriptions p join cohort c using (subject_id)
        where starttime < feature_time_upper_bound and starttime >= index_time - interval 365 day""",
    "dx_full": """select d.subject_id, d.hadm_id, a.admittime as dx_time,
        icd_version = 9 and substr(code, 1, 3) in ('249','250')
          or icd_version = 10 and substr(code, 1, 3) in ('E08','E09','E10','E11','E13') as is_diab,
        icd_version = 9 and substr(code, 1, 3) in ('410','411','412','413','414','428','433','434','435','436',
          '437','438','440')
          or icd_version = 10 and substr(code, 1, 3) in ('I20','I21','I22','I23','I24','I25','I50','I60','I61','I62',
          'I63','I64','I65','I66','I67','I68','I69','I70') as is_cvd
        from (select *, upper(regexp_replace(icd_code, '[^A-Za-z0-9]', '', 'g')) as code from diagnoses) d
        join admissions a using (hadm_id)""",
    "dx_narrow": """select d.subject_id, d.hadm_id, a.admittime as dx_time,
        icd_version = 9 and code like '250%' or icd_version = 10 and substr(code, 1, 3) in ('E10','E11','E13','E14')
          as is_diab,
        icd_version = 9 and substr(code, 1, 3) in ('410','411','412','413','414','428','433','434','436')
          or icd_version = 10 and substr(code, 1, 3) in ('I20','I21','I22','I23','I24','I25','I50','I63','I64')
          as is_cvd
        from (select *, upper(icd_code) as code from diagnoses) d
        join admissions a on a.hadm_id = d.hadm_id and a.subject_id = d.subject_id""",
    "first_events": """select subject_id,
        min(dx_time) filter (is_diab) as diab_first_event_time,
        arg_min(hadm_id, (dx_time, hadm_id)) filter (is_diab) as diab_first_event_hadm_id,
        min(dx_time) filter (is_cvd) as cvd_first_event_time,
        arg_min(hadm_id, (dx_time, hadm_id)) filter (is_cvd) as cvd_first_event_hadm_id
        from dx_full where is_diab or is_cvd group by 1""",
    "incident": """select c.subject_id, c.hadm_id, c.index_time, e.* exclude (subject_id),
        coalesce(diab_first_event_time < index_time, false) as diab_prevalent_at_index,
        coalesce(cvd_first_event_time < index_time, false) as cvd_prevalent_at_index,
        coalesce((diab_first_event_time > index_time or (diab_first_event_time = index_time
          and diab_first_event_hadm_id = c.hadm_id)), false) as diab_base,
        coalesce((cvd_first_event_time > index_time or (cvd_first_event_time = index_time
          and cvd_first_event_hadm_id = c.hadm_id)), false) as cvd_base
        from cohort c left join first_events e on c.subject_id = e.subject_id""",
    "preds": """select o_orderkey as subject_id, case when o_orderstatus = 'F' then 1 else 0 end as y_true,
        cast(((o_orderkey * 7919) % 1000) * 7 + case when o_orderstatus = 'F' then 3000 else 0 end as double)
        / 10000.0::double as y_score, o_orderdate as index_time from orders""",
    "val_preds": "select * from preds where index_time < timestamp '1998-07-01'",
    "test_preds": "select * from preds where index_time >= timestamp '1998-07-01'",
    "platt_fit": """with recursive d as materialized (select ln(s / (1 - s)) as x, n, p from (select
        greatest(1e-6::double, least(1 - 1e-6::double, y_score)) as s, count(*) as n, sum(y_true) as p
        from val_preds group by 1)),
        step(i, a, b) as (select 0, 0.0::double, 0.0::double union all
        select i + 1, a + (h01 * g0 - h00 * g1) / det, b + (h01 * g1 - h11 * g0) / det from
        (select *, h00 * h11 - h01 * h01 as det from (select i, a, b, sum(n * q - p) as g0, sum((n * q - p) * x) as g1,
          sum(n * q * (1 - q)) as h00, sum(n * q * (1 - q) * x) as h01, sum(n * q * (1 - q) * x * x) as h11
         from (select *, 1 / (1 + exp(-(b + a * x))) as q from step, d where i < 12) group by i, a, b)))
        select a, b from step where i = 12""",
    "iso_fit": """with g as (select y_score as s, count(*) as n, sum(y_true) as p from val_preds group by 1),
        c as materialized (select row_number() over (order by s) as i, s, n, p, sum(n) over (order by s) as cn,
          sum(p) over (order by s) as cp from g),
        pairs as (select a.i as j, b.i as k, (b.cp - a.cp + a.p) / (b.cn - a.cn + a.n) as av
          from c a join c b on b.i >= a.i),
        m as (select j, k, min(av) over (partition by j order by k desc) as low from pairs)
        select c.s, max(low) as v from m join c on c.i = m.k group by 1""",
    "calibrated_preds": """select f.*, 1 / (1 + exp(-(b + a * ln(cl / (1 - cl))))) as y_score_platt, coalesce(i.v,
        (select arg_min(v, s) from iso_fit)) as y_score_isotonic from (select subject_id, y_true, y_score as y_score_raw,
        case when index_time < timestamp '1998-07-01' then 'val' else 'test' end as fold,
        greatest(1e-6::double, least(1 - 1e-6::double, y_score)) as cl from preds) f
        cross join platt_fit asof left join iso_fit i on f.y_score_raw >= i.s""",
    "calibrated": """select o_orderkey as subject_id, case when o_orderstatus = 'F' then 1 else 0 end as y_true,
        cast(((o_orderkey * 7919) % 1000) * 7 + case when o_orderstatus = 'F' then 3000 else 0 end as double)
        / 10000.0::double as y_score_raw,
        cast(((o_orderkey * 104729) % 997) * 8 + case when o_orderstatus = 'F' then 1500 else 0 end as double)
        / 10000.0::double as y_score_alt from orders""",
    "long_preds": """select subject_id, y_true, 'raw' as variant, y_score_raw as score from calibrated
        union all select subject_id, y_true, 'alt', y_score_alt from calibrated""",
    "group_meta": """select o_orderkey as subject_id, c_mktsegment as segment, o_orderpriority as priority,
        o_totalprice as price, o_orderdate as index_time from orders left join customer on o_custkey = c_custkey""",
    "grouped": """select subject_id, y_true, variant, score, group_col, group_val from
        (select l.*, segment, priority from long_preds l join group_meta g using (subject_id))
        unpivot (group_val for group_col in (segment, priority))""",
    "matrix": """select o_orderkey as subject_id,
        case when o_orderdate <= timestamp '1999-06-30' then 'train'
             when o_orderdate <= timestamp '2000-03-31' then 'val' else 'test' end as fold,
        case when o_orderstatus = 'F' then 1 else 0 end as y, o_totalprice as f_price, f_lines, f_qty, f_disc,
        case when o_orderkey % 5 <> 0 then tax end as f_tax,
        case when o_orderkey % 7 <> 0 then case when o_orderpriority = '1-URGENT' then 1.0::double
             else 0.0::double end end as f_urgent,
        cast(((o_orderkey * 7919) % 1000) * 7 + case when o_orderstatus = 'F' then 3000 else 0 end as double)
        / 10000.0::double as f_signal, 1.0::double as f_const, cast(null as double) as f_empty
        from orders left join (select l_orderkey, cast(count(*) as double) as f_lines, sum(l_quantity) as f_qty,
        max(l_discount) as f_disc, max(l_tax) as tax from lineitem group by 1) on o_orderkey = l_orderkey""",
}


def sql(body: str) -> str:
    """A query text over the entity views, which precede it as common table expressions.

    Only the views the text needs are included; the order above is their dependency order.
    """
    import re

    need: set[str] = set()

    def visit(text: str) -> None:
        for name, view in SQL_VIEWS.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(view)

    visit(body)
    views = [f"{n} as ({v})" for n, v in SQL_VIEWS.items() if n in need]
    body = body.strip()
    if not views:
        return body
    if body.lower().startswith("with recursive"):
        return "with recursive " + ",\n".join(views) + ",\n" + body[len("with recursive"):].strip()
    if body.lower().startswith("with "):
        return "with " + ",\n".join(views) + ",\n" + body[4:].strip()
    return "with " + ",\n".join(views) + "\n" + body
