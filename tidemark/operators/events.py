"""Cohort, code-based labels and event features."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.codes import FULL_CODEBOOKS, NARROW_CODEBOOKS, Codebook, in_codebook
from .lookups import lookup_join, with_row
from .ranking import first_rows, quantiles

# Drug classes searched in lower-case drug text.
DRUG_CLASSES = {
    "insulin": r"\binsulin\b",
    "metformin": r"\bmetformin\b",
    "sulfonylurea": r"glyburide|glipizide|glimepiride",
    "statin": r"atorvastatin|rosuvastatin|simvastatin|pravastatin|lovastatin|pitavastatin|fluvastatin",
    "beta_blocker": r"metoprolol|carvedilol|atenolol|bisoprolol|propranolol|labetalol|nebivolol",
    "ace_inhibitor": r"\b(lisinopril|enalapril|captopril|ramipril|benazepril|quinapril|perindopril)\b",
    "arb": r"\b(losartan|valsartan|olmesartan|candesartan|irbesartan|telmisartan|azilsartan)\b",
    "diuretic": r"furosemide|bumetanide|torsemide|hydrochlorothiazide|chlorthalidone|indapamide|spironolactone|eplerenone",
}

# Vital signs searched in lower-case chart labels.
VITAL_SIGNS = {
    "heartrate": r"heart rate|heartrate",
    "sbp": r"(systolic )?bp systolic|sbp|arterial line systolic",
    "dbp": r"(diastolic )?bp diastolic|dbp|arterial line diastolic",
    "spo2": r"spo2|oxygen saturation",
    "resp_rate": r"respiratory rate|resp rate",
    "temp": r"temperature|temp",
}

# Fixed value: what feature tables say of the events they may see.
LEAKAGE_GUARD = "strictly before index_time"

LAB_STATS = ["min", "max", "mean", "last", "count"]
ZERO_FILL_ENDINGS = ["_count", "_any", "_missing", "_recent_30d", "_recent_90d"]


def require(df: DataFrame, names: Iterable[str], what: str) -> None:
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise KeyError(f"{what} lacks columns {absent}")


# --- cohort ---------------------------------------------------------------------------


def valid_stays(admissions: DataFrame) -> DataFrame:
    """Stays with keys and both times, not discharged before admission, with length in hours."""
    require(admissions, ["subject_id", "hadm_id", "admittime", "dischtime"], "admissions")
    return (
        admissions.dropna(subset=["subject_id", "hadm_id", "admittime", "dischtime"])
        .where(F.col("dischtime") >= F.col("admittime"))
        .withColumn("los_hours", C.hours_between("admittime", "dischtime"))
    )


def stays_with_age(stays: DataFrame, patients: DataFrame) -> DataFrame:
    """Stays left-joined to patients, with age at admission from either patient schema."""
    have = set(patients.columns)
    if {"anchor_age", "anchor_year"} <= have:
        age, need = C.age_from_anchor("anchor_age", "anchor_year", "admittime"), ["anchor_age", "anchor_year"]
    elif "dob" in have:
        age, need = C.age_from_birth("dob", "admittime"), ["dob"]
    else:
        raise KeyError("patients needs anchor_age and anchor_year, or dob")
    keep = [c for c in ("gender", "ethnicity") if c in have]
    joined = lookup_join(stays, patients.select("subject_id", *need, *keep), "subject_id", "left")
    return joined.withColumn("age_at_admit", age).drop(*need)


def in_years(stays: DataFrame, start_year: int | None, end_year: int | None) -> DataFrame:
    """Inclusive year window as plain time bounds, which reach the scan as pushed filters."""
    def new_year(y: int) -> Column:
        return F.lit(f"{y:04d}-01-01 00:00:00").cast("timestamp_ntz")

    if start_year is not None:
        stays = stays.where(F.col("admittime") >= new_year(start_year))
    if end_year is not None:
        stays = stays.where(F.col("admittime") < new_year(end_year + 1))
    return stays


def eligible_stays(stays: DataFrame, min_age: int = 18, start_year: int | None = None,
                   end_year: int | None = None) -> DataFrame:
    """Inclusive admission-year window and minimum age."""
    return in_years(stays, start_year, end_year).where(F.col("age_at_admit") >= min_age)


def index_stays(admissions: DataFrame, patients: DataFrame, min_age: int = 18,
                start_year: int | None = None, end_year: int | None = None) -> DataFrame:
    """One index stay per subject: the earliest eligible stay, lowest stay id on ties."""
    stays = in_years(valid_stays(admissions), start_year, end_year)
    stays = eligible_stays(stays_with_age(stays, patients), min_age)
    first = first_rows(stays, ["subject_id"], ["admittime", "hadm_id"])
    died = F.col("deathtime").isNotNull() if "deathtime" in first.columns else F.lit(False)
    out = [F.col("subject_id"), F.col("hadm_id"), F.col("hadm_id").alias("index_hadm_id")]
    if "gender" in first.columns:
        out += [F.col("gender"), F.col("gender").alias("sex")]
    out += [F.col("age_at_admit"), F.col("age_at_admit").alias("age")]
    if "ethnicity" in first.columns:
        out.append(F.col("ethnicity"))
    return first.select(
        *out,
        F.col("admittime").alias("index_time"),
        C.iso_date("admittime").alias("index_date"),
        F.year("admittime").alias("index_year"),
        F.col("dischtime").alias("discharge_time"),
        F.col("los_hours"),
        died.alias("in_hosp_mortality"),
        F.col("admittime").alias("feature_time_upper_bound"),
        F.col("admittime").alias("label_time_zero"),
    )


#: Row and stay numbers are whole, not negative and below this, so a time since year 1 and one of them make one number.
_ROWS = 10**19


def time_order(df: DataFrame, time: str, row_id: str) -> Column:
    """Time, then row number, in one number of fixed width, so that the latest row is found while hashing; a pair where
    the row id isn't a whole number."""
    if not isinstance(df.schema[row_id].dataType, T.IntegralType):
        return F.struct(F.col(time), F.col(row_id))
    at = F.timestamp_diff("MICROSECOND", F.lit("0001-01-01 00:00:00").cast(df.schema[time].dataType), F.col(time))
    return (at.cast("decimal(19,0)") * F.lit(Decimal(_ROWS)).cast("decimal(20,0)") + F.col(row_id).cast("decimal(19,0)")).cast("decimal(38,0)")


# --- labels ---------------------------------------------------------------------------


def dated_diagnoses(diagnoses: DataFrame, admissions: DataFrame, books: dict[str, Codebook],
                    normalise: bool = True, only_coded: bool = True,
                    match_subject: bool = False) -> DataFrame:
    """Diagnoses with one flag per condition and the admission time of their stay.

    Codes are matched before the join, so only rows of a listed condition are shuffled.
    """
    require(diagnoses, ["subject_id", "hadm_id", "icd_code", "icd_version"], "diagnoses")
    flagged = diagnoses.select(
        "subject_id", "hadm_id",
        *[in_codebook("icd_code", "icd_version", b, normalise).alias(f"is_{n}") for n, b in books.items()],
    )
    if only_coded:
        hit = F.lit(False)
        for n in books:
            hit = hit | F.col(f"is_{n}")
        flagged = flagged.where(hit)
    stays = admissions.where(F.col("admittime").isNotNull() & F.col("hadm_id").isNotNull())
    if match_subject:
        stays = stays.select("hadm_id", F.col("subject_id").alias("__owner"), F.col("admittime").alias("dx_time"))
        joined = lookup_join(flagged, stays, "hadm_id")
        return joined.where(F.col("__owner") == F.col("subject_id")).drop("__owner")
    return lookup_join(flagged, stays.select("hadm_id", F.col("admittime").alias("dx_time")), "hadm_id")


def earliest_events(dated: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """First (time, stay) per subject and condition, all conditions in one pass.

    Whole stay numbers are packed behind the time, and the smallest number taken apart again, so the pass only hashes.
    """
    kind = dated.schema["dx_time"].dataType
    packed = isinstance(dated.schema["hadm_id"].dataType, T.IntegralType)
    when = time_order(dated, "dx_time", "hadm_id") if packed else F.struct(F.col("dx_time").alias("t"), F.col("hadm_id").alias("h"))
    first = dated.groupBy("subject_id").agg(
        *[F.min(F.when(F.col(f"is_{n}"), when)).alias(n) for n in conditions])
    out = [F.col("subject_id")]
    for n in conditions:
        if packed:
            at = F.expr(f"timestampadd(MICROSECOND, floor(`{n}` div {_ROWS}BD), timestamp_ntz'0001-01-01')").cast(kind)
            stay = F.expr(f"pmod(`{n}`, {_ROWS}BD)").cast(dated.schema["hadm_id"].dataType)
        else:
            at, stay = F.col(n)["t"], F.col(n)["h"]
        out += [at.alias(f"{n}_first_event_time"), stay.alias(f"{n}_first_event_hadm_id")]
    return first.select(*out)


def horizon_flags(name: str, horizons: Sequence[int], count_index_stay: bool = True) -> list[Column]:
    """Prevalent flag and one incident flag per horizon, never null."""
    t, at = F.col(f"{name}_first_event_time"), F.col("index_time")
    after = t > at
    if count_index_stay:
        after = after | ((t == at) & (F.col(f"{name}_first_event_hadm_id") == F.col("hadm_id")))
    no = F.lit(False)
    flags = [F.coalesce(t < at, no).alias(f"{name}_prevalent_at_index")]
    for h in sorted({int(h) for h in horizons if int(h) > 0}):
        flags.append(F.coalesce(after & (t <= C.plus_days(at, h)), no).alias(f"{name}_incident_{h}d"))
    return flags


def incident_labels(cohort: DataFrame, diagnoses: DataFrame, admissions: DataFrame,
                    books: dict[str, Codebook] | None = None, horizons: Sequence[int] = (30, 90, 365),
                    count_index_stay: bool = True) -> DataFrame:
    """Prevalent and incident labels for several conditions and horizons, every cohort row kept."""
    books = books or FULL_CODEBOOKS
    if not [h for h in horizons if int(h) > 0]:
        raise ValueError("at least one positive horizon is needed")
    first = earliest_events(dated_diagnoses(diagnoses, admissions, books), list(books))
    joined = cohort.select("subject_id", "hadm_id", "index_time").join(first, "subject_id", "left")
    flags = [f for n in books for f in horizon_flags(n, horizons, count_index_stay)]
    return joined.select("*", *flags)


def window_labels(cohort: DataFrame, diagnoses: DataFrame, admissions: DataFrame,
                  horizon_days: int = 365, books: dict[str, Codebook] | None = None) -> DataFrame:
    """Any listed code from index time to the horizon, both ends included; prior disease not excluded."""
    books = books or NARROW_CODEBOOKS
    dated = dated_diagnoses(diagnoses, admissions, books, normalise=False, match_subject=True)
    base = cohort.select("subject_id", "index_time")
    inside = lookup_join(dated, base, "subject_id").where(
        (F.col("dx_time") >= F.col("index_time"))
        & (F.col("dx_time") <= C.plus_days("index_time", horizon_days)))
    found = inside.groupBy("subject_id").agg(
        *[F.max(F.col(f"is_{n}").cast("int")).alias(f"{n}_incident_{horizon_days}d") for n in books])
    return cohort.select("subject_id").join(found, "subject_id", "left").na.fill(0)


# --- events before the index ----------------------------------------------------------


def events_in_window(events: DataFrame, cohort: DataFrame, time: str, lookback_days: int,
                     keep: Sequence[str] = (), prune: bool = True) -> DataFrame:
    """Events of cohort subjects with index - lookback <= time < upper bound.

    The widest window of the cohort is a scalar subquery on the event time, so files and time
    partitions outside it are not read. Store the cohort first, since it is then read twice.
    """
    base = cohort.select("subject_id", "index_time", "feature_time_upper_bound").dropna()
    data = events.where(F.col("subject_id").isNotNull() & F.col(time).isNotNull())
    if "hadm_id" in events.columns:
        data = data.where(F.col("hadm_id").isNotNull())
    if keep:
        data = data.select("subject_id", time, *keep)
    if prune:
        low = base.select(F.min(C.minus_days("index_time", lookback_days))).scalar()
        high = base.select(F.max("feature_time_upper_bound")).scalar()
        data = data.where((F.col(time) >= low) & (F.col(time) < high))
    return lookup_join(data, base, "subject_id").where(
        (F.col(time) < F.col("feature_time_upper_bound"))
        & (F.col(time) >= C.minus_days("index_time", lookback_days)))


def with_lab_labels(labevents: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """Attach label and unit; the dictionary is made unique on itemid first (lowest label wins)."""
    if dictionary is None:
        return labevents.select("*", F.col("itemid").cast("string").alias("label"),
                                F.lit(None).cast("string").alias("unitname"))
    one = first_rows(dictionary.select("itemid", "label", "unitname"), ["itemid"], ["label", "unitname"])
    return lookup_join(labevents, one, "itemid", "left")


def lab_statistics(window: DataFrame, row_id: str, value: str = "valuenum", time: str = "charttime",
                   keep_null_last: bool = True) -> DataFrame:
    """Per subject and label: min, max, mean, count of values, last value, unit, recency in days.

    `last` is the value of the latest row (null when that row has none), or of the latest non-null
    row when keep_null_last is false. Rows at one time are ordered by `row_id`.
    """
    order = time_order(window, time, row_id)
    last_at = order if keep_null_last else F.when(F.col(value).isNotNull(), order)
    aggs = [
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        F.max_by(F.col(value), last_at).alias("last"), F.count(value).alias("count"),
        C.days_between(F.max(time), F.max("index_time")).alias("recency_days"),
    ]
    if "unitname" in window.columns:
        aggs.append(F.max_by("unitname", F.when(F.col("unitname").isNotNull(), order)).alias("unit"))
    return window.where(F.col("label").isNotNull()).groupBy("subject_id", "label").agg(*aggs)


def lab_table(cohort: DataFrame, labevents: DataFrame, dictionary: DataFrame | None, lookback_days: int = 365,
              label_patterns: Sequence[str] = (), row_id: str = "event_id") -> DataFrame:
    """Long lab features: one row per subject and label."""
    require(labevents, ["subject_id", "hadm_id", "charttime", "itemid", "valuenum"], "labevents")
    labs = with_lab_labels(labevents, dictionary)
    if label_patterns:
        labs = labs.where(C.matches_any_pattern("label", label_patterns))
    window = events_in_window(labs, cohort, "charttime", lookback_days,
                              keep=list(dict.fromkeys([row_id, "label", "unitname", "valuenum"])))
    return lab_statistics(window, row_id).withColumn(
        "per_day", F.col("count") / F.lit(float(max(1, lookback_days))))


def pivot_stats(long: DataFrame, labels: Sequence[str], stats: Sequence[str], prefix: str = "lab") -> DataFrame:
    """Wide table with one column per (sanitised label, statistic).

    Labels that share a sanitised name are combined by mean. A subject's rows become one map from name to statistics,
    out of which the listed columns are projected once, so the work per row doesn't depend on how many labels there
    are. The values are listed, so no extra pass looks for them and the width is known.
    """
    names = sorted({C.feature_name_text(v) for v in labels})
    keyed = long.withColumn("__name", C.feature_name("label")).where(F.col("__name").isin(names))
    one = keyed.groupBy("subject_id", "__name").agg(*[F.avg(F.col(s).cast("double")).alias(s) for s in stats])
    maps = one.groupBy("subject_id").agg(
        F.map_from_entries(F.collect_list(F.struct("__name", F.struct(*stats)))).alias("__stats"))
    wide = maps.select("subject_id", *[F.try_element_at("__stats", F.lit(n)).alias(f"__{i}") for i, n in enumerate(names)])
    # Subjects whose labels are all unlisted stay, without values.
    subjects = long.select("subject_id").distinct()
    return subjects.join(wide, "subject_id", "left").select(
        "subject_id", *[F.col(f"__{i}")[s].alias(f"{prefix}_{n}_{s}") for i, n in enumerate(names) for s in stats])


def add_missing_flags(wide: DataFrame, suffix: str = "_last") -> DataFrame:
    """`<x>_missing` = 1 where `<x>_last` is null."""
    cols = [c for c in wide.columns if c.endswith(suffix)]
    return wide.select("*", *[
        F.col(c).isNull().cast("int").alias(c[: -len(suffix)] + "_missing") for c in cols])


def medication_table(cohort: DataFrame, prescriptions: DataFrame, lookback_days: int = 365,
                     recent_windows: Sequence[int] = (30, 90),
                     classes: dict[str, str] | None = None) -> DataFrame:
    """Per subject: counts, any flags, recent flags, recency and density in one aggregate."""
    require(prescriptions, ["subject_id", "hadm_id", "drug", "starttime"], "prescriptions")
    classes = classes or DRUG_CLASSES
    window = events_in_window(prescriptions, cohort, "starttime", lookback_days, keep=["drug"])
    text = F.lower(F.col("drug"))
    rows = window.select("subject_id", "starttime", "index_time", *[
        F.coalesce(text.rlike(p), F.lit(False)).alias(f"is_{n}") for n, p in classes.items()])
    aggs = [F.count(F.lit(1)).cast("int").alias("med_any_count"),
            C.days_between(F.max("starttime"), F.max("index_time")).alias("med_recency_days")]
    for n in classes:
        hit = F.col(f"is_{n}")
        aggs += [F.count_if(hit).cast("int").alias(f"med_{n}_count"),
                 F.max(hit.cast("int")).alias(f"med_{n}_any")]
        aggs += [F.max((hit & (F.col("starttime") >= C.minus_days("index_time", w))).cast("int"))
                 .alias(f"med_{n}_recent_{w}d") for w in recent_windows]
    return rows.groupBy("subject_id").agg(*aggs).withColumn(
        "med_any_per_day", F.col("med_any_count") / F.lit(float(max(1, lookback_days))))


def vital_long(cohort: DataFrame, chartevents: DataFrame, lookback_days: int = 365,
               signs: dict[str, str] | None = None, row_id: str = "event_id") -> DataFrame:
    """Per subject and vital sign: min, max, mean, last non-null value, recency in days."""
    signs = signs or VITAL_SIGNS
    if "label" not in chartevents.columns:
        chartevents = chartevents.withColumn("label", F.col("itemid").cast("string"))
    window = events_in_window(chartevents, cohort, "charttime", lookback_days,
                              keep=list(dict.fromkeys([row_id, "label", "valuenum"])))
    text = F.lower(F.col("label"))
    named = F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in signs.items()]),
                     lambda v: v.isNotNull())
    rows = window.withColumn("label", F.explode(named))
    return lab_statistics(rows, row_id, keep_null_last=False).withColumnRenamed("label", "vital")


def vital_table(cohort: DataFrame, chartevents: DataFrame, lookback_days: int = 365,
                signs: dict[str, str] | None = None, row_id: str = "event_id",
                winsor: tuple[float, float] | None = None) -> DataFrame:
    """Wide vital features for every cohort subject, with missing flags; statistics are winsorised if limits are given."""
    signs = signs or VITAL_SIGNS
    long = vital_long(cohort, chartevents, lookback_days, signs, row_id).withColumnRenamed("vital", "label")
    wide = pivot_stats(long, list(signs), ["min", "max", "mean", "last", "recency_days"], "vital")
    if winsor:
        wide = winsorise_columns(wide, continuous_columns(wide), *winsor)
    return add_missing_flags(cohort.select("subject_id").join(wide, "subject_id", "left"))


# --- winsorising ----------------------------------------------------------------------


def winsor_limits(long: DataFrame, keys: Sequence[str], value: str, low: float = 0.005,
                  high: float = 0.995) -> DataFrame:
    """Exact lower and upper quantile per key; fit this on the rows allowed to inform it."""
    q = quantiles(long, keys, value, [low, high])
    return q.select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def winsorise(long: DataFrame, limits: DataFrame, key: str, value: str) -> DataFrame:
    """Clip to the fitted limits; keys without limits are left as they are."""
    joined = lookup_join(long, limits, key, "left")
    clipped = F.when(F.col("lo").isNull(), F.col(value)).otherwise(C.clamp(value, F.col("lo"), F.col("hi")))
    return joined.withColumn(value, clipped).drop("lo", "hi")


def continuous_columns(wide: DataFrame) -> list[str]:
    """The statistics that are winsorised: min, max, mean and last."""
    return [c for c in wide.columns if c.endswith(("_min", "_max", "_mean", "_last"))]


def winsorise_columns(wide: DataFrame, columns: Sequence[str], low: float = 0.005, high: float = 0.995,
                      fit_on: DataFrame | None = None) -> DataFrame:
    """Clip columns to their own quantiles, found for all of them in one pass over fit_on (the table itself if None).

    The limits stay in the plan as one row; columns without a value are left as they are.
    """
    columns = list(columns)
    if not columns:
        return wide
    rows = (wide if fit_on is None else fit_on).select(*[F.col(c).cast("double") for c in columns])
    limits = winsor_limits(rows.unpivot([], columns, "feature", "value"), ["feature"], "value", low, high)
    row = limits.agg(*[F.max(F.when(F.col("feature") == c, F.struct("lo", "hi"))).alias(f"__{i}") for i, c in enumerate(columns)])
    out = with_row(wide, row)
    clipped = {c: F.when(F.col(f"__{i}").isNull(), F.col(c)).otherwise(C.clamp(c, F.col(f"__{i}")["lo"], F.col(f"__{i}")["hi"]))
               for i, c in enumerate(columns)}
    return out.withColumns(clipped).select(*wide.columns)


# --- feature tables -------------------------------------------------------------------


def gender_indicators(cohort: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column per gender value (upper-cased), in the order given.

    Without a list, the values that occur, sorted; they are fetched, as each becomes a column of the result.
    """
    text = F.upper(F.trim(F.col("gender").cast("string")))
    if values is None:
        seen = cohort.select(text.alias("g")).where("g is not null").distinct().collect()
        values = sorted(r["g"] for r in seen)
    return cohort.select("subject_id", *[
        C.indicator(text, v).alias(f"gender_{C.feature_name_text(v)}") for v in values])


def event_features(cohort: DataFrame, labs: DataFrame | None = None, lab_labels: Sequence[str] = (),
                   meds: DataFrame | None = None, vitals: DataFrame | None = None,
                   genders: Sequence[str] | None = None, winsor: tuple[float, float] | None = None) -> DataFrame:
    """Wide feature table: demographics, labs (from the long table), medication, vitals.

    Lab statistics are winsorised if limits are given, over the subjects with labs. Missing flags are set on subjects
    with labs, then nulls of flag and count columns become 0.
    """
    base = cohort.select("subject_id", "age_at_admit")
    if "gender" in cohort.columns:
        base = base.join(gender_indicators(cohort, genders), "subject_id", "left")
    parts = []
    if labs is not None:
        stats = [*LAB_STATS, "recency_days", "per_day"]
        wide = pivot_stats(labs, lab_labels, stats)
        parts.append(add_missing_flags(winsorise_columns(wide, continuous_columns(wide), *winsor) if winsor else wide))
    parts += [p for p in (meds, vitals) if p is not None]
    for p in parts:
        base = base.join(p, "subject_id", "left")
    return C.fill_absent(base, ZERO_FILL_ENDINGS, ["gender_"])


def prior_stays(cohort: DataFrame, admissions: DataFrame, days: int = 365) -> DataFrame:
    """Stays with index - days <= admission < index, counted per subject."""
    rows = lookup_join(admissions.select("subject_id", "admittime"),
                       cohort.select("subject_id", "index_time"), "subject_id")
    return rows.where((F.col("admittime") < F.col("index_time"))
                      & (F.col("admittime") >= C.minus_days("index_time", days))) \
        .groupBy("subject_id").agg(F.count(F.lit(1)).alias(f"prev_adm_{days}d"))


def prior_history(cohort: DataFrame, diagnoses: DataFrame, admissions: DataFrame,
                  books: dict[str, Codebook] | None = None) -> DataFrame:
    """1 per condition with a listed code before the index, 0 for listed subjects without it."""
    books = books or NARROW_CODEBOOKS
    dated = dated_diagnoses(diagnoses, admissions, books, normalise=False, match_subject=True)
    rows = lookup_join(dated, cohort.select("subject_id", "index_time"), "subject_id") \
        .where(F.col("dx_time") < F.col("index_time"))
    return rows.groupBy("subject_id").agg(
        *[F.max(F.col(f"is_{n}").cast("int")).alias(f"prior_{n}") for n in books])


def compact_features(cohort: DataFrame, admissions: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Age, sex, ethnicity indicators, prior stays, index length of stay, prior history."""
    eth = C.ethnicity_group("ethnicity")
    base = cohort.select(
        "subject_id", "index_hadm_id", F.col("age"),
        C.indicator(F.upper("sex"), "F").alias("sex_female"),
        *[C.indicator(eth, g).alias(f"eth_{g}") for g in C.ETHNICITY_LEVELS])
    los = admissions.select(F.col("hadm_id").alias("index_hadm_id"),
                            F.col("subject_id").alias("__owner"),
                            C.days_between("admittime", "dischtime").alias("los_days_index"))
    base = (base.join(los, (base["index_hadm_id"] == los["index_hadm_id"])
                      & (base["subject_id"] == los["__owner"]), "left")
            .drop(los["index_hadm_id"]).drop("__owner", "index_hadm_id"))
    base = base.join(prior_stays(cohort, admissions), "subject_id", "left")
    base = base.join(prior_history(cohort, diagnoses, admissions), "subject_id", "left")
    return base.na.fill(0, subset=["prev_adm_365d", "prior_diab", "prior_cvd"]) \
        .na.fill(0.0, subset=["los_days_index"])


def feature_catalogue(spark, lab_units: DataFrame | None, drug_classes: Sequence[str], vitals: Sequence[str],
                      lookback_days: int, recent_windows: Sequence[int]) -> DataFrame:
    """Name, type, source, unit, lookback, aggregate and guard of every feature column.

    `lab_units` has (label, unit), one row per lab label; its rows stay distributed.
    """
    guard = LEAKAGE_GUARD
    schema = ("name string, dtype string, source string, description string, units string, "
              "lookback_days int, agg string, leakage_guard string")
    rows = [("age_at_admit", "float64", "cohort", "Age in years when the index stay began", None, None, None, guard)]
    src = "prescriptions"
    rows += [("med_any_count", "int32", src, "Any prescriptions", None, lookback_days, "count", guard),
             ("med_recency_days", "float64", src, "Days since last prescription", "days", lookback_days,
              "recency_days", guard),
             ("med_any_per_day", "float64", src, "Prescriptions per day", "count/day", lookback_days,
              "count_per_day", guard)]
    for n in drug_classes:
        rows += [(f"med_{n}_count", "int32", src, f"Count of {n}", None, lookback_days, "count", guard),
                 (f"med_{n}_any", "int8", src, f"Any {n}", None, lookback_days, "any", guard)]
        rows += [(f"med_{n}_recent_{w}d", "int8", src, f"Any {n} within {w} days", None, w, "recent_any", guard)
                 for w in recent_windows]
    for n in vitals:
        rows += [(f"vital_{n}_{s}", "float64", "chartevents", f"{n} {s}", None, lookback_days, s, guard)
                 for s in ("min", "max", "mean", "last")]
        rows += [(f"vital_{n}_recency_days", "float64", "chartevents", f"Days since last {n}", "days",
                  lookback_days, "recency_days", guard),
                 (f"vital_{n}_missing", "int8", "chartevents", f"No {n} in window", None, lookback_days,
                  "missing_flag", guard)]
    out = spark.createDataFrame(rows, schema)
    if lab_units is None:
        return out
    stats = [("min", "float64", True), ("max", "float64", True), ("mean", "float64", True),
             ("last", "float64", True), ("count", "float64", False), ("recency_days", "float64", False),
             ("per_day", "float64", False), ("missing", "int8", False)]
    unit_of = {"recency_days": "days", "per_day": "count/day"}
    agg_of = {"per_day": "count_per_day", "missing": "missing_flag"}
    per_stat = F.array(*[F.struct(F.lit(s).alias("stat"), F.lit(t).alias("dtype"), F.lit(u).alias("own"),
                                  F.lit(unit_of.get(s)).cast("string").alias("fixed"),
                                  F.lit(agg_of.get(s, s)).alias("agg")) for s, t, u in stats])
    labs = lab_units.select("label", "unit", F.explode(per_stat).alias("s")).select(
        F.concat(F.lit("lab_"), C.feature_name("label"), F.lit("_"), F.col("s.stat")).alias("name"),
        F.col("s.dtype").alias("dtype"), F.lit("labevents").alias("source"),
        F.concat(F.col("label"), F.lit(" "), F.col("s.stat")).alias("description"),
        F.when(F.col("s.own"), F.col("unit")).otherwise(F.col("s.fixed")).alias("units"),
        F.lit(lookback_days).cast(T.IntegerType()).alias("lookback_days"),
        F.col("s.agg").alias("agg"), F.lit(guard).alias("leakage_guard"))
    return out.unionByName(labs)
