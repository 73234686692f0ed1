"""Scalar column expressions: casts, times, categories, probabilities, keyed randomness."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_HOUR = 3.6e9
MICROS_PER_DAY = 8.64e10
DAYS_PER_YEAR = 365.2425

PROB_EPS = 1e-6
METRIC_EPS = 1e-12


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- boundary casts -------------------------------------------------------------------


def blank_to_null(c, tokens: Sequence[str]) -> Column:
    c = col(c)
    return F.when(F.trim(c).isin(list(tokens)), None).otherwise(c)


def to_id(c) -> Column:
    """Whole-number identifier; '12' and '12.0' parse, everything else is null."""
    text = F.trim(col(c).cast("string"))
    as_double = text.try_cast("double")
    whole = F.when(as_double == F.floor(as_double), as_double.try_cast("bigint"))
    return F.coalesce(text.try_cast("bigint"), whole)


def to_time(c) -> Column:
    """Timestamp without zone; anything unreadable is null."""
    return col(c).try_cast("timestamp_ntz")


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def finite_or_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


# --- time -----------------------------------------------------------------------------


def micros_between(start, end) -> Column:
    """Microseconds from start to end, for times without zone.

    The built-in difference function converts through the session's time zone, so a clock change
    inside the span would count. Interval arithmetic does not.
    """
    span = col(end) - col(start)

    def part(unit: str) -> Column:
        return F.extract(F.lit(unit), span)

    whole = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return whole * F.lit(60_000_000) + (part("SECOND") * F.lit(1_000_000)).cast("bigint")


def hours_between(start, end) -> Column:
    return micros_between(start, end) / F.lit(MICROS_PER_HOUR)


def days_between(start, end) -> Column:
    return micros_between(start, end) / F.lit(MICROS_PER_DAY)


def plus_days(c, days: int) -> Column:
    return col(c) + F.make_dt_interval(F.lit(int(days)))


def minus_days(c, days: int) -> Column:
    return col(c) - F.make_dt_interval(F.lit(int(days)))


def iso_date(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def month_label(c) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def quarter_label(c) -> Column:
    c = col(c)
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def year_label(c) -> Column:
    return F.year(col(c)).cast("string")


def clamp(c, low, high) -> Column:
    """Limit to [low, high]; null stays null (greatest/least alone would skip it)."""
    c = col(c)
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.greatest(low, F.least(high, c)))


def age_from_anchor(anchor_age, anchor_year, at) -> Column:
    age = col(anchor_age).cast("double") + (F.year(col(at)) - col(anchor_year)).cast("double")
    return clamp(age, 0.0, 120.0)


def age_from_birth(dob, at) -> Column:
    years = F.floor(days_between(dob, at) / F.lit(DAYS_PER_YEAR)).cast("double")
    return clamp(years, 0.0, 120.0)


# --- categories and names -------------------------------------------------------------

# Ordered substring rules for ethnicity groups.
ETHNICITY_RULES = [
    ("white", ["white"]),
    ("black", ["black", "african"]),
    ("asian", ["asian"]),
    ("hispanic", ["hispanic", "latino"]),
]
ETHNICITY_LEVELS = ["white", "black", "asian", "hispanic", "other"]


def ethnicity_group(c) -> Column:
    text = F.lower(col(c))
    out = None
    for name, words in ETHNICITY_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def indicator(c, value) -> Column:
    """1 where the column equals the value, else 0 (null counts as not equal)."""
    return F.when(col(c) == F.lit(value), 1).otherwise(0)


def feature_name(c) -> Column:
    return F.lower(F.btrim(F.regexp_replace(F.trim(col(c)), "[^A-Za-z0-9]+", "_"), F.lit("_")))


def feature_name_text(text: str) -> str:
    kept = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in str(text))
    return "_".join(kept.split()).lower()


def matches_any_pattern(c, patterns: Sequence[str]) -> Column:
    """Case-insensitive search for any pattern; null matches none."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return F.coalesce(col(c).rlike(f"(?i)(?:{joined})"), F.lit(False))


def group_label(c, is_sex: bool = False) -> Column:
    """Text label of an audit group; absent values become MISSING."""
    text = col(c).cast("string")
    if is_sex:
        up = F.upper(F.trim(text))
        text = F.when(up == "FEMALE", "F").when(up == "MALE", "M").otherwise(up)
    absent = text.isNull() | text.isin("nan", "NaT", "None", "")
    return F.when(absent, "MISSING").otherwise(text)


# --- labels and probabilities ---------------------------------------------------------


def binary_label(c) -> Column:
    return col(c).cast("boolean").cast("int")


def clip_probability(p, eps: float = PROB_EPS) -> Column:
    return clamp(p, eps, 1.0 - eps)


def logit(p, eps: float = PROB_EPS) -> Column:
    p = clip_probability(p, eps)
    return F.ln(p / (F.lit(1.0) - p))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient of counts with the denominator floored at one."""
    return top / F.greatest(F.lit(1), bottom)


# Rational approximation of the inverse normal distribution (P. J. Acklam).
_INV_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
          1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_INV_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
          6.680131188771972e01, -1.328068155288572e01, 1.0]
_INV_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
          -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_INV_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
          3.754408661907416e00, 1.0]
_INV_TAIL = 0.02425


def inverse_normal_sql(p: str) -> str:
    """Standard normal quantile of `p` in (0,1) as SQL text, relative error about 1e-9.

    Text reaches the JVM in one call, where a column tree of this size takes hundreds.
    """
    def poly(coefs: Iterable[float], x: str) -> str:
        out = ""
        for k in coefs:
            out = f"({out} * {x} + {k!r}D)" if out else f"({k!r}D)"
        return out

    q = f"({p} - 0.5D)"
    r = f"({q} * {q})"
    low, high = f"sqrt(-2D * ln({p}))", f"sqrt(-2D * ln(1D - {p}))"
    return (f"case when {p} < {_INV_TAIL!r}D then {poly(_INV_C, low)} / {poly(_INV_D, low)} "
            f"when {p} > 1D - {_INV_TAIL!r}D then -{poly(_INV_C, high)} / {poly(_INV_D, high)} "
            f"else {q} * {poly(_INV_A, r)} / {poly(_INV_B, r)} end")


def inverse_normal_values(p: np.ndarray) -> np.ndarray:
    """The same for numbers in (0,1) in an array."""
    low, high = np.sqrt(-2.0 * np.log(np.minimum(p, 0.5))), np.sqrt(-2.0 * np.log(np.minimum(1.0 - p, 0.5)))
    q = p - 0.5
    r = q * q
    inner = q * np.polyval(_INV_A, r) / np.polyval(_INV_B, r)
    tail = [np.polyval(_INV_C, t) / np.polyval(_INV_D, t) for t in (low, high)]
    return np.where(p < _INV_TAIL, tail[0], np.where(p > 1.0 - _INV_TAIL, -tail[1], inner))


def inverse_normal(p: str) -> Column:
    return F.expr(inverse_normal_sql(f"`{p}`"))


# --- keyed randomness: depends only on (seed, key), never on partitioning ----------------


def keyed_hash(*parts) -> Column:
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *texts).cast("binary"))


def hash_word(digest: Column, index: int = 0) -> Column:
    """One of the four 32-bit words of an md5 digest."""
    return F.conv(F.substring(digest, 1 + 8 * index, 8), 16, 10).cast("bigint")


def uniform(digest: Column, index: int = 0) -> Column:
    """Uniform in [0,1) with 32 bits."""
    return hash_word(digest, index).cast("double") / F.lit(4294967296.0)


def standard_normal(digest: Column) -> Column:
    """Box-Muller from two words of one digest."""
    u1 = (hash_word(digest, 0).cast("double") + F.lit(1.0)) / F.lit(4294967296.0)
    u2 = uniform(digest, 1)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def poisson_one(u: Column, top: int = 12) -> Column:
    """Poisson(1) draw by inversion of a uniform with 32 bits (mass above `top` is below 2**-32)."""
    steps, mass, below = [], 0.36787944117144233, 0.0
    for k in range(top):
        below += mass
        steps.append(F.when(u >= F.lit(below), 1).otherwise(0))
        mass /= k + 1
    out = steps[0]
    for s in steps[1:]:
        out = out + s
    return out


# --- whole-frame column helpers -------------------------------------------------------


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ("subject_id", "fold")) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def align_columns(df: DataFrame, wanted: Sequence[str], ids: Sequence[str] = ("subject_id",),
                  strict: bool = False) -> DataFrame:
    """Columns in stored order; absent ones become 0.0, or an error when strict."""
    absent = [c for c in wanted if c not in df.columns]
    if strict and absent:
        raise KeyError(f"missing feature columns: {absent[:10]}")
    out = [F.col(c) for c in ids]
    for c in wanted:
        value = F.lit(0.0) if c in absent else F.col(c).cast("double")
        out.append((value if strict else F.coalesce(value, F.lit(0.0))).alias(c))
    return df.select(*out)


def store_float32(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def fill_absent(df: DataFrame, endings: Sequence[str], starts: Sequence[str]) -> DataFrame:
    """Zero for count and flag columns that are null; infinities become null elsewhere."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name != "subject_id" and (f.name.endswith(tuple(endings)) or f.name.startswith(tuple(starts))):
            c = F.coalesce(c.cast("int"), F.lit(0))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = finite_or_null(c)
        out.append(c.alias(f.name))
    return df.select(*out)
