"""Typed catalogue of source tables and their scans."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

# Text that stands for an absent value in source files.
NULL_TOKENS = [
    "", "NA", "NaN", "NULL", "null", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "None", "n/a", "nan",
]


@dataclass(frozen=True)
class TableSpec:
    """Columns of one source table: identifiers, times, and the rest by type."""

    name: str
    ids: tuple[str, ...] = ()
    times: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()

    @property
    def file_name(self) -> str:
        return f"{self.name}.csv"

    @property
    def schema(self) -> T.StructType:
        fields = [T.StructField(c, T.LongType()) for c in self.ids]
        fields += [T.StructField(c, T.TimestampNTZType()) for c in self.times]
        fields += [T.StructField(c, T.DoubleType()) for c in self.numbers]
        fields += [T.StructField(c, T.StringType()) for c in self.texts]
        return T.StructType(fields)


# The twelve source tables, small ones first.
CATALOGUE = {s.name: s for s in [
    TableSpec("patients", ("subject_id",), ("dob",), ("anchor_age", "anchor_year"), ("gender",)),
    TableSpec("d_icd_diagnoses", (), (), ("icd_version",), ("icd_code", "long_title")),
    TableSpec("d_icd_procedures", (), (), ("icd_version",), ("icd_code", "long_title")),
    TableSpec("d_labitems", ("itemid",), (), (), ("label", "unitname")),
    TableSpec("admissions", ("subject_id", "hadm_id"), ("admittime", "dischtime", "deathtime")),
    TableSpec("transfers", ("subject_id", "hadm_id"), ("intime", "outtime")),
    TableSpec("diagnoses_icd", ("subject_id", "hadm_id"), (), ("icd_version",), ("icd_code",)),
    TableSpec("procedures_icd", ("subject_id", "hadm_id"), (), ("icd_version",), ("icd_code",)),
    TableSpec("pharmacy", ("subject_id", "hadm_id"), ("starttime", "stoptime", "verifiedtime")),
    TableSpec("prescriptions", ("subject_id", "hadm_id"), ("starttime", "stoptime"), (), ("drug",)),
    TableSpec("microbiologyevents", ("subject_id", "hadm_id", "specimen_id"),
              ("charttime", "storetime", "chartdate", "ab_charttime", "charttime_utc")),
    TableSpec("labevents", ("subject_id", "hadm_id", "itemid", "specimen_id"), ("charttime", "storetime"),
              ("valuenum",)),
]}

INGEST_ORDER = ["csv", "csv.gz"]
ANALYSIS_ORDER = ["parquet", "csv.gz", "csv"]


def table_spec(name: str) -> TableSpec:
    try:
        return CATALOGUE[name]
    except KeyError:
        raise ValueError(f"unknown table {name!r}; known: {sorted(CATALOGUE)}") from None


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def resolve(spark: SparkSession, root: str, name: str, order: Sequence[str] = ANALYSIS_ORDER) -> str:
    """First existing `<root>/<name>.<ext>` in the given order."""
    for ext in order:
        path = f"{root.rstrip('/')}/{name}.{ext}"
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"no {name} in {root} as {list(order)}")


def typed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Cast the listed columns that are present; bad text becomes null, other columns stay text."""
    out = []
    for c in df.columns:
        raw = C.blank_to_null(c, NULL_TOKENS)
        if c in spec.ids:
            raw = C.to_id(raw)
        elif c in spec.times:
            raw = C.to_time(raw)
        elif c in spec.numbers:
            raw = C.nan_to_null(raw.try_cast("double"))
        out.append(raw.alias(c))
    return df.select(*out)


def scan_csv(spark: SparkSession, path: str, spec: TableSpec, gzip_partitions: int | None = None,
             multi_line: bool = False) -> DataFrame:
    """Header CSV read as text and cast by the catalogue, so one bad value never fails the job.

    Quotes within a quoted field are doubled. Fields that hold line breaks need multi_line, which reads each
    file in one task, as a gzip file is; its rows are spread after the read, over `gzip_partitions` if given.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    df = typed(reader.csv(path), spec)
    if path.endswith(".gz"):
        df = df.repartition(gzip_partitions) if gzip_partitions else df.hint("rebalance")
    return df


def scan_table(spark: SparkSession, root: str, name: str, order: Sequence[str] = ANALYSIS_ORDER,
               columns: Iterable[str] | None = None, nrows: int | None = None, multi_line: bool = False) -> DataFrame:
    """One logical table in whichever format is present, optionally some columns or a row cap; multi_line for CSV files
    whose fields hold line breaks."""
    path = resolve(spark, root, name, order)
    df = spark.read.parquet(path) if path.endswith(".parquet") else scan_csv(spark, path, table_spec(name), multi_line=multi_line)
    if columns is not None:
        df = df.select(*columns)
    return df.limit(nrows) if nrows is not None else df


def ingest_profile(df: DataFrame, name: str, times: Sequence[str] | None = None) -> DataFrame:
    """Rows, exact distinct subjects and stays, and the range of the first time column; one row."""
    def distinct(c: str):
        return F.count_distinct(c) if c in df.columns else F.lit(None).cast("bigint")

    times = times if times is not None else table_spec(name).times
    first = next((c for c in times if c in df.columns), None)
    low = F.min(first) if first else F.lit(None).cast("timestamp_ntz")
    high = F.max(first) if first else F.lit(None).cast("timestamp_ntz")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), distinct("subject_id").alias("unique_subjects"),
        distinct("hadm_id").alias("unique_hadm"), low.alias("date_min"), high.alias("date_max"),
    ).select(F.lit(name).alias("name"), "*")
