"""Column access shared by the corpus operators.

Tables may carry any extra columns, also such as differ from ours only by case or repeat a name, so
columns are found by position and renamed before anything is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and what is stripped from lines.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null id where ids are ordered or compared.
NO_ID = -(2**63)


def position(df: DataFrame, name: str) -> int:
    """Index of a column: the exact name first, else the first that differs only by case."""
    names = df.columns
    if name in names:
        return names.index(name)
    lower = [n.lower() for n in names]
    if name.lower() not in lower:
        raise ValueError(f"no column {name} among {names}")
    return lower.index(name.lower())


def numbered(df: DataFrame) -> DataFrame:
    """The same columns named c0, c1, ... by position."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, under exactly these names."""
    flat = numbered(df)
    return flat.select(*[F.col(f"c{position(df, n)}").alias(n) for n in names])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a nullable text: rows with equal texts have equal keys."""
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def fold(doc_id: Column) -> Column:
    """Fold 0 to 4 of a document: crc32 of its id as text; fold 0 is held out, and so is a null id."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5).cast("int")
