"""Registered queries: a Spark callable, the SQL that must agree with it, and what they cover."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bindings import Bindings, sql


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[Bindings], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, oracle: str | None = None):
    """Register a function of the bindings under its own name."""

    def add(fn):
        name = fn.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), fn, sql(oracle) if oracle else None)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and times as text, so two engines can be compared value by value."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = stamp(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def R(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL text: rounded double without a negative zero."""
    return f"(round(cast({expr} as double), {digits}) + 0.0::double) as {name or expr}"


def TS(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') as {name or expr}"


def B(expr: str, name: str | None = None) -> str:
    return f"cast({expr} as bigint) as {name or expr}"
