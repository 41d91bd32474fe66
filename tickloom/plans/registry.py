"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Charges and prices are decimals at heart, so many sit exactly on a rounding tie that a double holds a
# hair above or below. Nudging by one part in 10^12 rounds them the same way in every engine.
NUDGE = "1.000000000001"


def tidy(value: Column, places: int) -> Column:
    """Rounded half up by plain arithmetic (cheaper than decimal rounding), negative zero folded into zero."""
    scale = float(10 ** places)
    return F.floor(value.cast("double") * (float(NUDGE) * scale) + 0.5) / scale


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers `fn(spark, sf_dir)` under `name`, with the SQL that must give the same rows."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")   # the tables' stamps are naive UTC
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def report(df: DataFrame, *columns: str, places: int = 6, **exact: int) -> DataFrame:
    """The chosen columns as plain values: doubles rounded, dates and times as text, counts as bigint."""
    kinds = dict(df.dtypes)

    def plain(c: str):
        kind = kinds[c]
        if kind in ("double", "float") or kind.startswith("decimal"):
            return tidy(F.col(c), exact.get(c, places)).alias(c)
        if kind == "date":
            return F.col(c).cast("string").alias(c)
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
        if kind in ("int", "smallint", "tinyint"):
            return F.col(c).cast("bigint").alias(c)
        return F.col(c)

    return df.select(*[plain(c) for c in (columns or df.columns)])


def r(expr: str, name: str | None = None, places: int = 6) -> str:
    """SQL for a rounded column, negative zero folded into zero."""
    scale = float(10 ** places)
    return f"floor(CAST({expr} AS DOUBLE) * {float(NUDGE) * scale!r}e0 + 5e-1) / {scale!r}e0 AS {name or expr}"


def rs(names: str, places: int = 6) -> str:
    return ", ".join(r(n, places=places) for n in names.split())
