"""Small numeric helpers shared by the feature tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def change(now: Column, base: Column) -> Column:
    """now / base - 1; null when the base is zero."""
    return F.try_divide(now, base) - 1


def order_key(ts: Column, seq: Column) -> Column:
    """Time, then sequence number, as one decimal: unlike a struct it lets min_by and max_by hash-aggregate."""
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(17,0)")
    return micros * F.lit("1" + "0" * 19).cast("decimal(20,0)") + seq.cast("decimal(19,0)")


def trailing(fn: Callable[[Column], Column], value: Column, w: WindowSpec, rows: int, at_least: int) -> Column:
    """`fn` over the `rows` rows before this one, null until `at_least` of them are non-null."""
    span = w.rowsBetween(-rows, -1)
    return F.when(F.count(value).over(span) >= at_least, fn(value).over(span))


def scrub_inf(df: DataFrame) -> DataFrame:
    """Infinite and NaN doubles become null; other columns pass through."""
    inf = F.lit(float("inf"))
    return df.select(*[
        F.when(F.isnan(c) | (F.abs(c) == inf), None).otherwise(F.col(c)).alias(c) if t in ("double", "float")
        else F.col(c) for c, t in df.dtypes])
