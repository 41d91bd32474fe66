"""Ticks to bars, bars to days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tickloom import constants as C
from tickloom.functions.stats import order_key


def first_seen(value: str, ts: str = "ts"):
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(ts)))


def last_seen(value: str, ts: str = "ts"):
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(ts)))


def build_bars(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """Ticks (symbol, ts, seq, price) to OHLC bars; volume counts ticks."""
    order = order_key(F.col("ts"), F.col("seq"))
    bars = (ticks.groupBy("symbol", F.date_trunc(unit, F.col("ts")).alias("bar_ts"))
            .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", order).alias("close"),
                 F.count(F.lit(1)).cast("double").alias("volume")))
    return (bars.withColumnRenamed("bar_ts", "ts").withColumn("date", F.to_date("ts")))


def with_ordinal(bars: DataFrame) -> DataFrame:
    """Adds `bar`, the 0-based position of a bar in its symbol-day."""
    w = W.partitionBy("symbol", "date").orderBy("ts")
    return bars.withColumn("bar", F.row_number().over(w) - 1)


def read_bars_subset(bars: DataFrame, symbols: list[str] | DataFrame | None = None,
                     index: str = "^NSEI") -> DataFrame:
    """Bars of an allow-list (the index always stays), small-platform listings removed, ordinal added."""
    for suffix in C.SMALL_PLATFORM_SUFFIXES:
        bars = bars.filter(~F.col("symbol").endswith(suffix))
    if isinstance(symbols, DataFrame):
        keep = symbols.select("symbol").union(symbols.sparkSession.createDataFrame([(index,)], "symbol string"))
        bars = bars.join(keep.distinct(), "symbol", "left_semi")
    elif symbols:
        bars = bars.filter(F.col("symbol").isin([*symbols, index]))
    return with_ordinal(bars)


def day_bars(bars: DataFrame) -> DataFrame:
    """One OHLC row per symbol-day."""
    return bars.groupBy("symbol", "date").agg(
        first_seen("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        last_seen("close").alias("close"), F.count(F.lit(1)).alias("n"))


def first_period(bars: DataFrame, until: str = C.FIRST_PERIOD_END) -> DataFrame:
    """Last close, high, low and volume of the bars that start before `until`."""
    early = bars.filter(F.date_format("ts", "HH:mm") < until)
    return early.groupBy("symbol", "date").agg(
        last_seen("close").alias("fh_close"), F.max("high").alias("fh_high"), F.min("low").alias("fh_low"),
        F.sum("volume").alias("fh_vol"))


def days_with_first_period(bars: DataFrame, until: str = C.FIRST_PERIOD_END) -> DataFrame:
    """`day_bars` and `first_period` in one aggregation; days without an early bar are dropped."""
    early = F.date_format("ts", "HH:mm") < until

    def when_early(c):
        return F.when(early, F.col(c))

    return (bars.groupBy("symbol", "date").agg(
        first_seen("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        last_seen("close").alias("close"), F.count(F.lit(1)).alias("n"),
        F.max_by("close", F.when(early & F.col("close").isNotNull(), F.col("ts"))).alias("fh_close"),
        F.max(when_early("high")).alias("fh_high"), F.min(when_early("low")).alias("fh_low"),
        F.sum(when_early("volume")).alias("fh_vol"), F.count_if(early).alias("_early"))
        .filter(F.col("_early") > 0).drop("_early"))


def day_turnover(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "date").agg(F.sum(F.col("close") * F.col("volume")).alias("turnover"))


def export_universe(table: DataFrame) -> DataFrame:
    """Sorted distinct symbols, indices left out."""
    return table.filter(~F.col("symbol").startswith("^")).select("symbol").distinct().orderBy("symbol")


def daily_closes(wide: DataFrame, day: str = "date") -> DataFrame:
    """A wide close table (one column per symbol) as long rows (symbol, date, close)."""
    symbols = [c for c in wide.columns if c != day]
    return (wide.unpivot([day], symbols, "symbol", "close").filter(F.col("close").isNotNull())
            .select("symbol", F.col(day).alias("date"), "close"))


def quotes_to_long(wide: DataFrame, symbols: list[str], ts: str = "ts",
                   fields: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Columns named `SYMBOL|field` to one row per symbol and time; absent symbols and null closes skipped."""
    have = set(wide.columns)
    blocks = [F.struct(F.lit(s).alias("symbol"),
                       *[(F.col(f"`{s}|{f}`") if f"{s}|{f}" in have else F.lit(None)).cast("double").alias(f)
                         for f in fields])
              for s in symbols if f"{s}|close" in have]
    if not blocks:
        return wide.sparkSession.createDataFrame(
            [], f"{ts} timestamp, symbol string, " + ", ".join(f"{f} double" for f in fields))
    return wide.select(ts, F.inline(F.array(*blocks))).filter(F.col("close").isNotNull())
