"""Hypothetical same-day trades: which entries are tradeable, where they exit, what they net."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tickloom import constants as C
from tickloom.functions.stats import change, trailing


def slippage_tier(turnover: Column, tiers=C.SLIPPAGE_TIERS, mode: str = "last_match") -> Column:
    """Slippage for a mean day turnover.

    `last_match` lets every lower threshold overwrite the ones above it, so the top tier never applies;
    `first_match` gives each turnover the tier it reaches.
    """
    *limits, (_, base) = tiers
    if mode == "last_match":
        limits = limits[::-1]
    out = None
    for floor, slip in limits:
        out = (F if out is None else out).when(turnover >= floor, F.lit(slip))
    return F.lit(base) if out is None else out.otherwise(F.lit(base))


def tradeable(entries: DataFrame, min_turnover: float = C.MIN_TURNOVER, min_price: float = C.MIN_PRICE,
              tiers=C.SLIPPAGE_TIERS, mode: str = "last_match") -> DataFrame:
    """Entries liquid enough to trade, with `avg20` (mean turnover of the prior 20 days) and `slippage`."""
    w = W.partitionBy("symbol").orderBy("date")
    days = entries.groupBy("symbol", "date").agg(F.max("turnover_day").alias("turnover_day"))
    days = days.select("symbol", "date", trailing(F.avg, F.col("turnover_day"), w, 20, 10).alias("avg20"))
    return (entries.join(days.filter(F.col("avg20") >= min_turnover), ["symbol", "date"])
            .filter(F.col("close") >= min_price)
            .withColumn("slippage", slippage_tier(F.col("avg20"), tiers, mode)))


def hypothetical_trades(entries: DataFrame, max_hold: int = 5) -> DataFrame:
    """Each entry bar with the close exactly 1..max_hold bars later that day, where that bar exists.

    A range frame of one position looks the exit up, so no self join and no extra shuffle.
    """
    by_bar = W.partitionBy("symbol", "date").orderBy("bar")
    exits = [F.struct(F.lit(h).alias("hold_bars"),
                      F.max("close").over(by_bar.rangeBetween(h, h)).alias("exit_close"))
             for h in range(1, max_hold + 1)]
    return (entries.withColumn("_exits", F.array(*exits))
            .select("*", F.inline("_exits")).drop("_exits")
            .filter(F.col("exit_close").isNotNull()))


def label_trades(trades: DataFrame, charges: float = C.INTRADAY_CHARGES, success: float = C.SUCCESS_NET) -> DataFrame:
    """Adds gross and net return and whether the trade succeeded."""
    slip = F.col("slippage") if "slippage" in trades.columns else F.lit(C.DEFAULT_SLIPPAGE)
    return (trades.withColumn("gross", change(F.col("exit_close"), F.col("close")))
            .withColumn("net", F.col("gross") - charges - 2 * slip)
            .withColumn("success", (F.col("net") > success).cast("int")))


def drop_outliers(trades: DataFrame, max_move: float = C.MAX_MOVE) -> DataFrame:
    return trades.filter((F.abs("gross") <= max_move) & F.col("net").isNotNull())
