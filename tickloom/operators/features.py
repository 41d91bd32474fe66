"""Feature and label tables.

Windows run over rows already reduced to one per symbol-day or symbol-bar, so a window partition holds
at most a calendar's worth of rows however large the tick table is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tickloom import constants as C
from tickloom.functions.stats import change, scrub_inf, trailing
from tickloom.operators.bars import days_with_first_period, first_seen, last_seen
from tickloom.operators.ranking import pct_rank_in


def daily_features(bars: DataFrame, index: str = "^NSEI", until: str = C.FIRST_PERIOD_END) -> DataFrame:
    """One row per symbol-day: what is known once the first period ends, and the day's remaining return."""
    w = W.partitionBy("symbol").orderBy("date")
    col, lag = F.col, lambda c, n=1: F.lag(c, n).over(w)
    d = days_with_first_period(bars, until)
    d = d.withColumns({
        "_prev": lag("close"), "_day_ret": change(col("close"), lag("close")), "_log_vol": F.log1p("fh_vol")})
    d = d.withColumns({
        "gap": change(col("open"), col("_prev")),
        "first_hr_ret": change(col("fh_close"), col("open")),
        "first_hr_range": F.try_divide(col("fh_high") - col("fh_low"), col("open")),
        "first_hr_vol_ratio": col("_log_vol") - trailing(F.avg, col("_log_vol"), w, 20, 10),
        "prev_ret": change(col("_prev"), lag("close", 2)),
        "prev_intraday": change(col("_prev"), lag("open")),
        "prev_range": F.try_divide(lag("high") - lag("low"), col("_prev")),
        "ret_5d": change(col("_prev"), lag("close", 6)),
        "ret_20d": change(col("_prev"), lag("close", 21)),
        "vol_20d": trailing(F.stddev_samp, col("_day_ret"), w, 20, 10),
        "dist_20d_high": change(col("_prev"), trailing(F.max, col("high"), w, 20, 10)),
        "label_ret": change(col("close"), col("fh_close")),
    }).drop("_prev", "_day_ret", "_log_vol")
    return scrub_inf(with_market(d, index))


def with_market(d: DataFrame, index: str = "^NSEI") -> DataFrame:
    """The index's gap and first-period return on every stock of the day; index rows leave the table."""
    market = (d.filter(F.col("symbol") == index)
              .select("date", F.col("gap").alias("mkt_gap"), F.col("first_hr_ret").alias("mkt_first_hr")))
    return (d.filter(~F.col("symbol").startswith("^"))
            .join(market, "date", "left")
            .withColumn("rel_first_hr", F.col("first_hr_ret") - F.col("mkt_first_hr")))


def labels(d: DataFrame) -> DataFrame:
    """Return in excess of the day's average over stocks, and its percent rank that day.

    A day holds one row per listed symbol, so both windows share one small partition per day.
    """
    day = [F.col("date")]
    return (d.withColumn("label_excess", F.col("label_ret") - F.avg("label_ret").over(W.partitionBy(*day)))
            .withColumn("label_rank", pct_rank_in(day, F.col("label_excess"))))


def latest_cross_section(d: DataFrame) -> DataFrame:
    """The newest day's rows that have a first-period return."""
    newest = d.agg(F.max("date").alias("date"))
    return d.join(F.broadcast(newest), "date", "left_semi").filter(F.col("first_hr_ret").isNotNull())


def day_context(bars: DataFrame) -> DataFrame:
    """Yesterday's view of each symbol-day: close, returns, volatility."""
    w = W.partitionBy("symbol").orderBy("date")
    lag = lambda c, n=1: F.lag(c, n).over(w)
    day = bars.groupBy("symbol", "date").agg(first_seen("open").alias("d_open"), last_seen("close").alias("d_close"))
    return (day.withColumn("_ret", change(F.col("d_close"), lag("d_close")))
            .select("symbol", "date", lag("d_close").alias("prev_close"),
                    change(lag("d_close"), lag("d_close", 2)).alias("prev_ret"),
                    change(lag("d_close"), lag("d_open")).alias("prev_intraday"),
                    change(lag("d_close"), lag("d_close", 6)).alias("ret_5d"),
                    trailing(F.stddev_samp, F.col("_ret"), w, 20, 10).alias("vol_20d")))


def with_day_context(b: DataFrame, day: DataFrame) -> DataFrame:
    return b.join(day, ["symbol", "date"], "left")


def with_market_bar(b: DataFrame, index: str = "^NSEI") -> DataFrame:
    """The index's return so far and last-bar return on every stock's bar; index rows leave the table."""
    market = (b.filter(F.col("symbol") == index)
              .select("date", "bar", F.col("ret_so_far").alias("mkt_so_far"),
                      F.col("last_bar_ret").alias("mkt_last_bar")))
    return (b.filter(F.col("symbol") != index)
            .join(market, ["date", "bar"], "left")
            .withColumn("rel_so_far", F.col("ret_so_far") - F.col("mkt_so_far")))


def entry_table(bars: DataFrame, index: str = "^NSEI") -> DataFrame:
    """One row per symbol-day-bar with everything known when the bar closes. Needs `bar`."""
    in_day = W.partitionBy("symbol", "date").orderBy("ts")
    so_far = in_day.rowsBetween(W.unboundedPreceding, 0)
    day = W.partitionBy("symbol", "date")
    same_bar = W.partitionBy("symbol", "bar").orderBy("date")
    col = F.col
    b = bars.withColumns({
        "day_open": F.first("open", ignorenulls=True).over(
            in_day.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        "hi_so_far": F.max("high").over(so_far), "lo_so_far": F.min("low").over(so_far),
        "cumvol": F.sum("volume").over(so_far),
        "turnover_day": F.sum(col("close") * col("volume")).over(day),
        "_prev_bar": F.lag("close").over(in_day)})
    b = with_day_context(b, day_context(bars))
    span = col("hi_so_far") - col("lo_so_far")
    b = b.withColumns({
        "ret_so_far": change(col("close"), col("day_open")),
        "gap": change(col("day_open"), col("prev_close")),
        "last_bar_ret": change(col("close"), F.coalesce("_prev_bar", "day_open")),
        "range_so_far": F.try_divide(span, col("day_open")),
        "pos_in_range": F.try_divide(col("close") - col("lo_so_far"), span),
        "vol_ratio_so_far": F.log1p("cumvol") - F.log1p(trailing(F.avg, col("cumvol"), same_bar, 20, 5)),
    }).drop("_prev_bar")
    b = with_market_bar(b, index).withColumn("entry_bar", col("bar"))
    return scrub_inf(b)
