"""Which symbols, quotes, picks and orders count."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tickloom import constants as C
from tickloom.functions.calendar import to_zone
from tickloom.functions.stats import order_key
from tickloom.operators.scans import HOT, PART, along, numbered


def names_a_fund(symbol: Column, words: tuple[str, ...] = C.FUND_WORDS) -> Column:
    return symbol.rlike("(?i)(" + "|".join(words) + ")")


def companies_only(df: DataFrame, blocklist: DataFrame | None = None) -> DataFrame:
    """Rows whose symbol is neither blocked nor, before its first dot, named like a fund."""
    root = F.split_part("symbol", F.lit("."), F.lit(1))
    out = df.filter(~names_a_fund(root))
    return out if blocklist is None else out.join(blocklist.select("symbol"), "symbol", "left_anti")


def not_companies(df: DataFrame, blocklist: DataFrame | None = None) -> DataFrame:
    """The complement of `companies_only`."""
    fund = names_a_fund(F.split_part("symbol", F.lit("."), F.lit(1)))
    if blocklist is None:
        return df.filter(fund)
    listed = blocklist.select("symbol").distinct().withColumn("_listed", F.lit(True))
    return df.join(listed, "symbol", "left").filter(fund | F.col("_listed")).drop("_listed")


def drop_funds(scores: DataFrame) -> DataFrame:
    """Snapshot rows without funds: the shorter word list against the whole symbol."""
    return scores.filter(~names_a_fund(F.col("symbol"), C.SNAPSHOT_FUND_WORDS))


def trade_day(epoch: Column, zone: str | None) -> Column:
    """Local date of a last-trade stamp in seconds or milliseconds."""
    seconds = F.when(epoch > 1e11, F.floor(epoch / 1000)).otherwise(epoch)
    return F.to_date(to_zone(F.timestamp_seconds(seconds), zone))


def valid_quotes(quotes: DataFrame, today: Column | str | None = None, zone: str | None = C.EXCHANGE_ZONE) -> DataFrame:
    """Quotes of exchange symbols with a price, volume and a trade on `today` (on any day without one)."""
    good = quotes.filter(
        F.col("symbol").endswith(".NS") & (F.col("ltp") > 0) & (F.coalesce("volume", F.lit(0)) != 0)
        & (F.coalesce("last_trade_epoch", F.lit(0)) != 0))
    if today is None:
        return good
    today = F.lit(today).cast("date") if isinstance(today, str) else today
    return good.filter(trade_day(F.col("last_trade_epoch"), zone) == today)


def circuit_flag(quotes: DataFrame) -> DataFrame:
    """Adds `at_limit`: upper, lower or null, for a price within a hair of the day's band."""
    upper = (F.col("band_hi") != 0) & (F.col("ltp") >= F.col("band_hi") * (1 - C.BAND_TOUCH))
    lower = (F.col("band_lo") != 0) & (F.col("ltp") <= F.col("band_lo") * (1 + C.BAND_TOUCH))
    return quotes.withColumn("at_limit", F.when(upper, "upper").when(lower, "lower"))


def mark_blocked(orders: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds `blocked`: why a circuit band stops the order, null when it can fill. `flags`: symbol, at_limit."""
    stuck = orders.join(flags.select("symbol", "at_limit"), "symbol", "left")
    side = F.upper("side")
    return stuck.withColumn(
        "blocked", F.when((side == "BUY") & (F.col("at_limit") == "upper"), "upper circuit")
        .when((side == "SELL") & (F.col("at_limit") == "lower"), "lower circuit")).drop("at_limit")


def split_blocked(orders: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orders that can fill, orders blocked at a band)."""
    marked = mark_blocked(orders, flags)
    return marked.filter(F.col("blocked").isNull()).drop("blocked"), marked.filter(F.col("blocked").isNotNull())


def is_fresh(asof: Column, today: Column, days: int = C.STALE_DAYS) -> Column:
    """An as-of text no older than `days`; text that is no date is stale, a future date is fresh."""
    day = F.when(asof.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(asof, "yyyy-MM-dd"))
    return F.coalesce(F.datediff(today, day) <= days, F.lit(False))


def fresh_picks(picks: DataFrame, today: Column | str, days: int = C.STALE_DAYS) -> DataFrame:
    today = F.lit(today).cast("date") if isinstance(today, str) else today
    return picks.filter(is_fresh(F.col("asof"), today, days))


def barred(ledger: DataFrame, day: Column | str, reasons: Sequence[str] | None = None) -> DataFrame:
    """(account, symbol) pairs sold on `day`, which may not be bought back that day.

    With `reasons` only sales whose reason begins with one of them bar: an account that weighs costs bars what fell too
    far below its entry, model accounts everything they sold.
    """
    day = F.lit(day).cast("date") if isinstance(day, str) else day
    sales = ledger.filter((F.upper("side") == "SELL") & (F.to_date("time") == day))
    if reasons is not None:
        sales = sales.filter(reduce(or_, [F.col("reason").startswith(r) for r in reasons], F.lit(False)))
    return sales.select("account", "symbol").distinct()


def out_of_band(price: Column, ref: Column, gap: float = C.PRICE_GAP) -> Column:
    """A price no single session can reach from `ref`; both ends of the band are still inside."""
    return (ref != 0) & ~price.between((1 - gap) * ref, ref / (1 - gap))


def corporate_gaps(positions: DataFrame, prices: DataFrame, gap: float = C.PRICE_GAP) -> DataFrame:
    """Held symbols priced too far from any holder's previous close. Needs prev_close on positions."""
    return (positions.filter(F.col("prev_close").isNotNull()).join(prices.select("symbol", "price"), "symbol")
            .filter(out_of_band(F.col("price"), F.col("prev_close"), gap)).select("symbol").distinct())


def without_gaps(prices: DataFrame, positions: DataFrame, gap: float = C.PRICE_GAP) -> DataFrame:
    return prices.join(corporate_gaps(positions, prices, gap), "symbol", "left_anti")


def open_candidates(picks: DataFrame, prices: DataFrame, positions: DataFrame) -> DataFrame:
    """An account's picks that have a live price and that it does not hold."""
    return (picks.join(prices.filter(F.col("price").isNotNull()).select("symbol"), "symbol", "left_semi")
            .join(positions.select("account", "symbol"), ["account", "symbol"], "left_anti"))


def merge_quotes(primary: DataFrame, fallback: DataFrame, today: Column | str,
                 zone: str | None = C.EXCHANGE_ZONE) -> DataFrame:
    """One price per symbol: the newest valid primary quote, else the newest fallback row dated today.

    One hash aggregation whose partial results merge before the shuffle, however often a symbol is quoted.
    """
    day = F.lit(today).cast("date") if isinstance(today, str) else today
    first = valid_quotes(primary, day, zone).withColumn("_first", F.lit(True))
    second = fallback.filter(F.col("ltp").isNotNull()
                             & (trade_day(F.col("last_trade_epoch"), zone) == day)).withColumn("_first", F.lit(False))
    rows = first.unionByName(second).withColumn("_order", order_key(F.col("asof"), F.col("seq")))
    best, other = (F.max_by("ltp", F.when(F.col("_first") == f, F.col("_order"))) for f in (True, False))
    return rows.groupBy("symbol").agg(
        F.coalesce(best, other).alias("price"), F.when(F.bool_or("_first"), "primary").otherwise("fallback").alias("source"))


def quote_universe(spark, positions: DataFrame, top_lists: list[tuple[DataFrame, int | None]],
                   always: tuple[str, ...] = C.ALWAYS_QUOTED) -> DataFrame:
    """Every symbol to quote: fixed ones, quoted holdings, and the first rows (by `pos`) of each pick list."""
    out = spark.createDataFrame([(s,) for s in always], "symbol string")
    out = out.union(held_symbols(positions))
    for picks, first in top_lists:
        out = out.union((picks if first is None else picks.filter(F.col("pos") <= first)).select("symbol"))
    return out.distinct()


def held_symbols(positions: DataFrame) -> DataFrame:
    """Distinct held symbols that trade: options and entitlements are not quoted."""
    return positions.filter(~F.col("product").isin(*C.NOT_QUOTED)).select("symbol").distinct()


def held_counts(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Names held per account, entitlements not counted."""
    return positions.groupBy(*keys).agg(
        F.count_if(F.col("product") != "entitlement").alias("names"), F.count(F.lit(1)).alias("positions"))


def picks_by_account(mapping: DataFrame, picks: DataFrame) -> DataFrame:
    """Each account with the rows of the pick list it follows; lists are shared by several accounts."""
    return mapping.join(picks, "list")


def every_nth(ticks: DataFrame, n: int = 3, account: str = "account", hot: int = HOT) -> DataFrame:
    """Every n-th tick of an account in the order of ts and seq, counted across days.

    An account with more than `hot` ticks is numbered in range parts, shifted by the parts before, however they lie in days.
    """
    order = ["ts", "seq"]
    placed = along(ticks, [account], order, lambda rows, span: numbered(rows, [account], order, "nth", span), hot)
    return placed.filter(F.col("nth") % n == 0).drop(PART)
