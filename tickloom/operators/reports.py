"""Summaries, leaderboards, report lines and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import constants as C
from tickloom.functions.stats import change
from tickloom.operators.books import day_move


def goals(summary: DataFrame, overrides: DataFrame | None = None, target: float = C.GOAL_PCT) -> DataFrame:
    """Adds goal_pct (an account's own, else the common one) and progress towards it in percent.

    `overrides` (account, target_pct) is a hand-kept list.
    """
    if overrides is None:
        s = summary.withColumn("goal_pct", F.lit(target))
    else:
        own = overrides.select("account", F.col("target_pct").alias("goal_pct"))
        s = summary.join(own, "account", "left").withColumn("goal_pct", F.coalesce("goal_pct", F.lit(target)))
    return s.withColumn("goal_progress_pct", F.round(F.try_divide("_raw_return", F.col("goal_pct")) * 100, 1))


def account_summary(accounts: DataFrame, ledger: DataFrame, equity: DataFrame, positions: DataFrame,
                    overrides: DataFrame | None = None) -> DataFrame:
    """One row per account: equity, return, holdings, closed trades, win rate, costs and goal progress.

    Holdings stay a table of their own (`holdings_report`), since a book can be any size. `ledger` holds fills, or one row
    per holding with their sums (`books.holding_totals`).
    """
    latest = equity.groupBy("account").agg(F.max_by("equity", F.struct("time", "seq")).alias("_equity"))
    sold = F.col("side") == "SELL"
    if "closed_trades" in ledger.columns:
        closed, won = F.sum("closed_trades"), F.sum("won")
    else:
        closed, won = F.count_if(sold), F.count_if(sold & (F.col("pnl") > 0))
    trades = ledger.groupBy("account").agg(closed.alias("closed_trades"), won.alias("_won"), F.sum("costs").alias("costs_paid"))
    held = positions.groupBy("account").agg(F.count(F.lit(1)).alias("open_positions"))
    s = (accounts.join(latest, "account", "left").join(trades, "account", "left").join(held, "account", "left")
         .withColumn("equity", F.coalesce("_equity", "cash"))
         .withColumn("_raw_return", 100 * change(F.col("equity"), F.col("start_cash"))))
    s = goals(s, overrides)
    return s.select(
        "account", F.round("equity", 2).alias("equity"), F.round("_raw_return", 3).alias("return_pct"),
        F.round("cash", 2).alias("cash"), F.coalesce("open_positions", F.lit(0)).alias("open_positions"),
        F.coalesce("closed_trades", F.lit(0)).alias("closed_trades"),
        F.round(F.try_divide(100 * F.col("_won"), F.col("closed_trades")), 1).alias("win_rate_pct"),
        F.round(F.coalesce("costs_paid", F.lit(0.0)), 2).alias("costs_paid"), "goal_pct", "goal_progress_pct")


def cents(price: Column) -> Column:
    """Rounded half up to cents; an average that stands for a tie, but lies a hair below it, goes up like one that does not."""
    return F.floor(price * (1 + 1e-12) * 100 + 0.5) / 100


def holdings_report(valued: DataFrame) -> DataFrame:
    """The summary's holdings: average and last price rounded for display, and the day each is to be sold (if any)."""
    until = F.col("exit_on") if "exit_on" in valued.columns else F.lit(None).cast("date")
    return valued.select("account", "symbol", "qty", cents(F.col("avg_price")).alias("avg_price"),
                         cents(F.col("mark")).alias("last"), until.alias("exit_on"))


def leaderboard(summary: DataFrame, by: str = "return_pct") -> DataFrame:
    return summary.orderBy(F.col(by).desc(), "account")


def recent_trades(ledger: DataFrame, order: list[str], n: int = 25) -> DataFrame:
    """Newest `n` fills; each partition keeps its own newest `n` before they meet."""
    return ledger.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def summary_document(summary: DataFrame) -> DataFrame:
    """One JSON text per account."""
    return summary.select("account", F.to_json(F.struct(*summary.columns), {"ignoreNullFields": "false"}).alias("doc"))


def summary_head(combined: DataFrame, updated: str, picks_asof: str, start_cash: float = C.START_CASH,
                 target: float = C.GOAL_PCT, by: str = C.GOAL_BY) -> DataFrame:
    """The summary's common part as one JSON text: when it was made, the goal and the combined book's newest day.

    Its accounts are the rows of `summary_document`, its holdings those of `holdings_report`, its weights those of
    `allocator_weights`: a document holds no table of unknown size.
    """
    last = combined.agg(F.max_by(F.struct(F.col("day").cast("string").alias("date"), "equity"), "day").alias("combined"))
    head = F.struct(F.lit(updated).alias("updated"), F.lit(picks_asof).alias("picks_asof"), F.lit(start_cash).alias("start_cash"),
                    F.struct(F.lit(target).alias("target_pct"), F.lit(by).alias("by")).alias("goal"), "combined")
    return last.select(F.to_json(head, {"ignoreNullFields": "false"}).alias("doc"))


def signed_money(value: Column, places: int = 0) -> Column:
    """Thousands separated, with an explicit sign."""
    text = F.format_number(value, places)
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def report_rows(summary: DataFrame) -> DataFrame:
    """The leaderboard as formatted table lines."""
    rate = F.coalesce(F.concat(F.format_number("win_rate_pct", 0), F.lit("%")), F.lit("-"))
    line = F.concat_ws(" | ", F.col("account"), F.format_number("equity", 0),
                       F.concat(signed_money(F.col("return_pct"), 2), F.lit("%")),
                       F.col("closed_trades").cast("string"), rate, F.format_number("costs_paid", 0))
    return summary.select("account", "return_pct", F.concat(F.lit("| "), line, F.lit(" |")).alias("line"))


def combined_line(combined: DataFrame, start_cash: float = C.START_CASH) -> DataFrame:
    """The combined book's newest value as a sentence. Needs day and equity."""
    last = combined.agg(F.max_by("equity", "day").alias("equity"))
    share = 100 * change(F.col("equity"), F.lit(start_cash))
    return last.select(F.concat(F.lit("Combined allocator (virtual): Rs "), F.format_number("equity", 0), F.lit(" ("),
                                signed_money(share, 2), F.lit("%).")).alias("line"))


def profit_rows(latest: DataFrame) -> DataFrame:
    """The latest day's profit as formatted table lines."""
    line = F.concat_ws(" | ", F.col("account"), signed_money(F.col("profit_rs")),
                       F.concat(signed_money(F.col("profit_pct"), 2), F.lit("%")))
    return latest.select("account", "profit_rs", F.concat(F.lit("| "), line, F.lit(" |")).alias("line"))


def average_rows(stats: DataFrame) -> DataFrame:
    """Each account's average profit per day in words."""
    return stats.select("account", "mean_profit", F.concat(
        F.col("account"), F.lit(" Rs "), signed_money(F.col("mean_profit"))).alias("line"))


def trade_alerts(ledger: DataFrame) -> DataFrame:
    time = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss")
    pnl = F.when(F.col("pnl").isNotNull(), F.concat(F.lit(", P&L Rs "), signed_money(F.col("pnl")))).otherwise("")
    return ledger.select(
        F.concat_ws("|", time, "account", "side", "symbol").alias("id"), time.alias("time"),
        F.lit("trade").alias("kind"), "account",
        F.concat(F.col("account"), F.lit(": "), F.col("side"), F.lit(" "), F.col("units").cast("string"), F.lit(" "),
                 F.col("symbol"), F.lit(" at "), F.format_number("price", 2), F.lit(" ("), F.col("reason"),
                 F.lit(")"), pnl).alias("text"))


def _percent(move: Column) -> Column:
    return F.concat(signed_money(100 * move, 1), F.lit("%"))


def move_alerts(positions: DataFrame, prices: DataFrame, now: Column, big: float = C.BIG_MOVE) -> DataFrame:
    p = positions.join(prices.select("symbol", "price"), "symbol").withColumn(
        "_move", change(F.col("price"), F.col("avg_price"))).filter(F.abs("_move") >= big)
    return p.select(
        F.concat_ws("|", F.to_date(now).cast("string"), "account", "symbol",
                    F.round("_move", 2).cast("string")).alias("id"),
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.lit("move").alias("kind"), "account",
        F.concat(F.col("account"), F.lit(": "), F.col("symbol"), F.lit(" is "), _percent(F.col("_move")),
                 F.lit(" since entry")).alias("text"))


def account_alerts(equity: DataFrame, big: float = C.BIG_MOVE) -> DataFrame:
    d = day_move(equity).filter(F.abs("move") >= big)
    day = F.col("day").cast("string")
    return d.select(
        F.concat_ws("|", day, "account", F.lit("day"), F.round("move", 2).cast("string")).alias("id"),
        day.alias("time"), F.lit("account").alias("kind"), "account",
        F.concat(F.col("account"), F.lit(" account "), _percent(F.col("move")), F.lit(" today (Rs "),
                 F.format_number("close", 0), F.lit(")")).alias("text"))


def alerts(*sources: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """All alerts once per id, those already in the log (`seen`: id) left out."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    one = rows.groupBy("id").agg(F.min(F.struct("time", "kind", "account", "text")).alias("a")).select("id", "a.*")
    return one if seen is None else one.join(seen.select("id"), "id", "left_anti")
