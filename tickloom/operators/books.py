"""Ledgers to positions, positions to values, values to profit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tickloom import constants as C
from tickloom.functions.money import total_charge
from tickloom.functions.stats import change, order_key
from tickloom.operators.filters import corporate_gaps, held_symbols
from tickloom.operators.scans import HOT, PART, along, blended, floored_sum
from tickloom.session import saved

KEYS = ["account", "symbol"]


# --- A ledger folded in order: quantity and moving-average cost after every fill ---

def _signed(ledger: DataFrame) -> DataFrame:
    buy = F.upper("side") == "BUY"
    return ledger.withColumn("_u", F.when(buy, F.col("qty")).otherwise(-F.col("qty")).cast("bigint"))


def fold_ledger(ledger: DataFrame, order: list[str], hot: int | None = HOT, like: Sequence[str] = ()) -> DataFrame:
    """Every fill with the units it moved, and the holding's quantity and average cost after it.

    Needs account, symbol, time, side, qty, price, and an `order` that is total. Sells stop at what is held and keep the
    average; a buy without a price leaves none from there on. A fill is a map of quantity, q -> max(q + u, 0), and a buy one
    of the average, a -> a * q / (q + u) + price * u / (q + u). Such maps compose, so a holding with more than `hot`
    fills is folded in parts, joined by one row per part. `hot` None: no holding has more. With `like`, the first columns
    of `order`, adds `_twin`: whether another fill of the holding has the same in all of them (or may, where a part ends).
    """
    def twin(rows: DataFrame, span: DataFrame | None) -> Column:
        w, own = W.partitionBy(PART, *KEYS).orderBy(*order), F.struct(*like)
        near = [F.lag(own).over(w), F.lead(own).over(w)]
        either = [F.when(other.isNull(), F.lit(span is not None)).otherwise(other.eqNullSafe(own)) for other in near]
        return (either[0] | either[1]).alias("_twin")

    def run(rows: DataFrame, span: DataFrame | None) -> DataFrame:
        rows = floored_sum(rows, KEYS, order, "_u", "_held", "qty_after", span)
        bought = F.col("qty_after") > F.col("_held")
        rows = rows.withColumns({"_factor": F.when(bought, F.col("_held") / F.col("qty_after")).otherwise(1.0),
                                 "_unpriced": bought & F.col("price").isNull()})
        rows = blended(rows, KEYS, order, "_factor", "price", "avg_after", "_unpriced", span)
        return rows.select(*ledger.columns, F.abs(F.col("qty_after") - F.col("_held")).alias("units"), "qty_after", "avg_after",
                           *([twin(rows, span)] if like else []))

    return along(_signed(ledger).withColumn("_u", F.coalesce("_u", F.lit(0).cast("bigint"))), KEYS, order, run, hot)


def realised(folded: DataFrame, broker: str = "broker") -> DataFrame:
    """Adds value, costs and (for sells) pnl on the units each fill moved; buy charges are not in pnl."""
    value = F.col("units") * F.col("price")
    side = F.lower("side")
    f = folded.withColumn("value", value)
    buy = total_charge("buy", F.col("product"), F.col("value"), F.col(broker))
    sell = total_charge("sell", F.col("product"), F.col("value"), F.col(broker))
    f = f.withColumn("costs", F.when(F.col("units") == 0, 0.0).when(side == "buy", buy).otherwise(sell))
    return f.withColumn("pnl", F.when((side == "sell") & (F.col("units") > 0),
                                      F.col("value") - F.col("costs") - F.col("units") * F.col("avg_after")))


def positions_from_ledger(folded: DataFrame, order: list[str]) -> DataFrame:
    """Open holdings: quantity, average cost, and when and as what (and until when, if fills say) the current one was opened."""
    at = F.struct(*order)
    opens = (F.upper("side") == "BUY") & (F.col("qty_after") == F.col("units"))
    return (folded.groupBy(*KEYS).agg(
        F.max_by("qty_after", at).alias("qty"), F.max_by("avg_after", at).alias("avg_price"),
        F.max(F.when(opens, F.col("time"))).alias("opened"),
        F.max_by("product", F.when(opens, at)).alias("product"),
        *[F.max_by(c, F.when(opens, at)).alias(c) for c in ("exit_on",) if c in folded.columns]).filter(F.col("qty") > 0))


def holding_totals(done: DataFrame, order: list[str]) -> DataFrame:
    """One row per holding, open or closed, written once: what `positions_from_ledger` says of it, and the sums over its fills
    that cash and summaries are made of (flow, costs, closed_trades, won). So the fold runs once for all of them."""
    at = F.struct(*order)
    opens = (F.upper("side") == "BUY") & (F.col("qty_after") == F.col("units"))
    sold = F.col("side") == "SELL"
    flow = F.when(F.lower("side") == "buy", -F.col("value")).otherwise(F.col("value")) - F.col("costs")
    return saved(done.groupBy(*KEYS).agg(
        F.max_by("qty_after", at).alias("qty"), F.max_by("avg_after", at).alias("avg_price"),
        F.max(F.when(opens, F.col("time"))).alias("opened"), F.max_by("product", F.when(opens, at)).alias("product"),
        F.sum(flow).alias("flow"), F.sum("costs").alias("costs"), F.count_if(sold).alias("closed_trades"),
        F.count_if(sold & (F.col("pnl") > 0)).alias("won")))


def open_positions(totals: DataFrame) -> DataFrame:
    return totals.filter(F.col("qty") > 0).select(*KEYS, "qty", "avg_price", "opened", "product")


def cash_from_totals(totals: DataFrame, start_cash: float = C.START_CASH) -> DataFrame:
    return totals.groupBy("account").agg((F.lit(start_cash) + F.sum("flow")).alias("cash"))


def cash_from_ledger(done: DataFrame, start_cash: float = C.START_CASH) -> DataFrame:
    """Cash per account after all fills and their charges."""
    buy = F.lower("side") == "buy"
    flow = F.when(buy, -F.col("value")).otherwise(F.col("value")) - F.col("costs")
    return done.groupBy("account").agg((F.lit(start_cash) + F.sum(flow)).alias("cash"))


# --- valuation ---

def value_positions(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds `mark` (live price, else last mark, else average cost) and `value`."""
    last = F.col("last_price") if "last_price" in positions.columns else F.lit(None).cast("double")
    p = positions.join(prices.select("symbol", F.col("price").alias("_px")), "symbol", "left")
    return (p.withColumn("mark", F.coalesce("_px", last, "avg_price")).drop("_px")
            .withColumn("value", F.col("qty") * F.col("mark")))


def account_equity(accounts: DataFrame, positions: DataFrame, prices: DataFrame) -> DataFrame:
    held = value_positions(positions, prices).groupBy("account").agg(F.sum("value").alias("held"))
    return (accounts.join(held, "account", "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
            .withColumn("equity", F.col("cash") + F.col("held")))


def close_coverage(positions: DataFrame, closes: DataFrame, at_least: float = 0.9) -> DataFrame:
    """One row: distinct quoted holdings, how many have a close, and whether that is enough."""
    held = held_symbols(positions).join(
        closes.filter(F.col("price").isNotNull()).select("symbol", F.lit(1).alias("_has")).distinct(), "symbol", "left")
    return held.agg(F.count(F.lit(1)).alias("held"), F.count("_has").alias("closed")).withColumn(
        "enough", (F.col("held") > 0) & (F.col("closed") >= at_least * F.col("held")))


def mark_close(positions: DataFrame, closes: DataFrame, at_least: float = 0.9) -> DataFrame:
    """Positions marked at the day's official closes.

    Nothing moves unless enough holdings have a close; a name far from its last close keeps its old mark.
    """
    usable = closes.join(corporate_gaps(positions, closes), "symbol", "left_anti")
    enough = close_coverage(positions, closes, at_least).select("enough").scalar()
    p = positions.join(usable.select("symbol", F.col("price").alias("_close")), "symbol", "left")
    p = p.withColumn("_close", F.when(enough, F.col("_close")))
    return (p.withColumn("last_price", F.coalesce("_close", "last_price"))
            .withColumn("prev_close", F.coalesce("_close", "prev_close"))
            .withColumn("marked", F.col("_close").isNotNull()).drop("_close"))


def close_equity(accounts: DataFrame, positions: DataFrame, closes: DataFrame, day: Column | str,
                 at_least: float = 0.9) -> DataFrame:
    """One mark per account at the session's end, after `mark_close`: cash and holdings at their official closes.

    Holdings without one keep their last mark. No marks while too few holdings have a close. Values are exact; reports
    round them to cents. `accounts` (account, cash).
    """
    day = F.lit(day).cast("date") if isinstance(day, str) else day
    covered = close_coverage(positions, closes, at_least).select((F.col("enough") | (F.col("held") == 0)).alias("ok")).scalar()
    held = mark_close(positions, closes, at_least).groupBy("account").agg(
        F.sum(F.col("qty") * F.coalesce("last_price", "avg_price")).alias("_held"))
    at = day.cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(C.SESSION_CLOSE))
    return accounts.join(held, "account", "left").filter(covered).select(
        "account", at.alias("time"), (F.col("cash") + F.coalesce("_held", F.lit(0.0))).alias("equity"))


# --- equity curves ---

def day_marks(equity: DataFrame) -> DataFrame:
    """First and last equity of each account-day."""
    at = order_key(F.col("time"), F.col("seq"))
    return equity.groupBy("account", F.to_date("time").alias("day")).agg(
        F.min_by("equity", at).alias("open"), F.max_by("equity", at).alias("close"))


def daily_profit(equity: DataFrame, start_cash: float = C.START_CASH) -> DataFrame:
    """Profit per account-day against the previous day's close, in money and percent."""
    w = W.partitionBy("account").orderBy("day")
    prev = F.coalesce(F.lag("close").over(w), F.lit(start_cash))
    return (day_marks(equity).withColumn("_prev", prev)
            .withColumn("profit_rs", F.round(F.col("close") - F.col("_prev"), 2))
            .withColumn("profit_pct", F.round(100 * change(F.col("close"), F.col("_prev")), 3)).drop("_prev"))


def profit_stats(daily: DataFrame) -> DataFrame:
    """Mean daily profit per account."""
    return daily.groupBy("account").agg(F.avg("profit_rs").alias("mean_profit"), F.count(F.lit(1)).alias("days"))


def latest_day_profit(daily: DataFrame) -> DataFrame:
    newest = daily.agg(F.max("day").alias("day"))
    return daily.join(F.broadcast(newest), "day", "left_semi")


def day_move(equity: DataFrame) -> DataFrame:
    """Last mark of each account-day against its first."""
    return day_marks(equity).withColumn("move", change(F.col("close"), F.col("open")))


# --- the risk-adjusted allocator ---
# A return is zero but where a mark moved, and a score changes only where a return comes into the days before or leaves them.
# So all is worked out on these points, a few per mark; a day's total score is carried as what came less what went.

EXACT = "decimal(38,18)"       # scores are added and taken away again without a rest


def _marked_days(last: DataFrame) -> DataFrame:
    """(day, _at): the days that any account marked, numbered from 0."""
    return last.select("day").distinct().withColumn("_at", F.row_number().over(W.orderBy("day")) - 1)   # one row per calendar day


def _points(last: DataFrame, days: DataFrame, lookback: int, start_cash: float) -> DataFrame:
    """(account, _at, ret, score, was): the days on which an account's return is not zero or its score may change, and day
    0; `was` is the score before. Equity starts at the starting cash and is carried over days without a mark.

    The returns among the days before are few; the days without are zeros, which mean and deviation take in by number.
    """
    w = W.partitionBy("account").orderBy("_at")
    marks = last.filter(F.col("equity").isNotNull()).join(days, "day")
    before = F.coalesce(F.lag("equity").over(w), F.lit(start_cash))
    ret = F.when(F.col("_at") > 0, F.coalesce(change(F.col("equity"), before), F.lit(0.0))).otherwise(0.0)
    moves = marks.withColumn("ret", ret).filter(F.col("ret") != 0).withColumn("_next", F.lead("_at").over(w))
    at = F.col("_at")
    # while there are fewer days than are looked back on, the number of zeros grows daily
    early = F.when(at < lookback, F.sequence(at + 1, F.least(F.coalesce("_next", F.lit(lookback)), F.lit(lookback))))
    places = F.array_union(F.array(at, at + 1, at + lookback + 1), F.coalesce(early, F.array().cast("array<int>")))
    rows = moves.select("account", F.explode(places).alias("_place"), F.when(F.col("_place") == at, F.col("ret")).alias("ret"))
    starts = last.select("account").distinct().select("account", F.lit(0).alias("_place"), F.lit(None).cast("double").alias("ret"))
    points = rows.unionByName(starts).groupBy("account", F.col("_place").alias("_at")).agg(F.max("ret").alias("ret"))

    span = w.rangeBetween(-lookback, -1)
    n, k = F.least(at, F.lit(lookback)), F.count("ret").over(span)
    own, spread = F.avg("ret").over(span), F.var_pop("ret").over(span) * k
    mean = F.when(k == n, own).otherwise(F.try_divide(own * k, n))
    sd = F.sqrt(F.try_divide(spread + F.when(k < n, own * own * k * F.try_divide(n - k, n)).otherwise(0.0), n - 1))
    score = F.when(n >= C.ALLOCATOR_MIN_ROWS, F.greatest(F.coalesce(F.try_divide(mean, sd), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    points = points.withColumn("score", score).withColumn("was", F.coalesce(F.lag("score").over(w), F.lit(0.0)))
    return points.join(days, "_at", "left_semi")                    # none after the last day


def _day_totals(points: DataFrame, days: DataFrame) -> DataFrame:
    """(day, _at, _total, _before, _all) for every day: all accounts' scores, those of the day before, and the accounts."""
    sums = points.groupBy("_at").agg(
        F.sum(F.col("score").cast(EXACT)).alias("_came"), F.sum(F.col("was").cast(EXACT)).alias("_went"),
        F.sum((F.col("score") > 0).cast("int") - (F.col("was") > 0).cast("int")).alias("_more"),
        F.sum((F.col("_at") == 0).cast("int")).alias("_starts"))
    w = W.orderBy("_at")                                            # one row per calendar day
    so_far = lambda c: F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0))                                # noqa: E731
    total = F.when(so_far("_more") > 0, (so_far("_came") - so_far("_went")).cast("double")).otherwise(0.0)
    carried = days.join(sums, "_at", "left").withColumns({"_total": total, "_all": so_far("_starts")})
    return carried.select("day", "_at", "_total", F.coalesce(F.lag("_total").over(w), F.lit(0.0)).alias("_before"), "_all")


def _share(score: str, total: str) -> Column:
    """Weight of a score on a day with that total; equal weights where nobody has earned any."""
    return F.when(F.col(total) > 0, F.col(score) / F.col(total)).otherwise(1 / F.col("_all"))


def _allocator_state(equity: DataFrame, lookback: int, start_cash: float) -> tuple[DataFrame, DataFrame]:
    last = day_marks(equity).select("account", "day", F.col("close").alias("equity"))
    days = saved(_marked_days(last))
    points = saved(_points(last, days, lookback, start_cash))
    return points, saved(_day_totals(points, days))


def _unfolded(points: DataFrame, totals: DataFrame) -> DataFrame:
    """Every day of the points' accounts, with return, weight and what the weight moved. No shuffle by day: each point is
    unfolded up to the next, and totals are one row per calendar day."""
    until = F.coalesce(F.lead("_at").over(W.partitionBy("account").orderBy("_at")), totals.agg(F.max("_at") + 1).scalar())
    each = points.withColumn("_until", until).withColumn("_day", F.explode(F.sequence(F.col("_at"), F.col("_until") - 1)))
    first = F.col("_day") == F.col("_at")
    each = each.select("account", F.col("_day").alias("_at"), F.when(first, F.coalesce("ret", F.lit(0.0))).otherwise(0.0).alias("ret"),
                       "score", F.when(first, F.col("was")).otherwise(F.col("score")).alias("was"))
    moved = F.when(F.col("_at") > 0, F.abs(F.col("weight") - _share("was", "_before")) / 2).otherwise(0.0)
    return (each.join(totals, "_at").withColumn("weight", _share("score", "_total"))
            .select("day", "account", "ret", "weight", moved.alias("moved")))


def allocator_weights(equity: DataFrame, lookback: int = C.ALLOCATOR_LOOKBACK,
                      start_cash: float = C.START_CASH) -> DataFrame:
    """Per day and account: return, and the weight earned by the risk-adjusted return of the days before."""
    return _unfolded(*_allocator_state(equity, lookback, start_cash))


def _combined(points: DataFrame, totals: DataFrame, cost: float, start_cash: float) -> DataFrame:
    at = points.join(totals, "_at").withColumn("_w", _share("score", "_total"))
    sums = at.groupBy("_at").agg(
        F.sum(F.col("_w") * F.col("ret")).alias("ret"), F.sum(F.abs(F.col("_w") - _share("was", "_before"))).alias("_moved"),
        F.sum("was").alias("_was"), F.count(F.lit(1)).alias("_n"))
    # the weights of all others move by the change of the total alone
    now, before = F.col("_total"), F.col("_before")
    rest = F.greatest(before - F.coalesce("_was", F.lit(0.0)), F.lit(0.0))
    others = (F.when((now > 0) & (before > 0), rest * F.abs(1 / now - 1 / before))
              .when((now > 0) | (before > 0), 1 - F.coalesce("_n", F.lit(0)) / F.col("_all")).otherwise(0.0))
    turnover = F.when(F.col("_at") > 0, (F.coalesce("_moved", F.lit(0.0)) + others) / 2).otherwise(0.0)
    days = totals.join(sums, "_at", "left").select("day", F.coalesce("ret", F.lit(0.0)).alias("ret"), turnover.alias("turnover"))
    grown = F.product((1 + F.col("ret")) * (1 - F.col("turnover") * cost)).over(
        W.orderBy("day").rowsBetween(W.unboundedPreceding, 0))    # one row per calendar day
    return days.withColumn("equity", F.round(F.lit(start_cash) * grown, 2))


def allocator(equity: DataFrame, lookback: int = C.ALLOCATOR_LOOKBACK, cost: float = C.SWITCH_COST,
              start_cash: float = C.START_CASH) -> DataFrame:
    """The combined book: one row per day with its compounded value and turnover. Accounts are never laid out by day."""
    return _combined(*_allocator_state(equity, lookback, start_cash), cost, start_cash)


def allocator_table(equity: DataFrame, accounts: list[str], lookback: int = C.ALLOCATOR_LOOKBACK,
                    cost: float = C.SWITCH_COST, start_cash: float = C.START_CASH) -> DataFrame:
    """The combined book as it is exported: date, equity and one rounded weight column per account named."""
    points, totals = _allocator_state(equity, lookback, start_cash)
    wide = (_unfolded(points.filter(F.col("account").isin(accounts)), totals).groupBy("day").pivot("account", accounts)
            .agg(F.round(F.first("weight"), 3)))
    wide = wide.withColumnsRenamed({a: f"w_{a}" for a in accounts})
    return _combined(points, totals, cost, start_cash).select("day", "equity").join(wide, "day", "left")


def all_children(children: dict[str, DataFrame], tag: str = "account") -> DataFrame:
    """The accounts' trades (or curves) as one table, each row tagged with its account."""
    out = None
    for name, rows in children.items():
        tagged = rows.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


# --- price history ---

def annual_vol(closes: DataFrame, window: int = 60) -> DataFrame:
    """Annualised volatility of each symbol's last `window` log returns; a default until there are enough."""
    w = W.partitionBy("symbol").orderBy("date")
    r = closes.select("symbol", "date", F.ln(F.try_divide("close", F.lag("close").over(w))).alias("r"))
    newest = W.partitionBy("symbol").orderBy(F.col("date").desc())
    r = r.filter(F.col("r").isNotNull()).withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= window)
    vol = F.when(F.count("r") > 10, F.stddev_samp("r") * F.sqrt(F.lit(252.0))).otherwise(F.lit(C.DEFAULT_VOL))
    have = r.groupBy("symbol").agg(vol.alias("vol"))
    return closes.select("symbol").distinct().join(have, "symbol", "left").withColumn(
        "vol", F.coalesce("vol", F.lit(C.DEFAULT_VOL)))


def running_vol(closes: DataFrame, window: int = 60) -> DataFrame:
    """The same volatility as it stood on every day."""
    w = W.partitionBy("symbol").orderBy("date")
    r = closes.withColumn("_r", F.ln(F.try_divide("close", F.lag("close").over(w))))
    span = w.rowsBetween(-(window - 1), 0)
    vol = F.when(F.count("_r").over(span) > 10, F.stddev_samp("_r").over(span) * F.sqrt(F.lit(252.0)))
    return r.withColumn("vol", F.coalesce(vol, F.lit(C.DEFAULT_VOL))).drop("_r")


def trend_flag(closes: DataFrame, days: int = 200) -> DataFrame:
    """Adds `mean` of the last `days` closes and `above`: more than `days` closes seen and price over the mean.

    Uses `price` where the table has one, else the close itself.
    """
    w = W.partitionBy("symbol").orderBy("date")
    price = F.col("price") if "price" in closes.columns else F.col("close")
    seen = F.count("close").over(w.rowsBetween(W.unboundedPreceding, 0))
    c = closes.withColumn("mean", F.avg("close").over(w.rowsBetween(-(days - 1), 0))).withColumn("_seen", seen)
    return c.withColumn("above", (F.col("_seen") > days) & (price > F.col("mean"))).drop("_seen")


def day_open(ticks: DataFrame, opens_at: int = C.SESSION_OPEN) -> DataFrame:
    """First price of each symbol-day at or after the opening bell."""
    from tickloom.functions.calendar import second_of_day
    return (ticks.filter(second_of_day(F.col("ts")) >= opens_at)
            .groupBy("symbol", F.to_date("ts").alias("date"))
            .agg(F.min_by("price", order_key(F.col("ts"), F.col("seq"))).alias("open")))
