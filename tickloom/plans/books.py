"""Registered queries: filters, quotes, corporate actions, books, reports and files."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from tickloom.functions import calendar as D
from tickloom.functions.options import price_premiums
from tickloom.operators import books as B
from tickloom.operators import corporate as S
from tickloom.operators import filters as L
from tickloom.operators import reports as R
from tickloom.operators.scans import HOT
from tickloom.plans import views as V
from tickloom.plans.pricing import sql_cdf, sql_charges
from tickloom.plans.registry import query, r, report, rs
from tickloom.plans.views import FILL_ORDER, VIEWS, with_more, with_views
from tickloom.session import saved, scratch_path
from tickloom.sources import accounts as A
from tickloom.sources import bars as SB
from tickloom.sources import picks as P
from tickloom.sources import reports as SR

# --- filters ---

STEMS = ("GOLDBEES", "NIFTYBEES", "LIQUIDCASE", "RELIANCE", "TCS", "Infy", "silverleaf", "ITC", "ONGC", "BetaPharma")
VIEWS["listed"] = f"""
 SELECT p_partkey, p_size, {list(STEMS)}[p_size % 10 + 1] || p_partkey
        || CASE WHEN p_size % 7 = 0 THEN '.ETF' ELSE '.NS' END AS symbol FROM part """


def listed(spark, sf):
    return V.table(spark, sf, "part").select(
        "p_partkey", "p_size", F.concat(
            F.element_at(F.array(*[F.lit(s) for s in STEMS]), F.col("p_size") % 10 + 1), F.col("p_partkey").cast("string"),
            F.when(F.col("p_size") % 7 == 0, ".ETF").otherwise(".NS")).alias("symbol"))


WORDS = "ETF|BEES|LIQUID|LIQID|BETA|NEXT50|NIFTY|SENSEX|GOLD|SILVER|GILT|GSEC|IETF"


@query("f01_companies_only", with_views("listed", f"""
 SELECT symbol FROM listed WHERE NOT regexp_matches(split_part(symbol, '.', 1), '{WORDS}', 'i')
   AND symbol NOT IN (SELECT symbol FROM listed WHERE p_size = 13)"""))
def f01(spark, sf):
    stocks = listed(spark, sf)
    return L.companies_only(stocks, stocks.filter("p_size = 13")).select("symbol")


@query("f02_drop_funds", with_views("listed", """
 SELECT symbol FROM listed WHERE NOT regexp_matches(symbol, 'ETF|BEES|LIQUID|GILT|GSEC|NIFTY|SENSEX', 'i')"""))
def f02(spark, sf):
    return L.drop_funds(listed(spark, sf)).select("symbol")


@query("f03_session_filter", """
 SELECT event_id FROM events WHERE isodow(ts) < 6 AND CAST(ts AS TIME) BETWEEN TIME '09:15:00' AND TIME '15:30:00'""")
def f03(spark, sf):
    return V.table(spark, sf, "events").filter(D.in_session(F.col("ts"))).select("event_id")


@query("f12_phase", """
 SELECT event_id, CASE WHEN CAST(ts AS TIME) < TIME '09:30:00' THEN 'wait' WHEN CAST(ts AS TIME) < TIME '10:20:00'
   THEN 'entry' WHEN CAST(ts AS TIME) < TIME '15:05:00' THEN 'model_entry' ELSE 'hard_exit' END AS phase FROM events""")
def f12(spark, sf):
    return V.table(spark, sf, "events").select("event_id", D.phase(F.col("ts")).alias("phase"))


TODAY = "2024-01-15"
ZONE = "Asia/Kolkata"
# Stamps are shifted from UTC by the zone's fixed offset of five and a half hours.
VIEWS["dated_quotes"] = """
 SELECT *, CAST(make_timestamp((CASE WHEN last_trade_epoch > 1e11 THEN last_trade_epoch // 1000 ELSE last_trade_epoch END
        + 19800) * 1000000) AS DATE) AS trade_day FROM quotes """


@query("f04_valid_quotes", with_views("dated_quotes", f"""
 SELECT seq, symbol, source, {r('ltp')} FROM dated_quotes
 WHERE symbol LIKE '%.NS' AND ltp > 0 AND volume <> 0 AND trade_day = DATE '{TODAY}'"""))
def f04(spark, sf):
    return report(L.valid_quotes(V.quotes(spark, sf), TODAY, ZONE), "seq", "symbol", "source", "ltp")


LIMIT = "CASE WHEN ltp >= band_hi * 999e-3 THEN 'upper' WHEN ltp <= band_lo * 1001e-3 THEN 'lower' END"


@query("f05_circuit_flags", with_views("quotes", f"SELECT seq, symbol, {LIMIT} AS at_limit FROM quotes"))
def f05(spark, sf):
    return L.circuit_flag(V.quotes(spark, sf)).select("seq", "symbol", "at_limit")


# Orders against one flag per symbol: suppliers' ratings stand in for the day's bands.
@query("f05_blocked_orders", with_more("ledger", """
 flags AS (SELECT 'L' || s_suppkey AS symbol, CASE WHEN s_acctbal > 7000 THEN 'upper' WHEN s_acctbal < 1000 THEN 'lower' END
   AS at_limit FROM supplier)""", """
 SELECT account, side, CASE WHEN side = 'BUY' AND at_limit = 'upper' THEN 'upper circuit'
     WHEN side = 'SELL' AND at_limit = 'lower' THEN 'lower circuit' END AS blocked, count(*) AS orders
 FROM ledger LEFT JOIN flags USING (symbol) GROUP BY ALL"""))
def f05_orders(spark, sf):
    s = V.table(spark, sf, "supplier")
    flags = s.select(F.concat(F.lit("L"), F.col("s_suppkey").cast("string")).alias("symbol"),
                     F.when(F.col("s_acctbal") > 7000, "upper").when(F.col("s_acctbal") < 1000, "lower").alias("at_limit"))
    marked = L.mark_blocked(V.ledger(spark, sf), flags)
    return marked.groupBy("account", "side", "blocked").agg(F.count(F.lit(1)).alias("orders"))


@query("f06_fresh_picks", """
 SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown'
   ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS stamp FROM orders)
 WHERE DATE '1998-06-01' - try_cast(stamp AS DATE) <= 4""")
def f06(spark, sf):
    picks = V.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(
            F.to_date("o_orderdate").cast("string")).alias("asof"))
    return L.fresh_picks(picks, "1998-06-01").select("o_orderkey")


VIEWS["marked_book"] = """
 SELECT b.*, CASE WHEN product = 'intraday' THEN round(avg_price * 1.01, 4) END AS last_price,
        CASE WHEN qty % 2 = 0 THEN round(avg_price * (qty % 10 + 5) / 10, 4) END AS prev_close FROM book b """


def marked_book(spark, sf):
    return V.book(spark, sf).withColumns({
        "last_price": F.when(F.col("product") == "intraday", F.round(F.col("avg_price") * 1.01, 4)),
        "prev_close": F.when(F.col("qty") % 2 == 0, F.round(F.col("avg_price") * (F.col("qty") % 10 + 5) / 10, 4))})


VIEWS["gapped"] = """
 SELECT DISTINCT m.symbol FROM marked_book m JOIN prices p ON m.symbol = p.symbol
 WHERE prev_close IS NOT NULL AND NOT (price BETWEEN 75e-2 * prev_close AND prev_close / 75e-2) """


@query("f09_corporate_gaps", with_views("gapped", "SELECT symbol FROM gapped"))
def f09(spark, sf):
    return L.corporate_gaps(marked_book(spark, sf), V.prices(spark, sf))


@query("f09_prices_without_gaps", with_views("gapped prices", f"""
 SELECT symbol, {r('price')} FROM prices WHERE symbol NOT IN (SELECT symbol FROM gapped)"""))
def f09_prices(spark, sf):
    return report(L.without_gaps(V.prices(spark, sf), marked_book(spark, sf)), "symbol", "price")


@query("f11_barred_today", with_views("ledger", """
 SELECT DISTINCT account, symbol FROM ledger WHERE side = 'SELL' AND CAST(time AS DATE) = DATE '1997-03-10'"""))
def f11(spark, sf):
    return L.barred(V.ledger(spark, sf), "1997-03-10")


@query("f11_barred_by_reason", with_views("ledger", """
 SELECT DISTINCT account, symbol FROM ledger WHERE side = 'SELL' AND CAST(time AS DATE) = DATE '1997-03-10'
   AND reason IN ('1-URGENT', '5-LOW')"""))
def f11_by_reason(spark, sf):
    return L.barred(V.ledger(spark, sf), "1997-03-10", ["1-URGENT", "5-LOW"])


# --- joins and sets ---

@query("j06_open_candidates", with_views("accounts pick_lists live_prices book", """
 SELECT a.account, p.symbol, p.pos FROM accounts a JOIN pick_lists p ON a.list = p.list
 WHERE p.symbol IN (SELECT symbol FROM live_prices)
   AND NOT EXISTS (SELECT 1 FROM book b WHERE b.account = a.account AND b.symbol = p.symbol)"""))
def j06(spark, sf):
    picks = L.picks_by_account(V.accounts(spark, sf).select("account", "list"), V.pick_lists(spark, sf))
    return report(L.open_candidates(picks, V.prices(spark, sf), V.book(spark, sf)), "account", "symbol", "pos")


@query("j07_merge_quotes", with_more("dated_quotes", f"""
 good AS (SELECT *, 0 AS feed FROM dated_quotes WHERE source = 'primary' AND symbol LIKE '%.NS' AND ltp > 0
            AND volume <> 0 AND trade_day = DATE '{TODAY}'
          UNION ALL SELECT *, 1 FROM dated_quotes WHERE source = 'fallback' AND ltp IS NOT NULL
            AND trade_day = DATE '{TODAY}')""", f"""
 SELECT symbol, {r('ltp', 'price')}, source FROM (
   SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY feed, "asof" DESC, seq DESC) AS k FROM good) WHERE k = 1"""))
def j07(spark, sf):
    q = V.quotes(spark, sf)
    merged = L.merge_quotes(q.filter("source = 'primary'"), q.filter("source = 'fallback'"), TODAY, ZONE)
    return report(merged, "symbol", "price", "source")


@query("j08_quote_universe", with_views("book pick_lists", """
 SELECT unnest(['NIFTYBEES.NS', 'GOLDBEES.NS', 'HDFCSML250.NS', '^NSEI']) AS symbol
 UNION SELECT symbol FROM book WHERE product NOT IN ('option', 'entitlement')
 UNION SELECT symbol FROM pick_lists WHERE pos <= 15"""))
def j08(spark, sf):
    return L.quote_universe(spark, V.book(spark, sf), [(V.pick_lists(spark, sf), 15)])


@query("j09_position_values", with_views("marked_book prices", f"""
 SELECT m.account, m.symbol, m.qty, {r('coalesce(price, last_price, avg_price)', 'mark')},
        {r('qty * coalesce(price, last_price, avg_price)', 'value', 4)}
 FROM marked_book m LEFT JOIN prices p ON m.symbol = p.symbol"""))
def j09(spark, sf):
    return report(B.value_positions(marked_book(spark, sf), V.prices(spark, sf)),
                  "account", "symbol", "qty", "mark", "value", value=4)


@query("j10_picks_by_account", with_views("accounts pick_lists", f"""
 SELECT account, p.list, symbol, pos, {r('expected')} FROM accounts a JOIN pick_lists p ON a.list = p.list"""))
def j10(spark, sf):
    picks = L.picks_by_account(V.accounts(spark, sf).select("account", "list"), V.pick_lists(spark, sf))
    return report(picks, "account", "list", "symbol", "pos", "expected")


@query("a14_held_symbols", with_views("book", """
 SELECT DISTINCT symbol FROM book WHERE product NOT IN ('option', 'entitlement')"""))
def a14(spark, sf):
    return L.held_symbols(V.book(spark, sf))


@query("a14_names_held", with_views("book", """
 SELECT account, count(*) FILTER (WHERE product <> 'entitlement') AS names, count(*) AS positions FROM book GROUP BY 1"""))
def a14_names(spark, sf):
    return L.held_counts(V.book(spark, sf), ["account"])


# --- ledger folds ---

VIEWS["numbered_fills"] = """
 SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY time, order_id, line, part, value) AS nth FROM ledger """
VIEWS["folded"] = """
 SELECT account, symbol, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS units, CAST(0 AS BIGINT) AS qty_after,
        0e0 AS avg_after FROM ledger GROUP BY 1, 2
 UNION ALL
 SELECT f.account, f.symbol, f.nth, CASE WHEN side = 'BUY' THEN f.qty ELSE least(f.qty, s.qty_after) END,
        CASE WHEN side = 'BUY' THEN s.qty_after + f.qty ELSE s.qty_after - least(f.qty, s.qty_after) END,
        CASE WHEN side = 'BUY' THEN (s.avg_after * s.qty_after + f.qty * f.price) / (s.qty_after + f.qty) ELSE s.avg_after END
 FROM folded s JOIN numbered_fills f ON f.account = s.account AND f.symbol = s.symbol AND f.nth = s.nth + 1 """
VIEWS["fills_done"] = f"""
 SELECT *, CASE WHEN units = 0 THEN 0e0 ELSE {sql_charges('side', 'product', 'moved', 'broker')['total']} END AS costs,
        CASE WHEN side = 'SELL' AND units > 0
             THEN moved - {sql_charges("'sell'", 'product', 'moved', 'broker')['total']} - units * avg_after END AS pnl
 FROM (SELECT f.*, s.units, s.qty_after, s.avg_after, s.units * f.price AS moved
       FROM folded s JOIN numbered_fills f ON f.account = s.account AND f.symbol = s.symbol AND f.nth = s.nth) """
VIEWS["held_now"] = """
 SELECT account, symbol, arg_max(qty_after, nth) AS qty, arg_max(avg_after, nth) AS avg_price,
        max(time) FILTER (WHERE side = 'BUY' AND qty_after = units) AS opened,
        arg_max(product, nth) FILTER (WHERE side = 'BUY' AND qty_after = units) AS product
 FROM fills_done GROUP BY 1, 2 HAVING arg_max(qty_after, nth) > 0 """


def folded(spark, sf):
    """The fold; holdings are counted, which takes the join of all fills, only where some symbol has more fills than one task takes."""
    most = V.table(spark, sf, "lineitem").groupBy("l_suppkey").count().agg(F.max("count")).first()[0] or 0
    return B.fold_ledger(V.ledger(spark, sf), list(FILL_ORDER), HOT if most > HOT else None)


def fills_done(spark, sf):
    return B.realised(folded(spark, sf))


def holding_totals(spark, sf):
    return B.holding_totals(fills_done(spark, sf), list(FILL_ORDER))


def held_now(spark, sf):
    return B.positions_from_ledger(folded(spark, sf), list(FILL_ORDER))


@query("a15_ledger_fold", with_views("fills_done", f"""
 SELECT account, symbol, order_id, line, part, side, units, qty_after, {r('avg_after', places=4)}, {r('costs', places=4)},
        {r('pnl', places=3)} FROM fills_done"""))
def a15(spark, sf):
    return report(fills_done(spark, sf), "account", "symbol", "order_id", "line", "part", "side", "units", "qty_after",
                  "avg_after", "costs", "pnl", places=4, pnl=3)


@query("a15_positions", with_views("held_now", f"""
 SELECT account, symbol, qty, {r('avg_price', places=4)}, strftime(opened, '%Y-%m-%d %H:%M:%S') AS opened, product FROM held_now"""))
def a15_positions(spark, sf):
    return report(held_now(spark, sf), "account", "symbol", "qty", "avg_price", "opened", "product", places=4)


VIEWS["purses"] = """
 SELECT account, 200000 + sum(CASE WHEN side = 'BUY' THEN -moved ELSE moved END - costs) AS cash
 FROM fills_done GROUP BY 1 """
VIEWS["supply_prices"] = """
 SELECT 'L' || s_suppkey AS symbol, CASE WHEN s_nationkey <> 0 THEN abs(s_acctbal) + 100 END AS price FROM supplier """


def supply_prices(spark, sf):
    return V.table(spark, sf, "supplier").select(
        F.concat(F.lit("L"), F.col("s_suppkey").cast("string")).alias("symbol"),
        F.when(F.col("s_nationkey") != 0, F.abs("s_acctbal") + 100).alias("price"))


@query("a16_account_equity", with_more("purses held_now supply_prices", """
 worth AS (SELECT account, sum(qty * coalesce(price, avg_price)) AS held FROM held_now LEFT JOIN supply_prices USING (symbol)
           GROUP BY 1)""", f"""
 SELECT account, {r('cash', places=2)}, {r('coalesce(held, 0)', 'held', 2)}, {r('cash + coalesce(held, 0)', 'equity', 2)}
 FROM purses LEFT JOIN worth USING (account)"""))
def a16(spark, sf):
    totals = holding_totals(spark, sf)
    return report(B.account_equity(B.cash_from_totals(totals), B.open_positions(totals), supply_prices(spark, sf)), places=2)


# --- corporate actions ---

@query("j14_recent_splits", with_views("actions", f"""
 SELECT DISTINCT symbol, CAST(ex_date AS VARCHAR) AS ex_date, {r('ratio')} FROM actions
 WHERE ex_date BETWEEN DATE '1998-06-01' - 7 AND DATE '1998-06-01' AND ratio <> 1"""))
def j14(spark, sf):
    return report(S.recent_splits(V.actions(spark, sf), "1998-06-01"))


VIEWS["events_in_turn"] = """
 SELECT h.account, h.symbol, e.ex_date, e.ratio, row_number() OVER (PARTITION BY h.account, h.symbol ORDER BY e.ex_date) AS nth
 FROM held_now h JOIN (SELECT DISTINCT symbol, ex_date, ratio FROM actions WHERE ratio <> 1) e
   ON h.symbol = e.symbol AND CAST(h.opened AS DATE) < e.ex_date WHERE h.product <> 'option' """
VIEWS["split_steps"] = """
 SELECT account, symbol, CAST(0 AS BIGINT) AS nth, qty, avg_price, CAST(NULL AS DATE) AS ex_date, 1e0 AS ratio,
        CAST(0 AS BIGINT) AS qty_before FROM held_now
 UNION ALL
 SELECT s.account, s.symbol, e.nth, CAST(floor(s.qty * e.ratio + 1e-9) AS BIGINT), s.avg_price / e.ratio, e.ex_date,
        e.ratio, s.qty
 FROM split_steps s JOIN events_in_turn e ON e.account = s.account AND e.symbol = s.symbol AND e.nth = s.nth + 1 """


def adjusted(spark, sf):
    held = held_now(spark, sf).withColumn("splits", F.lit(None).cast("array<date>"))
    return S.apply_splits(held, V.actions(spark, sf))


@query("j13_apply_splits", with_views("split_steps", f"""
 SELECT account, symbol, arg_max(qty, nth) AS qty, {r('arg_max(avg_price, nth)', 'avg_price', 4)},
        max(nth) AS events FROM split_steps GROUP BY 1, 2"""))
def j13(spark, sf):
    out = adjusted(spark, sf).withColumn("events", F.size("applied"))
    return report(out, "account", "symbol", "qty", "avg_price", "events", places=4)


@query("r07_action_log", with_views("split_steps", f"""
 SELECT account, symbol, CAST(ex_date AS VARCHAR) AS ex_date, {r('ratio')}, qty_before, qty AS qty_after
 FROM split_steps WHERE nth > 0"""))
def r07(spark, sf):
    return report(S.action_log(adjusted(spark, sf)))


# --- marks, summaries, profit ---

COVERED = "(SELECT count(p.symbol) >= 9e-1 * count(*) FROM (SELECT DISTINCT symbol FROM book WHERE product NOT IN ('option', 'entitlement')) h LEFT JOIN live_prices p ON h.symbol = p.symbol)"


@query("a11_close_coverage", with_views("book live_prices", f"""
 SELECT count(*) AS held, count(p.symbol) AS closed, {COVERED} AS enough
 FROM (SELECT DISTINCT symbol FROM book WHERE product NOT IN ('option', 'entitlement')) h
 LEFT JOIN live_prices p ON h.symbol = p.symbol"""))
def a11(spark, sf):
    return B.close_coverage(V.book(spark, sf), V.prices(spark, sf))


@query("r01_mark_close", with_more("book marked_book gapped prices live_prices", f"""
 usable AS (SELECT * FROM prices WHERE symbol NOT IN (SELECT symbol FROM gapped) AND {COVERED})""", f"""
 SELECT m.account, m.symbol, {r('coalesce(price, last_price)', 'last_price')}, {r('coalesce(price, prev_close)', 'prev_close')},
        price IS NOT NULL AS marked FROM marked_book m LEFT JOIN usable u ON m.symbol = u.symbol"""))
def r01(spark, sf):
    return report(B.mark_close(marked_book(spark, sf), V.prices(spark, sf)),
                  "account", "symbol", "last_price", "prev_close", "marked")


@query("r01_close_equity", with_more("book accounts marked_book gapped prices live_prices", f"""
 usable AS (SELECT * FROM prices WHERE symbol NOT IN (SELECT symbol FROM gapped) AND {COVERED})""", f"""
 SELECT account, '1998-06-02 15:30:00' AS time, {r('cash + coalesce(held, 0)', 'equity', 2)}
 FROM accounts LEFT JOIN (SELECT account, sum(qty * coalesce(price, last_price, avg_price)) AS held
   FROM marked_book m LEFT JOIN usable u ON m.symbol = u.symbol GROUP BY 1) USING (account) WHERE {COVERED}"""))
def r01_equity(spark, sf):
    marks = B.close_equity(V.accounts(spark, sf), marked_book(spark, sf), V.prices(spark, sf), "1998-06-02")
    return report(marks, "account", "time", "equity", places=2)


VIEWS["option_book"] = """
 SELECT l_orderkey, l_linenumber, l_partkey, p_retailprice AS spot,
        round_even(p_retailprice / 50, 0) * 50 + (l_linenumber - 4) * 50 AS strike,
        greatest(CAST(l_quantity AS INTEGER) - 20, 0) / 365e0 AS years, (l_tax + 1e-2) * 5 * 115e-2 AS vol
 FROM lineitem JOIN part ON l_partkey = p_partkey """
VIEWS["option_terms"] = """
 SELECT *, (ln(spot / strike) + (65e-3 + 5e-1 * vol * vol) * years) / nullif(vol * sqrt(years), 0) AS d1,
        (ln(spot / strike) + (65e-3 + 5e-1 * vol * vol) * years) / nullif(vol * sqrt(years), 0) - vol * sqrt(years) AS d2
 FROM option_book """


@query("r02_option_marks", with_views("option_terms", f"""
 SELECT l_orderkey, l_linenumber, l_partkey, {r(f"CASE WHEN years <= 0 THEN greatest(spot - strike, 0) ELSE spot * {sql_cdf('d1')} - strike * exp(-65e-3 * years) * {sql_cdf('d2')} END", 'price', 4)}
 FROM option_terms"""))
def r02(spark, sf):
    from tickloom.functions.options import atm_strike
    o = (V.table(spark, sf, "lineitem")
         .join(V.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
         .select("l_orderkey", "l_linenumber", "l_partkey", F.col("p_retailprice").alias("spot"),
                 (atm_strike(F.col("p_retailprice")) + (F.col("l_linenumber") - 4) * 50).alias("strike"),
                 (F.col("l_quantity").cast("int") - 20).alias("days_left"),
                 ((F.col("l_tax") + 0.01) * 5).alias("realised_vol")))
    return report(price_premiums(o, name="price"), "l_orderkey", "l_linenumber", "l_partkey", "price", price=4)


VIEWS["marks"] = """
 SELECT account, CAST(time AS DATE) AS day, arg_min(equity, (time, seq)) AS open, arg_max(equity, (time, seq)) AS close
 FROM equity GROUP BY 1, 2 """
VIEWS["profits"] = """
 SELECT *, round(close - prev, 2) AS profit_rs, round(100 * (close / prev - 1), 3) AS profit_pct FROM (
   SELECT *, coalesce(lag(close) OVER (PARTITION BY account ORDER BY day), 200000) AS prev FROM marks ) """


@query("a05_daily_profit", with_views("profits", f"""
 SELECT account, CAST(day AS VARCHAR) AS day, {rs('open close profit_rs profit_pct', 3)} FROM profits"""))
def a05(spark, sf):
    return report(B.daily_profit(V.equity(spark, sf)), "account", "day", "open", "close", "profit_rs", "profit_pct", places=3)


@query("a06_profit_stats", with_views("profits", f"""
 SELECT account, {r('avg(profit_rs)', 'mean_profit', 4)}, count(*) AS days FROM profits GROUP BY 1"""))
def a06(spark, sf):
    return report(B.profit_stats(B.daily_profit(V.equity(spark, sf))), places=4)


@query("a06_latest_day", with_views("profits", f"""
 SELECT account, CAST(day AS VARCHAR) AS day, {rs('profit_rs profit_pct', 3)} FROM profits
 WHERE day = (SELECT max(day) FROM profits)"""))
def a06_latest(spark, sf):
    return report(B.latest_day_profit(B.daily_profit(V.equity(spark, sf))), "account", "day", "profit_rs", "profit_pct",
                  places=3)


@query("w07_day_move", with_views("marks", f"""
 SELECT account, CAST(day AS VARCHAR) AS day, {r('close / nullif(open, 0) - 1', 'move')} FROM marks"""))
def w07(spark, sf):
    return report(B.day_move(V.equity(spark, sf)), "account", "day", "move")


VIEWS["alloc_grid"] = """
 SELECT account, day, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY account ORDER BY day), 200000) AS eq
 FROM (SELECT * FROM (SELECT DISTINCT account FROM marks) CROSS JOIN (SELECT DISTINCT day FROM marks))
 LEFT JOIN marks USING (account, day) """
VIEWS["alloc"] = """
 SELECT *, coalesce(abs(weight - lag(weight) OVER (PARTITION BY account ORDER BY day)) / 2, 0) AS moved FROM (
   SELECT *, CASE WHEN sum(score) OVER (PARTITION BY day) > 0 THEN score / sum(score) OVER (PARTITION BY day)
                  ELSE 1e0 / count(*) OVER (PARTITION BY day) END AS weight FROM (
     SELECT *, CASE WHEN count(ret) OVER b >= 5
         THEN greatest(coalesce(avg(ret) OVER b / nullif(stddev_samp(ret) OVER b, 0), 0), 0) ELSE 0 END AS score FROM (
       SELECT *, coalesce(eq / lag(eq) OVER (PARTITION BY account ORDER BY day) - 1, 0) AS ret FROM alloc_grid )
     WINDOW b AS (PARTITION BY account ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))) """
VIEWS["alloc_days"] = """
 SELECT day, turnover, round(200000 * product((1 + gain) * (1 - turnover * 2e-3)) OVER (ORDER BY day), 2) AS equity FROM (
   SELECT day, sum(weight * ret) AS gain, sum(moved) AS turnover FROM alloc GROUP BY 1) """


@query("w06_allocator_weights", with_views("alloc", f"""
 SELECT CAST(day AS VARCHAR) AS day, account, {rs('ret weight moved')} FROM alloc"""))
def w06_weights(spark, sf):
    return report(B.allocator_weights(V.equity(spark, sf)))


@query("w06_allocator", with_views("alloc_days", f"""
 SELECT CAST(day AS VARCHAR) AS day, {r('turnover')}, {r('equity', places=2)} FROM alloc_days"""))
def w06(spark, sf):
    return report(B.allocator(V.equity(spark, sf)), "day", "turnover", "equity", equity=2)


DESKS = [f"A{i}" for i in range(21)]
WEIGHT = "CAST(round(max(weight) FILTER (WHERE account = '{a}'), 3) AS DOUBLE) AS w_{a}"


@query("w06_allocator_table", with_views("alloc alloc_days", f"""
 SELECT CAST(d.day AS VARCHAR) AS day, {r('d.equity', 'equity', 2)}, w.* EXCLUDE (day) FROM alloc_days d
 JOIN (SELECT day, {', '.join(WEIGHT.format(a=a) for a in DESKS)} FROM alloc GROUP BY 1) w ON w.day = d.day"""))
def w06_table(spark, sf):
    return report(B.allocator_table(V.equity(spark, sf), DESKS), equity=2)


@query("j15_all_trades", with_views("ledger", f"""
 SELECT product AS account, symbol, side, qty, {r('price')}, order_id, line FROM ledger"""))
def j15(spark, sf):
    fills = V.ledger(spark, sf).select("symbol", "side", "qty", "price", "order_id", "line", "product")
    books = {p: fills.filter(F.col("product") == p).drop("product") for p in ("delivery", "intraday", "option")}
    return report(B.all_children(books), "account", "symbol", "side", "qty", "price", "order_id", "line")


VIEWS["summaries"] = """
 SELECT account, round(coalesce(eq, cash), 2) AS equity, round(100 * (coalesce(eq, cash) / 200000 - 1), 3) AS return_pct,
        round(cash, 2) AS cash, coalesce(open_positions, 0) AS open_positions, coalesce(closed, 0) AS closed_trades,
        round(100 * won / nullif(closed, 0), 1) AS win_rate_pct, round(coalesce(paid, 0), 2) AS costs_paid,
        CASE account WHEN 'A7' THEN 20e0 ELSE 10e0 END AS goal_pct,
        round(100 * (coalesce(eq, cash) / 200000 - 1) / CASE account WHEN 'A7' THEN 20e0 ELSE 10e0 END * 100, 1) AS goal_progress_pct
 FROM purses
 LEFT JOIN (SELECT account, arg_max(equity, (time, seq)) AS eq FROM equity GROUP BY 1) USING (account)
 LEFT JOIN (SELECT account, count(*) FILTER (WHERE side = 'SELL') AS closed,
       count(*) FILTER (WHERE side = 'SELL' AND pnl > 0) AS won, sum(costs) AS paid FROM fills_done GROUP BY 1) USING (account)
 LEFT JOIN (SELECT account, count(*) AS open_positions FROM held_now GROUP BY 1) USING (account) """


def summaries(spark, sf):
    totals = holding_totals(spark, sf)
    purses = B.cash_from_totals(totals).withColumn("start_cash", F.lit(200000.0))
    own = spark.createDataFrame([("A7", 20.0)], "account string, target_pct double")
    return R.account_summary(purses, totals, V.equity(spark, sf), B.open_positions(totals), own)


SUMMARY_NUMBERS = "equity return_pct cash win_rate_pct costs_paid goal_pct goal_progress_pct"


@query("a04_account_summary", with_views("summaries", f"""
 SELECT account, open_positions, closed_trades, {rs(SUMMARY_NUMBERS, 3)} FROM summaries"""))
def a04(spark, sf):
    return report(summaries(spark, sf), "account", "open_positions", "closed_trades", *SUMMARY_NUMBERS.split(), places=3)


@query("a04_holdings", with_more("fills_done held_now supply_prices", """
 until AS (SELECT account, symbol, arg_max(CAST(CAST(time AS DATE) + CAST(qty AS INTEGER) AS VARCHAR), nth)
             FILTER (WHERE side = 'BUY' AND qty_after = units) AS exit_on FROM fills_done WHERE product = 'delivery' GROUP BY 1, 2)""", f"""
 SELECT account, symbol, qty, {r('avg_price', places=2)}, {r('coalesce(price, avg_price)', 'last', 2)}, exit_on
 FROM held_now LEFT JOIN supply_prices USING (symbol) LEFT JOIN until USING (account, symbol)"""))
def a04_holdings(spark, sf):
    dated = V.ledger(spark, sf).withColumn("exit_on", F.when(
        F.col("product") == "delivery", F.date_add(F.to_date("time"), F.col("qty").cast("int"))))
    held = B.positions_from_ledger(B.fold_ledger(dated, list(FILL_ORDER)), list(FILL_ORDER))
    return report(R.holdings_report(B.value_positions(held, supply_prices(spark, sf))), places=2)


@query("r06_goal_progress", with_views("summaries", f"""
 SELECT account, {rs('goal_pct goal_progress_pct', 1)} FROM summaries"""))
def r06(spark, sf):
    return report(summaries(spark, sf), "account", "goal_pct", "goal_progress_pct", places=1)


@query("k02_leaderboard", with_views("summaries", f"""
 SELECT account, {rs('return_pct equity', 3)}, row_number() OVER (ORDER BY return_pct DESC, account) AS place FROM summaries"""))
def k02(spark, sf):
    from pyspark.sql import Window as W
    board = R.leaderboard(summaries(spark, sf))
    board = board.withColumn("place", F.row_number().over(W.orderBy(F.col("return_pct").desc(), "account")))
    return report(board, "account", "return_pct", "equity", "place", places=3)


@query("k03_recent_trades", with_views("ledger", """
 SELECT account, symbol, side, CAST(time AS VARCHAR)[1:10] AS day, order_id, line FROM ledger
 ORDER BY time DESC, order_id DESC, line DESC, part DESC, value DESC LIMIT 25"""))
def k03(spark, sf):
    t = R.recent_trades(V.ledger(spark, sf), list(FILL_ORDER)).withColumn("day", F.to_date("time"))
    return report(t, "account", "symbol", "side", "day", "order_id", "line")


@query("r03_summary_document", with_views("summaries alloc_days", """
 SELECT account, CAST(to_json({account: account, equity: equity, return_pct: return_pct, open_positions: open_positions,
   closed_trades: closed_trades, win_rate_pct: win_rate_pct, goal_pct: goal_pct, goal_progress_pct: goal_progress_pct})
   AS VARCHAR) AS doc FROM summaries
 UNION ALL SELECT NULL, CAST(to_json({updated: '1998-08-02T15:30:00', picks_asof: '1998-08-01', start_cash: 200000e0,
   goal: {target_pct: 10e0, "by": '2026-10-31'}, combined: {date: CAST(max(day) AS VARCHAR), equity: arg_max(equity, day)}})
   AS VARCHAR) FROM alloc_days"""))
def r03(spark, sf):
    accounts = R.summary_document(summaries(spark, sf).select(
        "account", "equity", "return_pct", "open_positions", "closed_trades", "win_rate_pct", "goal_pct", "goal_progress_pct"))
    head = R.summary_head(B.allocator(V.equity(spark, sf)), "1998-08-02T15:30:00", "1998-08-01")
    return accounts.unionByName(head, allowMissingColumns=True)


@query("r04_report_lines", with_views("summaries", """
 SELECT account, '| ' || concat_ws(' | ', account, format('{:,.0f}', equity),
   CASE WHEN return_pct >= 0 THEN '+' ELSE '' END || format('{:,.2f}', return_pct) || '%', CAST(closed_trades AS VARCHAR),
   coalesce(format('{:.0f}', win_rate_pct) || '%', '-'), format('{:,.0f}', costs_paid)) || ' |' AS line FROM summaries"""))
def r04(spark, sf):
    return R.report_rows(summaries(spark, sf)).select("account", "line")


@query("r04_profit_lines", with_views("profits", """
 SELECT account, '| ' || concat_ws(' | ', account, CASE WHEN profit_rs >= 0 THEN '+' ELSE '' END || format('{:,.0f}', profit_rs),
   CASE WHEN profit_pct >= 0 THEN '+' ELSE '' END || format('{:,.2f}', profit_pct) || '%') || ' |' AS line
 FROM profits WHERE day = (SELECT max(day) FROM profits)
 UNION ALL
 SELECT account, account || ' Rs ' || CASE WHEN avg(profit_rs) >= 0 THEN '+' ELSE '' END || format('{:,.0f}', avg(profit_rs))
 FROM profits GROUP BY account"""))
def r04_profit(spark, sf):
    daily = B.daily_profit(V.equity(spark, sf))
    lines = R.profit_rows(B.latest_day_profit(daily)).select("account", "line")
    return lines.unionByName(R.average_rows(B.profit_stats(daily)).select("account", "line"))


@query("r04_combined_line", with_views("alloc_days", """
 SELECT 'Combined allocator (virtual): Rs ' || format('{:,.0f}', arg_max(equity, day)) || ' ('
   || CASE WHEN arg_max(equity, day) >= 200000 THEN '+' ELSE '' END
   || format('{:,.2f}', 100 * (arg_max(equity, day) / 200000 - 1)) || '%).' AS line FROM alloc_days"""))
def r04_combined(spark, sf):
    return R.combined_line(B.allocator(V.equity(spark, sf)))


SIGNED = "CASE WHEN {x} >= 0 THEN '+' ELSE '' END || format('{{:,.{n}f}}', {x})"
VIEWS["alert_rows"] = f"""
 SELECT strftime(time, '%Y-%m-%dT%H:%M:%S') || '|' || account || '|' || side || '|' || symbol AS id, 'trade' AS kind, account,
        account || ': ' || side || ' ' || units || ' ' || symbol || ' at ' || format('{{:,.2f}}', price) || ' (' || reason
        || ')' || coalesce(', P&L Rs ' || {SIGNED.format(x='pnl', n=0)}, '') AS text
 FROM fills_done
 UNION ALL
 SELECT '2001-12-31|' || h.account || '|' || h.symbol || '|' || CAST(round(price / avg_price - 1, 2) AS VARCHAR), 'move', h.account,
        h.account || ': ' || h.symbol || ' is ' || {SIGNED.format(x='(100 * (price / avg_price - 1))', n=1)} || '% since entry'
 FROM held_now h JOIN supply_prices p ON h.symbol = p.symbol WHERE abs(price / avg_price - 1) >= 2e-2
 UNION ALL
 SELECT CAST(day AS VARCHAR) || '|' || account || '|day|' || CAST(round(close / open - 1, 2) AS VARCHAR), 'account', account,
        account || ' account ' || {SIGNED.format(x='(100 * (close / open - 1))', n=1)} || '% today (Rs '
        || format('{{:,.0f}}', close) || ')' FROM marks WHERE abs(close / open - 1) >= 2e-2 """


@query("r05_alerts", with_views("alert_rows held_now", """
 SELECT id, kind, account, min(text) AS text FROM alert_rows
 WHERE id NOT IN (SELECT '2001-12-31|' || account || '|' || symbol || '|-0.5' FROM held_now) GROUP BY 1, 2, 3"""))
def r05(spark, sf):
    # the fills are folded once, for trades, moves and what is seen
    done = saved(fills_done(spark, sf).select(*FILL_ORDER, "account", "symbol", "side", "units", "price", "reason", "pnl", "product", "qty_after", "avg_after"))
    held = saved(B.positions_from_ledger(done, list(FILL_ORDER)))
    now = F.lit("2001-12-31").cast("timestamp_ntz")
    seen = held.select(F.concat_ws("|", F.lit("2001-12-31"), "account", "symbol", F.lit("-0.5")).alias("id"))
    found = R.alerts(R.trade_alerts(done), R.move_alerts(held, supply_prices(spark, sf), now),
                     R.account_alerts(V.equity(spark, sf)), seen=seen)
    return found.select("id", "kind", "account", "text")


# --- price history ---

VIEWS["log_returns"] = """
 SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS lr FROM daily """


@query("a13_annual_vol", with_views("log_returns", f"""
 SELECT symbol, {r('CASE WHEN count(lr) > 10 THEN stddev_samp(lr) * sqrt(252) ELSE 2e-1 END', 'vol')} FROM (
   SELECT *, row_number() OVER (PARTITION BY symbol, lr IS NULL ORDER BY date DESC) AS k FROM log_returns)
 WHERE k <= 60 GROUP BY symbol"""))
def a13(spark, sf):
    return report(B.annual_vol(V.daily(spark, sf)))


@query("a13_running_vol", with_views("log_returns", f"""
 SELECT symbol, CAST(date AS VARCHAR) AS date, {r('CASE WHEN count(lr) OVER w > 10 THEN stddev_samp(lr) OVER w * sqrt(252) ELSE 2e-1 END', 'vol')}
 FROM log_returns WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""))
def a13_running(spark, sf):
    return report(B.running_vol(V.daily(spark, sf)), "symbol", "date", "vol")


@query("w05_trend_flag", with_views("daily", f"""
 SELECT symbol, CAST(date AS VARCHAR) AS date, {r('avg(close) OVER w', 'mean', 4)},
        count(*) OVER (PARTITION BY symbol ORDER BY date) > 200 AND close > avg(close) OVER w AS above
 FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)"""))
def w05(spark, sf):
    return report(B.trend_flag(V.daily(spark, sf)), "symbol", "date", "mean", "above", mean=4)


@query("w08_day_open", with_views("ticks", f"""
 SELECT symbol, CAST(date AS VARCHAR) AS date, {r('arg_min(price, (ts, seq))', 'open')} FROM ticks
 WHERE CAST(ts AS TIME) >= TIME '09:15:00' GROUP BY symbol, date"""))
def w08(spark, sf):
    return report(B.day_open(V.ticks(spark, sf)))


@query("w09_every_third_tick", with_views("ticks", """
 SELECT symbol, seq, nth FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS nth FROM ticks)
 WHERE nth % 3 = 0"""))
def w09(spark, sf):
    return L.every_nth(V.ticks(spark, sf), 3, "symbol").select("symbol", "seq", "nth")


# --- files written and read back ---

@query("s01_bar_files", with_views("bars", f"""
 SELECT lpad(regexp_replace(symbol, '[^0-9]', '', 'g'), 7, '0') AS symbol, CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS date,
        strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS ts, {rs('open high low close volume')} FROM bars"""))
def s01(spark, sf):
    path = scratch_path(spark, "bars")
    digits = F.lpad(F.regexp_replace("symbol", "[^0-9]", ""), 7, "0")          # folder names that look like numbers
    SB.write_bars(V.bars(spark, sf).drop("date", "bar").withColumn("symbol", digits), path)
    return report(SB.read_bars(spark, path), "symbol", "date", "ts", "open", "high", "low", "close", "volume")


@query("s05_latest_snapshot", with_views("scores", f"SELECT list, symbol, {r('score')} FROM scores WHERE score >= 950"))
def s05(spark, sf):
    root = scratch_path(spark, "snapshots")
    scores = V.scores(spark, sf)
    scores.filter("score < 950").write.parquet(f"{root}/asof_1.parquet")
    scores.filter("score >= 950").write.parquet(f"{root}/asof_2.parquet")
    return report(SB.latest_snapshot(spark, f"{root}/asof_*.parquet"), "list", "symbol", "score")


@query("s06_export_ranks", with_views("scores", f"""
 SELECT symbol, {r('round(CAST((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER () AS DECIMAL(18, 12)), 4)', 'rank_pct', 4)} FROM scores"""))
def s06_ranks(spark, sf):
    return report(P.export_picks(V.scores(spark, sf))[1], places=4)


@query("s04_model_maps", with_views("pick_lists", f"""
 SELECT list AS source, NULL AS account, symbol, 'wait' AS name, {r('wait', 'value')} FROM pick_lists
 UNION ALL SELECT list, 'desk ' || list, symbol, 'pred', {r('expected', 'value')} FROM pick_lists
 UNION ALL SELECT list, 'desk ' || list, symbol, 'age', {r('size', 'value')} FROM pick_lists
 UNION ALL SELECT list, 'desk ' || list, symbol, 'gain', {r('round(score / 1000, 6)', 'value')} FROM pick_lists
 UNION ALL SELECT list, 'desk ' || list, symbol, 'rank', {r('pos', 'value')} FROM pick_lists
 UNION ALL SELECT list, NULL, NULL, 'min_age', {r('min(size)', 'value')} FROM pick_lists GROUP BY list
 UNION ALL SELECT list, NULL, NULL, 'margin', {r('max(wait)', 'value')} FROM pick_lists GROUP BY list"""))
def s04_maps(spark, sf):
    def by_symbol(value):
        return F.map_from_entries(F.collect_list(F.struct("symbol", value)))

    def by_desk(value):
        return F.create_map(F.concat(F.lit("desk "), F.col("source")), by_symbol(value))

    path = scratch_path(spark, "model-picks")
    inputs = F.create_map(F.lit("gain"), F.round(F.col("score") / 1000, 6), F.lit("rank"), F.col("pos").cast("double"))
    (V.pick_lists(spark, sf).withColumnRenamed("list", "source").groupBy("source").agg(
        by_symbol(F.col("wait")).alias("entry_wait"),
        by_desk(F.struct(F.col("expected").alias("pred"), F.col("size").cast("int").alias("age"))).alias("exit_scores"),
        F.struct(F.min("size").cast("int").alias("min_age"), F.max("wait").alias("margin")).alias("exit_rule"),
        by_desk(inputs).alias("exit_inputs")).write.json(path))
    wait, scores, rule, features = P.read_model_maps(spark, f"{path}/*.json", one_per_line=True)
    none = F.lit(None).cast("string")

    def rows(df, account, symbol, *names):
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
        return df.select("source", account.alias("account"), symbol.alias("symbol"), F.inline(pairs))

    desk, symbol = F.col("account"), F.col("symbol")
    out = rows(wait, none, symbol, "wait").unionByName(rows(scores, desk, symbol, "pred", "age")).unionByName(
        rows(rule, none, none, "min_age", "margin")).unionByName(features.select("source", "account", "symbol", "name", "value"))
    return report(out)


@query("s04_pick_files", with_views("pick_lists", f"""
 SELECT list AS source, symbol, pos, {r('round(score, 6)', 'score')}, {r('round(rank_pct, 4)', 'rank_pct', 4)} FROM pick_lists"""))
def s04(spark, sf):
    path = scratch_path(spark, "picks")
    docs, _ = P.export_picks(V.scores(spark, sf), by=["list"])
    P.write_picks(docs, path, "1998-06-01", "X", F.col("list"))
    top, _, _ = P.read_picks(spark, f"{path}/*.json", schema=P.PICKS_SCHEMA, one_per_line=True)
    return report(top, "source", "symbol", "pos", "score", "rank_pct", rank_pct=4)


@query("s07_account_documents", with_views("purses held_now", f"""
 SELECT account, {r('cash', places=2)}, symbol, qty, {r('avg_price', places=4)}, strftime(opened, '%Y-%m-%d %H:%M:%S') AS opened
 FROM purses LEFT JOIN held_now USING (account)"""))
def s07(spark, sf):
    path = scratch_path(spark, "accounts")
    totals = holding_totals(spark, sf)
    held = B.open_positions(totals).select("account", F.create_map("symbol", F.struct(
        "symbol", "qty", "avg_price", F.date_format("opened", "yyyy-MM-dd'T'HH:mm:ss").alias("opened"), "product"))
        .alias("positions"))                                      # one line per holding
    (B.cash_from_totals(totals).join(held, "account", "left")
     .select(F.col("account").alias("name"), "cash", F.lit(200000.0).alias("start_cash"), "positions").write.json(path))
    t = A.read_accounts(spark, path)
    out = t["accounts"].join(t["positions"], "account", "left")
    return report(out, "account", "cash", "symbol", "qty", "avg_price", "opened", cash=2, avg_price=4)


CSV = "account string, symbol string, side string, qty bigint, price double, reason string"


@query("s09_trade_csv", with_views("ledger", f"""
 SELECT account, symbol, side, qty, {r('price', places=4)}, 'said "' || reason || '", then' AS reason FROM ledger"""))
def s09(spark, sf):
    path = scratch_path(spark, "trades")
    trades = V.ledger(spark, sf).select("account", "symbol", "side", "qty", "price", F.concat(
        F.lit('said "'), F.col("reason"), F.lit('", then')).alias("reason"))
    SR.write_reports({"trades": trades}, path)
    return report(SR.read_trades_csv(spark, f"{path}/trades", CSV), price=4)


@query("s08_report_files", with_views("profits", f"""
 SELECT account, CAST(day AS VARCHAR) AS day, {rs('profit_rs profit_pct', 3)} FROM profits"""))
def s08(spark, sf):
    path = scratch_path(spark, "reports")
    daily = B.daily_profit(V.equity(spark, sf)).select("account", F.col("day").cast("string"), "profit_rs", "profit_pct")
    SR.write_reports({"daily_profit": daily, "summary": daily.groupBy("account").agg(F.sum("profit_rs").alias("total"))}, path)
    back = spark.read.csv(f"{path}/daily_profit", header=True,
                          schema="account string, day string, profit_rs double, profit_pct double")
    return report(back, places=3)


@query("s10_append_once_log", """
 SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN 'first' ELSE 'second' END AS batch FROM orders""")
def s10(spark, sf):
    log = scratch_path(spark, "alerts")
    rows = V.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus")
    SR.append_new(rows.filter("o_orderstatus = 'F'").select("id", F.lit("first").alias("batch")), log)
    SR.append_new(rows.select("id", F.lit("second").alias("batch")), log)
    return SR.read_log(spark, log, "id string, batch string")


@query("s10_log_of_two_writers", """
 SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(CAST(ts AS DATE) AS VARCHAR) || '|' || user_id || '|' || event_type AS id
 FROM events""")
def s10_writers(spark, sf):
    """Two writers append overlapping halves of all alerts to one log at the same time."""
    log = scratch_path(spark, "alerts")
    day = F.to_date("ts").cast("string")
    e = V.table(spark, sf, "events")
    alerts = e.select("event_id", day.alias("day"), F.concat_ws("|", day, F.col("user_id").cast("string"), "event_type").alias("id"))
    halves = [alerts.filter(F.col("event_id") % 3 != n).drop("event_id") for n in (0, 1)]
    with ThreadPoolExecutor(len(halves)) as writers:
        list(writers.map(inheritable_thread_target(spark)(lambda half: SR.append_once(half, log)), halves))
    return SR.read_once(spark, log, halves[0].schema)
