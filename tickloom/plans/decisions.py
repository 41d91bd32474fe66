"""Registered queries: which holdings leave, which candidates enter."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import books as B
from tickloom.operators import costs as K
from tickloom.operators import filters as L
from tickloom.operators import learning as M
from tickloom.operators import rules as U
from tickloom.plans import views as V
from tickloom.plans.pricing import (measured, sql_cdf, sql_charges, sql_exit_cost, sql_round_trip)
from tickloom.plans.registry import query, r, report, rs
from tickloom.plans.views import VIEWS, with_more, with_views
from tickloom.session import ship_functions

ship_functions(__name__)

LINE = "account, order_id, line, symbol, avg_price"
LINE_COLUMNS = ("account", "order_id", "line", "symbol", "avg_price")
MOVE = "(price / avg_price - 1)"
PERCENT = f"CASE WHEN {MOVE} >= 0 THEN '+' ELSE '' END || format('{{:,.2f}}', 100 * {MOVE}) || '%'"
CLOCK = "CAST(now AS TIME)"


def sell_sql(views: str, source: str, cases: str, extra: str = "") -> str:
    """Rows of `source` (which ends in holdings columns) with the first reason that applies."""
    return with_views(views, f"""
 SELECT account, order_id, line, symbol, {r('avg_price')}, reason{extra} FROM (
   SELECT *, CASE WHEN price IS NULL THEN NULL {cases} END AS reason FROM ({source})) WHERE reason IS NOT NULL""")


def sold(df, *more):
    return report(df, *LINE_COLUMNS, "reason", *more)


@query("d01_exits_due", sell_sql("holdings", "SELECT * FROM holdings",
                                 "WHEN exit_on <= CAST(now AS DATE) THEN 'holding period elapsed'"))
def d01(spark, sf):
    return sold(U.exits_due(V.holdings(spark, sf)))


WANTED = "(SELECT symbol FROM ranks WHERE rank_pct >= 0.6)"


def wanted(spark, sf):
    return V.ranks(spark, sf).filter("rank_pct >= 0.6")


def same_day(spark, sf):
    """Holdings opened today: those of even orders, so that the day's own rules get to speak."""
    h = V.holdings(spark, sf)
    return h.withColumn("opened", F.when(F.col("order_id") % 2 == 0, F.col("now")).otherwise(F.col("opened")))


VIEWS["same_day"] = """
 SELECT * REPLACE (CASE WHEN order_id % 2 = 0 THEN now ELSE opened END AS opened) FROM holdings """


@query("d02_exits_intraday", sell_sql("same_day ranks", f"SELECT *, symbol IN {WANTED} AS wanted FROM same_day", f"""
     WHEN CAST(opened AS DATE) < CAST(now AS DATE) THEN 'missed close; sold next session'
     WHEN {CLOCK} >= TIME '15:05:00' THEN 'intraday hard exit'
     WHEN {MOVE} >= 2e-2 THEN 'target hit ' || {PERCENT} WHEN {MOVE} <= -15e-3 THEN 'stop loss ' || {PERCENT}
     WHEN NOT wanted THEN 'model dropped it ' || {PERCENT}"""))
def d02(spark, sf):
    return sold(U.exits_intraday(same_day(spark, sf), wanted(spark, sf)))


@query("d03_exits_rank", sell_sql("holdings ranks", "SELECT h.*, rank_pct FROM holdings h LEFT JOIN ranks USING (symbol)",
                                  "WHEN coalesce(rank_pct, 0) < 75e-2 THEN 'fell out of the top 25%'"))
def d03(spark, sf):
    return sold(U.exits_rank(V.holdings(spark, sf), V.ranks(spark, sf)))


AGE = "CAST(greatest(trunc((CAST(now AS DATE) - CAST(opened AS DATE)) * 5 / 7), 0) AS BIGINT)"


@query("d04_exits_cost_aware", sell_sql(
    "holdings ranks", f"""SELECT h.*, 11e-3 * (coalesce(rank_pct, 0) - 5e-1) / 5e-1 AS gross, {AGE} AS sessions,
      {sql_exit_cost('qty * price')} AS cost FROM holdings h LEFT JOIN ranks USING (symbol) WHERE product <> 'intraday'""",
    f"""WHEN {MOVE} <= -25e-2 THEN 'down ' || format('{{:,.0f}}', 100 * ({MOVE})) || '% from entry; selling regardless of rank'
        WHEN sessions < 63 AND gross < -cost THEN 'deteriorated after ' || sessions || ' sessions, not merely gone quiet'
        WHEN sessions >= 63 AND gross <= cost THEN 'held ' || sessions || ' sessions; expected return no longer covers selling'""", ", sessions"))
def d04(spark, sf):
    return sold(U.exits_cost_aware(V.holdings(spark, sf), V.ranks(spark, sf)), "sessions")


VIEWS["policies"] = """
 SELECT 'C' || g AS account, g % 5 <> 0 AS fresh, g % 4 = 0 AS wild, g % 2 = 0 AS uses_exit_model, g % 7 = 0 AS retired,
        g % 6 = 0 AS holds_funds, CASE WHEN g % 3 = 0 THEN 8 END AS min_age, CASE WHEN g % 3 = 0 THEN 5e-2 END AS margin
 FROM range(21) t(g) """


def policies(spark, sf):
    """Rules of the 21 accounts that appear in the holdings, one row each."""
    g = F.substring("account", 2, 9).cast("int")
    return V.holdings(spark, sf).select("account").distinct().select(
        "account", (g % 5 != 0).alias("fresh"), (g % 4 == 0).alias("wild"), (g % 2 == 0).alias("uses_exit_model"),
        (g % 7 == 0).alias("retired"), (g % 6 == 0).alias("holds_funds"),
        F.when(g % 3 == 0, 8).alias("min_age"), F.when(g % 3 == 0, 0.05).alias("margin"))


SIGNED_EXPECTED = "CASE WHEN expected >= 0 THEN '+' ELSE '' END || format('{:,.2f}', 100 * expected)"


@query("d05_exits_model", sell_sql(
    "holdings ranks policies", f"""SELECT h.*, p.* EXCLUDE (account), (rank_pct - 5e-1) * 1e-1 AS expected,
      {sql_exit_cost('qty * price')} AS cost FROM holdings h JOIN policies p USING (account) LEFT JOIN ranks USING (symbol)""",
    f"""WHEN NOT wild AND {MOVE} <= -25e-2 THEN 'disaster stop ' || format('{{:,.1f}}', 100 * ({MOVE})) || '%' WHEN NOT fresh THEN NULL
        WHEN uses_exit_model AND age >= CASE WHEN wild THEN 0 ELSE coalesce(min_age, 10) END
         AND pred < -CASE WHEN wild THEN 0 ELSE coalesce(margin, 2e-2) END THEN 'model exit model: switching expected to beat holding by ' || format('{{:,.2f}}', -100 * pred)
           || '% over 10 sessions (held ' || age || ' sessions)'
        WHEN expected IS NULL THEN 'model exit: no longer scored'
        WHEN expected <= cost THEN 'model exit: expects ' || {SIGNED_EXPECTED} || '%, selling costs ' || format('{{:,.2f}}', 100 * cost) || '%'"""))
def d05(spark, sf):
    scored = V.ranks(spark, sf).select("symbol", ((F.col("rank_pct") - 0.5) * 0.1).alias("expected"))
    held = V.holdings(spark, sf).join(scored, "symbol", "left")
    policy = policies(spark, sf).select("account", "fresh", "wild", "uses_exit_model", "min_age", "margin")
    return sold(U.exits_model(held, policy))


# Symbols renamed so that some holdings are funds.
FUNDS = ("ETF", "BETA", "STEEL", "MOTORS", "BANK", "POWER", "CHEM", "TEXTILE", "GOLD", "FOODS")
VIEWS["named_holdings"] = f"""
 SELECT * REPLACE (symbol || {list(FUNDS)}[CAST(symbol[2:] AS BIGINT) % 10 + 1] || '.NS' AS symbol) FROM holdings """
WORDS = "ETF|BEES|LIQUID|LIQID|BETA|NEXT50|NIFTY|SENSEX|GOLD|SILVER|GILT|GSEC|IETF"


@query("d06_exits_forced", sell_sql(
    "named_holdings policies", f"""SELECT h.*, retired, holds_funds,
      regexp_matches(split_part(symbol, '.', 1), '{WORDS}', 'i') AS fund FROM named_holdings h JOIN policies USING (account)""",
    f"""WHEN fund AND NOT holds_funds THEN 'not a company'
        WHEN retired AND {CLOCK} >= TIME '09:30:00' AND product <> 'entitlement' THEN 'account retired'"""))
def d06(spark, sf):
    words = F.element_at(F.array(*[F.lit(w) for w in FUNDS]),
                         (F.substring("symbol", 2, 12).cast("bigint") % 10 + 1).cast("int"))
    held = V.holdings(spark, sf).withColumn("symbol", F.concat(F.col("symbol"), words, F.lit(".NS")))
    return sold(U.exits_forced(held, policies(spark, sf).select("account", "retired", "holds_funds")))


# --- entries ---

def sql_fills(product: str = "'delivery'", floor: float = 0, stop: bool = False, key: str = "account", cash_floor: float = 0) -> str:
    """CTE `steps` over `offers` (key, nth, budget, fill, cash): units of each buy and the cash left after it."""
    value = "n * o.fill"
    fee = sql_charges("'buy'", product, value)["total"]
    paid = sql_charges("'buy'", product, "units * fill")["total"]
    small = f"least(o.budget, s.left_over) < {floor}"
    return f"""
 steps AS (
   SELECT {key}, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS units, max(cash) AS left_over, false AS stopped
   FROM offers GROUP BY {key}
   UNION ALL
   SELECT {key}, nth, units, CASE WHEN units > 0 THEN left_over - units * fill - {paid} ELSE left_over END, stopped FROM (
     SELECT {', '.join('o.' + k.strip() for k in key.split(','))}, o.nth, s.left_over, o.fill,
            s.stopped OR ({str(stop).lower()} AND {small}) OR s.left_over < {cash_floor} AS stopped,
            CASE WHEN s.stopped OR {small} OR s.left_over < {cash_floor} THEN 0 ELSE coalesce(list_max(list_filter(
              range(1, CAST(floor(least(o.budget, s.left_over) / o.fill) AS BIGINT) + 1),
              lambda n: {value} + {fee} <= s.left_over)), 0) END AS units
     FROM steps s JOIN offers o ON {' AND '.join(f'o.{k.strip()} = s.{k.strip()}' for k in key.split(','))}
       AND o.nth = s.nth + 1))"""


BOUGHT = f"""
 SELECT o.account, o.symbol, o.nth AS pos, s.units, {r('o.budget', 'budget', 3)}, {r('s.left_over', 'cash_after', 3)}
 FROM offers o JOIN steps s ON o.account = s.account AND o.nth = s.nth"""
NOT_HELD = "NOT EXISTS (SELECT 1 FROM book b WHERE b.account = a.account AND b.symbol = p.symbol)"
VIEWS["slots"] = "SELECT account, count(*) AS names, count(*) FILTER (WHERE product <> 'entitlement') AS traded FROM book GROUP BY 1 "
VIEWS["bought_back"] = """
 SELECT DISTINCT 'C' || l_orderkey AS account, 'P' || (l_partkey + 1) AS symbol,
        CASE WHEN l_linenumber % 2 = 0 THEN 'down -30% from entry; selling regardless of rank'
          ELSE 'deteriorated after 9 sessions, not merely gone quiet' END AS reason
 FROM lineitem WHERE l_returnflag = 'R' """


def bought(df):
    df = df.withColumn("pos", F.row_number().over(U.W.partitionBy("account").orderBy("pos")))
    return report(df, "account", "symbol", "pos", "units", "budget", "cash_after", places=3)


def bought_back(spark, sf, reasons=None):
    """What each account sold today and may not buy back: the neighbours of its returned parts."""
    today = V.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.concat(F.lit("C"), F.col("l_orderkey").cast("string")).alias("account"),
        F.concat(F.lit("P"), (F.col("l_partkey") + 1).cast("string")).alias("symbol"),
        F.lit("SELL").alias("side"), F.lit("1998-06-02 10:00:00").cast("timestamp_ntz").alias("time"),
        F.when(F.col("l_linenumber") % 2 == 0, "down -30% from entry; selling regardless of rank")
        .otherwise("deteriorated after 9 sessions, not merely gone quiet").alias("reason"))
    return L.barred(today, "1998-06-02", reasons)


def parts(spark, sf):
    """accounts, pick lists, prices and the open book."""
    return V.accounts(spark, sf), V.pick_lists(spark, sf), V.prices(spark, sf), V.book(spark, sf)


@query("d07_entries_topn", with_more("accounts pick_lists live_prices book slots", f"""
 first5 AS (SELECT * FROM (SELECT list, symbol, price, row_number() OVER (PARTITION BY list ORDER BY pos) AS k
            FROM pick_lists JOIN live_prices USING (symbol)) WHERE k <= 5),
 offers AS (SELECT a.account, p.symbol, a.cash, a.cash / count(*) OVER (PARTITION BY a.account) AS budget,
              price * 10015e-4 AS fill, row_number() OVER (PARTITION BY a.account ORDER BY k) AS nth
            FROM accounts a JOIN first5 p ON a.list = p.list LEFT JOIN slots s ON s.account = a.account
            WHERE cash >= 5000 AND coalesce(names, 0) < 5 AND {NOT_HELD}), {sql_fills()}""", BOUGHT))
def d07(spark, sf):
    a, picks, prices, book = parts(spark, sf)
    a = a.withColumn("now", F.lit("1998-06-02 10:30:00").cast("timestamp_ntz"))
    return bought(U.entries_topn(a, picks, prices, book, hold_days=5))


def sql_weights(group: str, source: str) -> str:
    """CTEs ending in `weighted` (group, pos, weight) over `source` (group, pos, score, rank_pct)."""
    return f"""
 edged AS (SELECT {group}, pos, CASE WHEN coalesce(stddev_samp(score) OVER t, 0) > 0
     THEN exp((score - avg(score) OVER t) / stddev_samp(score) OVER t) ELSE greatest(rank_pct - 5e-1, 1e-6) END AS e
   FROM {source} WINDOW t AS (PARTITION BY {group})),
 cap_steps AS (
   SELECT {group}, CAST(0 AS BIGINT) AS step, greatest(35e-2, 1e0 / count(*)) AS cap, list(pos ORDER BY pos) AS ps,
          list(e / total ORDER BY pos) AS w FROM (SELECT *, sum(e) OVER (PARTITION BY {group}) AS total FROM edged) GROUP BY 1
   UNION ALL
   SELECT {group}, step + 1, cap, ps, list_transform(w, lambda x: CASE WHEN x > cap THEN cap ELSE x
     + list_sum(list_transform(w, lambda z: greatest(z - cap, 0))) * x
     / CASE WHEN coalesce(list_sum(list_filter(w, lambda z: z <= cap)), 0) = 0 THEN 1
            ELSE list_sum(list_filter(w, lambda z: z <= cap)) END END)
   FROM cap_steps WHERE step < len(w)),
 weighted AS (SELECT {group}, pos, least(x / total, cap) AS weight FROM (
   SELECT {group}, cap, unnest(ps) AS pos, unnest(w) AS x, list_max(w) < 5e-2 AS all_small,
          CASE WHEN list_max(w) < 5e-2 THEN list_sum(w) ELSE list_sum(list_filter(w, lambda z: z >= 5e-2)) END AS total
   FROM cap_steps WHERE step = len(w)) WHERE all_small OR x >= 5e-2)"""


@query("d08_entries_confidence", with_more("accounts pick_lists live_prices book slots ranks", f"""
 room AS (SELECT * FROM (
   SELECT a.account, a.cash, p.symbol, p.pos, p.score, p.rank_pct, 8 - coalesce(names, 0) AS free,
          row_number() OVER (PARTITION BY a.account ORDER BY p.pos) AS k
   FROM accounts a JOIN pick_lists p ON a.list = p.list LEFT JOIN slots s ON s.account = a.account
   LEFT JOIN ranks q ON q.symbol = p.symbol
   WHERE cash >= 5000 AND coalesce(names, 0) < 8 AND coalesce(q.rank_pct, p.rank_pct) >= 75e-2 AND {NOT_HELD})
   WHERE k <= free),
 live AS (SELECT account, cash, symbol, k AS pos, score, rank_pct, price FROM room JOIN live_prices USING (symbol)),
 {sql_weights('account', 'live')},
 offers AS (SELECT l.account, l.symbol, cash, cash * weight AS budget, price * 10015e-4 AS fill,
              row_number() OVER (PARTITION BY l.account ORDER BY l.pos) AS nth
            FROM live l JOIN weighted g ON l.account = g.account AND l.pos = g.pos), {sql_fills()}""", BOUGHT))
def d08(spark, sf):
    a, picks, prices, book = parts(spark, sf)
    return bought(U.entries_confidence(a, picks, prices, book, V.ranks(spark, sf)))


VIEWS["measured_picks"] = """
 SELECT p.*, CASE WHEN s <= (SELECT min(x0) FROM segments) THEN (SELECT arg_min(y0, x0) FROM segments)
     WHEN s > (SELECT max(x0) FROM segments) THEN (SELECT arg_max(y0, x0) FROM segments)
     ELSE y0 + (y1 - y0) * (s - x0) / (x1 - x0) END AS net
 FROM (SELECT *, rank_pct - size / 100.0 AS s FROM pick_lists) p LEFT JOIN segments ON s > x0 AND s <= x1 """


def entries_intraday_sql(order: str) -> str:
    return with_more("accounts measured_picks live_prices book", f"""
 fresh AS (SELECT * FROM (
   SELECT a.account, a.cash, p.symbol, price, row_number() OVER (PARTITION BY a.account ORDER BY {order}) AS nth
   FROM accounts a JOIN measured_picks p ON a.list = p.list JOIN live_prices q ON q.symbol = p.symbol
   WHERE cash >= 5000 AND net >= 2 * 36e-4 AND {NOT_HELD}) WHERE nth <= greatest(floor(cash / 5000), 1)),
 offers AS (SELECT *, cash / count(*) OVER (PARTITION BY account) AS budget, price * 10015e-4 AS fill FROM fresh),
 {sql_fills("'intraday'")}""", BOUGHT)


def measured_picks(spark, sf, lists):
    picks = lists.withColumn("s", F.col("rank_pct") - F.col("size") / 100)
    return K.calibrate(picks, measured(spark, sf), "s")


@query("d09_entries_intraday", entries_intraday_sql("p.pos"))
def d09(spark, sf):
    a, lists, prices, book = parts(spark, sf)
    return bought(U.entries_intraday(a, measured_picks(spark, sf, lists), prices, book))


@query("d09_entries_by_edge", entries_intraday_sql("round(net, 12) DESC, p.pos"))
def d09_edge(spark, sf):
    a, lists, prices, book = parts(spark, sf)
    picks = measured_picks(spark, sf, lists).withColumn("expected_net", F.round("expected_net", 12))
    return bought(U.entries_intraday(a, picks, prices, book, by_edge=True))


@query("d10_entries_cost_aware", with_more("accounts pick_lists live_prices book ranks bought_back", f"""
 room AS (SELECT * FROM (
   SELECT a.account, a.cash, p.symbol, price, coalesce(q.rank_pct, p.rank_pct) AS rnk,
          row_number() OVER (PARTITION BY a.account ORDER BY p.pos) AS pos
   FROM accounts a JOIN pick_lists p ON a.list = p.list JOIN live_prices x ON x.symbol = p.symbol
   LEFT JOIN ranks q ON q.symbol = p.symbol
   WHERE cash >= 5000 AND {NOT_HELD} AND (a.account, p.symbol) NOT IN (SELECT (account, symbol) FROM bought_back WHERE reason LIKE 'down %'))
   WHERE pos <= 12),
 sizes AS (SELECT a.account, a.pos AS n, a.cash / a.pos AS ticket, avg(11e-3 * (b.rnk - 5e-1) / 5e-1) AS mean_gross,
             min(11e-3 * (b.rnk - 5e-1) / 5e-1) AS worst FROM room a JOIN room b ON a.account = b.account AND b.pos <= a.pos
           GROUP BY 1, 2, 3),
 good AS (SELECT *, (mean_gross - cost) * sqrt(n / (1 + (n - 1) * 35e-2)) AS score FROM (
            SELECT *, {sql_round_trip('ticket')} AS cost FROM sizes) WHERE ticket >= 5000 AND worst - cost >= 25e-2 * cost),
 size_of AS (SELECT account, arg_max(n, (score, -n)) AS n, arg_max(ticket, (score, -n)) AS ticket FROM good
             WHERE score > 0 GROUP BY 1),
 chosen AS (SELECT r.account, r.cash, symbol, price, pos, 11e-3 * (rnk - 5e-1) / 5e-1 - {sql_round_trip('ticket')} AS edge
            FROM room r JOIN size_of s ON r.account = s.account AND pos <= n
            WHERE 11e-3 * (rnk - 5e-1) / 5e-1 - {sql_round_trip('ticket')} >= 25e-2 * {sql_round_trip('ticket')}),
 live AS (SELECT *, greatest(30e-2, 1e0 / count(*) OVER (PARTITION BY account)) AS cap,
            row_number() OVER (PARTITION BY account ORDER BY edge DESC, symbol) - 1 AS above FROM chosen),
 levels AS (SELECT a.account, a.above, a.cap, (1 - a.above * a.cap) / sum(b.edge) AS level, max(b.edge) AS top
            FROM live a JOIN live b ON a.account = b.account AND b.above >= a.above GROUP BY 1, 2, 3),
 at_level AS (SELECT account, min(above) AS k, arg_min(level, above) AS level FROM levels WHERE top * level <= cap GROUP BY 1),
 offers AS (SELECT l.account, l.symbol, cash, price * 10015e-4 AS fill,
              cash * CASE WHEN k IS NULL OR above < k THEN cap ELSE edge * level END AS budget,
              row_number() OVER (PARTITION BY l.account ORDER BY pos) AS nth
            FROM live l LEFT JOIN at_level t ON t.account = l.account), {sql_fills(floor=5000)}""", BOUGHT))
def d10(spark, sf):
    a, picks, prices, book = parts(spark, sf)
    return bought(U.entries_cost_aware(a, picks, prices, book, V.ranks(spark, sf), bought_back(spark, sf, ["down "])))


VIEWS["funded"] = """
 SELECT a.*, a.cash + coalesce(held, 0) AS equity, CASE WHEN waits THEN 0e0 ELSE 2e0 END AS power FROM accounts a
 LEFT JOIN (SELECT b.account, sum(qty * coalesce(price, avg_price)) AS held FROM book b LEFT JOIN prices p
            ON b.symbol = p.symbol GROUP BY 1) h ON h.account = a.account """


def funded(a, prices, book):
    return B.account_equity(a, book, prices).drop("held").withColumn(
        "power", F.when(F.col("waits"), 0.0).otherwise(2.0))


@query("d11_entries_model", with_more("funded pick_lists live_prices prices book slots ranks bought_back", f"""
 ready AS (SELECT *, {sql_round_trip('ticket')} AS need FROM (
   SELECT f.*, CASE WHEN wild THEN 3 ELSE 6 END - coalesce(traded, 0) AS free,
          least(equity / CASE WHEN wild THEN 3 ELSE 6 END, cash / nullif(CASE WHEN wild THEN 3 ELSE 6 END - coalesce(traded, 0), 0)) AS ticket
   FROM funded f LEFT JOIN slots s ON s.account = f.account) WHERE free > 0 AND cash >= 5000 AND ticket >= 5000),
 open_to AS (SELECT a.*, p.symbol, p.pos, p.expected, p.wait, price,
     row_number() OVER (PARTITION BY a.account ORDER BY p.pos) AS slot,
     max(CASE WHEN p.expected <= need THEN 1 ELSE 0 END) OVER (PARTITION BY a.account ORDER BY p.pos) AS failed
   FROM ready a JOIN pick_lists p ON a.list = p.list JOIN live_prices q ON q.symbol = p.symbol
   WHERE {NOT_HELD} AND (a.account, p.symbol) NOT IN (SELECT (account, symbol) FROM bought_back)),
 chosen AS (SELECT * FROM open_to WHERE slot <= free AND failed = 0 AND NOT (waits AND wait > 0)),
 views_held AS (SELECT b.account, sum((rank_pct - 5e-1) * 1e-1) AS s, count(rank_pct) AS n FROM book b JOIN ranks USING (symbol) GROUP BY 1),
 refs AS (SELECT c.*, (sum(expected) OVER (PARTITION BY c.account) + coalesce(s, 0))
                      / (count(*) OVER (PARTITION BY c.account) + coalesce(n, 0)) AS ref
          FROM chosen c LEFT JOIN views_held h ON h.account = c.account),
 offers AS (SELECT account, symbol, cash, price * 10015e-4 AS fill, CASE WHEN power > 0 AND ref > 0
     THEN least(ticket * least(greatest(pow(expected / ref, power), 5e-1), CASE WHEN wild THEN 3e0 ELSE 16e-1 END),
                CASE WHEN wild THEN 1e0 ELSE 30e-2 END * equity) ELSE ticket END AS budget,
     row_number() OVER (PARTITION BY account ORDER BY pos) AS nth FROM refs), {sql_fills(floor=5000, stop=True)}""", BOUGHT))
def d11(spark, sf):
    a, picks, prices, book = parts(spark, sf)
    scored = V.ranks(spark, sf).select("symbol", ((F.col("rank_pct") - 0.5) * 0.1).alias("expected"))
    return bought(U.entries_model(funded(a, prices, book), picks, prices, book, bought_back(spark, sf), scored))


# --- cross-section reversion: every hour of the index day is a tick of twenty names ---

VIEWS["moves"] = """
 SELECT symbol, date, ts, close AS price, close / nullif(first_value(open) OVER (PARTITION BY symbol, date ORDER BY ts), 0) - 1 AS move
 FROM bars WHERE symbol <> '^IDX' """
VIEWS["section"] = """
 SELECT *, CASE WHEN names >= 8 AND sd > 0 THEN (move - mean) / sd END AS z FROM (
   SELECT *, avg(move) OVER t AS mean, stddev_samp(move) OVER t AS sd, count(move) OVER t AS names FROM moves
   WINDOW t AS (PARTITION BY ts)) """


def section(spark, sf):
    w = U.W.partitionBy("symbol", "date").orderBy("ts")
    bars = V.bars(spark, sf).filter(F.col("symbol") != V.INDEX)
    moves = bars.select("symbol", "date", "ts", F.col("close").alias("price"),
                        (F.try_divide("close", F.first("open").over(w)) - 1).alias("move"))
    return U.cross_section(moves, ["ts"], min_names=8)


@query("a12_cross_section", with_views("section", f"""
 SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, names, {rs('move mean sd z')} FROM section"""))
def a12(spark, sf):
    return report(section(spark, sf), "symbol", "ts", "names", "move", "mean", "sd", "z")


VIEWS["tick_accounts"] = """
 SELECT DISTINCT 'R' || isodow(ts) AS account, ts, 22000e0 + 6000 * isodow(ts) AS cash, 200000e0 AS equity FROM moves """


# Each tick's account holds the names that were up at the tick.
@query("d12_reversion_entries", with_more("section tick_accounts", f"""
 ready AS (SELECT a.*, coalesce(n, 0) AS held FROM tick_accounts a LEFT JOIN (
     SELECT ts, count(*) AS n FROM moves WHERE move > 1 GROUP BY 1) h ON h.ts = a.ts
   WHERE coalesce(n, 0) < 8 AND CAST(a.ts AS TIME) >= TIME '09:30:00' AND CAST(a.ts AS TIME) < TIME '15:05:00'),
 offers AS (SELECT * FROM (SELECT a.account, a.ts, s.symbol, cash, least(equity * 12e-2, cash) AS budget, price * 10015e-4 AS fill, held,
     (abs(z) - 25e-2) * sd AS gap, row_number() OVER (PARTITION BY a.account, a.ts ORDER BY (abs(z) - 25e-2) * sd DESC, s.symbol DESC) AS nth
   FROM ready a JOIN section s ON a.ts = s.ts WHERE z <= -1.5 AND sd >= 3e-3 AND (abs(z) - 25e-2) * sd >= 72e-4 AND move <= 1)
   WHERE nth <= 8 - held),
 {sql_fills("'intraday'", key='account, ts', cash_floor=5000)}""", f"""
 SELECT o.account, strftime(o.ts, '%Y-%m-%d %H:%M:%S') AS ts, o.symbol, s.units, {r('gap', 'expected')}, {r('s.left_over', 'cash_after', 3)}
 FROM offers o JOIN steps s ON o.account = s.account AND o.ts = s.ts AND o.nth = s.nth"""))
def d12(spark, sf):
    sec = section(spark, sf)
    day = F.weekday("ts") + 1
    accounts = sec.select("ts").distinct().select(
        F.concat(F.lit("R"), day.cast("string")).alias("account"), "ts", (22000.0 + 6000 * day).alias("cash"),
        F.lit(200000.0).alias("equity"), F.col("ts").alias("now"))
    held = sec.filter("move > 1").select(F.concat(F.lit("R"), day.cast("string")).alias("account"), "ts", "symbol")
    out = U.reversion_entries(sec, ["ts"], accounts, held)
    return report(out, "account", "ts", "symbol", "units", "expected", "cash_after", cash_after=3)


DAY_GAIN = ("CASE WHEN h.price / avg_price - 1 >= 0 THEN '+' ELSE '' END || "
            "format('{:,.2f}', 100 * (h.price / avg_price - 1)) || '%'")


@query("d12_reversion_exits", with_more("section moves", """
 held AS (SELECT 'R' AS account, ts, symbol, price, price / (1 + greatest(coalesce(move, 0), -9e-1) / 2) AS avg_price FROM moves),
 live AS (SELECT DISTINCT ts FROM section WHERE z IS NOT NULL)""", f"""
 SELECT account, symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, reason FROM (
   SELECT h.*, CASE WHEN CAST(h.ts AS TIME) >= TIME '15:05:00' THEN 'flat before the close'
     WHEN CAST(h.ts AS TIME) < TIME '09:30:00' OR live.ts IS NULL THEN NULL
     WHEN coalesce(z, 0) >= -25e-2 OR coalesce(mean - move, 0) <= 3e-3 THEN 'gap closed ' || {DAY_GAIN}
     WHEN h.price / avg_price - 1 <= -15e-3 THEN 'stop loss ' || {DAY_GAIN} END AS reason
   FROM held h LEFT JOIN live ON live.ts = h.ts LEFT JOIN section s ON s.ts = h.ts AND s.symbol = h.symbol AND z IS NOT NULL)
 WHERE reason IS NOT NULL"""))
def d12_exits(spark, sf):
    sec = section(spark, sf)
    moved = F.greatest(F.coalesce("move", F.lit(0.0)), F.lit(-0.9))
    held = sec.select(F.lit("R").alias("account"), "ts", F.col("ts").alias("now"), "symbol", "price", (F.col("price") / (1 + moved / 2)).alias("avg_price"))
    return report(U.reversion_exits(held, sec, ["ts"]), "account", "symbol", "ts", "reason")


# --- one-symbol holds and weekly options, on the long daily history ---

HELD = "volume > 30"


@query("d13_trend_hold", with_views("daily", f"""
 SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN above THEN 'BUY' ELSE 'SELL' END AS action FROM (
   SELECT *, {HELD} AS held, count(*) OVER (PARTITION BY symbol ORDER BY date) > 200 AND close > avg(close) OVER w AS above
   FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
 WHERE above <> held"""))
def d13(spark, sf):
    state = B.trend_flag(V.daily(spark, sf)).withColumns({
        "price": F.col("close"), "held": F.expr(HELD), "account": F.col("symbol")})
    return report(U.hold_rules(state, trend=True), "symbol", "date", "action")


@query("d13_buy_and_hold", with_views("daily", f"""
 SELECT symbol, CAST(date AS VARCHAR) AS date, 'BUY' AS action FROM daily WHERE NOT ({HELD})"""))
def d13_hold(spark, sf):
    state = V.daily(spark, sf).withColumns({"price": F.col("close"), "held": F.expr(HELD), "account": F.col("symbol")})
    return report(U.hold_rules(state), "symbol", "date", "action")


def d_terms(spot: str, strike: str, years: str, vol: str) -> tuple[str, str]:
    spread = f"nullif(greatest({vol}, 1e-4) * sqrt({years}), 0)"
    d1 = f"((ln({spot} / {strike}) + (65e-3 + 5e-1 * {vol} * {vol}) * {years}) / {spread})"
    return d1, f"({d1} - {spread})"


D1, D2 = d_terms("close", "strike", "3e0 / 365", "(vol * 115e-2)")
VIEWS["vols"] = """
 SELECT symbol, date, close, CASE WHEN count(lr) OVER w > 10 THEN stddev_samp(lr) OVER w * sqrt(252) ELSE 2e-1 END AS vol
 FROM log_returns WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) """
VIEWS["mondays"] = f"""
 SELECT *, close * {sql_cdf('d1')} - strike * exp(-65e-3 * 3e0 / 365) * {sql_cdf('d2')} AS premium FROM (
   SELECT *, {D1} AS d1, {D2} AS d2 FROM (
     SELECT *, nullif(round_even(close / 50, 0) * 50, 0) AS strike, date + 3 AS expiry FROM vols WHERE isodow(date) = 1)) """


def mondays(spark, sf):
    return U.option_entries(B.running_vol(V.daily(spark, sf)), 400000.0)


LOT_FEE = sql_charges("'buy'", "'option'", "n * 75 * fill")["total"]


@query("d14_option_entries", with_more("mondays", f"""
 offers AS (SELECT *, premium * 1005e-3 AS fill, CASE WHEN premium >= 5e-2 THEN least(400000, premium * 75 * 101e-2 + 60) ELSE 0 END AS budget FROM mondays)""", f"""
 SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(expiry AS VARCHAR) AS expiry, {r('strike')}, {r('premium', places=3)},
   CAST(75 * coalesce(list_max(list_filter(range(1, CAST(floor(budget / (fill * 75)) AS BIGINT) + 1),
     lambda n: n * 75 * fill + {LOT_FEE} <= 400000)), 0) AS BIGINT) AS units FROM offers"""))
def d14(spark, sf):
    return report(mondays(spark, sf), "symbol", "date", "expiry", "strike", "premium", "units", premium=3)


@query("d14_option_exits", with_views("mondays vols", f"""
 SELECT m.symbol, CAST(m.date AS VARCHAR) AS bought, CAST(v.date AS VARCHAR) AS date,
        {r('greatest(v.close - strike, 0)', 'premium', 3)}, {r('greatest(v.close - strike, 0) * 995e-3', 'fill', 3)}
 FROM mondays m JOIN vols v ON m.symbol = v.symbol AND v.date = m.expiry"""))
def d14_exits(spark, sf):
    buys = mondays(spark, sf).select("symbol", F.col("date").alias("bought"), "strike", "expiry", "vol")
    days = V.daily(spark, sf).select("symbol", "date", "close")
    held = buys.join(days.withColumn("expiry", F.col("date")), ["symbol", "expiry"])
    return report(U.option_exits(held), "symbol", "bought", "date", "premium", "fill", premium=3, fill=3)


@query("d16_live_exit_features", with_views("holdings", f"""
 SELECT order_id, line, {r('avg_price')}, symbol, {rs('gain peak')}, {r('(1 + gain) / nullif(1 + peak, 0) - 1', 'from_peak')} FROM (
   SELECT *, greatest(avg_price * (1 + age / 100.0) / avg_price - 1, gain, 0) AS peak FROM (
     SELECT *, p_retailprice / avg_price - 1 AS gain FROM holdings JOIN part ON symbol = 'P' || p_partkey WHERE p_size < 50))"""))
def d16(spark, sf):
    inputs = V.holdings(spark, sf).drop("price").withColumns({
        "base": F.col("avg_price"), "peak_px": F.col("avg_price") * (1 + F.col("age") / 100)})
    out = U.live_exit_features(inputs, V.prices(spark, sf)).withColumnRenamed("peak_gain", "peak")
    return report(out, "order_id", "line", "avg_price", "symbol", "gain", "peak", "from_peak")


LIVE_FEATURES = ("gain", "peak_gain", "from_peak")


def fixed_scorer():
    """Stands in for a trained exit model: one weighted sum per row."""
    return lambda f: 0.05 * f["gain"] - 0.4 * f["peak_gain"] + 0.2 * f["from_peak"]


@query("d05_live_exit_chain", with_more("holdings ranks policies live_prices", f"""
 asked AS (SELECT * EXCLUDE (price, pred) FROM (SELECT *, row_number() OVER (
   PARTITION BY account ORDER BY now, order_id, line, symbol, avg_price) AS nth FROM holdings) WHERE nth % 3 = 0),
 gains AS (SELECT a.*, price, price / avg_price - 1 AS gain,
   greatest(avg_price * (1 + age / 100.0) / avg_price - 1, price / avg_price - 1, 0) AS peak FROM asked a JOIN live_prices USING (symbol)),
 scored AS (SELECT g.*, p.* EXCLUDE (account), 5e-2 * gain - 4e-1 * peak + 2e-1 * ((1 + gain) / nullif(1 + peak, 0) - 1) AS pred,
   (rank_pct - 5e-1) * 1e-1 AS expected, {sql_exit_cost('qty * price')} AS cost
   FROM gains g JOIN policies p USING (account) LEFT JOIN ranks USING (symbol))""", f"""
 SELECT account, order_id, line, symbol, {r('avg_price')}, {r('pred')}, reason FROM (SELECT *, CASE
   WHEN NOT wild AND {MOVE} <= -25e-2 THEN 'disaster stop ' || format('{{:,.1f}}', 100 * ({MOVE})) || '%' WHEN NOT fresh THEN NULL
   WHEN uses_exit_model AND age >= CASE WHEN wild THEN 0 ELSE coalesce(min_age, 10) END
     AND pred < -CASE WHEN wild THEN 0 ELSE coalesce(margin, 2e-2) END
   THEN 'model exit model (live, at ' || format('{{:,.2f}}', price) || '): switching expected to beat holding by '
     || format('{{:,.2f}}', -100 * pred) || '% over 10 sessions (held ' || age || ' sessions)'
   WHEN expected IS NULL THEN 'model exit: no longer scored'
   WHEN expected <= cost THEN 'model exit: expects ' || {SIGNED_EXPECTED} || '%, selling costs ' || format('{{:,.2f}}', 100 * cost) || '%'
   END AS reason FROM scored) WHERE reason IS NOT NULL"""))
def d05_chain(spark, sf):
    """Every third tick of an account: features at the live price, the model's answer, the exits that follow from it."""
    # only what the features and rules read is put in order, and each of it once
    ticks = V.holdings(spark, sf).select("account", F.col("now").alias("ts"), F.struct("order_id", "line", "symbol", "avg_price").alias("seq"), "qty", "age")
    third = L.every_nth(ticks, 3).select("account", "seq.*", "qty", "age").withColumns({
        "base": F.col("avg_price"), "peak_px": F.col("avg_price") * (1 + F.col("age") / 100)})
    asked = U.live_exit_features(third, V.prices(spark, sf))
    scored = M.score_with(asked, fixed_scorer, LIVE_FEATURES).withColumn("live", F.lit(True))
    expected = V.ranks(spark, sf).select("symbol", ((F.col("rank_pct") - 0.5) * 0.1).alias("expected"))
    policy = policies(spark, sf).select("account", "fresh", "wild", "uses_exit_model", "min_age", "margin")
    return sold(U.exits_model(scored.join(expected, "symbol", "left"), policy), "pred")
