"""Registered queries: charges, fills, sizes, options and edges over whole order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import constants as C
from tickloom.functions import calendar as D
from tickloom.functions import money as M
from tickloom.functions import options as O
from tickloom.operators import costs as K
from tickloom.operators import rules as U
from tickloom.operators import sizing as Z
from tickloom.plans import views as V
from tickloom.plans.registry import query, r, report
from tickloom.plans.views import VIEWS, with_more, with_views
from tickloom.session import tasks_for

FILL_KEYS = "account, symbol, CAST(time AS VARCHAR)[1:10] AS day, order_id, line, part"
KEY_COLUMNS = ("account", "symbol", "day", "order_id", "line", "part")


# --- charges written out in SQL for the checks ---

def sql_rates(product: str, rates: dict) -> str:
    return f"CASE {product} " + " ".join(f"WHEN '{k}' THEN {float(v):e}" for k, v in rates.items()) + " END"


def sql_charges(side: str, product: str, value: str, broker: str = "'zerodha'") -> dict[str, str]:
    """SQL text of each charge; `side` is 'buy' or 'sell' in quotes, or a column."""
    v = f"({value})"
    fee = (f"(CASE WHEN {product} = 'option' THEN 20.0 WHEN {broker} = 'zerodha' THEN CASE WHEN {product} = 'delivery' "
           f"THEN 0.0 ELSE least(20e0, 3e-4 * {v}) END ELSE greatest(5e0, least(20e0, 1e-3 * {v})) END)")
    tax = (f"({v} * CASE lower({side}) WHEN 'buy' THEN {sql_rates(product, dict(delivery=1e-3, intraday=0, option=0))} "
           f"ELSE {sql_rates(product, dict(delivery=1e-3, intraday=2.5e-4, option=1.5e-3))} END)")
    exch = f"({v} * {sql_rates(product, dict(delivery=3.07e-5, intraday=3.07e-5, option=3.553e-4))})"
    reg = f"({v} * 1e-6)"
    stamp = (f"(CASE lower({side}) WHEN 'buy' THEN {v} * "
             f"{sql_rates(product, dict(delivery=1.5e-4, intraday=3e-5, option=3e-5))} ELSE 0e0 END)")
    gst = f"(18e-2 * ({fee} + {exch} + {reg}))"
    depository = (f"(CASE WHEN lower({side}) = 'buy' OR {product} <> 'delivery' THEN 0e0 WHEN {broker} = 'zerodha' "
                  f"THEN 15.34e0 WHEN {v} < 100 THEN 0e0 ELSE 23.6e0 END)")
    parts = dict(brokerage=fee, transaction_tax=tax, exchange_fee=exch, regulator_fee=reg, stamp=stamp, gst=gst,
                 depository=depository)
    return {**parts, "total": "(" + " + ".join(parts.values()) + ")"}


def sql_round_trip(value: str, product: str = "'delivery'") -> str:
    buy, sell = sql_charges("'buy'", product, value)["total"], sql_charges("'sell'", product, value)["total"]
    return f"(CASE WHEN ({value}) <= 0 THEN 1e0 ELSE ({buy} + {sell}) / ({value}) + 30e-4 END)"


def sql_exit_cost(value: str, product: str = "'delivery'") -> str:
    return f"(CASE WHEN ({value}) <= 0 THEN 1e0 ELSE {sql_charges(chr(39) + 'sell' + chr(39), product, value)['total']} / ({value}) + 15e-4 END)"


PARTS = sql_charges("side", "product", "value", "broker")


@query("c01_charge_orders", with_views("orders_to_charge", f"""
 SELECT {FILL_KEYS}, side, product, broker, {', '.join(r(e, n) for n, e in PARTS.items())} FROM orders_to_charge"""))
def c01(spark, sf):
    o = K.charge_orders(V.orders_to_charge(spark, sf)).withColumn("day", F.to_date("time"))
    return report(o, *KEY_COLUMNS, "side", "product", "broker", *PARTS)


@query("c02_slippage_fill", with_views("orders_to_charge", f"""
 SELECT {FILL_KEYS}, {r("price * (1 + CASE side WHEN 'BUY' THEN 1 ELSE -1 END * CASE product WHEN 'option' THEN 50 ELSE 15 END / 1e4)", 'fill')}
 FROM orders_to_charge"""))
def c02(spark, sf):
    o = V.orders_to_charge(spark, sf).withColumn("day", F.to_date("time")).withColumn(
        "bps", F.when(F.col("product") == "option", C.OPTION_SLIPPAGE_BPS).otherwise(C.STOCK_SLIPPAGE_BPS))
    return report(K.fill_orders(o), *KEY_COLUMNS, "fill")


@query("c03_round_trip_cost", with_views("orders_to_charge", f"""
 SELECT {FILL_KEYS}, {r(sql_round_trip('value', 'product'), 'cost', 9)} FROM orders_to_charge"""))
def c03(spark, sf):
    o = V.orders_to_charge(spark, sf).withColumn("day", F.to_date("time"))
    return report(o.withColumn("cost", M.round_trip_cost(F.col("value"), F.col("product"))), *KEY_COLUMNS, "cost", cost=9)


@query("c04_exit_cost", with_views("orders_to_charge", f"""
 SELECT {FILL_KEYS}, {r(sql_exit_cost('value', 'product'), 'cost', 9)} FROM orders_to_charge"""))
def c04(spark, sf):
    o = V.orders_to_charge(spark, sf).withColumn("day", F.to_date("time"))
    return report(o.withColumn("cost", M.exit_cost(F.col("value"), F.col("product"))), *KEY_COLUMNS, "cost", cost=9)


# Budgets and cash near the line's value, so that charges decide the last unit.
VIEWS["requests"] = """
 SELECT account, symbol, time, order_id, line, part, product, broker, value * 1.02 AS budget,
        value * (1 + (order_id % 9 - 4) / 1000.0) AS cash, price * 1.0015 AS fill,
        CASE product WHEN 'option' THEN 5 ELSE 1 END AS lot FROM orders_to_charge """


def requests(spark, sf):
    o = V.orders_to_charge(spark, sf)
    return o.select(
        "account", "symbol", "time", "order_id", "line", "part", "product", "broker",
        (F.col("value") * 1.02).alias("budget"),
        (F.col("value") * (1 + (F.col("order_id") % 9 - 4) / 1000.0)).alias("cash"),
        (F.col("price") * 1.0015).alias("fill"), F.when(F.col("product") == "option", 5).otherwise(1).alias("lot"))


COVERED = f"n * lot * fill + {sql_charges(chr(39) + 'buy' + chr(39), 'product', 'n * lot * fill', 'broker')['total']} <= cash"


@query("c05_whole_units", with_more("requests", f"""
 tried AS (SELECT *, unnest(range(1, CAST(floor(least(budget, cash) / (fill * lot)) AS BIGINT) + 1)) AS n FROM requests),
 best AS (SELECT account, symbol, time, order_id, line, part, cash, fill, max(n * lot) AS units FROM tried
          WHERE {COVERED} GROUP BY ALL)""", f"""
 SELECT q.account, q.symbol, CAST(q.time AS VARCHAR)[1:10] AS day, q.order_id, q.line, q.part, {r('q.cash', 'cash', 4)},
        CAST(coalesce(units, 0) AS BIGINT) AS units
 FROM requests q LEFT JOIN best b USING (account, symbol, time, order_id, line, part, cash, fill)"""))
def c05(spark, sf):
    sized = K.size_orders(requests(spark, sf)).withColumn("day", F.to_date("time"))
    return report(sized, *KEY_COLUMNS, "cash", "units", cash=4)


# One order is one tick of one account; its lines are the buys, and cash covers about two thirds of them.
VIEWS["tick_buys"] = """
 SELECT order_id, account, line, part, product, broker, value * 0.6 + 20000 AS budget, o_totalprice * 0.4 AS cash,
        price * 1.0015 AS fill, 1 AS lot, row_number() OVER (PARTITION BY order_id ORDER BY line, part, value) AS nth
 FROM orders_to_charge JOIN orders ON order_id = o_orderkey """


def tick_buys(spark, sf, tasks):
    heads = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), "o_totalprice")
    return (V.orders_to_charge(spark, sf, tasks).join(heads.repartition(tasks, "order_id"), "order_id")
            .select("order_id", "account", "line", "part", "value", "product", "broker",
                    (F.col("value") * 0.6 + 20000).alias("budget"), (F.col("o_totalprice") * 0.4).alias("cash"),
                    (F.col("price") * 1.0015).alias("fill"), F.lit(1).alias("lot")))


BUY = sql_charges("'buy'", "product", "n * fill", "broker")["total"]
SPENT = sql_charges("'buy'", "product", "units * fill", "broker")["total"]


@query("c06_sequential_fills", with_more("tick_buys", f"""
 offers AS (SELECT order_id, nth, budget, fill, product, broker, cash FROM tick_buys),
 steps AS (
   SELECT order_id, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS units, max(cash) AS left_over FROM offers GROUP BY 1
   UNION ALL
   SELECT order_id, nth, units, CASE WHEN units > 0 THEN left_over - units * fill - {SPENT} ELSE left_over END FROM (
     SELECT o.order_id, o.nth, s.left_over, o.fill, o.product, o.broker,
            coalesce(list_max(list_filter(range(1, CAST(floor(least(o.budget, s.left_over) / o.fill) AS BIGINT) + 1),
              lambda n: n * o.fill + {BUY.replace('product', 'o.product').replace('broker', 'o.broker').replace('n * fill', 'n * o.fill')} <= s.left_over)), 0) AS units
     FROM steps s JOIN offers o ON o.order_id = s.order_id AND o.nth = s.nth + 1))""", f"""
 SELECT b.order_id, b.line, b.part, s.units, {r('s.left_over', 'cash_after', 4)}
 FROM steps s JOIN tick_buys b ON b.order_id = s.order_id AND b.nth = s.nth"""))
def c06(spark, sf):
    tasks = tasks_for(V.table(spark, sf, "lineitem"))
    filled = K.fill_batch(tick_buys(spark, sf, tasks), ["order_id"], ["line", "part", "value"], dealt=True)
    return report(filled, "order_id", "line", "part", "units", "cash_after", cash_after=4)


def sql_cdf(x: str) -> str:
    def horner(cs):
        out = f"{cs[0]!r}"
        for c in cs[1:]:
            out = f"({out} * abs({x}) + {c!r})"
        return out
    far = f"abs({x}) + 65e-2"
    for k in (4, 3, 2, 1):
        far = f"abs({x}) + {k} / ({far})"
    tail = (f"CASE WHEN abs({x}) > 37 THEN 0e0 WHEN abs({x}) < {O.HART_SPLIT}e0 THEN exp(-{x} * {x} / 2) * "
            f"{horner(O.HART_TOP)} / {horner(O.HART_BOTTOM)} ELSE exp(-{x} * {x} / 2) / ({far}) / {O.HART_SCALE}e0 END")
    return f"(CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END)"


VIEWS["contracts"] = """
 SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS spot,
        round_even(l_extendedprice / 50, 0) * 50 + (l_linenumber - 4) * 100 AS strike,
        CAST(l_quantity AS INTEGER) - 3 AS days_left, l_tax * 5 AS realised_vol FROM lineitem """
VIEWS["d1_terms"] = """
 SELECT *, (ln(spot / strike) + (65e-3 + 5e-1 * vol * vol) * years) / nullif(spread, 0) AS d1,
        (ln(spot / strike) + (65e-3 + 5e-1 * vol * vol) * years) / nullif(spread, 0) - spread AS d2 FROM (
   SELECT *, greatest(days_left, 0) / 365e0 AS years, realised_vol * 115e-2 AS vol,
          greatest(realised_vol * 115e-2, 1e-4) * sqrt(greatest(days_left, 0) / 365e0) AS spread FROM contracts ) """


@query("c07_call_premium", with_views("d1_terms", f"""
 SELECT l_orderkey, l_linenumber, l_partkey, {r('strike')}, CAST(days_left AS BIGINT) AS days_left,
        {r(f"CASE WHEN years <= 0 THEN greatest(spot - strike, 0) ELSE spot * {sql_cdf('d1')} - strike * exp(-65e-3 * years) * {sql_cdf('d2')} END", 'premium', 4)}
 FROM d1_terms"""))
def c07(spark, sf):
    li = V.table(spark, sf, "lineitem")
    c = li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("spot"),
                  (O.atm_strike(F.col("l_extendedprice")) + (F.col("l_linenumber") - 4) * 100).alias("strike"),
                  (F.col("l_quantity").cast("int") - 3).alias("days_left"), (F.col("l_tax") * 5).alias("vol"))
    return report(O.price_premiums(c, realised_vol="vol"), "l_orderkey", "l_linenumber", "l_partkey", "strike", "days_left", "premium", premium=4)


@query("c08_atm_strike", f"""
 SELECT o_orderkey, {r('round_even(o_totalprice / 50, 0) * 50', 'strike')},
        {r('round_even((o_orderkey * 25) / 50, 0) * 50', 'on_a_half')} FROM orders""")
def c08(spark, sf):
    o = V.table(spark, sf, "orders")
    return report(o.select("o_orderkey", O.atm_strike(F.col("o_totalprice")).alias("strike"),
                           O.atm_strike(F.col("o_orderkey") * 25).alias("on_a_half")))


RANK = "(1 - l_discount * 6)"
GROSS = f"(11e-3 * ({RANK} - 5e-1) / 5e-1)"


@query("c09_rank_edge", f"""
 SELECT l_orderkey, l_linenumber, l_partkey, {r(GROSS, 'gross', 9)},
        {r(f"({GROSS} - {sql_round_trip('l_extendedprice')}) / 21", 'per_day', 9)},
        {GROSS} - {sql_round_trip('l_extendedprice')} >= 25e-2 * {sql_round_trip('l_extendedprice')} AS clears
 FROM lineitem""")
def c09(spark, sf):
    rank, value = 1 - F.col("l_discount") * 6, F.col("l_extendedprice")
    li = V.table(spark, sf, "lineitem")
    return report(li.select("l_orderkey", "l_linenumber", "l_partkey", M.expected_gross(rank).alias("gross"),
                            M.edge_per_day(rank, value).alias("per_day"),
                            M.clears_margin(rank, value).alias("clears")), gross=9, per_day=9)


@query("c10_weekday_arithmetic", """
 SELECT l_orderkey, l_linenumber, l_partkey, CAST((
     SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) AS k FROM (
       SELECT CAST(l_shipdate AS DATE) + CAST(unnest(range(1, 90)) AS INTEGER) AS d) WHERE isodow(d) < 6) WHERE k = n) AS VARCHAR) AS due,
   CAST(greatest(trunc((CAST(now AS DATE) - CAST(l_shipdate AS DATE)) * 5 / 7), 0) AS BIGINT) AS sessions
 FROM (SELECT *, CAST(l_quantity AS INTEGER) AS n, l_shipdate + to_days(CAST(l_partkey % 150 AS INTEGER)) AS now
       FROM lineitem)""")
def c10(spark, sf):
    li = V.table(spark, sf, "lineitem")
    opened = F.to_date("l_shipdate")
    now = F.date_add(opened, (F.col("l_partkey") % 150).cast("int"))
    return report(li.select("l_orderkey", "l_linenumber", "l_partkey",
                            D.add_weekdays(opened, F.col("l_quantity").cast("int")).alias("due"),
                            D.sessions_held(opened, now).alias("sessions")))


# Measured payoff per score, from what each discount level earned on average.
VIEWS["measured"] = """
 SELECT l_discount * 10 AS score, avg(l_tax - 0.04) * 20 + l_discount * 0.4 - 0.02 AS expected_net FROM lineitem GROUP BY l_discount """


def measured(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.groupBy("l_discount").agg(F.avg(F.col("l_tax") - 0.04).alias("m")).select(
        (F.col("l_discount") * 10).alias("score"),
        (F.col("m") * 20 + F.col("l_discount") * 0.4 - 0.02).alias("expected_net"))


def scored_parts(spark, sf):
    return V.table(spark, sf, "part").select(
        "p_partkey", ((F.col("p_retailprice") - 900) / 80 - 0.1).alias("score"))


VIEWS["scored_parts"] = "SELECT p_partkey, (p_retailprice - 900) / 80 - 0.1 AS score FROM part "
VIEWS["segments"] = """
 SELECT score AS x0, expected_net AS y0, lead(score) OVER (ORDER BY score) AS x1,
        lead(expected_net) OVER (ORDER BY score) AS y1 FROM measured """
VIEWS["calibrated"] = """
 SELECT p_partkey, score, CASE
     WHEN score <= (SELECT min(x0) FROM segments) THEN (SELECT arg_min(y0, x0) FROM segments)
     WHEN score > (SELECT max(x0) FROM segments) THEN (SELECT arg_max(y0, x0) FROM segments)
     ELSE y0 + (y1 - y0) * (score - x0) / (x1 - x0) END AS net
 FROM scored_parts LEFT JOIN segments ON score > x0 AND score <= x1 """


@query("j11_calibrated_lookup", with_views("calibrated", f"""
 SELECT p_partkey, {r('score')}, {r('net', 'expected_net')} FROM calibrated"""))
def j11(spark, sf):
    return report(K.calibrate(scored_parts(spark, sf), measured(spark, sf)))


@query("c12_intraday_gate", with_views("calibrated", f"""
 SELECT p_partkey, coalesce(net >= 2 * 36e-4, false) AS worth_it FROM calibrated"""))
def c12(spark, sf):
    c = K.calibrate(scored_parts(spark, sf), measured(spark, sf))
    return report(c.select("p_partkey", K.worth_it(F.col("expected_net")).alias("worth_it")))


# --- sizing: one order is one account's candidate list ---

VIEWS["cands"] = """
 SELECT l_orderkey AS tick, CAST(row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_discount, l_linenumber, l_partkey, l_extendedprice) AS BIGINT) AS pos,
        l_partkey AS symbol, 1 - l_discount * 3 AS rank_pct, l_extendedprice / 1000 AS score,
        l_tax * 0.2 - 0.003 AS edge, o_totalprice AS budget, l_extendedprice / l_quantity AS price,
        0.02 + l_tax AS expected
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey """


def cands(spark, sf):
    from pyspark.sql import Window as W
    lines = V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    tasks = tasks_for(lines)                                     # joined, numbered and sized in one task each, a bounded number of rows
    lines = lines.repartition(tasks, "l_orderkey")
    heads = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").repartition(tasks, "o_orderkey")
    w = W.partitionBy("l_orderkey").orderBy("l_discount", "l_linenumber", "l_partkey", "l_extendedprice")
    return (lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("l_orderkey").alias("tick"), F.row_number().over(w).cast("bigint").alias("pos"),
                    F.col("l_partkey").alias("symbol"), (1 - F.col("l_discount") * 3).alias("rank_pct"),
                    (F.col("l_extendedprice") / 1000).alias("score"), (F.col("l_tax") * 0.2 - 0.003).alias("edge"),
                    F.col("o_totalprice").alias("budget"), V.unit_price().alias("price"),
                    (0.02 + F.col("l_tax")).alias("expected")))


VIEWS["passes"] = """
 SELECT tick, CAST(0 AS BIGINT) AS step, greatest(35e-2, 1e0 / len(w)) AS cap, w FROM (
   SELECT tick, list(e / total ORDER BY pos) AS w FROM (
     SELECT *, sum(e) OVER (PARTITION BY tick) AS total FROM (
       SELECT tick, pos, CASE WHEN coalesce(stddev_samp(score) OVER t, 0) > 0
            THEN exp((score - avg(score) OVER t) / stddev_samp(score) OVER t) ELSE greatest(rank_pct - 5e-1, 1e-6) END AS e
       FROM cands WINDOW t AS (PARTITION BY tick))) GROUP BY tick)
 UNION ALL
 SELECT tick, step + 1, cap, list_transform(w, lambda x: CASE WHEN x > cap THEN cap ELSE x
     + list_sum(list_transform(w, lambda z: greatest(z - cap, 0))) * x
     / CASE WHEN coalesce(list_sum(list_filter(w, lambda z: z <= cap)), 0) = 0 THEN 1
            ELSE list_sum(list_filter(w, lambda z: z <= cap)) END END)
 FROM passes WHERE step < len(w) """


@query("p01_confidence_weights", with_more("cands passes", """
 final AS (SELECT tick, cap, w, CASE WHEN list_max(w) < 5e-2 THEN w ELSE list_filter(w, lambda x: x >= 5e-2) END AS kept
           FROM passes WHERE step = len(w)),
 each AS (SELECT tick, cap, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS x, list_max(w) < 5e-2 AS all_small,
                 list_sum(kept) AS total FROM final)""", f"""
 SELECT tick, pos, {r('CASE WHEN all_small OR x >= 5e-2 THEN least(x / total, cap) END', 'weight')} FROM each"""))
def p01(spark, sf):
    return report(Z.confidence_weights(cands(spark, sf), ["tick"]), "tick", "pos", "weight")


# Exact water filling: raise the level a name at a time until every share fits under the cap.
@query("p02_edge_shares", with_more("cands", """
 live AS (SELECT tick, symbol, pos, edge, greatest(30e-2, 1e0 / count(*) OVER (PARTITION BY tick)) AS cap,
                 row_number() OVER (PARTITION BY tick ORDER BY edge DESC, symbol, pos) - 1 AS above,
                 count(*) OVER (PARTITION BY tick) AS n FROM cands WHERE edge > 0),
 levels AS (SELECT a.tick, a.above, a.cap, (1 - a.above * a.cap) / sum(b.edge) AS level, max(b.edge) AS top
            FROM live a JOIN live b ON a.tick = b.tick AND b.above >= a.above GROUP BY 1, 2, 3),
 chosen AS (SELECT tick, min(above) AS k, arg_min(level, above) AS level FROM levels WHERE top * level <= cap GROUP BY 1)""",
                                     f"""
 SELECT c.tick, c.pos, {r('CASE WHEN l.edge IS NULL THEN 0 WHEN k IS NULL OR l.above < k THEN l.cap ELSE l.edge * level END', 'share')}
 FROM cands c LEFT JOIN live l ON c.tick = l.tick AND c.pos = l.pos LEFT JOIN chosen h ON h.tick = c.tick"""))
def p02(spark, sf):
    return report(Z.edge_shares(cands(spark, sf), ["tick"]), "tick", "pos", "share")


@query("p03_best_book", with_more("cands", f"""
 sizes AS (SELECT a.tick, a.pos AS n, a.budget / a.pos AS ticket, avg(11e-3 * (b.rank_pct - 5e-1) / 5e-1) AS mean_gross,
                  min(11e-3 * (b.rank_pct - 5e-1) / 5e-1) AS worst_gross
           FROM cands a JOIN cands b ON a.tick = b.tick AND b.pos <= a.pos WHERE a.pos <= 12 GROUP BY 1, 2, 3),
 priced AS (SELECT *, {sql_round_trip('ticket')} AS cost FROM sizes),
 scored AS (SELECT *, (mean_gross - cost) * sqrt(n / (1 + (n - 1) * 35e-2)) AS score FROM priced
            WHERE ticket >= 5000 AND worst_gross - cost >= 25e-2 * cost),
 best AS (SELECT tick, arg_max(n, (score, -n)) AS n, arg_max(ticket, (score, -n)) AS ticket FROM scored
          WHERE score > 0 GROUP BY 1)""", f"""
 SELECT t.tick, CAST(coalesce(n, 0) AS BIGINT) AS n, {r('coalesce(ticket, 0)', 'ticket', 4)}
 FROM (SELECT DISTINCT tick FROM cands) t LEFT JOIN best USING (tick)"""))
def p03(spark, sf):
    return report(Z.best_book(cands(spark, sf), ["tick"]), ticket=4)


VIEWS["staked"] = """
 SELECT *, budget / 6 AS ticket, budget AS equity, tick % 4 = 0 AS wild, CASE WHEN tick % 3 = 0 THEN 0e0 ELSE 2e0 END AS power
 FROM cands WHERE pos <= 3 """


@query("p04_conviction_stakes", with_more("staked", """
 kept AS (SELECT tick, sum(expected) AS s, count(*) AS n FROM cands WHERE pos > 3 GROUP BY 1),
 refs AS (SELECT s.*, (sum(s.expected) OVER (PARTITION BY s.tick) + coalesce(k.s, 0))
                      / (count(*) OVER (PARTITION BY s.tick) + coalesce(k.n, 0)) AS ref
          FROM staked s LEFT JOIN kept k ON s.tick = k.tick)""", f"""
 SELECT tick, pos, {r('CASE WHEN power > 0 AND ref > 0 THEN least(ticket * least(greatest(pow(expected / ref, power), 5e-1), CASE WHEN wild THEN 3e0 ELSE 16e-1 END), CASE WHEN wild THEN 1e0 ELSE 30e-2 END * equity) ELSE ticket END', 'stake', 4)}
 FROM refs"""))
def p04(spark, sf):
    c = cands(spark, sf)
    chosen = c.filter("pos <= 3").withColumns({
        "ticket": F.col("budget") / 6, "equity": F.col("budget"), "wild": F.col("tick") % 4 == 0,
        "power": F.when(F.col("tick") % 3 == 0, 0.0).otherwise(C.STAKE_POWER)})
    held = c.filter("pos > 3").select("tick", "expected")
    return report(Z.conviction_stakes(chosen, held, ["tick"]), "tick", "pos", "stake", stake=4)


@query("p05_equal_budget", with_views("cands", f"""
 SELECT tick, pos, {r('budget / count(*) OVER (PARTITION BY tick)', 'each', 4)} FROM cands"""))
def p05(spark, sf):
    c = Z.equal_budget(cands(spark, sf).withColumnRenamed("budget", "cash"), ["tick"])
    return report(c.withColumnRenamed("budget", "each"), "tick", "pos", "each", each=4)


@query("d15_random_exit_date", """
 SELECT l_orderkey, l_linenumber, l_partkey, hold, CAST((
     SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) AS k FROM (
       SELECT day + CAST(unnest(range(1, 70)) AS INTEGER) AS d) WHERE isodow(d) < 6) WHERE k = hold) AS VARCHAR) AS exit_on
 FROM (SELECT *, CAST(l_shipdate AS DATE) AS day,
         CAST('0x' || md5(CAST(l_shipdate AS VARCHAR)[1:10] || '|P' || l_partkey)[1:8] AS BIGINT) % 39 + 2 AS hold
       FROM lineitem)""")
def d15(spark, sf):
    li = V.table(spark, sf, "lineitem")
    day = F.to_date("l_shipdate")
    symbol = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    li = li.withColumn("hold", U.random_hold(day, symbol).cast("bigint"))
    return report(li.select("l_orderkey", "l_linenumber", "l_partkey", "hold",
                            D.add_weekdays(day, F.col("hold").cast("int")).alias("exit_on")))
