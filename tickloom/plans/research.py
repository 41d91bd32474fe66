"""Registered queries: bars, features, labels, same-day trades and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.stats import scrub_inf
from tickloom.operators import bars as B
from tickloom.operators import evaluation as E
from tickloom.operators import features as X
from tickloom.operators import ranking as K
from tickloom.operators import trades as T
from tickloom.plans import views as V
from tickloom.plans.flagship import top_names_per_day
from tickloom.plans.registry import query, r, report, rs
from tickloom.plans.views import INDEX, UNTIL, VIEWS, with_more, with_views

TIERS = ((900.0, 0.0010), (800.0, 0.0020), (0.0, 0.0035))
LIQUID = 700.0
MOVE = 1.0

EARLY = f"FILTER (WHERE strftime(ts, '%H:%M') < '{UNTIL}')"
VIEWS["first_days"] = f"""
 SELECT symbol, date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
        count(*) AS n, arg_max(close, ts) {EARLY} AS fh_close, max(high) {EARLY} AS fh_high,
        min(low) {EARLY} AS fh_low, sum(volume) {EARLY} AS fh_vol
 FROM bars GROUP BY 1, 2 HAVING count(*) {EARLY} > 0 """
VIEWS["features"] = """
 SELECT d.* EXCLUDE (pc, dr, lv), m.gap AS mkt_gap, m.first_hr_ret AS mkt_first_hr,
        d.first_hr_ret - m.first_hr_ret AS rel_first_hr
 FROM (SELECT *, open / nullif(pc, 0) - 1 AS gap, fh_close / nullif(open, 0) - 1 AS first_hr_ret,
         (fh_high - fh_low) / nullif(open, 0) AS first_hr_range,
         lv - CASE WHEN count(lv) OVER b >= 10 THEN avg(lv) OVER b END AS first_hr_vol_ratio,
         pc / nullif(lag(close, 2) OVER w, 0) - 1 AS prev_ret, pc / nullif(lag(open) OVER w, 0) - 1 AS prev_intraday,
         (lag(high) OVER w - lag(low) OVER w) / nullif(pc, 0) AS prev_range,
         pc / nullif(lag(close, 6) OVER w, 0) - 1 AS ret_5d, pc / nullif(lag(close, 21) OVER w, 0) - 1 AS ret_20d,
         CASE WHEN count(dr) OVER b >= 10 THEN stddev_samp(dr) OVER b END AS vol_20d,
         pc / nullif(CASE WHEN count(high) OVER b >= 10 THEN max(high) OVER b END, 0) - 1 AS dist_20d_high,
         close / nullif(fh_close, 0) - 1 AS label_ret
       FROM (SELECT *, lag(close) OVER w AS pc, close / nullif(lag(close) OVER w, 0) - 1 AS dr, ln(1 + fh_vol) AS lv
             FROM first_days WINDOW w AS (PARTITION BY symbol ORDER BY date))
       WINDOW w AS (PARTITION BY symbol ORDER BY date),
              b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) d
 LEFT JOIN (SELECT date, open / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS gap,
                   fh_close / nullif(open, 0) - 1 AS first_hr_ret FROM first_days WHERE symbol = '^IDX') m
   ON d.date = m.date
 WHERE d.symbol NOT LIKE '^%' """
VIEWS["labelled"] = """
 SELECT *, CASE WHEN label_excess IS NOT NULL THEN
     (rank() OVER (PARTITION BY date ORDER BY label_excess NULLS LAST)
      + (count(*) OVER (PARTITION BY date, label_excess) - 1) / 2.0)
     / count(label_excess) OVER (PARTITION BY date) END AS label_rank
 FROM (SELECT *, label_ret - avg(label_ret) OVER (PARTITION BY date) AS label_excess FROM features ) """
VIEWS["day_ctx"] = """
 SELECT symbol, date, pc AS prev_close, pc / nullif(lag(c, 2) OVER w, 0) - 1 AS prev_ret,
        pc / nullif(lag(o) OVER w, 0) - 1 AS prev_intraday, pc / nullif(lag(c, 6) OVER w, 0) - 1 AS ret_5d,
        CASE WHEN count(dr) OVER b >= 10 THEN stddev_samp(dr) OVER b END AS vol_20d
 FROM (SELECT *, lag(c) OVER w AS pc, c / nullif(lag(c) OVER w, 0) - 1 AS dr
       FROM (SELECT symbol, date, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2)
       WINDOW w AS (PARTITION BY symbol ORDER BY date))
 WINDOW w AS (PARTITION BY symbol ORDER BY date),
        b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) """
VIEWS["entry_rows"] = """
 SELECT b0.*, c.prev_close, c.prev_ret, c.prev_intraday, c.ret_5d, c.vol_20d,
        close / nullif(day_open, 0) - 1 AS ret_so_far, day_open / nullif(c.prev_close, 0) - 1 AS gap,
        close / nullif(coalesce(prev_bar, day_open), 0) - 1 AS last_bar_ret,
        (hi_so_far - lo_so_far) / nullif(day_open, 0) AS range_so_far,
        (close - lo_so_far) / nullif(hi_so_far - lo_so_far, 0) AS pos_in_range,
        ln(1 + cumvol) - ln(1 + CASE WHEN count(cumvol) OVER v >= 5 THEN avg(cumvol) OVER v END) AS vol_ratio_so_far
 FROM (SELECT *, first_value(open) OVER s AS day_open, max(high) OVER s AS hi_so_far, min(low) OVER s AS lo_so_far,
              sum(volume) OVER s AS cumvol, sum(close * volume) OVER (PARTITION BY symbol, date) AS turnover_day,
              lag(close) OVER (PARTITION BY symbol, date ORDER BY ts) AS prev_bar
       FROM bars WINDOW s AS (PARTITION BY symbol, date ORDER BY ts ROWS UNBOUNDED PRECEDING)) b0
 LEFT JOIN day_ctx c ON b0.symbol = c.symbol AND b0.date = c.date
 WINDOW v AS (PARTITION BY b0.symbol, b0.bar ORDER BY b0.date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) """
VIEWS["entries"] = """
 SELECT e.*, m.ret_so_far AS mkt_so_far, m.last_bar_ret AS mkt_last_bar, e.ret_so_far - m.ret_so_far AS rel_so_far,
        e.bar AS entry_bar
 FROM entry_rows e LEFT JOIN (SELECT * FROM entry_rows WHERE symbol = '^IDX') m ON e.date = m.date AND e.bar = m.bar
 WHERE e.symbol <> '^IDX' """
VIEWS["liquid"] = f"""
 SELECT e.*, a.avg20, CASE WHEN a.avg20 >= {TIERS[1][0]} THEN {TIERS[1][1]} WHEN a.avg20 >= {TIERS[0][0]}
        THEN {TIERS[0][1]} ELSE {TIERS[2][1]} END AS slippage
 FROM entries e JOIN (
   SELECT symbol, date, CASE WHEN count(t) OVER b >= 10 THEN avg(t) OVER b END AS avg20
   FROM (SELECT symbol, date, max(turnover_day) AS t FROM entries GROUP BY 1, 2)
   WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) a
   ON e.symbol = a.symbol AND e.date = a.date
 WHERE a.avg20 >= {LIQUID} AND e.close >= 20 """
VIEWS["paired"] = """
 SELECT e.*, h.h AS hold_bars, x.close AS exit_close FROM liquid e CROSS JOIN (SELECT unnest([1,2,3,4,5]) AS h) h
 JOIN liquid x ON e.symbol = x.symbol AND e.date = x.date AND e.bar + h.h = x.bar """
VIEWS["labelled_trades"] = f"""
 SELECT *, CASE WHEN net > 0.002 THEN 1 ELSE 0 END AS success FROM (
   SELECT *, exit_close / nullif(close, 0) - 1 AS gross,
          exit_close / nullif(close, 0) - 1 - 0.0006 - 2 * slippage AS net FROM paired )
 WHERE abs(gross) <= {MOVE} AND net IS NOT NULL """
VIEWS["preds"] = "SELECT symbol, date, label_ret, label_excess, first_hr_ret AS prediction FROM labelled "
VIEWS["trade_preds"] = """
 SELECT symbol, date, entry_bar, hold_bars, net, success, pos_in_range AS prob FROM labelled_trades """


def features(spark, sf):
    return X.daily_features(V.bars(spark, sf), INDEX, UNTIL)


def labelled(spark, sf):
    return X.labels(features(spark, sf))


def entries(spark, sf):
    return X.entry_table(V.bars(spark, sf), INDEX)


def liquid(spark, sf):
    return T.tradeable(entries(spark, sf), min_turnover=LIQUID, tiers=TIERS)


def trades(spark, sf):
    return T.drop_outliers(T.label_trades(T.hypothetical_trades(liquid(spark, sf))), MOVE)


def preds(spark, sf):
    return labelled(spark, sf).withColumnRenamed("first_hr_ret", "prediction")


def trade_preds(spark, sf):
    return trades(spark, sf).withColumnRenamed("pos_in_range", "prob")


FEATURE_NAMES = ("gap first_hr_ret first_hr_range first_hr_vol_ratio prev_ret prev_intraday prev_range ret_5d ret_20d "
                 "vol_20d dist_20d_high mkt_gap mkt_first_hr rel_first_hr")
ENTRY_NAMES = ("ret_so_far gap last_bar_ret range_so_far pos_in_range vol_ratio_so_far prev_ret prev_intraday ret_5d "
               "vol_20d mkt_so_far mkt_last_bar rel_so_far")
KEYS = "symbol, CAST(date AS VARCHAR) AS date"

query("flagship_top_names_per_day", with_views("labelled", f"""
 SELECT {KEYS}, pos, {rs('gap first_hr_ret first_hr_range first_hr_vol_ratio vol_20d rel_first_hr label_excess label_rank')}
 FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY first_hr_ret DESC NULLS LAST, symbol) AS pos
       FROM labelled) WHERE pos <= 5"""))(top_names_per_day)


@query("s02_bar_subset", with_views("bars", f"""
 SELECT {KEYS}, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, bar, {rs('open high low close volume')}
 FROM bars WHERE symbol IN ('S1', 'S2', 'S3', 'S4', 'S5', '^IDX')"""))
def s02(spark, sf):
    bars = B.read_bars_subset(B.build_bars(V.ticks(spark, sf)), ["S1", "S2", "S3", "S4", "S5"], INDEX)
    return report(bars, "symbol", "date", "ts", "bar", "open", "high", "low", "close", "volume")


@query("s03_wide_quotes_to_long", with_views("bars", f"""
 SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {rs('open close volume')} FROM bars"""))
def s03(spark, sf):
    names = [*[f"S{i}" for i in range(1, 20)], INDEX]
    wide = (V.bars(spark, sf).groupBy("ts").pivot("symbol", names)
            .agg(*[F.first(c).alias(c) for c in ("open", "close", "volume")]))
    wide = wide.toDF(*[c if c == "ts" else "|".join(c.rsplit("_", 1)) for c in wide.columns])
    return report(B.quotes_to_long(wide, [*names, "NOT_LISTED"]), "symbol", "ts", "open", "close", "volume")


@query("s11_universe", with_views("features", "SELECT DISTINCT symbol FROM features"))
def s11(spark, sf):
    return B.export_universe(features(spark, sf))


@query("f10_scrub_inf", """
 SELECT l_orderkey, l_linenumber, l_partkey, """ + r("l_tax / nullif(l_discount, 0)", "ratio") + """ FROM lineitem""")
def f10(spark, sf):
    # Division done as IEEE would, so that zero discounts give infinities to scrub.
    li = V.table(spark, sf, "lineitem")
    raw = F.when(F.col("l_discount") == 0, F.when(F.col("l_tax") == 0, float("nan")).otherwise(float("inf"))).otherwise(
        F.try_divide("l_tax", "l_discount"))
    return report(scrub_inf(li.select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("ratio"))))


@query("a01_day_bars", with_views("bars", f"""
 SELECT {KEYS}, {rs('open high low close')}, n FROM (
   SELECT symbol, date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
          count(*) AS n FROM bars GROUP BY 1, 2)"""))
def a01(spark, sf):
    return report(B.day_bars(V.bars(spark, sf)))


@query("a02_first_period", with_views("first_days", f"""
 SELECT {KEYS}, {rs('fh_close fh_high fh_low fh_vol')} FROM first_days"""))
def a02(spark, sf):
    return report(B.first_period(V.bars(spark, sf), UNTIL))


@query("j01_days_with_first_period", with_views("first_days", f"""
 SELECT {KEYS}, {rs('open high low close fh_close fh_high fh_low fh_vol')}, n FROM first_days"""))
def j01(spark, sf):
    return report(B.days_with_first_period(V.bars(spark, sf), UNTIL))


@query("a03_day_turnover", with_views("bars", f"""
 SELECT {KEYS}, {r('sum(close * volume)', 'turnover')} FROM bars GROUP BY symbol, date"""))
def a03(spark, sf):
    return report(B.day_turnover(V.bars(spark, sf)))


@query("w01_daily_features", with_views("features", f"SELECT {KEYS}, {rs(FEATURE_NAMES)} FROM features"))
def w01(spark, sf):
    return report(features(spark, sf), "symbol", "date", *FEATURE_NAMES.split())


@query("j02_market_by_date", with_views("features", f"""
 SELECT {KEYS}, {rs('mkt_gap mkt_first_hr rel_first_hr')} FROM features"""))
def j02(spark, sf):
    return report(features(spark, sf), "symbol", "date", "mkt_gap", "mkt_first_hr", "rel_first_hr")


@query("w02_labels", with_views("labelled", f"SELECT {KEYS}, {rs('label_ret label_excess label_rank')} FROM labelled"))
def w02(spark, sf):
    return report(labelled(spark, sf), "symbol", "date", "label_ret", "label_excess", "label_rank")


@query("k05_latest_cross_section", with_views("features", f"""
 SELECT {KEYS}, pos, {rs('first_hr_ret gap')} FROM (
   SELECT *, row_number() OVER (ORDER BY first_hr_ret DESC, symbol) AS pos FROM features
   WHERE date = (SELECT max(date) FROM features) AND first_hr_ret IS NOT NULL) WHERE pos <= 5"""))
def k05(spark, sf):
    d = X.latest_cross_section(features(spark, sf))
    best = K.top_k(d, [], 5, [F.col("first_hr_ret").desc(), F.col("symbol")])
    return report(best, "symbol", "date", "pos", "first_hr_ret", "gap")


@query("w03_entry_table", with_views("entries", f"SELECT {KEYS}, entry_bar, {rs(ENTRY_NAMES)} FROM entries"))
def w03(spark, sf):
    return report(entries(spark, sf), "symbol", "date", "entry_bar", *ENTRY_NAMES.split())


@query("j03_market_by_bar", with_views("entries", f"""
 SELECT {KEYS}, bar, {rs('mkt_so_far mkt_last_bar rel_so_far')} FROM entries"""))
def j03(spark, sf):
    return report(entries(spark, sf), "symbol", "date", "bar", "mkt_so_far", "mkt_last_bar", "rel_so_far")


@query("j04_day_context", with_views("bars day_ctx", f"""
 SELECT b.symbol, CAST(b.date AS VARCHAR) AS date, bar, {rs('close prev_close prev_ret prev_intraday ret_5d vol_20d')}
 FROM bars b LEFT JOIN day_ctx c ON b.symbol = c.symbol AND b.date = c.date"""))
def j04(spark, sf):
    bars = V.bars(spark, sf)
    return report(X.with_day_context(bars, X.day_context(bars)), "symbol", "date", "bar", "close", "prev_close",
                  "prev_ret", "prev_intraday", "ret_5d", "vol_20d")


@query("f07_tradeable", with_views("liquid", f"SELECT {KEYS}, bar, {rs('close avg20 slippage')} FROM liquid"))
def f07(spark, sf):
    return report(liquid(spark, sf), "symbol", "date", "bar", "close", "avg20", "slippage")


@query("j12_slippage_tiers", """
 SELECT l_orderkey, l_linenumber, l_partkey, """ + r("l_extendedprice * 5000", "turnover", 2) + """,
   CASE WHEN l_extendedprice * 5000 >= 2e8 THEN 2e-3 WHEN l_extendedprice * 5000 >= 5e8 THEN 1e-3
        ELSE 3.5e-3 END AS last_match,
   CASE WHEN l_extendedprice * 5000 >= 5e8 THEN 1e-3 WHEN l_extendedprice * 5000 >= 2e8 THEN 2e-3
        ELSE 3.5e-3 END AS first_match FROM lineitem""")
def j12(spark, sf):
    li = V.table(spark, sf, "lineitem")
    turnover = F.col("l_extendedprice") * 5000
    return report(li.select("l_orderkey", "l_linenumber", "l_partkey", turnover.alias("turnover"),
                            T.slippage_tier(turnover).alias("last_match"),
                            T.slippage_tier(turnover, mode="first_match").alias("first_match")), turnover=2)


@query("j05_entry_exit_pairs", with_views("paired", f"SELECT {KEYS}, bar, hold_bars, {rs('close exit_close')} FROM paired"))
def j05(spark, sf):
    return report(T.hypothetical_trades(liquid(spark, sf)), "symbol", "date", "bar", "hold_bars", "close", "exit_close")


@query("c11_trade_labels", with_views("paired", f"""
 SELECT {KEYS}, bar, hold_bars, {rs('gross net')}, CAST(CASE WHEN net > 0.002 THEN 1 ELSE 0 END AS BIGINT) AS success
 FROM (SELECT *, exit_close / nullif(close, 0) - 1 AS gross,
              exit_close / nullif(close, 0) - 1 - 0.0006 - 2 * slippage AS net FROM paired)"""))
def c11(spark, sf):
    t = T.label_trades(T.hypothetical_trades(liquid(spark, sf)))
    return report(t, "symbol", "date", "bar", "hold_bars", "gross", "net", "success")


@query("f08_outliers_dropped", with_views("labelled_trades", f"""
 SELECT {KEYS}, bar, hold_bars, {rs('gross net')}, CAST(success AS BIGINT) AS success FROM labelled_trades"""))
def f08(spark, sf):
    return report(trades(spark, sf), "symbol", "date", "bar", "hold_bars", "gross", "net", "success")


RANKED = """
 days AS (SELECT date, avg(label_ret) AS mkt FROM preds GROUP BY 1),
 both_known AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY prediction)
     + (count(*) OVER (PARTITION BY date, prediction) - 1) / 2.0 AS rp,
     rank() OVER (PARTITION BY date ORDER BY label_excess)
     + (count(*) OVER (PARTITION BY date, label_excess) - 1) / 2.0 AS re
   FROM preds WHERE prediction IS NOT NULL AND label_excess IS NOT NULL),
 ics AS (SELECT date, CASE WHEN stddev_pop(rp) > 0 AND stddev_pop(re) > 0 THEN corr(rp, re) END AS ic
         FROM both_known GROUP BY 1),
 best AS (SELECT date, avg(label_ret) AS ret, count(*) AS n, count(*) FILTER (WHERE label_excess > 0) AS hits FROM (
   SELECT *, row_number() OVER (PARTITION BY date ORDER BY prediction DESC, symbol) AS pos FROM preds
   WHERE prediction IS NOT NULL) WHERE pos <= 5 GROUP BY 1)"""


@query("a07_ranker_evaluation", with_more("preds", RANKED, f"""
 SELECT count(*) AS days, {r('avg(ic)', 'mean_ic')}, {r('avg(ic) / stddev_samp(ic) * sqrt(count(*))', 'ic_t')},
        {r('sum(hits) / sum(n)', 'top_hit_vs_avg')}, {r('avg(ret)', 'top_avg_ret')}, {r('avg(mkt)', 'market_avg_ret')},
        {r('avg(ret) - 0.0036', 'top_net_after_costs')},
        {r('count(*) FILTER (WHERE ret - 0.0036 > 0) / count(n)', 'days_net_positive')}
 FROM days LEFT JOIN ics USING (date) LEFT JOIN best USING (date)"""))
def a07(spark, sf):
    return report(E.evaluate_ranker(preds(spark, sf)))


@query("a08_threshold_sweep", with_more("trade_preds", """
 rules AS (SELECT * FROM (VALUES ('all trades', NULL), ('probability >= 30%', 0.3), ('probability >= 40%', 0.4),
   ('probability >= 50%', 0.5), ('probability >= 60%', 0.6)) v(rule, floor)),
 taken AS (SELECT rule, floor, t.* FROM trade_preds t JOIN rules ON floor IS NULL OR prob >= floor)""", f"""
 SELECT rule, {r('count(*) / count(DISTINCT date)', 'trades_per_day')}, {r('avg(success)', 'success_rate')},
        {r('avg(net)', 'avg_net')}, {r('median(net)', 'median_net')},
        CASE WHEN rule <> 'all trades' THEN count(DISTINCT date) END AS days_with_trades FROM taken GROUP BY rule"""))
def a08(spark, sf):
    return report(E.threshold_sweep(trade_preds(spark, sf)))


@query("a09_best_k_per_day", with_more("trade_preds", """
 best AS (SELECT k, t.* FROM (SELECT *, row_number() OVER (PARTITION BY date
     ORDER BY prob DESC NULLS LAST, symbol, entry_bar, hold_bars) AS pos FROM trade_preds) t
   JOIN (SELECT unnest([1, 3, 5]) AS k) ON pos <= k),
 per_day AS (SELECT k, date, avg(net) AS net FROM best GROUP BY 1, 2)""", f"""
 SELECT 'best ' || k || ' per day' AS rule, CAST(k AS DOUBLE) AS trades_per_day, {r('avg(success)', 'success_rate')},
        {r('avg(net)', 'avg_net')}, {r('median(net)', 'median_net')},
        {r('(SELECT count(*) FILTER (WHERE net > 0) / count(*) FROM per_day p WHERE p.k = best.k)', 'days_profitable')}
 FROM best GROUP BY k"""))
def a09(spark, sf):
    return report(E.best_k(trade_preds(spark, sf)))


@query("a10_walk_forward_folds", with_more("daily", """
 months AS (SELECT date_trunc('month', date) AS m, min(date) AS f,
     row_number() OVER (ORDER BY date_trunc('month', date)) - 1 AS fold FROM daily GROUP BY 1)""", """
 SELECT fold, 'train' AS role, (SELECT count(*) FROM daily WHERE date < f - 1) AS rows FROM months WHERE fold >= 6
 UNION ALL
 SELECT fold, 'test', (SELECT count(*) FROM daily WHERE date_trunc('month', date) = m) FROM months WHERE fold >= 6"""))
def a10(spark, sf):
    return report(E.walk_forward_folds(V.daily(spark, sf)))


@query("w04_pct_rank", with_views("scores", f"""
 SELECT list, symbol, {r('(rank() OVER (PARTITION BY list ORDER BY score) + (count(*) OVER (PARTITION BY list, score) - 1) / 2.0) / count(*) OVER (PARTITION BY list)', 'rank_pct')},
        {r('(rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER ()', 'overall')}
 FROM scores"""))
def w04(spark, sf):
    s = K.pct_rank(V.scores(spark, sf), ["list"], "score", "rank_pct")
    return report(K.pct_rank(s, [], "score", "overall"), "list", "symbol", "rank_pct", "overall")


@query("k01_top_k", with_views("scores", f"""
 SELECT list, symbol, {r('score')}, pos FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, symbol)
   AS pos FROM scores) WHERE pos <= 12"""))
def k01(spark, sf):
    best = K.top_k(V.scores(spark, sf), ["list"], 12, [F.col("score").desc(), F.col("symbol")])
    return report(best, "list", "symbol", "score", "pos")


@query("k04_bounded_sample", """
 SELECT o_orderkey, o_custkey FROM (
   SELECT *, row_number() OVER (ORDER BY CAST('0x' || md5(o_orderkey || '|42')[1:8] AS BIGINT), o_orderkey) AS n
   FROM orders) WHERE n <= 5000""")
def k04(spark, sf):
    return K.cap_rows(V.table(spark, sf, "orders"), 5000, ["o_orderkey"]).select("o_orderkey", "o_custkey")
