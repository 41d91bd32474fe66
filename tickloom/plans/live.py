"""Registered queries: streams run over the tables, and the learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import evaluation as E
from tickloom.operators import features as X
from tickloom.operators import learning as M
from tickloom.operators import ranking as K
from tickloom.plans import research as R
from tickloom.plans import views as V
from tickloom.plans.books import ZONE
from tickloom.plans.registry import query, r, report, rs
from tickloom.plans.views import FILL_ORDER, INDEX, with_views
from tickloom.session import scratch_path, shuffles_freed
from tickloom.streaming import jobs as J


def events(spark, sf):
    """The events table as a stream, stamps as instants."""
    schema = V.table(spark, sf, "events").schema
    return J.stream_files(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def live_ticks(spark, sf):
    u = F.col("user_id") % 20
    return events(spark, sf).select(
        F.when(u == 0, INDEX).otherwise(F.concat(F.lit("S"), u.cast("string"))).alias("symbol"), "ts",
        F.col("event_id").alias("seq"), F.col("value").alias("price"))


@query("t01_stream_bars", with_views("ticks", f"""
 SELECT symbol, strftime(w, '%Y-%m-%d %H:%M:%S') AS ts, {rs('open high low close volume')} FROM (
   SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts - INTERVAL 15 MINUTE) + INTERVAL 15 MINUTE AS w,
          arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close,
          CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2)
 WHERE w + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM ticks)) - INTERVAL 10 MINUTE"""))
def t01(spark, sf):
    return report(J.run_to_files(J.stream_bars(live_ticks(spark, sf)), "bars"))


def in_turn(df, clock, name, run):
    """What `run(stream, at)` gives of `df` arriving in three turns by `clock`, going on from its state after each.

    The rows are written once, by turn; each turn streams the folders of all turns so far, and takes its own in one batch.
    """
    spark = df.sparkSession
    folder, at = scratch_path(spark, f"{name}-in"), scratch_path(spark, name)
    with shuffles_freed(spark):
        cuts = df.agg(F.percentile_approx(clock, [0.33, 0.67]).alias("cuts")).first()["cuts"] or []
        turn = sum(((F.col(clock) > cut).cast("int") for cut in cuts), F.lit(0))
        df.withColumn("turn", turn).filter("turn IS NOT NULL").write.partitionBy("turn").option("compression", "zstd").parquet(folder)
    for turn in range(len(cuts) + 1):
        out = run(J.stream_files(spark, f"{folder}/turn=[0-{turn}]", df.schema, files_per_batch=None), at)
    return out


def latest(name, keys, stream):
    """For `in_turn`: the newest row per key, read from a snapshot after every other batch."""
    return lambda rows, at: J.run_to_latest(stream(rows), name, keys, at, every=2)


@query("t02_stream_latest_quotes", with_views("dated_quotes", f"""
 SELECT symbol, CAST(trade_day AS VARCHAR) AS date, {r('ltp', 'price')} FROM (
   SELECT *, row_number() OVER (PARTITION BY symbol, trade_day ORDER BY
   CASE WHEN last_trade_epoch > 1e11 THEN last_trade_epoch // 1000 ELSE last_trade_epoch END DESC, seq DESC) AS k
   FROM dated_quotes WHERE symbol LIKE '%.NS' AND ltp > 0 AND volume <> 0) WHERE k = 1"""))
def t02(spark, sf):
    quotes = V.quotes(spark, sf).select("symbol", "ltp", "volume", "last_trade_epoch", "seq", "asof")
    return report(in_turn(quotes, "asof", "quotes", latest("quotes", ["symbol", "date"], lambda q: J.stream_latest_quotes(q, ZONE))), "symbol", "date", "price")


@query("t03_stream_day_open", with_views("ticks", f"""
 SELECT symbol, CAST(date AS VARCHAR) AS date, {r('arg_min(price, (ts, seq))', 'open')} FROM ticks
 WHERE CAST(ts AS TIME) >= TIME '09:15:00' GROUP BY symbol, date"""))
def t03(spark, sf):
    return report(J.run_to_latest(J.stream_day_open(live_ticks(spark, sf)), "opens", ["symbol", "date"]), "symbol", "date", "open")


def streamed_fills(spark, sf):
    fills = V.ledger(spark, sf).drop("reason")
    return in_turn(fills, "time", "positions", lambda f, at: J.run_positions(f, "positions", list(FILL_ORDER), at))


POSITIONS = with_views("fills_done", f"""
 SELECT account, symbol, order_id, line, part, side, units, qty_after,
        {r('CASE WHEN units > 0 THEN avg_after END', 'avg_after', 4)}, {r('costs', places=4)}, {r('pnl', places=3)} FROM fills_done""")


def report_positions(done):
    return report(done, "account", "symbol", "order_id", "line", "part", "side", "units", "qty_after", "avg_after", "costs", "pnl",
                  places=4, pnl=3)


@query("t04_stream_positions", POSITIONS)
def t04(spark, sf):
    return report_positions(streamed_fills(spark, sf))


@query("t04_late_fills", POSITIONS)
def t04_late(spark, sf):
    """Each fill arrives up to 29 days after its time, so every turn brings some that belong before those of the last one."""
    fills = V.ledger(spark, sf).drop("reason").withColumn(
        "arrives", F.date_add(F.to_date("time"), (F.crc32(F.col("order_id").cast("string")) % 30).cast("int")))
    return report_positions(in_turn(fills, "arrives", "late", lambda f, at: J.run_late_positions(
        f, "late", list(FILL_ORDER), "31 days", at)))


@query("t04_stream_cash", with_views("fills_done", f"""
 SELECT account, {r("200000 + sum(CASE WHEN side = 'BUY' THEN -moved ELSE moved END - costs)", 'cash_after', 2)},
        {r('sum(costs)', 'costs', 2)}, {r('sum(pnl)', 'pnl', 2)}, count(*) AS fills FROM fills_done GROUP BY 1"""))
def t04_cash(spark, sf):
    last = in_turn(streamed_fills(spark, sf), "time", "cash", latest("cash", ["account"], J.stream_cash))
    return report(last.select("account", F.col("cash").alias("cash_after"), "costs", "pnl", "fills"), places=2)


@query("t05_stream_alert_ids", """
 SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) || '|' || user_id || '|' || event_type AS id FROM events""")
def t05(spark, sf):
    e = events(spark, sf)
    alerts = e.select("ts", F.concat_ws("|", F.to_date("ts").cast("string"), F.col("user_id").cast("string"),
                                        "event_type").alias("id"))
    return J.run_to_files(J.stream_alerts(alerts), "alerts").select("id")


@query("t06_stream_once_per_day", """
 SELECT 'U' || user_id AS account, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, arg_min(event_id, (ts, event_id)) AS seq
 FROM events GROUP BY 1, 2""")
def t06(spark, sf):
    e = events(spark, sf).select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("account"), "ts",
                                 F.col("event_id").alias("seq"))
    return report(J.run_to_latest(J.stream_once_per_day(e), "entries", ["account", "date"]), "account", "date", "seq")


# the operators walk by month after six of them; bars and their trades cover one month here and are walked by week after two
BY_WEEK = {"min_train": 2, "period": "week"}


@query("m01_walk_forward_ranker")
def m01(spark, sf):
    d = R.labelled(spark, sf)
    p = M.walk_forward_regress(d, **BY_WEEK)
    return report(p, "symbol", "date", "label_ret", "label_excess", "prediction")


@query("m01_ranker_report")
def m01_report(spark, sf):
    d = R.labelled(spark, sf)
    p = M.walk_forward_regress(d, **BY_WEEK)
    return report(E.evaluate_ranker(p))


@query("m02_walk_forward_classifier")
def m02(spark, sf):
    t = R.trades(spark, sf)
    p = M.walk_forward_classify(t, **BY_WEEK)
    return report(p, "symbol", "date", "entry_bar", "hold_bars", "net", "success", "prob")


@query("m03_m04_fit_and_score_latest")
def m03(spark, sf):
    path = scratch_path(spark, "model")
    d = R.features(spark, sf)
    M.fit_final(X.labels(d), path)
    best = K.top_k(M.score(X.latest_cross_section(d), path), [], 5, [F.col("score").desc(), F.col("symbol")])
    return report(best, "symbol", "date", "pos", "score")
