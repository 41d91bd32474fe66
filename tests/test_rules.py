import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.functions.calendar import add_weekdays, in_session, phase, sessions_held
from tickloom.operators import filters as L
from tickloom.operators import rules as U

NAMES = [f"{c * 3}.NS" for c in "ABCDEFGH"]


def at(text):
    return dt.datetime.fromisoformat(text)


def held(spark, *rows):
    """(symbol, avg, price, product, opened, extra...) holdings of account t on 2026-09-30 10:30."""
    return spark.createDataFrame(
        [("t", s, 100, avg, at(opened), product, at("2026-09-30 10:30"), price) for s, avg, price, product, opened in rows],
        "account string, symbol string, qty bigint, avg_price double, opened timestamp_ntz, product string, "
        "now timestamp_ntz, price double")


def reasons(df):
    return {r["symbol"]: r["reason"] for r in df.collect()}


def test_weekday_arithmetic(spark):
    days = [dt.date(2026, 9, 18) + dt.timedelta(days=i) for i in range(14)]
    df = spark.createDataFrame([(d, n) for d in days for n in range(1, 45)], "d date, n int")
    for r in df.select("d", "n", add_weekdays(F.col("d"), F.col("n")).alias("out")).collect():
        day, left = r["d"], r["n"]
        while left:
            day += dt.timedelta(days=1)
            left -= day.weekday() < 5
        assert r["out"] == day
    one = spark.createDataFrame([(dt.date(2026, 9, 22),)], "d date").select(
        add_weekdays(F.col("d"), 5).alias("a"), sessions_held(F.col("d"), F.lit("2026-12-29").cast("date")).alias("s"),
        sessions_held(F.col("d"), F.lit("2026-09-20").cast("date")).alias("z")).first()
    assert (one["a"], one["s"], one["z"]) == (dt.date(2026, 9, 29), 70, 0)


def test_clock(spark):
    times = ["2026-09-22 09:14:59", "2026-09-22 09:15:00", "2026-09-22 09:30:00", "2026-09-22 10:20:00",
             "2026-09-22 15:05:00", "2026-09-22 15:30:00", "2026-09-22 15:30:00.000001", "2026-09-26 11:00:00"]
    df = spark.createDataFrame([(i, at(t)) for i, t in enumerate(times)], "i int, ts timestamp_ntz")
    out = df.select("i", in_session(F.col("ts")).alias("open"), phase(F.col("ts")).alias("p")).orderBy("i").collect()
    assert [r["open"] for r in out] == [False, True, True, True, True, True, False, False]
    assert [r["p"] for r in out][:5] == ["wait", "wait", "entry", "model_entry", "hard_exit"]


def test_intraday_exits_in_order(spark):
    h = held(spark, ("old", 100.0, 100.0, "intraday", "2026-09-29 10:00"), ("up", 100.0, 102.5, "intraday", "2026-09-30 10:00"),
             ("down", 100.0, 98.0, "intraday", "2026-09-30 10:00"), ("kept", 100.0, 100.5, "intraday", "2026-09-30 10:00"),
             ("left", 100.0, 100.5, "intraday", "2026-09-30 10:00"), ("dark", 100.0, None, "intraday", "2026-09-29 10:00"))
    wanted = spark.createDataFrame([("kept",), ("up",)], "symbol string")
    assert reasons(U.exits_intraday(h, wanted)) == {
        "old": "missed close; sold next session", "up": "target hit +2.50%", "down": "stop loss -2.00%",
        "left": "model dropped it +0.50%"}
    late = h.withColumn("now", F.lit("2026-09-30 15:10:00").cast("timestamp_ntz"))
    assert set(reasons(U.exits_intraday(late, wanted)).values()) == {"missed close; sold next session", "intraday hard exit"}


def test_rank_exits_need_ranks(spark):
    h = held(spark, *[(s, 100.0, 100.0, "delivery", "2026-09-01 10:00") for s in ("a", "b", "c")])
    ranks = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "symbol string, rank_pct double")
    assert set(reasons(U.exits_rank(h, ranks))) == {"a", "c"}
    assert reasons(U.exits_rank(h, ranks.filter("false"))) == {}


def test_cost_aware_exits(spark):
    h = held(spark, ("quiet", 100.0, 100.0, "delivery", "2026-09-29 10:00"), ("bad", 100.0, 100.0, "delivery", "2026-09-29 10:00"),
             ("crash", 100.0, 70.0, "delivery", "2026-09-29 10:00"), ("served", 100.0, 100.0, "delivery", "2026-06-01 10:00"),
             ("day", 100.0, 50.0, "intraday", "2026-09-30 10:00"))
    ranks = spark.createDataFrame([("quiet", 0.60), ("bad", 0.02), ("crash", 0.99), ("served", 0.60)], "symbol string, rank_pct double")
    assert reasons(U.exits_cost_aware(h, ranks)) == {
        "bad": "deteriorated after 0 sessions, not merely gone quiet", "crash": "down -30% from entry; selling regardless of rank",
        "served": "held 86 sessions; expected return no longer covers selling"}


def policy(spark, **over):
    base = {"account": "t", "fresh": True, "wild": False, "uses_exit_model": True, "min_age": 10, "margin": 0.02, **over}
    return spark.createDataFrame([tuple(base.values())], "account string, fresh boolean, wild boolean, "
                                 "uses_exit_model boolean, min_age int, margin double")


def test_model_exits(spark):
    h = held(spark, *[(s, 100.0, 70.0 if s == "crash" else 100.0, "delivery", "2026-09-01 10:00")
                      for s in ("sold", "kept", "young", "unscored", "poor", "crash")])
    scores = spark.createDataFrame([("sold", 0.05, -0.05, 12), ("kept", 0.05, 0.01, 12), ("young", 0.05, -0.05, 4),
                                    ("poor", 0.0005, None, None), ("crash", 0.05, None, None)],
                                   "symbol string, expected double, pred double, age int")
    h = h.join(scores, "symbol", "left")
    assert reasons(U.exits_model(h, policy(spark))) == {
        "sold": "model exit model: switching expected to beat holding by 5.00% over 10 sessions (held 12 sessions)",
        "unscored": "model exit: no longer scored", "poor": "model exit: expects +0.05%, selling costs 0.41%",
        "crash": "disaster stop -30.0%"}
    assert reasons(U.exits_model(h, policy(spark, fresh=False))) == {"crash": "disaster stop -30.0%"}
    assert "sold" not in reasons(U.exits_model(h, policy(spark, uses_exit_model=False)))
    wild = reasons(U.exits_model(h, policy(spark, wild=True)))
    assert wild["young"].endswith("(held 4 sessions)") and "crash" not in wild
    asked = h.filter("symbol = 'young'").withColumns({"live": F.lit(True), "age": F.lit(None).cast("int")})
    assert reasons(U.exits_model(asked, policy(spark, wild=True))) == {
        "young": "model exit model (live, at 100.00): switching expected to beat holding by 5.00% over 10 sessions (held 0 sessions)"}


def test_forced_exits(spark):
    h = held(spark, *[(s, 100.0, 100.0, p, "2026-09-01 10:00") for s, p in (
        ("GOLDBEES.NS", "delivery"), ("TCS.NS", "delivery"), ("SPUN.NS", "entitlement"))])
    rule = lambda retired, funds: spark.createDataFrame([("t", retired, funds)], "account string, retired boolean, holds_funds boolean")
    assert set(reasons(U.exits_forced(h, rule(False, False)))) == {"GOLDBEES.NS"}
    assert reasons(U.exits_forced(h, rule(False, True))) == {}
    assert set(reasons(U.exits_forced(h, rule(True, True)))) == {"GOLDBEES.NS", "TCS.NS"}


def test_due_exits(spark):
    h = held(spark, *[(s, 1.0, 1.0, "delivery", "2026-09-01 10:00") for s in "abc"]).withColumn(
        "exit_on", F.when(F.col("symbol") == "a", F.lit("2026-09-30").cast("date")).when(
            F.col("symbol") == "b", F.lit("2026-10-01").cast("date")))
    assert set(reasons(U.exits_due(h))) == {"a"}


# --- entries ---

@pytest.fixture(scope="module")
def market(spark):
    picks = spark.createDataFrame([("L", i + 1, f"S{i}.NS", 1 - i / 10, 1 - i / 100) for i in range(10)],
                                  "list string, pos int, symbol string, score double, rank_pct double")
    prices = picks.select("symbol", F.lit(100.0).alias("price"))
    ranks = picks.select("symbol", "rank_pct")
    nothing = spark.createDataFrame([], "account string, symbol string, product string")
    return picks, prices, ranks, nothing


def account(spark, name="t", cash=50_000.0, now="2026-09-22 09:45:00", **more):
    df = spark.createDataFrame([(name, "L", cash, at(now))], "account string, list string, cash double, now timestamp_ntz")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_top_five_even_tickets(spark, market):
    picks, prices, _, nothing = market
    out = U.entries_topn(account(spark), picks, prices, nothing, hold_days=5).collect()
    assert sorted(r["symbol"] for r in out) == [f"S{i}.NS" for i in range(5)]
    assert all(r["units"] == 99 and r["exit_on"] == dt.date(2026, 9, 29) for r in out)
    assert U.entries_topn(account(spark, now="2026-09-22 09:20:00"), picks, prices, nothing).collect() == []
    assert U.entries_topn(account(spark, cash=4_000.0), picks, prices, nothing).collect() == []
    some = spark.createDataFrame([("t", "S0.NS", "delivery"), ("t", "Z.NS", "delivery")], nothing.schema)
    fewer = U.entries_topn(account(spark), picks, prices, some).collect()
    assert sorted(r["symbol"] for r in fewer) == [f"S{i}.NS" for i in range(1, 5)]       # top five first, then what is held


def test_a_name_at_its_limit_fills_nothing(spark, market):
    picks, prices, _, nothing = market
    stuck = prices.withColumn("blocked", F.col("symbol") == "S1.NS")
    out = {r["symbol"]: r for r in U.entries_topn(account(spark), picks, stuck, nothing).collect()}
    assert out["S1.NS"]["units"] == 0 and out["S1.NS"]["spent"] == 0 and out["S0.NS"]["units"] == 99
    assert out["S1.NS"]["cash_after"] == out["S0.NS"]["cash_after"]


def test_random_exit_dates_hold(spark, market):
    picks, prices, _, nothing = market
    rule = U.random_hold(F.to_date("now"), F.col("symbol"))
    first, again = ({r["symbol"]: r["exit_on"] for r in U.entries_topn(account(spark), picks, prices, nothing, hold_days=rule).collect()}
                    for _ in range(2))
    assert first == again and len(set(first.values())) > 1 and all(d.weekday() < 5 for d in first.values())
    assert all(dt.date(2026, 9, 23) < d <= dt.date(2026, 11, 17) for d in first.values())


def test_confidence_entries_fill_the_free_slots(spark, market):
    picks, prices, ranks, _ = market
    book = spark.createDataFrame([("t", f"H{i}.NS", "delivery") for i in range(5)], "account string, symbol string, product string")
    out = U.entries_confidence(account(spark), picks, prices, book, ranks).orderBy("pos").collect()
    assert [r["symbol"] for r in out] == ["S0.NS", "S1.NS", "S2.NS"]
    assert out[0]["units"] > out[2]["units"] and out[-1]["cash_after"] >= 0
    low = ranks.withColumn("rank_pct", F.when(F.col("symbol") == "S0.NS", 0.5).otherwise(F.col("rank_pct")))
    assert "S0.NS" not in {r["symbol"] for r in U.entries_confidence(account(spark), picks, prices, book, low).collect()}


def test_intraday_entries_need_a_measured_edge(spark, market):
    picks, prices, _, nothing = market
    scored = picks.withColumn("expected_net", F.when(F.col("pos") == 2, 0.02).when(F.col("pos") == 3, 0.03).otherwise(0.001))
    out = U.entries_intraday(account(spark, now="2026-09-22 10:30:00"), scored, prices, nothing).orderBy("pos").collect()
    assert [r["symbol"] for r in out] == ["S1.NS", "S2.NS"] and {r["product"] for r in out} == {"intraday"}
    best = U.entries_intraday(account(spark, cash=9_000.0, now="2026-09-22 10:30:00"), scored, prices, nothing, by_edge=True)
    assert [r["symbol"] for r in best.collect()] == ["S2.NS"]
    assert U.entries_intraday(account(spark), scored, prices, nothing).collect() == []        # before 10:20


def test_cost_aware_entries_respect_cap_and_bar(spark, market):
    picks, prices, ranks, nothing = market
    none = spark.createDataFrame([], "account string, symbol string")
    out = U.entries_cost_aware(account(spark), picks, prices, nothing, ranks, none).collect()
    assert out and max(r["units"] * 100.0 for r in out) <= (max(0.30, 1 / len(out)) + 0.02) * 50_000
    bar = spark.createDataFrame([("t", "S0.NS")], none.schema)
    again = U.entries_cost_aware(account(spark), picks, prices, nothing, ranks, bar).collect()
    assert "S0.NS" not in {r["symbol"] for r in again}


def model_world(spark, expected, wait=None):
    order = sorted(expected, key=lambda s: -expected[s])
    picks = spark.createDataFrame([("L", i + 1, s, expected[s], (wait or {}).get(s)) for i, s in enumerate(order)],
                                  "list string, pos int, symbol string, expected double, wait double")
    return picks, picks.select("symbol", F.lit(100.0).alias("price")), picks.select("symbol", "expected")


def buy_model(spark, world, book=None, bar=None, **flags):
    picks, prices, expected = world
    flags = {"equity": 200_000.0, "wild": False, "waits": False, "power": 0.0, **flags}
    book = spark.createDataFrame(book or [], "account string, symbol string, product string")
    bar = spark.createDataFrame(bar or [], "account string, symbol string")
    out = U.entries_model(account(spark, cash=200_000.0, **flags), picks, prices, book, bar, expected)
    return {r["symbol"]: r["units"] * r["fill"] for r in out.collect()}


def test_model_entries(spark):
    exp = {**{s: 0.05 - i * 0.002 for i, s in enumerate(NAMES[:7])}, "HHH.NS": 0.001}
    even = buy_model(spark, model_world(spark, exp))
    assert sorted(even) == NAMES[:6] and all(30_000 < v < 34_000 for v in even.values())
    picks, prices, expected = model_world(spark, exp)
    nobody, flags = spark.createDataFrame([], "account string, symbol string, product string"), {"wild": False, "waits": False, "power": 0.0}
    old = picks.withColumn("asof", F.lit("2026-09-10").cast("date"))
    for today, bought in (("2026-09-11", 6), ("2026-09-22", 0)):                # stale picks buy nothing
        out = U.entries_model(account(spark, cash=200_000.0, equity=200_000.0, **flags), old, prices, nobody, nobody, expected, today)
        assert out.count() == bought
    poor = buy_model(spark, model_world(spark, {"AAA.NS": 0.05, "HHH.NS": 0.001}))
    assert set(poor) == {"AAA.NS"}
    waiting = model_world(spark, exp, {"AAA.NS": 0.004, "BBB.NS": -0.002})
    assert sorted(buy_model(spark, waiting, waits=True)) == NAMES[1:6]          # its slot stays empty
    assert "AAA.NS" in buy_model(spark, waiting)
    assert buy_model(spark, model_world(spark, exp), entered=True) == {}
    assert "AAA.NS" not in buy_model(spark, model_world(spark, exp), bar=[("t", "AAA.NS")])
    kept = buy_model(spark, model_world(spark, exp), book=[("t", "E.NS", "entitlement"), ("t", "BBB.NS", "delivery")])
    assert sorted(kept) == ["AAA.NS", "CCC.NS", "DDD.NS", "EEE.NS", "FFF.NS"]    # an entitlement takes no slot


def test_conviction_entries(spark):
    wide = {s: 0.09 - i * 0.012 for i, s in enumerate(NAMES[:6])}
    conv = buy_model(spark, model_world(spark, wide), power=2.0)
    assert conv["AAA.NS"] > conv.get("FFF.NS", 0) and max(conv.values()) <= 60_001 and sum(conv.values()) <= 200_000
    wild = buy_model(spark, model_world(spark, wide), power=2.0, wild=True)
    assert len(wild) == 3 and max(wild.values()) > 60_000


def test_reversion_buys_the_laggard_only(spark):
    names = [f"N{i:02d}" for i in range(30)]
    px = {s: 101.0 for s in names} | {"N00": 95.0}
    moves = spark.createDataFrame([(1, s, p, p / 100 - 1) for s, p in px.items()], "tick int, symbol string, price double, move double")
    sec = U.cross_section(moves, ["tick"])
    acc = spark.createDataFrame([("t", 1, 50_000.0, 50_000.0)], "account string, tick int, cash double, equity double")
    none = spark.createDataFrame([], "account string, tick int, symbol string")
    out = U.reversion_entries(sec, ["tick"], acc, none).collect()
    assert [r["symbol"] for r in out] == ["N00"] and out[0]["units"] * out[0]["fill"] <= 6_000
    poor = spark.createDataFrame([("t", 1, 4_999.0, 50_000.0)], acc.schema)
    assert U.reversion_entries(sec, ["tick"], poor, none).collect() == []
    closed = moves.withColumn("move", F.when(F.col("symbol") == "N00", 0.009).otherwise(F.col("move")))
    mine = spark.createDataFrame([("t", 1, "N00", 95.0, 100.9)], "account string, tick int, symbol string, avg_price double, price double")
    assert reasons(U.reversion_exits(mine, U.cross_section(closed, ["tick"]), ["tick"])) == {"N00": "gap closed +6.21%"}
    for clock, why in (("15:05", {"N00": "flat before the close"}), ("09:29", {})):
        late = mine.withColumn("now", F.lit(at(f"2026-09-30 {clock}")))
        assert reasons(U.reversion_exits(late, sec.limit(0), ["tick"])) == why
        assert U.reversion_entries(sec, ["tick"], acc.withColumn("now", F.lit(at(f"2026-09-30 {clock}"))), none).isEmpty()
    flat = U.cross_section(moves.withColumn("move", F.lit(0.0)), ["tick"])
    assert U.reversion_entries(flat, ["tick"], acc, none).collect() == []
    assert U.cross_section(moves.limit(11), ["tick"]).filter("z IS NOT NULL").count() == 0


def test_live_exit_features(spark):
    inputs = spark.createDataFrame([("A", 100.0, 110.0), ("B", 0.0, 1.0)], "symbol string, base double, peak_px double")
    px = spark.createDataFrame([("A", 104.0), ("B", 2.0)], "symbol string, price double")
    (r,) = U.live_exit_features(inputs, px).collect()
    assert (r["gain"], r["peak_gain"]) == (pytest.approx(0.04), pytest.approx(0.10))
    assert r["from_peak"] == pytest.approx(1.04 / 1.10 - 1)


def test_weekly_option(spark):
    days = spark.createDataFrame([("I", dt.date(2026, 9, 21), 25_010.0, 0.14), ("I", dt.date(2026, 9, 22), 25_010.0, 0.14)],
                                 "symbol string, date date, close double, vol double")
    (buy,) = U.option_entries(days).collect()
    assert (buy["strike"], buy["expiry"], buy["units"]) == (25_000.0, dt.date(2026, 9, 24), 75)
    held_option = days.limit(1).select("symbol", F.lit(25_000.0).alias("strike"), F.lit("2026-09-24").cast("date").alias("expiry"),
                                       F.lit(0.14).alias("vol"))
    spot = lambda d, c: held_option.withColumns({"date": F.lit(d).cast("date"), "close": F.lit(c)})
    assert U.option_exits(spot("2026-09-23", 25_100.0)).collect() == []
    assert U.option_exits(spot("2026-09-24", 25_100.0)).first()["premium"] == 100.0


# --- filters ---

def test_company_and_quote_filters(spark):
    s = spark.createDataFrame([("GOLDBEES.NS",), ("TCS.NS",), ("TCS.ETF",), ("bad.NS",), ("niftyx.NS",)], "symbol string")
    block = spark.createDataFrame([("bad.NS",)], "symbol string")
    assert sorted(r[0] for r in L.companies_only(s, block).collect()) == ["TCS.ETF", "TCS.NS"]
    assert sorted(r[0] for r in L.not_companies(s, block).collect()) == ["GOLDBEES.NS", "bad.NS", "niftyx.NS"]
    stamp = int(dt.datetime(2026, 10, 20, 20, 0, tzinfo=dt.timezone.utc).timestamp())        # 01:30 on the 21st, local
    q = spark.createDataFrame(
        [("A.NS", 100.0, 5, stamp), ("B.NS", 100.0, 5, stamp * 1000), ("^I", 100.0, 5, stamp), ("C.NS", 0.0, 5, stamp),
         ("D.NS", 1.0, 0, stamp), ("E.NS", 1.0, 5, stamp - 7200), ("F.NS", 1.0, 5, None)],
        "symbol string, ltp double, volume bigint, last_trade_epoch bigint")
    assert sorted(r["symbol"] for r in L.valid_quotes(q, "2026-10-21").collect()) == ["A.NS", "B.NS"]


def test_circuit_bands_block_one_side(spark):
    q = spark.createDataFrame([("U", 120.0), ("D", 80.05), ("M", 100.0)], "symbol string, ltp double").withColumns(
        {"band_hi": F.lit(120.1), "band_lo": F.lit(80.0)})
    flags = L.circuit_flag(q)
    assert {r["symbol"]: r["at_limit"] for r in flags.collect()} == {"U": "upper", "D": "lower", "M": None}
    orders = spark.createDataFrame([(s, side) for s in "UDM" for side in ("BUY", "SELL")], "symbol string, side string")
    fill, stuck = L.split_blocked(orders, flags)
    assert fill.count() == 4
    assert {(r["symbol"], r["side"]): r["blocked"] for r in stuck.collect()} == {
        ("U", "BUY"): "upper circuit", ("D", "SELL"): "lower circuit"}


def test_freshness_bars_and_gaps(spark):
    p = spark.createDataFrame([("2026-09-26",), ("2026-09-25",), ("2026-12-01",), ("unknown",), (None,)], "asof string")
    assert sorted(r[0] for r in L.fresh_picks(p, "2026-09-30").collect()) == ["2026-09-26", "2026-12-01"]
    ledger = spark.createDataFrame([("a", "x", "SELL", at("2026-09-30 10:00")), ("a", "y", "BUY", at("2026-09-30 10:00")),
                                    ("a", "z", "SELL", at("2026-09-29 10:00"))], "account string, symbol string, side string, time timestamp_ntz")
    assert [tuple(r) for r in L.barred(ledger, "2026-09-30").collect()] == [("a", "x")]
    said = ledger.withColumn("reason", F.when(F.col("symbol") == "x", "deteriorated").otherwise("disaster stop"))
    assert L.barred(said, "2026-09-30", ["disaster stop"]).collect() == []
    assert [tuple(r) for r in L.barred(said, "2026-09-30", ["deteriorated"]).collect()] == [("a", "x")]
    pos = spark.createDataFrame([("a", "x", 100.0), ("b", "y", 100.0), ("c", "z", None)], "account string, symbol string, prev_close double")
    px = spark.createDataFrame([("x", 75.0), ("y", 74.9), ("z", 1.0)], "symbol string, price double")
    assert [r[0] for r in L.corporate_gaps(pos, px).collect()] == ["y"]
    assert sorted(r["symbol"] for r in L.without_gaps(px, pos).collect()) == ["x", "z"]


def test_accounts_go_down_a_list_no_further_than_they_need(spark):
    """Rows joined per account follow from its slots and bars; what is free behind many bars is still found."""
    lists = spark.createDataFrame([(name, i, f"s{i}") for name, n in (("long", 500), ("short", 3)) for i in range(n)], "list string, pos int, symbol string")
    accounts = spark.createDataFrame([("a", "long", 4), ("b", "long", 40), ("c", "short", 9), ("d", "none", 2), ("e", "long", 1)],
                                     "account string, list string, slots int")
    held = spark.createDataFrame([("a", f"s{i}") for i in range(60)] + [("c", "s1"), ("e", "s400")], "account string, symbol string")
    met = U._down_the_list(U._barring(accounts, held), lists, F.col("slots"), ["pos"])
    counts = {r["account"]: r["count"] for r in met.groupBy("account").count().collect()}
    assert counts == {"a": 64, "b": 40, "c": 3, "e": 2}
    free = {}
    for r in U._not_held(met, held).orderBy("pos").collect():
        free.setdefault(r["account"], []).append(r["symbol"])
    assert free["a"] == [f"s{i}" for i in range(60, 64)] and free["c"] == ["s0", "s2"] and free["e"][0] == "s0"
    joined = [x for x in met._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x]
    assert any("_block" in x and "list" in x for x in joined)


@pytest.mark.parametrize("name", ["d09_entries_intraday", "d10_entries_cost_aware", "d11_entries_model"])
def test_accounts_are_not_dealt_by_the_list_they_follow(spark, name):
    import re
    from tickloom.plans import load
    plan = load()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*_block", plan)


def test_live_exits_put_only_needed_columns_in_order(spark, monkeypatch):
    from tickloom.plans import decisions as P
    seen, real = [], P.L.every_nth
    monkeypatch.setattr(P.L, "every_nth", lambda ticks, n: seen.append(ticks.columns) or real(ticks, n))
    P.d05_chain(spark, "/root/testdata/sf0.001")
    assert seen == [["account", "ts", "seq", "qty", "age"]]
