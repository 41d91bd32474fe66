import datetime as dt
import random
import statistics

import pytest

from checks import is_fold
from tickloom.operators import books as B
from tickloom.operators import corporate as S


def fills_of(seed, groups, low, high, days):
    rng = random.Random(seed)
    rows, want = [], {}
    for g in range(groups):
        fills = [(rng.choice(["BUY", "SELL", "BUY"]), rng.randint(1, 40), round(rng.uniform(5, 900), 2))
                 for _ in range(rng.randint(low, high))]
        at = sorted(rng.randint(0, days * 24 - 1) for _ in fills)
        for i, (f, h) in enumerate(zip(fills, at)):
            rows.append((f"a{g % 2}", f"s{g}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), i, *f, "delivery", "zerodha"))
        want[f"a{g % 2}", f"s{g}"] = fills
    return rows, want


SCHEMA = "account string, symbol string, time timestamp_ntz, seq int, side string, qty bigint, price double, product string, broker string"


def test_ledger_fold_of_short_and_long_groups(spark):
    rows, want = fills_of(11, 9, 1, 150, 6)
    got = B.fold_ledger(spark.createDataFrame(rows, SCHEMA), ["time", "seq"]).orderBy("account", "symbol", "time", "seq").collect()
    assert len(got) == len(rows)
    for (account, symbol), fills in want.items():
        is_fold(fills, [(r["units"], r["qty_after"], r["avg_after"]) for r in got if (r["account"], r["symbol"]) == (account, symbol)])


def test_a_day_of_a_hundred_thousand_fills(spark):
    """Two bought at 10 and one sold, over and over, is one plan without a job while it is built."""
    df = spark.range(100_000).selectExpr(
        "'a' as account", "'s' as symbol", "timestamp_ntz'2024-01-01 10:00:00' as time", "id as seq",
        "case when id % 2 = 0 then 'BUY' else 'SELL' end as side", "case when id % 2 = 0 then 2 else 1 end as qty",
        "10.0D as price", "'delivery' as product", "'zerodha' as broker")
    last = B.fold_ledger(df, ["time", "seq"]).orderBy("seq", ascending=False).first()
    assert (last["qty_after"], last["avg_after"]) == (50_000, 10.0)


def test_realised_profit_and_positions(spark):
    rows = [("a", "x", dt.datetime(2024, 1, d), d, side, q, p, "delivery", "zerodha") for d, side, q, p in [
        (1, "BUY", 10, 100.0), (2, "BUY", 10, 120.0), (3, "SELL", 5, 130.0), (4, "SELL", 99, 90.0), (5, "BUY", 3, 50.0)]]
    folded = B.fold_ledger(spark.createDataFrame(rows, SCHEMA), ["time", "seq"])
    done = {r["seq"]: r for r in B.realised(folded).collect()}
    assert done[3]["pnl"] == pytest.approx(5 * 130 - done[3]["costs"] - 5 * 110)
    assert done[4]["units"] == 15 and done[4]["qty_after"] == 0 and done[1]["pnl"] is None
    held = B.positions_from_ledger(folded, ["time", "seq"]).collect()
    assert [(r["qty"], r["avg_price"], r["opened"]) for r in held] == [(3, 50.0, dt.datetime(2024, 1, 5))]


def holding(spark, qty, avg, opened, last=None, product="delivery", splits=None):
    return spark.createDataFrame(
        [("t", "X.NS", qty, avg, dt.datetime.fromisoformat(opened), product, last, splits)],
        "account string, symbol string, qty bigint, avg_price double, opened timestamp_ntz, product string, "
        "last_price double, splits array<date>")


def actions(spark, *events):
    return spark.createDataFrame([("X.NS", dt.date.fromisoformat(d), r) for d, r in events], "symbol string, ex_date date, ratio double")


def test_split_keeps_the_value_and_applies_once(spark):
    twice = actions(spark, ("2026-10-06", 2.0), ("2026-10-06", 2.0))
    first = S.apply_splits(holding(spark, 102, 324.5, "2026-09-30T10:21:00", 320.0), twice)
    r = first.first()
    assert (r["qty"], r["avg_price"], r["last_price"]) == (204, 162.25, 160.0) and len(r["applied"]) == 1
    again = S.apply_splits(first.drop("applied"), twice).first()
    assert again["qty"] == 204 and again["applied"] == []
    assert S.action_log(first).collect()[0].asDict() == {
        "account": "t", "symbol": "X.NS", "ex_date": dt.date(2026, 10, 6), "ratio": 2.0, "qty_before": 102, "qty_after": 204}


def test_splits_that_do_not_apply(spark):
    event = actions(spark, ("2026-10-06", 2.0))
    assert S.apply_splits(holding(spark, 10, 160.0, "2026-10-06T10:00:00"), event).first()["qty"] == 10
    assert S.apply_splits(holding(spark, 10, 160.0, "2026-01-06T10:00:00", product="option"), event).first()["qty"] == 10
    odd = S.apply_splits(holding(spark, 7, 300.0, "2026-09-01T10:00:00"), actions(spark, ("2026-10-06", 1.5), ("2026-10-09", 1.0)))
    assert odd.first()["qty"] == 10


def test_marks_and_equity(spark):
    pos = spark.createDataFrame([("a", "x", 2, 10.0, None), ("a", "y", 1, 10.0, 7.0), ("a", "z", 1, 10.0, 7.0)],
                                "account string, symbol string, qty bigint, avg_price double, last_price double")
    px = spark.createDataFrame([("z", 20.0)], "symbol string, price double")
    acc = spark.createDataFrame([("a", 5.0), ("b", 9.0)], "account string, cash double")
    got = {r["account"]: r["equity"] for r in B.account_equity(acc, pos, px).collect()}
    assert got == {"a": 5 + 20 + 7 + 20, "b": 9.0}


def test_closes_gate_marks(spark):
    pos = spark.createDataFrame(
        [("a", f"s{i}", 1, 10.0, "delivery", 9.0, 10.0 if i else 100.0) for i in range(10)],
        "account string, symbol string, qty bigint, avg_price double, product string, last_price double, prev_close double")
    px = lambda n: spark.createDataFrame([(f"s{i}", 11.0) for i in range(n)], "symbol string, price double")
    enough = {r["symbol"]: r["last_price"] for r in B.mark_close(pos, px(9)).collect()}
    assert enough == {"s0": 9.0, **{f"s{i}": 11.0 for i in range(1, 9)}, "s9": 9.0}     # s0 is a corporate action
    assert {r["last_price"] for r in B.mark_close(pos, px(8)).collect()} == {9.0}


def test_allocator_starts_equal_and_follows_strength(spark):
    rows = []
    for d in range(30):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
        rows += [("up", t, 1, 200_000.0 * 1.01 ** d * (1 + 0.001 * (d % 2))), ("down", t, 1, 200_000.0 * 0.99 ** d)]
    eq = spark.createDataFrame(rows, "account string, time timestamp_ntz, seq int, equity double")
    w = {(r["account"], r["day"].day): r["weight"] for r in B.allocator_weights(eq).collect()}
    assert all(w["up", d] == 0.5 for d in range(1, 6)) and w["up", 10] == pytest.approx(1.0) and w["down", 10] == 0.0
    value = B.allocator(eq).orderBy("day").collect()
    assert value[0]["equity"] == 200_000 and value[-1]["equity"] > 200_000
    assert [r["turnover"] for r in value][5] == pytest.approx(0.5)


def test_volatility_defaults_when_history_is_short(spark):
    rows = [("short", dt.date(2024, 1, d), 100.0 + d) for d in range(1, 12)]
    rows += [("long", dt.date(2024, 1, d), 100.0 * (1.01 if d % 2 else 1.0)) for d in range(1, 31)]
    vol = {r["symbol"]: r["vol"] for r in B.annual_vol(spark.createDataFrame(rows, "symbol string, date date, close double")).collect()}
    assert vol["short"] == 0.2 and vol["long"] > 0.1 and vol["long"] != 0.2


def test_trend_needs_more_than_the_window(spark):
    rows = [("x", dt.date(2023, 1, 1) + dt.timedelta(days=d), 100.0 + d) for d in range(205)]
    out = B.trend_flag(spark.createDataFrame(rows, "symbol string, date date, close double")).orderBy("date").collect()
    assert [r["above"] for r in out].index(True) == 200


@pytest.mark.parametrize("lookback", [6, 20])
def test_allocator_matches_the_whole_grid(spark, lookback):
    """Against a grid of all accounts by all days in plain Python: gaps, late starts, idle, null and ruined accounts."""
    rng = random.Random(lookback)
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(45)]
    marks = {}
    for n in range(9):
        value = 200_000.0
        for i, day in enumerate(days):
            if n == 0 or (rng.random() < (0.1, 0.3, 0.9, 1.0)[n % 4] and i >= 3 * n):
                value *= 1 if n == 1 else 1 + rng.gauss(0.002, 0.01 if i != 20 else 0.9)
                marks[f"a{n}", day] = None if rng.random() < 0.05 else 0.0 if n == 5 and i > 30 else value
    marks["never", days[7]] = None
    rows = [(a, dt.datetime.combine(d, dt.time(15)), 1, e) for (a, d), e in marks.items()]
    equity = spark.createDataFrame(rows, "account string, time timestamp_ntz, seq int, equity double")

    accounts, seen = sorted({a for a, _ in marks}), sorted({d for _, d in marks})
    rets, scores = {}, {}
    for a in accounts:
        last, line = 200_000.0, []
        for d in seen:
            now = marks.get((a, d))
            now = last if now is None else now
            line.append(now / last - 1 if line and last else 0.0)
            last = now
        rets[a] = line
        for i in range(len(seen)):
            span = line[max(0, i - lookback):i]
            sd = statistics.stdev(span) if len(span) >= 5 else 0
            scores[a, i] = max(statistics.fmean(span) / sd, 0) if sd else 0.0
    weight, want, value = {}, [], 1.0
    for i, d in enumerate(seen):
        total = sum(scores[a, i] for a in accounts)
        for a in accounts:
            weight[a, i] = scores[a, i] / total if total > 0 else 1 / len(accounts)
        gain = sum(weight[a, i] * rets[a][i] for a in accounts)
        turnover = sum(abs(weight[a, i] - weight[a, i - 1]) / 2 for a in accounts) if i else 0.0
        value *= (1 + gain) * (1 - turnover * 0.002)
        want.append((d, gain, turnover, value * 200_000))
    got = {(r["account"], r["day"]): r for r in B.allocator_weights(equity, lookback).collect()}
    assert len(got) == len(accounts) * len(seen)
    for i, d in enumerate(seen):
        for a in accounts:
            assert got[a, d]["weight"] == pytest.approx(weight[a, i], abs=1e-9) and got[a, d]["ret"] == pytest.approx(rets[a][i], abs=1e-12)
            assert got[a, d]["moved"] == pytest.approx(abs(weight[a, i] - weight[a, max(i - 1, 0)]) / 2, abs=1e-9)
    book = B.allocator(equity, lookback).orderBy("day").collect()
    assert [r["day"] for r in book] == seen
    for r, (_, gain, turnover, value) in zip(book, want, strict=True):
        assert (r["ret"], r["turnover"], r["equity"]) == pytest.approx((gain, turnover, value), rel=1e-7, abs=1e-9)
    table = B.allocator_table(equity, ["a2", "nobody"], lookback).orderBy("day").collect()
    assert [r["w_a2"] for r in table] == pytest.approx([round(weight["a2", i], 3) for i in range(len(seen))], abs=1.1e-3)
    assert B.allocator(equity.limit(0)).collect() == []


def test_average_that_stands_for_a_tie_goes_up(spark):
    """3680.715 as a fold leaves it: a hair below, which is no reason to report another cent than the exact average."""
    from tickloom.operators.reports import holdings_report
    held = spark.createDataFrame([("a", "x", 4, 3680.7149999999997, 1.005), ("a", "y", 1, 2.0, 2.004)], "account string, symbol string, qty int, avg_price double, mark double")
    assert [(r["avg_price"], r["last"]) for r in holdings_report(held).orderBy("symbol").collect()] == [(3680.72, 1.01), (2.0, 2.0)]


def test_summaries_fold_the_ledger_once(spark):
    """The fold's result is read by one aggregation per holding; cash, positions and summaries follow from what that wrote."""
    from tickloom.plans import books as P
    for query in (P.a04, P.a16):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan


def test_holdings_are_counted_only_where_a_symbol_may_be_hot(spark, monkeypatch):
    """A symbol has at least the fills of each of its holdings, so few fills of every symbol spare the count."""
    from tickloom.plans import books as P
    lines = []
    monkeypatch.setattr(P.B, "fold_ledger", lambda ledger, order, hot: lines.append(hot))
    P.folded(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(P, "HOT", 2)
    P.folded(spark, "/root/testdata/sf0.001")
    assert lines == [None, 2]


def test_alerts_fold_the_ledger_once(spark, monkeypatch):
    from tickloom.plans import books as P
    monkeypatch.setattr(P, "saved", lambda df: df.localCheckpoint())
    plan = P.r05(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "lineitem" not in plan and "Window" not in plan
