"""Sequences split into parts give what a loop gives, wherever the parts are cut."""

import random

import pytest
from checks import is_fold
from pyspark.sql import functions as F

from tickloom.operators import books as B, costs as K
from tickloom.operators.filters import every_nth
from tickloom.operators.scans import affine

SCHEMA = "account string, symbol string, time int, side string, qty bigint, price double"


def folded(spark, rows, hot):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = B.fold_ledger(df, ["time"], hot=hot).collect()
    assert len(got) == len(rows)
    out = {}
    for r in sorted(got, key=lambda r: r["time"]):
        out.setdefault((r["account"], r["symbol"]), []).append(r)
    return out


def loop(fills):
    qty, avg, out = 0, 0.0, []
    for _, _, _, side, n, price in fills:
        after = max(qty + (n or 0) * (1 if side == "BUY" else -1), 0)
        if after > qty:
            avg = None if avg is None or price is None else (avg * qty + (after - qty) * price) / after
        out.append((abs(after - qty), after, avg))
        qty = after
    return out


@pytest.mark.parametrize("hot", [1_000_000, 10])
def test_one_holding_with_most_fills(spark, hot):
    rng = random.Random(2)
    rows = []
    for i in range(4_000):
        key = ("a", "x") if rng.random() < 0.6 else (rng.choice("bcd"), rng.choice("xyz"))
        rows.append((*key, i, rng.choice(["BUY", "SELL"]), rng.randint(0, 30), rng.uniform(1, 1e5)))
    got = folded(spark, rows, hot)
    assert max(map(len, got.values())) > 2_000
    for (account, symbol), found in got.items():
        fills = [(r[3], r[4], r[5]) for r in rows if r[:2] == (account, symbol)]
        is_fold(fills, [(r["units"], r["qty_after"], r["avg_after"]) for r in found])


@pytest.mark.parametrize("hot", [1_000_000, 500])
def test_averages_keep_their_digits(spark, hot):
    """Thousands of halvings: the product of the weights is far below what a double can hold."""
    rows = [("a", "x", 0, "BUY", 1, 5.0)]
    for i in range(3_000):
        rows += [("a", "x", 2 * i + 1, "BUY", 1, 100.0 + i), ("a", "x", 2 * i + 2, "SELL", 1, 1.0)]
    found = folded(spark, rows, hot)["a", "x"]
    for r, (units, qty, avg) in zip(found, loop(rows), strict=True):
        assert (r["units"], r["qty_after"]) == (units, qty) and r["avg_after"] == pytest.approx(avg, rel=1e-11)


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_nulls_in_a_ledger(spark, hot):
    rows = [("a", "x", 1, "BUY", 5, 10.0), ("a", "x", 2, "BUY", None, 3.0), ("a", "x", 3, "SELL", 9, None), ("a", "x", 4, "BUY", 2, 7.0),
            ("a", "x", 5, "BUY", 2, None), ("a", "x", 6, "SELL", 9, 1.0), ("a", "x", 7, "BUY", 1, 4.0),
            (None, "x", 1, "BUY", 5, 10.0), (None, "x", 2, "SELL", 2, 10.0), (None, None, 1, "SELL", 3, 1.0), ("b", "x", 1, "SELL", 3, 1.0)]
    for key, found in folded(spark, rows, hot).items():
        assert [(r["units"], r["qty_after"], r["avg_after"]) for r in found] == loop([r for r in rows if r[:2] == key])
    assert folded(spark, [], hot) == {}


def test_no_python_in_the_fold(spark):
    plan = B.fold_ledger(spark.createDataFrame([("a", "x", 1, "BUY", 5, 10.0)] * 3, SCHEMA), ["time"], hot=1)._jdf.queryExecution().executedPlan()
    assert "InArrow" not in plan.toString() and "Python" not in plan.toString()


def test_affine_values_follow_their_recurrence(spark):
    rng = random.Random(4)
    rows, want, x = [], [], 0.0
    for i in range(2_000):
        f, t = rng.choice([1.0, 0.5, 1e-3, 2.0 ** -60, rng.random(), 1e-250 if i % 50 == 0 else 1.0]), rng.uniform(-5, 5)
        x = x * f + t
        rows.append(("k", i, f, t))
        want.append(x)
    got = affine(spark.createDataFrame(rows, "k string, i int, f double, t double"), ["k"], ["i"], "f", "t", "x").orderBy("i").collect()
    assert [r["x"] for r in got] == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_every_third_tick_of_a_hot_day(spark, hot):
    rows = [("a", 1, i, "x") for i in range(1_500)] + [("b", d, i, "x") for d in range(5) for i in range(30)] + [(None, 1, 1, "x")] * 1
    ticks = spark.createDataFrame(rows, "account string, day int, seq int, nth string").select(
        "account", F.expr("timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(day)").alias("ts"), "seq").repartition(5)
    got = {}
    for r in every_nth(ticks, 3, hot=hot).collect():
        got.setdefault(r["account"], set()).add((r["nth"], r["ts"].day - 1, r["seq"]))
    for account in ("a", "b"):
        order = sorted((d, i) for a, d, i, _ in rows if a == account)
        assert got[account] == {(n, *order[n - 1]) for n in range(3, len(order) + 1, 3)}


@pytest.mark.parametrize("floor,stop,cash_floor", [(0.0, False, 0.0), (900.0, False, 0.0), (900.0, True, 0.0), (0.0, False, 3_000.0)])
def test_buys_of_a_split_account(spark, floor, stop, cash_floor):
    rng = random.Random(8)
    data = []
    for account, cash in (("a", 4e5), ("b", 1e12), ("c", 2_500.0), (None, 9e4), ("d", None)):
        data += [(account, i, rng.choice([None, rng.uniform(200, 6000)]) if i % 40 == 39 else rng.uniform(950, 6000), cash, rng.uniform(10, 900),
                  i % 9 == 4, 1 + i % 3) for i in range(300)]
    df = spark.createDataFrame(data, "account string, pos int, budget double, cash double, fill double, blocked boolean, lot int")
    df = df.withColumns({"product": F.lit("delivery"), "broker": F.lit("groww")}).repartition(6)

    def rows(hot):
        out = K.fill_batch(df, ["account"], ["pos"], floor, stop, cash_floor, hot=hot).collect()
        return {(r["account"], r["pos"]): (r["units"], r["spent"], r["cash_after"]) for r in out}

    whole, split = rows(None), rows(20)
    assert len(whole) == len(data) and whole.keys() == split.keys()
    for key, (units, spent, after) in whole.items():
        assert split[key][0] == units and split[key][1] == pytest.approx(spent) and split[key][2] == pytest.approx(after, abs=1e-4)
    assert all(v == (0, 0.0, None) for k, v in whole.items() if k[0] == "d")


def test_cash_that_never_binds_needs_no_purse(spark):
    """All that passes by the purse of a hot account comes after its cash binds: here nothing does."""
    df = spark.range(50_000).selectExpr("'a' as account", "id as pos", "100.0D as budget", "1e12D as cash", "9.0D as fill",
                                        "'delivery' as product", "'zerodha' as broker", "1 as lot")
    out = K.fill_batch(df, ["account"], ["pos"], hot=1_000)
    assert out.groupBy("units").count().collect() == [(11, 50_000)]
    purse = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "_binds" in line and "> 0" in line]
    assert purse
