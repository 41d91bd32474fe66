import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import money as M
from tickloom.functions.options import atm_strike, normal_cdf, price_calls
from tickloom.operators import costs as K


def charged(spark, side, product, value, broker="zerodha"):
    df = spark.createDataFrame([(side, product, float(value), broker)], "side string, product string, value double, broker string")
    return K.charge_orders(df).first()


def test_charges_on_a_ten_thousand_order(spark):
    buy = charged(spark, "buy", "delivery", 10_000)
    assert buy["brokerage"] == 0 and buy["transaction_tax"] == pytest.approx(10) and buy["stamp"] == pytest.approx(1.5)
    assert charged(spark, "sell", "delivery", 10_000)["depository"] == pytest.approx(15.34)
    intraday = charged(spark, "sell", "intraday", 10_000)
    assert intraday["brokerage"] == pytest.approx(3) and intraday["transaction_tax"] == pytest.approx(2.5)
    assert charged(spark, "buy", "delivery", 10_000, "groww")["brokerage"] == pytest.approx(10)
    assert charged(spark, "buy", "delivery", 1_000, "groww")["brokerage"] == 5
    assert charged(spark, "sell", "delivery", 99, "groww")["depository"] == 0


def test_sizes_fit_and_one_lot_more_does_not(spark):
    rng = random.Random(7)
    orders = []
    for i in range(3000):
        cash = rng.uniform(0, 300_000)
        orders.append((i, cash * rng.choice([0.3, 1.0, 2.0]), cash, round(rng.uniform(0.5, 4000), 4),
                       rng.choice(["delivery", "intraday", "option"]), rng.choice(["zerodha", "groww"]), rng.choice([1, 1, 1, 5, 75])))
    df = spark.createDataFrame(orders, "id int, budget double, cash double, fill double, product string, broker string, lot int")
    product, broker = F.col("product"), F.col("broker")
    # cash that just covers some number of units, charges included, is where rounding bites
    exact = df.filter("lot = 1").withColumn("n", F.ceil(F.col("id") / 10)).withColumn("value", F.col("n") * F.col("fill"))
    exact = exact.withColumn("cash", F.col("value") + M.total_charge("buy", product, F.col("value"), broker) + F.when(F.col("id") % 2 == 0, 1e-6).otherwise(-1e-6))
    exact = exact.withColumn("budget", F.col("cash"))
    df = df.unionByName(exact.select(*df.columns))
    sized = K.size_orders(df).withColumn("value", F.col("units") * F.col("fill")).withColumn("more", (F.col("units") + F.col("lot")) * F.col("fill"))
    sized = sized.withColumns({"cost": F.col("value") + M.total_charge("buy", product, F.col("value"), broker),
                               "cost_more": F.col("more") + M.total_charge("buy", product, F.col("more"), broker)})
    fits = (F.col("units") == 0) | ((F.col("cost") <= F.col("cash")) & (F.col("value") <= F.col("budget") * (1 + 1e-12)))
    largest = (F.col("cost_more") > F.col("cash")) | (F.col("more") > F.least("budget", "cash") * (1 - 1e-12))
    assert sized.filter(~(fits & largest & (F.col("units") % F.col("lot") == 0) & (F.col("units") >= 0))).isEmpty()
    assert sized.filter("units > 0").count() > 2000


def test_whole_shares_and_rejections(spark):
    df = spark.createDataFrame([(50_000.0, 50_000.0, 30_000.0), (50_000.0, 50_000.0, 90_000.0), (0.0, 10.0, 5.0)],
                               "budget double, cash double, fill double")
    df = df.withColumns({"product": F.lit("delivery"), "broker": F.lit("zerodha"), "lot": F.lit(1)})
    assert [r["units"] for r in K.size_orders(df).collect()] == [1, 0, 0]


@pytest.mark.parametrize("floor,stop,cash_floor", [(0.0, False, 0.0), (900.0, False, 0.0), (900.0, True, 0.0), (0.0, False, 5_000.0)])
def test_sequential_buys_share_one_purse(spark, floor, stop, cash_floor):
    """Each order is sized by what the ones before it left, as `size_orders` sizes it alone."""
    rng = random.Random(3)
    data = []
    for account in ("a", "b", "c"):
        cash = rng.uniform(5_000, 60_000)
        data += [(account, i, rng.uniform(200, 6000), cash, rng.uniform(10, 900), i % 9 == 4) for i in range(rng.randint(5, 40))]
    df = spark.createDataFrame(data, "account string, pos int, budget double, cash double, fill double, blocked boolean")
    df = df.withColumns({"product": F.lit("delivery"), "broker": F.lit("zerodha"), "lot": F.lit(1)})
    got = K.fill_batch(df, ["account"], ["pos"], floor, stop, cash_floor).withColumn("left", F.col("cash_after") + F.col("spent"))
    alone = K.size_orders(got.withColumnRenamed("units", "bought").withColumn("cash", F.col("left")).withColumn("budget", F.least("budget", "left")))
    rows = sorted(alone.collect(), key=lambda r: (r["account"], r["pos"]))
    stopped = {}
    for before, r in zip([None, *rows], rows):
        start = {d[0]: d[3] for d in data}[r["account"]] if before is None or before["account"] != r["account"] else before["cash_after"]
        assert r["left"] == pytest.approx(start)
        small = r["budget"] < floor
        over = stopped.get(r["account"], False) or r["left"] < cash_floor or (stop and small)
        stopped[r["account"]] = over
        assert r["bought"] == (0 if over or small or r["blocked"] else r["units"])
        assert r["bought"] > 0 or r["spent"] == 0


def test_an_account_of_a_hundred_thousand_orders(spark):
    df = spark.range(100_000).selectExpr("'a' as account", "id as pos", "100.0D as budget", "5000.0D as cash", "99.0D as fill",
                                         "'delivery' as product", "'zerodha' as broker", "1 as lot")
    out = K.fill_batch(df, ["account"], ["pos"]).groupBy("units").count().collect()
    assert {r["units"]: r["count"] for r in out} == {1: 50, 0: 99_950}


def value_of(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_small_tickets_cost_more(spark):
    cost = {v: value_of(spark, M.round_trip_cost(F.lit(float(v)))) for v in (5_000, 12_500, 37_500, 50_000)}
    assert cost[5_000] > cost[37_500] > 0
    assert cost[5_000] - cost[50_000] > 0.002
    assert value_of(spark, M.exit_cost(F.lit(12_500.0))) < cost[12_500]
    assert value_of(spark, M.round_trip_cost(F.lit(0.0))) == 1.0


def test_one_cut_off_rank(spark):
    ranks = spark.range(0, 101).select((F.col("id") / 100).alias("rank")).withColumn(
        "edge", M.edge_per_day(F.col("rank"), F.lit(12_500.0)))
    edges = [r["edge"] for r in ranks.orderBy("rank").collect()]
    assert edges[99] > 0 >= edges[55] and edges == sorted(edges)


def test_calibration_interpolates_and_gates(spark):
    points = spark.createDataFrame([(0.4, -0.01), (0.6, 0.0), (0.8, 0.02)], "score double, expected_net double")
    scores = spark.createDataFrame([(0.3,), (0.4,), (0.6,), (0.7,), (0.8,), (0.9,)], "score double")
    out = K.calibrate(scores, points).withColumn("go", K.worth_it(F.col("expected_net"))).orderBy("score").collect()
    assert [r["expected_net"] for r in out] == pytest.approx([-0.01, -0.01, 0.0, 0.01, 0.02, 0.02])
    assert [r["go"] for r in out] == [False, False, False, True, True, True]
    none = K.calibrate(scores, points.filter("score > 9")).withColumn("go", K.worth_it(F.col("expected_net")))
    assert {(r["expected_net"], r["go"]) for r in none.collect()} == {(None, False)}


def test_calibration_of_any_size(spark):
    """More points than slices, ties, nulls and scores beyond both ends, against a search in the sorted points."""
    rng = random.Random(12)
    points = sorted({round(rng.gauss(0, 1) ** 3, 3): rng.uniform(-1, 1) for _ in range(9_000)}.items())
    xs = [x for x, _ in points]
    asked = [rng.gauss(0, 2) ** 3 for _ in range(3_000)] + xs[::50] + [None, -1e9, 1e9]
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(asked)], "id int, score double, _slice string")
    got = {r["id"]: r["expected_net"] for r in K.calibrate(df, spark.createDataFrame(points, "score double, expected_net double")).collect()}
    for i, x in enumerate(asked):
        if x is None:
            assert got[i] is None
            continue
        k = bisect.bisect_left(xs, x)
        want = points[0][1] if k == 0 else points[-1][1] if k == len(xs) else None
        if want is None:
            (x0, y0), (x1, y1) = points[k - 1], points[k]
            want = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
        assert got[i] == pytest.approx(want, abs=1e-9)
    assert len(got) == len(asked)


@pytest.mark.parametrize("scores", [[5.0] * 4_000, [1e6 + i for i in range(4_000)], [-1e6 - i for i in range(4_000)], [None] * 4_000])
def test_calibration_of_scores_off_the_curve(spark, scores):
    """All equal, all above, all below, all null: the same values, and no slice holds more than its share of the distinct ones."""
    points = spark.createDataFrame([(float(i), i / 10) for i in range(10)], "score double, expected_net double")
    df = spark.createDataFrame([(i, s, "k") for i, s in enumerate(scores)], "id int, score double, _x string")
    out = K.calibrate(df, points, slices=16)
    want = {5.0: 0.5, None: None}.get(scores[0], 0.9 if (scores[0] or 0) > 0 else 0.0)
    assert out.columns == ["id", "score", "_x", "expected_net"] and {r["expected_net"] for r in out.collect()} == {want}
    assert out.count() == 4_000


def test_normal_distribution_function(spark):
    xs = [i / 7 for i in range(-280, 281)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("p", normal_cdf(F.col("x")))
    for r in df.collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), rel=1e-9, abs=1e-15)


def test_call_values(spark):
    df = spark.createDataFrame([(25_000.0, 25_000.0, 7 / 365, 0.14), (110.0, 100.0, 0.0, 0.2), (90.0, 100.0, -1.0, 0.2)],
                               "spot double, strike double, years double, vol double")
    seven, inside, outside = [r["value"] for r in price_calls(df).collect()]
    assert 100 < seven < 250 and inside == 10.0 and outside == 0.0
    strikes = [value_of(spark, atm_strike(F.lit(s))) for s in (25.0, 75.0, 125.0, 26.0)]
    assert strikes == [0.0, 100.0, 100.0, 50.0]
