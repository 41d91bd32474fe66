import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from checks import are_capped_shares
from tickloom.operators import sizing as Z


def groups(seed, n, low, high, draw):
    rng = random.Random(seed)
    return {g: [draw(rng) for _ in range(rng.randint(low, high))] for g in range(n)}


def test_confidence_weights_are_capped_and_follow_the_scores(spark):
    data = groups(1, 300, 2, 12, lambda r: r.gauss(0, 1) ** 3)
    df = spark.createDataFrame([(g, i, s, 0.9) for g, ss in data.items() for i, s in enumerate(ss)],
                               "g int, i int, score double, rank_pct double")
    got = {(r["g"], r["i"]): r["weight"] for r in Z.confidence_weights(df, ["g"]).collect()}
    for g, ss in data.items():
        weights = [got[g, i] for i in range(len(ss))]
        kept, cap = [w for w in weights if w is not None], max(0.35, 1 / len(ss))
        assert kept and all(0 < w <= cap + 1e-9 for w in kept) and sum(kept) <= 1 + 1e-9
        order = sorted(range(len(ss)), key=lambda i: ss[i])
        ranked = [weights[i] or 0.0 for i in order]
        assert ranked == pytest.approx(sorted(ranked))                      # a better score never weighs less
        assert ranked[0] == 0 or min(kept) >= 0.05 - 1e-9 or len(kept) == len(ss)
        sd = statistics.stdev(ss)
        free = [(ss[i], weights[i]) for i in order if weights[i] and weights[i] < cap * 0.9]
        if sd > 0 and len(free) > 1 and len(kept) == len(ss) and max(kept) < cap * 0.9:
            (s0, w0), (s1, w1) = free[0], free[-1]
            assert math.log(w1 / w0) == pytest.approx((s1 - s0) / sd)


def test_equal_scores_fall_back_to_rank(spark):
    df = spark.createDataFrame([(0, "a", 1.0, 1.0), (0, "b", 1.0, 0.75), (1, "c", 5.0, 0.9)],
                               "g int, s string, score double, rank_pct double")
    got = {r["s"]: r["weight"] for r in Z.confidence_weights(df, ["g"]).collect()}
    assert got["a"] == pytest.approx(0.5) and got["b"] == pytest.approx(0.5) and got["c"] == 1.0


def test_edge_shares_fill_exactly(spark):
    data = groups(2, 400, 1, 12, lambda r: r.choice([r.uniform(-0.01, 0.02), r.uniform(0, 0.2)]))
    df = spark.createDataFrame([(g, i, f"s{i:02d}", e) for g, es in data.items() for i, e in enumerate(es)],
                               "g int, i int, symbol string, edge double")
    got = {(r["g"], r["i"]): r["share"] for r in Z.edge_shares(df, ["g"]).collect()}
    for g, es in data.items():
        are_capped_shares(es, [got[g, i] for i in range(len(es))], 0.30)


RANKS = [1.0, 0.99, 0.98, 0.97, 0.95, 0.93, 0.90, 0.87, 0.84, 0.80, 0.77]


def test_book_size_grows_with_the_budget(spark):
    lists = [("small", 50_000.0, RANKS), ("large", 1_000_000.0, RANKS), ("poor", 50_000.0, [0.66, 0.64, 0.62])]
    df = spark.createDataFrame([(k, b, i, r) for k, b, rs in lists for i, r in enumerate(rs)],
                               "k string, budget double, pos int, rank_pct double")
    got = {r["k"]: (r["n"], r["ticket"]) for r in Z.best_book(df, ["k"]).collect()}
    assert got["large"][0] > got["small"][0] and 3 <= got["small"][0] <= 10
    assert got["poor"][0] <= 1 and got["small"][1] == pytest.approx(50_000 / got["small"][0])


def test_stakes_stay_in_their_bounds(spark):
    chosen = spark.createDataFrame(
        [("calm", s, 0.09 - 0.012 * i, 33_000.0, 200_000.0, False, 2.0) for i, s in enumerate("ABCDEF")]
        + [("wild", s, 0.09 - 0.012 * i, 66_000.0, 200_000.0, True, 2.0) for i, s in enumerate("ABC")]
        + [("flat", s, 0.09 - 0.012 * i, 33_000.0, 200_000.0, False, 0.0) for i, s in enumerate("ABC")],
        "account string, symbol string, expected double, ticket double, equity double, wild boolean, power double")
    held = spark.createDataFrame([("calm", 0.01), ("calm", None)], "account string, expected double")
    out = Z.conviction_stakes(chosen, held, ["account"]).collect()
    stake = {(r["account"], r["symbol"]): r["stake"] for r in out}
    assert stake["calm", "A"] > stake["calm", "F"] and max(v for (a, _), v in stake.items() if a == "calm") <= 60_000
    assert stake["calm", "A"] == pytest.approx(min(33_000 * 1.6, 60_000))
    assert stake["wild", "A"] > 60_000 and stake["flat", "A"] == 33_000


def test_equal_budget(spark):
    df = spark.createDataFrame([("a", 100.0), ("a", 100.0), ("b", 90.0)], "account string, cash double")
    assert sorted(r["budget"] for r in Z.equal_budget(df, ["account"]).collect()) == [50.0, 50.0, 90.0]
    assert spark.range(1).select(Z.slot_ticket(F.lit(120.0), F.lit(50.0), F.lit(6), F.lit(5))).first()[0] == 10.0


@pytest.mark.parametrize("name", ["p01_confidence_weights", "p02_edge_shares", "p03_best_book", "p04_conviction_stakes",
                                  "p05_equal_budget", "c06_sequential_fills"])
def test_a_task_sizes_a_bounded_number_of_rows(spark, monkeypatch, name):
    from tickloom import session
    from tickloom.plans import load
    monkeypatch.setattr(session, "TASK_ROWS", 250, raising=False)
    sized = load()[0][name](spark, "/root/testdata/sf0.001")
    rows = [r["count"] for r in sized.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) >= 20 and max(rows) <= 500                 # 6,000 lines of 1,500 orders
