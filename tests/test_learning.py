import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom import constants as C
from tickloom.operators import evaluation as E
from tickloom.operators import learning as M


@pytest.fixture(scope="module")
def table(spark):
    """Eight weeks of twelve stocks whose return follows the gap, with holes in the features."""
    rng = random.Random(4)
    rows = []
    for d in range(40):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=d + 2 * (d // 5))
        for s in range(12):
            f = [rng.gauss(0, 1) for _ in C.DAY_FEATURES]
            ret = f[0] * 0.01 + rng.gauss(0, 0.004)
            f = [None if i and rng.random() < 0.1 else v for i, v in enumerate(f)]
            rows.append((f"S{s}", day, ret, ret, 0.5 + ret * 10, *f))
    names = ", ".join(f"{n} double" for n in C.DAY_FEATURES)
    return spark.createDataFrame(rows, f"symbol string, date date, label_ret double, label_excess double, label_rank double, {names}")


def test_folds_never_train_on_their_future(spark, table):
    bounds = E.fold_bounds(table, 3, "week").orderBy("fold").collect()
    assert len(bounds) == 5 and all(b["cutoff"] == b["test_from"] - dt.timedelta(days=1) for b in bounds)
    counts = {(r["fold"], r["role"]): r["rows"] for r in E.walk_forward_folds(table, 3, "week").collect()}
    dates = [r["date"] for r in table.select("date").collect()]
    for b in bounds:
        assert counts[b["fold"], "train"] == sum(d < b["cutoff"] for d in dates)
        assert counts[b["fold"], "test"] == sum(b["test_from"] <= d <= b["test_to"] for d in dates)


def test_walk_forward_finds_the_signal(spark, table):
    p = M.walk_forward_regress(table, min_train=4, period="week", trees=4, min_rows=5)
    assert p.count() == 4 * 5 * 12
    assert E.evaluate_ranker(p, top=3).first()["mean_ic"] > 0.4


def test_final_model_scores_the_same_after_loading(spark, table, tmp_path):
    path = str(tmp_path / "model")
    model = M.fit_final(table, path, trees=3, min_rows=5)
    day = table.filter("date = '2024-02-20'")
    got = {r["symbol"]: r["score"] for r in M.score(day, path).collect()}
    want = {r["symbol"]: r["prediction"] for r in model.transform(M.filled(day, C.DAY_FEATURES)).collect()}
    assert got == want and len(got) == 12


def test_outside_model_sees_missing_features(spark, table):
    load = lambda: lambda x: x.isna().sum(axis=1).astype("float64")
    out = M.score_with(table.select("symbol", *C.DAY_FEATURES), load, C.DAY_FEATURES)
    holes = sum((F.col(c).isNull().cast("int") for c in C.DAY_FEATURES), F.lit(0))
    assert out.filter(F.col("pred") != holes).count() == 0


def test_evaluation_by_hand(spark):
    rows = [(1, "a", 3.0, 0.02, 0.01), (1, "b", 2.0, 0.01, 0.0), (1, "c", 1.0, 0.0, -0.01),
            (2, "a", 1.0, 0.02, 0.01), (2, "b", 1.0, 0.0, -0.01)]
    p = spark.createDataFrame([(s, dt.date(2024, 1, d), pr, lr, ex) for d, s, pr, lr, ex in rows],
                              "symbol string, date date, prediction double, label_ret double, label_excess double")
    r = E.evaluate_ranker(p, top=1).first()
    assert r["days"] == 2 and r["mean_ic"] == pytest.approx(1.0) and r["ic_t"] is None       # day 2 has no spread
    assert r["top_avg_ret"] == pytest.approx(0.02) and r["top_hit_vs_avg"] == 1.0 and r["days_net_positive"] == 1.0


@pytest.mark.parametrize(("name", "leaf"), [("m01_walk_forward_ranker", 200), ("m02_walk_forward_classifier", 500), ("m03_m04_fit_and_score_latest", 200)])
def test_registered_learners_run_the_whole_job(spark, monkeypatch, name, leaf):
    from tickloom.plans import load
    asked, plain = set(), M.booster

    def one_tree(label, features, classify, trees, min_rows, seed):
        asked.add((trees, min_rows))
        return plain(label, features, classify, 1, 1, seed)
    monkeypatch.setattr(M, "booster", one_tree)
    load()[0][name](spark, "/root/testdata/sf0.01")
    assert asked == {(300, leaf)}


def test_learners_walk_by_month_after_six_of_them(spark):
    """By default a month is scored by what came before it, once six have passed; prediction ranks by the planted gap."""
    rng = random.Random(5)
    rows = [(f"S{s}", dt.date(2024, 1, 1) + dt.timedelta(days=7 * week), *[rng.gauss(0, 1) for _ in C.DAY_FEATURES])
            for week in range(34) for s in range(20)]
    d = spark.createDataFrame(rows, "symbol string, date date, " + ", ".join(f"{n} double" for n in C.DAY_FEATURES))
    gap = F.col(C.DAY_FEATURES[0]) * 0.01
    d = d.withColumns({"label_ret": gap, "label_excess": gap, "label_rank": 0.5 + 10 * gap})
    p = M.walk_forward_regress(d, trees=3, min_rows=5)
    assert {r["m"] for r in p.select(F.month("date").alias("m")).distinct().collect()} == {7, 8}
    assert p.count() == d.filter("month(date) > 6").count()
    assert E.evaluate_ranker(p, top=3).first()["mean_ic"] > 0.6


def test_classifier_separates_planted_successes(spark):
    """Success follows one feature for nine trades in ten: scores separate it, and come near the rate it happens at."""
    rng = random.Random(6)
    rows = []
    for d in range(25):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=d + 2 * (d // 5))
        for s in range(40):
            f = [rng.gauss(0, 1) for _ in C.ENTRY_FEATURES]
            good = (f[0] > 0.3) != (rng.random() < 0.1)
            rows.append((f"S{s}", day, "10:15", 1, 0.01 if good else -0.01, int(good), *f))
    keys = ["entry_bar string", "hold_bars int"]
    keys = [k for k in keys if k.split()[0] not in C.ENTRY_FEATURES]
    rows = [(*r[:2], *[v for k, v in zip(("entry_bar", "hold_bars"), r[2:4]) if k not in C.ENTRY_FEATURES], *r[4:]) for r in rows]
    t = spark.createDataFrame(rows, ", ".join(["symbol string", "date date", *keys, "net double", "success int",
                                               *[f"{n} double" for n in C.ENTRY_FEATURES]]))
    p = M.walk_forward_classify(t, min_train=3, period="week", trees=4, min_rows=10)
    got = sorted((r["prob"], r["success"]) for r in p.select("prob", "success").collect())
    assert len(got) == 2 * 5 * 40
    ups = [i for i, (_, y) in enumerate(got) if y]
    area = (sum(ups) - len(ups) * (len(ups) - 1) / 2) / (len(ups) * (len(got) - len(ups)))
    assert area > 0.85
    assert abs(sum(x for x, _ in got) / len(got) - len(ups) / len(got)) < 0.08
