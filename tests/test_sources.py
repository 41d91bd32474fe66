from concurrent.futures import ThreadPoolExecutor
import datetime as dt
import json

import pandas as pd

from tickloom.session import folders
from tickloom.sources import accounts as A
from tickloom.sources import bars as SB
from tickloom.sources import picks as P
from tickloom.sources import reports as SR


def test_one_file_per_symbol(spark, tmp_path):
    stamps = pd.to_datetime(["2026-09-22 03:45", "2026-09-22 04:45", "2026-09-22 20:00"], utc=True)
    for name, close in (("TCS.NS", [1.0, None, 3.0]), ("^NSEI", [5.0, 6.0, 7.0])):
        pd.DataFrame({"ts": stamps, "Open": 1.0, "High": 2.0, "Low": 0.5, "Close": close, "Volume": 10, "Other": "x"}).set_index(
            "ts").rename_axis("Datetime").to_parquet(tmp_path / f"{name}.parquet")
    got = SB.read_bars(spark, str(tmp_path)).orderBy("symbol", "ts").collect()
    assert [(r["symbol"], r["close"]) for r in got] == [("TCS.NS", 1.0), ("TCS.NS", 3.0), ("^NSEI", 5.0), ("^NSEI", 6.0), ("^NSEI", 7.0)]
    assert got[0]["ts"] == dt.datetime(2026, 9, 22, 9, 15) and got[1]["date"] == dt.date(2026, 9, 23)


def test_bar_scan_prunes_columns_and_pushes_the_filter(spark, tmp_path):
    pd.DataFrame({"ts": pd.to_datetime(["2026-09-22"]), "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 1.0,
                  "unused": "x"}).to_parquet(tmp_path / "A.parquet")
    plan = SB.read_bars(spark, str(tmp_path)).select("symbol", "close")._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(close)" in plan and "unused" not in plan and "volume" not in plan.split("ReadSchema")[1]


def test_newest_snapshot_wins(spark, tmp_path):
    import os
    for i, day in enumerate(["b", "a"]):
        f = tmp_path / f"asof_{day}.parquet"
        pd.DataFrame({"symbol": [day], "score": [1.0]}).to_parquet(f)
        os.utime(f, (1_000_000 + i, 1_000_000 + i))
    (r,) = SB.latest_snapshot(spark, str(tmp_path / "asof_*.parquet")).collect()
    assert (r["symbol"], r["source"]) == ("a", "asof_a.parquet")


def test_pick_files(spark, tmp_path):
    doc = {"asof": "2026-09-29", "market": "IN", "top": [
        {"symbol": "AAA.NS", "score": 0.9, "rank_pct": 1.0, "expected": 0.05, "horizon": 21},
        {"symbol": "GOLDBEES.NS", "score": 0.8}, {"symbol": "BBB.NS", "score": 0.7}],
        "ranks": {"AAA.NS": 1.0, "LIQUIDX.NS": 0.5}, "expected": {"BBB.NS": 0.01}}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=1))
    top, ranks, expected = P.read_picks(spark, str(tmp_path / "p.json"))
    assert [(r["symbol"], r["pos"], r["asof"]) for r in top.orderBy("pos").collect()] == [
        ("AAA.NS", 1, "2026-09-29"), ("BBB.NS", 3, "2026-09-29")]
    assert [r["symbol"] for r in ranks.collect()] == ["AAA.NS"] and expected.first()["expected"] == 0.01
    assert P.as_of(spark, str(tmp_path / "p.json")).first()["asof"] == "2026-09-29"
    assert P.as_of(spark, str(tmp_path / "absent.json")).first()["asof"] == "none"
    assert P.read_picks(spark, str(tmp_path / "absent.json"))[0].count() == 0


def test_model_maps(spark, tmp_path):
    doc = {"asof": "2026-09-29", "entry_wait": {"A.NS": 0.01}, "exit_rule": {"min_age": 5, "margin": 0.03},
           "exit_scores": {"x": {"A.NS": {"pred": -0.1, "age": 7}}, "y": {}}, "exit_inputs": {"x": {"A.NS": {"base": 9.0, "peak_px": None}}}}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    wait, scores, rule, inputs = P.read_model_maps(spark, str(tmp_path / "m.json"))
    assert wait.select("asof", "symbol", "wait").collect() == [("2026-09-29", "A.NS", 0.01)]
    assert scores.select("account", "symbol", "pred", "age").collect() == [("x", "A.NS", -0.1, 7)]
    assert rule.select("min_age", "margin").collect() == [(5, 0.03)]
    assert sorted(tuple(r) for r in inputs.select("account", "symbol", "name", "value").collect()) == [
        ("x", "A.NS", "base", 9.0), ("x", "A.NS", "peak_px", None)]
    assert [t.count() for t in P.read_model_maps(spark, str(tmp_path / "absent.json"))] == [0, 0, 0, 0]


def test_export(spark):
    scores = spark.createDataFrame([(f"S{i}", "n", float(i // 2)) for i in range(10)] + [("GILT1", "n", 99.0)],
                                   "symbol string, name string, score double")
    docs, ranks = P.export_picks(scores, top=3)
    assert [t["symbol"] for t in docs.first()["top"]] == ["S8", "S9", "S6"]
    assert {r["symbol"]: r["rank_pct"] for r in ranks.collect()}["S0"] == 0.15


def test_account_documents(spark, tmp_path):
    one = {"name": "a", "cash": 5.0, "start_cash": 9.0, "memo": {}, "positions": {"X": {
        "symbol": "X", "qty": 3, "avg_price": 2.0, "opened": "2026-09-22T10:00:00+05:30", "product": "delivery", "exit_on": "2026-09-29",
        "meta": {"last_price": 2.5, "splits": ["2026-09-01"]}}},
        "ledger": [{"time": "t1", "side": "BUY", "symbol": "X", "qty": 3, "price": 2.0, "value": 6.0, "costs": 0.1,
                    "product": "delivery", "reason": "r"}], "equity_curve": [{"time": "t1", "equity": 9.0}]}
    names = spark.createDataFrame([("a",), ("new",)], "account string")
    (tmp_path / "map.json").write_text(json.dumps({"a": one}, indent=1))
    (tmp_path / "lines.json").write_text(json.dumps(one) + "\n")
    for path, single in (("map.json", True), ("lines.json", False)):
        t = A.read_accounts(spark, str(tmp_path / path), names, 200.0, one_document=single)
        assert {(r["account"], r["cash"], r["start_cash"]) for r in t["accounts"].collect()} == {("a", 5.0, 9.0), ("new", 200.0, 200.0)}
        (p,) = t["positions"].collect()
        assert (p["qty"], p["last_price"], p["exit_on"], p["splits"]) == (3, 2.5, dt.date(2026, 9, 29), [dt.date(2026, 9, 1)])
        assert p["opened"] == dt.datetime(2026, 9, 22, 10)
        assert t["ledger"].first()["pnl"] is None and t["equity"].first()["equity"] == 9.0


def test_trade_csv_drops_ragged_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text('strategy,side,reason\na,BUY,"said ""hi"", then"\nb,SELL\nc,SELL,ok\n')
    got = SR.read_trades_csv(spark, str(tmp_path / "t.csv"), "strategy string, side string, reason string").collect()
    assert [tuple(r) for r in got] == [("a", "BUY", 'said "hi", then'), ("c", "SELL", "ok")]


def test_log_takes_each_id_once(spark, tmp_path):
    log = str(tmp_path / "alerts")
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id string, text string")
    SR.append_new(rows("1", "2", "2"), log)
    (tmp_path / "alerts" / "extra.json").write_text("not json\n")
    SR.append_new(rows("2", "3"), log)
    assert sorted(r["id"] for r in SR.read_log(spark, log, "id string, text string").filter("id IS NOT NULL").collect()) == ["1", "2", "3"]


def test_writers_at_once_append_each_id_once(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "day string, id string, text string"
    batches = [spark.createDataFrame([(f"d{i % 3}", f"i{i}", f"{w}") for i in range(w, w + 40)] * 2, schema) for w in (0, 10, 20)]
    with ThreadPoolExecutor(3) as pool:
        numbers = list(pool.map(lambda b: SR.append_once(b, log), batches))
    commits = sorted(n for n in numbers if n >= 0)                    # the middle batch may find all its rows in the others'
    assert commits in ([0, 1], [0, 1, 2])
    got = SR.read_once(spark, log, batches[0].schema)
    assert sorted((r["day"], r["id"]) for r in got.collect()) == sorted((f"d{i % 3}", f"i{i}") for i in range(60))
    assert SR.append_once(batches[1], log) == -1 and folders(spark, log) == commits


def test_the_loser_of_a_race_leaves_out_what_the_winner_wrote(spark, tmp_path, monkeypatch):
    log, schema = str(tmp_path / "log"), "id string, day string, text string"
    rows = lambda text, *keys: spark.createDataFrame([(k, d, text) for k, d in keys], schema)
    plain, first = SR.claim, []

    def late(session, staged, target):
        if not first:
            first.append(target)
            assert SR.append_once(rows("winner", ("a", "d1"), (None, "d1"), ("b", None)), log) == 0
        return plain(session, staged, target)
    monkeypatch.setattr(SR, "claim", late)
    assert SR.append_once(rows("loser", ("a", "d1"), ("a", "d2"), (None, "d1"), ("b", None), (None, None)), log) == 1
    got = {(r["id"], r["day"]): r["text"] for r in SR.read_once(spark, log, rows("x").schema).collect()}
    assert got == {("a", "d1"): "winner", (None, "d1"): "winner", ("b", None): "winner", ("a", "d2"): "loser", (None, None): "loser"}


def test_a_log_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id string, day string")
    assert SR.append_once(none, str(tmp_path / "log")) == -1
    assert SR.read_once(spark, str(tmp_path / "log"), none.schema).isEmpty()


def test_reports_on_disk(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "account string, equity double")
    SR.write_reports({"equity": df, "summary": df}, str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/equity", header=True).first()["equity"] == "1.5"
    assert spark.read.json(f"{tmp_path}/summary").first()["equity"] == 1.5
