"""Account state as nested JSON, to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import constants as C

POSITION = ("struct<symbol:string,qty:bigint,avg_price:double,opened:string,product:string,exit_on:string,"
            "meta:struct<last_price:double,prev_close:double,strike:double,vol:double,entry_exp:double,expiry:string,"
            "splits:array<string>>>")
FILL = ("struct<time:string,side:string,symbol:string,qty:bigint,price:double,value:double,costs:double,"
        "product:string,pnl:double,reason:string>")
ACCOUNT_SCHEMA = (f"name string, cash double, start_cash double, positions map<string,{POSITION}>, "
                  f"ledger array<{FILL}>, equity_curve array<struct<time:string,equity:double>>")


def read_accounts(spark: SparkSession, path: str, names: DataFrame | None = None,
                  start_cash: float = C.START_CASH, one_document: bool = False) -> dict[str, DataFrame]:
    """Tables accounts, positions, ledger and equity from account documents.

    JSON lines split over the cluster, and a large account may come in several lines that repeat its name and
    cash; `one_document` reads the older single map of accounts. Accounts in `names` without a document start
    with `start_cash`.
    """
    if one_document:
        body = ACCOUNT_SCHEMA.replace(" string", ":string").replace(" double", ":double").replace(
            " map<", ":map<").replace(" array<", ":array<").replace(", ", ",")
        text = spark.read.text(path, wholetext=True)
        docs = text.select(F.explode(F.from_json("value", f"map<string,struct<{body}>>")).alias("_k", "_a")).select("_a.*")
    else:
        docs = spark.read.schema(ACCOUNT_SCHEMA).json(path)
    docs = docs.withColumnRenamed("name", "account")
    seen = docs.select("account", "cash", "start_cash").distinct()
    if names is not None:
        seen = names.select("account").join(seen, "account", "left").select(
            "account", F.coalesce("cash", F.lit(start_cash)).alias("cash"),
            F.coalesce("start_cash", F.lit(start_cash)).alias("start_cash"))
    positions = docs.select("account", F.explode("positions").alias("_s", "_p")).select(
        "account", "_p.symbol", "_p.qty", "_p.avg_price", F.to_timestamp_ntz(F.substring("_p.opened", 1, 19),
                                                                           F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("opened"),
        "_p.product", F.to_date("_p.exit_on").alias("exit_on"), "_p.meta.last_price", "_p.meta.prev_close",
        "_p.meta.strike", "_p.meta.vol", "_p.meta.entry_exp", F.to_date("_p.meta.expiry").alias("expiry"),
        F.transform("_p.meta.splits", lambda d: F.to_date(d)).alias("splits"))
    ledger = docs.select("account", F.posexplode("ledger").alias("seq", "_f")).select("account", "seq", "_f.*")
    equity = docs.select("account", F.posexplode("equity_curve").alias("seq", "_e")).select("account", "seq", "_e.*")
    return {"accounts": seen, "positions": positions, "ledger": ledger, "equity": equity}
