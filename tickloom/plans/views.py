"""The given tables seen as ticks, bars, ledgers, quotes and picks — once in Spark, once as SQL.

Each function takes (spark, sf_dir); `VIEWS` holds the SQL of the same name for the check queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.bars import build_bars, with_ordinal
from tickloom.operators.ranking import pct_rank, top_k

INDEX = "^IDX"
UNTIL = "06:00"                 # events run around the clock, so the first period ends at six
VIEWS: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_views(names: str, body: str) -> str:
    """`body` behind the named views and the views they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for other in VIEWS:
            if other != name and f" {other} " in VIEWS[name].replace("\n", " ").replace(")", " "):
                add(other)
        order.append(name)

    for n in names.split():
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + body


def with_more(names: str, ctes: str, body: str) -> str:
    """Views, then the query's own CTEs, then its body."""
    return with_views(names, "").rstrip() + ",\n" + ctes.strip().rstrip(",") + "\n" + body


# --- ticks and bars, from events ---

def ticks(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id") % 20
    return table(spark, sf, "events").select(
        F.when(u == 0, INDEX).otherwise(F.concat(F.lit("S"), u.cast("string"))).alias("symbol"),
        "ts", F.to_date("ts").alias("date"), F.col("event_id").alias("seq"), F.col("value").alias("price"))


VIEWS["ticks"] = """
 SELECT CASE WHEN user_id % 20 = 0 THEN '^IDX' ELSE 'S' || (user_id % 20) END AS symbol, ts,
        CAST(ts AS DATE) AS date, event_id AS seq, value AS price FROM events """


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return with_ordinal(build_bars(ticks(spark, sf)))


VIEWS["bars"] = """
 SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY ts) - 1 AS bar FROM (
   SELECT symbol, date_trunc('hour', ts) AS ts, date, arg_min(price, (ts, seq)) AS open, max(price) AS high,
          min(price) AS low, arg_max(price, (ts, seq)) AS close, CAST(count(*) AS DOUBLE) AS volume
   FROM ticks GROUP BY 1, 2, 3) """


# --- long daily history, from lineitem ---

def unit_price() -> Column:
    return F.col("l_extendedprice") / F.col("l_quantity")


LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    # LINE_ORDER as one decimal: order, line, part and price in cents.
    def digits(c: str, zeros: int) -> Column:
        return F.col(c).cast("decimal(12,0)") * F.lit("1" + "0" * zeros).cast(f"decimal({zeros + 1},0)")

    order = (digits("l_orderkey", 24) + digits("l_linenumber", 22) + digits("l_partkey", 11)
             + F.round(F.col("l_extendedprice") * 100).cast("decimal(11,0)"))
    return (table(spark, sf, "lineitem").withColumn("price", unit_price())
            .groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("date"))
            .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", order).alias("close"), F.sum("l_quantity").alias("volume")))


VIEWS["daily"] = """
 SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
        arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
        max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
        arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
        sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2 """


# --- fills and orders, from orders and lineitem ---

FILL_ORDER = ("time", "order_id", "line", "part", "value")


def ledger(spark: SparkSession, sf: str, tasks: int | None = None) -> DataFrame:
    """The fills; `tasks` deal them by order (None: left to AQE)."""
    lines = table(spark, sf, "lineitem").select(*LINE_ORDER, "l_suppkey", "l_quantity", "l_returnflag")
    heads = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    if tasks:
        lines, heads = lines.repartition(tasks, "l_orderkey"), heads.repartition(tasks, "o_orderkey")
    return (lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.concat(F.lit("A"), (F.col("o_custkey") % 21).cast("string")).alias("account"),
                    F.concat(F.lit("L"), F.col("l_suppkey").cast("string")).alias("symbol"),
                    F.col("o_orderdate").alias("time"), F.col("l_orderkey").alias("order_id"),
                    F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
                    F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
                    F.col("l_quantity").cast("bigint").alias("qty"), unit_price().alias("price"),
                    F.col("l_extendedprice").alias("value"),
                    F.element_at(F.array(F.lit("delivery"), F.lit("intraday"), F.lit("option")),
                                 (F.col("l_suppkey") % 3 + 1).cast("int")).alias("product"),
                    F.when(F.col("o_custkey") % 2 == 0, "zerodha").otherwise("groww").alias("broker"),
                    F.col("o_orderpriority").alias("reason")))


VIEWS["ledger"] = """
 SELECT 'A' || (o_custkey % 21) AS account, 'L' || l_suppkey AS symbol, o_orderdate AS time,
        l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part,
        CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(l_quantity AS BIGINT) AS qty,
        l_extendedprice / l_quantity AS price, l_extendedprice AS value,
        CASE l_suppkey % 3 WHEN 0 THEN 'delivery' WHEN 1 THEN 'intraday' ELSE 'option' END AS product,
        CASE WHEN o_custkey % 2 = 0 THEN 'zerodha' ELSE 'groww' END AS broker, o_orderpriority AS reason
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey """


def orders_to_charge(spark: SparkSession, sf: str, tasks: int | None = None) -> DataFrame:
    return ledger(spark, sf, tasks).withColumn(
        "product", F.when(F.col("reason") == "1-URGENT", "intraday")
        .when(F.col("reason") == "2-HIGH", "option").otherwise("delivery"))


VIEWS["orders_to_charge"] = """
 SELECT account, symbol, time, order_id, line, part, side, qty, price, value, broker,
        CASE reason WHEN '1-URGENT' THEN 'intraday' WHEN '2-HIGH' THEN 'option' ELSE 'delivery' END AS product
 FROM ledger """


# --- marks of 21 accounts, from orders ---

def equity(spark: SparkSession, sf: str) -> DataFrame:
    sign = F.when(F.col("o_orderstatus") == "F", -1.0).otherwise(1.0)
    return table(spark, sf, "orders").select(
        F.concat(F.lit("A"), (F.col("o_custkey") % 21).cast("string")).alias("account"),
        F.col("o_orderdate").alias("time"), F.col("o_orderkey").alias("seq"),
        F.round(F.lit(200000.0) + sign * F.col("o_totalprice") / 7, 2).alias("equity"))


VIEWS["equity"] = """
 SELECT 'A' || (o_custkey % 21) AS account, o_orderdate AS time, o_orderkey AS seq,
        round(200000.0 + CASE WHEN o_orderstatus = 'F' THEN -1.0 ELSE 1.0 END * o_totalprice / 7, 2) AS equity
 FROM orders """


# --- scores, pick lists and prices, from part and customer ---

def scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("list"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"),
        F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_type").alias("type"),
        F.col("p_retailprice").alias("score"))


VIEWS["scores"] = """
 SELECT p_brand AS list, 'P' || p_partkey AS symbol, p_name AS name, p_size AS size, p_type AS type,
        p_retailprice AS score FROM part """


def ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Model rank per symbol; the largest sizes are not scored (null)."""
    rank = F.round((F.col("score") - 900) / 100, 4)
    return scores(spark, sf).select("symbol", F.when(F.col("size") <= 40, rank).alias("rank_pct"))


VIEWS["ranks"] = "SELECT symbol, CASE WHEN size <= 40 THEN round((score - 900) / 100, 4) END AS rank_pct FROM scores "


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """Live price per symbol; size 50 has not traded today (null)."""
    return scores(spark, sf).select("symbol", F.when(F.col("size") < 50, F.col("score")).alias("price"))


VIEWS["prices"] = "SELECT symbol, CASE WHEN size < 50 THEN score END AS price FROM scores "
VIEWS["live_prices"] = "SELECT * FROM prices WHERE price IS NOT NULL "


def pick_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The 30 best of each list, with what the model expects of them."""
    s = pct_rank(scores(spark, sf), ["list"], "score", "rank_pct")
    s = top_k(s, ["list"], 30, [F.col("score").desc(), F.col("symbol")])
    return s.withColumn("expected", F.round((F.col("rank_pct") - 0.5) * 0.1, 6)).withColumn(
        "wait", F.round((F.col("size") - 40) / 1000, 6))


VIEWS["pick_lists"] = """
 SELECT *, round((rank_pct - 0.5) * 0.1, 6) AS expected, round((size - 40) / 1000.0, 6) AS wait FROM (
   SELECT *, (rank() OVER (PARTITION BY list ORDER BY score)
              + (count(*) OVER (PARTITION BY list, score) - 1) / 2.0) / count(*) OVER (PARTITION BY list) AS rank_pct,
          row_number() OVER (PARTITION BY list ORDER BY score DESC, symbol) AS pos FROM scores )
 WHERE pos <= 30 """


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """One account per order, following one pick list."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("C"), key.cast("string")).alias("account"),
        F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string")).alias("list"),
        (F.col("o_totalprice") / 2).alias("cash"), (key % 4 == 0).alias("wild"), (key % 3 == 0).alias("waits"))


VIEWS["accounts"] = """
 SELECT 'C' || o_orderkey AS account, 'Brand#' || (o_orderkey % 25 + 1) AS list, o_totalprice / 2 AS cash,
        o_orderkey % 4 = 0 AS wild, o_orderkey % 3 = 0 AS waits FROM orders """


def book(spark: SparkSession, sf: str) -> DataFrame:
    """Open holdings per account: the lines of its order."""
    return (table(spark, sf, "lineitem")
            .groupBy(F.concat(F.lit("C"), F.col("l_orderkey").cast("string")).alias("account"),
                     F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"))
            .agg(F.sum("l_quantity").cast("bigint").alias("qty"),
                 F.round(F.sum(F.col("l_discount") * 400 + 850) / F.count(F.lit(1)), 4).alias("avg_price"),
                 F.min("l_shipdate").alias("opened"),
                 F.when(F.min("l_suppkey") % 10 == 0, "entitlement").when(F.min("l_suppkey") % 10 == 1, "intraday")
                 .otherwise("delivery").alias("product")))


VIEWS["book"] = """
 SELECT 'C' || l_orderkey AS account, 'P' || l_partkey AS symbol, CAST(sum(l_quantity) AS BIGINT) AS qty,
        round(sum(l_discount * 400 + 850) / count(*), 4) AS avg_price, min(l_shipdate) AS opened,
        CASE min(l_suppkey) % 10 WHEN 0 THEN 'entitlement' WHEN 1 THEN 'intraday' ELSE 'delivery' END AS product
 FROM lineitem GROUP BY 1, 2 """


# --- every order line as a holding on its own clock ---

def holdings(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    days = (F.col("l_partkey") % 120).cast("int")
    minutes = (9 * 60 + F.col("l_suppkey") % 400)
    now = F.date_add(F.to_date("l_shipdate"), days).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), minutes.cast("int"))
    move = (F.col("l_discount") - 0.0513) * F.col("l_tax") * 100
    return li.select(
        F.concat(F.lit("C"), (F.col("l_suppkey") % 21).cast("string")).alias("account"),
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"),
        F.col("l_quantity").cast("bigint").alias("qty"), unit_price().alias("avg_price"),
        F.col("l_shipdate").alias("opened"), now.alias("now"),
        F.when(F.col("l_returnflag") == "A", "intraday").when(F.col("l_linenumber") == 7, "option")
        .when(F.col("l_linenumber") == 6, "entitlement").otherwise("delivery").alias("product"),
        F.when(F.col("l_linestatus") == "O",
               F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int"))).alias("exit_on"),
        F.when(F.col("l_linenumber") != 5, unit_price() * (1 + move)).alias("price"),
        F.round(F.col("l_discount") * 5 - 0.25, 4).alias("pred"), (F.col("l_quantity") / 2).cast("int").alias("age"))


VIEWS["holdings"] = """
 SELECT 'C' || (l_suppkey % 21) AS account, l_orderkey AS order_id, l_linenumber AS line, 'P' || l_partkey AS symbol,
        CAST(l_quantity AS BIGINT) AS qty, l_extendedprice / l_quantity AS avg_price, l_shipdate AS opened,
        CAST(CAST(l_shipdate AS DATE) + CAST(l_partkey % 120 AS INTEGER) AS TIMESTAMP)
          + to_minutes(CAST(540 + l_suppkey % 400 AS BIGINT)) AS now,
        CASE WHEN l_returnflag = 'A' THEN 'intraday' WHEN l_linenumber = 7 THEN 'option'
             WHEN l_linenumber = 6 THEN 'entitlement' ELSE 'delivery' END AS product,
        CASE WHEN l_linestatus = 'O' THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS exit_on,
        CASE WHEN l_linenumber <> 5
             THEN l_extendedprice / l_quantity * (1 + (l_discount - 513e-4) * l_tax * 100) END AS price,
        round(l_discount * 5 - 0.25, 4) AS pred, CAST(floor(l_quantity / 2) AS INTEGER) AS age
 FROM lineitem """


# --- quotes of two feeds, from events ---

def quotes(spark: SparkSession, sf: str) -> DataFrame:
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(
        F.when(F.col("user_id") % 20 == 0, F.concat(F.lit("^I"), F.col("user_id").cast("string")))
        .otherwise(F.concat(F.lit("Q"), F.col("user_id").cast("string"), F.lit(".NS"))).alias("symbol"),
        F.when(F.col("event_type").isin("error", "signup"), "fallback").otherwise("primary").alias("source"),
        F.when(F.col("event_type") == "purchase", 0.0).otherwise(F.col("value")).alias("ltp"),
        F.get_json_object("props", "$.k").cast("bigint").alias("volume"),
        F.when(F.col("event_id") % 2 == 1, epoch * 1000).otherwise(epoch).alias("last_trade_epoch"),
        F.lit(400.0).alias("band_hi"), F.lit(100.0).alias("band_lo"), F.col("ts").alias("asof"),
        F.col("event_id").alias("seq"))


VIEWS["quotes"] = """
 SELECT CASE WHEN user_id % 20 = 0 THEN '^I' || user_id ELSE 'Q' || user_id || '.NS' END AS symbol,
        CASE WHEN event_type IN ('error', 'signup') THEN 'fallback' ELSE 'primary' END AS source,
        CASE WHEN event_type = 'purchase' THEN 0.0 ELSE value END AS ltp,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume,
        CAST(floor(epoch(ts)) AS BIGINT) * CASE WHEN event_id % 2 = 1 THEN 1000 ELSE 1 END AS last_trade_epoch,
        400.0 AS band_hi, 100.0 AS band_lo, ts AS "asof", event_id AS seq FROM events """


# --- corporate actions on suppliers' symbols, from part ---

def actions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").join(
        table(spark, sf, "supplier").select("s_suppkey"), F.col("p_partkey") == F.col("s_suppkey"))
    ratio = F.element_at(F.array(F.lit(2.0), F.lit(1.5), F.lit(0.5)), (F.col("p_partkey") % 3 + 1).cast("int"))
    one = p.select(F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("symbol"),
                   F.date_add(F.lit("1996-01-01").cast("date"), (F.col("p_partkey") * 17 % 2000).cast("int"))
                   .alias("ex_date"), ratio.alias("ratio"))
    later = one.select("symbol", F.date_add("ex_date", 400).alias("ex_date"),
                       F.when(F.col("ratio") == 2.0, 1.0).otherwise(3.0).alias("ratio"))
    return one.unionByName(later).unionByName(one)               # the log repeats events


VIEWS["actions"] = """
 SELECT symbol, ex_date, ratio FROM (
   SELECT 'L' || p_partkey AS symbol, DATE '1996-01-01' + CAST(p_partkey * 17 % 2000 AS INTEGER) AS ex_date,
          CASE p_partkey % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 ELSE 0.5 END AS ratio
   FROM part JOIN supplier ON p_partkey = s_suppkey)
 UNION ALL
 SELECT 'L' || p_partkey, DATE '1996-01-01' + CAST(p_partkey * 17 % 2000 AS INTEGER) + 400,
        CASE p_partkey % 3 WHEN 0 THEN 1.0 ELSE 3.0 END
 FROM part JOIN supplier ON p_partkey = s_suppkey """
