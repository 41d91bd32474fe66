"""Ranked pick files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.filters import companies_only, drop_funds
from tickloom.operators.ranking import pct_rank, top_k

PICKS_SCHEMA = ("asof string, market string, source string, "
                "top array<struct<symbol:string,name:string,score:double,rank_pct:double,expected:double,"
                "horizon:int,rank:int>>, ranks map<string,double>, expected map<string,double>, "
                "entry_wait map<string,double>, "
                "exit_scores map<string,map<string,struct<pred:double,age:int>>>, "
                "exit_rule struct<min_age:int,margin:double>, "
                "exit_inputs map<string,map<string,map<string,double>>>")


def _documents(spark: SparkSession, path: str, schema: str, one_per_line: bool = False) -> DataFrame:
    """The JSON documents at `path`; no rows when nothing is there."""
    try:
        return spark.read.schema(schema).json(path, multiLine=not one_per_line)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_picks(spark: SparkSession, path: str, blocklist: DataFrame | None = None,
               schema: str = PICKS_SCHEMA, one_per_line: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(top list with `pos`, rank per symbol, expected return per symbol), companies only.

    `one_per_line` reads JSON lines, which split; otherwise a file is one document.
    """
    docs = _documents(spark, path, schema, one_per_line).withColumn("asof", F.coalesce("asof", F.lit("unknown")))
    head = ["asof", "market", "source"]
    top = docs.select(*head, F.posexplode("top").alias("_pos", "_t")).select(
        *head, (F.col("_pos") + 1).alias("pos"), "_t.*")
    ranks = docs.select(*head, F.explode("ranks").alias("symbol", "rank_pct"))
    expected = docs.select(*head, F.explode("expected").alias("symbol", "expected"))
    return tuple(companies_only(t, blocklist) for t in (top, ranks, expected))


def read_model_maps(spark: SparkSession, path: str, schema: str = PICKS_SCHEMA, one_per_line: bool = False
                    ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What a model's pick file says beyond its picks, as tables headed by asof, market and source.

    (symbol, wait): what waiting a session is worth. (account, symbol, pred, age): last night's exit scores. (min_age,
    margin): the rule they are read by. (account, symbol, name, value): the exit model's inputs, one row each.
    """
    docs = _documents(spark, path, schema, one_per_line).withColumn("asof", F.coalesce("asof", F.lit("unknown")))
    head = ["asof", "market", "source"]
    wait = docs.select(*head, F.explode("entry_wait").alias("symbol", "wait"))
    scores = (docs.select(*head, F.explode("exit_scores").alias("account", "_m"))
              .select(*head, "account", F.explode("_m").alias("symbol", "_s")).select(*head, "account", "symbol", "_s.*"))
    rule = docs.filter(F.col("exit_rule").isNotNull()).select(*head, "exit_rule.*")
    inputs = (docs.select(*head, F.explode("exit_inputs").alias("account", "_m"))
              .select(*head, "account", F.explode("_m").alias("symbol", "_f"))
              .select(*head, "account", "symbol", F.explode("_f").alias("name", "value")))
    return wait, scores, rule, inputs


def as_of(spark: SparkSession, path: str) -> DataFrame:
    """The file's as-of text: `unknown` when it has none, `none` when there is no file."""
    docs = _documents(spark, path, PICKS_SCHEMA)
    return docs.agg(F.max(F.coalesce("asof", F.lit("unknown"))).alias("asof")).select(
        F.coalesce("asof", F.lit("none")).alias("asof"))


def rank_scores(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scores without funds and with their average-tie percent rank."""
    return pct_rank(drop_funds(scores), by or [], "score", "rank_pct")


def write_picks(docs: DataFrame, path: str, asof: Column | str, market: str, source: Column | str) -> None:
    """Pick documents as JSON, one per line, each headed by its date, market and source."""
    def text(value):
        return F.lit(value) if isinstance(value, str) else value

    docs.select(text(asof).alias("asof"), F.lit(market).alias("market"), text(source).alias("source"), "top").write.json(path)


def export_picks(scores: DataFrame, top: int = 30, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(one document per list with its `top` best rows, one row per symbol with its rank).

    The rank map goes out as rows: it has one entry per scored symbol and must not pass through one task.
    """
    by = by or []
    ranked = rank_scores(scores, by)
    best = top_k(ranked, by, top, [F.col("score").desc(), F.col("symbol")])
    row = F.struct("pos", "symbol", F.coalesce("name", F.lit("")).alias("name"),
                   F.round("score", 6).alias("score"), F.round("rank_pct", 4).alias("rank_pct"))
    rows = F.sort_array(F.collect_list(row))
    docs = best.groupBy(*by).agg(F.transform(rows, lambda r: F.struct(
        r["symbol"].alias("symbol"), r["name"].alias("name"), r["score"].alias("score"),
        r["rank_pct"].alias("rank_pct"))).alias("top"))
    ranks = ranked.select(*by, "symbol", F.round("rank_pct", 4).alias("rank_pct"))
    return docs, ranks
