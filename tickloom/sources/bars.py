"""Bar files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import constants as C
from tickloom.functions.calendar import to_zone

FIELDS = ("open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, path: str, zone: str | None = C.EXCHANGE_ZONE, ts: str | None = None) -> DataFrame:
    """Bars from one parquet file per symbol, or from folders `symbol=...`, with local `ts` and `date`.

    The file stem is the symbol where the table has no symbol column. Column names match in any case; the
    time column is `ts`, or the one time column there is (pandas stores an index under many names, and in
    nanoseconds, which arrive as integers). Only the bar fields are read, and rows without a close are
    dropped at the scan. Naive stamps count as UTC; pass no zone where they are local already.
    """
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    raw = spark.read.parquet(path)
    inferred = [f.name for f in raw.schema if f.name.lower() == "symbol" and f.dataType != T.StringType()]
    if inferred:                     # folder names that look like numbers: read as text, or leading zeros are lost
        raw = spark.read.schema(T.StructType([
            T.StructField(f.name, T.StringType() if f.name in inferred else f.dataType) for f in raw.schema])).parquet(path)
    names = {c.lower(): c for c in raw.columns}
    kinds = dict(raw.dtypes)
    if ts is None:
        times = [c for c in raw.columns if c.lower() not in (*FIELDS, "symbol")
                 and (kinds[c].startswith("timestamp") or kinds[c] == "bigint")]
        ts = names.get("ts") or min(times, key=lambda c: kinds[c] == "bigint")
    stamp = F.col(f"`{ts}`")
    if kinds[ts] == "bigint":
        stamp = F.timestamp_micros(F.floor(stamp / 1000))
    symbol = (F.col(names["symbol"]) if "symbol" in names
              else F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"^(.*)\.parquet$", 1))
    rows = raw.select(symbol.alias("symbol"), to_zone(stamp, zone).alias("ts"),
                      *[F.col(names[f]).cast("double").alias(f) for f in FIELDS])
    return rows.filter(F.col("close").isNotNull()).withColumn("date", F.to_date("ts"))


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars in one folder per symbol, so that a symbol list prunes files."""
    bars.hint("rebalance", "symbol").write.partitionBy("symbol").parquet(path)


def latest_snapshot(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of the most recently modified snapshot that matches `pattern`, with its name as `source`.

    A snapshot is a parquet file or a folder of them. Only the listing is read to find it, and then only it.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    snapshot = F.regexp_extract("path", r"^(.*?\.parquet)(/|$)", 1)
    newest = files.groupBy(snapshot.alias("path")).agg(F.max("modificationTime").alias("at")).orderBy(
        F.col("at").desc(), F.col("path").desc()).first()
    if newest is None:
        raise FileNotFoundError(pattern)
    return spark.read.parquet(newest["path"]).withColumn("source", F.lit(newest["path"].rsplit("/", 1)[-1]))
