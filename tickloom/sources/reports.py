"""Report files and the append-once logs."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import folders


def write_reports(tables: dict[str, DataFrame], out: str) -> None:
    """Each table as CSV with a header under `out`; a table named `summary` as JSON lines."""
    for name, df in tables.items():
        if name == "summary":
            df.write.mode("overwrite").json(f"{out}/{name}")
        else:
            df.write.mode("overwrite").csv(f"{out}/{name}", header=True, escape='"')


def read_trades_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A trade CSV with quoted fields; rows whose width differs from the header's are dropped."""
    return spark.read.csv(path, header=True, escape='"', multiLine=False, mode="DROPMALFORMED", schema=schema,
                          enforceSchema=False)


def read_log(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """A JSON-lines log; unreadable lines are skipped, a missing log is empty."""
    try:
        return spark.read.schema(schema).json(log, mode="DROPMALFORMED")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def append_new(df: DataFrame, log: str, key: str = "id") -> None:
    """Appends the rows whose key the log does not have yet."""
    seen = read_log(df.sparkSession, log, f"{key} string").filter(f"{key} IS NOT NULL").select(key).distinct()
    df.dropDuplicates([key]).join(seen, key, "left_anti").write.mode("append").json(log)


def claim(spark: SparkSession, staged: str, target: str) -> bool:
    """Moves `staged` to `target` unless that exists; false if another writer was first. As atomic as the store's rename."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    store = fs.Path(target).getFileSystem(conf)
    place = store.makeQualified(fs.Path(target))
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.NONE
    try:
        fs.FileContext.getFileContext(place.toUri(), conf).rename(store.makeQualified(fs.Path(staged)), place, options)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise


def read_commits(spark: SparkSession, log: str, schema: T.StructType, commits: list[int]) -> DataFrame:
    """Rows of these commits of a log that `append_once` writes, with the columns of `schema`."""
    if not commits:
        return spark.createDataFrame([], schema)
    paths = [f"{log}/commit={n}" for n in commits]
    return spark.read.schema(schema).option("basePath", log).parquet(*paths).select(*schema.names)


def read_once(spark: SparkSession, log: str, schema: T.StructType) -> DataFrame:
    """All rows of a log that `append_once` writes; a missing log is empty."""
    return read_commits(spark, log, schema, folders(spark, log))


def append_once(df: DataFrame, log: str, key: str = "id", day: str = "day") -> int:
    """Appends the rows whose (day, key) the log does not have yet, beside any number of other writers; the commit's number, or
    -1 if nothing was new.

    A batch is staged and becomes part of the log when its folder takes the next free number. A writer that loses that race
    leaves out what the winners wrote and tries again, so an id stands in the log once and one of the racers always gets on. Only
    the batch's own days of earlier commits are read. Of rows with one (day, key) the least stays; nulls are days and keys.
    """
    spark = df.sparkSession
    log = log.rstrip("/")
    names = df.columns
    rows = df.groupBy(day, key).agg(F.min(F.struct(*names)).alias("_row")).select("_row.*")
    days = [r[0] for r in df.select(day).distinct().collect()]                      # a calendar
    its_days = F.col(day).isin([d for d in days if d is not None]) | (F.col(day).isNull() if None in days else F.lit(False))
    last = -1
    while True:
        later = [n for n in folders(spark, log) if n > last]
        seen = read_commits(spark, log, df.schema, later).filter(its_days).select(
            F.col(day).alias("_day"), F.col(key).alias("_key")).distinct()
        rows = rows.join(seen, F.col(day).eqNullSafe(F.col("_day")) & F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        staged = f"{log}/_staged/{uuid.uuid4().hex}"
        rows.write.partitionBy(day).parquet(staged)
        rows = spark.read.schema(df.schema).parquet(staged).select(*names)         # a retry goes on from what is staged
        if rows.isEmpty():
            return -1
        last = max([last, *later])
        if claim(spark, staged, f"{log}/commit={last + 1}"):
            return last + 1
