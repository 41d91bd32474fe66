"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tickloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on; the cluster's own settings win.

    Sizes (shuffle partitions, split bytes) are left to the cluster; AQE merges small shuffle
    partitions and splits skewed ones at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir`. Only a local master may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = os.environ.get("TICKLOOM_LOCAL_DIR") or tempfile.mkdtemp(prefix="tickloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """`df` written once under the shared folder and read back, for jobs that read it several times.

    Cuts the lineage as a checkpoint would, but computes the rows once and keeps them columnar.
    """
    path = scratch_path(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside gives its shuffle files back as soon as it is written; else they stay until the driver
    happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


TASK_ROWS = 1 << 19     # rows that a task sorts where `tasks_for` says into how many


def tasks_for(df: DataFrame, each: int = 1) -> int:
    """How many tasks take `df`'s rows, `TASK_ROWS` or so each, if a row becomes `each`; as many as there are cores, at least.

    Given to `repartition`, AQE does not merge them: it merges by shuffled bytes alone, however many sorts and columns follow in the
    same task. Counts `df`, so it is for tables whose files know their rows.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() * each // TASK_ROWS))


def folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers n of the complete folders named `something=n` under `path`, in order; none where there is no such path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(hadoop(path)):
        return []
    found = [str(f.getPath().getName()) for f in fs.listStatus(hadoop(path)) if f.isDirectory()]
    return sorted(int(name.split("=")[1]) for name in found if "=" in name and fs.exists(hadoop(f"{path}/{name}/_SUCCESS")))


def ship_functions(module: str) -> None:
    """Sends a module's functions to Python workers by value, so that workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
