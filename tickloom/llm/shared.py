"""Helpers several operators use: tables, ordered prefix sums and connected components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.session import saved

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ordered_parts(df: DataFrame, order: Sequence[str], part: str) -> DataFrame:
    """`df` range-sorted by `order`, written once, with the number of each row's part in column `part`.

    The parts are written so that their numbers and rows stay the same however often they are read.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(ranged.withColumn(part, F.spark_partition_id()))


def running_total(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """`df` with `name`: the sum of `value` over all rows before this one in the order of `order`, a bigint.

    Sums within range parts, plus the totals of earlier parts (one row per part). Ties must be of equal use:
    rows with equal `order` get their places in any order.
    """
    parts = ordered_parts(df.withColumn("_value", value.cast("bigint")), order, "_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (parts.groupBy("_part").agg(F.sum("_value").alias("_total"))
              .select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (parts.join(totals, "_part")
            .withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
            .drop("_value", "_part", "_before"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the pairs a-b, without the smallest nodes themselves."""
    ids, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = index[:len(a)], index[len(a):]
    label = np.arange(len(ids))
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    child = label != np.arange(len(ids))
    return ids[child], ids[label[child]]


class Links:
    """Collects pairs, and keeps a spanning forest of them so that memory follows the nodes, not the pairs."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.held, self.parts = most, 0, []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append((a, b))
            self.held += len(a)
            if self.held > self.most:
                self.parts = [self.tree()]
                self.held = len(self.parts[0][0])
                self.most = max(self.most, 2 * self.held)

    def tree(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return forest(*(np.concatenate(side) for side in zip(*self.parts, strict=True)))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node on an edge (columns u, v: bigint): root is the smallest node it can reach.

    Alternates large stars and small stars until nothing changes. Each round is a few aggregations and joins on
    a node; its result is written to the shared folder, so that a lost executor costs one round at most.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    now = saved(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(small.union(least).distinct())
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v", "v").distinct())
