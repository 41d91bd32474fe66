"""Ranks, medians, top-k and bounded samples that stay distributed when one group is huge.

A plain ranking window sorts each group in one task. `ordered_counts` instead counts per distinct
value, cuts every group into value ranges at sketched quantiles, and ranks inside the ranges; the cut
points only balance the work, the ranks are exact wherever the cuts fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

ALL = "_all"


def ordered_counts(df: DataFrame, by: list[str], value: str, ranges: int = 64,
                   weight: str | None = None) -> DataFrame:
    """One row per (group, distinct non-null value): rows at it, rows below it, rows in the group.

    A row counts once, or `weight` times. Columns: *by, value, n_at, n_below, n_group.
    """
    keys = by or [ALL]
    rows = df.filter(F.col(value).isNotNull())
    if not by:
        rows = rows.withColumn(ALL, F.lit(0))
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = rows.groupBy(*keys, value).agg(count.alias("n_at"))
    points = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, points, 1000).alias("_cuts"))
    placed = counts.join(cuts, keys) if by else counts.withColumn("_cuts", cuts.select("_cuts").scalar())
    placed = placed.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    whole = (placed.groupBy(*keys, "_range").agg(F.sum("n_at").alias("_in_range")))
    w = W.partitionBy(*keys)
    whole = whole.select(
        *keys, "_range",
        (F.sum("_in_range").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, 0))
         - F.col("_in_range")).alias("_before"),
        F.sum("_in_range").over(w).alias("n_group"))
    inside = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    out = (placed.withColumn("_below", F.sum("n_at").over(inside) - F.col("n_at"))
           .join(whole, [*keys, "_range"])
           .select(*by, value, "n_at", (F.col("_below") + F.col("_before")).alias("n_below"), "n_group"))
    return out


def average_rank_in(by: list[Column], value: Column) -> Column:
    """1-based rank of `value`, ties sharing their average rank, for groups known to be small."""
    tied = F.count(F.lit(1)).over(W.partitionBy(*by, value))
    rank = F.rank().over(W.partitionBy(*by).orderBy(value.asc_nulls_last()))
    return F.when(value.isNotNull(), rank + (tied - 1) / 2)


def pct_rank_in(by: list[Column], value: Column) -> Column:
    """Average-tie rank over the non-null count, for groups known to be small; null values rank null."""
    return F.try_divide(average_rank_in(by, value), F.count(value).over(W.partitionBy(*by)))


def pct_rank(df: DataFrame, by: list[str], value: str, name: str = "rank_pct", ranges: int = 64) -> DataFrame:
    """`df` plus average-tie rank over the group's non-null count, for groups of any size."""
    ladder = ordered_counts(df, by, value, ranges)
    rank = ladder.select(*by, value,
                         ((F.col("n_below") + (F.col("n_at") + 1) / 2) / F.col("n_group")).alias(name))
    return df.join(rank, [*by, value], "left")


def exact_median(df: DataFrame, by: list[str], value: str, name: str = "median",
                 weight: str | None = None) -> DataFrame:
    """One row per group: the exact median, found by position instead of collecting the values."""
    ladder = ordered_counts(df, by, value, weight=weight)
    lo, hi = F.floor((F.col("n_group") - 1) / 2), F.floor(F.col("n_group") / 2)

    def at(pos: Column) -> Column:
        return F.when((F.col("n_below") <= pos) & (pos < F.col("n_below") + F.col("n_at")), F.col(value) / 2)

    return ladder.groupBy(*by).agg((F.sum(at(lo)) + F.sum(at(hi))).alias(name))


def top_k(df: DataFrame, by: list[str], k: int, order: list[Column], name: str = "pos") -> DataFrame:
    """First `k` rows per group; Spark limits each input partition to `k` rows before the shuffle."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return df.withColumn(name, F.row_number().over(w.orderBy(*order))).filter(F.col(name) <= k)


def stable_hash(*cols: Column | str) -> Column:
    """32-bit hash that any SQL engine with md5 can reproduce."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def cap_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows in hash order of `keys`, without sorting the table.

    A histogram of the hash's top bits finds the slice where the n-th row falls; whole slices below it
    are kept and only that slice is numbered.
    """
    hashed = df.withColumn("_h", stable_hash(*[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    hashed = hashed.withColumn("_slice", F.shiftright("_h", 16).cast("int"))
    upto = F.sum("_n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, 0))
    slices = (hashed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))       # at most 65,536 rows
              .select("_slice", "_n", upto.alias("_upto")))
    whole = hashed.join(slices.filter(F.col("_upto") <= n), "_slice", "left_semi")
    cut = slices.filter((F.col("_upto") > n) & (F.col("_upto") - F.col("_n") < n))
    w = W.partitionBy("_slice").orderBy("_h", *keys)
    part = (hashed.join(cut, "_slice").withColumn("_pos", F.row_number().over(w))
            .filter(F.col("_upto") - F.col("_n") + F.col("_pos") <= n))
    return whole.select(*df.columns).unionByName(part.select(*df.columns))
