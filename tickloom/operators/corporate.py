"""Splits and bonus issues applied to holdings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent_splits(actions: DataFrame, today: Column | str, days: int = 7) -> DataFrame:
    """Distinct events with an ex-date in the last `days` days and a ratio that changes something."""
    today = F.lit(today).cast("date") if isinstance(today, str) else today
    return (actions.filter(F.col("ex_date").between(F.date_sub(today, days), today)
                           & F.col("ratio").isNotNull() & (F.col("ratio") != 0) & (F.col("ratio") != 1))
            .select("symbol", "ex_date", "ratio").distinct())


def apply_splits(positions: DataFrame, actions: DataFrame) -> DataFrame:
    """Positions with every due event applied in ex-date order, plus `applied`, the audit of each.

    An event is due once per ex-date, for a holding opened before it that is not an option. Events are
    gathered per symbol first (a company has a handful in its life), so positions are joined, never grouped.
    """
    events = (actions.filter((F.col("ratio") > 0) & (F.col("ratio") != 1)).select("symbol", "ex_date", "ratio")
              .groupBy("symbol", "ex_date").agg(F.min("ratio").alias("ratio"))
              .groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("ex_date", "ratio"))).alias("_events")))
    p = positions.join(events, "symbol", "left")
    done = F.coalesce("splits", F.array().cast("array<date>"))
    due = F.when(F.col("product") == "option", F.array().cast("array<struct<ex_date:date,ratio:double>>")).otherwise(
        F.filter("_events", lambda e: (F.to_date("opened") < e["ex_date"]) & ~F.array_contains(done, e["ex_date"])))
    start = F.struct(
        F.col("qty").alias("qty"), F.lit(1.0).alias("factor"),
        F.array().cast("array<struct<ex_date:date,ratio:double,qty_before:bigint,qty_after:bigint>>").alias("applied"))

    def split(acc: Column, e: Column) -> Column:
        after = F.floor(acc["qty"] * e["ratio"] + 1e-9)
        return F.struct(after.alias("qty"), (acc["factor"] * e["ratio"]).alias("factor"),
                        F.concat(acc["applied"], F.array(F.struct(
                            e["ex_date"].alias("ex_date"), e["ratio"].alias("ratio"), acc["qty"].alias("qty_before"),
                            after.alias("qty_after")))).alias("applied"))

    none = F.array().cast("array<struct<ex_date:date,ratio:double>>")
    p = p.withColumn("_r", F.aggregate(F.coalesce(due, none), start, split))
    priced = [c for c in ("avg_price", "last_price", "prev_close") if c in positions.columns]
    return (p.withColumns({c: F.col(c) / F.col("_r.factor") for c in priced})
            .withColumn("qty", F.col("_r.qty"))
            .withColumn("splits", F.concat(done, F.transform("_r.applied", lambda a: a["ex_date"])))
            .withColumn("applied", F.col("_r.applied")).drop("_r", "_events"))


def action_log(adjusted: DataFrame) -> DataFrame:
    """One audit row per applied event: who, which, and the quantity before and after."""
    return adjusted.select("account", "symbol", F.inline("applied"))
