"""Walk-forward folds and the scores of rankings and trade filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tickloom import constants as C
from tickloom.operators.ranking import average_rank_in, exact_median, top_k


def fold_bounds(d: DataFrame, min_train: int = 6, period: str = "month") -> DataFrame:
    """One row per test period that has at least `min_train` earlier ones: its dates and training cutoff."""
    periods = (d.groupBy(F.trunc("date", period).alias("period"))
               .agg(F.min("date").alias("test_from"), F.max("date").alias("test_to")))
    w = W.orderBy("period")                                       # one row per calendar period
    return (periods.withColumn("fold", F.row_number().over(w) - 1).filter(F.col("fold") >= min_train)
            .select("fold", "period", "test_from", "test_to", F.date_sub("test_from", 1).alias("cutoff")))


def walk_forward_folds(d: DataFrame, min_train: int = 6, period: str = "month") -> DataFrame:
    """Rows per (fold, role): training rows lie strictly before the fold's cutoff."""
    daily = d.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    bounds = fold_bounds(daily, min_train, period)
    # Both tables are calendar sized: mark the cutoffs between the days and run one total along them.
    marks = (daily.select("date", F.lit(1).alias("_k"), "n", F.lit(None).cast("int").alias("fold"))
             .unionByName(bounds.select(F.col("cutoff").alias("date"), F.lit(0).alias("_k"),
                                        F.lit(0).cast("bigint").alias("n"), "fold")))
    run = F.sum("n").over(W.orderBy("date", "_k").rowsBetween(W.unboundedPreceding, 0))
    train = marks.withColumn("rows", run).filter(F.col("fold").isNotNull()).select(
        "fold", F.lit("train").alias("role"), "rows")
    tests = (daily.withColumn("period", F.trunc("date", period)).groupBy("period").agg(F.sum("n").alias("rows"))
             .join(bounds, "period").select("fold", F.lit("test").alias("role"), "rows"))
    return train.unionByName(tests)


def evaluate_ranker(preds: DataFrame, top: int = 5, cost: float = C.ROUND_TRIP) -> DataFrame:
    """One row: daily rank correlation, hit rate and returns of the top names, before and after costs.

    Needs symbol, date, prediction, label_ret, label_excess: one row per listed symbol and day, so ranks,
    positions and the day's totals come from one shuffle by date.
    """
    p, e, ret = F.col("prediction"), F.col("label_excess"), F.col("label_ret")
    known = p.isNotNull() & e.isNotNull()
    group = [F.col("date"), F.col("_known")]
    ranked = (preds.withColumn("_known", known)
              .withColumn("_rp", F.when(known, average_rank_in(group, p)))
              .withColumn("_re", F.when(known, average_rank_in(group, e)))
              .withColumn("_pos", F.row_number().over(
                  W.partitionBy("date").orderBy(p.desc_nulls_last(), F.col("symbol")))))
    best = (F.col("_pos") <= top) & p.isNotNull()
    # A day whose ranks do not vary has no correlation; `corr` itself would divide by zero there.
    ic = F.try_divide(F.covar_pop("_rp", "_re"), F.stddev_pop("_rp") * F.stddev_pop("_re"))
    days = ranked.groupBy("date").agg(
        ic.alias("ic"), F.avg(ret).alias("mkt"),
        F.avg(F.when(best, ret)).alias("ret"), F.count_if(best).alias("n"),
        F.count_if(best & (e > 0)).alias("hits"))
    return days.agg(
        F.count(F.lit(1)).alias("days"),
        F.avg("ic").alias("mean_ic"),
        (F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.count(F.lit(1)))).alias("ic_t"),
        F.try_divide(F.sum("hits"), F.sum("n")).alias("top_hit_vs_avg"),
        F.avg("ret").alias("top_avg_ret"), F.avg("mkt").alias("market_avg_ret"),
        (F.avg("ret") - cost).alias("top_net_after_costs"),
        F.try_divide(F.count_if(F.col("ret") - cost > 0), F.count_if(F.col("n") > 0)).alias("days_net_positive"))


def threshold_sweep(preds: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6)) -> DataFrame:
    """Results of taking every trade, and only those at or above each probability.

    Needs date, prob, net, success. Thresholds no trade reaches are left out.
    """
    rules = {"all trades": F.lit(True)}
    rules |= {f"probability >= {t:.0%}": F.coalesce(F.col("prob") >= t, F.lit(False)) for t in thresholds}

    def per_rule(grouped, columns: dict) -> DataFrame:
        """One aggregation for all rules, then a line per rule and group; the trades are not copied per rule."""
        wide = grouped.agg(*[F.struct(*[of(taken).alias(c) for c, of in columns.items()]).alias(f"_{i}")
                             for i, taken in enumerate(rules.values())])
        lines = F.array(*[F.struct(F.lit(rule).alias("rule"), *[F.col(f"_{i}.{c}").alias(c) for c in columns])
                          for i, rule in enumerate(rules)])
        keys = [c for c in wide.columns if not c.startswith("_")]
        return wide.select(*keys, F.inline(lines)).filter(F.col("n") > 0)

    count = F.count_if
    days = per_rule(preds.groupBy("date"), {
        "n": count, "won": lambda t: F.sum(F.when(t, F.col("success"))), "net": lambda t: F.sum(F.when(t, F.col("net"))),
        "n_net": lambda t: F.count(F.when(t, F.col("net")))})
    ladder = per_rule(preds.groupBy("net"), {"n": count})
    totals = days.groupBy("rule").agg(
        F.avg("n").alias("trades_per_day"), (F.sum("won") / F.sum("n")).alias("success_rate"),
        F.try_divide(F.sum("net"), F.sum("n_net")).alias("avg_net"), F.count(F.lit(1)).alias("_days"))
    return (totals.join(exact_median(ladder, ["rule"], "net", "median_net", weight="n"), "rule", "left")
            .withColumn("days_with_trades", F.when(F.col("rule") != "all trades", F.col("_days"))).drop("_days"))


def best_k(preds: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Results of taking the k most probable trades of each day. Needs symbol, date, entry_bar, hold_bars too."""
    best = top_k(preds, ["date"], max(ks), [F.col("prob").desc_nulls_last(), F.col("symbol"),
                                            F.col("entry_bar"), F.col("hold_bars")])
    each = best.select("date", "net", "success",
                       F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("pos"))).alias("k"))
    day = W.partitionBy("k", "date")                              # at most k rows
    each = each.withColumn("_day_net", F.avg("net").over(day)).withColumn(
        "_first", F.row_number().over(day.orderBy("net")) == 1)
    return (each.groupBy("k").agg(
        F.avg("success").alias("success_rate"), F.avg("net").alias("avg_net"),
        F.median("net").alias("median_net"),                      # at most k values a day
        (F.count_if(F.col("_first") & (F.col("_day_net") > 0)) / F.count_if("_first")).alias("days_profitable"))
        .select(F.format_string("best %d per day", F.col("k")).alias("rule"),
                F.col("k").cast("double").alias("trades_per_day"), "success_rate", "avg_net", "median_net",
                "days_profitable"))
