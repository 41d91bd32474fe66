"""Portfolio sizes per account and tick. Groups are the names one account may hold or buy: a dozen or so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tickloom import constants as C
from tickloom.functions.money import expected_gross, round_trip_cost


def confidence_weights(cands: DataFrame, keys: list[str], score: str = "score", rank: str = "rank_pct",
                       cap: float = C.CONFIDENCE_CAP, floor: float = C.CONFIDENCE_FLOOR) -> DataFrame:
    """Adds `weight`: shares that grow with the standardised score, capped, slivers dropped (null weight).

    Each pass cuts what exceeds the cap and spreads it over the names that do not exceed it, those sitting
    on the cap included, which is why passes repeat up to the number of names. Only 1/cap names can ever
    exceed the cap and all others grow by one common factor, so a pass needs just the largest few and that
    factor, whatever the size of the group.
    """
    w = W.partitionBy(*keys)
    s = F.coalesce(F.col(score), F.lit(0.0))
    sd = F.coalesce(F.stddev_samp(s).over(w), F.lit(0.0))
    by_score = F.exp(F.try_divide(s - F.avg(s).over(w), sd))
    by_rank = F.greatest(F.coalesce(F.col(rank), F.lit(0.5)) - 0.5, F.lit(1e-6))
    few = int(1 / cap)
    k, limit = F.col("_k"), F.col("_cap")
    c = cands.withColumn("_edge", F.when(sd > 0, by_score).otherwise(by_rank))
    c = c.withColumn("_share", F.col("_edge") / F.sum("_edge").over(w))
    c = c.withColumn("_k", F.row_number().over(w.orderBy(F.col("_share").desc())))
    c = c.withColumns({
        "_n": F.count(F.lit(1)).over(w),
        "_large": F.sort_array(F.collect_list(F.when(k <= few, F.col("_share"))).over(w), asc=False),
        "_others": F.coalesce(F.sum(F.when(k > few, F.col("_share"))).over(w), F.lit(0.0))})
    c = c.withColumn("_cap", F.greatest(F.lit(cap), 1 / F.col("_n")))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    def one_pass(acc: Column, _: Column) -> Column:
        spare = total(F.transform(acc["large"], lambda x: F.greatest(x - limit, F.lit(0.0))))
        rest = total(F.filter(acc["large"], lambda x: x <= limit)) + F.col("_others") * acc["factor"]
        gain = spare / F.when(rest == 0, F.lit(1.0)).otherwise(rest)
        return F.struct(F.transform(acc["large"], lambda x: F.when(x > limit, limit).otherwise(x * (1 + gain))).alias("large"),
                        (acc["factor"] * (1 + gain)).alias("factor"))

    # The passes run once per group, on its first row, and the group then shares the result.
    passes = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col("_n")),
                         F.struct(F.col("_large").alias("large"), F.lit(1.0).alias("factor")), one_pass)
    c = c.withColumn("_end", F.when(k == 1, passes)).withColumn("_end", F.max("_end").over(w))
    c = c.withColumn("_w", F.coalesce(F.get("_end.large", k - 1), F.col("_share") * F.col("_end.factor")))
    c = c.withColumn("_w", F.when((F.max("_w").over(w) < floor) | (F.col("_w") >= floor), F.col("_w")))
    weight = F.when(F.col("_w").isNotNull(), F.least(F.col("_w") / F.sum("_w").over(w), limit))
    return c.withColumn("weight", weight).drop("_edge", "_share", "_k", "_n", "_large", "_others", "_cap", "_end", "_w")


def edge_shares(cands: DataFrame, keys: list[str], edge: str = "edge", cap: float = C.EDGE_SHARE_CAP) -> DataFrame:
    """Adds `share`: cash in proportion to positive edges, none above the cap, the excess handed on exactly.

    With edges sorted downwards, the capped names are the shortest prefix after which the next name fits.
    """
    live = F.col(edge) > 0
    w = W.partitionBy(*keys)
    ranked = w.orderBy(F.when(live, F.col(edge)).desc_nulls_last(), F.col("symbol"))
    rest = ranked.rowsBetween(0, W.unboundedFollowing)
    c = (cands.withColumn("_n", F.count_if(live).over(w))
         .withColumn("_cap", F.greatest(F.lit(cap), F.try_divide(F.lit(1.0), F.col("_n"))))
         .withColumn("_above", F.row_number().over(ranked) - 1)
         .withColumn("_rest", F.sum(F.when(live, F.col(edge))).over(rest))
         .withColumn("_rate", F.try_divide(1 - F.col("_above") * F.col("_cap"), F.col("_rest"))))
    fits = live & (F.col(edge) * F.col("_rate") <= F.col("_cap"))
    c = c.withColumn("_first", F.min(F.when(fits, F.col("_above"))).over(w))
    c = c.withColumn("_level", F.max(F.when(F.col("_above") == F.col("_first"), F.col("_rate"))).over(w))
    share = (F.when(~F.coalesce(live, F.lit(False)), 0.0)
             .when(F.col("_first").isNull() | (F.col("_above") < F.col("_first")), F.col("_cap"))
             .otherwise(F.col(edge) * F.col("_level")))
    return c.withColumn("share", share).drop("_n", "_cap", "_above", "_rest", "_rate", "_first", "_level")


def with_best_book(cands: DataFrame, keys: list[str], rank: str = "rank_pct", budget: str = "budget",
                   max_names: int = C.MAX_BOOK) -> DataFrame:
    """The first `max_names` candidates (in `pos` order) with their `place`, and beside each the group's best
    book: how many names `n` to hold and the `ticket`; 0 when none pays."""
    group = W.partitionBy(*keys)
    w = group.orderBy("pos")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    k = F.col("place")
    c = cands.withColumn("place", F.row_number().over(w)).filter(k <= max_names)
    c = (c.withColumn("_ticket", F.col(budget) / k)
         .withColumn("_cost", round_trip_cost(F.col("_ticket")))
         .withColumn("_gross", expected_gross(F.col(rank)))
         .withColumn("_mean", F.avg("_gross").over(so_far) - F.col("_cost"))
         .withColumn("_worst", F.min("_gross").over(so_far) - F.col("_cost"))
         .withColumn("_score", F.col("_mean") * F.sqrt(k / (1 + (k - 1) * C.NAME_CORRELATION))))
    good = ((F.col("_ticket") >= C.MIN_TICKET) & (F.col("_worst") >= C.EDGE_MARGIN * F.col("_cost"))
            & (F.col("_score") > 0))
    best = F.max_by(F.struct(k.alias("n"), F.col("_ticket").alias("ticket")),
                    F.when(good, F.struct(F.col("_score"), -k))).over(group)
    return (c.withColumn("_b", best).withColumn("n", F.coalesce("_b.n", F.lit(0)))
            .withColumn("ticket", F.coalesce("_b.ticket", F.lit(0.0)))
            .drop("_b", "_ticket", "_cost", "_gross", "_mean", "_worst", "_score"))


def best_book(cands: DataFrame, keys: list[str], rank: str = "rank_pct", budget: str = "budget",
              max_names: int = C.MAX_BOOK) -> DataFrame:
    """One row per group: the size and ticket of its best book."""
    return with_best_book(cands, keys, rank, budget, max_names).filter(F.col("place") == 1).select(*keys, "n", "ticket")


def conviction_stakes(chosen: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `stake`: the ticket scaled by (expected / average expected) ** power within the account's limits.

    `chosen` needs expected, ticket, equity, wild, power; `held` holds the expectations of current holdings.
    """
    known = held.filter(F.col("expected").isNotNull()).groupBy(*keys).agg(
        F.sum("expected").alias("_held_sum"), F.count(F.lit(1)).alias("_held_n"))
    w = W.partitionBy(*keys)
    total = F.sum("expected").over(w) + F.coalesce("_held_sum", F.lit(0.0))
    count = F.count(F.lit(1)).over(w) + F.coalesce("_held_n", F.lit(0))
    c = chosen.join(known, keys, "left").withColumn("_ref", total / F.greatest(count, F.lit(1)))
    wild = F.col("wild")
    hi = F.when(wild, C.WILD_STAKE_HI).otherwise(C.STAKE_HI)
    cap = F.when(wild, C.WILD_MAX_WEIGHT).otherwise(C.STAKE_MAX_WEIGHT)
    scale = F.least(F.greatest(F.pow(F.try_divide("expected", "_ref"), F.col("power")), F.lit(C.STAKE_LO)), hi)
    stake = F.when((F.col("power") > 0) & (F.col("_ref") > 0),
                   F.least(F.col("ticket") * scale, cap * F.col("equity"))).otherwise(F.col("ticket"))
    return c.withColumn("stake", stake).drop("_held_sum", "_held_n", "_ref")


def equal_budget(cands: DataFrame, keys: list[str], cash: str = "cash") -> DataFrame:
    """Adds `budget`: the account's cash split evenly over its free candidates."""
    return cands.withColumn("budget", F.col(cash) / F.count(F.lit(1)).over(W.partitionBy(*keys)))


def slot_ticket(equity: Column, cash: Column, names: Column, free: Column) -> Column:
    """Equal share of the account, unless the cash per free slot is less."""
    return F.least(equity / names, F.try_divide(cash, free))
