"""Charges, sizes and expected edges over whole order tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import constants as C
from tickloom.functions.money import buy_terms, charges, fill_price, lots_cash_covers, whole_units
from tickloom.operators.scans import HOT, PART, along, running_sum
from tickloom.session import saved, ship_functions

ship_functions(__name__)
GST_ON_FEE = 1 + C.GST


def charge_orders(orders: DataFrame) -> DataFrame:
    """Adds every charge and the total to orders with side, product, value and broker."""
    parts = charges(F.col("side"), F.col("product"), F.col("value"), F.col("broker"))
    return orders.withColumns(parts)


def fill_orders(orders: DataFrame) -> DataFrame:
    """Adds `fill`, the price after slippage of `bps` basis points."""
    return orders.withColumn("fill", fill_price(F.col("price"), F.col("side"), F.col("bps")))


def size_orders(orders: DataFrame) -> DataFrame:
    """Adds `units`: whole lots the budget and the cash allow; 0 is a rejected order.

    Needs budget, cash, fill, product, broker, lot.
    """
    budget, cash, fill, lot = (F.col(c) for c in ("budget", "cash", "fill", "lot"))
    terms = buy_terms(F.col("product"), F.col("broker"))
    named = {k: F.col(f"_{k}") for k in terms}
    return (orders.withColumns({f"_{k}": v for k, v in terms.items()})
            .withColumn("_covered", lots_cash_covers(cash, fill, lot, named))
            .withColumn("units", whole_units(F.col("_covered"), budget, cash, fill, lot, named))
            .drop("_covered", *[f"_{k}" for k in terms]))


SLICES = 512           # ranges, of about as many rows each, in which scores meet measured points


def calibrate(scores: DataFrame, calibration: DataFrame, score: str = "score",
              name: str = "expected_net", slices: int = SLICES) -> DataFrame:
    """Score to measured net return: linear between points, flat beyond them, null when nothing is measured.

    An as-of join of any size on either side. Each distinct score is looked up once, so that equal scores do not meet in a
    task, and null scores take no part. Scores and points are cut at the quantiles of both together, from a mergeable sketch, and
    sorted within these slices, however the scores lie to the curve; the last point before and the first at or after a score
    come from its slice, or else are carried over from the slices around it, of which one line each is kept. Where the cuts
    fall changes no result.
    """
    points = calibration.filter(F.col("score").isNotNull()).select(
        F.col("score").cast("double").alias("_x"), F.struct(
            F.col("score").cast("double").alias("x"), F.col("expected_net").cast("double").alias("y")).alias("_p"))
    row = F.struct(*[F.col(f"`{c}`") for c in scores.columns])
    rows = scores.select(F.col(score).cast("double").alias("_x"), row.alias("_row"))
    asked = saved(rows.filter(F.col("_x").isNotNull()).select("_x").distinct())
    both = asked.withColumn("_p", F.lit(None).cast("struct<x:double,y:double>")).unionByName(points)
    found = both.agg(F.percentile_approx("_x", [i / slices for i in range(1, slices)], 4 * slices)).first()[0] or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(found))]).cast("array<double>")
    both = both.withColumn("_slice", F.size(F.filter(cuts, lambda c: c < F.col("_x"))))

    point = F.col("_p").isNotNull()
    ends = both.filter(point).groupBy("_slice").agg(F.min("_p").alias("low"), F.max("_p").alias("high"))
    grid = scores.sparkSession.range(len(set(found)) + 1).select(F.col("id").cast("int").alias("_slice")).join(ends, "_slice", "left")
    along = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)                # over the slices, a fixed number
    against = W.orderBy(F.col("_slice").desc()).rowsBetween(W.unboundedPreceding, -1)
    around = grid.select("_slice", F.last("high", True).over(along).alias("_under"), F.last("low", True).over(against).alias("_over"))

    up = W.partitionBy("_slice").orderBy("_x", point, "_p.y")
    down = W.partitionBy("_slice").orderBy(F.col("_x").desc(), point.desc(), F.col("_p.y").desc())
    met = (both.withColumn("_left", F.last("_p", True).over(up)).withColumn("_right", F.last("_p", True).over(down))
           .filter(~point).join(around, "_slice"))
    met = met.withColumn("_left", F.coalesce("_left", "_under")).withColumn("_right", F.coalesce("_right", "_over"))
    left, right, x = F.col("_left"), F.col("_right"), F.col("_x")
    between = left["y"] + (right["y"] - left["y"]) * (x - left["x"]) / (right["x"] - left["x"])
    value = F.when(left.isNull(), right["y"]).when(right.isNull(), left["y"]).otherwise(between)
    return rows.join(met.select("_x", value.alias("_value")), "_x", "left").select("_row.*", F.col("_value").alias(name))


def worth_it(expected_net: Column) -> Column:
    """The measured payoff is several times an intraday round trip; unmeasured means no."""
    return F.coalesce(expected_net >= C.EDGE_MULTIPLE * C.INTRADAY_ROUND_TRIP, F.lit(False))


def _free_buys(orders: DataFrame, floor: float) -> DataFrame:
    """Adds `_units` and `_need`: what each order buys and pays where cash is no matter, that is, by its budget alone."""
    budget, fill, lot, rate = (F.col(c) for c in ("_budget", "_fill", "_lot", "_rate"))
    unit = fill * lot
    lots = F.when((unit > 0) & rate.isNotNull() & (budget >= floor), F.floor(F.least(F.try_divide(budget, unit), F.lit(1e15))))
    wanted = F.when(F.col("_blocked") | F.col("_cash").isNull(), F.lit(0)).otherwise(F.greatest(F.coalesce(lots, F.lit(0)), F.lit(0)))
    value = F.col("_units") * fill
    fee = F.greatest("_low", F.least(F.col("_high"), F.col("_fee_rate") * value))
    return orders.withColumn("_units", (wanted * F.coalesce(lot, F.lit(0))).cast("bigint")).withColumn(
        "_need", F.when(F.col("_units") > 0, value + (value * rate + GST_ON_FEE * fee)).otherwise(0.0))


def fill_batch(orders: DataFrame, keys: list[str], order: list[str], floor: float = 0.0, stop: bool = False,
               cash_floor: float = 0.0, hot: int | None = HOT, dealt: bool = False) -> DataFrame:
    """One tick's buys per account, each limited by the cash the ones before it left.

    Needs budget, cash (at the start, the same for all of an account), fill, product, broker, lot; orders with `blocked` set,
    where there is such a column, buy nothing and leave their cash. Budgets under `floor` are skipped, or end the account's
    buying when `stop`; cash under `cash_floor` ends it. Adds units, spent and cash_after.

    Running sums of what the budgets alone would buy say where cash first binds: until there they are the result. From
    there on each buy decides the next, and the rest of an account's orders pass by a purse, sorted, without being held.
    An account with more than `hot` orders is summed in parts, and takes one task only for what comes after cash binds
    (None: accounts are known to have few). Orders `dealt` by account already are not shuffled again.
    """
    terms = buy_terms(F.col("product"), F.col("broker"))
    blocked = F.coalesce("blocked", F.lit(False)) if "blocked" in orders.columns else F.lit(False)
    numbers = {"_budget": F.col("budget"), "_cash": F.col("cash"), "_fill": F.col("fill"), **{f"_{k}": v for k, v in terms.items()}}
    ready = (orders.withColumns({k: v.cast("double") for k, v in numbers.items()})
             .withColumns({"_lot": F.col("lot").cast("bigint"), "_blocked": blocked}))
    helpers = ["_budget", "_before", "_fill", *[f"_{k}" for k in terms], "_lot", "_blocked"]
    free = ["_units", "_need", "_before", "_binds"]
    own = list(orders.columns)

    def affordable(cash, budget, fill, lot, rate, fee_rate, low, high):
        """The most units in whole lots within the budget and, charges included, the cash."""
        def cost(lots):
            value = lots * lot * fill
            return value + value * rate + GST_ON_FEE * max(low, min(high, fee_rate * value))

        if None in (fill, lot, rate) or fill * lot <= 0:
            return 0
        most = math.floor(min(min(budget, cash) / (fill * lot), 1e15))
        if most <= 0 or cost(1) > cash:
            return 0
        if cost(most) <= cash:
            return most * lot
        least = 1                                                # between one that is paid for and one that is not
        while most - least > 1:
            middle = (least + most) // 2
            least, most = (middle, most) if cost(middle) <= cash else (least, middle)
        return least * lot

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cash, stopped = None, 0.0, False
        for batch in batches:
            units, spent, before, binds = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in free)
            after, bound = before - spent, np.flatnonzero(binds > 0)
            rest = batch.take(pa.array(bound))
            names = zip(*[rest.column(k).to_pylist() for k in keys], strict=True)
            for i, name, line in zip(bound, names, zip(*[rest.column(h).to_pylist() for h in helpers], strict=True), strict=True):
                budget, start, fill, rate, fee_rate, low, high, lot, halted = line
                if name != group:
                    group, cash, stopped = name, start, False
                wanted = cash if budget is None else min(budget, cash)
                small = wanted < floor
                stopped = stopped or cash < cash_floor or (stop and small)
                n, paid = 0, 0.0
                if not (stopped or small or halted):
                    n = affordable(cash, wanted, fill, lot, rate, fee_rate, low, high)
                if n:
                    value = n * fill
                    paid = value + (value * rate + GST_ON_FEE * max(low, min(high, fee_rate * value)))
                    cash -= paid
                units[i], spent[i], after[i] = n, paid, cash
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in own], pa.array(units, pa.int64()), pa.array(spent, pa.float64()),
                 pa.array(after, pa.float64(), mask=np.isnan(before))], [*own, "units", "spent", "cash_after"])

    schema = T.StructType([*orders.schema.fields, T.StructField("units", T.LongType()), T.StructField("spent", T.DoubleType()),
                           T.StructField("cash_after", T.DoubleType())])

    def run(rows: DataFrame, span: DataFrame | None) -> DataFrame:
        rows = rows if span is not None or dealt else rows.repartition(*keys)
        rows = running_sum(_free_buys(rows, floor), keys, order, "_need", "_through", span)
        rows = rows.withColumn("_before", F.col("_cash") - (F.col("_through") - F.col("_need")))
        left = F.col("_before")
        binds = F.col("_budget").isNull() | (left < cash_floor) | ((F.col("_units") > 0) & ((left < F.col("_need")) | (left < floor)))
        if stop:
            binds = binds | (F.least("_budget", left) < floor)
        rows = rows.withColumn("_bind", (F.coalesce(binds, F.lit(False)) & left.isNotNull()).cast("int"))
        rows = running_sum(rows, keys, order, "_bind", "_binds", span)
        if span is None:                                         # an account's rows lie together, in the order of the sums
            return rows.sortWithinPartitions(PART, *keys, *order).mapInArrow(carry, schema)
        spent = F.col("_need")
        unbound = rows.filter("_binds = 0").select(*own, F.col("_units").alias("units"), spent.alias("spent"), (left - spent).alias("cash_after"))
        return unbound.union(rows.filter("_binds > 0").repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(carry, schema))

    return along(ready, keys, order, run, hot)
